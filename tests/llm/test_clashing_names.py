"""Input columns that differ from the text column in case only."""

from ledgerflow.llm import license_scan, near_copies, simhash

GRANT = next(iter(license_scan.TEMPLATES.values()))


def test_text_beside_text(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, GRANT, "z")], "doc_id long, text string, note string").toDF("doc_id", "text", "Text")
    for kept in (near_copies.deduplicate(df), simhash.deduplicate(df)):
        assert kept.columns == df.columns
        assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e f", "x"), (3, GRANT, "z")]
    found = license_scan.scan(df)
    assert found.columns == ["doc_id", "Text", "license", "containment", "start_word", "end_word"]
    assert {(r[0], r[1]) for r in found.collect()} == {(3, "z")}
