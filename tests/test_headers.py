"""Header lines by profiles of banks: every bank's printed sample, and what lacks, ties or is awkward."""

from ledgerflow.operators import header_profiles
from ledgerflow.plans.header_queries import SAMPLES

WORDS = "file_id long, page_no int, bank string, line_id int, top double, word_seq int, text string, x0 double, x1 double"


def words_of(lines, bank, file_id=1, page_no=0):
    return [(file_id, page_no, bank, n, float(top), seq, text, float(x0), float(x1)) for n, (top, words) in enumerate(lines) for seq, (text, x0, x1) in enumerate(words)]


def cuts_of(spark, rows):
    out = header_profiles.header_cuts(spark.createDataFrame(rows, WORDS))
    return {(r.file_id, r.bank): (r.score, r.cuts) for r in out.groupBy("file_id", "bank").agg({"score": "max", "col_name": "count"}).select("file_id", "bank", "max(score)").withColumnRenamed("max(score)", "score").join(
        out.selectExpr("file_id", "bank", "struct(col_ord, col_name, x_left, x_right) c").groupBy("file_id", "bank").agg({"c": "collect_list"}).withColumnRenamed("collect_list(c)", "cuts"), ["file_id", "bank"]).collect()}


def plain(cuts):
    return [tuple(c)[1:] for c in sorted(cuts)]


def test_every_profile_reads_its_printed_sample(spark):
    assert set(header_profiles.PROFILES) == set(SAMPLES) - {"elsewhere"}
    rows = [w for k, (bank, (lines, *_)) in enumerate(SAMPLES.items()) for w in words_of(lines, bank, k)]
    got = cuts_of(spark, rows)
    for k, (bank, (_, score, cuts)) in enumerate(SAMPLES.items()):
        if not cuts:
            assert (k, bank) not in got
            continue
        assert got[k, bank][0] == score, bank
        assert plain(got[k, bank][1]) == [(c, float(a), float(b)) for c, a, b in cuts], bank


def test_single_money_word_and_reference_instead_of_value_date(spark):
    lines = [(94, [("Trans", 29, 50), ("Reference", 298, 320)]), (100, [("Narration", 80, 130), ("Money", 350, 375), ("In", 377, 385), ("Out", 452, 467)])]
    (_, cuts), = cuts_of(spark, words_of(lines, "sterling")).values()
    assert plain(cuts) == [("date", 0.0, 78.0), ("description", 78.0, 296.0), ("reference", 296.0, 348.0), ("credit", 348.0, (385 + 422) / 2), ("debit", (385 + 422) / 2, 1000.0)]


def test_ties_missing_columns_and_awkward_words(spark):
    twice = [("Date", 20, 50), ("Debit", 350, 390), ("Credit", 430, 480)]
    moved = [(t, a + 7, b + 7) for t, a, b in twice]
    rows = words_of([(100, twice), (200, moved)], "zenith", 1)  # equal scores: the upper line
    rows += words_of([(100, [("Date", 20, 50), ("Balance", 350, 390), ("Credit", 430, 480)])], "zenith", 2)  # a debit column is required
    rows += words_of([(100, [("Date", 20, 50), ("Debit", 350, 390)])], "zenith", 3)  # under the least score
    rows += words_of([(100, twice)], "nobody", 4) + words_of([(100, twice)], "wema", 4)  # no profile; a word that must be there lacks
    nulls = [(5, 0, "zenith", 0, 100.0, 9, None, 1.0, 2.0), (5, 0, "zenith", 0, 100.0, 10, "Date", None, 2.0), (5, 0, "zenith", 0, None, 11, "Date", 1.0, 2.0), (6, 0, None, 0, 1.0, 0, "Date", 1.0, 2.0)]
    rows += words_of([(100, twice)], "zenith", 5) + nulls
    got = cuts_of(spark, rows)
    assert set(got) == {(1, "zenith"), (5, "zenith")}
    assert plain(got[1, "zenith"][1]) == plain(got[5, "zenith"][1]) == [("date", 0.0, 200.0), ("debit", 200.0, 410.0), ("credit", 410.0, 1000.0)]
    assert header_profiles.header_cuts(spark.createDataFrame([], WORDS)).count() == 0


def test_several_banks_on_one_page_and_repeated_words(spark):
    lines = SAMPLES["wema"][0]
    got = cuts_of(spark, words_of(lines, "wema") + words_of(lines, "firstbank") + words_of(lines, "uba"))
    assert plain(got[1, "wema"][1]) == [(c, float(a), float(b)) for c, a, b in SAMPLES["wema"][2]]
    assert {name for name, *_ in plain(got[1, "firstbank"][1])} == {"date", "debit", "credit", "balance"}
    doubled = cuts_of(spark, words_of(lines, "wema") * 2)
    assert plain(doubled[1, "wema"][1]) == plain(got[1, "wema"][1])
