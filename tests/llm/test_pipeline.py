import corpus_pipeline
import duckdb
import pyarrow as pa
from ledgerflow.llm import quality
from test_decontaminate import brute as leaks_of
from test_near_copies import brute as stay
from test_packing import check_layout


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")

    good = corpus_pipeline.keep_good(spark, docs, sf)
    model = quality.train(docs.select("doc_id", "text"), labels)
    want = {d for d, t in texts.items() if model.score(quality.features_of(pa.array([t])))[0] >= 0.3}
    good_ids = {r.doc_id for r in good.collect()}
    assert good.columns == columns and good_ids == want
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(truth[d] == 1 for d in truth if d not in good_ids) <= 1

    single = corpus_pipeline.keep_one_copy(spark, good, sf)
    single_ids = {r.doc_id for r in single.collect()}
    assert single.columns == columns and single_ids == set(stay([(d, texts[d]) for d in good_ids]))

    clean = corpus_pipeline.drop_leaks(spark, single, sf)
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    hit = {r[0] for r in leaks_of([(d, texts[d]) for d in single_ids], items) if r[2]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == single_ids - hit

    pieces = corpus_pipeline.pack(spark, clean, sf).collect()
    check_layout(pieces)
    assert {p.doc_id for p in pieces} == single_ids - hit


def test_null_ids_and_repeated_rows(spark, awkward, sf):
    docs = awkward.select("doc_id", "text", "source")
    one = corpus_pipeline.keep_one_copy(spark, docs, sf)
    assert one.where("doc_id is null").count() == 1
    assert corpus_pipeline.drop_leaks(spark, docs, sf).count() == docs.count()
    assert corpus_pipeline.drop_leaks(spark, docs.limit(0), sf).count() == 0
