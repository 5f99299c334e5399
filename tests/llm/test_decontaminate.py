import re

import duckdb
from ledgerflow.llm import decontaminate as d
from pyspark.sql import functions as F


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(d.WORD, t)


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[at : at + size]), set()).update([] if i is None else [str(i)])
    out = []
    for doc, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[at : at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    ids |= got
        out.append((doc, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def found(df, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.select("doc_id", "n_words", "n_hit", "items").collect()), key=str)


def test_matches_brute_force_in_small_chunks_and_blocks(spark, sf):
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    docs += [(9001, items[0][1] + " " + items[0][1]), (9002, "x " + items[1][1][: len(items[1][1]) // 2]), (9003, "one"), (9004, None), (9005, ""), (9003, "short ITEM, of four"), (9006, "here is an item, without an ID: hit")]
    items += [(77, "Short item of FOUR"), (78, "one"), (79, ""), (80, None), (77, "the the the the the the the the the the the the"), (None, "an item without an id")]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert any(x[2] for x in want) and (9006, 8, 5, []) in want
    index = d.build_index(a, chunk_bytes=20_000)
    assert found(d.search(index, d.windows(b)).withColumnRenamed("doc", "doc_id")) == want
    assert found(d.search(index, d.windows(b), block=150).withColumnRenamed("doc", "doc_id")) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha x x x x x x beta"), (3, "beta y y alpha"), (4, "alpha"), (5, "beta")], "doc_id long, text string")
    near = spark.createDataFrame([(["alpha", "beta"], ["q"])], "words array<string>, items array<string>")
    got = d.search(d.build_index(docs), near, within=3).where("n_hit > 0")
    assert {r.doc for r in got.collect()} == {1, 3}


def test_awkward_rows(spark, awkward):
    items = spark.createDataFrame([(1, "the quick brown"), (2, None), (None, "only words")], "item_id long, text string").withColumn("doc", F.lit(1))
    out = d.decontaminate(awkward, items)
    assert out.count() == awkward.count()
    assert {(r.doc_id, r.n_hit) for r in out.where("n_hit > 0").collect()} == {(1, 3), (None, 2)}
    assert d.decontaminate(awkward.limit(0), items).count() == 0
    assert d.decontaminate(awkward, items.limit(0)).where("n_hit > 0").count() == 0
