import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from ledgerflow.llm import merkle
from pyspark.sql import functions as F

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(hashes):
    """Root, and for each leaf its steps (left, right) by loops."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i in range(len(hashes)):
            k = at[i]
            left = level[k - 1] if k % 2 else ""
            right = level[k + 1] if k % 2 == 0 and k + 1 < len(level) else ""
            steps[i].append((left, right))
            at[i] = k // 2
        level = [H(*level[j : j + 2]) for j in range(0, len(level), 2)]
    return level[0], steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    inner = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    root, outer = tree([inner[g][0] for g in names]) if names else (None, [])
    out = []
    for k, g in enumerate(names):
        for r, steps in zip(groups[g], inner[g][1], strict=True):
            path = steps + outer[k]
            changed = list(r)
            if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                changed[3] += 1
            h = leaf(changed)
            for a, b in path:
                h = H(a, h, b)
            out.append((r[0], leaf(r), inner[g][0], root, H(*[x for s in path for x in s]), h, h == root))
    return Counter(out)


def mine(spark, df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return Counter(map(tuple, merkle.verified_manifest(df, FIELDS, "doc_id", "lang", {"n_chars": tampered}).collect()))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_query_equals_loops_and_sql(spark, sf):
    rows = duckdb.sql(f"select {', '.join(FIELDS)} from '{sf}/documents.parquet'").fetchall()
    out = merkle.query(spark, sf)
    got = Counter(map(tuple, out.collect()))
    assert got == brute(rows) and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert {r[-1] for r in got} == {True, False}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == Counter(con.execute(merkle.SQL).fetchall())


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_every_shape_of_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i, f"s{i % 3}", lang, i * 10, f"text {i}") for n, lang in [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "é"), (17, None), (33, ""), (64, "zz")] for i in range(n)]
    assert mine(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    long_text = "wörd " * 300_000
    rows = [(1, "s", "en", 3, "a"), (1, "s", "en", 3, "a"), (1, "s", "en", 4, "a"), (None, None, None, None, None), (None, "s", "en", 1, ""), (7, "", "", None, long_text), (-5, "-", "en", 0, "1:a"), (2, "a", None, 5, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mine(spark, df) == brute(rows)
    more = df.withColumns({c: F.lit(1) for c in ("key", "h", "leaf", "slot", "size", "block", "path", "left", "at", "now", "id", "root", "other")})
    assert mine(spark, more.toDF(*more.columns[:-1], "Text")) == brute(rows)
    assert mine(spark, df.limit(0)) == Counter()
    assert mine(spark, df.where("doc_id = 7")) == brute([rows[5]])


def test_any_change_is_found(spark):
    rows = [(i, "s", "en", 5, f"t{i}") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    for column in FIELDS[1:]:
        out = merkle.verified_manifest(df, FIELDS, "doc_id", "lang", {column: F.when(F.col("doc_id") == 4, F.lit(None)).otherwise(F.col(column))})
        assert {r.doc_id for r in out.where("not verified").collect()} == {4}


def test_fields_can_not_be_shifted():
    assert leaf((1, "2", None)) != leaf((1, None, "2")) != leaf((12, "", None))


def test_one_group_with_all_rows_is_cut_into_blocks(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "id as n_chars", "'x' as text")
    out = merkle.verified_manifest(df, FIELDS, "doc_id", "lang", {})
    rows = out.select("root", "verified").distinct().collect()
    want, _ = tree([leaf((i, "s", "en", i, "x")) for i in range(5000)])
    assert [(r.root, r.verified) for r in rows] == [(want, True)]
