import re

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from ledgerflow.llm import simhash

DATA = "/root/testdata/sf0.001/documents.parquet"


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def groups(ids, codes):
    best = list(ids)
    while True:
        new = [min(best[j] for j in range(len(ids)) if bin(codes[i] ^ codes[j]).count("1") <= 3) for i in range(len(ids))]
        if new == best:
            return best
        best = new


def test_fingerprints_match_brute_force():
    texts = [r[0] for r in duckdb.sql(f"select text from '{DATA}' limit 60").fetchall()] + [None, "", " \n", "a b", "A", "a\x85b c\xa0d e", "x  y\tz\n\nw"]
    got = simhash.fingerprints_of(pa.chunked_array([pa.array(texts)]))
    assert [int(x) for x in got] == [brute(t) for t in texts]
    assert len(simhash.fingerprints_of(pa.chunked_array([], pa.string()))) == 0


def test_index_search_finds_exactly_the_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    codes = np.unique(np.concatenate([base, near, np.arange(200, dtype=np.uint64)]))
    want = {(int(codes[i]), int(codes[j])) for i, j in zip(*np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= 3), strict=True) if i <= j}
    x = codes[simhash.gray_order(codes)]
    got = {tuple(sorted((int(x[i]), int(x[j])))) for a, b in simhash.search(x, x, True, 3) for i, j in zip(a, b, strict=True)}
    assert got == want


def test_query_matches_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{DATA}'").fetchall()
    codes = [brute(t) for _, t in rows]
    want = groups([r[0] for r in rows], codes)
    assert got == {r[0]: (f"{c:016x}", w) for r, c, w in zip(rows, codes, want, strict=True)}


def test_many_blocks_give_the_same_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 150, dtype=np.int64)
    codes = np.unique(np.concatenate([base, base ^ 1, base ^ 6, base ^ (7 << 30), np.arange(60)]))
    df = spark.createDataFrame([(r, int(c)) for c in codes for r in (0, 1)], "round int, fp long")
    edges = simhash.link_edges(df, block=5)
    assert {r["round"] for r in edges.collect()} == {0, 1}
    got = {r.a: r.component for r in simhash.components(edges.where("round = 1")).collect()}
    lab = simhash.labels(len(codes), *np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= 3))
    assert {int(c): got.get(int(c), int(c)) for c in codes} == {int(c): int(codes[k]) for c, k in zip(codes, lab, strict=True)}


def test_awkward_rows(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp0, r.component_id))
    assert by[2] == by[3] == by[4] == {(0, 2)} and by[5] == by[6] and len(by[1]) == 1
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark, awkward):
    kept = simhash.deduplicate(awkward)
    rows = simhash.near_duplicates(awkward).collect()
    assert kept.columns == awkward.columns and kept.count() == len({r.component_id for r in rows})
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in rows}
    assert simhash.deduplicate(awkward.limit(0)).count() == 0


def test_rounds_find_more_near_copies_and_no_strangers(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for g in range(40):
        base = [word() for _ in range(300)]
        edited = list(base)
        for _ in range(5):
            edited[rng.randrange(300)] = word()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(edited))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (simhash.near_duplicates(df, rounds=k).collect() for k in (1, 12))
    caught = lambda rows: sum(r.doc_id != r.component_id for r in rows)
    assert caught(many) >= max(caught(one), 30) and all(r.component_id // 2 == r.doc_id // 2 for r in many)
