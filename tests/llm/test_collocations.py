import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from ledgerflow.llm import collocations
from pyspark.sql import functions as F


def brute(rows, longest=5, least=100, top=2000):
    """By dictionaries of tuples, as the contract has it."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cand.items():
            for k in range(1, len(p)):
                for i in range(len(p) - k + 1):
                    x = p[i : i + k]
                    if x in cand and len(x) < len(p) and 100 * a >= 100 * cand[x]:
                        gone.add(x)
        rows_ = []
        for p, a in cand.items():
            if p not in gone:
                s, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def mine(df, **options):
    return sorted(map(tuple, collocations.collocations(df, "lang", "text", **options).collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_query_equals_dictionaries(spark):
    where = "/root/testdata/sf0.01"
    want = brute(duckdb.sql(f"select lang, text from '{where}/documents.parquet'").fetchall())
    out = collocations.query(spark, where)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 50
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("dense", [1, 1 << 15])
def test_random_texts_in_many_chunks(spark, monkeypatch, dense):
    """Chunks of a few words, tiles of four ids, ties, overlaps and phrases over the ends of chunks."""
    for name, value in (("SLICE_BYTES", 40), ("TILE_BITS", 2), ("HEAD", 2), ("DENSE", dense), ("FLUSH", 50)):
        monkeypatch.setattr(collocations, name, value)
    rows_a_batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if dense == 1 else rows_a_batch)
    random.seed(11)
    vocabulary = ["a", "b", "aa", "Ä", "é", "The", "x-y", "'s", "\x00", "w" * 50]
    rows = [(random.choice(["en", "de", None, "und", ""]), "".join(random.choice(vocabulary) + random.choice([" ", "  ", "\t", ". ", "\n", ",", " "]) for _ in range(random.choice([0, 3, 60])))) for _ in range(60)]
    rows += [("en", "a b c d e f " * 30), ("en", "a a a a a a a a"), (None, None), ("zz", "")]
    for options in ({"least": 3}, {"least": 2, "longest": 3, "top": 7}, {"least": 1, "longest": 2}):
        assert mine(frame(spark, rows).repartition(3), **options) == brute(rows, **{"longest": 5, **options})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)


def test_tiles_against_a_counter():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.002, 200_000) - 1, 20_000).astype(np.int64)
    ids[rng.random(len(ids)) < 0.05] = -1
    own = rng.random(len(ids)) < 0.9
    codes, a, b, n = collocations.pairs_of(ids, own)
    want, every = Counter(), set()
    for i in range(len(ids) - 1):
        if ids[i] >= 0 and ids[i + 1] >= 0:
            p = (int(ids[i]), int(ids[i + 1]))
            every.add(p)
            want[p] += int(own[i])
            assert (a[codes[i]], b[codes[i]]) == p
        else:
            assert codes[i] == -1
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == dict(want) and len(a) == len(every)


def test_awkward_rows(spark, awkward):
    rows = [(r.source, r.text) for r in awkward.collect()]
    more = awkward.withColumns({c: F.lit(1) for c in ("lang", "n", "id", "f", "phrase", "rank", "other")})
    other = more.toDF(*more.columns[:-1], "Text")
    got = sorted(map(tuple, collocations.collocations(other, "source", "text", least=2).collect()))
    assert got == brute(rows, least=2)
    assert mine(frame(spark, []), least=1) == [] and mine(frame(spark, [(None, None), ("a", "one")]), least=1) == []


def test_scores_are_exact(spark):
    rows = [(10**13 + 7, 10**15 - 3, 10**13 + 9, 10**13 + 11), (100, 9 * 10**14, 100, 100), (123456789012, 987654321098765, 123456789013, 223456789012), (7, 10, 7, 7)]
    out = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", collocations.score(*map(F.col, "anlr")).alias("s")).collect()
    assert [r.s for r in out] == [1000 * a * n // (x * y) for a, n, x, y in rows]


@pytest.mark.parametrize("shift", [0, 1 << 33])
def test_pairs_travel_packed_and_are_counted_over_chunks(spark, shift):
    """A chunk's pairs are one row a part, not one a pair; only frequent ones keep their chunks."""
    rng, parts, least = np.random.default_rng(5), 3, 20
    rows, want, having = [], Counter(), defaultdict(set)
    for chunk in range(6):
        ids = np.minimum(rng.geometric(0.05, 3000) - 1, 60).astype(np.int64)
        codes, a, b, n = collocations.pairs_of(ids, np.ones(len(ids), bool))
        pair_at = [(int(a[c]) + shift, int(b[c]) + shift) if c >= 0 else None for c in codes]
        codes, packed = collocations.dealt(codes, a + shift, b + shift, n, parts)
        assert packed.num_rows == parts
        rows += [(chunk, r["part"], r["base"], r["a"], r["b"], r["n"]) for r in packed.to_pylist()]
        want.update(p for p in pair_at if p)
        having.update({(chunk, int(c)): p for c, p in zip(codes, pair_at, strict=True) if p})
    df = spark.createDataFrame(rows, "chunk long, part int, base int, a binary, b binary, n binary")
    seen = collocations.counted(df, least).localCheckpoint()
    pairs = seen.where("f is not null").collect()
    assert {(r.a, r.b): r.f for r in pairs} == {p: f for p, f in want.items() if f >= least} and 0 < len(pairs) < len(want)
    table = spark.createDataFrame([(r.part, r.place, r.a * 100 + r.b) for r in pairs], "part int, place int, id long")
    got = {(r.to, int(c)): int(k) for r in collocations.numbered(seen, table).collect() for c, k in zip(collocations.dec(bytes(r.local), "<u4"), collocations.dec(bytes(r.id), "<u8"), strict=True)}
    assert got == {at: a * 100 + b for at, (a, b) in having.items() if want[a, b] >= least}
