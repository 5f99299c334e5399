import random
import re

import corpus_pipeline
import duckdb
import numpy as np
from ledgerflow.llm import near_copies, simhash


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Ids that stay when texts at five-word similarity 0.8 link."""
    rows = sorted(rows)
    s = [sets_of(t) for _, t in rows]
    near = [[j for j in range(i) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])] for i in range(len(s))]
    lab = simhash.labels(len(s), np.array([i for i, r in enumerate(near) for _ in r], int), np.array([j for r in near for j in r], int))
    return [d for k, (d, _) in enumerate(rows) if lab[k] == k]


def test_repeated_line_and_near_copies_match_brute_force(spark, sf):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    line = " ".join(word() for _ in range(9))
    texts = []
    for _ in range(30):  # unrelated prose with one line as 40 % of the words
        prose = [word() for _ in range(400)]
        parts = [" ".join(prose[i : i + 15]) for i in range(0, 400, 15)]
        texts.append(f" {line} ".join(parts) + f" {line}" * 3)
    base = [word() for _ in range(200)]
    for edits in (1, 2, 3, 4, 4, 4, 5, 6, 8, 10) * 4:  # similarities around 0.8, chains of links among them
        copy = list(base)
        for k in rng.sample(range(200), edits):
            copy[k] = word()
        texts.append(" ".join(copy))
    for n in (100, 200, 300):
        long = [word() for _ in range(n)]
        texts += [" ".join(long[: int(n * k)]) for k in (1, 0.9, 0.82, 0.79, 0.7, 0.6)]
    texts += [None, "", " \n", "a b", "A b", "a b c", "a b c d e"]
    rows = list(enumerate(texts)) + [(1000 + d, t) for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.keep_one_copy(spark, df, sf)
    want = brute(rows)
    assert sorted(r.doc_id for r in got.collect()) == want
    assert set(range(30)) <= set(want)


def test_pairs_between_groups_are_all_found(spark, monkeypatch):
    """Without stars the pairs of the prefix index alone give the same rows."""
    monkeypatch.setattr(near_copies, "STARS", 1)
    rng = random.Random(5)
    base = [[str(rng.random()) for _ in range(60)] for _ in range(8)]
    rows = []
    for g in range(160):
        copy = list(base[g % 8])
        at = rng.randrange(60)
        copy[at : at + 1 + g % 4] = [str(rng.random())]
        rows.append((g, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.deduplicate(df).collect()) == brute(rows)
    assert near_copies.deduplicate(df.limit(0)).count() == 0


def test_blocks_of_signatures_find_what_pairs_find(spark, sf, monkeypatch):
    """With hardly any group compared as rows and tiny blocks, many pairs of blocks: the same rows."""
    for name, value in (("STARS", 1), ("FEW", 1), ("BLOCK", 6)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(70)]
    rows = []
    for g in range(90):
        copy = list(base)
        for at in rng.sample(range(70), rng.randrange(4)):
            copy[at] = str(rng.random())
        rows.append((g, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.deduplicate(df).collect()) == brute(rows)


def test_signatures_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 900, 30)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, k, replace=False)) for k in n]
    s = near_copies.signatures(np.concatenate(sets), n)
    for i in range(30):
        for j in range(30):
            assert np.bitwise_count(s[i] ^ s[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_sketches_of_any_width_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(2)
    n = np.array([0, 1, 511, 512, 513, 900, 1024, 1500, 2100, 5000])
    pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, k, replace=False)) for k in n]
    flat, end = near_copies.sketches(np.concatenate(sets), n)
    one = [v.tobytes() for v in np.split(flat, end[:-1])]
    assert [len(v) * 8 for v in one] == [512, 512, 512, 512, 1024, 1024, 1024, 2048, 4096, 8192]
    pairs = [(i, j) for i in range(10) for j in range(10)]
    found = near_copies.differing([one[i] for i, _ in pairs], [one[j] for _, j in pairs])
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, (i, j) in zip(found, pairs, strict=True))
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)  # unrelated sets of one size are told apart
    far = near_copies.sketches(other, np.array([5000]))[0].tobytes()
    assert 9 * near_copies.differing([one[9]], [far])[0] > 10000
    assert len(near_copies.differing([], [])) == 0 and near_copies.narrow(np.zeros(0, np.uint64), np.zeros(0, np.int64)).shape == (0, 8)
