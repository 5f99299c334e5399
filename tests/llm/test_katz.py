import collections
import functools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from ledgerflow.llm import katz


def tokens(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), "</s>"]


class Brute:
    """The same model in plain dictionaries."""

    def __init__(self, docs):
        self.uni, self.bi = collections.Counter(), collections.Counter()
        for d, t in docs:
            if zlib.crc32(str(d).encode()) % 10:
                w = tokens(t)
                self.uni.update(w)
                self.bi.update(zip(["<s>", *w], w))
        self.n = sum(self.uni.values())
        d1, self.d2 = (katz.discounts(collections.Counter(c.values())) for c in (self.uni, self.bi))
        used = {w: c * (d1[c] if c < len(d1) else 1) for w, c in self.uni.items()}
        size = self.n if self.n - sum(used.values()) > 1e-9 * self.n else self.n + 0.5
        self.p1 = {w: u / size for w, u in used.items()}
        self.rest = 1 - sum(used.values()) / size
        self.next = collections.defaultdict(dict)
        for (h, w), c in self.bi.items():
            self.next[h][w] = c

    def p(self, w, h):
        low = self.p1.get(w, self.rest)
        if h not in self.next:
            return low
        seen = self.next[h]
        used = {x: c * (self.d2[c] if c < len(self.d2) else 1) for x, c in seen.items()}
        total = sum(seen.values())
        size = total if total - sum(used.values()) > 1e-9 * total else total + 0.5
        if w in used:
            return used[w] / size
        return (1 - sum(used.values()) / size) / (1 - sum(self.p1[x] for x in seen)) * low


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    return [*rows, (900001, None), (900002, ""), (900003, "the the the zzz-unseen the"), (900001, "A\x85b\xa0c ÀÉ")]


@pytest.mark.parametrize("bucket_tokens", [1 << 20, 700])
def test_scores_match_brute_force(spark, docs, bucket_tokens):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = Brute(docs)
    size = model.n + 0.1 * (len(model.uni) + 1)
    want = []
    for d, t in docs:
        w = tokens(t)
        base = sum(math.log10((model.uni[x] + 0.1) / size) for x in w)
        want.append((d, zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(model.uni[x] > 0 for x in w), model.n, base, sum(math.log10(model.p(x, h)) for h, x in zip(["<s>", *w], w))))
    got = [tuple(r) for r in katz.score(df, chunk_bytes=60_000, bucket_tokens=bucket_tokens).collect()]
    assert len(got) == len(want)
    for g, x in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == x[:5] and np.allclose(g[5:], x[5:], rtol=1e-9, atol=1e-9)


def recursive(docs, order):
    """Katz models of any length in plain dictionaries: p(w, h) and its recursion."""
    grams = [collections.Counter() for _ in range(order + 1)]
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 10:
            w = [*["<s>"] * (order - 1), *tokens(t)]
            for k in range(1, order + 1):
                grams[k].update(tuple(w[i - k + 1 : i + 1]) for i in range(order - 1, len(w)))
    d = [None, *(katz.discounts(collections.Counter(g.values())) for g in grams[1:])]
    used = lambda k, c: c * (d[k][c] if c < len(d[k]) else 1)
    size = lambda n, u: n if n - u > 1e-9 * n else n + 0.5
    n1, u1 = sum(grams[1].values()), sum(used(1, c) for c in grams[1].values())
    after = collections.defaultdict(dict)
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            after[g[:-1]][g[-1]] = c

    @functools.cache
    def context(h):
        seen, k = after[h], len(h) + 1
        total, u = sum(seen.values()), sum(used(k, c) for c in seen.values())
        return size(total, u), (1 - u / size(total, u)) / (1 - sum(p(w, h[1:]) for w in seen))

    @functools.cache
    def p(w, h):
        if not h:
            return used(1, grams[1][w,]) / size(n1, u1) if (w,) in grams[1] else 1 - u1 / size(n1, u1)
        if h not in after:
            return p(w, h[1:])
        if w in after[h]:
            return used(len(h) + 1, after[h][w]) / context(h)[0]
        return context(h)[1] * p(w, h[1:])

    return p


@pytest.mark.parametrize(("order", "bucket_tokens"), [(2, 700), (3, 1 << 20), (3, 700), (4, 900)])
def test_longer_contexts_match_the_recursion(spark, docs, order, bucket_tokens):
    p = recursive(docs, order)
    got = sorted((r.doc_id, r.score) for r in katz.score(spark.createDataFrame(docs, "doc_id long, text string"), order=order, chunk_bytes=60_000, bucket_tokens=bucket_tokens).collect())
    want = []
    for d, t in docs:
        w = [*["<s>"] * (order - 1), *tokens(t)]
        want.append((d, sum(math.log10(p(w[i], tuple(w[i - order + 1 : i]))) for i in range(order - 1, len(w)))))
    assert np.allclose(np.array(got), np.array(sorted(want)), rtol=1e-8)


def test_model_sums_to_one_and_beats_the_base(docs):
    model = Brute(docs)
    assert abs(sum(model.p1.values()) + model.rest - 1) < 1e-9
    for h in ["<s>", "the", "of", next(iter(model.uni)), "never seen"]:
        assert abs(sum(model.p(w, h) for w in model.uni) + model.p("never seen either", h) - 1) < 1e-9


def test_discounts():
    d = katz.discounts({1: 1000, 2: 400, 3: 220, 4: 150, 5: 110, 6: 80})
    assert all(0 < x < 1 for x in d[1:]) and abs((1000 * (1 - d[1]) + 800 * (1 - d[2]) + 660 * (1 - d[3]) + 600 * (1 - d[4]) + 550 * (1 - d[5])) - 1000) < 1e-6
    assert all(0 < x <= 1 for x in katz.discounts({})) and all(0 < x <= 1 for x in katz.discounts({1: 5}))


def test_awkward_rows(spark, awkward):
    rows = katz.score(awkward).collect()
    assert len(rows) == awkward.count() and all(math.isfinite(r.score) and r.score < 0 or r.score == 0 for r in rows)
    assert katz.score(awkward.limit(0)).count() == 0
    assert [r.train_tokens for r in katz.score(spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")).collect()][0] == 0


def test_counts_beyond_32_bits(spark):
    """Two chunks of a corpus whose n-gram counts and word numbers pass 2 ** 32."""
    import numpy as np
    from ledgerflow.llm import katz

    big = np.array([3, 2**32 + 5, 2**40], np.int64)
    assert katz.dec(katz.enc(big, "<u8"), "<u8").tolist() == big.tolist()
    key, word, seen = np.array([1 << 8, 2 << 8], np.uint64), np.array([7, 2**33 + 1], np.int64), np.array([2**32 - 1, 2**31 + 1], np.int64)
    rows = [(c, 0, katz.enc(katz.gaps(key), "<u8"), katz.enc(word, "<u8"), katz.enc(seen, "<u4"), None, None, None) for c in range(3)]
    occ = spark.createDataFrame(rows, "chunk long, bucket int, h binary, w binary, seen binary, low binary, n binary, doc binary")
    uni = katz.Unigrams([(5, 2), (1, 1)], 1)
    (row,) = katz.ngram_counts(occ, uni).collect()
    assert katz.dec(bytes(row.c), "<u8").tolist() == [3 * (2**32 - 1), 3 * (2**31 + 1)] and katz.dec(bytes(row.w), "<u8").tolist() == word.tolist()
