import collections

import duckdb
import numpy as np
from ledgerflow.llm import packing
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001/documents.parquet"


def check_layout(pieces, length=1024):
    """Pieces of each document tile it, pieces of each sequence tile it; all sequences but the last are full."""
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append((p.start, p.length, p.doc_tokens))
        seqs[p.sequence_id].append((p.offset, p.length))
    for rows in docs.values():
        at = 0
        for s, n, _ in sorted(rows):
            assert s == at
            at += n
        assert at == rows[0][2]
    for k, rows in seqs.items():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at == length or k == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))


def test_query_matches_brute_force(spark, sf):
    pieces = packing.query(spark, sf).collect()
    check_layout(pieces)
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    rows = duckdb.sql(f"select doc_id, text, source from '{DATA}'").fetchall()
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x, _ in rows}
    assert {p.doc_id for p in pieces} == set(ids)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == packing.crc32_of(ids[p.doc_id][p.start : p.start + p.length])
    size = collections.Counter()
    for d, _, s in rows:
        size[s] += len(ids[d])
    target = {s: n**packing.SMOOTHING for s, n in size.items()}
    total = sum(target.values())
    dry = min(n / target[s] for s, n in size.items()) * total  # tokens until the first queue is dry
    mix = collections.defaultdict(collections.Counter)
    for p in pieces:
        mix[p.sequence_id][p.source] += p.length
    depth = 2 * len(size).bit_length()
    full = [own for k, own in mix.items() if (k + 1) * 1024 < dry]
    assert full and all(abs(own[s] - 1024 * n / total) <= depth for own in full for s, n in target.items())
    last = max(mix)
    for k, own in mix.items():  # later too, queues that are left keep their proportions to each other
        if k < last - 2 and min(own.values()) > 30:
            a, b = own.most_common(2)
            assert abs(a[1] / b[1] - target[a[0]] / target[b[0]]) < 0.35 * target[a[0]] / target[b[0]]


def test_tree_matches_a_loop_that_carries_deficits():
    sizes = {"a": 1000, "b": 37, "c": 3, "d": 411}
    (p,) = packing.phases(sizes)
    order, total = [], sum(sizes.values())

    def deal(names, h):  # the node's token number h goes left when its deficit has grown to one
        if len(names) == 1:
            return names[0], h
        half = len(names) // 2
        left, all_ = sum(sizes[s] for s in names[:half]), sum(sizes[s] for s in names)
        before, after = h * left // all_, (h + 1) * left // all_
        return deal(names[:half], before) if after > before else deal(names[half:], h - before)

    order = [deal(sorted(sizes), h) for h in range(total)]
    assert collections.Counter(s for s, _ in order) == sizes
    for s, n in sizes.items():
        places = [h for h, (x, _) in enumerate(order) if x == s]
        assert places == p.rank(s, np.arange(n)).tolist()
        assert [sum(h < k for h in places) for k in range(0, total, 50)] == p.dealt(s, np.arange(0, total, 50)).tolist()
    big = {s: n * 10**11 + 7 for s, n in sizes.items()}
    (q,) = packing.phases(big)
    for s, n in big.items():
        c = [0, 1, n // 3, n - 1]
        assert q.dealt(s, q.rank(s, np.array(c))).tolist() == c and q.dealt(s, q.rank(s, np.array(c)) + 1).tolist() == [x + 1 for x in c]


def test_products_beyond_64_bits():
    rng = np.random.default_rng(6)
    for _ in range(300):
        d = int(rng.integers(1, 1 << int(rng.integers(1, 51))))
        b, a = int(rng.integers(0, d + 1)), rng.integers(0, 1 << 51, 20)
        for more in (0, -1):
            assert packing.muldiv(a, b, d, more).tolist() == [(int(x) * b + more) // d for x in a]


def test_many_queues_with_targets_need_few_phases():
    rng = np.random.default_rng(2)
    sizes = {f"s{k}": int(n) for k, n in enumerate(rng.integers(1, 4000, 500))}
    plan = packing.phases(sizes, dict.fromkeys(sizes, 1.0), most=8)
    assert len(plan) <= 8 and sum(p.total for p in plan) == sum(sizes.values())
    taken = np.zeros(-(-sum(sizes.values()) // 1024) * 1024, int)
    for s, n in sizes.items():
        start, size, sequence, offset = packing.cut_document(s, 0, n, plan)
        assert size.sum() == n and start.tolist() == (np.cumsum(size) - size).tolist()
        for k, o, m in zip(sequence, offset, size, strict=True):
            taken[k * 1024 + o : k * 1024 + o + m] += 1
    assert taken[: sum(sizes.values())].tolist() == [1] * sum(sizes.values())


def test_more_sources_than_queues(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(packing, "MOST_QUEUES", 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", (F.col("doc_id") % 9).cast("string"))
    rows = packing.pack(docs, targets={"1": 1.0, "2": 2.0}).collect()
    check_layout(rows)
    assert {r.source for r in rows} == {str(k) for k in range(9)}


def test_targets_and_awkward_rows(spark, awkward, sf):
    from pyspark.sql import functions as F

    pieces = packing.pack(awkward.drop("start", "length"))
    rows = pieces.collect()
    assert sum(p.length for p in rows if p.start + p.length == p.doc_tokens) > 0
    assert sum(1 for p in rows if p.doc_id in (2, 3)) == 2
    total = {(r.sequence_id, r.offset) for r in rows}
    assert len(total) == len(rows)
    assert packing.pack(awkward.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "y"))
    rows = packing.pack(docs, targets={"x": 0.5, "y": 0.25, "": 0.25}).collect()
    check_layout(rows)
    first = collections.Counter()
    for p in rows:
        if p.sequence_id == 0:
            first[p.source] += p.length
    assert abs(first["x"] - 512) <= 2 and abs(first["y"] - 256) <= 2


def test_literals_of_added_tokens_are_the_tokenizers_ids(spark):
    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["end <|endoftext|> next", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "<|endoftext| >", " <|ENDOFTEXT|>", "x<|endoftext|>\n\n  y", "<|<|endoftext|>|>", "na\u00efve <|endoftext|>\U0001f600"]
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(ids[0]) == 4 and [list(packing.encoder(packing.tokenizer_path())(x)) for x in texts] == ids
    pieces = packing.pack(spark.createDataFrame([(k, x, "s") for k, x in enumerate(texts)], "doc_id long, text string, source string")).collect()
    assert {p.doc_id: (p.doc_tokens, bytes(p.ids)) for p in pieces} == {k: (len(x) + 1, np.array([*x, 0], "<u4").tobytes()) for k, x in enumerate(ids)}
