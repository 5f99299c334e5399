"""Operator 2: mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A window of 1024 tokens takes from each queue its target share; the fraction a queue
was short of (its deficit) carries over to the next window. Dealt one window at a time this would be one long loop, so the
deficits are kept in closed form: sources are the leaves of a balanced binary tree, a node that has given out h tokens has
given ``h * left // total`` of them to its left child, and the remainder of that division is the deficit it carries. Any
window's share, and the place of any token of any queue, then follow from a few integer divisions, in any partition, in
any order, without loops over windows or messages between tasks. Shares are exact to within the tree's depth in tokens.

Targets may differ from what the queues hold. Then queues run dry at different times: dealing is cut into phases, each
with the shares of the queues that are left, and a phase is a tree of its own. A queue that runs dry within a phase ends with
it, so there are ``MOST_PHASES`` phases at most and the plan grows with the number of queues alone.

Two passes: tokenise and write the tokens with each document's place in its queue within the task's partition (one table in the
shared folder, no shuffle); then add each partition's offset in the queue (a sum per partition and source) and cut.

Defined results. Null text is empty, an empty document is its end token alone. Null sources are one queue. Repeated rows are
packed each for itself. Empty table: no pieces. Extra columns are left out. Only the last sequence is short; readers
pad it to 1024 unless its length is a power of two. A queue is a source; of more than ``MOST_QUEUES`` sources, those with the same
hash share a queue. Targets name sources; those of a shared queue add up.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ledgerflow.llm import scratch, textkit

LENGTH, END, MOST_QUEUES, MOST_PHASES, SLICE_BYTES = 1024, 0, 10_000, 64, 1 << 20
#: The query's target for a source is its share of all tokens to this power: small sources are met more often.
SMOOTHING = 0.7
#: Offsets of partitions and sources are broadcast up to so many rows, and joined by a shuffle beyond.
MOST_BROADCAST_ROWS = 200_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encoder of a text to ids, those of the named tokenizer's own ``encode``: the literal of an added token is that token. A
    ``.tiktoken`` rank file next to the tokenizer holds the same vocabulary and is several times faster (ids tested equal)."""
    from pathlib import Path

    ranks = Path(path).with_suffix(".tiktoken")
    added = json.loads(Path(path).read_text())["added_tokens"]
    plain = not any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    if ranks.exists() and plain:
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
        special = {t["content"]: t["id"] for t in added}
        encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        return lambda text: encoding.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def id_kind(path: str) -> type:
    """Integers that hold every id of the vocabulary: 16 bits halve the token table where they suffice."""
    from tokenizers import Tokenizer

    return np.uint16 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32


def tokenise(df: DataFrame, doc_id: str, text: str, source: str, path: str) -> DataFrame:
    """(part, source, queue, doc, before, n, ids): ``before`` counts the queue's tokens earlier in this task's partition."""
    docs = df.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    many = docs.select("source").distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES
    docs = docs.withColumn("queue", F.pmod(F.xxhash64("source"), F.lit(MOST_QUEUES)).cast("string") if many else F.col("source"))
    kind = id_kind(path)
    size_of = np.dtype(kind).itemsize
    schema = StructType([StructField("queue", StringType()), StructField("part", IntegerType()), StructField("source", StringType()), StructField("doc", docs.schema["doc"].dataType), StructField("before", LongType()), StructField("n", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, given = encoder(path), TaskContext.get().partitionId(), {}
        for t in textkit.in_slices(batches, "text", SLICE_BYTES):
            ids = [np.array([*encode(x or ""), END], kind).tobytes() for x in t.column("text").to_pylist()]
            before, queues, sources = [], t.column("queue").to_pylist(), t.column("source").to_pylist()
            for s, x in zip(queues, ids, strict=True):
                before.append(given.get(s, 0))
                given[s] = before[-1] + len(x) // size_of
            size = [len(x) // size_of for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(queues, pa.string()), pa.repeat(pa.scalar(part, pa.int32()), len(ids)), pa.array(sources, pa.string()), t.column("doc").combine_chunks(), pa.array(before, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())], schema.names)

    return scratch.table(docs.mapInArrow(run, schema), "tokens")


def muldiv(a: np.ndarray, b: int, d: int, more: int = 0) -> np.ndarray:
    """``(a * b + more) // d`` without overflow, for values below 2**52: a quotient in floating point is mended by the remainder, which
    wrapping 64-bit products give exactly."""
    if a.size <= 64:  # few values: Python's integers are exact too, and quicker than many array operations
        return np.array([(x * b + more) // d for x in a.tolist()], np.int64)
    a, b, d, more = (np.asarray(x, np.int64) for x in (a, b, d, more))
    q = np.atleast_1d(a * (b.astype(np.float64) / d)).astype(np.int64)
    rest = np.atleast_1d(a) * b + more - q * d
    return (q + rest // d).reshape(a.shape)


class Phase:
    """Dealing between the same queues with fixed shares: ``sizes`` tokens of each queue, all used up at the end.

    A node of the tree is a range of the sorted names; prefix sums give its tokens.
    """

    def __init__(self, start: int, sizes: dict[str, int], base: dict[str, int]):
        self.start, self.total = start, sum(sizes.values())
        self.sizes, self.base = sizes, base  # base: the tokens of each queue dealt before this phase
        self.names = sorted(s for s in sizes if sizes[s])
        self.sums = [0, *accumulate(sizes[s] for s in self.names)]
        self.known: dict[str, list] = {}  # paths asked for

    def path(self, queue: str) -> list[tuple[bool, int, int]]:
        """From the root: (is left, tokens of the left half, tokens of both)."""
        if queue in self.known:
            return self.known[queue]
        at, lo, hi, out = bisect_left(self.names, queue), 0, len(self.names), []
        while hi - lo > 1:
            mid = lo + (hi - lo) // 2
            out.append((at < mid, self.sums[mid] - self.sums[lo], self.sums[hi] - self.sums[lo]))
            lo, hi = (lo, mid) if at < mid else (mid, hi)
        self.known[queue] = out
        return out

    def dealt(self, queue: str, h: np.ndarray) -> np.ndarray:
        """Tokens of a queue among the first ``h`` of the phase."""
        for is_left, left, total in self.path(queue):
            given = muldiv(h, left, total)
            h = given if is_left else h - given
        return h

    def before(self, queue: str, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Tokens of queues ordered before this one among those from ``lo`` to ``hi``."""
        out = lo * 0
        for is_left, left, total in self.path(queue):
            a, b = muldiv(lo, left, total), muldiv(hi, left, total)
            if is_left:
                lo, hi = a, b
            else:
                out, lo, hi = out + b - a, lo - a, hi - b
        return out

    def rank(self, queue: str, c: np.ndarray) -> np.ndarray:
        """Place in the phase of the queue's token number ``c``."""
        for is_left, left, total in reversed(self.path(queue)):
            c = muldiv(c + 1, total, left, -1) if is_left else muldiv(c, total, total - left)
        return c


def phases(sizes: dict[str, int], targets: dict[str, float] | None = None, most: int = MOST_PHASES) -> list[Phase]:
    """Phases that use up all queues; without targets, one phase with the queues' own proportions."""
    left, base, start, out = dict(sizes), dict.fromkeys(sizes, 0), 0, []
    if targets is None:
        return [Phase(0, left, base)]
    share = {s: max(float(targets.get(s, 0)), 0) for s in sizes}
    while any(left.values()):
        active = [s for s in left if left[s] and share[s] > 0] or [s for s in left if left[s]]
        weight = {s: share[s] or 1.0 for s in active}
        ends = sorted(left[s] / weight[s] for s in active)
        rounds = ends[-(-len(ends) // max(1, most - len(out))) - 1]
        take = {s: min(left[s], int(round(rounds * weight[s]))) for s in active}
        for s in active:  # a queue that runs dry is used up, or a rounding would leave a token of it
            if left[s] / weight[s] <= rounds:
                take[s] = left[s]
        out.append(Phase(start, take, dict(base)))
        for s, n in take.items():
            left[s] -= n
            base[s] += n
        start += sum(take.values())
    return out


def cut_document(queue: str, c0: int, n: int, plan: list[Phase], length: int = LENGTH) -> list[np.ndarray]:
    """Pieces of a document whose tokens are ``c0 .. c0+n`` of its queue: start, length, sequence and offset arrays."""
    starts, sizes, sequences, offsets = [], [], [], []
    for p in plan:
        base = p.base.get(queue, 0)
        lo, hi = max(c0, base), min(c0 + n, base + p.sizes.get(queue, 0))
        if lo >= hi:
            continue
        ends = np.array([lo - base, hi - 1 - base])
        first, last = (int(x) for x in (p.rank(queue, ends) + p.start) // length)
        k = np.arange(first, last + 1)
        edge = np.clip(np.arange(first, last + 2) * length - p.start, 0, p.total)
        given = p.dealt(queue, edge)
        a, b = np.maximum(given[:-1], lo - base), np.minimum(given[1:], hi - base)
        keep = np.flatnonzero(a < b)
        # Tokens of an earlier phase in the same sequence come first.
        skipped = np.maximum(p.start - k * length, 0)
        offset = skipped + p.before(queue, edge[:-1], edge[1:]) + a - given[:-1]
        for out, v in zip((starts, sizes, sequences, offsets), (a + base - c0, b - a, k, offset), strict=True):
            out.append(v[keep].astype(np.int64))
    return [np.concatenate(x) for x in (starts, sizes, sequences, offsets)]


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None, targets: dict[str, float] | None = None, smoothing: float | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset, source.

    Windows hold the sources in the proportions of ``targets``, or of their shares to the power ``smoothing``, or of their shares.
    """
    path = path or tokenizer_path()
    kind = id_kind(path)
    tokens = tokenise(df, doc_id, text, source, path)
    sums = scratch.table(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "queues")
    sizes = {r.queue: int(r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # MOST_QUEUES at most
    if targets is None and smoothing is not None:
        targets = {s: n**smoothing for s, n in sizes.items()}
    elif targets is not None:
        of_queue = tokens.where(F.col("source").isin(list(targets))).groupBy("queue").agg(F.collect_set("source").alias("own")).collect()
        targets = {r.queue: sum(targets[s] for s in r.own) for r in of_queue}
    held = df.sparkSession.sparkContext.broadcast(phases(sizes, targets))  # MOST_PHASES numbers per queue at most
    offsets = sums.select(F.col("part").alias("p"), F.col("queue").alias("s"), (F.sum("n").over(W.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    if sums.count() <= MOST_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, (F.col("part") == F.col("p")) & (F.col("queue") == F.col("s"))).select("doc", "source", "n", (F.col("base") + F.col("before")).alias("at"), "ids", "queue")
    schema = StructType([StructField(doc_id, placed.schema["doc"].dataType), *(StructField(c, LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), StructField("source", StringType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plan = held.value
            queues, n, at = (b.column(i).to_pylist() for i in (5, 2, 3))
            for lo in range(0, b.num_rows, 500):  # rows at once, which bounds the pieces held
                cols, which, parts = [[], [], [], []], [], []
                for r in range(lo, min(lo + 500, b.num_rows)):
                    ids = np.frombuffer(b.column(4)[r].as_buffer(), kind).astype("<u4").tobytes()
                    found = cut_document(queues[r], at[r], n[r], plan, length)
                    for c, v in zip(cols, found, strict=True):
                        c.append(v)
                    which.append(np.full(len(found[0]), r))
                    parts += [ids[4 * s : 4 * (s + k)] for s, k in zip(found[0].tolist(), found[1].tolist(), strict=True)]
                start, size, sequence, offset = (pa.array(np.concatenate(c)) for c in cols)
                rows = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), start, size, b.column(2).take(rows), sequence, offset, b.column(1).take(rows), pa.array(parts, pa.binary())], schema.names)

    return placed.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    pieces = pack(docs, smoothing=SMOOTHING)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
