"""Operator 6: SimHash near-duplicates found with a Gray-order hierarchical index.

1. Fingerprints: one pass over whole texts; a bit is set when more than half of the shingles' XXH64 have it.
2. Equal fingerprints collapse to one, so thousands of copies cost one index entry.
3. The distinct fingerprints are range-partitioned by Gray rank into blocks. Neighbours in Gray order share many bits;
   a node keeps the bits that all below it share (mask and pattern), and groups of 64 nodes form the level above.
4. Pairs of nodes descend from the top: a pair whose shared bits already differ in more than ``bits`` places is dropped
   with all that lies below it. Surviving pairs of blocks are searched the same way, in memory, down to single
   fingerprints. A block pair returns a spanning forest of its links and never all pairs of a dense group.
5. Components of the links, by distributed star rounds.

With ``rounds`` above one, each text gets further fingerprints from the same shingles under other bit mixings, each has an
index of its own, and a link in any of them counts: near copies that one fingerprint misses by a bit are found by another,
while the distance that counts as a link stays small and the index selective.

Defined results. Null or empty text, or text without words: fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence is one shingle. Repeated rows share fingerprint and component. Empty table: empty result.
A component's id is its smallest document id, null only if all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from ledgerflow.llm import scratch, textkit
from ledgerflow.llm.components import components

WORDS, BITS, SEED = 3, 3, 42
BLOCK, FAN_OUT = 16_384, 64
SLICE_BYTES, PAIRS_AT_ONCE = 1 << 20, 1 << 20


def fingerprints_of(column: pa.ChunkedArray, words: int = WORDS, seed: int = SEED, rounds: int = 1) -> np.ndarray:
    """Unsigned 64-bit fingerprints of each text: one, or with ``rounds`` above one a row of them per text."""
    w = textkit.scan(column, "space")
    length = w.end - w.start
    buffer = np.full(int(length.sum()) + len(length), 32, np.uint8)
    inside = np.flatnonzero(np.repeat(True, int(length.sum()))) if len(length) else np.zeros(0, np.int64)
    source = np.repeat(w.start - (np.cumsum(length) - length), length) + inside
    buffer[inside + np.repeat(np.arange(len(length)), length)] = w.data[source]
    start = np.cumsum(length + 1) - length - 1
    end = start + length
    first, counts = w.first[:-1], w.counts
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))  # shingles of each text
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    last = at + np.repeat(np.minimum(counts, words), n) - 1
    whole = buffer.tobytes()
    hashes = np.fromiter((xxh64_intdigest(whole[a:b], seed) for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
    out = np.zeros((len(counts), rounds), np.uint64)
    for r in range(rounds):
        hashes = textkit.mix(hashes + np.uint64(r)) if r else hashes
        out[:, r] = fold(hashes, n)
    return out if rounds > 1 else out[:, 0]


#: For each byte, its bits as the bytes of one integer, so that adding integers counts eight bits at once.
LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(j)) & np.uint64(1)) << np.uint64(8 * j) for j in range(8))


def fold(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from its ``n`` hashes: the bits set in over half of them; zero without any."""
    out = np.zeros((len(n), 8), np.uint8)
    some = np.flatnonzero(n)
    if len(some):
        runs = -(-n[some] // 255)  # a lane counts to 255
        first = np.repeat((np.cumsum(n) - n)[some], runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
        each = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes = np.add.reduceat(LANES[each[:, k]], first).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(lanes, np.cumsum(runs) - runs, axis=0, dtype=np.int64)
            out[some, k] = np.packbits(ones * 2 > n[some, None], axis=1, bitorder="little")[:, 0]
    return out.view("<u8")[:, 0]


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, rounds: int = 1, keep_text: bool = False) -> DataFrame:
    """``df``, without its text unless kept, with the fingerprints as (signed) long columns ``fp0``, ``fp1`` ..."""
    names = [f"fp{r}" for r in range(rounds)]
    rest = [c for c in df.columns if (keep_text or c != text) and c not in names]
    schema = StructType([*df.select(*rest).schema.fields, *(StructField(c, LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.in_slices(batches, text, SLICE_BYTES):
            fp = fingerprints_of(t.column(text), words, rounds=rounds).reshape(-1, rounds).view(np.int64)
            out = t.select(rest)
            for r, c in enumerate(names):
                out = out.append_column(c, pa.array(fp[:, r]))
            yield from out.to_batches()

    return df.select(*dict.fromkeys([*rest, text])).mapInArrow(run, schema)


def gray_rank(fp: Column) -> Column:
    """Place of the 64-bit code in the reflected Gray sequence, in an order that signed comparison keeps."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _shared(groups: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Node per round and key: the bits below it that are all one (``low``) and those with any one (``high``)."""
    return groups.groupBy("round", key).agg(F.bit_and(low).alias("low"), F.bit_or(high).alias("high")).withColumnRenamed(key, "node")


def _apart(a: str, b: str) -> Column:
    """Differences that are certain from the bits each node's members share."""
    known = lambda n: F.bitwise_not(F.col(f"{n}.low").bitwiseXOR(F.col(f"{n}.high")))
    return F.bit_count(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low")).bitwiseAND(known(a)).bitwiseAND(known(b)))


def block_pairs(blocks: DataFrame, n_blocks: int, bits: int) -> DataFrame:
    """(round, a, b): pairs of blocks (a <= b) that may hold a link, found by descending the levels of nodes."""
    levels = [_shared(blocks, "block", "fp", "fp")]
    size = n_blocks
    while size > FAN_OUT:
        levels.append(_shared(levels[-1].withColumn("up", F.floor(F.col("node") / FAN_OUT).cast("int")), "up", "low", "high"))
        size = -(-size // FAN_OUT)
    pairs = None
    for level in reversed(levels):
        nodes = level.withColumn("up", F.floor(F.col("node") / FAN_OUT).cast("int"))
        if pairs is None:  # the top: at most FAN_OUT nodes of a round, all under one root
            pairs = nodes.select("round", F.lit(0).alias("a"), F.lit(0).alias("b")).distinct()
        same = lambda n: F.col("p.round") == F.col(f"{n}.round")
        met = pairs.alias("p").join(nodes.alias("x"), same("x") & (F.col("p.a") == F.col("x.up"))).join(nodes.alias("y"), same("y") & (F.col("p.b") == F.col("y.up")))
        pairs = met.where((F.col("x.node") <= F.col("y.node")) & (_apart("x", "y") <= bits)).select("p.round", F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return pairs


def labels(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n vertices by edges a-b, given labels so far."""
    lab = np.arange(n) if start is None else start
    while True:
        la, lb = lab[a], lab[b]
        open_ = la != lb
        if not open_.any():
            return lab
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(lab, la, low)
        np.minimum.at(lab, lb, low)
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def _tree(codes: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group size: AND and OR of every run of so many codes in Gray order."""
    return [(np.bitwise_and.reduceat(codes, np.arange(0, len(codes), s)), np.bitwise_or.reduceat(codes, np.arange(0, len(codes), s))) for s in sizes]


SIZES = (2048, 256, 32, 4, 1)


def search(x: np.ndarray, y: np.ndarray, same: bool, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with codes at most ``bits`` apart. Group pairs descend through SIZES while they may hold one."""
    tx, ty = _tree(x, SIZES), _tree(y, SIZES)
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(tx[0][0])), np.arange(len(ty[0][0])), indexing="ij"))
    stack = [(0, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS_AT_ONCE:
            stack += [(level, i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]) for k in range(0, len(i), PAIRS_AT_ONCE)]
            continue
        (xl, xh), (yl, yh) = tx[level], ty[level]
        known = ~(xl[i] ^ xh[i]) & ~(yl[j] ^ yh[j])
        keep = np.bitwise_count((xl[i] ^ yl[j]) & known) <= bits
        if same:
            keep &= i <= j
        i, j = i[keep], j[keep]
        if level + 1 == len(SIZES):
            if len(i):
                yield i, j
            continue
        fan = SIZES[level] // SIZES[level + 1]
        part = max(1, PAIRS_AT_ONCE // (fan * fan))
        for k in range(0, len(i), part):
            ci = (i[k : k + part, None] * fan + np.arange(fan))[:, :, None]
            cj = (j[k : k + part, None] * fan + np.arange(fan))[:, None, :]
            ci, cj = (c.ravel() for c in np.broadcast_arrays(ci, cj))
            ok = (ci < len(tx[level + 1][0])) & (cj < len(ty[level + 1][0]))
            stack.append((level + 1, ci[ok], cj[ok]))


def gray_order(codes: np.ndarray) -> np.ndarray:
    r = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return np.argsort(r, kind="stable")


def forest(x: np.ndarray, y: np.ndarray, same: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the codes of two blocks (or within one) that span the links found between them."""
    x = x[gray_order(x)]
    y = x if same else y[gray_order(y)]
    every = x if same else np.concatenate([x, y])
    shift, lab = 0 if same else len(x), np.arange(len(every))
    for i, j in search(x, y, same, bits):
        lab = labels(len(every), i, j + shift, lab)
    moved = np.flatnonzero(lab != np.arange(len(every)))
    return every[moved], every[lab[moved]]


def link_edges(codes: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``codes(round, fp)``, distinct -> edges ``(round, a, b)``: in each round, the components of all links within ``bits``.

    The indexes of all rounds are built and searched together, as separate key ranges of the same tables.
    """
    n_blocks = max(1, -(-codes.count() // block))
    placed = codes.select("round", "fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(n_blocks, "round", "rank").select("round", "fp", F.spark_partition_id().alias("block"))
    placed = scratch.table(placed, "gray")
    n_blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    arrays = placed.groupBy("round", "block").agg(F.collect_list("fp").alias("fps"))
    pairs = block_pairs(placed, n_blocks, bits)
    side = lambda n, k: arrays.select("round", F.col("block").alias(k), F.col("fps").alias(n))
    met = pairs.join(side("xs", "a"), ["round", "a"]).join(side("ys", "b"), ["round", "b"]).select("round", "a", "b", "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                xs, ys = (b.column(k)[r].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in (3, 4))
                p, q = forest(xs, ys, b.column(1)[r].as_py() == b.column(2)[r].as_py(), bits)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[r], len(p)), pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], ["round", "a", "b"])

    return met.repartition("round", "a", "b").mapInArrow(run, "round int, a long, b long")


def classes(fps: DataFrame, rounds: int = 1, bits: int = BITS) -> DataFrame:
    """(fp0 .., component) of every distinct tuple of fingerprints in ``fps``; ``component`` is the same for all that links
    of any round join."""
    names = [f"fp{r}" for r in range(rounds)]
    nodes = scratch.table(fps.select(*names).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    each = nodes.select("node", F.posexplode(F.array(*names)).alias("round", "fp"))
    firsts = scratch.table(each.groupBy("round", "fp").agg(F.min("node").alias("first")), "codes")
    x, y = (firsts.select("round", F.col("fp").alias(k), F.col("first").alias(f"{k}_node")) for k in ("a", "b"))
    edges = link_edges(firsts.select("round", "fp"), bits).join(x, ["round", "a"]).join(y, ["round", "b"]).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    if rounds > 1:  # tuples may share one fingerprint and differ in another
        edges = edges.unionAll(each.join(firsts, ["round", "fp"]).where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    joined = components(edges)
    return nodes.join(joined, nodes["node"] == joined["a"], "left").select(*names, F.coalesce("component", "node").alias("component"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, rounds: int = 1) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, fingerprints ``fp0`` .. and ``component_id``, the smallest id reachable by links."""
    names = [f"fp{r}" for r in range(rounds)]
    fps = scratch.table(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words, rounds), "fingerprints")
    lows = fps.groupBy(*names).agg(F.min("doc_id").alias("low"))
    of_class = classes(fps, rounds, bits).join(lows, names)
    ids = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    return fps.join(of_class.join(ids, "component").select(*names, "component_id"), names).select("doc_id", *names, "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, rounds: int = 1) -> DataFrame:
    """The rows of ``df`` that stay when each group of near-duplicates keeps one: the one with the smallest id."""
    names = [f"fp{r}" for r in range(rounds)]
    placed, (doc_at, text_at) = textkit.by_place(df, doc_id, text)
    held = placed.select(F.col(doc_at).alias("doc_id"), F.col(text_at).alias("text"), F.struct(*[c for c in placed.columns if c != text_at]).alias("row"))
    fps = scratch.table(fingerprints(held, "text", words, rounds, keep_text=True).withColumn("row_id", F.monotonically_increasing_id()), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_id").alias("row_id"))).alias("best")
    kept = fps.groupBy(*names).agg(best).join(classes(fps, rounds, bits), names).groupBy("component").agg(F.min("best").alias("best")).select("best.row_id")
    back = [F.col("text") if c == text_at else F.col(f"row.{c}") for c in placed.columns]
    return fps.join(kept, "row_id", "left_semi").select(*back).toDF(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
