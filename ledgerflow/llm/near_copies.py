"""Near copies by exact similarity of five-word shingle sets: one document of each group stays.

Two texts link when the Jaccard similarity of their sets of five-word shingles is at least 0.8. Every link is verified on
the sets themselves; fingerprints and shared shingles only say which pairs to verify.

1. Texts with equal sets collapse to one node, so thousands of copies cost one entry.
2. Candidates of op6: links of SimHash fingerprints of the sets, found in its Gray-order index, a spanning forest of each group.
3. Candidates by prefix: in one order of all shingles, common ones last, two sets that are 0.8 similar share one among the
   first n - ceil(0.8 n) + 1 of each. All texts that share such a shingle are verified against one of them, its lead, so the
   pairs grow with the number of texts and never with the square of a group.
4. Rounds: components of the verified links come next, and only shingles whose texts still lie in different ones go on, with
   another lead. In the first round all shingles of a group lead to its first text, later each shingle draws its own lead, so
   a text meets as many others as its prefix has shingles.
   Before any set is fetched, pairs are compared by sketches: parity bits like the signatures of 5, about one bit per shingle.
5. The rest: shingles whose texts still lie in different components. Pairs of a few texts are rows; of more, blocks of texts are
   compared by their signatures (64 bytes: the parity of the shingles with each of 512 hash values). Signatures differ in no more
   places than the sets do, so no similar pair is passed over; only pairs that may be similar become rows and are verified.

So no link is lost: the components are those of all verified links.

Shingles are told apart by 64-bit hashes. Defined results. Texts without words are copies of each other. Fewer words than a
shingle: the whole sequence is one shingle. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ledgerflow.llm import scratch, simhash, textkit
from ledgerflow.llm.components import components

WORDS, SLICE_BYTES = 5, 1 << 20
#: Texts sampled for the order of shingles, the most shingles held as common, and rounds against a lead of each shingle.
SAMPLE, MOST_COMMON, STARS = 20_000, 200_000, 2
#: Texts of a shingle whose signatures are compared as one block, and pairs compared at once.
BLOCK, PAIRS_AT_ONCE = 512, 1 << 16
#: Texts of a shingle up to which its pairs are rows: a fixed multiple of the texts.
FEW = 16


def shingle_sets(column: pa.ChunkedArray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and the number of each text."""
    w = textkit.scan(column, "space")
    h, first, counts = textkit.hash_words(w), w.first[:-1], w.counts
    parts, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for m in range(1, words + 1):
        which = np.flatnonzero(counts == m if m < words else counts >= words)
        if len(which):
            n = counts[which] - m + 1
            at = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            parts.append(textkit.shingle_hashes(h, m)[at])
            docs.append(np.repeat(which, n))
    hashes, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(counts)).astype(np.int64)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    end = np.cumsum(n)
    return (total[end] - total[end - n]).view(np.int64)


def sketches(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of all texts, one text after the other, and each text's end, in 64-bit words: a shingle turns the bit that its
    hash names. A text has a bit per shingle, rounded up to a power of two, 512 at least; a wide sketch folds to a narrow one."""
    wide = 8 << np.maximum(np.ceil(np.log2(np.maximum(n, 1) / 512)), 0).astype(np.int64)
    end = np.cumsum(wide)
    out = np.zeros(int(wide.sum()), np.uint64)
    mixed = textkit.mix(hashes + np.uint64(0x5151))
    word = np.repeat(end - wide, n) + ((mixed >> np.uint64(6)).astype(np.int64) & np.repeat(wide - 1, n))
    np.bitwise_xor.at(out, word, np.uint64(1) << (mixed & np.uint64(63)))
    return out, end


def narrow(flat: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sketches folded to 512 bits each, as eight integers."""
    if not len(end):
        return np.zeros((0, 8), np.uint64)
    return np.bitwise_xor.reduceat(flat.reshape(-1, 8), np.concatenate([[0], end[:-1]]) // 8, axis=0)


def signatures(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """512 parity bits of each text as eight integers."""
    return narrow(*sketches(hashes, n))


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the sketches of each pair differ, in the narrower one's width: never more than the sets differ in."""
    out = np.zeros(len(a), np.int64)
    wide = np.array([[len(x) // 8, len(y) // 8] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for x, y in np.unique(wide, axis=0):
        at, m = np.flatnonzero((wide == (x, y)).all(axis=1)), min(x, y)
        fold = lambda v: np.bitwise_xor.reduce(np.frombuffer(b"".join(v[i] for i in at), np.uint64).reshape(len(at), -1, m), axis=1)  # noqa: E731, B023
        out[at] = np.bitwise_count(fold(a) ^ fold(b)).sum(axis=1, dtype=np.int64)
    return out


def prefixes(hashes: np.ndarray, n: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in ``hashes``, text, place) of the shingles that a text is met by; ``common`` is sorted, ``rank`` is its order."""
    doc = np.repeat(np.arange(len(n)), n)
    weight = np.zeros(len(hashes), np.int64)
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, rank[at] + 1, 0)
    order = np.lexsort((hashes, weight, doc))
    place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    keep = place < np.repeat(n - -(-4 * n // 5) + 1, n)
    return order[keep], doc[keep], place[keep]


def _sets(df: DataFrame, text: str = "text") -> DataFrame:
    """(node, n, shingles) of ``df(row_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.in_slices(batches, "text", SLICE_BYTES):
            hashes, n = shingle_sets(t.column("text"))
            end = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([t.column("row_id").combine_chunks(), pa.array(n), pa.array([hashes[a:b].tobytes() for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)], pa.binary())], ["node", "n", "shingles"])

    return df.select("row_id", F.col(text).alias("text")).mapInArrow(run, "node long, n long, shingles binary")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a bounded sample of the distinct texts repeats, sorted, and their order by count. Any order gives the same
    links; this one keeps what many texts share out of the prefixes."""
    n = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, -(-n // SAMPLE)))) == 0).dropDuplicates(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.in_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(t.column("text"))[0].view(np.int64))], ["token"])

    counts = sample.select("text").mapInArrow(run, "token long").groupBy("token").count().where("count > 1")
    found = counts.orderBy(F.desc("count"), "token").limit(MOST_COMMON).toArrow()
    token, count = found.column("token").to_numpy().view(np.uint64), found.column("count").to_numpy()
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, count))] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], rank[order]


def close_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that the sketches allow to be 0.8 similar; a pair takes some hundred bytes here and not two sets."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_k"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", (F.col("a_n") + F.col("b_n")).alias("both"), "a_k", "b_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            good = pa.array(9 * differing(t.column(3).to_pylist(), t.column(4).to_pylist()) <= t.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in t.columns[:2]], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs(a, a_n, b, b_n)`` whose sets are at least 0.8 similar, of sizes and sketches that allow it."""
    fit = pairs.where("a != b and 5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)")
    fit = scratch.table(close_pairs(fit.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), nodes), "pairs")
    compared = scratch.table(fit.select(F.col("a").alias("node")).unionAll(fit.select(F.col("b").alias("node"))).distinct(), "compared")
    sets = scratch.table(_sets(texts.join(compared, texts["row_id"] == compared["node"], "left_semi")), "sets")
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_s"))
    met = fit.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_s", "b_s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            good = np.zeros(t.num_rows, bool)
            for r in range(t.num_rows):
                x, y = (np.frombuffer(t.column(k)[r].as_buffer(), np.uint64) for k in (2, 3))
                good[r] = 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in t.columns[:2]], ["a", "b"])

    out = scratch.table(met.mapInArrow(run, "a long, b long"), "links")
    scratch.drop(fit, compared, sets)
    return out


def fingerprint_links(nodes: DataFrame, rounds: int, bits: int) -> DataFrame:
    """Pairs (a, b) of ``nodes(node, n, fp0 ..)``, with their sizes, that span the groups that fingerprints link."""
    each = nodes.select("node", F.posexplode(F.array(*[f"fp{r}" for r in range(rounds)])).alias("round", "fp"))
    firsts = scratch.table(each.groupBy("round", "fp").agg(F.min("node").alias("first")), "codes")
    x, y = (firsts.select("round", F.col("fp").alias(k), F.col("first").alias(f"{k}_node")) for k in ("a", "b"))
    edges = simhash.link_edges(firsts.select("round", "fp"), bits).join(x, ["round", "a"]).join(y, ["round", "b"]).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    edges = scratch.table(edges.unionAll(each.join(firsts, ["round", "fp"]).where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))), "edges")
    size = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"))
    return edges.join(size("a"), "a").join(size("b"), "b").select("a", "a_n", "b", "b_n")


def _mixed(shared: DataFrame, joined: DataFrame | None, k: int) -> DataFrame:
    """``shared`` with each text's label, without shingles whose texts all have one, and with the shingle's text ``lead``."""
    label: Column = F.col("node")
    if joined is not None:
        shared = shared.join(joined.select(F.col("a").alias("node"), "component"), "node", "left")
        label = F.coalesce("component", "node")
    labelled = scratch.table(shared.select("token", "node", "n", "place", label.alias("label")), "labelled")
    first = F.xxhash64("token", "node", F.lit(k)) if k else F.col("label")
    ends = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(first.alias("first"), "label", "node", "n", "place")).alias("lead")).where("low < high")
    out = scratch.table(labelled.join(ends.select("token", "lead"), "token"), "mixed")
    scratch.drop(labelled)
    return out


#: The best that two sets can still share from the places on where they share a shingle reaches 0.8.
REACH = "9 * least(n - place, lead.n - lead.place) >= 4 * (n + lead.n)"


def links(nodes: DataFrame, rows: DataFrame, rounds: int, bits: int) -> DataFrame:
    """(a, component) of all verified links. ``nodes(node, n, signature, sketch, fp0 ..)``, ``rows(row_id, n, prefix, text)``."""
    postings = lambda df: df.select("n", F.col("row_id").alias("node"), F.posexplode("prefix").alias("place", "token")).select("token", "node", "n", "place")
    prefixes_of = rows.select("row_id", "n", "prefix")
    # A text's shingles are distinct, so a count tells what several rows share. Copies count too: a superset, and no join before it.
    several = postings(prefixes_of).groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token")
    several = scratch.table(several, "several")
    one = scratch.table(nodes.select("node"), "nodes")
    prefix = postings(prefixes_of.join(one, F.col("row_id") == F.col("node"), "left_semi"))
    shared = scratch.table(prefix.join(several.hint("merge"), "token"), "shared")  # grows with the corpus: one plan at every size
    scratch.drop(several, one)
    texts = rows.select("row_id", "text")
    found, joined = None, None

    def add(more: DataFrame) -> None:
        nonlocal found, joined
        more = verified(more, texts, nodes)
        found = more if found is None else found.unionAll(more)
        joined = scratch.table(components(found), "labels")

    previous = shared
    for k in range(STARS):
        mixed = _mixed(shared, joined, k)
        scratch.drop(previous)
        star = mixed.where("label != lead.label").where(REACH).select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("lead.node").alias("b"), F.col("lead.n").alias("b_n"))
        add(star.unionAll(fingerprint_links(nodes, rounds, bits)) if k == 0 else star)
        previous, shared = mixed, mixed.select("token", "node", "n", "place")
    mixed = _mixed(shared, joined, 0)
    scratch.drop(previous)
    add(rest_pairs(mixed, nodes))
    return joined


def rest_pairs(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs under one shingle with different labels that their sizes, places and signatures allow to be similar."""
    sizes = scratch.table(mixed.groupBy("token").agg(F.count("*").alias("size")), "sizes")
    held = mixed.select("token", "node", "n", "place", "label").join(sizes, "token")
    few, many = held.where(F.col("size") <= FEW), held.where(F.col("size") > FEW).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    lead = few.select("token", F.struct("node", "n", "place", "label").alias("lead"))
    plain = few.join(lead, "token").where("label != lead.label and node < lead.node and 5 * least(n, lead.n) >= 4 * greatest(n, lead.n)").where(REACH).select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("lead.node").alias("b"), F.col("lead.n").alias("b_n"))
    held = many.join(nodes.select("node", "signature"), "node")
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = held.groupBy("token", "blocks", part.alias("i")).agg(F.collect_list(F.struct("node", "n", "place", "label", "signature")).alias("x"))
    rows = scratch.table(rows, "blocks")
    # Pairs of blocks are rows of numbers first, and blocks come to them by (token, block): no key holds all pairs of a shingle.
    cut = many.select("token", "blocks").where("blocks > 1").distinct()
    met = cut.select("token", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).where("i + 1 < blocks")
    met = met.select("token", "i", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)).alias("j"))
    other = rows.where("blocks > 1").select("token", F.col("i").alias("j"), F.col("x").alias("y"))
    inside = rows.select("x", F.lit(None).cast(rows.schema["x"].dataType).alias("y"))
    between = met.join(rows.select("token", "i", "x"), ["token", "i"]).join(other, ["token", "j"]).select("x", "y")

    def arrays(v: pa.StructArray) -> list[np.ndarray]:
        return [*(v.field(c).to_numpy() for c in ("node", "n", "place", "label")), np.frombuffer(b"".join(v.field("signature").to_pylist()), np.uint64).reshape(-1, 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = arrays(b.column(0)[r].values)
                y = arrays(b.column(1)[r].values) if b.column(1)[r].is_valid else x
                step = max(1, PAIRS_AT_ONCE // len(y[0]))
                for lo in range(0, len(x[0]), step):
                    node, n, place, label, sign = (v[lo : lo + step, None] for v in x)
                    both = n + y[1]
                    good = (label != y[3]) & (5 * np.minimum(n, y[1]) >= 4 * np.maximum(n, y[1])) & (9 * np.minimum(n - place, y[1] - y[2]) >= 4 * both)
                    if y is x:
                        good &= node < y[0]
                    i, j = np.nonzero(good)
                    close = 9 * np.bitwise_count(sign[i, 0] ^ y[4][j]).sum(axis=1, dtype=np.int64) <= both[i, j]
                    i, j = i[close], j[close]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[0][lo + i], x[1][lo + i].astype(np.int32), y[0][j], y[1][j].astype(np.int32))], ["a", "a_n", "b", "b_n"])

    return plain.unionAll(inside.unionAll(between).mapInArrow(run, "a long, a_n int, b long, b_n int"))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 2, bits: int = simhash.BITS) -> DataFrame:
    """The rows of ``df`` that stay when each group of near copies keeps one: the one with the smallest id."""
    names = [f"fp{r}" for r in range(rounds)]
    placed, (doc_at, text_at) = textkit.by_place(df, doc_id, text)
    held = placed.select(F.col(doc_at).alias("doc_id"), F.col(text_at).alias("text"), F.struct(*[c for c in placed.columns if c != text_at]).alias("row"))
    schema = StructType([*held.schema.fields, StructField("n", IntegerType()), *(StructField(c, LongType()) for c in ("s0", "s1", *names)), StructField("signature", BinaryType()), StructField("sketch", BinaryType()), StructField("prefix", ArrayType(LongType()))])
    common = df.sparkSession.sparkContext.broadcast(common_shingles(held))  # at most MOST_COMMON of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.in_slices(batches, "text", SLICE_BYTES):
            hashes, n = shingle_sets(t.column("text"))
            fps = [simhash.fold(textkit.mix(hashes + np.uint64(r)) if r else hashes, n).view(np.int64) for r in range(rounds)]
            sums = [_sums(textkit.mix(hashes ^ np.uint64(s)), n) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            at, doc, _ = prefixes(hashes, n, *common.value)
            ends = np.searchsorted(doc, np.arange(len(n) + 1))
            for name, v in zip(["n", "s0", "s1", *names], [n.astype(np.int32), *sums, *fps], strict=True):
                t = t.append_column(name, pa.array(v))
            flat, end = sketches(hashes, n)
            t = t.append_column("signature", pa.array([v.tobytes() for v in narrow(flat, end)], pa.binary()))
            t = t.append_column("sketch", pa.array([v.tobytes() for v in np.split(flat, end[:-1])] if len(n) else [], pa.binary()))
            yield from t.append_column("prefix", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[at].view(np.int64)))).to_batches()

    rows = scratch.table(held.mapInArrow(run, schema).withColumn("row_id", F.monotonically_increasing_id()), "rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_id").alias("row_id"))).alias("best")
    classes = scratch.table(rows.groupBy("n", "s0", "s1").agg(best, F.min_by(F.struct("row_id", "signature", "sketch", *names), "row_id").alias("one")).select("best", "n", F.col("one.row_id").alias("node"), "one.signature", "one.sketch", *(F.col(f"one.{c}").alias(c) for c in names)), "classes")
    joined = links(classes.select("node", "n", "signature", "sketch", *names), rows, rounds, bits)
    kept = classes.join(joined, classes["node"] == joined["a"], "left").groupBy(F.coalesce("component", "node")).agg(F.min("best").alias("best")).select("best.row_id")
    kept = scratch.table(kept, "kept")  # its size is known when the texts are joined, and they need not move if it is small
    back = [F.col("text") if c == text_at else F.col(f"row.{c}") for c in placed.columns]
    return rows.join(kept, "row_id", "left_semi").select(*back).toDF(*df.columns)
