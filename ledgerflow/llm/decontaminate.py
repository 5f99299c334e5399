"""Operator 8: benchmark decontamination with a distributed positional inverted index.

The index is a Parquet table in the shared folder: one row per term and chunk of documents (about ``CHUNK_BYTES`` of text)
with the gaps between the term's positions in the chunk, and one row per document with the position of its first word.
It is written in one pass without a shuffle and holds every word of every document.

A query window is looked up from its rarest term: the offset-adjusted positions of that term are candidates, and the other
terms, rarest first, are intersected with them. Only the postings of terms that occur in test items are read out
and meet by chunk, so the work of a task is bounded by a chunk whatever a word's frequency. The test set is taken in
blocks of at most ``WINDOWS_AT_ONCE`` windows, which bounds what each task receives.

Defined results. Null or empty text: no words, no hits, not contaminated. Items without words match nothing; an item
shorter than a window is one window. Repeated rows (and repeated ids) are judged each for itself. Windows of items
with a null id hit words like any other; such items are not among a document's items. Empty tables: no rows, or no hits. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ledgerflow.llm import scratch, textkit

WINDOW, CHUNK_BYTES, WINDOWS_AT_ONCE, CANDIDATES_AT_ONCE = 10, 4 << 20, 100_000, 1 << 19
#: Words: runs of 0-9, a-z and everything above 7F, after A-Z are lower-cased. Fixed value of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _postings(w: textkit.Words) -> tuple[pa.Array, pa.Array]:
    """Terms of a chunk and their positions as gaps, the first counted from the chunk's first word."""
    h = textkit.hash_words(w)
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    gaps = np.diff(order, prepend=0)
    gaps[new] = order[new]
    first = order[new]
    length = w.end[first] - w.start[first]
    bounds = np.concatenate([[0], np.cumsum(length)])
    data = w.data[np.repeat(w.start[first] - bounds[:-1], length) + np.arange(bounds[-1])]
    # Bytes that are no valid UTF-8 cannot come from an Arrow string column, and words are cut at ASCII bytes only.
    terms = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(h)), pa.int32()), pa.array(gaps, pa.int32()))
    return terms, lists


def build_index(df: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of kind ``posting`` (chunk, term, gaps) and ``doc`` (chunk, doc_no, doc, first, n_words), written and read back."""
    docs = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    kind_of_id = docs.schema["doc"].dataType
    schema = StructType([StructField("kind", StringType()), StructField("chunk", LongType()), StructField("term", StringType()), StructField("gaps", ArrayType(IntegerType())), StructField("doc_no", IntegerType()), StructField("doc", kind_of_id), StructField("first", LongType()), StructField("n_words", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, t in enumerate(textkit.in_slices(batches, "text", chunk_bytes)):
            w = textkit.scan(t.column("text"), "alnum")
            terms, gaps = _postings(w)
            ids = t.column("doc").combine_chunks()
            n, m = len(terms), len(ids)
            none = lambda size, kind: pa.nulls(size, kind)
            at = lambda size: pa.array(np.full(size, part + k), pa.int64())
            names = schema.names
            counts = w.counts
            for lo in range(0, n, 50_000):
                hi = min(n, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.repeat("posting", hi - lo), at(hi - lo), terms[lo:hi], gaps[lo:hi], none(hi - lo, pa.int32()), none(hi - lo, ids.type), none(hi - lo, pa.int64()), none(hi - lo, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.repeat("doc", m), at(m), none(m, pa.string()), none(m, gaps.type), pa.array(np.arange(m), pa.int32()), ids, pa.array(w.first[:-1], pa.int64()), pa.array(counts, pa.int64())], names)

    return scratch.table(docs.mapInArrow(run, schema), "index", ["kind"])


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows of the test items: ``words`` and the ids (as strings, nulls left out) of the ``items`` that hold them."""
    each = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - size, F.lit(0))
    cut = each.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item", F.slice("w", F.col("at") + 1, size).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


class Queries:
    """A block of windows as arrays: term numbers (padded by -1) and lengths."""

    def __init__(self, rows: list):
        self.terms = sorted({t for r in rows for t in r.words})
        number = {t: i for i, t in enumerate(self.terms)}
        self.length = np.array([len(r.words) for r in rows])
        self.slots = np.full((len(rows), int(self.length.max(initial=1))), -1, np.int64)
        for i, r in enumerate(rows):
            self.slots[i, : len(r.words)] = [number[t] for t in r.words]
        self.items = [r["items"] for r in rows]


def match(q: Queries, numbers: np.ndarray, positions: list[np.ndarray], within: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and start positions that occur in a chunk; with ``within``, places of the rarest term that has each
    other term at most so many words away."""
    counts = np.zeros(len(q.terms) + 1, np.int64)  # the last stands for padding
    counts[numbers] = [len(p) for p in positions]
    order = np.argsort(numbers)
    keys = np.concatenate([(numbers[i] << 32) + positions[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.cumsum(counts[:-1])])
    counts[-1] = 1 << 60
    alive = np.flatnonzero((counts[q.slots] > 0).all(axis=1))
    ranked = np.argsort(counts[q.slots[alive]], axis=1, kind="stable")
    rarest = q.slots[alive, ranked[:, 0]] if len(alive) else alive
    ends = np.cumsum(counts[rarest])
    lo = 0
    while lo < len(alive):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES_AT_ONCE, side="right")), lo + 1)
        own, n = np.arange(lo, hi), counts[rarest[lo:hi]]
        which = np.repeat(own, n)
        at = np.repeat(begins[rarest[lo:hi]], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        place = keys[at] & 0xFFFFFFFF
        start = place if within is not None else place - ranked[which, 0]
        for k in range(1, q.slots.shape[1]):
            slot = ranked[which, k]
            term = q.slots[alive[which], slot]
            if within is None:
                key = (term << 32) + start + slot
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ok = (term < 0) | (keys[found] == key)
            else:
                after = np.minimum(np.searchsorted(keys, (term << 32) + start - within), len(keys) - 1)
                ok = (term < 0) | (keys[after] <= (term << 32) + start + within) & (keys[after] >> 32 == term)
            which, start = which[ok], start[ok]
        yield alive[which], start
        lo = hi


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[cut].tolist(), end[np.append(cut[1:] - 1, len(end) - 1)].tolist()


def hits_of_block(index: DataFrame, q: Queries, within: int | None = None) -> DataFrame:
    """(chunk, doc_no, items, starts, ends) of every document with a hit of this block's windows."""
    spark = index.sparkSession
    terms = spark.createDataFrame(list(zip(q.terms, range(len(q.terms)), strict=True)) or [], "term string, number long")
    postings = index.where("kind = 'posting'").select("chunk", "term", "gaps").join(F.broadcast(terms), "term").select("chunk", "number", "gaps")
    docs = index.where("kind = 'doc'").select(F.col("chunk").alias("doc_chunk"), "doc_no", "first", "n_words")
    out = "chunk long, doc_no int, items array<string>, starts array<int>, ends array<int>"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {"chunk": [], "doc_no": [], "items": [], "starts": [], "ends": []}
        numbers = left.column("number").to_numpy()
        gaps = left.column("gaps").combine_chunks()
        gaps = gaps if isinstance(gaps, pa.Array) else gaps.chunk(0)
        values, offsets = gaps.flatten().to_numpy(), gaps.offsets.to_numpy() - gaps.offsets[0].as_py()
        positions = [np.cumsum(values[a:b], dtype=np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        right = right.sort_by("first")
        right = right.filter(pc.greater(right.column("n_words"), 0))
        first, size, doc_no = (right.column(c).to_numpy() for c in ("first", "n_words", "doc_no"))
        if within is not None and len(first):  # documents move apart, so that no place near an edge reaches the next one
            positions = [p + (np.searchsorted(first, p, side="right") - 1) * (within + 1) for p in positions]
            first = first + np.arange(len(first)) * (within + 1)
        found = [(w, s) for w, s in match(q, numbers, positions, within) if len(w)]
        if found and len(first):
            which, start = (np.concatenate(x) for x in zip(*found, strict=True))
            long = q.length[which] if within is None else np.ones(len(which), np.int64)
            doc = np.searchsorted(first, start, side="right") - 1
            ok = (start >= 0) & (doc >= 0) & (start + long <= first[doc] + size[doc])
            which, start, long, doc = which[ok], start[ok], long[ok], doc[ok]
            order = np.argsort(doc, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
                d = doc[part[0]]
                a, b = _merged(start[part] - first[d], start[part] - first[d] + long[part])
                rows["chunk"].append(right.column("doc_chunk")[0].as_py())
                rows["doc_no"].append(doc_no[d])
                rows["items"].append(sorted({i for w in np.unique(which[part]) for i in q.items[w]}))
                rows["starts"].append(a)
                rows["ends"].append(b)
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=list(rows))

    return postings.groupBy("chunk").cogroup(docs.groupBy("doc_chunk")).applyInArrow(run, out)


def in_blocks(test_windows: DataFrame, block: int) -> Iterator[list]:
    """The windows in lists of at most ``block``: parts by hash, and a part that is larger is cut again by another hash."""
    todo = [(test_windows, 0)]
    while todo:
        part, depth = todo.pop()
        n = part.count()
        if n <= block:
            rows = part.collect()
            if rows:
                yield rows
        else:
            pieces = -(-n // block)
            todo += [(part.where(F.pmod(F.xxhash64(F.lit(depth), "words"), F.lit(pieces)) == k), depth + 1) for k in range(pieces)]


def search(index: DataFrame, test_windows: DataFrame, within: int | None = None, block: int = WINDOWS_AT_ONCE) -> DataFrame:
    """One row per indexed document: ``doc``, ``n_words``, ``n_hit``, sorted ``items`` and the merged ``spans`` hit."""
    test_windows = scratch.table(test_windows, "windows")
    hits, blocks = None, 0
    for rows in in_blocks(test_windows, block):
        got = hits_of_block(index, Queries(rows), within)
        hits, blocks = got if hits is None else hits.unionAll(got), blocks + 1
    docs = index.where("kind = 'doc'").select("chunk", "doc_no", "doc", "n_words")
    if hits is None:
        return docs.select("doc", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    per_doc = hits.groupBy("chunk", "doc_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))).alias("spans"))
    if blocks == 1:  # the spans of one block are disjoint already
        n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    else:
        n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    joined = docs.join(per_doc.withColumn("n_hit", n_hit.cast("long")), ["chunk", "doc_no"], "left")
    return joined.select("doc", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per document: its words, words hit by a test window of ``size`` words, the items concerned and the spans."""
    index = build_index(docs, doc_id, text)
    return search(index, windows(items, item_id, item_text, size)).withColumnRenamed("doc", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
q AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, pos + 1, pos + 10), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS pos FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM q),
x AS (
  SELECT rid, pos, n, array_to_string(list_slice(w, pos + 1, pos + n), ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS pos FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT x.rid, x.pos, x.n, q.item FROM x JOIN q ON x.win = q.win AND x.n = q.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS p FROM m) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM m WHERE item IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
