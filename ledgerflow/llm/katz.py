"""Operator 4: n-gram language model with Katz backoff, learnt from and applied to whole documents.

    P(w | h) = d(c(hw)) c(hw) / c(h)     if hw was seen in training
             = alpha(h) P(w | h')        otherwise (h' is h without its first word),   P(w) = d(c(w)) c(w) / N,
                                         all unseen words: one class with the rest

d are Good-Turing discounts of each length of n-gram (Katz 1987, counts up to five), alpha(h) makes each context's probabilities
sum to one exactly. Words before a document's first are "begin", its last token is "end". ``order`` is the longest n-gram.

Everything is keyed and partitioned, nothing is gathered: documents become chunks of token numbers (table ``tokens``); distinct
words meet by word hash to be counted and numbered, most frequent first (table ``words``); the numbers go back to the
chunks. Then, length by length, a chunk's distinct n-grams go to buckets by context (table ``ngrams``: a row per bucket holds the
counts and who asked), where discounts and backoff weights are formed. Shorter n-grams' probabilities go back to the chunks,
which attach them to the next length, so each token's recursion is evaluated from the shortest context up; the longest n-grams'
buckets return sums by document. A bucket holds about half a million tokens, so tasks are even. A context with more tokens than a
bucket holds ("the", "begin") is split over several buckets by its next word and its sums are joined in one more grouping.
Only sums and the table of count classes (at most sqrt(2 N) rows) reach the driver.

Defined results. Null and empty texts are the end token alone. Ids are compared as text; null ids count as training rows.
Repeated rows count repeatedly. Empty table: empty result. Without training rows every token is of the unseen class.
Extra columns are left out. Words are told apart by 64-bit hashes, contexts of several words by 56 bits. Counts are 64-bit; words are numbered below
2 ** 55. What one chunk counts by itself fits 32 bits, as a chunk is a few megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerflow.llm import scratch, textkit

ORDER, FOLDS, MOST_DISCOUNTED, CHUNK_BYTES, BUCKET_TOKENS = 2, 10, 5, 8 << 20, 1 << 19
#: Bytes of text scanned at once; a chunk keeps only hashes of what was scanned.
SLICE_BYTES = 1 << 20
#: Hash of the end token (no word has it but by chance), number of the unseen class, number of the context "begin".
END_HASH, UNSEEN, BEGIN = 0x5EED0E4D, 0, (1 << 55) - 1
#: Split contexts are sent to all tasks up to so many rows, and joined by a shuffle beyond.
MOST_BROADCAST_ROWS = 100_000
#: What a context gives up where Good-Turing discounts nothing.
LEAST_REST = 0.5


def enc(a: np.ndarray, kind: str) -> bytes:
    """Integers as compressed byte planes."""
    a = np.ascontiguousarray(a, kind)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(a).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def dec(b: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(b[4:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def discounts(n: dict[int, int], most: int = MOST_DISCOUNTED) -> np.ndarray:
    """Factor for counts 0..most from the numbers of types seen r times; absolute discounting where those are too few."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    absolute = n1 / (n1 + 2 * n2) if n1 else 0.0
    beyond = (most + 1) * n.get(most + 1, 0) / n1 if n1 else 0.0
    d = np.ones(most + 1)
    for r in range(1, most + 1):
        turing = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - beyond) / (1 - beyond) if n.get(r) and beyond < 1 else 0.0
        d[r] = turing if 0 < turing < 1 else 1 - absolute / r if absolute < 1 else 0.5
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)


class Unigrams:
    """Counts and probabilities by word number: numbers from 1 fall by count, so classes of equal count suffice."""

    def __init__(self, classes: list[tuple[int, int]], begins: int):
        """``classes``: (count, how many words have it); ``begins``: training documents."""
        rows = sorted(classes, reverse=True)
        self.counts = np.array([0] + [c for c, _ in rows], np.int64)
        self.starts = np.concatenate([[0, 1], 1 + np.cumsum([k for _, k in rows])])[: len(rows) + 1].astype(np.int64)
        self.total = int(sum(c * k for c, k in rows))
        self.types = int(sum(k for _, k in rows))
        self.begins = begins
        used = discounted(self.counts[1:], discounts(dict(rows)))
        mass = float((used * [k for _, k in rows]).sum()) if rows else 0.0
        size = self.total if self.total - mass > 1e-9 * self.total else self.total + LEAST_REST
        self.p = np.concatenate([[1 - mass / size if size else 1.0], used / size if size else []])

    def _class(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, numbers, side="right") - 1

    def count(self, numbers: np.ndarray) -> np.ndarray:
        return self.counts[self._class(numbers)]

    def probability(self, numbers: np.ndarray) -> np.ndarray:
        return self.p[self._class(numbers)]

    def context_size(self, h: np.ndarray) -> np.ndarray:
        return np.where(h == BEGIN, self.begins, self.count(np.where(h == BEGIN, 0, h)))


#: Low bits of a context's key: the binary logarithm of the buckets it is split over.
SPLIT = np.uint64(255)


def context_keys(w: np.ndarray, sizes: np.ndarray, length: int, uni: Unigrams, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token: the key of the ``length`` words before it, and whether training can have seen all of them."""
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(w)) - np.repeat(begin, sizes)
    key, known, size = np.zeros(len(w), np.uint64), np.ones(len(w), bool), np.full(len(w), uni.total, np.int64)
    for back in range(length, 0, -1):
        h = np.where(place >= back, w[np.maximum(np.arange(len(w)) - back, 0)], BEGIN)
        key = textkit.mix(key * np.uint64(textkit.BASE) + h.astype(np.uint64)) if length > 1 else h.astype(np.uint64)
        known &= h != UNSEEN
        size = np.minimum(size, uni.context_size(h))  # no context is larger than the rarest of its words
    parts = np.maximum(-(-size // tokens), 1)
    return (key << np.uint64(8)) | np.ceil(np.log2(parts)).astype(np.uint64), known


def bucket_of(key: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    return (textkit.mix(key + part.astype(np.uint64) * np.uint64(textkit.BASE)) % np.uint64(buckets)).astype(np.int64)


def part_of(key: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which part of its context an n-gram belongs to, by its last word."""
    return textkit.mix(w.astype(np.uint64) + np.uint64(77)) & ((np.uint64(1) << (key & SPLIT)) - np.uint64(1))


def runs(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by context and word, and where each distinct pair begins in it."""
    order = np.lexsort((w, key))
    key, w = key[order], w[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (w[1:] != w[:-1])
    return order, np.flatnonzero(new)


def chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Word hashes, words per document, ids and training flags of consecutive documents."""
    held, size = [], 0

    def joined() -> tuple:
        hashes, n, docs, train = zip(*held, strict=True)
        return np.concatenate(hashes), np.concatenate(n), pa.concat_arrays(docs), np.concatenate(train)

    for t in textkit.in_slices(batches, "text", min(chunk_bytes, SLICE_BYTES)):
        w = textkit.scan(t.column("text"), "space")
        docs = t.column("doc").combine_chunks()
        held.append((textkit.hash_words(w), w.counts, docs if isinstance(docs, pa.Array) else pa.concat_arrays(docs.chunks), t.column("train").to_numpy().astype(bool)))
        size += len(w.data)
        if size >= chunk_bytes:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def tokens_of(df: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of documents (doc, train, text) as token numbers into each chunk's own sorted word hashes."""
    kind = df.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, (hashes, n, docs, train) in enumerate(chunks(batches, chunk_bytes)):
            stream = np.full(len(hashes) + len(n), END_HASH, np.uint64)
            stream[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes
            words, ids = np.unique(stream, return_inverse=True)
            seen = np.bincount(ids[np.repeat(train, n + 1)], minlength=len(words))
            row = [part + k, enc(gaps(words), "<u8"), enc(seen, "<u4"), enc(ids, "<u4"), docs.to_pylist(), (n + 1).tolist(), train.tolist(), len(stream), len(words), int(train.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(docs.type), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.int64()], strict=True)], names)

    names = ["chunk", "words", "seen", "ids", "docs", "sizes", "train", "n_tokens", "n_words", "n_train"]
    schema = f"chunk long, words binary, seen binary, ids binary, docs array<{kind}>, sizes array<long>, train array<boolean>, n_tokens long, n_words long, n_train long"
    return scratch.table(df.mapInArrow(run, schema), "tokens")


def _binary_rows(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def number_words(tokens: DataFrame, buckets: int) -> tuple[DataFrame, list[tuple[int, int]], DataFrame]:
    """(chunk, bucket, numbers): the number of each of a chunk's words of that bucket, in hash order; and count classes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                words, seen = np.cumsum(dec(b.column(1)[r].as_py(), "<u8"), dtype=np.uint64), dec(b.column(2)[r].as_py(), "<u4")
                own = (words % np.uint64(buckets)).astype(np.int64)
                rows = [[b.column(0)[r].as_py(), k, enc(gaps(words[own == k]), "<u8"), enc(seen[own == k], "<u4")] for k in np.unique(own).tolist()]
                yield from _binary_rows(rows, ["chunk", "bucket", "words", "seen"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]).to_batches()

    def count(t: pa.Table) -> pa.Table:
        asks = [np.cumsum(dec(x.as_py(), "<u8"), dtype=np.uint64) for x in t.column("words")]
        words, at = np.unique(np.concatenate(asks), return_inverse=True)
        c = np.bincount(at, np.concatenate([dec(x.as_py(), "<u4") for x in t.column("seen")]), len(words)).astype(np.int64)
        classes, sizes = np.unique(c[c > 0], return_counts=True)
        asked = [enc(gaps(x), "<u4") for x in np.split(at, np.cumsum([len(x) for x in asks])[:-1])]
        row = [t.column("bucket")[0].as_py(), enc(gaps(words), "<u8"), enc(c, "<u8"), classes.tolist(), sizes.tolist(), t.column("chunk").to_pylist(), asked]
        return _binary_rows([row], ["bucket", "words", "counts", "classes", "sizes", "chunks", "asked"], [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())])

    asked = tokens.select("chunk", "words", "seen").mapInArrow(ask, "chunk long, bucket int, words binary, seen binary")
    words = scratch.table(asked.groupBy("bucket").applyInArrow(count, "bucket int, words binary, counts binary, classes array<long>, sizes array<long>, chunks array<long>, asked array<binary>"), "words")
    per = words.select("bucket", F.explode(F.arrays_zip("classes", "sizes")).alias("x")).select("bucket", F.col("x.classes").alias("c"), F.col("x.sizes").alias("n"))
    totals = [(int(r.c), int(r.n)) for r in per.groupBy("c").agg(F.sum("n").alias("n")).collect()]  # at most sqrt(2 N) rows
    after = np.cumsum([0] + [n for _, n in sorted(totals, reverse=True)])
    first = {c: 1 + int(a) for (c, _), a in zip(sorted(totals, reverse=True), after, strict=False)}
    firsts = tokens.sparkSession.createDataFrame(list(first.items()), "c long, first long")
    starts = per.join(firsts, "c").select("bucket", "c", (F.col("first") + F.sum("n").over(W.partitionBy("c").orderBy("bucket")) - F.col("n")).alias("start"))
    starts = scratch.table(starts.groupBy("bucket").agg(F.collect_list(F.struct("c", "start")).alias("starts")), "starts")  # read with its size known
    given = words.select("bucket", "counts", "chunks", "asked").join(starts, "bucket", "left").select("bucket", "counts", "chunks", "asked", F.col("starts.c").alias("cs"), F.col("starts.start").alias("at"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                c = dec(b.column(1)[r].as_py(), "<u8").astype(np.int64)
                start = dict(zip(b.column(4)[r].as_py() or [], b.column(5)[r].as_py() or [], strict=True))
                numbers = np.zeros(len(c), np.int64)
                order = np.argsort(c, kind="stable")
                bounds = np.flatnonzero(np.diff(c[order], prepend=-1))
                for lo, hi in zip(bounds, [*bounds[1:], len(c)], strict=True):
                    if c[order[lo]]:
                        numbers[order[lo:hi]] = start[int(c[order[lo]])] + np.arange(hi - lo)
                rows = [[chunk, b.column(0)[r].as_py(), enc(numbers[np.cumsum(dec(x.as_py(), "<u4").astype(np.int64))], "<u8")] for chunk, x in zip(b.column(2)[r].as_py(), b.column(3)[r], strict=True)]
                yield from _binary_rows(rows, ["chunk", "bucket", "numbers"], [pa.int64(), pa.int32(), pa.binary()]).to_batches()

    return given.mapInArrow(answer, "chunk long, bucket int, numbers binary"), totals, words


def occurrences(tokens: DataFrame, back: DataFrame, level: int, last: bool, words_buckets: int, buckets: int, uni: Unigrams, bucket_tokens: int) -> DataFrame:
    """A row per (chunk, bucket) with its distinct n-grams of this length, how often training has them, what a shorter context gives
    them (``low``; not for pairs, where the word says it) and, if it is the longest, their documents. Bucket -1: sums by document.

    ``back`` holds what chunks were sent: numbers of words, and probabilities of the n-grams one shorter.
    """
    add = uni.total + 0.1 * (uni.types + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = left.column("chunk")[0].as_py()
        words = np.cumsum(dec(left.column("words")[0].as_py(), "<u8"), dtype=np.uint64)
        own, number = (words % np.uint64(words_buckets)).astype(np.int64), np.zeros(len(words), np.int64)
        sent = {}
        for kind, k, x in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("values"), strict=True):
            if kind:
                sent[k] = dec(x.as_py(), "<f8")
            else:
                number[own == k] = dec(x.as_py(), "<u8")
        w = number[dec(left.column("ids")[0].as_py(), "<u4")]
        sizes, train = np.array(left.column("sizes")[0].as_py(), np.int64), np.array(left.column("train")[0].as_py(), bool)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        low = uni.probability(w)
        if level > 2:
            key, _ = context_keys(w, sizes, level - 2, uni, bucket_tokens)
            order, new = runs(key, w)
            first = order[new]
            place, value = bucket_of(key[first], part_of(key[first], w[first]), buckets), np.zeros(len(first))
            for k, x in sent.items():
                value[place == k] = x
            low[order] = np.repeat(value, np.diff(np.append(new, len(order))))
        key, known = context_keys(w, sizes, level - 1, uni, bucket_tokens)
        rows = []
        if last:
            c = uni.count(w)
            base = np.bincount(doc, np.log10((c + 0.1) / add), len(sizes))
            # A context that training has not seen leaves the shorter one's probability alone.
            start = np.bincount(doc[~known], np.log10(low[~known]), len(sizes))
            rows.append([chunk, -1, base.astype("<f8").tobytes(), start.astype("<f8").tobytes(), enc(np.bincount(doc, c > 0, len(sizes)), "<u8"), None, None, None])
        at = np.flatnonzero(known) if last else np.arange(len(w))  # the next length asks for every token's value
        order, new = runs(key[at], w[at])
        at, n = at[order], np.diff(np.append(new, len(order)))
        seen = np.add.reduceat(train[doc[at]].astype(np.int64), new) if len(new) else n
        first = at[new]
        key, w, low = key[first], w[first], low[first]
        place = bucket_of(key, part_of(key, w), buckets)
        by = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[by], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            mine = by[edges[k] : edges[k + 1]]
            row = [chunk, k, enc(gaps(key[mine]), "<u8"), enc(w[mine], "<u8"), enc(seen[mine], "<u4"), enc(low[mine], "<f8") if level > 2 else None, None, None]
            if last:
                each = np.repeat(new[mine] - (np.cumsum(n[mine]) - n[mine]), n[mine]) + np.arange(int(n[mine].sum()))
                row[6:] = [enc(n[mine], "<u4"), enc(doc[at[each]], "<u4")]
            rows.append(row)
        return _binary_rows(rows, ["chunk", "bucket", "h", "w", "seen", "low", "n", "doc"], [pa.int64(), pa.int32(), *[pa.binary()] * 6])

    return tokens.select("chunk", "words", "ids", "sizes", "train").groupBy("chunk").cogroup(back.groupBy("to")).applyInArrow(run, "chunk long, bucket int, h binary, w binary, seen binary, low binary, n binary, doc binary")


def ngram_counts(occ: DataFrame, uni: Unigrams) -> DataFrame:
    """The model's table of one length: per bucket the n-grams (context, word, training count, ``low``), how many occur 1 .. 6 times,
    and for each chunk that asked, which n-grams are its own. Rows of bucket -1 pass through."""

    def run(t: pa.Table) -> pa.Table:
        rows, own = [], t.filter(pc.greater_equal(t.column("bucket"), 0))
        for r in range(t.num_rows):
            if t.column("bucket")[r].as_py() < 0:
                sums = [t.column(k)[r].as_py() for k in ("h", "w", "seen")]
                rows.append([-1, *sums, None, [t.column("chunk")[r].as_py()], [], [], [], []])
        if own.num_rows:
            parts = [(np.cumsum(dec(h.as_py(), "<u8"), dtype=np.uint64), dec(w.as_py(), "<u8"), dec(s.as_py(), "<u4")) for h, w, s in zip(*(own.column(k) for k in ("h", "w", "seen")), strict=True)]
            key, w, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
            ends = np.cumsum([len(p[0]) for p in parts])
            del parts
            order, new = runs(key, w)
            c = np.add.reduceat(seen[order].astype(np.int64), new)
            index = np.empty(len(order), np.int64)
            index[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
            first = order[new]
            low = enc(np.concatenate([dec(x.as_py(), "<f8") for x in own.column("low")])[first], "<f8") if own.column("low")[0].is_valid else None
            times = np.bincount(np.minimum(c, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[: MOST_DISCOUNTED + 2]
            asked = [enc(gaps(index[a:b]), "<u4") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            rows.append([own.column("bucket")[0].as_py(), enc(gaps(key[first]), "<u8"), enc(w[first], "<u8"), enc(c, "<u8"), low, own.column("chunk").to_pylist(), asked, own.column("n").to_pylist(), own.column("doc").to_pylist(), times.tolist()])
        blobs = pa.list_(pa.binary())
        return _binary_rows(rows, ["bucket", "h", "w", "c", "low", "chunks", "asked", "n", "doc", "times"], [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), blobs, blobs, blobs, pa.list_(pa.int64())])

    # Sums by document of all chunks would meet in one group if -1 were their key.
    keyed = occ.withColumn("key", F.when(F.col("bucket") < 0, -1 - F.col("chunk")).otherwise(F.col("bucket")))
    schema = "bucket int, h binary, w binary, c binary, low binary, chunks array<long>, asked array<binary>, n array<binary>, doc array<binary>, times array<long>"
    return scratch.table(keyed.groupBy("key").applyInArrow(run, schema), "ngrams")


def context_sums(key: np.ndarray, c: np.ndarray, low: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, and for each: tokens, discounted tokens, shorter contexts' mass of the words seen after it."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(new):
        return key[:0], np.zeros((0, 3))
    return key[new], np.stack([np.add.reduceat(x, new) for x in (c.astype(float), discounted(c, d), np.where(c > 0, low, 0))], axis=1)


def weights(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts: the size that divides discounted counts, and the backoff weight; 1 and 1 where training has none."""
    size = np.where(sums[:, 0] - sums[:, 1] > 1e-9 * sums[:, 0], sums[:, 0], sums[:, 0] + LEAST_REST)
    alpha = (1 - sums[:, 1] / np.where(size > 0, size, 1)) / np.maximum(1 - sums[:, 2], 1e-300)
    return np.where(sums[:, 0] > 0, size, 1.0), np.where(sums[:, 0] > 0, alpha, 1.0)


def _decoded(h: bytes, w: bytes, c: bytes, low: bytes | None, uni: Unigrams) -> tuple[np.ndarray, ...]:
    word = dec(w, "<u8")
    return np.cumsum(dec(h, "<u8"), dtype=np.uint64), dec(c, "<u8").astype(np.int64), uni.probability(word.astype(np.int64)) if low is None else dec(low, "<f8")


def split_contexts(model: DataFrame, uni: Unigrams, d: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, h, tokens, used, mass): whole sums of each context that is split, for every bucket with a part of it."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                key, s = context_sums(*_decoded(*(b.column(k)[r].as_py() for k in range(4)), uni), d)
                big = key & SPLIT > 0
                yield pa.RecordBatch.from_arrays([pa.array(key[big].view(np.int64)), *(pa.array(s[big, k]) for k in range(3))], ["h", "tokens", "used", "mass"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            n = (np.uint64(1) << (key & SPLIT)).astype(np.int64)
            row = np.repeat(np.arange(len(key)), n)
            part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(key[row], part, buckets).astype(np.int32)), *(c.take(pa.array(row)) for c in b.columns)], ["bucket", "h", "tokens", "used", "mass"])

    sums = model.where("bucket >= 0").select("h", "w", "c", "low").mapInArrow(parts, "h long, tokens double, used double, mass double").groupBy("h").agg(*(F.sum(k).alias(k) for k in ("tokens", "used", "mass")))
    return sums.mapInArrow(deal, "bucket int, h long, tokens double, used double, mass double").distinct()


def answers(model: DataFrame, split: DataFrame, uni: Unigrams, d: np.ndarray, last: bool) -> DataFrame:
    """What each bucket sends back. The longest n-grams: (to, docs, sums), its share of the log10 probability of a chunk's documents.
    Shorter ones: (to, kind, bucket, values), the probability of each n-gram a chunk asked for."""
    whole = scratch.table(split.groupBy("bucket").agg(F.collect_list(F.struct("h", "tokens", "used", "mass")).alias("whole")), "split")  # a few contexts per bucket
    few = whole.agg(F.sum(F.size("whole"))).first()[0] or 0
    known = model.where("bucket >= 0").drop("times").join(F.broadcast(whole) if few <= MOST_BROADCAST_ROWS else whole, "bucket", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(k)[r] for k, name in enumerate(b.schema.names)}
                key, c, low = _decoded(*(row[k].as_py() for k in ("h", "w", "c", "low")), uni)
                contexts, sums = context_sums(key, c, low, d)
                for x in row["whole"].as_py() or []:
                    at = np.searchsorted(contexts, np.int64(x["h"]).view(np.uint64))
                    if at < len(contexts) and contexts[at] == np.int64(x["h"]).view(np.uint64):
                        sums[at] = x["tokens"], x["used"], x["mass"]
                size, alpha = weights(sums)
                of = np.searchsorted(contexts, key)
                value = np.where(c > 0, discounted(c, d) / size[of], alpha[of] * low)
                if last:
                    value = np.log10(value)
                out = []
                for k, (chunk, asked) in enumerate(zip(row["chunks"].as_py(), row["asked"], strict=True)):
                    own = value[np.cumsum(dec(asked.as_py(), "<u4").astype(np.int64))]
                    if last:
                        n, doc = (dec(row[x][k].as_py(), "<u4") for x in ("n", "doc"))
                        sums_of, some = np.bincount(doc, np.repeat(own, n)), np.unique(doc)
                        out.append([chunk, enc(gaps(some), "<u4"), sums_of[some].astype("<f8").tobytes()])
                    else:
                        out.append([chunk, 1, row["bucket"].as_py(), enc(own, "<f8")])
                yield from _binary_rows(out, *((["to", "docs", "sums"], [pa.int64(), pa.binary(), pa.binary()]) if last else (["to", "kind", "bucket", "values"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()]))).to_batches()

    return known.mapInArrow(run, "to long, docs binary, sums binary" if last else "to long, kind int, bucket int, values binary")


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Learn n-grams up to ``order`` (two at least) from the rows whose id's checksum is no multiple of ``folds`` and score every row."""
    if order < 2:
        raise ValueError("backoff needs n-grams of two words at least")
    fold = F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % folds
    docs = df.select(F.col(doc_id).alias("doc"), F.coalesce(fold != 0, F.lit(True)).alias("train"), F.col(text).alias("text"))
    tokens = tokens_of(docs, chunk_bytes)
    sums = tokens.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_words", "n_train"))).first()
    buckets, words_buckets = (max(1, -(-int(n) // bucket_tokens)) for n in (sums.n_tokens, sums.n_words))
    numbers, classes, words = number_words(tokens, words_buckets)
    uni = Unigrams(classes, int(sums.n_train))
    numbers = numbers.select(F.col("chunk").alias("to"), F.lit(0).alias("kind"), "bucket", F.col("numbers").alias("values"))
    back = numbers
    for level in range(2, order + 1):
        last = level == order
        if order > 2 and level == 2:
            back = numbers = scratch.table(numbers, "numbers")
        model = ngram_counts(occurrences(tokens, back, level, last, words_buckets, buckets, uni, bucket_tokens), uni)
        times = model.where("bucket >= 0").select(F.posexplode("times").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
        d = discounts({int(r.r): int(r.n) for r in times if r.r})
        found = answers(model, split_contexts(model, uni, d, buckets), uni, d, last)
        if not last:
            back = numbers.unionAll(found)
    heads = scratch.table(tokens.select("chunk", "docs", "sizes", "train"), "documents")
    if order == 2:  # nothing later reads words or tokens
        scratch.drop(tokens, words)
    base = model.where("bucket < 0").select(F.element_at("chunks", 1).alias("to"), F.concat(F.lit(b"base"), "c").alias("docs"), F.concat("h", "w").alias("sums"))
    schema = f"{doc_id} {docs.schema['doc'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.array(left.column("sizes")[0].as_py(), np.int64)
        total, base, known = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64)
        shares = []
        for docs_, sums_ in zip(right.column("docs"), right.column("sums"), strict=True):
            docs_, sums_ = docs_.as_py(), np.frombuffer(sums_.as_py(), "<f8")
            if docs_[:4] == b"base":
                base, known = sums_[: len(n)], dec(docs_[4:], "<u8").astype(np.int64)
                total += sums_[len(n) :]
            else:
                shares.append((np.cumsum(dec(docs_, "<u4").astype(np.int64)), sums_))
        for at, s in sorted(shares, key=lambda x: (len(x[0]), x[1].tobytes())):  # one order of adding, so runs agree to the last bit
            total[at] += s
        train = pa.array(left.column("train")[0].as_py(), pa.bool_())
        kind = left.schema.field("docs").type.value_type
        return pa.table([pa.array(left.column("docs")[0].as_py(), kind), pc.invert(train), pa.array(n), pa.array(known), pa.repeat(uni.total, len(n)), pa.array(base), pa.array(total)], names=[doc_id, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return heads.groupBy("chunk").cogroup(found.unionAll(base).groupBy("to")).applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
