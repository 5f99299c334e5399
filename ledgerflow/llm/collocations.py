"""Operator 11: phrases of two to five words that occur together more often than their parts would by chance, by direct-address tiling.

Words get ids by falling frequency, so frequent pairs have small ids on both sides. The square of all pairs of ids is cut into tiles;
in a chunk of text a tile that many pairs fall into is a dense array, counted with one numpy bincount whose cells are the pairs'
addresses; pairs of all other tiles are sorted coordinates. Pairs that are frequent in the whole corpus are ranked by frequency in turn
and get ids of their own: where two of them overlap, their ids are a pair again, and that pair is a phrase of three words. The same
step, applied to the ids of the step before, gives phrases of four and five.

Spark holds it together: texts become chunks of about ``SLICE_BYTES``, each a row of codes plus a row for each distinct word with its
count. Counts of a word are summed over chunks by a grouping, words seen ``least`` times are numbered by a range partitioning, the
numbers go back to the chunks that asked by a streamed merge, and codes and numbers meet in a cogrouping by chunk, which forms the
next length's pairs. A chunk deals its distinct pairs by hash to parts of all pairs and sends each part one packed row, in order, so a
pair takes a few bytes and its code none. A part counts its pairs over all chunks; pairs that are not frequent end there, and who has
the others is kept until they are numbered. There are as many parts as chunks ask for, so all chunks and all groups are bounded; no
vocabulary is ever in one task. A phrase that crosses the end of a chunk belongs to the chunk of its first word: chunks of one text
overlap by the words that takes.

All parts of a frequent phrase are frequent, so the tables of frequent phrases hold every count that scores need. A phrase is
dropped if a longer one occurs as often; it suffices to look at phrases one word longer, for counts fall with length.

Defined results. Null and empty texts have no words. Null languages are ``und``. Repeated rows count repeatedly. Empty table: empty
result. Extra columns are left out, columns are found by their exact names. Scores are exact below 1e16 words of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerflow.llm import scratch, sharding, textkit
from ledgerflow.llm.katz import dec, enc

LONGEST, LEAST, TOP, SLICE_BYTES = 5, 100, 2000, 4 << 20
#: Ids on a side of a tile; how many tiles on a side may be dense; pairs that make a tile dense.
TILE_BITS, HEAD, DENSE = 9, 16, 1 << 15
#: Answers that are packed together.
FLUSH = 1 << 20
#: Chunks whose pairs make up one part, and the fewest parts.
CHUNKS_A_PART, LEAST_PARTS = 4, 64
#: Groups into which a language's phrases are dealt before the last ranking.
DEALT = 64
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
WORD, BLANK, BREAK = range(3)


def _kinds() -> np.ndarray:
    t = np.full(256, WORD, np.uint8)
    t[list(BLANKS)] = BLANK
    t[list(BREAKS)] = BREAK
    return t


KINDS = _kinds()


def parts(data: np.ndarray, ahead: int) -> Iterator[tuple[np.ndarray, int]]:
    """A text in parts of about ``SLICE_BYTES`` that end before a blank or break; each with the bytes of at least ``ahead`` words after
    its own of the same piece, and the number of its own bytes."""
    at, n = 0, len(data)
    while at < n:
        to = at + SLICE_BYTES
        while to < n and KINDS[data[to]] == WORD:
            window = np.flatnonzero(KINDS[data[to : to + 4096]] != WORD)
            to += int(window[0]) if len(window) else 4096
        to = min(to, n)
        end, width = to, 4096
        while to < n:
            kind = KINDS[data[to : to + width]]
            stop = np.flatnonzero(kind == BREAK)
            word_ends = np.flatnonzero((kind[:-1] == WORD) & (kind[1:] != WORD)) + 1
            if len(stop) and (len(word_ends) < ahead or stop[0] < word_ends[ahead - 1]):
                end = to + int(stop[0])
            elif len(word_ends) >= ahead:
                end = to + int(word_ends[ahead - 1])
            elif to + width >= n:
                end = n
            else:
                width *= 2
                continue
            break
        yield data[at:end], to - at
        at = to


def words_of(held: list[np.ndarray], own_bytes: list[int], langs: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Codes of the words of some parts in order, -1 between pieces; which of them are own; and the words: local, lang, word, n."""
    data = textkit.LOWER[np.concatenate(held)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in held])])
    kind = KINDS[data]
    inside = kind == WORD
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    start = np.flatnonzero(inside & (cut[:-1] | ~np.append(False, inside[:-1])))
    end = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False))) + 1
    part = np.searchsorted(bounds, start, side="right") - 1
    own = start - bounds[part] < np.array(own_bytes, np.int64)[part]
    breaks = np.concatenate([[0], np.cumsum(kind == BREAK)])
    new_piece = np.append(False, (breaks[start[1:]] != breaks[end[:-1]]) | (part[1:] != part[:-1])) if len(start) else np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    names = sorted(set(langs))
    lang = np.array([names.index(x) for x in langs], np.int64)[part]
    distinct, local = np.unique(words.indices.to_numpy().astype(np.int64) * len(names) + lang, return_inverse=True)
    place = np.arange(len(start)) + np.cumsum(new_piece)
    size = int(place[-1]) + 1 if len(place) else 0
    codes, mine = np.full(size, -1, np.int32), np.zeros(size, bool)
    codes[place], mine[place] = local, own
    n = np.bincount(local, own, len(distinct)).astype(np.int64)
    table = pa.table({"local": pa.array(np.arange(len(distinct), dtype=np.int32)), "lang": pa.array(names).take(pa.array(distinct % len(names))), "word": words.dictionary.take(pa.array(distinct // len(names))).cast(pa.large_string()).cast(pa.string()), "n": pa.array(n)})
    return codes, mine, table


def pairs_of(ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of neighbouring ids, by tiles: at each place the number of the pair that begins there (-1: none), and for each
    pair its two ids and how often an own place has it."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) else np.zeros(0, np.int64)
    a, b, mine = ids[at], ids[at + 1], own[at]
    local = np.empty(len(at), np.int64)
    tile_a, tile_b = a >> TILE_BITS, b >> TILE_BITS
    tile = np.where((tile_a < HEAD) & (tile_b < HEAD), tile_a * HEAD + tile_b, HEAD * HEAD)
    sizes = np.bincount(tile, minlength=HEAD * HEAD + 1)
    dense = np.flatnonzero(sizes[:-1] >= DENSE)
    order = np.argsort(tile.astype(np.int16), kind="stable")
    edges = np.concatenate([[0], np.cumsum(sizes)])
    side = 1 << TILE_BITS
    out_a, out_b, out_n, base = [], [], [], 0
    for t in dense.tolist():
        rows = order[edges[t] : edges[t + 1]]
        cell = ((a[rows] & (side - 1)) << TILE_BITS) | (b[rows] & (side - 1))
        seen = np.bincount(cell, minlength=side * side) > 0
        own_n = np.bincount(cell[mine[rows]], minlength=side * side)
        cells = np.flatnonzero(seen)
        local[rows] = base + (np.cumsum(seen) - 1)[cell]
        out_a.append((t // HEAD << TILE_BITS) + (cells >> TILE_BITS))
        out_b.append((t % HEAD << TILE_BITS) + (cells & (side - 1)))
        out_n.append(own_n[cells])
        base += len(cells)
    is_dense = np.zeros(HEAD * HEAD + 1, bool)
    is_dense[dense] = True
    rows = np.flatnonzero(~is_dense[tile])
    # Ids of a chunk are few, so places in the list of its ids make one sortable coordinate.
    some_a, ia = np.unique(a[rows], return_inverse=True)
    some_b, ib = np.unique(b[rows], return_inverse=True)
    cells, inverse = np.unique(ia * max(len(some_b), 1) + ib, return_inverse=True)
    local[rows] = base + inverse
    if len(rows):
        out_a.append(some_a[cells // len(some_b)])
        out_b.append(some_b[cells % len(some_b)])
        out_n.append(np.bincount(inverse, mine[rows], len(cells)).astype(np.int64))
    codes = np.full(len(ids), -1, np.int32)
    codes[at] = local
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return codes, join(out_a), join(out_b), join(out_n)


def _with_codes(chunk: int, codes: np.ndarray | None, own: np.ndarray, symbols: pa.Table) -> pa.Table:
    """The rows of a chunk: its symbols, and first of all its codes."""
    held = pa.table({"chunk": pa.array([chunk], pa.int64()), "own": pa.array([enc(own, "u1")], pa.binary()), "codes": pa.array([enc(codes, "<i4") if codes is not None else None], pa.binary())})
    rows = symbols.append_column("chunk", pa.array(np.full(symbols.num_rows, chunk, np.int64)))
    return pa.concat_tables([held, rows], promote_options="default").select(["chunk", "own", "codes", *symbols.column_names])


def word_chunks(docs: DataFrame, longest: int) -> DataFrame:
    """``docs(lang, text)`` as chunks of codes, and for each chunk its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held, own, langs, size = [], [], [], 0

        def flush() -> list[pa.RecordBatch]:
            nonlocal chunk, size
            codes, mine, words = words_of(held, own, langs)
            held.clear(), own.clear(), langs.clear()
            chunk, size = chunk + 1, 0
            return _with_codes(chunk, codes, mine, words).to_batches() if words.num_rows else []

        for batch in batches:
            raw, bounds = textkit.texts_buffer(batch.column(1))
            names = batch.column(0).to_pylist()
            for k in range(batch.num_rows):
                for part, mine in parts(raw[bounds[k] : bounds[k + 1]], longest - 1):
                    held.append(part)
                    own.append(mine)
                    langs.append(names[k])
                    size += len(part)
                    if size >= SLICE_BYTES:
                        yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, "chunk long, own binary, codes binary, local int, lang string, word string, n long")


def answered(symbols: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """What ``table(by, id)`` knows of the symbols that chunks ask for: (to, local, id), a row for each chunk and ``FLUSH`` answers, its
    numbers packed. A merge of both sides in the order of their symbols, streamed: a symbol's row of the table comes first, and those who
    ask follow, however many they are; memory does not depend on them."""
    asked = symbols.select(*by, F.lit(1).alias("side"), "chunk", "local", F.lit(None).cast("long").alias("id"))
    known = table.select(*by, F.lit(0).alias("side"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("int").alias("local"), "id")
    merged = known.unionAll(asked).repartition(*map(F.col, by)).sortWithinPartitions(*by, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, last, last_id = 0, None, -1

        def flush() -> pa.RecordBatch:
            chunk, local, number = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((local, chunk))
            chunk, local, number = chunk[order], local[order], number[order]
            edges = [*np.flatnonzero(np.diff(chunk, prepend=-1)).tolist(), len(chunk)]
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            return pa.RecordBatch.from_arrays([pa.array([int(chunk[a]) for a, _ in spans], pa.int64()), pa.array([enc(local[a:b], "<u4") for a, b in spans], pa.binary()), pa.array([enc(number[a:b], "<u8") for a, b in spans], pa.binary())], names=["to", "local", "id"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(k) for k in range(len(by))]
            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = last != [k[0].as_py() for k in keys]
            ids = batch.column(len(by) + 3).fill_null(-1).to_numpy()
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            # The id of a symbol stands in its first row; symbols that go on from the last batch keep theirs.
            number = np.where(first >= 0, ids[np.maximum(first, 0)], last_id)
            last, last_id = [k[n - 1].as_py() for k in keys], int(number[-1])
            asks = (batch.column(len(by)).to_numpy() == 1) & (number >= 0)
            if asks.any():
                held.append((batch.column(len(by) + 1).fill_null(-1).to_numpy()[asks], batch.column(len(by) + 2).fill_null(-1).to_numpy()[asks], number[asks]))
                size += int(asks.sum())
            if size >= FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    return merged.mapInArrow(run, "to long, local binary, id binary")


def dealt(codes: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: int) -> tuple[np.ndarray, pa.Table]:
    """The pairs of a chunk by part, one packed row each, and the codes that fit: pairs are in the order of their part and ids, and a
    pair's code is its place, ``base`` being the first of its row."""
    mixed = (a.astype(np.uint64) * np.uint64(textkit.MIX_A)) ^ b.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(textkit.MIX_B)
    part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((b, a, part))
    code = np.empty(len(order) + 1, np.int32)
    code[order], code[-1] = np.arange(len(order)), -1
    a, b, n, part = a[order], b[order], n[order], part[order]
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    packed = {"a": [enc(np.diff(a[i:j], prepend=0), "<u8") for i, j in spans], "b": [enc(b[i:j], "<u8") for i, j in spans], "n": [enc(n[i:j], "<u8") for i, j in spans]}
    return code[codes], pa.table({"part": pa.array(part[edges[:-1]].astype(np.int32)), "base": pa.array(np.array(edges[:-1], np.int32))} | {k: pa.array(v, pa.binary()) for k, v in packed.items()})


def next_chunks(chunks: DataFrame, answers: DataFrame, parts: int, last: bool) -> DataFrame:
    """Chunks of the phrases one word longer: codes meet the ids that ``answers(to, local, id)`` give their symbols."""
    kinds = (("chunk", pa.int64()), ("own", pa.binary()), ("codes", pa.binary()), ("part", pa.int32()), ("base", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({k: pa.array([], t) for k, t in kinds})
        if not left.num_rows or not right.num_rows:
            return empty
        codes, own = dec(left.column("codes")[0].as_py(), "<i4"), dec(left.column("own")[0].as_py(), "u1").astype(bool)
        number = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)  # the last is for -1
        for local, ids in zip(right.column("local"), right.column("id"), strict=True):
            number[dec(local.as_py(), "<u4")] = dec(ids.as_py(), "<u8").astype(np.int64)
        codes, a, b, n = pairs_of(number[codes], own)
        if not len(a):
            return empty
        codes, symbols = dealt(codes, a, b, n, parts)
        return _with_codes(left.column("chunk")[0].as_py(), None if last else codes, own, symbols)

    held = chunks.where("codes is not null").select("chunk", "own", "codes")
    return held.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(run, "chunk long, own binary, codes binary, part int, base int, a binary, b binary, n binary")


def counted(chunks: DataFrame, least: int) -> DataFrame:
    """Pairs seen ``least`` times, and who has them. Two kinds of rows: (part, a, b, f, place), a pair with its place in its part; and
    (part, chunk, local, at), packed: the codes of a chunk's frequent pairs of that part, and their places."""
    kinds = (("part", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64()), ("place", pa.int32()), ("chunk", pa.int64()), ("local", pa.binary()), ("at", pa.binary()))

    def run(rows: pa.Table) -> pa.Table:
        each = [np.cumsum(dec(x.as_py(), "<u8")) for x in rows.column("a")]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in each])]).tolist()
        a = np.concatenate(each).astype(np.int64)
        b, n = (np.concatenate([dec(x.as_py(), "<u8") for x in rows.column(c)]).astype(np.int64) for c in "bn")
        small = max(a.max(), b.max()) < 1 << 31
        order = np.argsort((a << 32) | b, kind="stable") if small else np.lexsort((b, a))
        first, second = a[order], b[order]
        start = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        f = np.add.reduceat(n[order], start)
        often = f >= least
        place = np.empty(len(a), np.int64)
        place[order] = np.repeat(np.where(often, np.cumsum(often) - 1, -1), np.diff(np.append(start, len(a))))
        asks = []
        for chunk, base, i, j in zip(rows.column("chunk").to_pylist(), rows.column("base").to_pylist(), edges[:-1], edges[1:], strict=True):
            hit = np.flatnonzero(place[i:j] >= 0)
            if len(hit):
                asks.append((chunk, enc(np.diff(hit + base, prepend=0), "<u4"), enc(np.diff(place[i:j][hit], prepend=0), "<u4")))
        pairs = pa.table({"a": pa.array(first[start[often]]), "b": pa.array(second[start[often]]), "f": pa.array(f[often]), "place": pa.array(np.arange(int(often.sum()), dtype=np.int32))})
        chunks_of = pa.table({name: pa.array([x[k] for x in asks], kind) for k, (name, kind) in enumerate(kinds[5:])})
        both = pa.concat_tables([pairs, chunks_of], promote_options="default")
        return both.append_column("part", pa.array(np.full(both.num_rows, rows.column("part")[0].as_py(), np.int32))).select([k for k, _ in kinds])

    return chunks.where("part is not null").select("part", "chunk", "base", "a", "b", "n").groupBy("part").applyInArrow(run, "part int, a long, b long, f long, place int, chunk long, local binary, at binary")


def numbered(seen: DataFrame, table: DataFrame) -> DataFrame:
    """``answered`` for pairs: the ids that ``table(part, place, id)`` gives those that chunks have, (to, local, id)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number = np.zeros(right.num_rows, np.int64)
        number[right.column("place").to_numpy()] = right.column("id").to_numpy()
        plain = lambda x: np.cumsum(dec(x.as_py(), "<u4"), dtype=np.int64)
        local, ids = ([enc(read(x), kind) for x in left.column(c)] for c, kind, read in (("local", "<u4", plain), ("at", "<u8", lambda x: number[plain(x)])))
        return pa.table({"to": left.column("chunk"), "local": pa.array(local, pa.binary()), "id": pa.array(ids, pa.binary())})

    asks = seen.where("chunk is not null").select("part", "chunk", "local", "at")
    return asks.groupBy("part").cogroup(table.select("part", "place", "id").groupBy("part")).applyInArrow(run, "to long, local binary, id binary")


def ranked(df: DataFrame, by: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """``df(by, f, more)`` with ``id`` from 0 by falling ``f``, as a written table and a join with the partitions' offsets."""
    order = [F.col("f").desc(), *map(F.col, by)]
    placed = scratch.table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("bucket", F.shiftright("at", 33)), "phrases-ranked")
    offsets = sharding.offsets_of(placed.groupBy("bucket").count())  # a row for each partition
    return placed.join(F.broadcast(offsets), "bucket").select(*by, "f", *more, (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))


def frequent(symbols: DataFrame, by: list[str], least: int) -> DataFrame:
    return symbols.groupBy(*by).agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in exact arithmetic."""
    exact = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact(a) * exact(n), exact(left) * exact(right))


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``docs(lang, text)`` -> all candidates that are kept: lang, phrase, a, l, r, n, score."""
    chunks = scratch.table(word_chunks(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), longest), "phrases-1")
    totals = scratch.table(chunks.where("local is not null").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    by, words = ["lang", "word"], chunks.where("local is not null").drop("own", "codes")
    table = scratch.table(ranked(frequent(words, by, least), by), "phrases-frequent-1")
    levels, answers, seen = [table], answered(words, table, by), None
    parts = max(LEAST_PARTS, -(-chunks.where("codes is not null").count() // CHUNKS_A_PART))
    for length in range(2, longest + 1):
        before, chunks = [chunks, seen], scratch.table(next_chunks(chunks, answers, parts, length == longest), f"phrases-{length}")
        scratch.drop(*before)
        seen = scratch.table(counted(chunks, least), f"phrases-counted-{length}")
        pairs = seen.where("f is not null").select("a", "b", "f", "part", "place")
        if length == longest:
            levels.append(pairs.withColumn("id", F.lit(None).cast("long")))
            scratch.drop(chunks)
            break
        levels.append(scratch.table(ranked(pairs, ["a", "b"], ("part", "place")), f"phrases-frequent-{length}"))
        answers = numbered(seen, levels[-1])
    known = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    found = []
    for length, table in enumerate(levels[1:], 2):
        left = known.select(F.col("id").alias("a"), "lang", "phrase", "heads")
        right = known.select(F.col("id").alias("b"), "last", "tails")
        joined = table.join(left, "a").join(right, "b")
        known = scratch.table(joined.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails")), f"phrases-known-{length}")
        kept = known
        if length < longest:
            longer = levels[length]
            covered = longer.select(F.col("a").alias("id"), "f").unionAll(longer.select(F.col("b").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("covered"))
            kept = known.join(covered, "id", "left").where(F.col("covered").isNull() | (F.col("covered") < F.col("f")))
        scored = kept.join(totals, "lang")
        cuts = [(F.col("heads")[k - 1], F.col("tails")[length - k - 1], k) for k in range(1, length)]
        worst = F.array_min(F.array(*[F.struct(score(F.col("f"), F.col("n"), h, t).alias("score"), F.lit(k).alias("k"), h.alias("l"), t.alias("r")) for h, t, k in cuts]))
        found.append(scored.select("lang", "phrase", F.col("f").alias("a"), worst.alias("cut"), "n").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def best(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their rank, in two steps: of each of some groups, then of those."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = scored.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    first = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "dealt").orderBy(*order))).where(F.col("rank") <= top).drop("dealt", "rank")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, lang: str, text: str, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    names = df.columns  # by position: names may differ in case only
    placed = df.toDF(*[f"c{k}" for k in range(len(names))])
    return best(phrases(placed.select(F.col(f"c{names.index(lang)}").alias("lang"), F.col(f"c{names.index(text)}").alias("text")), longest, least), top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "text")
