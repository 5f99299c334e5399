"""Operator 13: token counts of whole texts under a byte-pair vocabulary with word ends, by rank-synchronous array merging.

A task holds the pre-tokens of a slice of texts as ragged numpy arrays: one array of symbols, one of the sequence each belongs to.
In each round every sequence applies its own lowest-ranked pair at all its places at once, until no sequence has a pair left; what
survives is counted. Equal pre-tokens of a slice are merged once. Rounds are bounded by the length of a sequence; sequences of more
than ``LONG`` symbols are merged rank by rank instead: places wait in a queue by rank, symbols are linked, so a word of
megabytes costs time in proportion to its length.

Doing all places of a pair at once equals the one-by-one order of the library because a merge only uses symbols of earlier
merges; ``vocabulary`` refuses a file where that does not hold. Classes of characters (letter, number, white space) and the
normalisation of texts that are not ASCII are the library's own, so both agree on every character it knows.

The work is one pass over the rows: no shuffle, nothing gathered. Texts are cut at blanks into slices of ``SLICE_BYTES``.

Defined results. Null and empty texts: no bytes, no tokens. Literals of special tokens inside a text are one token each (the library's
default). Repeated rows are counted each for itself. Empty table: empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ledgerflow.llm import textkit

VOCABULARY, LIMIT, SLICE_BYTES, LONG = "word_bpe_49k.json", 2048, 1 << 20, 256
SPACE, LETTER, NUMBER, OTHER = range(4)
NEVER = np.int64(1) << 40
#: Fixed values of the pre-tokeniser: what follows an apostrophe that stands alone.
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
#: Fixed value: the only pre-tokeniser pattern this module knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@dataclass
class Vocabulary:
    inner: np.ndarray  # symbol of a byte inside a word, -1 if there is none
    last: np.ndarray  # symbol of a byte at the end of a word
    keys: np.ndarray  # sorted: left * size + right
    ranks: np.ndarray
    made: np.ndarray
    size: int
    kind: np.ndarray  # class of each code point
    special: re.Pattern | None
    normalise: object

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NEVER`` if it does not merge) and where it stands in ``keys``."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), at


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in set(shown) else next(rest)) for b in range(256)]


def _kinds() -> np.ndarray:
    """Class of every code point, as the library's regular expressions see it; planes without letters are not asked."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.array([*range(0xD800), *range(0xE000, 0x40000)], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[points[a:b]] = kind
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], spec["added_tokens"]
    split, level = [*(spec["pre_tokenizer"] or {}).get("pretokenizers", []), {}, {}][:2]
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    known = model["type"] == "BPE" and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback", "dropout"))
    known &= kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": PATTERN} and level.get("type") == "ByteLevel" and not level["use_regex"] and not level["add_prefix_space"]
    if not known or any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: not a byte-level vocabulary with word ends of the kind this module counts")
    ids, end = model["vocab"], model["end_of_word_suffix"] or ""
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made_at: dict[str, int] = {}
    for rank, (a, b) in enumerate(merges):
        if a + b in made_at:
            raise ValueError(f"{path}: {a + b!r} is made by two merges")
        made_at[a + b] = rank
    if any(made_at.get(x, -1) > rank for rank, pair in enumerate(merges) for x in pair):
        raise ValueError(f"{path}: a merge uses a symbol of a later one")
    size = max(ids.values()) + 1
    key = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
    order = np.argsort(key)
    made = np.array([ids[a + b] for a, b in merges], np.int64)
    chars = byte_characters()
    special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
    return Vocabulary(np.array([ids.get(c, -1) for c in chars], np.int64), np.array([ids.get(c + end, -1) for c in chars], np.int64), key[order], np.arange(len(merges))[order], made[order], size, _kinds(), special, Tokenizer.from_file(path).normalizer.normalize_str)


def every_other(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of places in order, of which ``follows`` says that one begins where the last one's pair ends: the first of each run, the third ..."""
    index = np.arange(len(at))
    start = np.maximum.accumulate(np.where(follows, 0, index))
    return at[(index - start) % 2 == 0]


def surviving(v: Vocabulary, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Symbols left of each sequence; ``sizes``: how many symbols each one begins with."""
    out = sizes.astype(np.int64).copy()
    for k in np.flatnonzero(sizes > LONG).tolist():
        a = int(sizes[:k].sum())
        out[k] = _surviving_long(v, symbols[a : a + int(sizes[k])])
    seq = np.repeat(np.arange(len(sizes)), sizes)
    keep = (sizes > 1)[seq] & (sizes <= LONG)[seq]
    symbols, seq = symbols[keep], seq[keep]
    while len(symbols):
        first = np.flatnonzero(np.diff(seq, prepend=-1))
        rank, at = v.look_up(symbols, np.append(symbols[1:], 0))
        rank[np.append(first[1:], len(symbols)) - 1] = NEVER  # a sequence's last symbol has no partner
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
        hit = np.flatnonzero((rank == lowest) & (rank < NEVER))
        hit = every_other(hit, np.diff(hit, prepend=-2) == 1)
        symbols[hit] = v.made[at[hit]]
        out -= np.bincount(seq[hit], minlength=len(out))
        keep = lowest < NEVER
        keep[hit + 1] = False
        symbols, seq = symbols[keep], seq[keep]
    return out


def _surviving_long(v: Vocabulary, symbols: np.ndarray) -> int:
    """As ``surviving`` for one long sequence: ranks in ascending order, each at all its places at once."""
    n = len(symbols)
    symbols = np.append(symbols, 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    now = np.full(n + 1, NEVER)
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []
    left = n

    def enlist(at: np.ndarray) -> None:
        rank, _ = v.look_up(symbols[at], symbols[after[at]])
        rank[after[at] >= n] = NEVER
        now[at] = rank
        at, rank = at[rank < NEVER], rank[rank < NEVER]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        edges = np.flatnonzero(np.diff(rank[order], prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            r = int(rank[order[a]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(queue, r)
            waiting[r].append(at[order[a:b]])

    enlist(np.arange(n))
    while queue:
        r = heapq.heappop(queue)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[now[at] == r]
        if not len(at):
            continue
        at = every_other(at, np.append(False, after[at[:-1]] == at[1:]))
        gone = after[at]
        symbols[at] = v.made[np.searchsorted(v.keys, symbols[at] * v.size + symbols[gone])]
        now[gone] = NEVER
        after[at] = after[gone]
        before[after[at]] = at
        left -= len(at)
        behind = before[at]
        enlist(np.unique(np.concatenate([at, behind[behind >= 0]])))
    return left


def pre_tokens(v: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of normalised texts begin and end in their bytes; ``bounds``: of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.ones(n, bool)
    if (data > 127).any():
        lead = (data & 0xC0) != 0x80
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = v.kind[points][np.cumsum(lead) - 1]
    else:
        kind = v.kind[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    start = cut[:n] | (np.diff(kind, prepend=255) != 0) | ((kind == NUMBER) & lead)
    # An apostrophe that begins a run of other characters and ends it takes the letters of a contraction with it.
    tick = np.flatnonzero((data == 39) & start)
    tick = tick[tick + 1 < n]
    tick = tick[(kind[tick + 1] == LETTER) & ~cut[tick + 1]]
    long = tick + 2
    two = (long < n) & (kind[np.minimum(long, n - 1)] == LETTER) & ~cut[np.minimum(long, n)]
    for tail in CONTRACTIONS:
        fits = data[tick + 1] == tail[0]
        if len(tail) > 1:
            fits &= two & (data[np.minimum(long, n - 1)] == tail[1])
        at = tick[fits]
        start[at + 1] = False
        rest = at + 1 + len(tail)
        start[rest[rest < n]] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    word = kind[begin] != SPACE
    return begin[word], end[word]


def _cuts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text's bytes in parts that begin at a blank and hold about ``SLICE_BYTES``: no pre-token or composed character spans a blank."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        to, width = at + SLICE_BYTES, 1 << 12
        while to < len(data):  # the next blank
            blanks = np.flatnonzero(data[to : to + width] == 32)
            if len(blanks):
                to += int(blanks[0])
                break
            to, width = to + width, width * 2
        to = min(to, len(data))
        yield data[at:to]
        at = to
    yield data[at:]


def count_slice(v: Vocabulary, parts: list[np.ndarray]) -> np.ndarray:
    """Tokens of each text of a slice."""
    plain, owner, out = [], [], np.zeros(len(parts), np.int64)
    for k, part in enumerate(parts):
        raw = part.tobytes()
        if raw.isascii() and not (v.special and b"<" in raw):
            plain.append(textkit.LOWER[part])
            owner.append(k)
            continue
        text = raw.decode("utf-8")
        pieces = v.special.split(text) if v.special else [text]
        out[k] += len(pieces) - 1
        plain += [np.frombuffer(v.normalise(p).encode("utf-8"), np.uint8) for p in pieces]
        owner += [k] * len(pieces)
    data = np.concatenate(plain) if plain else np.zeros(0, np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in plain])]).astype(np.int64)
    begin, end = pre_tokens(v, data, bounds)
    if not len(begin):
        return out
    size = end - begin
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begin] += 1  # no place occurs twice in either
    inside[end] -= 1
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(inside[:-1]) > 0])])
    coded = words.dictionary_encode()
    _, raw_offsets, raw = coded.dictionary.buffers()
    edges = np.frombuffer(raw_offsets, np.int64)[: len(coded.dictionary) + 1]
    distinct = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]]
    symbols = v.inner[distinct]
    symbols[edges[1:] - 1 - edges[0]] = v.last[distinct[edges[1:] - 1 - edges[0]]]
    sizes = np.diff(edges)
    if (symbols < 0).any():  # the library leaves out bytes that the vocabulary lacks
        sizes = np.add.reduceat((symbols >= 0).astype(np.int64), edges[:-1] - edges[0])
        symbols = symbols[symbols >= 0]
    tokens = np.concatenate([[0], np.cumsum(surviving(v, symbols, sizes)[coded.indices.to_numpy()])])
    at = np.searchsorted(begin, bounds)
    np.add.at(out, owner, tokens[at[1:]] - tokens[at[:-1]])
    return out


def counted(v: Vocabulary, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text of a column."""
    raw, bounds = textkit.texts_buffer(column)
    out, held, rows, size = np.zeros(len(bounds) - 1, np.int64), [], [], 0

    def flush() -> None:
        np.add.at(out, np.array(rows, np.int64), count_slice(v, held))
        held.clear()
        rows.clear()

    for k in range(len(out)):
        for part in _cuts(raw[bounds[k] : bounds[k + 1]]):
            held.append(part)
            rows.append(k)
            size += len(part)
            if size >= SLICE_BYTES:
                flush()
                size = 0
    flush()
    return np.diff(bounds), out


def count_tokens(df: DataFrame, text: str, path: str, limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """``df`` (all columns, or those of ``keep``) with ``n_bytes``, ``n_tokens`` and ``over_limit`` of the column ``text``."""
    fields = [f for f in df.schema.fields if f.name not in ("n_bytes", "n_tokens", "over_limit") and (keep is None or f.name in keep)]
    # By position: names may differ in case only.
    placed = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    places = {f.name: k for k, f in enumerate(df.schema.fields)}
    rows = placed.select(*[F.col(f"c{places[f.name]}") for f in fields], F.col(f"c{places[text]}").alias("body"))
    schema = StructType([*[StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)], StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n_bytes, n_tokens = counted(v, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*[f.name for f in fields], "n_bytes", "n_tokens", "over_limit")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document under the vocabulary with word ends."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, "text", public_tokenizers.path(VOCABULARY), keep=["doc_id"])
