"""Operator 5: near-duplicate vectors by an exact metric range join.

Unit vectors with cosine >= c are those at most r = sqrt(2 - 2c) apart, so the join is a range join in a metric space:

1. Equal vectors collapse to one node with a count, so copies are never compared with each other.
2. Vectors are turned at random and cut into up to four subspaces. A linked pair is at most r / sqrt(subspaces) apart in the one where it
   is nearest; there it is sought and counted, and in no other.
3. In each subspace, pivots (a bounded sample) partition the nodes: each belongs to the cell of its nearest pivot. A node visits the cells
   that may hold a partner, of those before its own. By the triangle inequality a cell may not where the node's distance to the pivot exceeds
   the cell's radius by more than the range, nor where the plane between the two pivots is further than the range.
4. Nothing is replicated: cells, in an order in which neighbours are near, form groups of bounded bytes, a cell too large for one is dealt to
   several. A group is sent to all tasks, and the nodes that visit it stream by, each task with its part of the table, so disk is in proportion
   to the input. Within a cell, leaves of some BLOCK points let a visitor pass over most of them. A task returns, per vector, the number of
   its links and an edge to its class among the group, never the pairs.

Nothing is approximate: pivots decide where pairs meet, not whether. Turned vectors are whole numbers whose distances are exact in any
order of addition, so all passes agree where a pair counts; the range is wider by what rounding can change, and pairs that this leaves open are decided
by the cosine itself. Pivots that almost coincide are merged, as the plane between them says little. Vectors of each length have cells
of their own.

Defined results. Null vectors, zero vectors, empty ones and those with null or non-finite components link with nothing. Vectors of
different length do not link. Repeated rows count as other vectors. Empty table: empty result. Null ids count as vectors; a
component's id is its smallest non-null id. Extra columns are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import scratch
from ledgerflow.llm.components import components
from ledgerflow.llm.simhash import labels

COSINE, CELL, BLOCK, MOST_PIVOTS, MOST_SPACES = 0.95, 512, 64, 2048, 4
#: Bytes of vectors that are sent to all tasks at once, that a task compares with them at once (rows too), and that are turned at once.
CHUNK_BYTES, STREAM_BYTES, STREAM_ROWS, TURNED_BYTES = 24 << 20, 16 << 20, 32_768, 1 << 19
#: Turned vectors are whole numbers, this many to the unit: their products and sums stay below 2^24 and are exact in 32-bit floats.
SCALE = 1024
#: Pivots are so far apart at least (in units of SCALE): a plane's distance is divided by it.
SAFE = 51
#: Rows whose distances to all pivots are held at once.
SLICE = 256
#: Pairs are decided one by one where fewer than one in so many of a block pass, so many at once, and whole blocks otherwise.
SPARSE, MOST_PAIRS = 25, 1 << 14
#: Scores that are held at once, so that they stay in a core's cache.
TILE = 48 << 10
KEY_OF = {"float": np.dtype("<f4"), "double": np.dtype("<f8")}


def digest(column: str) -> Column:
    """What rows find their node by, where no two nodes share it."""
    return F.xxhash64(column)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def turned(x: np.ndarray) -> np.ndarray:
    """Unit vectors, turned by random signs and a Hadamard matrix, so that each coordinate has its share of any distance, in whole SCALE-ths."""
    n, d = x.shape
    p = 1 << (d - 1).bit_length()
    out = np.zeros((n, p))
    out[:, :d] = x * np.random.default_rng(d).choice([-1.0, 1.0], d)
    h = 1
    while h < p:
        v = out.reshape(n, -1, 2, h)
        out = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], 2).reshape(n, p)
        h *= 2
    return np.rint(out * (SCALE / math.sqrt(p))).astype(np.int16)


def _matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _by_size(b: pa.RecordBatch | pa.Table, most: int | None = None) -> Iterator[tuple[int, pa.RecordBatch | pa.Table]]:
    """The rows of each length of vectors, at most so many bytes of them at once."""
    sizes = np.asarray(pc.binary_length(b.column("key")))
    for size in np.unique(sizes).tolist():
        mine = b if (sizes == size).all() else b.take(pa.array(np.flatnonzero(sizes == size)))
        step = max(1, most // size) if most else len(sizes)
        for at in range(0, mine.num_rows, step):
            yield size, mine.slice(at, step)


def _keyed(df: DataFrame, kind: np.dtype) -> DataFrame:
    """(vec_id, key): the vector's bytes, null for those that link with nothing."""
    scalar = "float" if kind.itemsize == 4 else "double"
    held = df.select("vec_id", F.col("v").cast(f"array<{scalar}>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy().astype(np.int64)
            values = b.column(1).flatten()  # without those of null rows
            x = pc.fill_null(values, math.nan).to_numpy().astype(kind) + kind.type(0)  # + 0: no negative zeros
            at = np.concatenate([[0], np.cumsum(lengths)])
            count = lambda what: np.diff(np.concatenate([[0], np.cumsum(what)])[at])  # noqa: E731, B023
            fine = (count(~np.isfinite(x)) == 0) & (count(x != 0) > 0)
            valid = pa.array(fine).buffers()[1]
            ends = pa.py_buffer((at * kind.itemsize).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), len(fine), [valid, ends, pa.py_buffer(x)])], ["vec_id", "key"])

    schema = f"vec_id {df.schema['vec_id'].dataType.simpleString()}, key binary"
    return held.mapInArrow(run, schema)


def choose_pivots(nodes: DataFrame, n: int) -> list[bytes]:
    """A sample by hash of at most MOST_PIVOTS nodes, about one for each CELL of them: its size is bounded and checked."""
    k = min(MOST_PIVOTS, max(1, -(-n // CELL)))
    return [bytes(r.key) for r in nodes.select("key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(k).select("key").collect()]


def raised(x: np.ndarray, least: np.ndarray | float = 0.0) -> np.ndarray:
    """Points as rows that, times ``asking`` rows, give ``least`` (a squared distance) minus the squared distance."""
    return np.hstack([x, (least - (x * x).sum(axis=1))[:, None], np.ones((len(x), 1))]).astype(np.float32)


def asking(y: np.ndarray) -> np.ndarray:
    return np.hstack([2 * y, np.ones((len(y), 1)), -(y * y).sum(axis=1)[:, None]]).astype(np.float32)


def apart(p: np.ndarray) -> np.ndarray:
    """Points without those within SAFE of an earlier one."""
    near, out = asking(p) @ raised(p, SAFE * SAFE).T >= 0, []
    for k in range(len(p)):
        if not near[k, out].any():
            out.append(k)
    return p[out]


def side_by_side(p: np.ndarray) -> np.ndarray:
    """Points in an order in which neighbours are near: halves of halves along the widest coordinate."""
    if len(p) <= 2:
        return p
    p = p[np.argsort(p[:, p.var(axis=0).argmax()], kind="stable")]
    return np.vstack([side_by_side(p[: len(p) // 2]), side_by_side(p[len(p) // 2 :])])


class Space:
    """Vectors of one length: their subspaces, each with its pivots, and how far apart there a linked pair may be."""

    def __init__(self, size: int, kind: np.dtype, cosine: float, keys: list[bytes] | None = None):
        self.p = 1 << (size // kind.itemsize - 1).bit_length()
        self.m = max(1, min(MOST_SPACES, self.p // 16))
        self.k = self.p // self.m
        radius, off = SCALE * math.sqrt(max(2 - 2 * cosine, 0)), math.sqrt(self.p) + 0.01  # whole numbers: each coordinate of a difference is off by 1 at most
        self.radius = (radius + off) / math.sqrt(self.m)
        self.most, self.sure = math.floor((radius + off) ** 2) + 1, math.floor(max(radius - off, 0) ** 2) - 1
        q = turned(unit(np.frombuffer(b"".join(keys), kind).reshape(len(keys), -1))) if keys else np.zeros((1, self.p), np.int16)
        self.pivots = [side_by_side(apart(self.part(q, s))) for s in range(self.m)]
        self.raised = [raised(x) for x in self.pivots]

    def part(self, q: np.ndarray, s: int) -> np.ndarray:
        return q[:, s * self.k : (s + 1) * self.k].astype(np.float32)

    def homes(self, q: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest pivot, and its squared distance."""
        home, own = np.zeros(len(q), np.int64), np.zeros(len(q))
        for at in range(0, len(q), SLICE):
            d = asking(self.part(q[at : at + SLICE], s)) @ self.raised[s].T
            home[at : at + SLICE] = d.argmax(axis=1)
            own[at : at + SLICE] = -d.max(axis=1)
        return home, own

    def planes(self, p: np.ndarray, there: np.ndarray) -> np.ndarray:
        """How much larger a point's squared distance to one of ``there`` may be than that to one of ``p``, if it has a partner nearer to the former."""
        return np.sqrt(np.maximum(-(asking(p) @ there.T), 0)) * np.float32(2 * self.radius * 1.00001) + 1

    def visits(self, ask: np.ndarray, home: np.ndarray, own: np.ndarray, s: int, first: int, end: int, reach: np.ndarray) -> np.ndarray:
        """Which of the cells ``first`` to ``end`` may hold a partner, none after a row's own: a pair meets in the earlier of its cells."""
        cell, near = np.arange(first, end), np.empty((len(ask), end - first), bool)
        there = self.raised[s][first:end]
        between = self.planes(self.pivots[s], there)
        far = (((np.sqrt(reach[first:end]) + self.radius) ** 2) * 1.00001 + 1).astype(np.float32)
        for at in range(0, len(ask), SLICE):
            d, h = -(ask[at : at + SLICE] @ there.T), home[at : at + SLICE, None]
            near[at : at + SLICE] = (d <= far) & (cell < h)
            d -= own[at : at + SLICE, None].astype(np.float32)
            near[at : at + SLICE] &= d <= between[home[at : at + SLICE]]
            near[at : at + SLICE] |= cell == h
        return near


def measured(nodes: DataFrame, space: Callable[[int], Space], kind: np.dtype) -> list[Row]:
    """Of each cell: length in bytes, subspace, place, nodes, largest squared distance to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for size, b in _by_size(whole, TURNED_BYTES):
                of = space(size)
                q = turned(unit(_matrix(b.column("key"), kind)))
                for s in range(of.m):
                    home, own = of.homes(q, s)
                    p = len(of.pivots[s])
                    n, reach = seen.setdefault((size, s), (np.zeros(p, np.int64), np.zeros(p)))
                    n += np.bincount(home, minlength=p)
                    np.maximum.at(reach, home, own)
        for (size, s), (n, reach) in seen.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size)), pa.array(np.full(len(some), s)), pa.array(some), pa.array(n[some]), pa.array(reach[some])], ["size", "s", "place", "n", "reach"])

    found = nodes.select("key").mapInArrow(run, "size long, s long, place long, n long, reach double")
    return found.groupBy("s", "size", "place").agg(F.sum("n").alias("n"), F.max("reach").alias("reach")).collect()


class Groups:
    """Cells of a subspace, in order, in groups of at most CHUNK_BYTES; a larger cell is dealt to several."""

    def __init__(self, stats: list[Row], space: Callable[[int], Space], s: int):
        self.n, self.runs, self.reach, self.first, self.parts = 0, {}, {}, {}, {}
        held = 0  # bytes in the last group
        for size in sorted({r.size for r in stats}):
            p = len(space(size).pivots[s])
            self.reach[size], self.first[size], self.parts[size], runs = np.zeros(p), np.zeros(p, np.int64), np.ones(p, np.int64), []
            for r in sorted((r for r in stats if r.size == size), key=lambda r: r.place):
                mine = r.n * (size + 16)
                parts = -(-mine // CHUNK_BYTES)
                if not self.n or held + mine > CHUNK_BYTES:
                    self.n, held = self.n + parts, 0
                self.first[size][r.place], self.parts[size][r.place], self.reach[size][r.place] = self.n - parts, parts, r.reach
                held = held + mine if parts == 1 else CHUNK_BYTES
                runs += [[self.n - parts + t, r.place, r.place + 1] for t in range(parts)]
            joined = []
            for g, a, b in runs:
                if joined and joined[-1][0] == g:
                    joined[-1][2] = b
                else:
                    joined.append([g, a, b])
            self.runs[size] = joined


def placed(nodes: DataFrame, space: Callable[[int], Space], groups: list[Groups], kind: np.dtype) -> DataFrame:
    """(node, copies, key, q, and of each subspace s: home_s, group_s, visits_s_w): 63 groups to a word of those that a row visits."""
    words = [-(-g.n // 63) for g in groups]
    names = [*(f"home_{s}" for s in range(len(groups))), *(f"group_{s}" for s in range(len(groups))), *(f"visits_{s}_{w}" for s in range(len(groups)) for w in range(words[s]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for size, b in _by_size(whole, TURNED_BYTES):
                of, node = space(size), b.column("node").to_numpy()
                q = turned(unit(_matrix(b.column("key"), kind)))
                out = {x: np.full(len(q), -1 if x[0] != "v" else 0, np.int64) for x in names}
                for s in range(of.m):
                    g, (home, own) = groups[s], of.homes(q, s)
                    out[f"home_{s}"], out[f"group_{s}"] = home, g.first[size][home] + node % g.parts[size][home]
                    near = of.visits(asking(of.part(q, s)), home, own, s, 0, len(of.pivots[s]), g.reach[size])
                    for k, lo, hi in g.runs[size]:
                        out[f"visits_{s}_{k // 63}"] |= near[:, lo:hi].any(axis=1).astype(np.int64) << (k % 63)
                turns = pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(np.arange(len(q) + 1, dtype=np.int32) * (2 * of.p)), pa.py_buffer(np.ascontiguousarray(q))])
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("key"), turns, *(pa.array(out[x]) for x in names)], ["node", "copies", "key", "q", *names])

    return nodes.select("node", "copies", "key").mapInArrow(run, ", ".join(["node long, copies long, key binary, q binary", *(f"{x} long" for x in names)]))


def _pieces(x: np.ndarray, most: int) -> list[np.ndarray]:
    return [x[at : at + most] for at in range(0, len(x), most)]


class Chunk:
    """Nodes of one length in some cells of a subspace, cells cut into leaves of about BLOCK points around their mean."""

    def __init__(self, rows: pa.Table, of: Space, s: int, kind: np.dtype, reach: np.ndarray):
        column = lambda c: rows.column(c).chunk(0)
        home, q = column("home").to_numpy(), _matrix(column("q"), np.dtype(np.int16))
        x, order, self.cells, leaf_at, centres, radii, seeds, self.planes = of.part(q, s), [], [], [0], [], [], [], []
        by_home = np.argsort(home, kind="stable")
        places, starts = np.unique(home[by_home], return_index=True)
        for place, mine in zip(places.tolist(), np.split(by_home, starts[1:]), strict=True):
            seed = apart(x[mine[::BLOCK]])
            leaf = (asking(x[mine]) @ raised(seed).T).argmax(axis=1)
            inside = [(k, piece) for k in range(len(seed)) for piece in _pieces(mine[leaf == k], 4 * BLOCK)]  # seeds lie apart, so a dense one has many points
            own = seed[[k for k, _ in inside]]
            self.cells.append((place, len(centres), len(centres) + len(inside)))
            self.planes.append(of.planes(own, raised(own)))
            seeds.append(raised(own))
            for _, piece in inside:
                centre = np.rint(x[piece].mean(axis=0))
                centres.append(centre)
                radii.append(((x[piece] - centre) ** 2).sum(axis=1).max())
                order.append(piece)
                leaf_at.append(leaf_at[-1] + len(piece))
        order = np.concatenate(order)
        self.leaf_at, self.q, points = leaf_at, q[order], raised(x[order], math.floor(of.radius**2) + 1)
        self.points = np.concatenate([points[a:b].T.ravel() for a, b in itertools.pairwise(leaf_at)])  # a leaf's as columns, which are multiplied faster
        self.seeds, self.leaves = np.concatenate(seeds), raised(np.array(centres), np.ceil((np.sqrt(radii) + of.radius) ** 2 * 1.00001) + 1)
        self.home, self.node, self.copies, self.key = home[order], column("node").to_numpy()[order], column("copies").to_numpy()[order], _matrix(column("key"), kind)[order]
        self.reach = reach


def decide(x: np.ndarray, y: np.ndarray, of: Space, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (of rows of y and x) that may link and are nearest in subspace ``s``, where alone they count, and whether they link for sure."""
    total, owned = np.zeros((len(y), len(x)), np.float32), np.ones((len(y), len(x)), bool)
    here = -(asking(of.part(y, s)) @ raised(of.part(x, s)).T)
    for k in range(of.m):
        d = here if k == s else -(asking(of.part(y, k)) @ raised(of.part(x, k)).T)
        total += d
        if k != s:
            owned &= here < d if k < s else here <= d
    i, j = np.nonzero(owned & (total <= of.most))
    return i, j, total[i, j] <= of.sure


def decide_each(x: np.ndarray, y: np.ndarray, of: Space, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows, as ``decide``: which count here, and which of all link for sure."""
    d = x.astype(np.int32) - y
    d = (d * d).reshape(len(d), of.m, of.k).sum(axis=2)
    total = d.sum(axis=1)
    return (d.argmin(axis=1) == s) & (total <= of.most), total <= of.sure  # argmin: the first of equals


class Links:
    """Links of a chunk's nodes among the rows that stream by: counts on both sides, and edges that span the links."""

    def __init__(self, chunk: Chunk, of: Space, s: int, cosine: float):
        self.chunk, self.of, self.s, self.cosine = chunk, of, s, cosine
        self.links, self.lab = np.zeros(len(chunk.node), np.int64), np.arange(len(chunk.node))

    def pairs(self, q: np.ndarray, key: np.ndarray, node: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs as places in the stream's rows and in the chunk."""
        c, of, s = self.chunk, self.of, self.s
        x = of.part(q, s)
        ask, own = asking(x), ((x - of.pivots[s][home]) ** 2).sum(axis=1)
        first, end = c.cells[0][0], c.cells[-1][0] + 1
        near = of.visits(ask, home, own, s, first, end, c.reach)
        near, tile, wide, held, waiting = np.ascontiguousarray(near.T), np.empty(0, np.float32), ask.shape[1], [], 0
        for (place, lo, hi), planes in zip(c.cells, c.planes, strict=True):
            here = np.flatnonzero(near[place - first])
            mine = ask.take(here, axis=0)
            d = -(mine @ c.seeds[lo:hi].T)
            least = d.argmin(axis=1)
            d -= d[np.arange(len(d)), least][:, None]
            which = np.ascontiguousarray(((d <= planes[least]) & (mine @ c.leaves[lo:hi].T >= 0)).T)
            for leaf in range(lo, hi):
                a, b = c.leaf_at[leaf], c.leaf_at[leaf + 1]
                n, points, sub = b - a, c.points[a * wide : b * wide].reshape(wide, b - a), np.flatnonzero(which[leaf - lo])
                step = max(1, TILE // n)
                if len(tile) < step * n:
                    tile = np.empty(step * n, np.float32)
                for at in range(0, len(sub), step):
                    who = sub[at : at + step]
                    score = tile[: len(who) * n]
                    np.matmul(mine.take(who, axis=0), points, out=score.reshape(-1, n))
                    if score.max() < 0:
                        continue
                    hits = np.flatnonzero(score >= 0)
                    if len(hits) * SPARSE > len(score):
                        some = here[who[np.unique(hits // n)]]
                        i, j, sure = decide(c.q[a:b], q[some], of, s)
                        yield self.linked(key, node, home, some[i], a + j, sure)
                        continue
                    held.append((here[who[hits // n]], a + hits % n))
                    waiting += len(hits)
                    if waiting >= MOST_PAIRS:
                        yield self.each(q, key, node, home, held)
                        held, waiting = [], 0
        if held:
            yield self.each(q, key, node, home, held)

    def each(self, q: np.ndarray, key: np.ndarray, node: np.ndarray, home: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        i, j = map(np.concatenate, zip(*held, strict=True))
        counts, sure = decide_each(self.chunk.q[j], q[i], self.of, self.s)
        return self.linked(key, node, home, i[counts], j[counts], sure[counts])

    def linked(self, key: np.ndarray, node: np.ndarray, home: np.ndarray, i: np.ndarray, j: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that link."""
        c = self.chunk
        keep = (home[i] != c.home[j]) | (c.node[j] < node[i])  # both of a pair in one cell: once, and never with itself
        i, j, sure = i[keep], j[keep], sure[keep]
        open_ = np.flatnonzero(~sure)
        for at in range(0, len(open_), MOST_PAIRS):
            u = open_[at : at + MOST_PAIRS]
            sure[u] = np.einsum("ij,ij->i", unit(c.key[j[u]]), unit(key[i[u]])) >= self.cosine
        return i[sure], j[sure]

    def add(self, b: pa.Table, kind: np.dtype) -> pa.RecordBatch:
        """Take in rows of the stream; what they have among the chunk's nodes."""
        c, b = self.chunk, b.combine_chunks()
        column = lambda x: b.column(x).chunk(0)
        node, copies = column("node").to_numpy(), column("copies").to_numpy()
        links, n = np.zeros(len(node), np.int64), len(c.node)
        lab, held, waiting = np.concatenate([self.lab, n + np.arange(len(node))]), [], 0
        for i, j in self.pairs(_matrix(column("q"), np.dtype(np.int16)), _matrix(column("key"), kind), node, column("home").to_numpy()):
            np.add.at(links, i, c.copies[j])
            np.add.at(self.links, j, copies[i])
            new = lab[n + i] != lab[j]
            if new.any():
                held.append((n + i[new], j[new]))
                waiting += len(held[-1][0])
            if waiting > 1 << 20:
                lab, held, waiting = labels(len(lab), *map(np.concatenate, zip(*held, strict=True)), lab), [], 0
        if held:
            lab = labels(len(lab), *map(np.concatenate, zip(*held, strict=True)), lab)
        self.lab = lab[:n]
        some = np.flatnonzero(links)
        return _links(node[some], links[some], c.node[lab[n + some]])

    def rest(self) -> pa.RecordBatch:
        """What the chunk's nodes have among all rows that streamed by."""
        some = np.flatnonzero(self.links)
        return _links(self.chunk.node[some], self.links[some], self.chunk.node[self.lab[some]])


def _links(node: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], ["node", "links", "other"])


LINKS = "node long, links long, other long"


def compare(table: DataFrame, chunks: Broadcast, space: Callable[[int], Space], kind: np.dtype, s: int, cosine: float) -> DataFrame:
    """Rows that visit a group stream by its nodes -> (node, links, other): counts of links, each with an edge to a node of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        state: dict[int, Links] = {}

        def flush(size: int) -> Iterator[pa.RecordBatch]:
            if size not in chunks.value:  # a part of a cell that no node was dealt to
                held.pop(size)
                return
            if size not in state:
                state[size] = Links(chunks.value[size], space(size), s, cosine)
            yield state[size].add(pa.Table.from_batches(held.pop(size)), kind)

        for whole in batches:
            for size, b in _by_size(whole):
                held.setdefault(size, []).append(b)
                if sum(x.num_rows for x in held[size]) >= min(STREAM_ROWS, STREAM_BYTES // size):
                    yield from flush(size)
        for size in list(held):
            yield from flush(size)
        for x in state.values():
            yield x.rest()

    return table.mapInArrow(run, LINKS)


def join(nodes: DataFrame, kind: np.dtype, cosine: float) -> DataFrame:
    """``nodes(node, copies, key)`` -> (node, links, other): counts of links, each with an edge."""
    spark = nodes.sparkSession
    of_size: dict[int, list[bytes]] = {}
    for k in choose_pivots(nodes, nodes.count()):
        of_size.setdefault(len(k), []).append(k)
    spaces = {size: Space(size, kind, cosine, keys) for size, keys in of_size.items()}

    def space(size: int) -> Space:
        return spaces.get(size) or Space(size, kind, cosine)

    stats = measured(nodes, space, kind)
    groups = [Groups([r for r in stats if r.s == s], space, s) for s in range(max((r.s + 1 for r in stats), default=0))]
    table = scratch.table(placed(nodes, space, groups, kind), "cells")

    def met(s: int, k: int) -> str:
        """Where the links that count in subspace ``s`` are, of the nodes in group ``k``."""
        rows = table.select("node", "copies", "key", "q", F.col(f"home_{s}").alias("home"), f"group_{s}", F.col(f"visits_{s}_{k // 63}").alias("visits"))
        mine = rows.where(F.col(f"group_{s}") == k).select("node", "copies", "key", "q", "home").toArrow().combine_chunks()
        chunks = spark.sparkContext.broadcast({size: Chunk(x, space(size), s, kind, groups[s].reach[size]) for size, x in _by_size(mine)})
        del mine
        pa.default_memory_pool().release_unused()  # the driver holds one group at a time
        guests = rows.where(F.col("visits").bitwiseAND(F.lit(1 << (k % 63)).cast("long")) != 0).select("node", "copies", "key", "q", "home")
        path = scratch.table(compare(guests, chunks, space, kind, s, cosine), "links").scratch_path
        chunks.destroy()
        return path

    paths = [met(s, k) for s, g in enumerate(groups) for k in range(g.n)]
    scratch.drop(table)
    return spark.read.schema(LINKS).parquet(*paths) if paths else spark.createDataFrame([], LINKS)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``df``: ``vec_id``, ``n_links``, ``component_id``."""
    kind = KEY_OF.get(df.schema[vector].dataType.elementType.simpleString(), KEY_OF["double"])
    rows = scratch.table(_keyed(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), kind).withColumn("h", F.when(F.col("key").isNotNull(), digest("key"))), "vectors")
    grouped = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    nodes = scratch.table(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("h", digest("key")), "nodes")
    # Rows find their node by the digest of the vector, and by the vector itself only where two nodes share a digest.
    by = ["h"] if nodes.groupBy("h").count().where("count > 1").isEmpty() else ["h", "key"]
    facts, ids = scratch.table(nodes.select("node", "low", "copies", *by), "facts"), scratch.table(rows.select("vec_id", *by), "ids")
    scratch.drop(rows)
    found = join(nodes, kind, cosine)
    scratch.drop(nodes)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = facts.join(joined, facts["node"] == joined["a"], "left").join(counts, "node", "left").select(*by, "low", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    known = classes.join(smallest, "component").select(*by, (F.col("copies") - 1 + F.col("links")).alias("n"), "component_id")
    # Null keys find no partner; dealing them by id keeps many of them from meeting in one task.
    alone = ids.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ids.where("h is not null").join(known, by).select("vec_id", F.col("n").cast("long").alias("n_links"), "component_id").unionAll(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
