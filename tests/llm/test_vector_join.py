import numpy as np
import pyarrow as pa
import pytest
from ledgerflow.llm import vector_join as v
from pyspark.sql import functions as F


def brute(vectors, cosine=0.95):
    ok = [x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x) for x in vectors]
    u = [np.array(x, float) / np.linalg.norm(x) if k else None for x, k in zip(vectors, ok, strict=True)]
    link = lambda i, j: i != j and ok[i] and ok[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine
    near = [[j for j in range(len(u)) if link(i, j)] for i in range(len(u))]
    best = list(range(len(u)))
    while True:
        new = [min([best[i], *(best[j] for j in near[i])]) for i in range(len(u))]
        if new == best:
            return [(i, len(near[i]), best[i]) for i in range(len(u))]
        best = new


def test_matches_brute_force_with_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(v, "CELL", 40)
    monkeypatch.setattr(v, "BLOCK", 30)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(centres[i % 12] + rng.normal(size=8) * 0.25).astype(np.float32).tolist() for i in range(240)]
    rows += [rows[0]] * 9 + [[2 * x for x in rows[1]]] + [None, [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] * 8, [], [1.0, 0.0], [1.0, 0.01], [-0.0] * 8, [1e-30] * 8, [1e30] * 8]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in v.near_duplicates(df).collect())
    assert got == brute([None if x is None else [c if c is None else float(np.float32(c)) for c in x] for x in rows])


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (None, [1.0, 0.0], 5), (2, None, 5)], "vec_id long, embedding array<double>, node int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in v.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)], key=str)
    assert v.near_duplicates(df.limit(0)).count() == 0
    assert v.near_duplicates(df.where("embedding is null")).count() == 1


def test_scaled_copies_as_pivots_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(v, "CELL", 30)
    rng = np.random.default_rng(11)
    centre = rng.normal(size=16)
    rows = [(centre * k).astype(np.float32).tolist() for k in rng.uniform(0.1, 9, 160)]
    rows += [(centre + rng.normal(size=16) * 0.3).astype(np.float32).tolist() for _ in range(200)]
    rows += [[1.0] * n for n in range(1, 90) for _ in range(2)]
    rows = [rows[k] if k < 360 else [x * (1 + k % 2) for x in rows[k]] for k in range(len(rows))]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in v.near_duplicates(df).collect())
    assert got == brute([[float(np.float32(c)) for c in x] for x in rows])


def spread_and_near(seed, n, d):
    """Vectors in all directions, a few near copies of some of them and one large near group."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[: n // 4] + rng.normal(size=(n // 4, d)) * rng.uniform(0.02, 0.45, (n // 4, 1)) / d**0.5
    group = x[0] + rng.normal(size=(n // 4, d)) * 0.25 / d**0.5
    return np.concatenate([x, near, group]).astype(np.float32)


def links_of(spark, df):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in v.near_duplicates(df).collect())


def test_no_table_is_many_times_the_input(spark, monkeypatch):
    monkeypatch.setattr(v, "CELL", 20)
    rows = spread_and_near(1, 400, 64).tolist()
    sizes, write = {}, v.scratch.table

    def table(df, name, *more):
        out = write(df, name, *more)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(v.scratch, "table", table)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    assert links_of(spark, df) == brute(rows)
    assert max(sizes.values()) <= 2 * len(rows), sizes


def test_many_groups_and_a_cell_dealt_to_several(spark, monkeypatch):
    monkeypatch.setattr(v, "CELL", 60)
    monkeypatch.setattr(v, "BLOCK", 8)
    monkeypatch.setattr(v, "CHUNK_BYTES", 9000)
    rows = spread_and_near(2, 200, 8).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    assert links_of(spark, df) == brute(rows)


def test_nodes_that_share_a_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(v, "digest", lambda column: F.lit(7).cast("long"))
    rows = [*spread_and_near(3, 40, 4).tolist(), None, [0.0] * 4]
    rows += rows[:5]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    assert links_of(spark, df) == brute(rows)


def test_words_of_visited_groups(spark, monkeypatch):
    """Each linked pair meets: the node of the later cell visits the group of the other, in every subspace where they are near enough."""
    monkeypatch.setattr(v, "CELL", 3)
    monkeypatch.setattr(v, "CHUNK_BYTES", 200)
    x, kind = spread_and_near(4, 300, 16), v.KEY_OF["float"]
    keys = [r.tobytes() for r in x]
    of = v.Space(64, kind, 0.95, keys[::3])
    nodes = spark.createDataFrame([(i, 1, k) for i, k in enumerate(keys)], "node long, copies long, key binary")
    groups = [v.Groups([r for r in v.measured(nodes, lambda _: of, kind) if r.s == 0], lambda _: of, 0)]
    got = {r.node: r for r in v.placed(nodes, lambda _: of, groups, kind).collect()}
    assert groups[0].n > 130
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, j in np.argwhere(u @ u.T >= 0.951).tolist():
        if got[i].home_0 >= got[j].home_0:
            k = got[j].group_0
            assert got[i][f"visits_0_{k // 63}"] >> (k % 63) & 1


@pytest.mark.parametrize(("cosine", "sparse", "most_pairs", "tile"), [(0.95, 0, 7, 64), (0.95, 10**9, 7, 64), (0.7, 25, 64, 4096), (1.0, 25, 64, 4096), (-0.2, 25, 1 << 14, 4096)])
def test_each_link_counts_once_in_all_subspaces(monkeypatch, cosine, sparse, most_pairs, tile):
    for name, value in (("SPARSE", sparse), ("MOST_PAIRS", most_pairs), ("TILE", tile), ("BLOCK", 6), ("SLICE", 50)):
        monkeypatch.setattr(v, name, value)
    x, kind = spread_and_near(5, 160, 50), v.KEY_OF["float"]
    x = np.concatenate([x, x[1] + np.random.default_rng(6).normal(size=(60, 50)).astype(np.float32) * np.float32(1e-3)])  # in one leaf, cut into pieces
    keys = [r.tobytes() for r in x]
    of, n = v.Space(200, kind, cosine, keys[::9]), len(x)
    q = v.turned(v.unit(x))
    copies, links, edges = np.arange(n) % 3 + 1, np.zeros(n, int), []
    assert of.m == 4
    for s in range(of.m):
        home, own = of.homes(q, s)
        reach = np.zeros(len(of.pivots[s]))
        np.maximum.at(reach, home, own)
        rows = pa.table({"node": np.arange(n), "copies": copies, "key": pa.array(keys, pa.binary()), "q": pa.array([r.tobytes() for r in q], pa.binary()), "home": home})
        for half in (home < len(reach) // 2, home >= len(reach) // 2):
            found = v.Links(v.Chunk(rows.filter(pa.array(half)).combine_chunks(), of, s, kind, reach), of, s, cosine)
            for b in (*(found.add(rows.slice(at, 70), kind) for at in range(0, n, 70)), found.rest()):
                np.add.at(links, b.column(0).to_numpy(), b.column(1).to_numpy())
                edges += zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)
    u = v.unit(x)
    near = np.einsum("ik,jk->ij", u, u) >= cosine
    np.fill_diagonal(near, False)
    assert links.tolist() == (near @ copies).tolist()
    a, b = np.array([*edges, (0, 0)]).T
    i, j = np.nonzero(near)
    assert v.labels(n, a, b).tolist() == v.labels(n, i, j).tolist()
