"""Operator 12: Merkle manifest of a dataset: a hash tree per group of rows, a tree over the groups' roots, a proof for every row.

Rows of a group ascend by id and are leaves; every two consecutive nodes become the hash of their digests (a last single one the
hash of its own) while a group has more than one. The trees are built with windows: rows get gapless slots, a block of
``2 ** LEVELS`` slots is a window partition, and a level is one lag and one lead by a fixed offset (1, 2, 4 ...), masked by the slot
and by how many nodes the level has. First children hash their parents, so a node stands in the row of its first leaf. A row's
siblings of all levels of a block are the last ones known at its slot. The blocks' top nodes, a thousandth of the rows, are the rows
of the next tier; three tiers hold a billion rows of a group. No window ever sees more than one block, however large the group.

Slots come from a range partitioning by group, id and digest (ties are split by their place in the input) and a sum per partition. Texts
are hashed in the scan and never moved. A lost executor costs a re-read: slots and tiers are written tables.

Defined results. A null field is ``-``. Null groups are one group, the first. Null ids come first in their group. Rows with equal ids
are ordered by their digests; equal rows are leaves of their own. Empty table: empty result. Extra columns are left out, columns
are found by their exact names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerflow.llm import scratch

#: Binary logarithm of the slots in a block.
LEVELS = 10


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """Length in bytes, colon, value; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return sha(*map(field, values))


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``slot`` (from 0 in each ``key``) and ``size`` (rows of the key), as a written table."""
    salted = df.withColumn("place", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (key, *order, "place")]
    sorted_ = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("place")
    placed = scratch.table(sorted_.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-rows")
    runs = placed.groupBy("part", key).agg(F.min("at").alias("first"), F.count("*").alias("n"))  # partitions plus keys
    earlier = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = scratch.table(runs.select("part", key, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy(key)).alias("size")), "merkle-runs")
    return placed.join(runs, ["part", key]).withColumn("slot", F.col("base") + F.col("at") - F.col("first")).drop("at", "part", "first", "base")


def fold(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``nodes(key, slot, size, h, ...)`` -> the same rows with ``path`` (siblings of ``LEVELS`` levels, from the leaf up: what stands left
    and right of the running digest), and the blocks' top nodes ``(key, slot, size, h)``."""
    block = F.shiftright("slot", LEVELS)
    df = nodes.withColumn("block", block)
    w = W.partitionBy("key", "block").orderBy("slot")
    steps = []
    for level in range(LEVELS):
        offset = 1 << level
        here, first = F.col("slot") % offset == 0, F.col("slot") % (2 * offset) == 0
        left = F.when(here & ~first, F.lag("h", offset).over(w))
        right = F.when(first & (F.col("slot") + offset < F.col("size")), F.lead("h", offset).over(w))
        several = F.col("size") > offset  # this level has more than one node
        step, sides = f"step{level}", F.struct(F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))
        df = df.withColumns({"left": left, "right": right})
        df = df.withColumns({step: F.when(here & several, sides), "h": F.when(first & several, sha(F.col("h"), F.coalesce("right", F.lit("")))).when(first, F.col("h"))}).drop("left", "right")
        steps.append(step)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    known = df.withColumns({s: F.last(s, ignorenulls=True).over(so_far) for s in steps})
    out = scratch.table(known.withColumn("path", F.array_compact(F.array(*steps))).drop(*steps), name)
    tops = out.where(F.col("slot") % (1 << LEVELS) == 0)
    return out.drop("h"), tops.select("key", F.col("block").alias("slot"), F.ceil(F.col("size") / (1 << LEVELS)).cast("long").alias("size"), "h")


def trees(rows: DataFrame) -> DataFrame:
    """``rows(key, slot, size, h, ...)`` -> the rows with ``path`` up to their key's top node, and that node's digest ``top``."""
    most = rows.agg(F.max("size")).first()[0] or 1
    out, up = fold(rows, "merkle-leaves")
    tiers = []
    while most > 1 << LEVELS:
        most = -(-most >> LEVELS) if most % (1 << LEVELS) == 0 else (most >> LEVELS) + 1
        above, up = fold(up, "merkle-tier")
        tiers.append(above.select("key", F.col("slot").alias("block"), F.col("block").alias("next"), F.col("path").alias("more")))
    for above in tiers:
        out = out.join(above, ["key", "block"]).withColumn("path", F.concat("path", "more")).drop("more", "block").withColumnRenamed("next", "block")
    return out.join(up.select("key", F.col("h").alias("top")), "key").drop("block", "slot", "size")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: sha(s["left"], h, s["right"]))


def manifest(df: DataFrame, id: str, group: Column, digest: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``df``: ``id``, ``leaf``, ``subroot``, ``root``, ``path`` (siblings up to the root) and the columns of ``carry``."""
    # Null first, then by bytes: a null group is a shorter key than any other.
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    rows = df.select(F.col(id).alias("id"), key.alias("key"), digest.alias("h"), digest.alias("leaf"), *[c.alias(f"_{name}") for name, c in (carry or {}).items()])
    within = trees(numbered(rows, "key", ["id", "leaf"]))
    groups = within.select("key", F.col("top").alias("h")).distinct()
    over = trees(numbered(groups.withColumnRenamed("key", "name").withColumn("key", F.lit("")), "key", ["name"]))
    over = over.select(F.col("name").alias("key"), F.col("top").alias("root"), F.col("path").alias("over"))
    out = within.join(over, "key").withColumn("path", F.concat("path", "over"))
    return out.select(F.col("id").alias(id), "leaf", F.col("top").alias("subroot"), "root", "path", *[F.col(f"_{name}").alias(name) for name in carry or {}])


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verified_manifest(df: DataFrame, fields: list[str], id: str, group: str, changed: dict[str, Column]) -> DataFrame:
    """Manifest of ``df`` and, for each row, whether the row with the ``changed`` columns still leads to the root by its proof."""
    # By position: names may differ in case only.
    names = df.columns
    exact = df.toDF(*[f"c{k}" for k in range(len(names))]).select(*[F.col(f"c{names.index(c)}").alias(c) for c in dict.fromkeys([id, group, *fields])])
    other = leaf(*[changed.get(c, F.col(c)) for c in fields])
    out = manifest(exact, id, F.col(group), leaf(*map(F.col, fields)), {"now": other})
    out = out.select(id, "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; where the checksum of the id is a multiple of seven, ``n_chars`` was changed after hashing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return verified_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"n_chars": tampered})


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"


def _levels_sql(name: str, source: str, key: str) -> str:
    return f"""{name} as (select 0 as level, {key}, slot, size, h from {source}
  union all select level + 1, {key}, slot // 2, (size + 1) // 2, sha256(string_agg(h, '' order by slot)) from {name} where size > 1 group by level, {key}, slot // 2, size)"""


#: A step is the side on which the sibling stands and the sibling; N: there is none.
_STEP = "case when s.h is null then 'N' when s.slot < n.slot then 'L' || s.h else 'R' || s.h end"
SQL = f"""
with recursive crc as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
docs as (select doc_id, source, lang, n_chars, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(str_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) as crc from documents, crc),
hashed as (select doc_id, lang,
    sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) as h,
    sha256({" || ".join(_field_sql(c) for c in ("doc_id", "source", "lang"))} || {_field_sql("(n_chars + case when crc % 7 = 0 then 1 else 0 end)")} || {_field_sql("text")}) as now from docs),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as slot, count(*) over (partition by lang) as size from hashed),
{_levels_sql("nodes", "leaves", "lang")},
subroots as (select lang, h, row_number() over (order by lang nulls first) - 1 as slot, count(*) over () as size, 0 as one from nodes where size = 1),
{_levels_sql("tops", "subroots", "one")},
inner_steps as (select n.lang, n.level, n.slot, {_STEP} as step from nodes n left join nodes s on s.level = n.level and s.lang is not distinct from n.lang and s.slot = xor(n.slot, 1) where n.size > 1),
outer_steps as (select n.level, n.slot, {_STEP} as step from tops n left join tops s on s.level = n.level and s.slot = xor(n.slot, 1) where n.size > 1),
own as (select l.lang, l.slot, list(i.step order by i.level) as steps from leaves l join inner_steps i on i.lang is not distinct from l.lang and i.slot = l.slot >> i.level::bigint group by l.lang, l.slot),
shared as (select r.lang, list(o.step order by o.level) as steps from subroots r join outer_steps o on o.slot = r.slot >> o.level::bigint group by r.lang),
paths as (select l.*, r.h as subroot, (select h from tops where size = 1) as root, coalesce(o.steps, []::varchar[]) || coalesce(s.steps, []::varchar[]) as steps
  from leaves l join subroots r on r.lang is not distinct from l.lang left join own o on o.lang is not distinct from l.lang and o.slot = l.slot left join shared s on s.lang is not distinct from l.lang),
final as (select doc_id, h as leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x[2:]), ''), '')) as proof_sha256,
  list_reduce(list_prepend(now, steps), lambda a, x: sha256(case x[1] when 'L' then x[2:] || a when 'R' then a || x[2:] else a end)) as folded_root from paths)
select *, folded_root = root as verified from final"""
