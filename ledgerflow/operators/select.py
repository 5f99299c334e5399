"""ORD, SET: de-duplication, candidate choice, chunking, unions. Survivors are chosen by an explicit order, never by arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ledgerflow.operators.chain import KEY
from ledgerflow.operators.folds import fold_rows


def top_k(df: DataFrame, value: str, name: str, k: int = 8) -> DataFrame:
    """ORD-02: the k largest by absolute value, ties by name. The limit is the report."""
    return df.orderBy(F.abs(value).desc(), name).limit(k)


def distinct_rows(df: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """ORD-03: of rows equal in ``fields``, the first."""
    w = Window.partitionBy(*key, *fields).orderBy("row_seq")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ordered_unique(values: Column) -> Column:
    """ORD-04: first appearances, in order."""
    return F.array_distinct(values)


def best_candidate(candidates: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """ORD-05: match first, then printed totals, then rows; the earlier candidate on ties."""
    score = F.struct(F.coalesce("totals_match", F.lit(False)).cast("int"), F.col("has_totals").cast("int"), "n_rows", (-F.col("candidate")).alias("c"))
    return candidates.groupBy(*key).agg(F.max_by("candidate", score).alias("candidate"))


def nearest_totals(candidates: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """ORD-06: the candidate nearest to the printed totals if it is better than the first by more than 0.01; without
    printed totals, the one with most rows."""
    off = F.abs("debit_diff") + F.abs("credit_diff")
    x = candidates.withColumn("_off", off)
    g = x.groupBy(*key).agg(F.max(F.when(F.col("candidate") == 0, F.col("_off"))).alias("_first"), F.min_by("candidate", F.struct("_off", "candidate")).alias("_near"), F.min("_off").alias("_least"), F.max_by("candidate", F.struct("n_rows", -F.col("candidate"))).alias("_most"))
    better = F.col("_least") + F.lit("0.01").cast("decimal(18,2)") < F.col("_first")
    return g.select(*key, F.when(F.col("_first").isNull(), F.col("_most")).when(better, F.col("_near")).otherwise(0).alias("candidate"))


def cascade(candidates: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """ORD-07: the first stage that passes, else the one with most rows."""
    ok = F.coalesce("totals_match", F.lit(False))
    g = candidates.groupBy(*key).agg(F.min(F.when(ok, F.col("candidate"))).alias("_p"), F.max_by("candidate", F.struct("n_rows", -F.col("candidate"))).alias("_m"))
    return g.select(*key, F.coalesce("_p", "_m").alias("candidate"))


def accept_if_more(candidates: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """ORD-08: a later candidate only if it has more rows than the first."""
    n = lambda k: F.max(F.when(F.col("candidate") == k, F.col("n_rows")))
    return candidates.groupBy(*key).agg(F.when(F.coalesce(n(1), F.lit(0)) > F.coalesce(n(0), F.lit(0)), 1).otherwise(0).alias("candidate"))


def batches(df: DataFrame, size: int = 35, key: Sequence[str] = KEY) -> DataFrame:
    """ORD-09: rows of a statement in batches of ``size``."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("row_seq")) - 1) / size).cast("int"))


def text_chunks(pages: DataFrame, most: int = 80_000, key: Sequence[str] = ("file_id",)) -> DataFrame:
    """ORD-09: consecutive pages packed greedily into chunks of at most ``most`` characters; a longer page is alone. Null text is empty.

    Where a chunk ends depends on all before it, so a file's page lengths are streamed in order (numbers only, no text)."""

    def step(state: tuple, row: tuple) -> tuple:
        used, chunk = state
        fresh = used > 0 and used + row[0] > most
        return (row[0] if fresh else used + row[0], chunk + fresh), chunk + fresh

    sizes = pages.select(*key, "page_no", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return fold_rows(sizes, key, ["page_no"], ["n"], lambda: (0, 0), step, "chunk", IntegerType()).drop("n")


def concatenate(parts: Sequence[DataFrame]) -> DataFrame:
    """SET-01: rows of all parts, by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def vocabulary(lists: Sequence[DataFrame]) -> DataFrame:
    """SET-02: distinct labels of several one-column tables in order of first appearance (list, place)."""
    tagged = [d.select(F.col(d.columns[0]).alias("label"), F.col(d.columns[1]).alias("place"), F.lit(i).alias("list")) for i, d in enumerate(lists)]
    return concatenate(tagged).where("label <> ''").groupBy("label").agg(F.min(F.struct("list", "place")).alias("first"))
