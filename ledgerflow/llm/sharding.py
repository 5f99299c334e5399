"""Operator 9: two-pass external shuffle into shards.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash of their place in the input. Pass two draws one
Fisher-Yates permutation per bucket (Spark's seeded ``shuffle`` of the array of the slots that the bucket's rows share out, so no text
is ever gathered), gives each row its slot by its rank in the bucket, and writes it. A bucket's slots begin at its offset, so all
slots together are one order of all rows; shards are ranges of that order, whose row counts differ by one at most (law ``rows``).

Texts move once, from the input to the task of their bucket, which also writes them: drawing needs the buckets' counts only, and
these come from the places. So the input is read twice and must give the same rows at the same places both times. A scan of a table
does; anything else is written to the shared folder first, with its places.

Only DataFrame functions are used. Hashing the place and not the content keeps buckets even when a third of all rows
are copies or share a key.

Defined results. Null text: size 1, checksum 0. Repeated rows: each gets its own slot. Empty table: empty result.
Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerflow.llm import scratch

SHARDS, SEED, BUCKET_BYTES, LEAST_BUCKETS = 16, 20240229, 64 << 20, 64
#: Bytes that a row counts for besides its own, so that a bucket of tiny rows holds about a million.
ROW_BYTES = 64
#: Buckets whose offsets are summed together; sums of such groups come first, so no task sees all buckets.
GROUP = 1024


def offsets_of(counts: DataFrame) -> DataFrame:
    """``counts(bucket, count)`` -> (bucket, count, base): rows in the buckets before it, summed in two levels."""
    grouped = counts.withColumn("part", F.floor(F.col("bucket") / GROUP))
    whole = grouped.groupBy("part").agg(F.sum("count").alias("all"))  # a thousandth of the buckets
    before = whole.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("before"))
    return grouped.join(before, "part").select("bucket", "count", (F.col("before") + F.sum("count").over(W.partitionBy("part").orderBy("bucket")) - F.col("count")).alias("base"))


def _drawn(df: DataFrame, size: str, seed: int, bucket_bytes: int, least_buckets: int, scan: bool) -> tuple[DataFrame, int]:
    """``df`` with ``global_slot``, and the number of its rows."""
    numbered = df.select(F.monotonically_increasing_id().alias("place"), (F.col(size) + ROW_BYTES).alias("held"), F.struct(*df.columns).alias("row"))
    if not scan:
        numbered = scratch.table(numbered, "numbered")
    rows, total = numbered.agg(F.count("*"), F.sum("held")).first()
    buckets = max(least_buckets, -(-int(total or 0) // bucket_bytes))
    scattered = numbered.select(F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)).cast("int").alias("bucket"), "place", "row")
    offsets = offsets_of(scratch.table(scattered.groupBy("bucket").count(), "counts"))
    # One row per bucket, in a fixed order inside each task: a task that runs again draws the same numbers. The draw is written, as
    # the join may read it twice.
    ordered = offsets.repartitionByRange("bucket").sortWithinPartitions("bucket")
    slots = scratch.table(ordered.select("bucket", F.shuffle(F.sequence("base", F.col("base") + F.col("count") - 1), F.lit(seed)).alias("slots")), "drawn")
    ranked = scattered.withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy("place")))
    slot = F.coalesce(F.get("slots", F.col("rank") - 1), F.raise_error(F.lit("the input gave other rows when it was read again")).cast("long"))
    return ranked.join(slots, "bucket", "left").select("row.*", slot.alias("global_slot")), rows


def shuffled(df: DataFrame, size: str, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS, scan: bool = False) -> DataFrame:
    """``df`` with ``global_slot``: a seeded uniform permutation of all rows, gapless from 0.

    ``size`` names the column with a row's bytes; buckets hold about ``bucket_bytes`` of them. ``scan``: ``df`` is a plain scan of a
    table, with columns computed row by row at most, so it can be read twice as it is.
    """
    return _drawn(df, size, seed, bucket_bytes, least_buckets, scan)[0]


def deal(df: DataFrame, size: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS, scan: bool = False) -> DataFrame:
    """Rows of ``df`` with ``law``, ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    out, n = _drawn(df.drop("law", "shard", "slot", "global_slot"), size, seed, bucket_bytes, least_buckets, scan)
    n = max(n, 1)
    out = out.withColumns({"law": F.lit("rows"), "shard": F.expr(f"cast(global_slot * {shards} div {n} as int)")})
    return out.withColumn("slot", F.expr(f"global_slot - (shard * {n}L + {shards - 1}) div {shards}")).drop("global_slot")


def write_shards(df: DataFrame, path: str, text: str = "text", shards: int = SHARDS, **options) -> DataFrame:
    """Write every row of ``df`` into Parquet folders ``shard=k``, each file in slot order, and read them back. The task of a bucket
    writes it, so a folder has a file from each task with rows of that shard."""
    sized = df.withColumn("size", F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1)
    dealt = deal(sized, "size", shards, **options)
    dealt.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows are shuffled into shards; size and checksum are those of the text that the shards hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    written = write_shards(docs, scratch.new_path(spark, "shards"), scan=True)
    text = F.coalesce("text", F.lit(""))
    return written.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
