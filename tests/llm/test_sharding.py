import collections
import zlib

import duckdb
from ledgerflow.llm import sharding
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001/documents.parquet"


def test_query(spark, sf):
    rows = sharding.query(spark, sf).collect()
    want = {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in duckdb.sql(f"select doc_id, text from '{DATA}'").fetchall()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want and len(rows) == len(want)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_order_is_a_seeded_uniform_permutation(spark):
    df = spark.range(4000).withColumn("size", F.lit(1))
    first, again = ([r.global_slot for r in sharding.shuffled(df, "size").orderBy("id").collect()] for _ in range(2))
    other = [r.global_slot for r in sharding.shuffled(df, "size", seed=7).orderBy("id").collect()]
    assert first == again != other and sorted(first) == list(range(4000))
    moved = sum(abs(a - b) for a, b in enumerate(first)) / 4000
    assert abs(moved - 4000 / 3) < 150  # the mean displacement of a uniform permutation


def test_each_bucket_is_the_seeded_permutation_of_its_places(spark, monkeypatch):
    """The written draw, replayed: in every bucket the places in order of their slots are a permutation that begins at the bucket's offset."""
    held = []
    real = sharding.scratch.table
    monkeypatch.setattr(sharding.scratch, "table", lambda df, *a, **b: held.append(real(df, *a, **b)) or held[-1])
    monkeypatch.setattr(sharding, "GROUP", 8)
    df = spark.range(0, 5000, 1, 7).withColumn("size", F.lit(1))
    out = {r.id: r.global_slot for r in sharding.shuffled(df, "size", scan=True).collect()}
    place = F.monotonically_increasing_id()
    scattered = {r.place: (r.bucket, r.id) for r in df.select("id", place.alias("place"), F.pmod(F.xxhash64(F.lit(sharding.SEED), place), F.lit(64)).alias("bucket")).collect()}
    assert sorted(i for _, i in scattered.values()) == list(range(5000))
    drawn, by = {r.bucket: r.slots for r in held[1].collect()}, collections.defaultdict(list)
    for p, (bucket, i) in sorted(scattered.items()):
        by[bucket].append((out[i], p))
        assert out[i] == drawn[bucket][len(by[bucket]) - 1]  # the row's rank in its bucket names its draw
    base = moved = 0
    for bucket in sorted(by):
        slots, places = zip(*sorted(by[bucket]), strict=True)
        assert list(slots) == list(range(base, base + len(slots)))
        assert sorted(places) == sorted(p for p, (b, _) in scattered.items() if b == bucket)
        moved += list(places) != sorted(places)
        base += len(slots)
    assert base == 5000 and moved == len(by) == 64


def test_awkward_rows_and_copies(spark, awkward, tmp_path):
    sized = awkward.withColumn("size", F.lit(5))
    out = sharding.deal(sized, "size")
    assert out.count() == awkward.count() and out.select("shard", "slot").distinct().count() == awkward.count()
    assert sharding.deal(sized.limit(0), "size").count() == 0
    copies = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))
    sharding.write_shards(copies, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r["count"] for r in back.groupBy("shard").count().collect()} <= {187, 188}


def test_query_shuffles_whole_rows(spark, sf):
    rows = sharding.query(spark, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(DATA).collect()}
    (folder,) = {f.rsplit("/shard=", 1)[0] for f in rows.inputFiles()}
    shards = spark.read.parquet(folder)
    assert {r.doc_id: r.text for r in shards.collect()} == texts
    got = {(r.shard, r.slot): r.text_crc32 for r in rows.collect()}
    assert got == {(r.shard, r.slot): zlib.crc32((r.text or "").encode()) for r in shards.collect()}


def test_long_texts_in_small_buckets(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.col("id").cast("string"), F.when(F.col("id") == 5, 3_000_000).otherwise(40).cast("int"))).alias("text"))
    back = sharding.write_shards(df, str(tmp_path / "s"), bucket_bytes=20_000)
    assert {(r.doc_id, r.h) for r in back.select("doc_id", F.xxhash64("text").alias("h")).collect()} == {(r.doc_id, r.h) for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    assert {r["count"] for r in back.groupBy("shard").count().collect()} <= {18, 19}
    assert sharding.write_shards(df.limit(0), str(tmp_path / "e")).count() == 0


def test_texts_move_once_and_files_are_in_order(spark, sf, tmp_path, monkeypatch):
    plans = []
    writer = type(spark.range(1).write)
    real = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **b: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or real(self, path, *a, **b))
    docs = spark.read.parquet(DATA).select("doc_id", "text")
    sharding.write_shards(docs, str(tmp_path / "s"), scan=True)
    moved = [line for line in plans[-1].splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
    assert len(moved) <= 2 and sum("slots" not in line for line in moved) == 1  # the rows, and at most the draws
    back = spark.read.parquet(str(tmp_path / "s")).select("shard", "slot", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    for a, b in zip(back, back[1:], strict=False):
        assert a.f != b.f or a.slot < b.slot


def test_an_input_that_can_not_be_read_twice_is_written_first(spark, tmp_path):
    df = spark.range(0, 3000, 1, 5).repartition(7).withColumn("text", F.concat(F.lit("t"), F.rand().cast("string")))
    back = sharding.write_shards(df, str(tmp_path / "s"))
    assert sorted(r.id for r in back.collect()) == list(range(3000))
    assert {r["count"] for r in back.groupBy("shard").count().collect()} <= {187, 188}
