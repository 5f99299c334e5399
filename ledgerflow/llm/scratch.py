"""Intermediate tables in the folder that driver and executors share.

Every operator that reads its own intermediate result twice writes it as a Parquet table here instead of caching it,
so a lost executor costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (local tests) a temporary folder of this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own[app] = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a new shared Parquet table and read it back: lineage ends at the files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    # Rows may hold megabytes: the writer looks at its memory after a few of them, not after a hundred.
    writer = df.write.option("compression", "zstd").option("parquet.page.size.row.check.min", "4").option("parquet.block.size", str(32 << 20))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables written by ``table`` that no later result reads."""
    for t in tables:
        if t is not None:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
