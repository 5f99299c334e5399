"""The stateless stages on a stream: cleaning, rules and templates run unchanged on a streaming DataFrame.

No stateful operator is offered: running-balance work needs a statement's whole order, which a stream does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerflow.operators import rules, templates


def read_ledger(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a ledger folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def categorise_stream(stream: DataFrame, template: templates.Template | None = None) -> DataFrame:
    """Rows categorised by the built-in rules, or by a template."""
    return rules.categorise(stream) if template is None else templates.classify(templates.normalise_rows(stream), template)
