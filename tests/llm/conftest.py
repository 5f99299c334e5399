import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empties, ties, repeated rows, a long text and columns whose names clash with results."""
    long_text = " ".join(f"word{i % 900}" for i in range(12_000))
    rows = [(1, "The quick brown fox jumps", "s0"), (1, "The quick brown fox jumps", "s0"), (2, None, None), (3, "", "s1"), (None, "only words", "s1"), (4, " \t\n", ""), (5, long_text, "s0"), (6, long_text, "s0"), (7, "naïve café ÀÉ ﬀ 😀 a b", "s2"), (8, "A", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(9) for c in ("shard", "slot", "score", "a", "b", "fp", "block", "component_id", "host", "path", "row", "bucket", "n_words", "chunk", "start", "length")})
