"""NFKC: right on awkward text, and Python is given small batches of the rows that need it only."""

import unicodedata

from ledgerflow.functions import text


def test_fold_compatibility_in_small_batches(spark):
    said = [None, "", "plain", "ﬁne ①", "é å", "x" * 70_000 + "ﬀ", "Ⅷ ½"]
    got = text.fold_compatibility(spark.createDataFrame(list(enumerate(said)), "n int, text string"), "text")
    assert {r.n: r.text for r in got.collect()} == {n: s and unicodedata.normalize("NFKC", s) for n, s in enumerate(said)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
