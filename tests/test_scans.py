"""Scans in two levels against plain loops, and chain operators over many short ranges against one range a statement."""

import random
from decimal import Decimal as D

import pytest
from ledgerflow.operators import chain, scans
from ledgerflow.plans.fixtures import ledger
from pyspark.sql import functions as F


def test_scan_is_a_loop(spark):
    random.seed(8)
    rows = [(s, 7 * k - 50, random.choice([None, None, k, -k, 0])) for s in (None, 1, 2, 3) for k in range(40 if s != 3 else 1)]
    rows.append((1, None, 99))  # no place: before all others
    df = spark.createDataFrame(random.sample(rows, len(rows)), "stmt_id long, row_seq long, v long").withColumn("V_extra", F.lit(1))
    out = scans.scan(df, ["stmt_id"], span=30, a=("lag", F.col("v")), b=("last", F.col("v")), c=("next", F.col("v")), d=("sum", F.col("v")), n=("sum", F.lit(1)))
    got = {(r.stmt_id, r.row_seq): (r.a, r.b, r.c, r.d, r.n) for r in out.collect()}
    want = {}
    for s in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0))
        vs = [r[2] for r in own]
        for i, r in enumerate(own):
            some = [v for v in vs[: i + 1] if v is not None]
            last = [v for v in vs[:i] if v is not None]
            want[r[:2]] = (vs[i - 1] if i else None, last[-1] if last else None, next((v for v in vs[i + 1 :] if v is not None), None), sum(some) if some else None, i + 1)
    assert got == want and len(got) == len(rows)
    assert scans.scan(df.limit(0), ["stmt_id"], a=("lag", F.col("v"))).count() == 0


OPERATORS = {
    "audit": chain.balance_audit, "reconcile": chain.reconcile_rows, "issues": chain.consecutive_issues, "status": chain.row_status, "static": chain.drop_static_rows, "repair": chain.repair_amounts, "swap": chain.swap_and_snap,
    "fill": chain.fill_missing_movement, "override": chain.movement_override, "flip": chain.flip_in_segments, "forward": chain.infer_balances, "backward": lambda df, **kw: chain.infer_balances(df, True, **kw), "adjust": chain.insert_chain_adjustments,
}


@pytest.fixture(scope="module")
def hot(spark, sf):
    """One statement that holds most rows, with long runs without balances."""
    x = ledger(spark, sf)
    one = x.withColumns({"row_seq": F.col("event_id").cast("long"), "stmt_id": F.when(F.col("event_id") % 3 > 0, F.lit(1)).otherwise(F.col("stmt_id")).cast("long"), "opening": F.lit(500).cast("decimal(18,2)")})
    gone = (F.col("event_id") % 200 < 90) | (F.col("event_id") % 7 == 0)
    one = one.withColumn("balance", F.when(gone, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("balance")))
    return one.cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_many_ranges_give_the_rows_of_one(hot, name):
    run = OPERATORS[name]
    plain = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    want = plain(run(hot, span=1 << 40))
    assert plain(run(hot, span=13)) == want and want
    assert scans.PART not in run(hot, span=13).columns


def test_flips_and_inference_over_ends_of_ranges(spark):
    rows = [(1, k, D(0), D(0), D(0)) for k in range(1, 41)]
    rows[0] = (1, 1, D(0), D(0), D(100))
    rows[20] = (1, 21, D(5), D(0), D(0))  # printed as a debit, meant as a credit
    rows[39] = (1, 40, D(0), D(0), D(105))
    df = spark.createDataFrame(rows, "stmt_id long, row_seq long, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)")
    flipped = chain.flip_in_segments(df, span=4)
    assert [(r.row_seq, r.credit) for r in flipped.where("credit > 0").collect()] == [(21, D(5))]
    full = {r.row_seq: r.balance for r in chain.infer_balances(flipped, span=4).collect()}
    assert full == {k: D(100) if k < 21 else D(105) for k in range(1, 41)}
    back = {r.row_seq: r.balance for r in chain.infer_balances(flipped.where("row_seq > 1"), True, span=4).collect()}
    assert back == {k: D(100) if k < 21 else D(105) for k in range(2, 41)}


def test_a_hot_statement_is_many_tasks(spark):
    """No window partition holds more than a range, whatever a statement's length."""
    df = spark.range(40_000).select(F.lit(1).alias("stmt_id"), F.col("id").alias("row_seq"), F.lit(1).cast("decimal(18,2)").alias("debit"), F.lit(0).cast("decimal(18,2)").alias("credit"), (-F.col("id")).cast("decimal(18,2)").alias("balance"))
    parts = scans.in_ranges(df, 1000).groupBy(scans.PART).count()
    assert {r["count"] for r in parts.collect()} == {1000}
    plan = chain.row_status(df.withColumn("opening", F.lit(0).cast("decimal(18,2)")), span=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(scans.PART) > 4 and chain.balance_audit(df, None, span=1000).count() == 0
