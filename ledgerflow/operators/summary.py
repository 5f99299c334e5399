"""AGG: totals, verdicts and overviews. Each is one grouping with map-side combination; no operator orders its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.dates import month_bucket
from ledgerflow.operators.chain import KEY, money


def _totals() -> list[Column]:
    return [F.sum("debit").alias("debit_total"), F.sum("credit").alias("credit_total"), F.sum(F.col("credit") - F.col("debit")).alias("net_movement"), F.count("*").alias("transaction_count")]


def category_summary(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """AGG-01: totals per category."""
    return df.withColumn("category", F.coalesce("category", F.lit("Review Required"))).groupBy(*key, "category").agg(*_totals())


def monthly_summary(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """AGG-02: totals per month and category."""
    return df.select("*", month_bucket(F.col("txn_date")).alias("month")).groupBy(*key, "month", "category").agg(*_totals())


def reconciliation(df: DataFrame, meta: DataFrame | None = None, key: Sequence[str] = KEY, tolerance: str = "0.05") -> DataFrame:
    """AGG-03: opening plus movements against closing; given bounds before those of the first and last row."""
    g = df.groupBy(*key).agg(F.min_by(F.col("balance") + F.col("debit") - F.col("credit"), "row_seq").alias("_open"), F.max_by("balance", "row_seq").alias("_close"), F.sum("debit").alias("total_debit"), F.sum("credit").alias("total_credit"))
    if meta is not None:
        g = g.join(meta.select(*key, "opening_balance", "closing_balance"), list(key), "left")
    given = lambda c: F.col(c) if meta is not None else F.lit(None)
    g = g.withColumns({"opening": F.coalesce(given("opening_balance"), "_open"), "actual_closing": F.coalesce(given("closing_balance"), "_close")})
    g = g.withColumn("expected_closing", F.col("opening") + F.col("total_credit") - F.col("total_debit")).withColumn("difference", F.col("actual_closing") - F.col("expected_closing"))
    status = F.when(F.col("difference").isNull(), "Unverified").when(F.abs("difference") <= F.lit(tolerance).cast("decimal(18,2)"), "Passed").otherwise("Failed")
    return g.select(*key, "opening", "total_debit", "total_credit", "expected_closing", "actual_closing", "difference", status.alias("status"))


def validate_totals(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY, tolerance: str = "0.50") -> DataFrame:
    """AGG-04: extracted against printed totals. ``totals_match`` is null where printed totals are missing."""
    last = F.max_by(F.col("balance"), F.when(F.col("balance") != 0, F.col("row_seq"))).alias("last_balance")
    g = meta.join(df.groupBy(*key).agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), last, F.count("*").alias("n_rows")), list(key), "left")
    zero = money(0)
    opening, last_b = F.coalesce("opening_balance", zero), F.coalesce("last_balance", zero)
    closing = F.when((F.coalesce("closing_balance", zero) == 0) & (last_b != 0), last_b).otherwise(F.coalesce("closing_balance", zero))
    g = g.withColumns({"_open": opening, "_last": last_b, "_close": closing})
    bounds = F.col("opening_balance").isNotNull() & (F.col("closing_balance").isNotNull() | (F.col("_last") != 0))
    g = g.withColumns({"implied": F.col("_open") + F.col("c") - F.col("d"), "debit_diff": F.col("d") - F.col("statement_total_debit"), "credit_diff": F.col("c") - F.col("statement_total_credit")})
    reconciles = bounds & (F.abs(F.col("implied") - F.col("_close")) <= 1)
    t = F.lit(tolerance).cast("decimal(18,2)")
    g = g.withColumns({"reconciles": F.coalesce(reconciles, F.lit(False)), "totals_match": (F.abs("debit_diff") <= t) & (F.abs("credit_diff") <= t), "has_totals": F.col("statement_total_debit").isNotNull() & F.col("statement_total_credit").isNotNull()})
    header = F.lower("bank").isin("gtbank", "gtco") & F.col("reconciles") & (F.col("_last") != 0) & (F.abs(F.col("_close") - F.col("_last")) > 1)
    two = lambda f, a, b: F.format_string(f, F.col(a).cast("double"), F.col(b).cast("double"))
    status = (
        F.when(F.col("n_rows").isNull(), "No transactions extracted")
        .when(~F.col("has_totals") & F.col("reconciles"), "Ledger balances reconcile; statement debit/credit totals unavailable.")
        .when(~F.col("has_totals"), "Statement totals missing (cannot fully validate). Extraction totals computed.")
        .when(F.col("totals_match"), "Totals match statement")
        .when(header, two("Header totals and transaction ledger conflict: ledger rows are internally consistent, but they do not reconcile to statement header totals (header closing=%.2f, ledger closing=%.2f).", "_close", "_last"))
        .when(F.col("reconciles"), "Statement totals and transaction ledger conflict: ledger rows reconcile from opening to closing balance, but extracted debit/credit totals do not match the statement summary.")
        .otherwise(two("Totals mismatch: Debit diff=%.2f, Credit diff=%.2f", "debit_diff", "credit_diff"))
    )
    match = F.when(F.col("n_rows").isNull(), False).when(F.col("has_totals"), F.col("totals_match"))
    return g.select(*key, status.alias("status"), match.alias("totals_match"), F.coalesce("d", zero).alias("extracted_total_debit"), F.coalesce("c", zero).alias("extracted_total_credit"), *(F.when(F.col("n_rows").isNotNull() & F.col("has_totals"), F.col(c)).alias(c) for c in ("debit_diff", "credit_diff")))


def totals_gate(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """AGG-05: whether printed totals exist and are met within 1.0."""
    g = meta.join(df.groupBy(*key).agg(F.sum("debit").alias("d"), F.sum("credit").alias("c")), list(key), "left")
    has = F.col("statement_total_debit").isNotNull() & F.col("statement_total_credit").isNotNull()
    diff = lambda a, b: F.when(has, F.coalesce(a, money(0)) - F.col(b))
    g = g.withColumns({"debit_diff": diff("d", "statement_total_debit"), "credit_diff": diff("c", "statement_total_credit"), "has_statement_totals": has})
    return g.select(*key, "has_statement_totals", ((F.abs("debit_diff") <= 1) & (F.abs("credit_diff") <= 1)).alias("totals_match"), "debit_diff", "credit_diff")


def file_rollup(df: DataFrame, meta: DataFrame, file_of: str, key: Sequence[str] = KEY) -> DataFrame:
    """AGG-06: one row per file: totals, printed ones only if every statement has them, and the statement with most rows."""
    per = meta.join(df.groupBy(*key).agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count("*").alias("n")), list(key), "left").withColumn("file_id", F.expr(file_of))
    has = F.col("statement_total_debit").isNotNull() & F.col("statement_total_credit").isNotNull()
    g = per.groupBy("file_id").agg(F.sum("d").alias("d"), F.sum("c").alias("c"), F.sum(F.coalesce("n", F.lit(0))).alias("transaction_count"), F.count("*").alias("statement_count"), F.bool_and(has).alias("all_have"), F.sum("statement_total_debit").alias("sd"), F.sum("statement_total_credit").alias("sc"), F.max_by(F.col(key[0]), F.struct(F.coalesce("n", F.lit(0)), -F.col(key[0]))).alias("primary_stmt"))
    shown = lambda a, b: F.when(F.col("all_have"), F.col(a)).otherwise(F.col(b))
    return g.select("file_id", shown("sd", "d").alias("total_debit"), shown("sc", "c").alias("total_credit"), F.col("d").alias("extracted_total_debit"), F.col("c").alias("extracted_total_credit"), "transaction_count", "statement_count", (F.col("statement_count") > 1).alias("multi_statement"), "primary_stmt")


def rollup_status(verdicts: DataFrame, file_of: str) -> DataFrame:
    """AGG-07: true if every statement of a file matches, false if any does not, else null."""
    g = verdicts.withColumn("file_id", F.expr(file_of)).groupBy("file_id").agg(F.bool_and(F.coalesce("totals_match", F.lit(False))).alias("every"), F.bool_or(~F.col("totals_match")).alias("some_not"))
    return g.select("file_id", F.when(F.col("every"), True).when(F.col("some_not"), False).alias("totals_match"))


def folder_baseline(df: DataFrame, verdicts: DataFrame, file_of: str, key: Sequence[str] = KEY) -> DataFrame:
    """AGG-08: counts, totals and verdicts per file."""
    rows = df.groupBy(*key).agg(F.count("*").alias("n"), F.sum("debit").alias("d"), F.sum("credit").alias("c"))
    joined = verdicts.select(*key, "totals_match", "status").join(rows, list(key), "left").withColumn("file_id", F.expr(file_of))
    return joined.groupBy("file_id").agg(F.count("*").alias("n_statements"), F.sum(F.coalesce("n", F.lit(0))).alias("n_transactions"), F.sum("d").alias("total_debit"), F.sum("c").alias("total_credit"), F.count_if("totals_match").alias("n_match"), F.count_if(~F.col("totals_match")).alias("n_mismatch"), F.count_if(F.col("totals_match").isNull()).alias("n_unknown"))


def expense_allocation(df: DataFrame) -> DataFrame:
    """AGG-09: debits above zero per category."""
    return df.where("debit > 0").groupBy("category").agg(F.sum("debit").alias("amount"))


#: Categories that are movements and not expenses.
MOVEMENTS = ["Opening Balance", "Closing Balance", "Inter-Account / Treasury Transfer", "Unallocated"]


def top_net_expenses(df: DataFrame, n: int = 8) -> DataFrame:
    """AGG-10, ORD-02: the largest net expenses, ties by name. The limit is the report."""
    g = df.where(~F.col("category").isin(MOVEMENTS)).groupBy("category").agg(F.sum(F.col("debit") - F.col("credit")).alias("value"))
    return g.where("value > 0").orderBy(F.col("value").desc(), "category").limit(n)


def income_and_expense(df: DataFrame) -> DataFrame:
    """AGG-11: both sides per category, null where a side has no movement."""
    return df.groupBy("category").agg(F.sum(F.when(F.col("credit") != 0, F.col("credit"))).alias("income"), F.sum(F.when(F.col("debit") != 0, F.col("debit"))).alias("expense"))


def needs_review() -> Column:
    """FLT-06: flagged, or of low confidence."""
    return F.col("review_required") | (F.col("confidence_label") == "Low")


def workspace_counters(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """AGG-12: rows by who decided, and rows for review."""
    src = lambda s: F.count_if(F.col("decision_source") == s)
    return df.groupBy(*key).agg(F.count("*").alias("total"), src("RULE").alias("rule"), src("AI").alias("ai"), src("MANUAL").alias("manual"), F.count_if(needs_review()).alias("review"))


def statement_overview(df: DataFrame, meta: DataFrame, verdicts: DataFrame, anomalies: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """AGG-13: printed figures before computed ones, counts of anomalies and reviews, and the check's outcome."""
    g = df.groupBy(*key).agg(F.min_by(F.col("balance") + F.col("debit") - F.col("credit"), "row_seq").alias("o"), F.max_by("balance", "row_seq").alias("cl"), F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count("*").alias("transaction_count"), F.count_if(F.col("flag") == "review").alias("reviews"))
    g = g.join(meta, list(key), "left").join(verdicts.select(*key, "totals_match"), list(key), "left").join(anomalies.groupBy(*key).agg(F.count("*").alias("anomalies")), list(key), "left")
    check = F.when(F.col("totals_match"), "Passed").when(~F.col("totals_match"), "Failed").otherwise("Unverified")
    return g.select(*key, F.coalesce("opening_balance", "o").alias("opening"), F.coalesce("closing_balance", "cl").alias("closing"), F.coalesce("statement_total_debit", "d").alias("total_debits"), F.coalesce("statement_total_credit", "c").alias("total_credits"), "transaction_count", F.coalesce("anomalies", F.lit(0)).cast("long").alias("anomalies"), "reviews", check.alias("check_status"))


def result_mapping(verdicts: DataFrame, counts: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """AGG-14: whether reconciliation failed, with the warning to show."""
    g = verdicts.join(counts, list(key), "left").withColumn("none", F.coalesce("n_rows", F.lit(0)) == 0)
    bad_text = F.lower("status").contains("mismatch") | F.lower("status").contains("no transactions extracted")
    failed = F.col("none") | F.coalesce(~F.col("totals_match"), F.lit(False)) | (~F.coalesce("totals_match", F.lit(False)) & bad_text)
    return g.select(*key, failed.alias("reconciliation_failed"), F.when(failed, F.coalesce("status", F.lit("No transactions extracted"))).alias("warning"))


def out_of_scope_credits(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """AGG-15: credits that a debit-only template leaves aside."""
    aside = ((F.col("category") == "Out of Scope") | (F.col("debit") == 0)) & (F.col("credit") > 0)
    return df.groupBy(*key).agg(F.coalesce(F.sum(F.when(aside, F.col("credit"))), money(0)).alias("out_of_scope_credit"))


def empty_description_gate(df: DataFrame, text: str = "narration", key: Sequence[str] = KEY, most: float = 0.25) -> DataFrame:
    """AGG-16: statements with too many empty descriptions."""
    g = df.groupBy(*key).agg(F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("n_empty"), F.count("*").alias("n"))
    return g.select(*key, "n_empty", "n", (F.col("n_empty") / F.col("n") > most).alias("retry"))


def regression(actual: DataFrame, expected: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """AGG-17: PASS, FAIL with reasons, or SKIP where nothing was extracted."""
    e = expected.join(actual, list(key), "left")
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > F.col("tolerance")
    said = lambda name, a, b: F.when(off(a, b), F.format_string(f"{name} expected %.2f, got %.2f", F.col(b).cast("double"), F.col(a).cast("double")))
    count = F.when(F.col("n") != F.col("expected_count"), F.format_string("count expected %d, got %d", "expected_count", "n"))
    errors = F.filter(F.array(count, said("debit", "d", "expected_debit"), said("credit", "c", "expected_credit"), said("closing", "last_balance", "expected_closing")), lambda x: x.isNotNull())
    e = e.withColumn("errors", F.array_join(errors, "; "))
    return e.select(*key, F.when(F.col("n").isNull(), "SKIP").when(F.col("errors") == "", "PASS").otherwise("FAIL").alias("result"), F.when(F.col("n").isNull(), "nothing extracted").otherwise(F.col("errors")).alias("reasons"))


def audit_lines(df: DataFrame, text: str = "narration") -> DataFrame:
    """AGG-18: one line per row: date, signed amount, category, narration."""
    amount = F.when(F.col("credit") > 0, F.col("credit")).otherwise(-F.col("debit"))
    return df.withColumn("line", F.concat_ws(" | ", F.col("txn_date").cast("string"), F.format_number(amount, 2), "category", text))
