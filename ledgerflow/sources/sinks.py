"""SNK: report tables and their writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import summary
from ledgerflow.operators.chain import KEY
from ledgerflow.operators.summary import needs_review


def scrub(c: Column) -> Column:
    """SNK-04: without control characters that sheets refuse."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def report_sheet(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """SNK-01: eight columns per row and the sheet it goes to."""
    title = F.substring(F.coalesce("account_no", F.concat(F.lit("Stmt "), F.col(key[0]).cast("string"))), 1, 31)
    text = scrub(F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.nullif(F.trim("remarks"), F.lit("")), "branch", F.lit("")))
    out = df.join(meta.select(*key, "account_no"), list(key), "left")
    return out.select(title.alias("sheet"), "row_seq", F.col("txn_date").cast("string").alias("date"), scrub(F.coalesce("value_date", F.lit(""))).alias("value_date"), scrub(F.coalesce("reference", F.lit(""))).alias("reference"), text.alias("description"), F.coalesce("category", F.lit("Unallocated")).alias("category"), "debit", "credit", "balance")


def write_sheets(sheet: DataFrame, path: str, form: str = "parquet") -> None:
    """A folder per sheet, rows in order inside each file."""
    sheet.repartition("sheet").sortWithinPartitions("sheet", "row_seq").write.partitionBy("sheet").format(form).save(path)


def summary_block(df: DataFrame, verdicts: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """SNK-02: account, totals and status per statement."""
    t = df.groupBy(*key).agg(F.sum("debit").alias("total_debit"), F.sum("credit").alias("total_credit"))
    return meta.select(*key, "account_no").join(t, list(key), "left").join(verdicts.select(*key, "status"), list(key), "left")


def audit_sheet(gaps: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """SNK-03: one row per gap."""
    return gaps.select(*key, F.col("page_no").alias("impacted_page"), F.col("txn_date").cast("string").alias("date"), F.col("narration").alias("description"), F.col("expected").alias("expected_balance"), F.col("balance").alias("extracted_balance"), F.col("diff").alias("difference"))


def bundle(df: DataFrame, categories: DataFrame, meta: DataFrame | None = None, key: Sequence[str] = KEY) -> dict[str, DataFrame]:
    """SNK-05: the seven tables of an analysis export."""
    base = ["txn_date", "reference", "description", "debit", "credit", "balance", "page_no", "source_file"]
    more = ["category", "sub_category", "tax_authority", "confidence_label", "decision_source", "reason"]
    full = df.select(*key, "row_seq", *base, *more, F.when(F.col("review_required"), "Yes").otherwise("No").alias("review_required"))
    return {
        "extracted_transactions": df.select(*key, "row_seq", *base), "classified_transactions": full, "category_summary": summary.category_summary(df, key), "monthly_summary": summary.monthly_summary(df, key),
        "review_required": full.where((F.col("review_required") == "Yes") | (F.col("confidence_label") == "Low")), "reconciliation": summary.reconciliation(df, meta, key), "rules_used": rules_used(categories),
    }


def write_bundle(sheets: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    for name, sheet in sheets.items():
        sheet.write.format(form).save(f"{path}/{name}")


def rules_used(categories: DataFrame) -> DataFrame:
    """SNK-06: one row per category of a template, keywords joined."""
    return categories.select("template_name", "scope", "instructions", "category", F.col("label").alias("output_label"), "applies_to", F.array_join("include", ", ").alias("include_keywords"), F.array_join("exclude", ", ").alias("exclude_keywords"), "priority")


def ledger_with_notes(df: DataFrame) -> DataFrame:
    """SNK-07: notes say who decided, by which rule, and reversals."""
    note = F.concat(F.when(F.col("is_reversal"), "[REVERSAL] ").otherwise(""), F.coalesce("decision_source", F.lit("")), F.when(F.col("rule_id").isNotNull(), F.concat(F.lit(" ("), "rule_id", F.lit(")"))).otherwise(""))
    return df.withColumn("notes", note)


def metric_sheet(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """SNK-08: labelled figures per statement: bounds, totals, income and expense by category."""
    g = df.groupBy(*key).agg(F.min_by(F.col("balance") + F.col("debit") - F.col("credit"), "row_seq").alias("o"), F.max_by("balance", "row_seq").alias("z"), F.sum("debit").alias("d"), F.sum("credit").alias("c"))
    line = lambda d, block, name, value: d.select(*key, F.lit(block).alias("block"), name.alias("metric"), value.cast("decimal(28,2)").alias("value"))
    both = df.groupBy(*key, "category").agg(F.sum("credit").alias("i"), F.sum("debit").alias("e"))
    parts = [line(g, "Metric", F.lit(n), F.col(c)) for n, c in (("Opening Balance (Calc)", "o"), ("Closing Balance", "z"), ("Total Debits", "d"), ("Total Credits", "c"))]
    parts += [line(both.where(f"{c} <> 0"), b, F.col("category"), F.col(c)) for b, c in (("Income by Category", "i"), ("Expenses by Category", "e"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["audit_sheet", "bundle", "ledger_with_notes", "metric_sheet", "needs_review", "report_sheet", "rules_used", "scrub", "summary_block", "write_bundle", "write_sheets"]
