"""Queries of summaries, reports and selection over the derived ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import chain, review, select, summary, templates
from ledgerflow.plans.chain_queries import AUDIT_SQL, plain
from ledgerflow.plans.classify_queries import ALL, CLASSIFIED_SQL, TEMPLATED_SQL, classified, templated
from ledgerflow.plans.fixtures import LEDGER_SQL, META_SQL, ledger, statement_meta
from ledgerflow.plans.registry import query
from ledgerflow.sources import sinks

_T = TEMPLATED_SQL["firs-sirs-na"]
_sums = "CAST(sum(debit) AS DOUBLE) AS debit_total, CAST(sum(credit) AS DOUBLE) AS credit_total, CAST(sum(credit - debit) AS DOUBLE) AS net_movement, count(*) AS transaction_count"
_dbl = lambda *cs: ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cs)
FILE = "cast(floor(stmt_id / 4) as bigint)"


@query("agg_01_category_summary", f"WITH {CLASSIFIED_SQL} SELECT category, {_sums} FROM classified GROUP BY category")
def _(spark, sf_dir):
    return plain(summary.category_summary(classified(spark, sf_dir)))


@query("agg_02_monthly_summary", f"WITH {CLASSIFIED_SQL} SELECT strftime(txn_date, '%Y-%m') AS month, category, {_sums} FROM classified GROUP BY ALL")
def _(spark, sf_dir):
    return plain(summary.monthly_summary(classified(spark, sf_dir)))


_REC = f"""r AS (SELECT stmt_id, min_by(balance + debit - credit, row_seq) AS o, max_by(balance, row_seq) AS z, sum(debit) AS d, sum(credit) AS c FROM ledger GROUP BY stmt_id),
rec AS (SELECT stmt_id, coalesce(opening_balance, o) AS opening, d AS total_debit, c AS total_credit, coalesce(opening_balance, o) + c - d AS expected_closing, coalesce(closing_balance, z) AS actual_closing FROM r LEFT JOIN statement_meta USING (stmt_id))"""


@query("agg_03_reconciliation", f"WITH {LEDGER_SQL}, {META_SQL}, {_REC} SELECT stmt_id, {_dbl('opening', 'total_debit', 'total_credit', 'expected_closing', 'actual_closing')}, CAST(actual_closing - expected_closing AS DOUBLE) AS difference, CASE WHEN abs(actual_closing - expected_closing) <= 0.05 THEN 'Passed' ELSE 'Failed' END AS status FROM rec")
def _(spark, sf_dir):
    return plain(summary.reconciliation(ledger(spark, sf_dir), statement_meta(spark, sf_dir)))


#: The ledger without faults for odd statements, so that every verdict occurs.
def _mixed(spark, sf_dir) -> DataFrame:
    from ledgerflow.plans.fixtures import true_ledger

    good = true_ledger(spark, sf_dir).select("stmt_id", "row_seq", "txn_date", F.col("true_debit").alias("debit"), F.col("true_credit").alias("credit"), F.col("true_balance").alias("balance"))
    return good.where("stmt_id % 2 = 1").unionByName(ledger(spark, sf_dir).where("stmt_id % 2 = 0").select(*good.columns))


_MIX = "mixed AS (SELECT stmt_id, row_seq, txn_date, true_debit AS debit, true_credit AS credit, true_balance AS balance FROM true_ledger WHERE stmt_id % 2 = 1 UNION ALL SELECT stmt_id, row_seq, txn_date, debit, credit, balance FROM ledger WHERE stmt_id % 2 = 0)"
VALID_SQL = f"""{LEDGER_SQL}, {META_SQL}, {_MIX},
vg AS (SELECT m.*, d, c, coalesce(lb, 0) AS lb, opening_balance + c - d AS implied, d - statement_total_debit AS dd, c - statement_total_credit AS cd, n FROM statement_meta m LEFT JOIN (SELECT stmt_id, sum(debit) AS d, sum(credit) AS c, max_by(balance, row_seq) FILTER (balance <> 0) AS lb, count(*) AS n FROM mixed GROUP BY stmt_id) USING (stmt_id)),
vh AS (SELECT *, CASE WHEN closing_balance = 0 AND lb <> 0 THEN lb ELSE closing_balance END AS cb FROM vg),
verdicts AS (SELECT stmt_id, d, c, dd, cd, n, CASE WHEN statement_total_debit IS NULL THEN CASE WHEN abs(implied - cb) <= 1 THEN 'Ledger balances reconcile; statement debit/credit totals unavailable.' ELSE 'Statement totals missing (cannot fully validate). Extraction totals computed.' END
 WHEN abs(dd) <= 0.5 AND abs(cd) <= 0.5 THEN 'Totals match statement' WHEN bank = 'gtbank' AND abs(implied - cb) <= 1 AND lb <> 0 AND abs(cb - lb) > 1 THEN printf('Header totals and transaction ledger conflict: ledger rows are internally consistent, but they do not reconcile to statement header totals (header closing=%.2f, ledger closing=%.2f).', CAST(cb AS DOUBLE), CAST(lb AS DOUBLE))
 WHEN abs(implied - cb) <= 1 THEN 'Statement totals and transaction ledger conflict: ledger rows reconcile from opening to closing balance, but extracted debit/credit totals do not match the statement summary.' ELSE printf('Totals mismatch: Debit diff=%.2f, Credit diff=%.2f', CAST(dd AS DOUBLE), CAST(cd AS DOUBLE)) END AS status,
 CASE WHEN statement_total_debit IS NOT NULL THEN abs(dd) <= 0.5 AND abs(cd) <= 0.5 END AS totals_match FROM vh)"""


def verdicts(spark, sf_dir) -> DataFrame:
    return summary.validate_totals(_mixed(spark, sf_dir), statement_meta(spark, sf_dir))


@query("agg_04_validate_totals", f"WITH {VALID_SQL} SELECT stmt_id, status, totals_match, CAST(d AS DOUBLE) AS extracted_total_debit, CAST(c AS DOUBLE) AS extracted_total_credit, CAST(dd AS DOUBLE) AS debit_diff, CAST(cd AS DOUBLE) AS credit_diff FROM verdicts")
def _(spark, sf_dir):
    return plain(verdicts(spark, sf_dir))


@query("agg_05_totals_gate", f"WITH {VALID_SQL} SELECT stmt_id, dd IS NOT NULL AS has_statement_totals, abs(dd) <= 1 AND abs(cd) <= 1 AS totals_match, CAST(dd AS DOUBLE) AS debit_diff, CAST(cd AS DOUBLE) AS credit_diff FROM verdicts")
def _(spark, sf_dir):
    return plain(summary.totals_gate(_mixed(spark, sf_dir), statement_meta(spark, sf_dir)))


@query("agg_06_file_rollup", f"""WITH {VALID_SQL}, f AS (SELECT stmt_id // 4 AS file_id, sum(v.d) AS ed, sum(v.c) AS ec, sum(n) AS transaction_count, count(*) AS statement_count, bool_and(statement_total_debit IS NOT NULL) AS ah, sum(statement_total_debit) AS sd, sum(statement_total_credit) AS sc, arg_max(stmt_id, n * 1000000 - stmt_id) AS primary_stmt FROM verdicts v JOIN statement_meta USING (stmt_id) GROUP BY ALL)
SELECT file_id, CAST(CASE WHEN ah THEN sd ELSE ed END AS DOUBLE) AS total_debit, CAST(CASE WHEN ah THEN sc ELSE ec END AS DOUBLE) AS total_credit, CAST(ed AS DOUBLE) AS extracted_total_debit, CAST(ec AS DOUBLE) AS extracted_total_credit, CAST(transaction_count AS BIGINT) AS transaction_count, statement_count, statement_count > 1 AS multi_statement, primary_stmt FROM f""")
def _(spark, sf_dir):
    return plain(summary.file_rollup(_mixed(spark, sf_dir), statement_meta(spark, sf_dir), FILE))


@query("agg_07_rollup_status", f"WITH {VALID_SQL} SELECT stmt_id // 4 AS file_id, CASE WHEN bool_and(coalesce(totals_match, false)) THEN true WHEN bool_or(NOT totals_match) THEN false END AS totals_match FROM verdicts GROUP BY 1")
def _(spark, sf_dir):
    return summary.rollup_status(verdicts(spark, sf_dir), FILE)


@query("agg_08_folder_baseline", f"WITH {VALID_SQL} SELECT stmt_id // 4 AS file_id, count(*) AS n_statements, CAST(sum(n) AS BIGINT) AS n_transactions, CAST(sum(d) AS DOUBLE) AS total_debit, CAST(sum(c) AS DOUBLE) AS total_credit, count(*) FILTER (totals_match) AS n_match, count(*) FILTER (NOT totals_match) AS n_mismatch, count(*) FILTER (totals_match IS NULL) AS n_unknown FROM verdicts GROUP BY 1")
def _(spark, sf_dir):
    return plain(summary.folder_baseline(_mixed(spark, sf_dir), verdicts(spark, sf_dir), FILE))


@query("agg_09_expense_allocation", f"WITH {CLASSIFIED_SQL} SELECT category, CAST(sum(debit) AS DOUBLE) AS amount FROM classified WHERE debit > 0 GROUP BY 1")
def _(spark, sf_dir):
    return plain(summary.expense_allocation(classified(spark, sf_dir)))


@query("agg_10_top_net_expenses", f"WITH {CLASSIFIED_SQL} SELECT category, CAST(sum(debit - credit) AS DOUBLE) AS value FROM classified WHERE category NOT IN ('Opening Balance', 'Closing Balance', 'Inter-Account / Treasury Transfer', 'Unallocated') GROUP BY 1 HAVING sum(debit - credit) > 0 ORDER BY sum(debit - credit) DESC, category LIMIT 8")
def _(spark, sf_dir):
    return plain(summary.top_net_expenses(classified(spark, sf_dir)))


@query("agg_11_income_and_expense", f"WITH {CLASSIFIED_SQL} SELECT category, CAST(sum(credit) FILTER (credit <> 0) AS DOUBLE) AS income, CAST(sum(debit) FILTER (debit <> 0) AS DOUBLE) AS expense FROM classified GROUP BY 1")
def _(spark, sf_dir):
    return plain(summary.income_and_expense(classified(spark, sf_dir)))


@query("agg_12_workspace_counters", f"WITH {_T} SELECT stmt_id, count(*) AS total, count(*) FILTER (decision_source = 'RULE') AS rule, count(*) FILTER (decision_source = 'AI') AS ai, count(*) FILTER (decision_source = 'MANUAL') AS manual, count(*) FILTER (review_required OR confidence_label = 'Low') AS review FROM templated GROUP BY 1")
def _(spark, sf_dir):
    return summary.workspace_counters(templated(spark, sf_dir), ["stmt_id"])


@query("agg_13_statement_overview", f"""WITH {VALID_SQL}, {CLASSIFIED_SQL.split(LEDGER_SQL + ',', 1)[1]}, {AUDIT_SQL}, fl AS (SELECT c.*, CASE WHEN g.row_seq IS NOT NULL THEN 'anomaly' WHEN category = 'Review Required' OR confidence < 0.7 THEN 'review' ELSE 'ok' END AS flag FROM classified c LEFT JOIN gaps g ON c.stmt_id = g.stmt_id AND c.row_seq = g.row_seq),
o AS (SELECT stmt_id, sum(debit) AS d, sum(credit) AS c, count(*) AS transaction_count, count(*) FILTER (flag = 'review') AS reviews, count(*) FILTER (flag = 'anomaly') AS anomalies FROM fl GROUP BY 1)
SELECT o.stmt_id, CAST(opening_balance AS DOUBLE) AS opening, CAST(closing_balance AS DOUBLE) AS closing, CAST(coalesce(statement_total_debit, o.d) AS DOUBLE) AS total_debits, CAST(coalesce(statement_total_credit, o.c) AS DOUBLE) AS total_credits, transaction_count, anomalies, reviews, CASE WHEN totals_match THEN 'Passed' WHEN NOT totals_match THEN 'Failed' ELSE 'Unverified' END AS check_status
FROM o JOIN statement_meta USING (stmt_id) JOIN verdicts USING (stmt_id)""")
def _(spark, sf_dir):
    gaps = chain.balance_audit(ledger(spark, sf_dir))
    flagged = review.flag_rows(classified(spark, sf_dir), gaps)
    return plain(summary.statement_overview(flagged, statement_meta(spark, sf_dir), verdicts(spark, sf_dir), gaps))


@query("agg_14_result_mapping", f"WITH {VALID_SQL}, x AS (SELECT stmt_id, status, coalesce(n, 0) = 0 OR totals_match = false OR (totals_match IS NOT true AND (contains(lower(status), 'mismatch') OR contains(lower(status), 'no transactions extracted'))) AS f FROM verdicts) SELECT stmt_id, coalesce(f, false) AS reconciliation_failed, CASE WHEN f THEN status END AS warning FROM x")
def _(spark, sf_dir):
    counts = _mixed(spark, sf_dir).groupBy("stmt_id").agg(F.count("*").alias("n_rows"))
    return summary.result_mapping(verdicts(spark, sf_dir), counts)


@query("agg_15_out_of_scope_credits", f"WITH {_T} SELECT stmt_id, CAST(coalesce(sum(credit) FILTER ((category = 'Out of Scope' OR debit = 0) AND credit > 0), 0) AS DOUBLE) AS out_of_scope_credit FROM templated GROUP BY 1")
def _(spark, sf_dir):
    return plain(summary.out_of_scope_credits(templated(spark, sf_dir)))


@query("agg_16_empty_description_gate", f"WITH {LEDGER_SQL} SELECT stmt_id, count(*) FILTER (event_id % 4 = 0) AS n_empty, count(*) AS n, count(*) FILTER (event_id % 4 = 0) / count(*) > 0.25 AS retry FROM ledger GROUP BY 1")
def _(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("narration", F.when(F.col("event_id") % 4 != 0, F.col("narration")))
    return summary.empty_description_gate(rows)


@query("agg_17_regression", f"""WITH {LEDGER_SQL}, {META_SQL}, a AS (SELECT stmt_id, count(*) AS n, sum(debit) AS d, sum(credit) AS c, max_by(balance, row_seq) AS lb FROM ledger WHERE stmt_id % 11 <> 0 GROUP BY 1),
e AS (SELECT stmt_id, count(*) + CASE WHEN stmt_id % 3 = 0 THEN 1 ELSE 0 END AS ec, sum(true_debit) AS ed, sum(true_credit) AS ecr, max_by(true_balance, row_seq) AS ecl FROM true_ledger GROUP BY 1),
x AS (SELECT e.*, a.n, array_to_string(list_filter([CASE WHEN n <> ec THEN printf('count expected %d, got %d', ec, n) END, CASE WHEN abs(d - ed) > 0.01 THEN printf('debit expected %.2f, got %.2f', CAST(ed AS DOUBLE), CAST(d AS DOUBLE)) END, CASE WHEN abs(c - ecr) > 0.01 THEN printf('credit expected %.2f, got %.2f', CAST(ecr AS DOUBLE), CAST(c AS DOUBLE)) END,
 CASE WHEN abs(lb - ecl) > 0.01 THEN printf('closing expected %.2f, got %.2f', CAST(ecl AS DOUBLE), CAST(lb AS DOUBLE)) END], lambda s: s IS NOT NULL), '; ') AS errors FROM e LEFT JOIN a USING (stmt_id))
SELECT stmt_id, CASE WHEN n IS NULL THEN 'SKIP' WHEN errors = '' THEN 'PASS' ELSE 'FAIL' END AS result, CASE WHEN n IS NULL THEN 'nothing extracted' ELSE errors END AS reasons FROM x""")
def _(spark, sf_dir):
    from ledgerflow.plans.fixtures import true_ledger

    got = ledger(spark, sf_dir).where("stmt_id % 11 <> 0").groupBy("stmt_id").agg(F.count("*").alias("n"), F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.max_by("balance", "row_seq").alias("last_balance"))
    want = true_ledger(spark, sf_dir).groupBy("stmt_id").agg((F.count("*") + F.when(F.first("stmt_id") % 3 == 0, 1).otherwise(0)).alias("expected_count"), F.sum("true_debit").alias("expected_debit"), F.sum("true_credit").alias("expected_credit"), F.max_by("true_balance", "row_seq").alias("expected_closing"), F.lit("0.01").cast("decimal(18,2)").alias("tolerance"))
    return summary.regression(got, want)


@query("agg_18_audit_lines", f"WITH {CLASSIFIED_SQL} SELECT stmt_id, row_seq, CAST(txn_date AS VARCHAR) || ' | ' || format('{{:,.2f}}', CAST(CASE WHEN credit > 0 THEN credit ELSE -debit END AS DOUBLE)) || ' | ' || category || ' | ' || narration AS line FROM classified WHERE debit <> 0 OR credit <> 0")
def _(spark, sf_dir):
    return summary.audit_lines(classified(spark, sf_dir).where("debit <> 0 or credit <> 0")).select("stmt_id", "row_seq", "line")


# --- reports ---------------------------------------------------------------------------------------------------------


@query("snk_01_report_sheet", f"WITH {CLASSIFIED_SQL}, {META_SQL} SELECT account_no AS sheet, row_seq, CAST(txn_date AS VARCHAR) AS date, '' AS value_date, '' AS reference, CASE WHEN event_id % 3 = 0 THEN 'BR' ELSE narration END AS description, category, {_dbl('debit', 'credit', 'balance')} FROM classified JOIN statement_meta USING (stmt_id)")
def _(spark, sf_dir):
    n = F.col("event_id") % 3
    rows = classified(spark, sf_dir).withColumns({"description": F.when(n == 1, F.concat("narration", F.lit("\x07"))).otherwise(" "), "remarks": F.when(n == 2, F.col("narration")), "branch": F.lit("BR"), "value_date": F.lit(None).cast("string"), "reference": F.lit(None).cast("string")})
    return plain(sinks.report_sheet(rows, statement_meta(spark, sf_dir)))


@query("snk_02_summary_block", f"WITH {VALID_SQL} SELECT stmt_id, account_no, CAST(v.d AS DOUBLE) AS total_debit, CAST(v.c AS DOUBLE) AS total_credit, status FROM verdicts v JOIN statement_meta USING (stmt_id)")
def _(spark, sf_dir):
    return plain(sinks.summary_block(_mixed(spark, sf_dir), verdicts(spark, sf_dir), statement_meta(spark, sf_dir)))


@query("snk_03_audit_sheet", f"WITH {LEDGER_SQL}, {AUDIT_SQL} SELECT stmt_id, page_no AS impacted_page, CAST(txn_date AS VARCHAR) AS date, narration AS description, CAST(expected AS DOUBLE) AS expected_balance, CAST(balance AS DOUBLE) AS extracted_balance, CAST(balance - expected AS DOUBLE) AS difference FROM audit WHERE abs(balance - expected) > 0.05")
def _(spark, sf_dir):
    return plain(sinks.audit_sheet(chain.balance_audit(ledger(spark, sf_dir))))


@query("snk_04_scrub", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq, narration || chr(9) || 'x' AS value FROM ledger")
def _(spark, sf_dir):
    return ledger(spark, sf_dir).select("stmt_id", "row_seq", sinks.scrub(F.concat("narration", F.lit("\x01\x0b\t\x1fx"))).alias("value"))


_BUNDLE = {
    "extracted_transactions": f"SELECT stmt_id, row_seq, CAST(txn_date AS VARCHAR) AS txn_date, page_no, {_dbl('debit', 'credit', 'balance')} FROM templated",
    "classified_transactions": "SELECT stmt_id, row_seq, category, tax_authority, confidence_label, decision_source, reason, CASE WHEN review_required THEN 'Yes' ELSE 'No' END AS review_required FROM templated",
    "category_summary": f"SELECT stmt_id, category, {_sums} FROM templated GROUP BY ALL",
    "monthly_summary": f"SELECT stmt_id, strftime(txn_date, '%Y-%m') AS month, category, {_sums} FROM templated GROUP BY ALL",
    "review_required": "SELECT stmt_id, row_seq, category, reason FROM templated WHERE review_required OR confidence_label = 'Low'",
    "reconciliation": f"SELECT stmt_id, {_dbl('opening', 'actual_closing')} FROM rec",
    "rules_used": "SELECT * FROM (VALUES ('FIRS', 90), ('Not Applicable', 100), ('SIRS', 40)) t(category, priority)",
}


def _bundle_query(name: str, columns: list[str], sql: str) -> None:
    ctes = f"{_T}, {META_SQL}, {_REC}" if name == "reconciliation" else _T

    @query(f"snk_05_{name}" if name != "rules_used" else "snk_06_rules_used", f"WITH {ctes} {sql}")
    def _(spark, sf_dir):
        sheets = sinks.bundle(templated(spark, sf_dir), templates.template_rows(spark, ALL["firs-sirs-na"]), statement_meta(spark, sf_dir))
        return plain(sheets[name], *columns)


for _name, _columns in (("extracted_transactions", ["stmt_id", "row_seq", "txn_date", "page_no", "debit", "credit", "balance"]), ("classified_transactions", ["stmt_id", "row_seq", "category", "tax_authority", "confidence_label", "decision_source", "reason", "review_required"]), ("category_summary", []), ("monthly_summary", []), ("review_required", ["stmt_id", "row_seq", "category", "reason"]), ("reconciliation", ["stmt_id", "opening", "actual_closing"])):
    _bundle_query(_name, _columns, _BUNDLE[_name])


@query("snk_07_ledger_with_notes", f"WITH {CLASSIFIED_SQL} SELECT stmt_id, row_seq, CASE WHEN is_reversal THEN '[REVERSAL] ' ELSE '' END || decision_source || coalesce(' (' || rule_id || ')', '') AS notes FROM classified")
def _(spark, sf_dir):
    return sinks.ledger_with_notes(classified(spark, sf_dir)).select("stmt_id", "row_seq", "notes")


@query("snk_08_metric_sheet", f"""WITH {CLASSIFIED_SQL}, g AS (SELECT stmt_id, min_by(balance + debit - credit, row_seq) AS o, max_by(balance, row_seq) AS z, sum(debit) AS d, sum(credit) AS c FROM classified GROUP BY 1), k AS (SELECT stmt_id, category, sum(credit) AS i, sum(debit) AS e FROM classified GROUP BY ALL)
SELECT stmt_id, 'Metric' AS block, unnest(['Opening Balance (Calc)', 'Closing Balance', 'Total Debits', 'Total Credits']) AS metric, unnest([CAST(o AS DOUBLE), CAST(z AS DOUBLE), CAST(d AS DOUBLE), CAST(c AS DOUBLE)]) AS value FROM g
UNION ALL SELECT stmt_id, 'Income by Category', category, CAST(i AS DOUBLE) FROM k WHERE i <> 0 UNION ALL SELECT stmt_id, 'Expenses by Category', category, CAST(e AS DOUBLE) FROM k WHERE e <> 0""")
def _(spark, sf_dir):
    return plain(sinks.metric_sheet(classified(spark, sf_dir)))


# --- selection -------------------------------------------------------------------------------------------------------


@query("ord_02_top_categories", f"WITH {CLASSIFIED_SQL} SELECT category, {_sums} FROM classified GROUP BY 1 ORDER BY abs(sum(credit - debit)) DESC, category LIMIT 8")
def _(spark, sf_dir):
    return plain(select.top_k(summary.category_summary(classified(spark, sf_dir)), "net_movement", "category"))


@query("ord_03_distinct_rows", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq, {_dbl('debit', 'credit')} FROM ledger QUALIFY row_number() OVER (PARTITION BY stmt_id, txn_date, narration, debit, credit, balance ORDER BY row_seq) = 1")
def _(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    doubled = rows.unionByName(rows.where("event_id % 61 = 0").withColumn("row_seq", F.col("row_seq") + 100_000))
    return plain(select.distinct_rows(doubled, ["txn_date", "narration", "debit", "credit", "balance"]), "stmt_id", "row_seq", "debit", "credit")


@query("ord_04_ordered_unique", f"WITH {LEDGER_SQL}, {AUDIT_SQL} SELECT stmt_id, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY f) AS pages FROM (SELECT stmt_id, page_no, min(row_seq) AS f FROM gaps GROUP BY ALL) GROUP BY 1")
def _(spark, sf_dir):
    g = chain.balance_audit(ledger(spark, sf_dir)).groupBy("stmt_id").agg(F.array_sort(F.collect_list(F.struct("row_seq", "page_no"))).alias("x"))
    return g.select("stmt_id", F.array_join(F.transform(select.ordered_unique(F.transform("x", lambda s: s["page_no"])), lambda p: p.cast("string")), ",").alias("pages"))


def _candidates(spark, sf_dir) -> DataFrame:
    """Three extractions per statement: the ledger, the same without its last rows, and the true one for some statements."""
    from ledgerflow.plans.fixtures import true_ledger

    good = true_ledger(spark, sf_dir).select("stmt_id", "row_seq", F.col("true_debit").alias("debit"), F.col("true_credit").alias("credit"), F.col("true_balance").alias("balance"))
    rows = ledger(spark, sf_dir).select(*good.columns)
    every = select.concatenate([rows.withColumn("candidate", F.lit(0)), rows.where("row_seq <= 40").withColumn("candidate", F.lit(1)), good.where("stmt_id % 3 = 0").withColumn("candidate", F.lit(2))])
    g = every.groupBy("stmt_id", "candidate").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count("*").alias("n_rows")).join(statement_meta(spark, sf_dir), "stmt_id")
    g = g.withColumns({"debit_diff": F.col("d") - F.col("statement_total_debit"), "credit_diff": F.col("c") - F.col("statement_total_credit"), "has_totals": F.col("statement_total_debit").isNotNull()})
    return g.withColumn("totals_match", (F.abs("debit_diff") <= 0.5) & (F.abs("credit_diff") <= 0.5))


_CAND = f"""{LEDGER_SQL}, {META_SQL}, ca AS (SELECT stmt_id, debit, credit, 0 AS candidate FROM ledger UNION ALL SELECT stmt_id, debit, credit, 1 FROM ledger WHERE row_seq <= 40 UNION ALL SELECT stmt_id, true_debit, true_credit, 2 FROM true_ledger WHERE stmt_id % 3 = 0),
cb AS (SELECT stmt_id, candidate, count(*) AS n, abs(sum(debit) - any_value(statement_total_debit)) + abs(sum(credit) - any_value(statement_total_credit)) AS off, coalesce(abs(sum(debit) - any_value(statement_total_debit)) <= 0.5 AND abs(sum(credit) - any_value(statement_total_credit)) <= 0.5, false) AS ok FROM ca JOIN statement_meta USING (stmt_id) GROUP BY ALL)"""
_CHOICES = {
    "ord_05_best_candidate": (select.best_candidate, "SELECT stmt_id, candidate FROM cb QUALIFY row_number() OVER (PARTITION BY stmt_id ORDER BY ok DESC, n DESC, candidate) = 1"),
    "ord_06_nearest_totals": (select.nearest_totals, "SELECT stmt_id, CASE WHEN max(off) FILTER (candidate = 0) IS NULL THEN arg_max(candidate, n * 10 - candidate) WHEN min(off) + 0.01 < max(off) FILTER (candidate = 0) THEN arg_min(candidate, off) ELSE 0 END AS candidate FROM cb GROUP BY 1"),
    "ord_07_cascade": (select.cascade, "SELECT stmt_id, coalesce(min(candidate) FILTER (ok), arg_max(candidate, n * 10 - candidate)) AS candidate FROM cb GROUP BY 1"),
    "ord_08_accept_if_more": (select.accept_if_more, "SELECT stmt_id, CASE WHEN coalesce(max(n) FILTER (candidate = 1), 0) > coalesce(max(n) FILTER (candidate = 0), 0) THEN 1 ELSE 0 END AS candidate FROM cb GROUP BY 1"),
}


def _choice_query(name: str, f, sql: str) -> None:
    @query(name, f"WITH {_CAND} {sql}")
    def _(spark, sf_dir):
        return f(_candidates(spark, sf_dir))


for _name, (_f, _sql) in _CHOICES.items():
    _choice_query(_name, _f, _sql)


@query("ord_09_batches", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq, CAST((row_seq - 1) // 35 AS INT) AS batch FROM ledger")
def _(spark, sf_dir):
    return select.batches(ledger(spark, sf_dir)).select("stmt_id", "row_seq", "batch")


@query("ord_09_text_chunks", """WITH RECURSIVE p AS (SELECT doc_id // 50 AS file_id, CAST(doc_id % 50 AS INT) AS page_no, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id % 50) AS k FROM documents),
f AS (SELECT file_id, page_no, n AS used, 0 AS chunk, k FROM p WHERE k = 1
UNION ALL SELECT p.file_id, p.page_no, CASE WHEN f.used > 0 AND f.used + p.n > 20000 THEN p.n ELSE f.used + p.n END, f.chunk + CASE WHEN f.used > 0 AND f.used + p.n > 20000 THEN 1 ELSE 0 END, p.k FROM f JOIN p ON p.file_id = f.file_id AND p.k = f.k + 1)
SELECT file_id, page_no, chunk FROM f""")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return select.text_chunks(docs.select(F.floor(F.col("doc_id") / 50).cast("long").alias("file_id"), (F.col("doc_id") % 50).cast("int").alias("page_no"), "text"), 20_000)


@query("set_01_concatenate", f"WITH {CLASSIFIED_SQL} SELECT category, count(*) AS n FROM (SELECT category FROM classified UNION ALL SELECT category FROM classified WHERE stmt_id % 2 = 0) GROUP BY 1")
def _(spark, sf_dir):
    rows = classified(spark, sf_dir).select("stmt_id", "category")
    return select.concatenate([rows, rows.where("stmt_id % 2 = 0")]).groupBy("category").agg(F.count("*").alias("n"))


@query("set_02_vocabulary", f"WITH {CLASSIFIED_SQL} SELECT DISTINCT label FROM (SELECT category AS label FROM classified UNION ALL SELECT narration FROM ledger UNION ALL SELECT 'Out of Scope')")
def _(spark, sf_dir):
    a = classified(spark, sf_dir).select("category", F.col("row_seq").alias("place"))
    b = ledger(spark, sf_dir).select("narration", "row_seq")
    return select.vocabulary([a, b, spark.createDataFrame([("Out of Scope", 0), ("", 1)], "label string, place long")]).select("label")
