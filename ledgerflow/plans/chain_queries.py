"""Queries of the chain operators over the derived ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import chain
from ledgerflow.plans.fixtures import LEDGER_SQL, META_SQL, ledger, statement_meta
from ledgerflow.plans.registry import query


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; decimals as doubles, dates as text."""
    df = df.select(*columns) if columns else df
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


_w = "OVER (PARTITION BY stmt_id ORDER BY row_seq)"
_wp = "OVER (PARTITION BY stmt_id ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_wn = "OVER (PARTITION BY stmt_id ORDER BY row_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_pb = f"last_value(nullif(balance, 0) IGNORE NULLS) {_wp}"
_dc = "CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit"
AUDIT_SQL = f"""audit AS (SELECT *, CAST(coalesce(lag(balance) {_w}, opening, balance - credit + debit) + credit - debit AS DECIMAL(18,2)) AS expected FROM ledger),
gaps AS (SELECT stmt_id, row_seq, page_no, expected, balance, balance - expected AS diff FROM audit WHERE abs(balance - expected) > 0.05)"""


@query("chn_01_balance_audit", f"WITH {LEDGER_SQL}, {AUDIT_SQL} SELECT stmt_id, row_seq, page_no, CAST(expected AS DOUBLE) AS expected, CAST(balance AS DOUBLE) AS balance, CAST(diff AS DOUBLE) AS diff FROM gaps")
def _(spark, sf_dir):
    return plain(chain.balance_audit(ledger(spark, sf_dir)), "stmt_id", "row_seq", "page_no", "expected", "balance", "diff")


@query("chn_02_failed_pages", f"WITH {LEDGER_SQL}, {AUDIT_SQL} SELECT stmt_id, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS failed_pages FROM (SELECT DISTINCT stmt_id, page_no FROM gaps) GROUP BY stmt_id")
def _(spark, sf_dir):
    out = chain.failed_pages(chain.balance_audit(ledger(spark, sf_dir)))
    return out.select("stmt_id", F.array_join(F.transform("failed_pages", lambda p: p.cast("string")), ",").alias("failed_pages"))


@query("chn_03_statement_audit", f"""WITH {LEDGER_SQL}, {META_SQL}, {AUDIT_SQL},
t AS (SELECT l.stmt_id, sum(debit) - coalesce(any_value(statement_total_debit), 0) AS dd, sum(credit) - coalesce(any_value(statement_total_credit), 0) AS cd FROM ledger l JOIN statement_meta m USING (stmt_id) GROUP BY l.stmt_id)
SELECT stmt_id, CAST(dd AS DOUBLE) AS debit_diff, CAST(cd AS DOUBLE) AS credit_diff, coalesce(n, 0) AS n_gaps, abs(dd) < 0.1 AS debit_match, abs(cd) < 0.1 AS credit_match, abs(dd) < 0.1 AND abs(cd) < 0.1 AND coalesce(n, 0) = 0 AS is_perfect
FROM t LEFT JOIN (SELECT stmt_id, count(*) AS n FROM gaps GROUP BY stmt_id) USING (stmt_id)""")
def _(spark, sf_dir):
    return plain(chain.statement_audit(ledger(spark, sf_dir), statement_meta(spark, sf_dir)))


@query("chn_04_reconcile_rows", f"""WITH {LEDGER_SQL}, x AS (SELECT *, lag(balance) {_w} AS prev FROM ledger),
y AS (SELECT *, coalesce(abs(balance - prev - credit + debit) > 0.01, false) AS off, abs(debit) < 0.01 AND abs(credit) < 0.01 AS empty FROM x)
SELECT stmt_id, row_seq, CAST(CASE WHEN off AND empty AND prev - balance > 0.01 THEN prev - balance ELSE debit END AS DOUBLE) AS debit,
CAST(CASE WHEN off AND empty AND prev - balance < -0.01 THEN balance - prev ELSE credit END AS DOUBLE) AS credit, off AND NOT (empty AND abs(prev - balance) > 0.01) AS reconciliation_error FROM y""")
def _(spark, sf_dir):
    return plain(chain.reconcile_rows(ledger(spark, sf_dir)), "stmt_id", "row_seq", "debit", "credit", "reconciliation_error")


@query("chn_05_consecutive_issues", f"""WITH {LEDGER_SQL}, x AS (SELECT *, lag(balance) {_w} + credit - debit AS e, row_number() {_w} AS n FROM ledger)
SELECT stmt_id, CAST(sum(debit) AS DOUBLE) AS total_debit, CAST(sum(credit) AS DOUBLE) AS total_credit, count(*) FILTER (abs(e - balance) > 0.01) = 0 AS is_valid,
coalesce(string_agg(printf('Row %d: Balance mismatch. Expected ~%.2f, got %.2f', n, CAST(e AS DOUBLE), CAST(balance AS DOUBLE)), '; ' ORDER BY row_seq) FILTER (abs(e - balance) > 0.01), '') AS issues FROM x GROUP BY stmt_id""")
def _(spark, sf_dir):
    return plain(chain.consecutive_issues(ledger(spark, sf_dir)).withColumn("issues", F.array_join("issues", "; ")))


@query("chn_06_row_status", f"""WITH {LEDGER_SQL}, x AS (SELECT *, abs(coalesce({_pb}, nullif(opening, 0)) + credit - debit - nullif(balance, 0)) AS off FROM ledger)
SELECT stmt_id, row_seq, CASE WHEN off IS NULL THEN 'Pending' WHEN off <= 0.02 THEN 'Success' ELSE 'Anomaly' END AS status FROM x""")
def _(spark, sf_dir):
    return chain.row_status(ledger(spark, sf_dir)).select("stmt_id", "row_seq", "status")


@query("chn_07_drop_static_rows", f"""WITH {LEDGER_SQL}, a AS (SELECT * FROM ledger WHERE NOT (balance = 0 AND greatest(debit, credit) >= 1000 AND regexp_matches(upper(narration), 'STAMP DUTY CHARGE|ELECTRONIC MONEY TRANSFER LEVY'))),
b AS (SELECT *, lag(balance) {_w} AS prev FROM a)
SELECT stmt_id, row_seq, {_dc} FROM b WHERE NOT coalesce(((debit > 0 AND credit = 0) OR (credit > 0 AND debit = 0)) AND balance <> 0 AND prev <> 0 AND abs(balance - prev) <= 0.01, false)""")
def _(spark, sf_dir):
    return plain(chain.drop_static_rows(ledger(spark, sf_dir)), "stmt_id", "row_seq", "debit", "credit")


@query("chn_08_repair_amounts", f"""WITH {LEDGER_SQL}, x AS (SELECT *, CASE WHEN balance <> 0 THEN balance - ({_pb} + credit - debit) END AS gap FROM ledger)
SELECT stmt_id, row_seq, CAST(CASE WHEN abs(gap) > 0.02 AND debit > 0 AND credit = 0 AND gap < 0 AND abs(gap) <= 1000 THEN debit - gap ELSE debit END AS DOUBLE) AS debit,
CAST(CASE WHEN abs(gap) > 0.02 AND debit > 0 AND credit > 0 AND abs(gap + credit) <= 0.02 THEN 0 WHEN abs(gap) > 0.02 AND credit > 0 AND debit = 0 AND gap > 0 AND abs(gap) <= 1000 THEN credit + gap ELSE credit END AS DOUBLE) AS credit FROM x""")
def _(spark, sf_dir):
    return plain(chain.repair_amounts(ledger(spark, sf_dir)), "stmt_id", "row_seq", "debit", "credit")


@query("chn_09_swap_and_snap", f"""WITH {LEDGER_SQL}, x AS (SELECT *, CASE WHEN balance <> 0 THEN balance - {_pb} END AS m FROM ledger),
k AS (SELECT *, CASE WHEN m IS NULL OR abs(m) <= 1 THEN 'keep'
  WHEN debit > 0 AND credit = 0 THEN CASE WHEN abs(m + debit) <= 1 THEN 'keep' WHEN abs(m - debit) <= 1 THEN 'swap' ELSE 'size_d' END
  WHEN credit > 0 AND debit = 0 THEN CASE WHEN abs(m - credit) <= 1 THEN 'keep' WHEN abs(m + credit) <= 1 THEN 'swap' ELSE 'size_c' END
  WHEN debit > 0 AND credit > 0 THEN CASE WHEN abs(m + debit) <= 1 AND abs(m - credit) > 1 THEN 'only_d' WHEN abs(m - credit) <= 1 AND abs(m + debit) > 1 THEN 'only_c' ELSE 'build' END
  WHEN debit = 0 AND credit = 0 THEN 'build' ELSE 'keep' END AS what FROM x)
SELECT stmt_id, row_seq,
CAST(CASE what WHEN 'swap' THEN credit WHEN 'size_d' THEN abs(m) WHEN 'only_c' THEN 0 WHEN 'build' THEN CASE WHEN m < 0 THEN -m ELSE 0 END ELSE debit END AS DOUBLE) AS debit,
CAST(CASE what WHEN 'swap' THEN debit WHEN 'size_c' THEN abs(m) WHEN 'only_d' THEN 0 WHEN 'build' THEN CASE WHEN m < 0 THEN 0 ELSE m END ELSE credit END AS DOUBLE) AS credit FROM k""")
def _(spark, sf_dir):
    return plain(chain.swap_and_snap(ledger(spark, sf_dir)), "stmt_id", "row_seq", "debit", "credit")


@query("chn_10_fill_missing_movement", f"""WITH {LEDGER_SQL}, x AS (SELECT *, CASE WHEN debit = 0 AND credit = 0 THEN nullif(balance, 0) - coalesce({_pb}, nullif(opening, 0)) END AS m FROM ledger)
SELECT stmt_id, row_seq, CAST(CASE WHEN m < 0 THEN -m ELSE debit END AS DOUBLE) AS debit, CAST(CASE WHEN m > 0 THEN m ELSE credit END AS DOUBLE) AS credit FROM x""")
def _(spark, sf_dir):
    return plain(chain.fill_missing_movement(ledger(spark, sf_dir)), "stmt_id", "row_seq", "debit", "credit")


@query("chn_11_movement_override", f"""WITH {LEDGER_SQL}, x AS (SELECT *, balance - lag(balance) {_w} AS m FROM ledger WHERE balance <> 0),
y AS (SELECT *, coalesce(m <> 0 AND ((debit + credit <> 0 AND abs(m - credit + debit) > 0.01) OR debit + credit = 0), false) AS wrong FROM x),
z AS (SELECT stmt_id, row_seq, CASE WHEN wrong THEN greatest(-m, 0) ELSE debit END AS debit, CASE WHEN wrong THEN greatest(m, 0) ELSE credit END AS credit FROM y)
SELECT stmt_id, row_seq, {_dc} FROM z WHERE debit <> 0 OR credit <> 0""")
def _(spark, sf_dir):
    return plain(chain.movement_override(ledger(spark, sf_dir)), "stmt_id", "row_seq", "debit", "credit")


@query("chn_12_flip_in_segments", f"""WITH {LEDGER_SQL}, s AS (SELECT *, count(nullif(balance, 0)) {_wp} AS seg, {_pb} AS b0 FROM ledger),
t AS (SELECT *, max(nullif(balance, 0)) OVER (PARTITION BY stmt_id, seg) - b0 - sum(credit - debit) OVER (PARTITION BY stmt_id, seg) AS short FROM s),
f AS (SELECT *, CASE WHEN seg > 0 AND short <> 0 AND debit > 0 AND 2 * debit = short THEN 'c' WHEN seg > 0 AND short <> 0 AND credit > 0 AND -2 * credit = short THEN 'd' END AS flip FROM t),
g AS (SELECT *, flip IS NOT NULL AND row_seq = min(CASE WHEN flip IS NOT NULL THEN row_seq END) OVER (PARTITION BY stmt_id, seg) AS first FROM f)
SELECT stmt_id, row_seq, CAST(CASE WHEN first THEN CASE flip WHEN 'c' THEN 0 ELSE credit END ELSE debit END AS DOUBLE) AS debit,
CAST(CASE WHEN first THEN CASE flip WHEN 'c' THEN debit ELSE 0 END ELSE credit END AS DOUBLE) AS credit FROM g""")
def _(spark, sf_dir):
    return plain(chain.flip_in_segments(ledger(spark, sf_dir)), "stmt_id", "row_seq", "debit", "credit")


def _infer_sql(first: str, second: str) -> str:
    return f"""WITH {LEDGER_SQL}, c AS (SELECT *, nullif(balance, 0) AS b, sum(credit - debit) {_w} AS cum FROM ledger),
k AS (SELECT *, last_value(b IGNORE NULLS) {_wp} + cum - last_value(CASE WHEN b IS NOT NULL THEN cum END IGNORE NULLS) {_wp} AS fwd,
  first_value(b IGNORE NULLS) {_wn} - first_value(CASE WHEN b IS NOT NULL THEN cum END IGNORE NULLS) {_wn} + cum AS bwd FROM c)
SELECT stmt_id, row_seq, CAST(coalesce(b, {first}, {second}, 0) AS DOUBLE) AS balance FROM k"""


@query("chn_13_infer_balances_forward", _infer_sql("fwd", "bwd"))
def _(spark, sf_dir):
    return plain(chain.infer_balances(ledger(spark, sf_dir)), "stmt_id", "row_seq", "balance")


@query("chn_14_infer_balances_backward", _infer_sql("bwd", "fwd"))
def _(spark, sf_dir):
    return plain(chain.infer_balances(ledger(spark, sf_dir), backward_first=True), "stmt_id", "row_seq", "balance")


_digits = "regexp_replace(CAST(balance AS VARCHAR), '[^0-9]', '', 'g')"


@query("chn_15_mend_truncated_balances", f"""WITH RECURSIVE {LEDGER_SQL}, p AS (SELECT stmt_id, row_seq, debit, credit, opening, CASE WHEN event_id % 13 = 0 THEN left({_digits}, length({_digits}) - 1) ELSE {_digits} END AS printed, CAST(CASE WHEN event_id % 13 = 0 THEN floor(balance) ELSE balance END AS DECIMAL(18,2)) AS balance FROM ledger),
f AS (SELECT stmt_id, CAST(0 AS BIGINT) AS row_seq, min_by(opening, row_seq) AS prev, CAST(NULL AS DECIMAL(18,2)) AS balance FROM p GROUP BY stmt_id
UNION ALL SELECT stmt_id, row_seq, CAST(CASE WHEN mend THEN expected WHEN balance <> 0 THEN balance ELSE prev END AS DECIMAL(18,2)), CAST(CASE WHEN mend THEN expected ELSE balance END AS DECIMAL(18,2))
 FROM (SELECT *, balance <> 0 AND ((length(printed) >= 6 AND length(printed) < length(want) AND starts_with(want, printed)) OR (floor(abs(balance)) = floor(abs(expected)) AND abs(balance - expected) <= 1)) AS mend
 FROM (SELECT p.*, f.prev, CAST(f.prev - p.debit + p.credit AS DECIMAL(18,2)) AS expected, regexp_replace(CAST(CAST(f.prev - p.debit + p.credit AS DECIMAL(18,2)) AS VARCHAR), '[^0-9]', '', 'g') AS want FROM f JOIN p ON p.stmt_id = f.stmt_id AND p.row_seq = f.row_seq + 1)))
SELECT stmt_id, row_seq, CAST(balance AS DOUBLE) AS balance FROM f WHERE row_seq > 0""")
def _(spark, sf_dir):
    cut = F.expr("CASE WHEN event_id % 13 = 0 THEN left(regexp_replace(cast(balance AS string), '[^0-9]', ''), length(regexp_replace(cast(balance AS string), '[^0-9]', '')) - 1) ELSE cast(balance AS string) END")
    rows = ledger(spark, sf_dir).withColumn("raw_balance", cut).withColumn("balance", F.when(F.col("event_id") % 13 == 0, F.expr("cast(floor(balance) AS decimal(18,2))")).otherwise(F.col("balance")))
    return plain(chain.mend_truncated_balances(rows), "stmt_id", "row_seq", "balance")


@query("chn_16_insert_chain_adjustments", f"""WITH {LEDGER_SQL}, x AS (SELECT *, {_pb} AS prev FROM ledger), y AS (SELECT *, CASE WHEN balance <> 0 THEN balance - (prev + credit - debit) END AS gap FROM x)
SELECT stmt_id, 2 * row_seq AS row_seq, {_dc}, CAST(balance AS DOUBLE) AS balance, false AS is_inferred FROM y
UNION ALL SELECT stmt_id, 2 * row_seq - 1, CAST(greatest(-gap, 0) AS DOUBLE), CAST(greatest(gap, 0) AS DOUBLE), CAST(prev + gap AS DOUBLE), true FROM y WHERE abs(gap) >= 400""")
def _(spark, sf_dir):
    return plain(chain.insert_chain_adjustments(ledger(spark, sf_dir), least=400), "stmt_id", "row_seq", "debit", "credit", "balance", "is_inferred")


#: The ledger as printed but for statements that lost their last row, which is what the adjustment rows are for.
def _short(spark, sf_dir) -> DataFrame:
    rows = ledger(spark, sf_dir).drop("debit", "credit", "balance")
    from ledgerflow.plans.fixtures import true_ledger

    true = true_ledger(spark, sf_dir).select("stmt_id", "row_seq", F.col("true_debit").alias("debit"), F.col("true_credit").alias("credit"), F.col("true_balance").alias("balance"))
    last = true.groupBy("stmt_id").agg(F.max("row_seq").alias("last_seq"))
    return rows.join(true, ["stmt_id", "row_seq"]).join(last, "stmt_id").where((F.col("stmt_id") % 2 == 1) | (F.col("row_seq") < F.col("last_seq"))).drop("last_seq")


_TOTALS = f"""WITH {LEDGER_SQL}, {META_SQL}, ends AS (SELECT stmt_id, max(row_seq) AS z FROM true_ledger GROUP BY stmt_id),
short AS (SELECT t.* FROM true_ledger t JOIN ends USING (stmt_id) WHERE stmt_id % 2 = 1 OR row_seq < z),
g AS (SELECT s.stmt_id, max(row_seq) + 1 AS row_seq, max_by(txn_date, row_seq) AS txn_date, max_by(true_balance, row_seq) AS lb, sum(true_debit) AS d, sum(true_credit) AS c FROM short s GROUP BY s.stmt_id),
h AS (SELECT g.*, m.* EXCLUDE (stmt_id), statement_total_debit - d AS dg, statement_total_credit - c AS cg FROM g JOIN statement_meta m USING (stmt_id))"""
_ADJ = "SELECT stmt_id, row_seq, CAST(txn_date AS VARCHAR) AS txn_date, CAST(a AS DOUBLE) AS debit, CAST(b AS DOUBLE) AS credit, CAST(bal AS DOUBLE) AS balance, ref AS reference FROM k WHERE a > 0 OR b > 0"


@query("chn_17_header_adjustment", f"""{_TOTALS}, j AS (SELECT *, dg > 0.01 AND abs(cg) <= 0.01 AND abs(dg - (lb - closing_balance)) <= 0.05 AS isd, cg > 0.01 AND abs(dg) <= 0.01 AND abs(cg + lb - closing_balance) <= 0.05 AS isc FROM h),
k AS (SELECT *, CASE WHEN isd THEN dg ELSE 0 END AS a, CASE WHEN isc AND NOT isd THEN cg ELSE 0 END AS b, closing_balance AS bal, 'INFERRED_HEADER_ADJUSTMENT' AS ref FROM j) {_ADJ}""")
def _(spark, sf_dir):
    return plain(chain.header_adjustment(_short(spark, sf_dir), statement_meta(spark, sf_dir)))


@query("chn_18_rounding_adjustment", f"""{_TOTALS}, j AS (SELECT *, dg BETWEEN 0.01 AND 1 AND abs(cg) <= 0.01 AS isd, cg BETWEEN 0.01 AND 1 AND abs(dg) <= 0.01 AS isc FROM h),
i AS (SELECT *, CASE WHEN isd THEN dg ELSE 0 END AS a, CASE WHEN isc AND NOT isd THEN cg ELSE 0 END AS b, 'INFERRED_ROUNDING_ADJUSTMENT' AS ref FROM j), k AS (SELECT *, lb - a + b AS bal FROM i) {_ADJ}""")
def _(spark, sf_dir):
    return plain(chain.rounding_adjustment(_short(spark, sf_dir), statement_meta(spark, sf_dir)))


def _both_sides_short(spark, sf_dir) -> DataFrame:
    """Printed totals with the same amount missing on both sides for every third statement."""
    extra = F.when(F.col("stmt_id") % 3 == 0, 12.5).otherwise(0).cast("decimal(18,2)")
    cap = lambda c: (F.col(c) + extra).cast("decimal(18,2)").alias(c)
    m = statement_meta(spark, sf_dir)
    return m.select(*[cap(c) if c.startswith("statement_total") else c for c in m.columns])


@query("chn_19_offsetting_adjustment", f"""{_TOTALS.replace("short AS (SELECT t.* FROM true_ledger t JOIN ends USING (stmt_id) WHERE stmt_id % 2 = 1 OR row_seq < z)", "short AS (SELECT * FROM true_ledger)")},
j AS (SELECT *, dg + CASE WHEN stmt_id % 3 = 0 THEN 12.5 ELSE 0 END AS x, cg + CASE WHEN stmt_id % 3 = 0 THEN 12.5 ELSE 0 END AS y FROM h),
k AS (SELECT *, CASE WHEN x > 0 AND abs(x - y) <= 0.02 THEN x ELSE 0 END AS a, CASE WHEN x > 0 AND abs(x - y) <= 0.02 THEN y ELSE 0 END AS b, lb AS bal, 'OFFSETTING_ADJUSTMENT' AS ref FROM j) {_ADJ}""")
def _(spark, sf_dir):
    from ledgerflow.plans.fixtures import true_ledger

    true = true_ledger(spark, sf_dir).select("stmt_id", "row_seq", "txn_date", F.col("true_debit").alias("debit"), F.col("true_credit").alias("credit"), F.col("true_balance").alias("balance"))
    return plain(chain.offsetting_adjustment(true, _both_sides_short(spark, sf_dir)))


@query("chn_20_discard_copied_total", f"""{_TOTALS}, j AS (SELECT *, CASE WHEN stmt_id % 4 = 1 THEN statement_total_credit ELSE statement_total_debit END AS td FROM h),
k AS (SELECT *, coalesce(abs(opening_balance + c - d - closing_balance) <= 1 AND abs(opening_balance + statement_total_credit - td - closing_balance) > 1 AND abs(td - statement_total_credit) <= 0.01 AND abs(td - d) > 1, false) AS gone FROM j)
SELECT stmt_id, CAST(CASE WHEN NOT gone THEN td END AS DOUBLE) AS statement_total_debit, CAST(statement_total_credit AS DOUBLE) AS statement_total_credit, gone AS debit_total_discarded FROM k""")
def _(spark, sf_dir):
    m = statement_meta(spark, sf_dir)
    m = m.withColumn("statement_total_debit", F.when(F.col("stmt_id") % 4 == 1, F.col("statement_total_credit")).otherwise(F.col("statement_total_debit")))
    return plain(chain.discard_copied_total(_short(spark, sf_dir), m))


@query("chn_21_discard_ocr_totals", f"""{_TOTALS}, k AS (SELECT *, coalesce(abs(dg) > 1 OR abs(cg) > 1, false) AS off FROM h)
SELECT stmt_id, CAST(CASE WHEN NOT off THEN statement_total_debit END AS DOUBLE) AS statement_total_debit, CAST(CASE WHEN NOT off THEN statement_total_credit END AS DOUBLE) AS statement_total_credit,
CAST(CASE WHEN off THEN statement_total_debit END AS DOUBLE) AS ocr_statement_total_debit, CAST(CASE WHEN off THEN statement_total_credit END AS DOUBLE) AS ocr_statement_total_credit, CAST(lb AS DOUBLE) AS closing_balance FROM k""")
def _(spark, sf_dir):
    return plain(chain.discard_ocr_totals(_short(spark, sf_dir), statement_meta(spark, sf_dir)))
