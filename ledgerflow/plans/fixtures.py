"""Ledgers derived from the given tables, in Spark and in DuckDB SQL, for queries, tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Narrations, one for each rule family, and the amounts that make amount rules fire.
NARRATIONS = [
    "NIP TRF TO ADE BAKERY LTD", "STAMP DUTY CHARGE", "NIP CHARGE", "SMS CHARGE MAY 2024", "COB TRF FEE", "SALARY MAY 2024", "PENSION PTAD ALLOWANCE", "UBER TRIP 8841", "REV TRF FAILED", "ACCOUNT MAINTENANCE FEE",
    "COB TRF TO DAMAC OIL", "POS PURCHASE SHOPRITE IKEJA", "OFFICE LAND L TD", "CREDIT INTEREST Q2", "TRANSFER BETWEEN CUSTOMERS VIA GTWORLD JOHN OKORO", "NIP FROM CHIOMA OBI", "DIESEL SUPPLY 0803", "VAT ON BANK CHARGE", "TRF TO MRS FOLA BELLO", "CASH WITHDRAWAL ATM 0011",
    "LOAN REPAYMENT FACILITY 77", "OPENING BALANCE", "STAFF LOAN ADVANCE TO STAFF", "TRAINING WORKSHOP LAGOS", "GENERATOR MAINTENANCE WORK", "SECURITY GUARD ESCORT", "IELTS EXAM FEE", "STATIONERY AND PRINTING", "LOCAL TRANSFERS OTHER BANKS/ZENITH/MUSA BELLO", "DSTV SUBSCRIPTION",
    "CHICKEN REPUBLIC LUNCH", "LAWYER RETAINER", "GAPS PAYMENT 2505123 TO KEMI STORES", "ELECTRONIC MONEY TRANSFER LEVY", "WEB PAYMENT INVOICE 4410 CUSTOMER", "HOTEL BOOKING ABUJA", "DIVIDEND RECEIVED", "OVERDRAFT INTEREST CHARGE", "PP REV 08031234567 TUNDE ALABI LIMITE", "CORPORATE SERVICES RENT 12345678901",
]
AMOUNTS = {1: "50.00", 2: "53.75", 3: "26.88", 4: "10.75"}
#: Bank names for statement metadata.
BANKS = ["access", "gtbank", "fcmb", "fidelity", "sterling", "wema", "zenith", "uba", "providus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own():
    """All windows of a ledger share this order, so that a statement is sorted once."""
    return W.partitionBy("stmt_id").orderBy("ts", "event_id")


def _timed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("stmt_id"), "event_type", "value")
    rows = e.withColumn("row_seq", F.row_number().over(_own()).cast("long"))
    amount = F.col("value").cast(MONEY)
    for k, v in AMOUNTS.items():
        amount = F.when(F.col("event_id") % 40 == k, F.lit(v).cast(MONEY)).otherwise(amount)
    outward = F.col("event_type").isin("purchase", "error")
    zero = F.lit(0).cast(MONEY)
    rows = rows.select(
        "ts", "stmt_id", "row_seq", "event_id", F.to_date("ts").alias("txn_date"), (F.floor((F.col("row_seq") - 1) / 20) + 1).cast("int").alias("page_no"),
        F.element_at(F.array(*map(F.lit, NARRATIONS)), (F.col("event_id") % 40 + 1).cast("int")).alias("narration"),
        (F.col("stmt_id") + 1000).cast(MONEY).alias("opening"), F.when(outward, amount).otherwise(zero).alias("true_debit"), F.when(outward, zero).otherwise(amount).alias("true_credit"),
    )
    moved = F.sum(F.col("true_credit") - F.col("true_debit")).over(_own().rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("true_balance", (F.col("opening") + moved).cast(MONEY))


def true_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement = user, rows in time order, running balance exact."""
    return _timed_ledger(spark, sf_dir).drop("ts")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true ledger with faults: swapped, doubled and blank amounts, missing and repeated balances."""
    n, zero = F.col("event_id"), F.lit(0).cast(MONEY)

    def faulty(this: str, other: str):
        v = F.when(n % 47 == 0, F.col(other)).otherwise(F.col(this))
        return F.when(n % 83 == 0, zero).when(n % 71 == 0, (v * 2).cast(MONEY)).otherwise(v).cast(MONEY)

    balance = F.when(n % 31 == 0, zero).when(n % 97 == 0, F.coalesce(F.lag("true_balance").over(_own()), "true_balance")).otherwise(F.col("true_balance"))
    return _timed_ledger(spark, sf_dir).select("stmt_id", "row_seq", "event_id", "txn_date", "page_no", "narration", "opening", faulty("true_debit", "true_credit").alias("debit"), faulty("true_credit", "true_debit").alias("credit"), balance.cast(MONEY).alias("balance"))


def statement_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed totals per statement: missing, slightly off, clearly off or exact."""
    off = F.when(F.col("stmt_id") % 5 == 1, F.lit("0.30")).when(F.col("stmt_id") % 5 == 2, F.lit("25.00")).otherwise(F.lit("0.00")).cast(MONEY)
    known = F.col("stmt_id") % 5 != 0
    g = true_ledger(spark, sf_dir).groupBy("stmt_id").agg(F.min("opening").alias("opening_balance"), F.max_by("true_balance", "row_seq").alias("closing_balance"), F.sum("true_debit").alias("d"), F.sum("true_credit").alias("c"))
    bank = F.element_at(F.array(*map(F.lit, BANKS)), (F.col("stmt_id") % 9 + 1).cast("int"))
    return g.select("stmt_id", bank.alias("bank"), F.lpad(F.col("stmt_id").cast("string"), 10, "0").alias("account_no"), "opening_balance", "closing_balance", F.when(known, (F.col("d") + off).cast(MONEY)).alias("statement_total_debit"), F.when(known, F.col("c").cast(MONEY)).alias("statement_total_credit"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_amount = "CASE event_id % 40 " + " ".join(f"WHEN {k} THEN CAST({v} AS DECIMAL(18,2))" for k, v in AMOUNTS.items()) + " ELSE CAST(value AS DECIMAL(18,2)) END"
LEDGER_SQL = f"""
ev AS (SELECT user_id AS stmt_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_seq, event_id, CAST(ts AS DATE) AS txn_date,
  {_list(NARRATIONS)}[event_id % 40 + 1] AS narration, CAST(user_id + 1000 AS DECIMAL(18,2)) AS opening, {_amount} AS amount, event_type IN ('purchase', 'error') AS outward FROM events),
true_ledger AS (SELECT stmt_id, row_seq, event_id, txn_date, CAST((row_seq - 1) // 20 + 1 AS INT) AS page_no, narration, opening,
  CASE WHEN outward THEN amount ELSE 0 END AS true_debit, CASE WHEN outward THEN 0 ELSE amount END AS true_credit,
  CAST(opening + sum(CASE WHEN outward THEN -amount ELSE amount END) OVER (PARTITION BY stmt_id ORDER BY row_seq) AS DECIMAL(18,2)) AS true_balance FROM ev),
ledger AS (SELECT stmt_id, row_seq, event_id, txn_date, page_no, narration, opening,
  CAST(CASE WHEN event_id % 83 = 0 THEN 0 ELSE (CASE WHEN event_id % 47 = 0 THEN true_credit ELSE true_debit END) * (CASE WHEN event_id % 71 = 0 THEN 2 ELSE 1 END) END AS DECIMAL(18,2)) AS debit,
  CAST(CASE WHEN event_id % 83 = 0 THEN 0 ELSE (CASE WHEN event_id % 47 = 0 THEN true_debit ELSE true_credit END) * (CASE WHEN event_id % 71 = 0 THEN 2 ELSE 1 END) END AS DECIMAL(18,2)) AS credit,
  CASE WHEN event_id % 31 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN event_id % 97 = 0 THEN coalesce(lag(true_balance) OVER (PARTITION BY stmt_id ORDER BY row_seq), true_balance) ELSE true_balance END AS balance
  FROM true_ledger)"""
META_SQL = f"""
statement_meta AS (SELECT stmt_id, {_list(BANKS)}[stmt_id % 9 + 1] AS bank, lpad(CAST(stmt_id AS VARCHAR), 10, '0') AS account_no, min(opening) AS opening_balance, max_by(true_balance, row_seq) AS closing_balance,
  CASE WHEN stmt_id % 5 <> 0 THEN CAST(sum(true_debit) + CASE stmt_id % 5 WHEN 1 THEN 0.30 WHEN 2 THEN 25.00 ELSE 0 END AS DECIMAL(18,2)) END AS statement_total_debit,
  CASE WHEN stmt_id % 5 <> 0 THEN CAST(sum(true_credit) AS DECIMAL(18,2)) END AS statement_total_credit FROM true_ledger GROUP BY stmt_id)"""
