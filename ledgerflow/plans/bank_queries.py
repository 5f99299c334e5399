"""Queries of what is printed differently by each bank. Printed texts are hung on the rows of the ledger; the SQL states what a reader
would answer for each of them, by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import bank_profiles, layout
from ledgerflow.plans.chain_queries import plain
from ledgerflow.plans.fixtures import LEDGER_SQL, META_SQL, ledger, statement_meta
from ledgerflow.plans.layout_queries import doc_words, page_texts
from ledgerflow.plans.registry import query

_META = f"WITH {LEDGER_SQL}, {META_SQL}"


def _nth(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _sql(values: list) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


@query("lay_18_bank_of", f"{_META} SELECT stmt_id AS file_id, CASE WHEN bank = 'gtbank' THEN 'generic' ELSE bank END AS bank, CASE WHEN bank = 'gtbank' THEN 'generic' ELSE bank END AS guarded, bank AS hint FROM statement_meta")
def _(spark, sf_dir):
    pages = page_texts(spark, sf_dir).where("page_no = 0").join(statement_meta(spark, sf_dir).select(F.col("stmt_id").alias("file_id"), F.col("bank").alias("b")), "file_id")
    bank = bank_profiles.bank_of(F.col("text"))
    return pages.select("file_id", bank.alias("bank"), bank_profiles.guarded_bank(bank, F.col("text")).alias("guarded"), bank_profiles.bank_hint(F.concat(F.lit("Stmt_"), F.upper("b"), F.lit(".pdf"))).alias("hint"))


# Heads of first pages, the bank each is from, and what becomes of the claim that it is a gtbank page.
HEADS = [
    ("Guaranty Trust\nBank statement", "gtbank", "gtbank"), ("GTCO PLC", "gtbank", "gtbank"), ("Ecobank transfer to Zenith", "ecobank", "ecobank"), ("PROVIDUS customer", "providus", "providus"),
    ("to Access  Bank by Sterling", "access", "access"), ("Sterling transfer Access diamonds", "access", "access"), ("Withdrawals Deposits Remarks", "wema", "wema"), ("Withdrawals Deposits Cheque", "generic", "generic"),
    ("the tubal works UBA", "uba", "uba"), ("Rhubarb ubah sum", "generic", "generic"), ("Chq No Tran Date Debit", "uba", "uba"), ("Withdrawal (DR) Deposit (CR) Ref Number Transaction Details", "firstbank", "firstbank"),
    ("Fidelity of FCMB", "fidelity", "fidelity"), ("Stanbic originating branch remarks", "generic", "gtbank"), ("Trans. Date   Originating\nBranch", "gtbank", "gtbank"), ("Trans Date only", "generic", "generic"),
    ("Txn Date Val Date", "providus", "providus"), ("Money In Money Out Narration", "sterling", "sterling"), ("Posted Date and Remarks", "access", "access"), ("Transaction Details Lodgement Value Date", "access", "access"),
    ("Transaction Details Value Date", "zenith", "zenith"), ("", "generic", "generic"),
]


@query("lay_19_guarded_bank", f"{_META} SELECT stmt_id AS file_id, {_sql([b for _, b, _ in HEADS])}[stmt_id % {len(HEADS)} + 1] AS bank, {_sql([g for *_, g in HEADS])}[stmt_id % {len(HEADS)} + 1] AS guarded, {_sql(['access', 'access', 'uba', 'auto'])}[stmt_id % 4 + 1] AS alias FROM statement_meta")
def _(spark, sf_dir):
    m = statement_meta(spark, sf_dir).select(F.col("stmt_id").alias("file_id"))
    text = _nth([h for h, *_ in HEADS], F.col("file_id"))
    return m.select("file_id", bank_profiles.bank_of(text).alias("bank"), bank_profiles.guarded_bank(F.lit("gtbank"), text).alias("guarded"), bank_profiles.bank_alias(_nth(["Access-Bank", " access_bank ", "UBA", ""], F.col("file_id"))).alias("alias"))


# Lines, and whether a reader drops them as noise on any page, as a summary, as zenith's, uba's, sterling's and fcmb's own.
LINES = [
    ("TRANSFER TO MRS TOTALIA", 0, 0, 0, 0, 0, 0), ("see Account Summary below", 1, 0, 0, 0, 0, 0), ("Opening Bal", 1, 0, 1, 0, 1, 0), ("Shop opening party", 0, 0, 1, 0, 1, 0), (" total debits ", 1, 0, 0, 0, 1, 0), ("Page  Total", 0, 1, 0, 0, 0, 0),
    ("TOTAL FILLING STATION", 0, 1, 0, 0, 0, 0), ("PAID AT TOTAL STATION", 0, 0, 0, 0, 0, 0), ("Balance b/f", 0, 1, 0, 0, 0, 0), ("Balance  brought forward", 0, 1, 0, 0, 0, 0), ("Balance brought forward", 0, 1, 1, 0, 0, 1), ("Grand Total", 0, 1, 0, 0, 0, 0),
    ("Chat with Leo now", 0, 0, 0, 1, 0, 0), ("AFRICA'S GLOBAL BANK", 0, 0, 0, 1, 0, 0), ("Balance: 5.00", 0, 0, 0, 0, 1, 0), ("Money In", 0, 0, 0, 0, 1, 0), ("MONEY IN TRANSIT", 0, 0, 0, 0, 0, 0), ("Debit and credit", 0, 0, 0, 0, 0, 1), ("Insured by NDIC", 1, 0, 0, 0, 0, 0), ("Effective available", 0, 0, 0, 0, 0, 0),
]
_NOISE = ("noise", "summary", "zenith", "uba", "sterling", "fcmb")


@query("lay_27_bank_noise", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq, " + ", ".join(f"{_sql([x[k + 1] for x in LINES])}[event_id % {len(LINES)} + 1] = 1 AS {n}" for k, n in enumerate(_NOISE)) + " FROM ledger")
def _(spark, sf_dir):
    text = _nth([x[0] for x in LINES], F.col("event_id"))
    own = [bank_profiles.is_bank_noise(F.lit(n), text).alias(n) for n in _NOISE[2:]]
    return ledger(spark, sf_dir).select("stmt_id", "row_seq", bank_profiles.is_noise(text).alias("noise"), bank_profiles.is_summary(text).alias("summary"), *own)


@query("lay_28_guarded_dates", f"""{_META}, r AS (SELECT l.*, event_id % 7 AS k, CASE WHEN event_id % 7 = 0 THEN strftime(txn_date, '%Y-%m-%d') END AS day, m.statement_total_debit AS td, m.statement_total_credit AS tc FROM ledger l JOIN statement_meta m USING (stmt_id)),
x AS (SELECT *, last_value(day IGNORE NULLS) OVER (PARTITION BY stmt_id ORDER BY row_seq) AS known FROM r)
SELECT stmt_id, row_seq, CASE WHEN day IS NOT NULL THEN day WHEN k = 1 THEN known WHEN k = 6 AND td IS NULL THEN known WHEN k = 4 AND balance > 0 THEN known WHEN k = 5 THEN known END AS date_raw FROM x""")
def _(spark, sf_dir):
    k, zero = F.col("event_id") % 7, F.lit(0).cast("decimal(18,2)")
    rows = ledger(spark, sf_dir).join(statement_meta(spark, sf_dir).select("stmt_id", "statement_total_debit", "statement_total_credit"), "stmt_id")
    # 0 dated, 1 words, 2 a page counter, 3 a header's words, 4 only a balance, 5 only a large amount, 6 the totals again
    rows = rows.select(
        "stmt_id", "row_seq", F.col("row_seq").alias("line_no"), F.when(k == 0, F.date_format("txn_date", "yyyy-MM-dd")).alias("date_raw"), F.when(k.isin(1, 2, 3), "paid").when(k == 6, "sum").otherwise("").alias("description"), F.lit(None).cast("string").alias("reference"),
        F.when(k == 2, " 12 ").when(k == 3, "Account of").otherwise("paid 5.00").alias("row_text"), F.when(k == 5, 1_000_000).when(k == 6, F.coalesce("statement_total_debit", F.lit(5))).otherwise(5).cast("decimal(18,2)").alias("debit"), zero.alias("credit"),
        F.when(k == 5, zero).when(k == 6, F.coalesce("statement_total_credit", zero)).otherwise(F.col("balance")).cast("decimal(18,2)").alias("balance"),
    )
    return layout.guarded_dates(rows, statement_meta(spark, sf_dir)).select("stmt_id", "row_seq", "date_raw")


# Statements as each bank prints them; {d}, {c}, {o}, {z}: totals, opening and closing balance. Then name and period as a reader has them.
PRINTED = {
    "gtbank": ("CUSTOMER STATEMENT ADE & SONS\nTrans. Date\nStatement Period : May 2024\nTotal Debit {d} Total Credit {c}\nOpening Balance {o} Closing Balance {z}", "ADE & SONS", "May 2024"),
    "access": ("Account Name: BISI FOODS Total\nPeriod: 01-May-2024 to 31/May/2024\nTotal Withdrawals: {d}\nTotal Lodgements: {c}\nOpening Balance: {o}\nClosing Balance: {z}", "BISI FOODS", "01-May-2024 to 31/May/2024"),
    "zenith": ("Account Name: CHI\nPeriod: May\nTotal Debit: {d} Total Credit: {c} Opening Balance: {o} Closing Balance: {z}", "CHI", "May"),
    "fidelity": ("Account: DAMI Stores Currency: NGN\nFrom 1 May to 31 May\nTotal Debits{d} Total Credit: {c} Opening  Balance {o} Closing Balance{z}", "DAMI Stores", "1 May to 31 May"),
    "fcmb": ("Account Name: EKO\nStatement Period: May\nTotal Debit: {d} Total Credit: {c} Opening Balance: {o} Closing Balance: {z}", "EKO", "May"),
    "none": ("nothing printed", None, None),
}


@query("lay_45_profile_fields", f"""{_META}, p AS (SELECT *, {_sql(list(PRINTED))}[stmt_id % {len(PRINTED)} + 1] AS b FROM statement_meta)
SELECT stmt_id AS file_id, b AS profile, CASE b {' '.join(f"WHEN '{b}' THEN '{n}'" for b, (_, n, _) in PRINTED.items() if n)} END AS account_name, CASE b {' '.join(f"WHEN '{b}' THEN '{n}'" for b, (*_, n) in PRINTED.items() if n)} END AS statement_period,
 {', '.join(f"CASE WHEN b <> 'none' THEN CAST({c} AS DOUBLE) END AS {n}" for n, c in (('total_debit', 'statement_total_debit'), ('total_credit', 'statement_total_credit'), ('opening_balance', 'opening_balance'), ('closing_balance', 'abs(closing_balance)')))} FROM p""")
def _(spark, sf_dir):
    m = statement_meta(spark, sf_dir).withColumn("b", _nth(list(PRINTED), F.col("stmt_id")))
    f = lambda c: F.coalesce(F.format_number(F.abs(c), 2), F.lit("n/a"))
    text = _nth([t for t, *_ in PRINTED.values()], F.col("stmt_id"))
    for mark, column in (("{d}", "statement_total_debit"), ("{c}", "statement_total_credit"), ("{o}", "opening_balance"), ("{z}", "closing_balance")):
        text = F.replace(text, F.lit(mark), f(column))
    pages = m.select("stmt_id", "b", text.alias("text"))
    read = bank_profiles.fields(F.col("b"), F.col("text"))
    return plain(pages.select(F.col("stmt_id").alias("file_id"), F.col("b").alias("profile"), *[c.alias(n) for n, c in read.items()]))


# Headers as banks print them: the cells from left to right and the columns that a reader takes them for.
PRINTED_HEADERS = {
    "gtbank": [("Trans. Date", "trans_date"), ("Value Date", "value_date"), ("Reference", "reference"), ("Debits", "debit"), ("Credits", "credit"), ("Balance", "balance"), ("Remarks", "remarks")],
    "access": [("Transaction Date", "trans_date"), ("Value Date", "value_date"), ("Narration", "remarks"), ("Withdrawals", "debit"), ("Lodgements", "credit"), ("Balance", "balance")],
    "firstbank": [("TransDate", "trans_date"), ("Reference", "reference"), ("Particulars", "remarks"), ("Value Date", "value_date"), ("Credit", "credit"), ("Debit", "debit"), ("Balance", "balance")],
    "zenith": [("DATE", "trans_date"), ("VALUE DATE", "value_date"), ("DESCRIPTION", "remarks"), ("DEBIT", "debit"), ("CREDIT", "credit"), ("BALANCE", "balance")],
    "uba": [("Trans Date", "trans_date"), ("Narration", "remarks"), ("Debit", "debit"), ("Credit", "credit"), ("Balance", "balance")],
    "fidelity": [("Transaction Date", "trans_date"), ("Channel", "channel"), ("Details", "remarks"), ("Pay In", "credit"), ("Pay Out", "debit"), ("Balance", "balance")],
    "fcmb": [("Tran Date", "trans_date"), ("Value Date", "value_date"), ("Details", "remarks"), ("Debit", "debit"), ("Credit", "credit"), ("Balance", "balance")],
    "sterling": [("Trans Date", "trans_date"), ("Narration", "remarks"), ("Money Out", "debit"), ("Money In", "credit"), ("Balance", "balance")],
    "elsewhere": [("Debit", "debit"), ("Credit", "credit"), ("Balance", "balance")],
}
_PLACES = ", ".join(f"({b}, {i}, '{c}')" for b, cells in enumerate(PRINTED_HEADERS.values()) for i, (_, c) in enumerate(cells))


@query("lay_14_header_cuts", f"""{_META}, h AS (SELECT *, CAST(100 * i + 3 * b + CASE WHEN c IN ('debit', 'credit', 'balance') THEN 60 ELSE 0 END AS DOUBLE) AS x FROM (VALUES {_PLACES}) t(b, i, c) WHERE b < 8),
k AS (SELECT b, i, c, coalesce((x + lag(x) OVER w) / 2, -10000) AS x_left, coalesce((x + lead(x) OVER w) / 2, 10000) AS x_right FROM h WINDOW w AS (PARTITION BY b ORDER BY i))
SELECT stmt_id AS file_id, CAST(i AS INT) AS col_ord, c AS col_name, x_left, x_right FROM statement_meta JOIN k ON b = stmt_id % 9""")
def _(spark, sf_dir):
    at = lambda line, seq, text, x0, x1: F.struct(F.lit(line).alias("line_id"), F.lit(seq).alias("word_seq"), F.lit(text).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"))
    printed = []
    for b, cells in enumerate(PRINTED_HEADERS.values()):
        words = [at(0, 0, "Debit", 10, 40), at(0, 1, "Balance", 60, 90)]  # a line above that names two columns only
        for i, (cell, _) in enumerate(cells):
            parts, left = cell.split(" "), 100 * i + 3 * b
            words += [at(1, 2 * i + j, w, left + 30 * j + 2 * (j > 0), left + (60 if j == len(parts) - 1 else 30)) for j, w in enumerate(parts)]
        printed.append(F.array(*words))
    m = statement_meta(spark, sf_dir).select(F.col("stmt_id").alias("file_id"), F.lit(0).alias("page_no"), _nth(list(PRINTED_HEADERS), F.col("stmt_id")).alias("bank"), F.explode(F.element_at(F.array(*printed), (F.col("stmt_id") % 9 + 1).cast("int"))).alias("w"))
    return bank_profiles.header_cuts(m.select("file_id", "page_no", "bank", "w.*")).select("file_id", "col_ord", "col_name", "x_left", "x_right")


@query("lay_02_bucket_lines_down", "SELECT doc_id AS file_id, CAST(floor((pos // 10 * 12 + (pos % 3 - 1) * 0.4) / 5) AS INT) AS line_id, count(*) AS n FROM (SELECT doc_id, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents) GROUP BY ALL")
def _(spark, sf_dir):
    return layout.bucket_lines(doc_words(spark, sf_dir), 5.0, down=True).groupBy("file_id", "line_id").agg(F.count("*").alias("n"))


@query("lay_11_pick_number", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq, CASE event_id % 4 WHEN 0 THEN format('{{:,.2f}}', CAST(debit AS DOUBLE)) WHEN 1 THEN 'x,9' WHEN 2 THEN CAST(debit AS VARCHAR) END AS number FROM ledger")
def _(spark, sf_dir):
    k = F.col("event_id") % 4
    cell = F.when(k == 0, F.concat(F.lit(" 17 a.b "), F.format_number("debit", 2), F.lit(" 8.00"))).when(k == 1, "5 x,9 1,000.00").when(k == 2, F.col("debit").cast("string")).otherwise("12 . ,")
    return ledger(spark, sf_dir).select("stmt_id", "row_seq", layout.pick_number(cell).alias("number"))
