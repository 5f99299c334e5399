"""Queries of columns that are found and of fields that are printed in pieces. Pages are printed from the ledger with edges that vary, or
are samples hung on its statements; the SQL states what was printed or what a reader would answer by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import discovery, printed_fields
from ledgerflow.plans.chain_queries import plain
from ledgerflow.plans.fixtures import LEDGER_SQL, META_SQL, ledger, statement_meta
from ledgerflow.plans.registry import query

_META = f"WITH {LEDGER_SQL}, {META_SQL}"


def _nth(values: list[Column], index: Column) -> Column:
    return F.element_at(F.array(*values), (index % len(values) + 1).cast("int"))


def _sql(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


# Candidates of a page: hint, then each detector in its turn with its columns (a "-" in front: the cut is turned round), and the one taken.
CANDIDATES = [
    ("", [("Access", "date debit credit"), ("UBA", "date debit credit balance")], ("UBA", 6)), ("", [("Access", "date debit credit"), ("UBA", "date debit credit")], ("Access", 5)),
    ("", [("Access", "date a b c d e f"), ("UBA", "date deposits balance")], ("UBA", 3)), ("", [("Access", "date debit -credit balance"), ("UBA", "date debit x")], ("UBA", 3)),
    ("uba", [("Access", "date debit credit balance narration"), ("UBA", "date debit x")], ("UBA", 53)), ("my UBA", [("Access", "date debit credit"), ("UBA", "date debit")], ("Access", 5)),
    ("gtbank", [("Access", "date debit credit balance narration reference branch a b c d e f"), ("GTCO", "date debit credit")], ("GTCO", 15)), ("gtco", [("Access", "date debit credit"), ("Wema", "date debit x")], ("Wema", 3)),
]


@query("lay_15_judged_cuts", f"{_META} SELECT stmt_id AS file_id, {_sql([w for *_, (w, _) in CANDIDATES])}[stmt_id % {len(CANDIDATES)} + 1] AS detector, {_sql([s for *_, (_, s) in CANDIDATES])}[stmt_id % {len(CANDIDATES)} + 1] AS score FROM statement_meta")
def _(spark, sf_dir):
    files = statement_meta(spark, sf_dir).select(F.col("stmt_id").alias("file_id"))
    cut = lambda k, d, i, c: F.struct(F.lit(k).alias("place"), F.lit(d).alias("detector"), F.lit(c.lstrip("-")).alias("col_name"), F.lit(float(10 * i + (20 if c[0] == "-" else 0))).alias("x_left"), F.lit(float(10 * i + 10)).alias("x_right"))
    samples = [F.array(*[cut(k, d, i, c) for k, (d, names) in enumerate(each) for i, c in enumerate(names.split())]) for _, each, _ in CANDIDATES]
    cuts = files.select("file_id", F.lit(0).alias("page_no"), F.explode(_nth(samples, F.col("file_id"))).alias("c")).select("file_id", "page_no", "c.*")
    hints = files.select("file_id", _nth([F.lit(h) for h, *_ in CANDIDATES], F.col("file_id")).alias("hint"))
    return discovery.judged_cuts(cuts, hints).select("file_id", "detector", "score")


def ragged_words(spark, sf_dir) -> DataFrame:
    """Every row of the ledger as a line whose date and amounts stand up to three places off, by the row; every ninth is a whole amount."""
    n, f = F.col("event_id"), lambda c: F.when(F.col("event_id") % 9 == 0, "7").otherwise(F.format_number(F.abs(c), 2))
    w = lambda t, x0, x1: F.struct(t.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"))
    off = n % 4
    words = F.array(w(F.date_format("txn_date", "dd-MMM-yyyy"), 30 + off, 90 + off), w(F.split("narration", " ")[0], F.lit(150), F.lit(200)), w(f("debit"), F.lit(350), 400 - off), w(f("credit"), F.lit(450), 500 + (n % 3) * 20), w(f("balance"), F.lit(560), 600 + n % 2))
    rows = ledger(spark, sf_dir)
    return rows.select(F.col("stmt_id").alias("file_id"), "page_no", ((F.col("row_seq") - 1) % 20).cast("int").alias("line_id"), F.posexplode(words).alias("s", "w")).select("file_id", "page_no", "line_id", (F.col("line_id") * 10 + F.col("s")).cast("long").alias("word_seq"), "w.*")


@query("lay_16_consensus_zones", f"""WITH {LEDGER_SQL}, w AS (SELECT stmt_id AS file_id, row_seq, event_id, unnest([{{'c': 'date', 'x': 30 + event_id % 4}}, {{'c': 'debit', 'x': 400 - event_id % 4}}, {{'c': 'credit', 'x': 500 + event_id % 3 * 20}}, {{'c': 'balance', 'x': 600 + event_id % 2}}]) AS p FROM ledger WHERE page_no <= 5),
m AS (SELECT file_id, p.c AS col_name, p.x AS x, count(*) AS n, min(row_seq) AS met FROM w GROUP BY file_id, p.c, p.x QUALIFY row_number() OVER (PARTITION BY file_id, p.c ORDER BY count(*) DESC, min(row_seq)) = 1)
SELECT file_id, col_name, CAST(x - CASE col_name WHEN 'date' THEN 10 ELSE 30 END AS DOUBLE) AS x_left, CAST(x + CASE col_name WHEN 'date' THEN 50 ELSE 10 END AS DOUBLE) AS x_right FROM m""")
def _(spark, sf_dir):
    return discovery.consensus_zones(ragged_words(spark, sf_dir))


# Words of a page by line (text, left edge, right edge), and its columns as a reader names them.
PAGES = [
    ([[("Date", 30, 60), ("Details", 120, 180), ("Debit", 300, 340), ("Credit", 400, 440), ("Balance", 500, 560)], [("01-Jan", 28, 70), ("RENT", 120, 160), ("PAID", 160, 240), ("5.00", 310, 345), ("9.00", 505, 562)]], [("date", 28, 70), ("description", 120, 240), ("debit", 300, 345), ("credit", 400, 440), ("balance", 500, 562)]),
    ([[("01", 30, 60), ("RENT", 120, 180), ("x", 300, 310), ("9.00", 500, 560)]], [("date", 30, 60), ("description", 120, 180), ("balance", 500, 560)]),
    ([[("Period", 30, 90), ("Narration", 100, 190), ("Withdrawal", 300, 360), ("Deposit", 400, 440), ("Sum", 500, 560)], [("1", 30, 50)]], [("date", 30, 90), ("description", 100, 190), ("debit", 300, 360), ("credit", 400, 440), ("balance", 500, 560)]),
    ([[("Memo", 30, 90), ("a", 100, 120), ("b", 200, 280), ("c", 300, 340)], [("7", 400, 440)]], [("date", 30, 90), (None, 100, 120), ("description", 200, 280), ("amount", 300, 340), ("balance", 400, 440)]),
    ([[("Date", 30, 60), ("Value", 70, 100), ("Date", 101, 130), ("Bal", 500, 560)], [("01-Jan-2024", 20, 90), ("02-Jan-2024", 95, 135)]], [("date", 20, 135), ("balance", 500, 560)]),
]
_COLUMNS = [(k, i, *c) for k, (_, columns) in enumerate(PAGES) for i, c in enumerate(columns)]


@query("lay_17_discovered_columns", f"{_META} SELECT stmt_id AS file_id, o AS col_ord, c AS col_name, l AS x_left, r AS x_right FROM statement_meta JOIN (VALUES {', '.join(f'({k}, {i}, {_sql([c])[1:-1]}, {a}, {b})' for k, i, c, a, b in _COLUMNS)}) t(k, o, c, l, r) ON stmt_id % {len(PAGES)} = k")
def _(spark, sf_dir):
    files = statement_meta(spark, sf_dir).select(F.col("stmt_id").alias("file_id"))
    word = lambda n, k, t, a, b: F.struct(F.lit(n).alias("line_id"), F.lit(n * 100 + k).cast("long").alias("word_seq"), F.lit(t).alias("text"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"))
    samples = [F.array(*[word(n, k, *w) for n, ws in enumerate(lines) for k, w in enumerate(ws)]) for lines, _ in PAGES]
    words = files.select("file_id", F.lit(0).alias("page_no"), F.explode(_nth(samples, F.col("file_id"))).alias("w")).select("file_id", "page_no", "w.*")
    return discovery.discovered_columns(words).drop("page_no")


# Texts of scanned pages, and the total debit, total credit and opening balance a reader finds.
SPLIT = [
    ("TOTAL DEBIT 1,654.0 1 8, 157.69 TOTAL CREDIT 2,000.00", 1654018157.69, 2000.0, None), ("Total  Debit\n1,654,018,157.69", 1654018157.69, None, None), ("TOTAL DEBIT 157.69 OPENING BALANCE 1 234.50", 157.69, None, 1234.5), ("TOTAL DEBIT 1 2 3.45 x", 123.45, None, None),
    ("TOTAL DEBIT 12, 345.67 89", 12345.67, None, None), ("TOTAL DEBITS 5.00 total credit 7,0 00.10", None, 7000.1, None), ("TOTAL DEBIT 1.2.3", 0.0, None, None), ("", None, None, None),
]


@query("lay_41_split_totals", f"{_META} SELECT stmt_id AS file_id, " + ", ".join(f"CAST({_sql([s[k] for s in SPLIT])}[stmt_id % {len(SPLIT)} + 1] AS DOUBLE) AS {n}" for k, n in ((1, "statement_total_debit"), (2, "statement_total_credit"), (3, "opening_balance"))) + " FROM statement_meta")
def _(spark, sf_dir):
    pages = statement_meta(spark, sf_dir).select(F.col("stmt_id").alias("file_id"), _nth([F.lit(t) for t, *_ in SPLIT], F.col("stmt_id")).alias("text"))
    return plain(printed_fields.split_digit_fields(pages), "file_id", "statement_total_debit", "statement_total_credit", "opening_balance")


_or_null = lambda c: f"CAST({c} AS DOUBLE) AS {c}"


@query("lay_41_compact_fields", f"{_META} SELECT stmt_id AS file_id, account_no, 'MR ' || bank AS account_name, 'January 1, 2024 to Mar 31, 2024' AS period, {', '.join(map(_or_null, ('opening_balance', 'closing_balance', 'statement_total_debit', 'statement_total_credit')))} FROM (SELECT * REPLACE (abs(closing_balance) AS closing_balance) FROM statement_meta)")
def _(spark, sf_dir):
    m = statement_meta(spark, sf_dir).withColumn("closing_balance", F.abs("closing_balance"))
    # By the statement: with colon and blank, without either, or with a digit group apart.
    form = F.col("stmt_id") % 3
    shown = lambda label, c: F.concat(F.lit(label), F.when(form == 0, ": ").when(form == 1, " ").otherwise(" :\n"), F.coalesce(F.when(form == 2, F.regexp_replace(F.format_number(c, 2), ",", ", ")).otherwise(F.format_number(c, 2)), F.lit("n/a")), F.lit("\n"))
    head = F.when(form == 0, F.concat(F.lit("Bank Statement MR "), "bank", F.lit(" No 12 "))).otherwise(F.concat(F.lit("Hello  MR "), "bank", F.lit(", Here is your\nAccount Summary ")))
    text = F.concat(head, F.lit("Account Number\n"), "account_no", F.lit(" January 1, 2024 to Mar 31,\n2024 "), shown("Opening Balance", "opening_balance"), shown("CLOSING BALANCE", "closing_balance"), shown("Total Debit", "statement_total_debit"), shown("Total Credit", "statement_total_credit"))
    pages = m.select(F.col("stmt_id").alias("file_id"), text.alias("text"))
    return plain(printed_fields.compact_fields(pages), "file_id", "account_no", "account_name", "period", "opening_balance", "closing_balance", "statement_total_debit", "statement_total_credit")


@query("lay_42_footer_fields", f"{_META} SELECT stmt_id AS file_id, CASE stmt_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'NGN' END AS currency, '01-Jan-2024 to 31-Mar-2024' AS period, account_no, {_or_null('statement_total_debit')}, {_or_null('statement_total_credit')} FROM statement_meta")
def _(spark, sf_dir):
    m = statement_meta(spark, sf_dir)
    n, f = F.col("stmt_id"), lambda c: F.format_number(c, 2)
    cut = lambda c, back: F.substring(f(c), 1, F.length(f(c)) - back)
    tail = lambda c, k: F.substring(f(c), -k, k)
    one = F.concat(F.lit("Account No "), "account_no", F.lit(" Currency "), _nth([F.lit("US Dollar"), F.lit("Naira"), F.lit("Euro")], n), F.lit("\nTotal"))
    two = F.lit("Withdrawals 7\nStatement for period 1 January 2024 and")
    # The totals stand on one page or go on over its end; every second prints their last digits on the next line.
    whole = F.concat(f("statement_total_debit"), F.lit("  "), f("statement_total_credit"))
    split = F.concat(cut("statement_total_debit", 1), F.lit(" "), cut("statement_total_credit", 2), F.lit("\n"), tail("statement_total_debit", 1), F.lit(" "), tail("statement_total_credit", 2))
    three = F.concat(F.lit("ending 31-Mar-2024 Opening\nBalance 5.00\n"), F.coalesce(F.when(n % 2 == 0, whole).otherwise(split), F.lit("n/a")))
    pages = m.select(n.alias("file_id"), F.posexplode(F.array(one, two, three, F.lit("4 of 4\nend"))).alias("page_no", "text"))
    return plain(printed_fields.footer_fields(pages), "file_id", "currency", "period", "account_no", "statement_total_debit", "statement_total_credit")
