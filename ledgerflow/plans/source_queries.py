"""Queries of the tabular sources over cells, lines and files printed from the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.plans.chain_queries import plain
from ledgerflow.plans.fixtures import LEDGER_SQL, ledger
from ledgerflow.plans.registry import query
from ledgerflow.sources import tables, tabular

#: Header rows as different banks print them; one in five statements has none.
HEADS = [["Trans Date", "Narration", "Ref", "Debit", "Credit", "Balance"], ["DATE", "DESCRIPTION", "BRANCH", "WITHDRAWAL", "DEPOSIT", "BALANCE"], ["Transaction Date", "Remarks", "Value Date", "Withdrawals", "Lodgement", "Balance (NGN)"], ["Date", "Particulars", "x", "Debit Amt", "Credit Amt", "Closing Balance"]]


def cells(spark, sf_dir) -> DataFrame:
    """Statements as cell tables: up to three banner rows, a header (but for one in five), rows with printed amounts."""
    n = F.col("stmt_id") % 4
    f = lambda c: F.when(F.col(c) == 0, "").otherwise(F.format_number(c, 2))
    rows = ledger(spark, sf_dir)
    body = rows.select(F.col("stmt_id").alias("file_id"), (F.col("row_seq") + n).cast("int").alias("row_idx"), F.array(F.date_format("txn_date", "dd/MM/yyyy"), F.col("narration"), F.lit("x"), f("debit"), f("credit"), F.format_number("balance", 2)).alias("cells"))
    heads = rows.select("stmt_id").distinct()
    header = heads.where("stmt_id % 5 <> 0").select(F.col("stmt_id").alias("file_id"), n.cast("int").alias("row_idx"), F.element_at(F.array(*[F.array(*map(F.lit, h)) for h in HEADS]), (n + 1).cast("int")).alias("cells"))
    banner = heads.where(n > 0).select(F.col("stmt_id").alias("file_id"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("row_idx"), F.array(F.lit("Statement of account"), F.lit("page date")).alias("cells"))
    return body.unionByName(header).unionByName(banner)


_hd = "[" + ", ".join("[" + ", ".join(f"'{c}'" for c in h) + "]" for h in HEADS) + "]"
_fm = lambda c: f"format('{{:,.2f}}', CAST({c} AS DOUBLE))"
_MAPS = {"date": "[0, 0, 0, 0]", "vdate": "[NULL, NULL, 2, NULL]", "desc": "[1, 1, 1, 1]", "debit": "[3, 3, 3, 3]", "credit": "[4, 4, 4, 4]", "balance": "[5, 5, 5, 5]"}


@query("src_03_header_rows", f"WITH {LEDGER_SQL} SELECT DISTINCT stmt_id AS file_id, CASE WHEN stmt_id % 5 = 0 THEN -1 ELSE stmt_id % 4 END AS header_idx FROM ledger")
def _(spark, sf_dir):
    return tabular.header_rows(cells(spark, sf_dir)).select("file_id", F.col("header_idx").cast("long").alias("header_idx"))


@query("src_04_header_map", f"WITH {LEDGER_SQL} SELECT DISTINCT stmt_id AS file_id, CASE WHEN stmt_id % 5 <> 0 AND stmt_id % 4 = 2 THEN '2' END AS vdate, 1 AS \"desc\", 3 AS debit, 4 AS credit, 5 AS balance FROM ledger")
def _(spark, sf_dir):
    return tabular.header_map(cells(spark, sf_dir)).select("file_id", F.col("vdate").cast("string").alias("vdate"), "desc", "debit", "credit", "balance")


@query("src_05_universal_map", f"WITH {LEDGER_SQL} SELECT DISTINCT stmt_id AS file_id, 0 AS date, CASE WHEN stmt_id % 4 = 2 THEN '2' END AS value_date, 1 AS description, 3 AS debit, CASE WHEN stmt_id % 4 = 1 THEN 1 ELSE 4 END AS credit, 5 AS balance FROM ledger WHERE stmt_id % 5 <> 0")
def _(spark, sf_dir):
    return tabular.universal_map(cells(spark, sf_dir)).select("file_id", "date", F.col("value_date").cast("string").alias("value_date"), "description", "debit", "credit", "balance")


@query("src_06_universal_header", f"WITH {LEDGER_SQL} SELECT DISTINCT stmt_id AS file_id, stmt_id % 4 AS header_idx FROM ledger WHERE stmt_id % 5 <> 0")
def _(spark, sf_dir):
    return tabular.universal_header(cells(spark, sf_dir)).select("file_id", F.col("header_idx").cast("long").alias("header_idx"))


@query("src_07_project_rows", f"WITH {LEDGER_SQL} SELECT stmt_id AS file_id, row_seq + stmt_id % 4 AS row_seq, strftime(txn_date, '%d/%m/%Y') AS date_raw, narration AS description, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, CAST(balance AS DOUBLE) AS balance FROM ledger WHERE debit <> 0 OR credit <> 0")
def _(spark, sf_dir):
    out = tabular.project_rows(cells(spark, sf_dir))
    return out.select("file_id", F.col("row_seq").cast("long").alias("row_seq"), "date_raw", "description", "debit", "credit", "balance")


_VALUES = "CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, CAST(balance AS DOUBLE) AS balance"


@query("src_08_piped_rows", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq, strftime(txn_date, '%d-%b-%Y') AS date_raw, narration AS description, {_VALUES} FROM ledger WHERE narration <> 'OPENING BALANCE' AND event_id % 6 <> 5")
def _(spark, sf_dir):
    day, n = F.date_format("txn_date", "dd-MMM-yyyy"), F.col("event_id") % 6
    tail = [F.col("narration"), *[F.format_number(c, 2) for c in ("debit", "credit", "balance")]]
    line = F.when(n == 5, F.concat_ws("|", day, F.col("narration"))).when(n % 2 == 0, F.concat_ws(" | ", day, day, *tail)).otherwise(F.concat_ws("|", day, *tail))
    rows = ledger(spark, sf_dir).select("stmt_id", "row_seq", line.alias("line"))
    heads = rows.select("stmt_id").distinct().select("stmt_id", F.lit(0).cast("long").alias("row_seq"), F.lit("Date|Value Date|Description|Debit|Credit|Balance").alias("line"))
    return tabular.piped_rows(rows.unionByName(heads)).select("stmt_id", "row_seq", "date_raw", "description", "debit", "credit", "balance")


@query("src_09_json_rows", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq - 1 AS row_seq, CAST(txn_date AS VARCHAR) AS date_raw, narration AS description, {_VALUES} FROM ledger WHERE debit <> 0 OR credit <> 0")
def _(spark, sf_dir):
    odd = F.col("event_id") % 2 == 1
    pair = lambda a, b, v: F.struct(F.when(odd, a).otherwise(b).alias("key"), v.cast("string").alias("value"))
    m = F.map_from_entries(F.array(pair("Date", "txn_date", F.col("txn_date")), pair("Narration", "description", F.col("narration")), pair("DR", "debit", F.col("debit")), pair("CR", "credit", F.col("credit")), pair("Balance", "running_balance", F.col("balance"))))
    texts = ledger(spark, sf_dir).select("stmt_id", "row_seq", m.alias("m")).groupBy("stmt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_seq", F.to_json("m").alias("j")))), lambda s: s["j"]).alias("js"))
    texts = texts.select("stmt_id", F.concat(F.lit("```json\n["), F.array_join("js", ","), F.lit("]\n```")).alias("text"))
    return tabular.json_rows(texts).select("stmt_id", F.col("row_seq").cast("long").alias("row_seq"), "date_raw", "description", "debit", "credit", "balance")


@query("src_10_anchored_lines", f"""WITH {LEDGER_SQL}, x AS (SELECT *, debit + credit AS amount FROM ledger), y AS (SELECT *, balance - lag(balance) OVER (PARTITION BY stmt_id ORDER BY row_seq) AS m FROM x)
SELECT stmt_id AS file_id, 2 * row_seq AS line_no, strftime(txn_date, '%d-%b-%Y') AS date_raw, 'continued ' || narration AS description, CAST(CASE WHEN m < 0 THEN amount ELSE 0 END AS DOUBLE) AS debit, CAST(CASE WHEN m < 0 THEN 0 ELSE amount END AS DOUBLE) AS credit, CAST(balance AS DOUBLE) AS balance FROM y""")
def _(spark, sf_dir):
    day = F.date_format("txn_date", "dd-MMM-yyyy")
    rows = ledger(spark, sf_dir)
    lines = rows.select(F.col("stmt_id").alias("file_id"), (F.col("row_seq") * 2).alias("line_no"), F.concat_ws(" ", day, day, "narration", F.format_number(F.col("debit") + F.col("credit"), 2), F.format_number("balance", 2)).alias("line"))
    lines = lines.unionByName(rows.select(F.col("stmt_id").alias("file_id"), (F.col("row_seq") * 2 - 1).alias("line_no"), F.lit("continued").alias("line")))
    return plain(tabular.anchored_lines(lines))


@query("src_11_gap_lines", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq, strftime(txn_date, '%d/%m/%Y') AS date_raw, narration AS description, CAST(CASE WHEN event_id % 2 = 0 THEN greatest(debit - credit, 0) ELSE debit END AS DOUBLE) AS debit, CAST(CASE WHEN event_id % 2 = 0 THEN greatest(credit - debit, 0) ELSE credit END AS DOUBLE) AS credit, CAST(balance AS DOUBLE) AS balance FROM ledger")
def _(spark, sf_dir):
    net = F.format_number(F.col("debit") - F.col("credit"), 2)
    amounts = F.when(F.col("event_id") % 2 == 0, net).otherwise(F.concat_ws("   ", F.format_number("debit", 2), F.format_number("credit", 2)))
    lines = ledger(spark, sf_dir).select("stmt_id", "row_seq", F.concat_ws("   ", F.date_format("txn_date", "dd/MM/yyyy"), "narration", amounts, F.format_number("balance", 2)).alias("line"))
    return tabular.gap_lines(lines).select("stmt_id", "row_seq", "date_raw", "description", "debit", "credit", "balance")


@query("src_12_positional_rows", f"WITH {LEDGER_SQL} SELECT stmt_id AS file_id, row_seq + stmt_id % 4 AS row_idx, strftime(txn_date, '%d-%b-%Y') AS date_raw, narration || ' x' AS description, {_VALUES} FROM ledger")
def _(spark, sf_dir):
    return tabular.positional_rows(cells(spark, sf_dir)).withColumn("row_idx", F.col("row_idx").cast("long"))


@query("src_13_layout_rows", f"WITH {LEDGER_SQL} SELECT stmt_id AS file_id, row_seq AS row_idx, strftime(txn_date, '%d/%m/%Y') AS date_raw, narration AS description, {_VALUES} FROM ledger")
def _(spark, sf_dir):
    odd, day = F.col("stmt_id") % 2 == 1, F.date_format("txn_date", "dd/MM/yyyy")
    tail = [F.col("narration"), *[F.format_number(c, 2) for c in ("debit", "credit", "balance")]]
    rows = ledger(spark, sf_dir)
    body = rows.select(F.col("stmt_id").alias("file_id"), F.col("row_seq").cast("int").alias("row_idx"), F.when(odd, F.array(day, day, *tail)).otherwise(F.array(day, *tail)).alias("cells"))
    names = ["Narration", "Debit", "Credit", "Balance"]
    head = rows.select("stmt_id").distinct().select(F.col("stmt_id").alias("file_id"), F.lit(0).alias("row_idx"), F.when(odd, F.array(*map(F.lit, ["Date", "Value Date", *names]))).otherwise(F.array(*map(F.lit, ["Date", *names]))).alias("cells"))
    return tabular.layout_rows(body.unionByName(head)).withColumn("row_idx", F.col("row_idx").cast("long"))


@query("src_14_continued_rows", f"WITH {LEDGER_SQL} SELECT stmt_id AS file_id, 2 * row_seq AS row_idx, strftime(txn_date, '%d/%m/%Y') AS date_raw, CASE WHEN row_seq = 1 THEN 'lead ' ELSE '' END || narration || CASE WHEN event_id % 3 = 0 THEN ' more' ELSE '' END AS description, {_VALUES} FROM ledger")
def _(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    seq = lambda d: (F.col("row_seq") * 2 + d).cast("int").alias("row_idx")
    body = rows.select(F.col("stmt_id").alias("file_id"), seq(0), F.array(F.date_format("txn_date", "dd/MM/yyyy"), F.col("narration"), *[F.concat(F.format_number(c, 2), F.lit("\n9.99")) for c in ("debit", "credit", "balance")]).alias("cells"))
    more = rows.where("event_id % 3 = 0").select(F.col("stmt_id").alias("file_id"), seq(1), F.array(F.lit(""), F.lit("more")).alias("cells"))
    lead = rows.where("row_seq = 1").select(F.col("stmt_id").alias("file_id"), F.lit(0).alias("row_idx"), F.array(F.lit(""), F.lit("lead")).alias("cells"))
    return tabular.continued_rows(body.unionByName(more).unionByName(lead)).withColumn("row_idx", F.col("row_idx").cast("long"))


@query("src_01_landing_gate", "SELECT d.doc_id, CASE doc_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'extension' WHEN 2 THEN 'empty' WHEN 3 THEN 'content' WHEN 4 THEN 'binary' ELSE 'ok' END AS verdict FROM documents d")
def _(spark, sf_dir):
    k, text = F.col("doc_id") % 6, F.encode(F.concat(F.lit("a"), F.coalesce("text", F.lit(""))), "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.when(k == 1, ".exe").when(k == 3, ".pdf").when(k == 5, ".pdf").otherwise(".csv"))
    content = F.when(k == 2, F.lit(b"")).when(k == 4, F.concat(F.lit(b"a\x00"), text)).when(k == 5, F.concat(F.lit(b"%PDF-1"), text)).otherwise(text)
    gate = tabular.landing_gate(docs.select(path.alias("path"), content.alias("content"), F.length(content).alias("length")))
    return gate.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), "verdict")


@query("src_02_decode_csv", "SELECT doc_id, text FROM documents")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    latin = F.encode("text", "ISO-8859-1")
    content = F.when((F.col("doc_id") % 2 == 0) & (F.decode(latin, "ISO-8859-1") == F.col("text")), latin).otherwise(F.encode("text", "UTF-8"))
    return tabular.decode_csv(docs.select(F.col("doc_id").alias("path"), content.alias("content"))).select(F.col("path").alias("doc_id"), "text")


@query("src_13_printed_layouts", f"""WITH {LEDGER_SQL} SELECT stmt_id AS file_id, row_seq + 1 AS row_idx, CASE WHEN event_id % 5 = 0 THEN 'padded' WHEN stmt_id % 3 = 1 THEN 'branches' ELSE 'details' END AS layout,
 strftime(txn_date, '%d-%b-%Y') AS date_raw, CASE WHEN event_id % 7 = 0 THEN 'No Description' ELSE narration END AS description, CASE WHEN event_id % 5 = 0 OR event_id % 2 = 0 THEN 'R' || event_id ELSE '' END AS reference, {_VALUES} FROM ledger""")
def _(spark, sf_dir):
    """Files with either header or none, a banner above; every fifth row has empty columns between its cells."""
    rows, n = ledger(spark, sf_dir), F.col("event_id")
    kind, day, no = F.col("stmt_id") % 3, F.date_format("txn_date", "dd-MMM-yyyy"), F.lit("")
    said, ref = F.when(n % 7 == 0, "").otherwise(F.regexp_replace("narration", " ", "\n")), F.concat(F.lit("R"), n.cast("string"))
    own = F.when(n % 2 == 0, ref).otherwise(no)
    d, c, b = (F.format_number(x, 2) for x in ("debit", "credit", "balance"))
    cells_ = F.when(n % 5 == 0, F.array(day, said, no, ref, no, day, d, no, c, b)).when(kind == 1, F.array(day, day, own, d, c, b, F.lit("LAGOS"), said)).otherwise(F.array(day, said, own, F.when(n % 3 > 0, day).otherwise(no), d, c, b))
    body = rows.select(F.col("stmt_id").alias("file_id"), (F.col("row_seq") + 1).cast("int").alias("row_idx"), cells_.alias("cells"))
    head = F.when(kind == 0, F.array(*map(F.lit, ["Date", "Transaction Details", "Reference", "Value Date", "Withdrawals", "Lodgements", "Balance"]))).when(kind == 1, F.array(*map(F.lit, ["Posted Date", "Value Date", "Ref", "Debit", "Credit", "Balance", "Originating Branch", "Remarks"])))
    files = rows.select("stmt_id").distinct()
    banner = files.select(F.col("stmt_id").alias("file_id"), F.lit(0).alias("row_idx"), F.array(F.lit("Opening Balance"), F.lit(None), F.lit("9.00")).alias("cells"))
    heads = files.where(kind < 2).select(F.col("stmt_id").alias("file_id"), F.lit(1).alias("row_idx"), head.alias("cells"))
    out = tables.layout_rows(body.unionByName(heads).unionByName(banner))
    return out.select("file_id", F.col("row_idx").cast("long").alias("row_idx"), "layout", "date_raw", F.col("description"), "reference", "debit", "credit", "balance")


@query("src_14_table_rows", f"""WITH {LEDGER_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY stmt_id ORDER BY row_seq) = 1 AS first FROM ledger WHERE narration <> 'OPENING BALANCE')
SELECT stmt_id AS file_id, page_no, strftime(txn_date, '%d-%b-%Y') AS date_raw, CASE WHEN event_id % 4 = 0 THEN 'REFNO:' || event_id ELSE '' END AS reference,
 CASE WHEN event_id % 4 = 0 THEN 'REFNO:' || event_id || ' ' ELSE '' END || narration || CASE WHEN event_id % 4 = 2 THEN ' more' ELSE '' END || CASE WHEN first THEN ' lead' ELSE '' END AS description, {_VALUES} FROM e WHERE debit <> 0 OR credit <> 0""")
def _(spark, sf_dir):
    """A header on each page; a reference behind the text of every fourth row, text in the next cell, or going on below. All lines of a row
    are printed in one pass, with the header before a page's first row."""
    rows, n = ledger(spark, sf_dir), F.col("event_id")
    place = (F.col("row_seq") - 1) % 20
    line = lambda test, at, *cells: F.when(test, F.struct(F.lit(at).cast("int").alias("row_idx"), F.array(*cells).alias("cells")))
    day = F.date_format("txn_date", "dd-MMM-yyyy")
    text_ = F.when(n % 4 == 0, F.concat("narration", F.lit(" , REFNO:"), n.cast("string"))).when(n % 4 == 1, "").otherwise(F.col("narration"))
    money = [F.concat(F.lit("\n"), F.format_number(c, 2), F.lit("\n9.99")) for c in ("debit", "credit", "balance")]
    each = F.array(
        line(place == 0, 0, *map(F.lit, ["Transaction\nDate", "Remarks", "Value Date", "Debit", "Credit", "Balance"])), line(F.col("row_seq") == 1, 1, F.lit(""), F.lit("lead"), F.lit(""), F.lit("")),
        line(F.lit(True), place * 2 + 2, day, text_, F.when(n % 4 == 1, F.col("narration")).otherwise(day), *money), line(n % 4 == 2, place * 2 + 3, F.lit(None), F.lit("more"), F.lit(""), F.lit("")),
    )
    cells_ = rows.select(F.col("stmt_id").alias("file_id"), "page_no", F.explode(F.filter(each, lambda l: l.isNotNull())).alias("l")).select("file_id", "page_no", "l.*")
    out = tables.continued_table_rows(cells_)
    return out.select("file_id", "page_no", "date_raw", "reference", "description", "debit", "credit", "balance")
