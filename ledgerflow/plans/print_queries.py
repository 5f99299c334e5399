"""Queries of printed pages and files: ledgers are printed as scanned lines, amount lines and delimited files in forms that vary by row, and
read again. The SQL states what was printed, or, for samples, what a reader would answer by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import repair, zones
from ledgerflow.plans.chain_queries import plain
from ledgerflow.plans.fixtures import LEDGER_SQL, ledger, true_ledger
from ledgerflow.plans.registry import query
from ledgerflow.sources import tabular

#: Printed balances are so much higher, so that none is negative.
LIFT = 10_000_000


def _word(text: Column, x0: float, x1: float) -> Column:
    return F.struct(text.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"))


def _narration(first: float, step: float) -> Column:
    """The narration's words from ``first`` on."""
    return F.transform(F.split("narration", " "), lambda t, i: F.struct(t.alias("text"), (first + i * step).cast("double").alias("x0"), (first + i * step + step - 5).cast("double").alias("x1")))


def _printed(rows: DataFrame, *lines: tuple[Column, Column, Column]) -> DataFrame:
    """Words of some lines for each row; a line is its number, its height and its words (null ones are not printed)."""
    each = F.array(*[F.struct(n.cast("int").alias("line_id"), top.cast("double").alias("top"), ws.alias("ws")) for n, top, ws in lines])
    x = rows.select(F.col("stmt_id").alias("file_id"), "page_no", F.explode(each).alias("l")).select("file_id", "page_no", "l.line_id", "l.top", F.posexplode("l.ws").alias("word_seq", "w")).where("w.text is not null")
    return x.select("file_id", "page_no", "line_id", F.col("word_seq").cast("long").alias("word_seq"), "w.text", "w.x0", "w.x1", "top")


def _money(c: Column) -> Column:
    return F.format_number(c, 2)


def scanned_words(spark, sf_dir) -> DataFrame:
    """One or two lines per row: all in one, the balance below, the date above, no amount, or the amount on the wrong side."""
    rows = true_ledger(spark, sf_dir)
    form, day = F.col("event_id") % 5, F.date_format("txn_date", "dd-MMM-yyyy")
    amount, debit = _money(F.greatest("true_debit", "true_credit")), F.col("true_debit") > 0
    left = F.when(form == 4, ~debit).otherwise(debit)
    put = lambda shown: F.array(_word(F.when(shown & left, amount), 600, 660), _word(F.when(shown & ~left, amount), 700, 750))
    balance = lambda shown: F.array(_word(F.when(shown, _money(F.col("true_balance") + LIFT)), 850, 930))
    two, line = form.isin(1, 2), F.col("row_seq") * 2
    top = F.concat(F.array(_word(day, 50, 120)), _narration(265, 30), put(form.isin(0, 1, 4)), balance(~two))
    return _printed(rows, (line, line * 10, top), (line + 1, line * 10 + 10, F.concat(put(form == 2), balance(two))))


_day = "strftime(txn_date, '%d-%b-%Y')"
_amount = "format('{:,.2f}', CAST(greatest(true_debit, true_credit) AS DOUBLE))"
_out = f"CAST(true_debit AS DOUBLE) AS debit, CAST(true_credit AS DOUBLE) AS credit, CAST(true_balance + {LIFT} AS DOUBLE) AS balance"


@query("lay_38_zone_rows", f"""WITH {LEDGER_SQL} SELECT stmt_id AS file_id, page_no, 2 * row_seq + CASE WHEN event_id % 5 IN (1, 2) THEN 1 ELSE 0 END AS line_id, {_day} AS date_raw, {_day} AS value_date,
 CASE event_id % 5 WHEN 1 THEN {_day} || ' ' || narration || ' ' || {_amount} WHEN 2 THEN '' ELSE narration END AS description, {_out} FROM true_ledger WHERE true_debit <> 0 OR true_credit <> 0""")
def _(spark, sf_dir):
    openings = true_ledger(spark, sf_dir).groupBy(F.col("stmt_id").alias("file_id")).agg((F.min("opening") + LIFT).alias("opening_balance"))
    out = zones.zone_rows(scanned_words(spark, sf_dir), openings)
    return plain(out.withColumn("line_id", F.col("line_id").cast("long")), "file_id", "page_no", "line_id", "date_raw", "value_date", "description", "debit", "credit", "balance")


#: The header of pages with amount lines.
HEAD = [("TRANS", 35.9, 63.7), ("DATE", 66.1, 87.9), ("VALUE", 100.1, 127.0), ("DATE", 129.5, 151.3), ("NARRATION", 197.2, 245.5), ("DEBIT", 343.9, 368.1), ("CREDIT", 425.8, 456.3), ("BALANCE", 507.0, 545.2)]


def amount_line_words(spark, sf_dir) -> DataFrame:
    """Twenty rows a page: the text above the amounts; the date with them, above them, or its year below them; a value date with every
    fourth; a second amount with every sixth; text below with every fifth, which belongs to the next row."""
    rows = true_ledger(spark, sf_dir)
    n, k, day = F.col("event_id"), (F.col("row_seq") - 1) % 20, F.date_format("txn_date", "dd-MMM-yyyy")
    base, debit, amount = 115 + 30 * k, F.col("true_debit") > 0, _money(F.greatest("true_debit", "true_credit"))
    above = F.concat(F.array(_word(F.when(n % 3 == 1, F.substring(day, 1, 7)).when(n % 3 == 2, day), 33.7, 89.8)), _narration(165, 20))
    line = F.array(
        _word(F.when(n % 3 == 0, day), 33.7, 89.8), _word(F.when(n % 4 == 0, F.date_format(F.date_add("txn_date", 1), "dd-MMM-yyyy")), 97.4, 153.6), _word(F.when(debit, amount), 345.1, 395.1), _word(F.when(~debit, amount), 435.7, 480.1),
        _word(F.when(n % 6 == 5, "1.00"), 485.0, 495.0), _word(_money(F.col("true_balance") + LIFT), 515.1, 565.2),
    )
    below = F.array(_word(F.when(n % 3 == 1, F.substring(day, 8, 4)), 33.7, 55.9), _word(F.when(n % 5 == 0, F.concat(F.lit("tail"), n.cast("string"))), 165, 195))
    # A page's first row prints its header, so the ledger is read once.
    head = F.when(k == 0, F.array(*[_word(F.lit(t), a, b) for t, a, b in HEAD]))
    return _printed(rows, (F.lit(0), F.lit(100), head), (3 * k + 1, base, above), (3 * k + 2, base + 10, line), (3 * k + 3, base + 20, below))


_said = r"""trim(regexp_replace(regexp_replace(concat_ws(' ', lag(CASE WHEN event_id % 5 = 0 THEN 'tail' || event_id END) OVER page, narration), '\b(?:TRANS|VALUE|NARRATION|DEBIT|CREDIT|BALANCE|CHQ|NO)\b|\b20\d{2}\b', ' ', 'gi'), '\s+', ' ', 'g'), ' -|/')"""


@query("lay_36_amount_lines", f"""WITH {LEDGER_SQL}, v AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN strftime(txn_date + 1, '%d-%b-%Y') END AS own FROM true_ledger),
n AS (SELECT *, coalesce(own, lag(own) OVER page, lead(own) OVER page) AS near, {_said} AS description FROM v WINDOW page AS (PARTITION BY stmt_id, page_no ORDER BY row_seq)),
e AS (SELECT *, coalesce(last_value(near IGNORE NULLS) OVER file, first_value({_day}) OVER file) AS value_date FROM n WINDOW file AS (PARTITION BY stmt_id ORDER BY row_seq))
SELECT stmt_id AS file_id, page_no, (row_seq - 1) % 20 * 3 + 2 AS line_id, {_day} AS date_raw, value_date, description, {_out} FROM e
UNION ALL SELECT stmt_id, page_no, (row_seq - 1) % 20 * 3 + 2, {_day}, value_date, description, 0, 1, CAST(true_balance + {LIFT} AS DOUBLE) FROM e WHERE event_id % 6 = 5""")
def _(spark, sf_dir):
    out = zones.amount_lines(amount_line_words(spark, sf_dir))
    return plain(out.withColumn("line_id", F.col("line_id").cast("long")), "file_id", "page_no", "line_id", "date_raw", "value_date", "description", "debit", "credit", "balance")


CUTS = [("date", 0, 100), ("reference", 100, 200), ("description", 200, 400), ("debit", 400, 500), ("credit", 500, 600), ("balance", 600, 700)]
CELLS = [c for c, *_ in CUTS]
# Words of a line (text, left edge, right edge, the column the cuts gave it), and the cells a reader would write, in the order of the cuts.
SAMPLES = [
    ([("01-Jan-2024", 205, 245, "description"), ("REF123456", 250, 290, "description"), ("RENT", 300, 330, "description"), ("1,200.00", 440, 480, "debit"), ("9,000.00", 640, 690, "balance")], ["01-Jan-2024", "REF123456", "RENT", "1,200.00", "", "9,000.00"]),
    ([("01-Jan-2024", 10, 60, "date"), ("RENT", 210, 240, "description"), ("1,200.00", 330, 375, "description"), ("9,000.00", 640, 690, "balance")], ["01-Jan-2024", "", "RENT", "1,200.00", "", "9,000.00"]),
    ([("01-Jan-2024", 10, 60, "date"), ("RENT", 210, 240, "description"), ("1,200.00", 320, 365, "description"), ("9,000.00", 640, 690, "balance")], ["01-Jan-2024", "", "RENT 1,200.00", "", "", "9,000.00"]),
    ([("RENT", 210, 240, "description"), ("5.00", 450, 480, "debit"), ("70.00", 520, 590, "description"), ("9,000.00", 640, 690, "balance")], ["", "", "RENT", "5.00", "70.00", "9,000.00"]),
    ([("77", 395, 425, "description"), ("12,5", 430, 460, "description"), ("TO", 465, 480, "description")], ["", "", "77 TO", "12,5", "", ""]),
    ([("10.00", 480, 520, "description"), ("20.00", 485, 525, "description"), ("END", 530, 560, "description"), ("1.00", 640, 690, "balance")], ["", "", "END", "10.00", "20.00", "1.00"]),
    ([("BANK", 210, 240, "description"), ("REF77", 410, 440, "debit"), ("1,000.00", 445, 490, "debit"), ("12", 510, 530, "credit"), ("345", 535, 560, "credit"), ("8.", 640, 660, "balance"), ("50", 661, 680, "balance")], ["", "", "BANK", "1,000.00", "12345", "8."]),
    ([("5.00", 210, 240, "description"), ("X", 250, 270, "description"), ("5.00", 640, 680, "balance")], ["", "", "5.00 X", "", "", "5.00"]),
    ([("AB12", 205, 240, "description"), ("2024-01-02", 245, 300, "description"), ("7.00", 430, 470, "debit"), ("3.00", 530, 570, "credit")], ["", "", "AB12 2024-01-02", "7.00", "3.00", ""]),
    ([("1/2/24", 205, 240, "description"), ("'A12345", 245, 300, "description"), ("44", 600, 640, "description"), ("X", 650, 660, "description")], ["1/2/24", "'A12345", "X", "", "", "44"]),
]


def _list(values: list) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("lay_09_mended_cells", f"WITH {LEDGER_SQL} SELECT stmt_id AS file_id, page_no, row_seq AS line_id, " + ", ".join(f"{_list([want[k] for _, want in SAMPLES])}[event_id % {len(SAMPLES)} + 1] AS \"{c}\"" for k, c in enumerate(CELLS)) + " FROM true_ledger")
def _(spark, sf_dir):
    rows = true_ledger(spark, sf_dir)
    sample = lambda ws: F.array(*[F.struct(F.lit(t).alias("text"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"), F.lit(c).alias("col_name")) for t, a, b, c in ws])
    words = rows.select(F.col("stmt_id").alias("file_id"), "page_no", F.col("row_seq").alias("line_id"), F.posexplode(F.element_at(F.array(*[sample(ws) for ws, _ in SAMPLES]), (F.col("event_id") % len(SAMPLES) + 1).cast("int"))).alias("word_seq", "w")).select("file_id", "page_no", "line_id", F.col("word_seq").cast("long").alias("word_seq"), "w.*")
    cuts = F.array(*[F.struct(F.lit(c).alias("col_name"), F.lit(float(a)).alias("x_left"), F.lit(float(b)).alias("x_right")) for c, a, b in CUTS])
    edges = rows.select(F.col("stmt_id").alias("file_id"), "page_no").distinct().select("file_id", "page_no", F.explode(cuts).alias("c")).select("file_id", "page_no", "c.*")
    return repair.mended_cells(words, edges, CELLS)


_cell = "narration || CASE WHEN event_id % 3 = 0 THEN ', \"MAY\"' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN chr(10) || 'caf' || chr(233) ELSE '' END"


@query("src_02_quoted_cells", f"""WITH {LEDGER_SQL}, r AS (SELECT stmt_id AS file_id, row_seq AS row_idx, strftime(txn_date, '%d/%m/%Y') AS c0, {_cell} AS c1, format('{{:,.2f}}', CAST(debit AS DOUBLE)) AS c2, '5" x' AS c3, '' AS c4 FROM ledger
UNION ALL SELECT DISTINCT stmt_id, 0, 'Date', 'Details', 'Debit', 'Pipe', '' FROM ledger) SELECT *, 5 AS n FROM r""")
def _(spark, sf_dir):
    n = F.col("event_id")
    cell = F.concat("narration", F.when(n % 3 == 0, ', "MAY"').otherwise(""), F.when(n % 4 == 0, "\ncafé").otherwise(""))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    line = F.concat_ws(",", F.date_format("txn_date", "dd/MM/yyyy"), quoted(cell), quoted(_money(F.col("debit"))), F.lit('5" x'), F.lit(""))
    end = F.when(F.col("stmt_id") % 2 == 0, "\r\n").otherwise("\n")
    files = ledger(spark, sf_dir).groupBy("stmt_id").agg(F.array_sort(F.collect_list(F.struct("row_seq", line.alias("line")))).alias("ls"))
    text = F.concat(F.lit("Date,Details,Debit,Pipe,"), end, end, F.concat_ws("", F.transform("ls", lambda r: F.concat(r["line"], end))))
    content = F.when(F.col("stmt_id") % 3 == 0, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    cells = tabular.cell_rows(tabular.decode_csv(files.select(F.col("stmt_id").alias("path"), content.alias("content"))))
    return cells.select("file_id", F.col("row_idx").cast("long").alias("row_idx"), *[F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(5)], F.size("cells").alias("n"))
