"""SRC: landing gates, delimited files, cell tables, piped and JSON rows, and printed lines, as tables of many files at once.

Cell tables have one row per source row: ``file_id``, ``row_idx`` from 0 and ``cells array<string>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions.dates import smart_date
from ledgerflow.functions.money import SIGNED, parse_money

#: Landing extensions with the bytes their files begin with, and the size limit.
MAGIC = {"pdf": "25504446", "xlsx": "504B0304", "xls": "D0CF11E0", "csv": ""}
MOST_BYTES = 20 << 20
#: Summary and header words of printed rows.
SUMMARY = r"(?i)^\s*(total|opening balance|closing balance|brought forward|carried forward|page \d+)"
#: Header words of the eight universal fields, tried in order.
UNIVERSAL = {
    "date": ["transaction date", "trans date", "txn date", "tran date", "posting date", "date"],
    "value_date": ["value date", "val date", "value dt"],
    "description": ["description", "remarks", "narration", "transaction details", "particulars", "transaction description", "details", "payment details", "beneficiary", "narrative"],
    "reference": ["reference", "reference no", "ref no", "cheque no", "chq no"],
    "branch": ["originating branch", "branch", "channel"],
    "debit": ["debit", "withdrawal", "dr amount", "debit amount", "dr"],
    "credit": ["credit", "lodgement", "deposit", "cr amount", "credit amount", "cr"],
    "balance": ["balance", "running balance", "available balance"],
}
#: Names of fields in JSON rows.
ALIASES = {"date": ["date", "transaction_date", "txn_date"], "description": ["description", "narration", "details"], "debit": ["debit", "withdrawal", "dr"], "credit": ["credit", "deposit", "cr"], "balance": ["balance", "running_balance"]}


def landing_gate(files: DataFrame) -> DataFrame:
    """SRC-01: ``path, content, length`` (a binaryFile scan) -> verdict per file: ok, or the first test it fails."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    good = F.lit(False)
    for e, magic in MAGIC.items():
        good = good | ((ext == e) & head.startswith(magic))
    nul = (ext == "csv") & F.hex(F.substring("content", 1, 4096)).rlike("^(..)*00")
    verdict = F.when(~ext.isin(list(MAGIC)), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when(~good, "content").when(nul, "binary").otherwise("ok")
    return files.select("path", "length", verdict.alias("verdict"))


def decode_csv(files: DataFrame) -> DataFrame:
    """SRC-02: text of each file: UTF-8 where it is valid, else Latin-1 (which never fails)."""
    text = F.when(F.expr("is_valid_utf8(decode(content, 'ISO-8859-1')) and try_validate_utf8(cast(content as string)) is not null"), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("text"))


#: A field of a delimited record: quoted (quotes doubled inside, anything but a comma after it) or bare. All loops are possessive: a
#: record is read once from left to right, however long it is.
FIELD = r'(?:"(?:[^"]++|"")*+(?:"[^,\r\n]*+)?|[^",\r\n][^,\r\n]*+)?+'
RECORD = rf"{FIELD}(?:,{FIELD})*+(?:\r\n|\n|\r|\z)"


def split_records(text: Column) -> Column:
    """Records of a delimited text. A quote that begins a field holds commas and line breaks together until the quote that ends
    it; elsewhere a quote is a character like any other. A field that is never closed goes on to the end of the text."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "^\ufeff", ""), F.lit(RECORD), F.lit(0)), lambda r: F.regexp_replace(r, r"(?:\r\n|\n|\r)\z", ""))


def split_cells(record: Column) -> Column:
    """Cells of a record without their quotes, doubled quotes as one, outer white space trimmed."""
    raw = F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf",({FIELD})"), F.lit(0)), lambda c: F.substr(c, F.lit(2)))
    quoted = r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'
    bare = lambda c: F.concat(F.regexp_replace(F.regexp_extract(c, quoted, 1), '""', '"'), F.regexp_extract(c, quoted, 2))
    return F.transform(raw, lambda c: F.regexp_replace(F.when(c.startswith('"'), bare(c)).otherwise(c), r"^\s+|\s+$", ""))


def cell_rows(texts: DataFrame, file_id: str = "path", text: str = "text") -> DataFrame:
    """SRC-02: records of decoded files as cell rows, numbered without blank ones. A file is at most ``MOST_BYTES`` long."""
    records = F.filter(split_records(F.coalesce(text, F.lit(""))), lambda r: F.trim(r) != "")
    each = texts.select(F.col(file_id).alias("file_id"), F.posexplode(records).alias("row_idx", "record"))
    return each.select("file_id", "row_idx", split_cells(F.col("record")).alias("cells"))


def read_csv_folder(spark: SparkSession, path: str) -> DataFrame:
    """Cell rows of all good files under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    good = landing_gate(files).where("verdict = 'ok'").select("path")
    return cell_rows(decode_csv(files.join(good, "path", "left_semi")))


def field_of(cell: Column) -> Column:
    """SRC-04: the field that a header cell names, by the tabular keywords in order; null for none."""
    u = F.upper(F.coalesce(cell, F.lit("")))
    has = lambda *ks: F.exists(F.array(*map(F.lit, ks)), lambda k: F.contains(u, k))
    return (
        F.when(has("DATE") & ~has("VALUE"), "date").when(has("VALUE") & has("DATE"), "vdate").when(has("DESC", "REMARKS", "PARTICULAR", "NARRATION"), "desc")
        .when(has("DEBIT", "WITHDRAWAL"), "debit").when(has("CREDIT", "DEPOSIT", "LODGEMENT"), "credit").when(has("BALANCE"), "balance")
    )


def header_rows(cells: DataFrame, within: int = 20, least: int = 3) -> DataFrame:
    """SRC-03: per file the first of its first rows that names three fields, or -1 where the positions must be guessed."""
    hits = F.size(F.filter("cells", lambda c: field_of(c).isNotNull() & (field_of(c) != "vdate")))
    found = F.min(F.when((F.col("row_idx") < within) & (hits >= least), F.col("row_idx")))
    g = cells.groupBy("file_id").agg(found.alias("header_idx"), F.max(F.size("cells")).alias("width"))
    return g.where("header_idx is not null or width >= 5").select("file_id", F.coalesce("header_idx", F.lit(-1)).alias("header_idx"))


def header_map(cells: DataFrame, within: int = 20, least: int = 3) -> DataFrame:
    """SRC-04: (file_id, header_idx, field -> cell number); the last cell that names a field wins. One grouping by file keeps the cells of
    its header row; files without one get guessed places if they are wide enough."""
    hits = F.size(F.filter("cells", lambda c: field_of(c).isNotNull() & (field_of(c) != "vdate")))
    found = F.min_by(F.struct("row_idx", "cells"), F.when((F.col("row_idx") < within) & (hits >= least), F.col("row_idx")))
    g = cells.groupBy("file_id").agg(found.alias("h"), F.max(F.size("cells")).alias("width")).where("h is not null or width >= 5")
    g = g.withColumn("named", F.transform("h.cells", lambda c, i: F.struct(field_of(c).alias("f"), i.alias("i"))))
    guesses = {"date": 0, "vdate": None, "desc": 1, "debit": 3, "credit": 4, "balance": 5}
    at = lambda f: F.array_max(F.transform(F.filter("named", lambda x: x["f"] == f), lambda x: x["i"]))
    return g.select("file_id", F.coalesce("h.row_idx", F.lit(-1)).alias("header_idx"), *[F.when(F.col("h").isNotNull(), at(f)).otherwise(F.lit(p).cast("int")).alias(f) for f, p in guesses.items()])


def universal_map(cells: DataFrame) -> DataFrame:
    """SRC-05: per file and universal field the first cell of the header row that contains any of its words."""
    heads = cells.join(universal_header(cells), "file_id").where("row_idx = header_idx").select("file_id", F.posexplode("cells").alias("p", "cell"))
    has = lambda ks: F.exists(F.array(*map(F.lit, ks)), lambda k: F.contains(F.lower("cell"), k))
    return heads.groupBy("file_id").agg(*[F.min(F.when(has(ks), F.col("p"))).alias(f) for f, ks in UNIVERSAL.items()])


def universal_header(cells: DataFrame) -> DataFrame:
    """SRC-06: the first row whose joined text has date and balance."""
    text = F.lower(F.array_join("cells", " "))
    return cells.where(text.contains("date") & text.contains("balance")).groupBy("file_id").agg(F.min("row_idx").alias("header_idx"))


def project_rows(cells: DataFrame) -> DataFrame:
    """SRC-07: ledger rows below the header: fields by the map, amounts parsed, rows without text or movement left out."""
    at = lambda f: F.get("cells", F.col(f))
    rows = cells.join(header_map(cells), "file_id").where("row_idx > header_idx")
    amount = lambda f: parse_money(at(f), "tabular")
    out = rows.select("file_id", F.col("row_idx").alias("row_seq"), F.coalesce(at("date"), F.lit("")).alias("date_raw"), F.trim(F.coalesce(at("desc"), F.lit(""))).alias("description"), amount("debit").alias("debit"), amount("credit").alias("credit"), amount("balance").alias("balance"), F.lit("Unallocated").alias("category"))
    return out.where("(date_raw <> '' or description <> '') and (debit <> 0 or credit <> 0)")


def piped_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """SRC-08: six parts with a value date or five without; header and summary rows dropped."""
    parts = F.transform(F.split(line, r"\|"), lambda p: F.trim(p))
    rows = lines.withColumn("_p", parts).withColumn("_n", F.size("_p"))
    k = F.when(F.col("_n") >= 6, 1).otherwise(0)
    bare = F.lower(F.get("_p", F.lit(0))).contains("date") | F.get("_p", k + 1).rlike(SUMMARY)
    out = rows.where((F.col("_n") >= 5) & ~bare)
    money = lambda i: parse_money(F.get("_p", k + i), "capped")
    return out.withColumns({"date_raw": F.get("_p", F.lit(0)), "value_date_raw": F.when(F.col("_n") >= 6, F.get("_p", F.lit(1))), "description": F.get("_p", k + 1), "debit": money(2), "credit": money(3), "balance": money(4)}).drop("_p", "_n")


def json_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """SRC-09: fenced JSON arrays of objects with alias keys; rows without date or movement dropped."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?|```\s*$", "")), r"^\s+", "")
    each = texts.select(*[c for c in texts.columns if c != text], F.posexplode(F.from_json(bare, "array<map<string,string>>")).alias("row_seq", "m"))
    m = F.transform_keys("m", lambda k, v: F.lower(k))
    pick = lambda f: F.coalesce(*[F.nullif(F.try_element_at(F.col("m"), F.lit(a)), F.lit("")) for a in ALIASES[f]])
    each = each.withColumn("m", m)
    out = each.withColumns({"date_raw": pick("date"), "description": pick("description"), **{f: parse_money(pick(f), "capped") for f in ("debit", "credit", "balance")}}).drop("m")
    return out.where("date_raw is not null and (debit <> 0 or credit <> 0)")


DATES = r"\d{1,2}[-/][A-Za-z0-9]{2,3}[-/]\d{2,4}"


def anchored_lines(lines: DataFrame, key: Sequence[str] = ("file_id",)) -> DataFrame:
    """SRC-10: lines with two dates are rows: last amount is the balance, the one before the movement, its side from the
    balance's change; lines between go in front of the next row's text."""
    w = Window.partitionBy(*key).orderBy("line_no")
    days, sums = F.regexp_extract_all("line", F.lit(DATES), F.lit(0)), F.regexp_extract_all("line", F.lit(SIGNED), F.lit(0))
    x = lines.withColumns({"_d": days, "_m": sums}).withColumn("_anchor", (F.size("_d") >= 2) & (F.size("_m") >= 2))
    x = x.withColumn("_isle", F.coalesce(F.sum(F.col("_anchor").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", DATES, " "), SIGNED, " "))
    num = lambda i: F.regexp_replace(F.try_element_at("_m", F.lit(i)), ",", "").try_cast("decimal(18,2)")
    g = x.groupBy(*key, "_isle").agg(F.max(F.when(F.col("_anchor"), F.struct("line_no", F.get("_d", F.lit(0)).alias("date_raw"), num(-1).alias("balance"), num(-2).alias("amount")))).alias("a"), F.array_sort(F.collect_list(F.struct("line_no", bare.alias("t")))).alias("ts"))
    rows = g.where("a is not null").select(*key, "a.line_no", "a.date_raw", "a.balance", "a.amount", F.trim(F.regexp_replace(F.array_join(F.transform("ts", lambda s: s["t"]), " "), r"\s+", " ")).alias("description"))
    change = F.col("balance") - F.lag("balance").over(w)
    debit = F.coalesce(change < 0, F.lit(False))
    return rows.withColumns({"debit": F.when(debit, F.col("amount")).otherwise(0).cast("decimal(18,2)"), "credit": F.when(debit, 0).otherwise(F.col("amount")).cast("decimal(18,2)")}).drop("amount")


def gap_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """SRC-11: parts two or more spaces apart, a day-first date in front: two amounts are movement and balance, three or
    more are debit, credit and, last, balance."""
    x = lines.withColumn("_p", F.split(F.trim(line), r"\s{2,}")).where((F.size("_p") >= 4) & F.get("_p", F.lit(0)).rlike(r"^\d{2}/\d{2}/\d{4}$"))
    x = x.withColumn("_m", F.filter(F.slice("_p", 3, 20), lambda p: p.rlike(r"^-?[\d,]+\.\d{2}$")))
    num = lambda i: F.regexp_replace(F.try_element_at("_m", F.lit(i)), ",", "").try_cast("double")
    two, n = F.size("_m") == 2, F.size("_m")
    debit = F.when(two & (num(1) > 0), num(1)).when(n >= 3, num(1)).otherwise(0.0)
    credit = F.when(two & (num(1) < 0), -num(1)).when(n >= 3, num(2)).otherwise(0.0)
    return x.where("size(_m) >= 2").withColumns({"date_raw": F.get("_p", F.lit(0)), "description": F.get("_p", F.lit(1)), "debit": debit, "credit": credit, "balance": num(-1)}).drop("_p", "_m")


def positional_rows(cells: DataFrame) -> DataFrame:
    """SRC-12: first cell date, last three debit, credit, balance, the cells between are the text."""
    last = lambda i: parse_money(F.try_element_at("cells", F.lit(i)), "ledger")
    rows = cells.where(F.size("cells") >= 5).withColumn("date_raw", smart_date(F.get("cells", F.lit(0)))).where("date_raw is not null")
    middle = F.array_join(F.filter(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 4, F.lit(0))), lambda c: F.trim(c) != ""), " ")
    return rows.select("file_id", "row_idx", "date_raw", middle.alias("description"), last(-3).alias("debit"), last(-2).alias("credit"), last(-1).alias("balance"))


def layout_rows(cells: DataFrame) -> DataFrame:
    """SRC-13: two printed layouts told apart by the header row: with a value date in second place, or without."""
    heads = cells.join(universal_header(cells), "file_id").where("row_idx = header_idx").select("file_id", "header_idx", F.lower(F.get("cells", F.lit(1))).contains("value").cast("int").alias("s"))
    rows = cells.join(heads, "file_id").where("row_idx > header_idx")
    money = lambda i: parse_money(F.get("cells", F.col("s") + i), "ledger")
    return rows.select("file_id", "row_idx", F.get("cells", F.lit(0)).alias("date_raw"), F.get("cells", F.col("s") + 1).alias("description"), money(2).alias("debit"), money(3).alias("credit"), money(4).alias("balance"))


def continued_rows(cells: DataFrame) -> DataFrame:
    """SRC-14: dated rows are entries; undated rows add their text to the entry before; text before any entry is carried
    into the first; amounts are the first line of their cell."""
    w = Window.partitionBy("file_id").orderBy("row_idx")
    first_line = lambda i: F.split(F.coalesce(F.get("cells", F.lit(i)), F.lit("")), "\n")[0]
    x = cells.withColumn("_dated", F.get("cells", F.lit(0)).rlike(r"^\d{1,2}[-/]")).withColumn("_isle", F.greatest(F.sum(F.col("_dated").cast("int")).over(w), F.lit(1)))
    g = x.groupBy("file_id", "_isle").agg(F.min(F.when(F.col("_dated"), F.struct("row_idx", F.get("cells", F.lit(0)).alias("date_raw"), *[parse_money(first_line(i), "ledger").alias(n) for i, n in ((2, "debit"), (3, "credit"), (4, "balance"))]))).alias("a"), F.array_sort(F.collect_list(F.struct("row_idx", F.trim(F.coalesce(F.get("cells", F.lit(1)), F.lit(""))).alias("t")))).alias("ts"))
    text = F.array_join(F.filter(F.transform("ts", lambda s: s["t"]), lambda t: t != ""), " ")
    return g.where("a is not null").select("file_id", "a.row_idx", "a.date_raw", text.alias("description"), "a.debit", "a.credit", "a.balance")
