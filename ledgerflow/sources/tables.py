"""SRC-13, SRC-14: tables of pages whose columns are found by their header, also where cells are padded, shifted or go on below.

``cells(file_id, row_idx, cells)``; a file's (or page's) rows are numbered from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.dates import smart_date
from ledgerflow.functions.money import parse_money
from ledgerflow.operators.repair import looks_like_date
from ledgerflow.sources.tabular import UNIVERSAL

#: The places of the fields in three printed layouts.
FIELDS = ("date", "desc", "ref", "vdate", "debit", "credit", "balance")
LAYOUTS = {"details": (0, 1, 2, 3, 4, 5, 6), "branches": (0, 7, 2, 1, 3, 4, 5), "padded": (0, 1, 3, 5, 6, 8, 9)}
PADDED_CELLS = (2, 4, 7)
#: Entry dates, references and rows without entries of continued tables; the places of fields where no header says.
ENTRY_DATE = r"^\d{2}-[A-Za-z]{3}-\d{4}$"
REFERENCE = r"(?i)REF(?:NO)?[:.]?\s*[A-Z0-9]+"
NO_ENTRY = ["OPENING BALANCE", "CLOSING BALANCE", "BROUGHT FORWARD", "TRANSACTION DATE"]
GUESSED = {"date": 0, "desc": 1, "vdate": 2, "debit": 3, "credit": 4, "balance": 5}
AMOUNTS = ("debit", "credit", "balance")
NEIGHBOURS = (-1, 1, 2, -2)


def _said(cells: Column) -> Column:
    return F.array_join(F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != ""), " ")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def layout_rows(cells: DataFrame) -> DataFrame:
    """SRC-13: rows of tables in one of two printed layouts, told apart by a header in the first two rows, with rows of ten cells that
    hold empty columns between. Banners, headers, rows without date and rows that are too short are left out."""
    said = F.upper(_said(F.col("cells")))
    has = lambda w: F.contains(said, F.lit(w))
    heads = cells.where((F.col("row_idx") < 2) & has("DATE") & (has("DETAILS") | has("REMARKS")))
    heads = heads.groupBy("file_id").agg(F.min("row_idx").alias("header_idx"), F.min_by(has("REMARKS") & has("ORIGINATING"), "row_idx").alias("branches"))
    rows = cells.join(heads, "file_id", "left").where(F.col("header_idx").isNull() | (F.col("row_idx") > F.col("header_idx")))
    rows = rows.withColumn("cells", F.transform("cells", lambda c: _stripped(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))))
    at = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    empty = F.lit(True)
    for k in PADDED_CELLS:
        empty = empty & (at(k) == "")
    layout = F.when((F.size("cells") >= 10) & empty, "padded").when(F.coalesce("branches", F.lit(False)), "branches").otherwise("details")
    rows = rows.withColumn("layout", layout)
    field = lambda f: F.coalesce(*[F.when(F.col("layout") == n, at(p[FIELDS.index(f)])) for n, p in LAYOUTS.items()])
    needed = F.coalesce(*[F.when(F.col("layout") == n, F.lit(max(p))) for n, p in LAYOUTS.items()])
    bare = (at(0) != "") & ~at(0).rlike("Date|Opening|Balance")
    rows = rows.where(bare & (F.size("cells") > needed) & looks_like_date(field("date")))
    money = lambda f: parse_money(field(f), "ledger")
    return rows.select(
        "file_id", "row_idx", "layout", smart_date(field("date")).alias("date_raw"), F.when(field("desc") == "", "No Description").otherwise(field("desc")).alias("description"), field("ref").alias("reference"),
        F.when(field("vdate") != "", smart_date(field("vdate"))).alias("value_date"), money("debit").alias("debit"), money("credit").alias("credit"), money("balance").alias("balance"),
    )


def _columns_of(header: Column) -> dict[str, Column]:
    """Where a header puts each field: by its words, else from the right for amounts and from the left for the rest."""
    n = F.size(header)
    low = F.transform(header, lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    named = lambda f: F.nullif(F.array_position(F.transform(low, lambda c: F.exists(F.array(*map(F.lit, UNIVERSAL[f])), lambda k: F.contains(c, k))), F.lit(True)), F.lit(0)) - 1
    wordy = F.filter(F.transform(F.slice(header, 2, 3), lambda c, i: F.struct(_stripped(F.coalesce(c, F.lit(""))).alias("c"), (i + 1).alias("i"))), lambda s: (s["c"] != "") & ~F.substring(s["c"], 1, 5).rlike(r"\d"))
    fall = {"date": F.lit(0), "desc": F.coalesce(F.get(wordy, F.lit(0))["i"], F.lit(1)), "vdate": F.when(n > 2, 2), "debit": F.when(n > 3, n - 3), "credit": F.when(n > 2, n - 2), "balance": n - 1}
    source = {"desc": "description", "vdate": "value_date"}
    return {f: F.coalesce(named(source.get(f, f)).cast("int"), fall[f].cast("int")) for f in GUESSED}


def continued_table_rows(cells: DataFrame) -> DataFrame:
    """SRC-14: entries of a file's tables, one a page: ``cells(file_id, page_no, row_idx, cells)``.

    The header is looked for in each page's first six rows. A dated row is an entry; if its text is empty, the nearest cell that is no
    date or amount gives it. A reference in the text goes to its front. An undated row adds its text to the entry before, over the
    end of a page too; text before any entry ends the first one's. Amounts are the first line of their cell; entries
    without movement are left out.
    """
    low = F.lower(F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " "))
    heading = (F.col("row_idx") < 6) & F.contains(low, F.lit("date")) & F.contains(low, F.lit("balance"))
    head = F.when(heading, F.struct("row_idx", F.struct(*[c.alias(f) for f, c in _columns_of(F.col("cells")).items()]).alias("at")))
    # In the order of the window over the file below, so that rows are read and sorted once.
    page = Window.partitionBy("file_id", "page_no").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = cells.withColumn("_head", head).withColumn("_head", F.min("_head").over(page)).where((F.col("_head").isNull() | (F.col("row_idx") > F.col("_head.row_idx"))) & (F.size("cells") >= 4))
    rows = rows.withColumn("at", F.coalesce("_head.at", F.struct(*[F.lit(k).alias(f) for f, k in GUESSED.items()]))).drop("_head")
    raw = lambda at: F.coalesce(F.when((at >= 0) & (at < F.size("cells")), F.get("cells", at)), F.lit(""))
    text = lambda at: _stripped(F.regexp_replace(raw(at), r"\s+", " "))
    first_line = lambda f: F.coalesce(F.get(F.filter(F.transform(F.split(raw(F.col(f"at.{f}")), "\n"), _stripped), lambda x: x != ""), F.lit(0)), F.lit(""))
    rows = rows.withColumns({"_date": text(F.col("at.date")), "_desc": text(F.col("at.desc")), "_value": text(F.col("at.vdate"))})
    dated = F.col("_date").rlike(ENTRY_DATE)
    taken = F.array(*[F.col(f"at.{f}") for f in ("date", "debit", "credit", "balance")])
    near = [F.when(~F.coalesce(F.array_contains(taken, F.col("at.desc") + k), F.lit(False)), F.nullif(text(F.col("at.desc") + k), F.lit(""))) for k in NEIGHBOURS]
    rows = rows.withColumn("_desc", F.when(dated & (F.col("_desc") == ""), F.coalesce(*near, F.lit(""))).otherwise(F.col("_desc")))
    said = F.upper(F.concat_ws(" ", "_date", "_desc"))
    entry = dated & ~F.exists(F.array(*map(F.lit, NO_ENTRY)), lambda k: F.contains(said, k))
    more = (F.col("_date") == "") & (F.col("_desc") != "")
    found = F.regexp_extract("_desc", f"({REFERENCE})", 1)
    whole = F.when(found != "", F.concat_ws(" ", _stripped(found), F.nullif(F.trim(F.regexp_replace("_desc", REFERENCE, ""), F.lit(" ,;")), F.lit("")))).otherwise(F.col("_desc"))
    x = rows.withColumns({"_entry": entry, "_ref": F.when(entry, _stripped(found)), "_text": F.when(entry, whole).otherwise(F.col("_desc")), "_keep": entry | more, **{f"_{f}": F.when(entry, first_line(f)) for f in AMOUNTS}})
    order = Window.partitionBy("file_id").orderBy("page_no", "row_idx")
    # Behind the window, so that the texts it asks for are not computed again to filter by them; the amounts are columns for the same reason.
    x = x.withColumn("_isle", F.sum(F.col("_entry").cast("int")).over(order)).where("_keep")
    amount = lambda f: parse_money(F.col(f"_{f}"), "ledger").alias(f)
    head = F.struct("page_no", "row_idx", F.coalesce(smart_date(F.col("_date")), F.col("_date")).alias("date_raw"), F.coalesce(smart_date(F.col("_value")), F.col("_value")).alias("value_date"), F.col("_ref").alias("reference"), *[amount(f) for f in AMOUNTS])
    part = F.struct((F.col("_isle") == 0).alias("early"), "page_no", "row_idx", "_text")
    g = x.groupBy("file_id", F.greatest("_isle", F.lit(1)).alias("_isle")).agg(F.max(F.when(F.col("_entry"), head)).alias("h"), F.array_sort(F.collect_list(part)).alias("parts")).where("h is not null")
    out = g.select("file_id", "h.page_no", "h.row_idx", "h.date_raw", "h.value_date", "h.reference", _stripped(F.array_join(F.transform("parts", lambda p: p["_text"]), " ")).alias("description"), "h.debit", "h.credit", "h.balance")
    return out.where("debit <> 0 or credit <> 0")
