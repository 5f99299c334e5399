"""LAY: from positioned words to rows, columns and entries, for many pages at once.

``words(file_id, page_no, word_seq, text, x0, x1, top)``; ``cuts(file_id, page_no, col_ord, col_name, x_left, x_right)``. Pages are
the unit of work: joins of words with cuts are equi-joins on the page with the interval as a residual test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ledgerflow.functions import dates
from ledgerflow.functions.money import SIGNED, TOKEN
from ledgerflow.functions.text import bind
from ledgerflow.operators import bank_profiles, scans
from ledgerflow.operators.folds import fold_rows

PAGE = ("file_id", "page_no")
#: Words of a header or a block of totals.
HEADER_NOISE = r"ADDRESS|ACCOUNT|STATEMENT|TOTAL|OPENING|CLOSING|CURRENT BAL|EFF\."
#: Header words of the detectors, one profile per layout, with the edge that anchors a column.
HEADER_WORDS = {"date": "x0", "narration": "x0", "description": "x0", "debit": "x1", "withdrawal": "x1", "credit": "x1", "deposit": "x1", "balance": "x1"}


def cluster_lines(words: DataFrame, tolerance: float = 3.0, look_back: int = 8) -> DataFrame:
    """LAY-01: words join the last line within the tolerance of its first word, else the newest of the last eight that is,
    else begin a line. Depends on all lines before, so a page's words are streamed in order; the state is the last eight lines."""

    def step(state: tuple, row: tuple) -> tuple:
        count, recent = state
        for back, top in enumerate(reversed(recent)):
            if abs(row[0] - top) <= tolerance:
                return state, count - 1 - back
        return (count + 1, [*recent, row[0]][-look_back:]), count

    return fold_rows(words, PAGE, ["top", "x0", "word_seq"], ["top"], lambda: (0, []), step, "line_id", IntegerType())


def bucket_lines(words: DataFrame, height: float = 3.0, down: bool = False) -> DataFrame:
    """LAY-02: line id from the rounded position, or from the one below it (``down``)."""
    place = F.col("top") / height
    return words.withColumn("line_id", (F.floor(place) if down else F.bround(place)).cast("int"))


def gap_lines(words: DataFrame, gap: float = 4.0) -> DataFrame:
    """LAY-03: a new line where the step to the next word down exceeds the gap; slow drift stays one line."""
    w = Window.partitionBy(*PAGE).orderBy("top", "x0", "word_seq")
    step = F.coalesce(F.col("top") - F.lag("top").over(w) >= gap, F.lit(False)).cast("int")
    return words.withColumn("_s", step).withColumn("line_id", F.sum("_s").over(w).cast("int")).drop("_s")


def assign(words: DataFrame, cuts: DataFrame | Sequence[tuple[int, str, float, float]], mode: str = "left", slack: float = 5.0) -> DataFrame:
    """LAY-04..08: the column of each word. ``left``: its left edge; ``edge``: the right edge for amounts; ``middle``: its middle, into
    every column that holds it; ``near``: middle, else right edge within the slack; ``overlap``: over half of it.

    The few cuts of a page are one array that its words meet in one join; the choice is an expression over it. The pages' arrays are
    hashed, so words stream by and are not sorted. A layout whose cuts are the same on all pages may be given as rows (col_ord,
    col_name, x_left, x_right); its words stay where they are.
    """
    shape = ("col_ord", "col_name", "x_left", "x_right")
    x0, x1 = F.col("x0"), F.col("x1")
    inside = lambda c, p, s=0.0: (c["x_left"] - s <= p) & (p < c["x_right"] + s)
    mid, edge = (x0 + x1) / 2, F.when(F.col("text").rlike(r"^[\d,.()\-]+$") & F.col("text").rlike(r"\d"), x1).otherwise(x0)
    tests = {
        "left": lambda c: inside(c, x0), "middle": lambda c: inside(c, mid), "near": lambda c: inside(c, mid) | inside(c, x1, slack),
        "overlap": lambda c: F.least(x1, c["x_right"]) - F.greatest(x0, c["x_left"]) > 0.5 * (x1 - x0),
    }
    if isinstance(cuts, DataFrame):
        few = cuts.groupBy(*PAGE).agg(F.collect_list(F.struct(*shape)).alias("_cuts"))
        met = words.join(few.hint("shuffle_hash"), list(PAGE))
    else:
        met = words.withColumn("_cuts", F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(shape, row, strict=True)]) for row in cuts]))
    # Whether a word is an amount is found once, not again for every cut.
    hits = bind(edge, lambda p: F.filter("_cuts", lambda c: inside(c, p))) if mode == "edge" else F.filter("_cuts", tests[mode])
    met = met.withColumn("_hits", hits).drop("_cuts")
    if mode == "middle":
        return met.select(*words.columns, F.explode("_hits").alias("_c")).select(*words.columns, F.col("_c.col_ord").alias("col_ord"), F.col("_c.col_name").alias("col_name"))
    second = (lambda c: (~inside(c, mid)).cast("int")) if mode == "near" else (lambda c: F.lit(0))
    best = F.array_min(F.transform("_hits", lambda c: F.struct(second(c).alias("second"), c["col_ord"].alias("col_ord"), c["col_name"].alias("col_name"))))
    return met.withColumn("_c", best).where("_c is not null").select(*words.columns, F.col("_c.col_ord").alias("col_ord"), F.col("_c.col_name").alias("col_name"))


def cells_of(assigned: DataFrame) -> DataFrame:
    """Text of each column of each line, words from left to right."""
    g = assigned.groupBy(*PAGE, "line_id", "col_name").agg(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text"))).alias("ws"))
    return g.select(*PAGE, "line_id", "col_name", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("cell"))


def wide(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per line with the named columns."""
    return cells.groupBy(*PAGE, "line_id").agg(*[F.max(F.when(F.col("col_name") == n, F.col("cell"))).alias(n) for n in names])


def wide_cells(assigned: DataFrame, names: Sequence[str]) -> DataFrame:
    """``wide`` of ``cells_of`` in one grouping: one row per line with the named columns, words from left to right."""
    g = assigned.groupBy(*PAGE, "line_id").agg(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text", "col_name"))).alias("_ws"))
    cell = lambda n: bind(F.filter("_ws", lambda w: w["col_name"] == n), lambda ws: F.when(F.size(ws) > 0, F.array_join(F.transform(ws, lambda w: w["text"]), " ")))
    return g.select(*PAGE, "line_id", *[cell(n).alias(n) for n in names])


def clean_number(cell: Column) -> Column:
    """LAY-10: of several tokens the rightmost with a point and a digit, else all joined."""
    parts = F.split(F.trim(cell), r"\s+")
    fit = F.filter(parts, lambda p: p.contains(".") & p.rlike(r"\d"))
    return F.when(F.size(parts) <= 1, F.trim(cell)).otherwise(F.coalesce(F.try_element_at(fit, F.lit(-1)), F.array_join(parts, "")))


def pick_money(cell: Column, which: int = 1) -> Column:
    """LAY-11: the first (1) or last (-1) money token of a cell."""
    return F.try_element_at(F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lit(which))


def pick_number(cell: Column) -> Column:
    """LAY-11: the first word of a cell with a digit and a comma or point; null without one."""
    return F.try_element_at(F.filter(F.split(F.trim(F.coalesce(cell, F.lit(""))), r"\s+"), lambda p: p.rlike(r"\d") & p.rlike("[,.]")), F.lit(1))


def header_line(lines: DataFrame, least: int = 3) -> DataFrame:
    """LAY-12: per page the line with most header words, the topmost of equals."""
    # Lines without any header word are not grouped, unless none is enough.
    hit = F.lower("text").isin(list(HEADER_WORDS))
    some = lines.where(hit) if least > 0 else lines
    g = some.groupBy(*PAGE, "line_id").agg(F.sum(hit.cast("int")).alias("hits")).where(F.col("hits") >= least)
    best = Window.partitionBy(*PAGE).orderBy(F.col("hits").desc(), "line_id")
    return g.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def cuts_from_header(lines: DataFrame, far: float = 10_000.0) -> DataFrame:
    """LAY-13, LAY-14: cuts halfway between the anchors of the header's words; text anchors at its left edge, amounts at
    the right one. Profiles are the rows of HEADER_WORDS."""
    edges = F.create_map(*[F.lit(x) for kv in HEADER_WORDS.items() for x in kv])
    w = lines.join(header_line(lines).select(*PAGE, "line_id"), [*PAGE, "line_id"]).withColumn("col_name", F.lower("text")).where(F.col("col_name").isin(list(HEADER_WORDS)))
    w = w.withColumn("_x", F.when(edges[F.col("col_name")] == "x1", F.col("x1")).otherwise(F.col("x0")))
    o = Window.partitionBy(*PAGE).orderBy("_x")
    half = lambda other: (F.col("_x") + other) / 2
    return w.select(*PAGE, (F.row_number().over(o) - 1).alias("col_ord"), "col_name", F.coalesce(half(F.lag("_x").over(o)), F.lit(-far)).alias("x_left"), F.coalesce(half(F.lead("_x").over(o)), F.lit(far)).alias("x_right"))


def best_cuts(candidates: DataFrame) -> DataFrame:
    """LAY-15: per page the candidate with most columns, two more if date, debit and credit are there, fifty if hinted."""
    has = lambda n: F.max((F.col("col_name") == n).cast("int"))
    g = candidates.groupBy(*PAGE, "candidate").agg((F.count("*") + F.when((has("date") + has("debit") + has("credit")) == 3, 2).otherwise(0) + F.when(F.max("hinted"), 50).otherwise(0)).alias("score"))
    return g.groupBy(*PAGE).agg(F.max_by("candidate", F.struct("score", -F.col("candidate"))).alias("candidate"), F.max("score").alias("score"))


def money_columns(words: DataFrame, gap: float = 40.0) -> DataFrame:
    """LAY-16: clusters of the right edges of money words, negative ones too (a gap over 40 parts them) and the usual edge of each;
    the last three are debit, credit and balance."""
    m = words.where(F.col("text").rlike(f"^{SIGNED}$")).withColumn("_x", F.round("x1").cast("int"))
    o = Window.partitionBy("file_id").orderBy("_x")
    d = m.select("file_id", "_x").groupBy("file_id", "_x").count()
    d = d.withColumn("_s", F.coalesce(F.col("_x") - F.lag("_x").over(o) > gap, F.lit(False)).cast("int")).withColumn("cluster", F.sum("_s").over(o))
    g = d.groupBy("file_id", "cluster").agg(F.max_by("_x", F.struct("count", -F.col("_x"))).alias("x1"), F.sum("count").alias("n"))
    back = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("cluster").desc()))
    return g.withColumn("col_name", F.element_at(F.array(F.lit("balance"), F.lit("credit"), F.lit("debit")), F.least(back, F.lit(3)))).withColumn("_b", back).where("_b <= 3").select("file_id", "col_name", "x1", "n")


def occupied_runs(words: DataFrame, least: int = 10) -> DataFrame:
    """LAY-17: maximal runs of occupied x positions wider than ten, as columns."""
    i = words.select(*PAGE, F.floor("x0").alias("a"), F.ceil("x1").alias("b")).distinct()
    o = Window.partitionBy(*PAGE).orderBy("a", "b")
    i = i.withColumn("_top", F.max("b").over(o.rowsBetween(Window.unboundedPreceding, -1)))
    i = i.withColumn("_r", F.sum(F.coalesce(F.col("a") > F.col("_top"), F.lit(False)).cast("int")).over(o))
    g = i.groupBy(*PAGE, "_r").agg(F.min("a").alias("x_left"), F.max("b").alias("x_right")).where(F.col("x_right") - F.col("x_left") > least)
    return g.select(*PAGE, (F.row_number().over(Window.partitionBy(*PAGE).orderBy("x_left")) - 1).alias("col_ord"), "x_left", "x_right")


def distinct_pages(pages: DataFrame, most: int = 30_000) -> DataFrame:
    """LAY-21: of pages with the same text (white space folded, first 30,000 characters), the first."""
    sign = F.xxhash64(F.substring(F.regexp_replace(F.trim("text"), r"\s+", " "), 1, most))
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy("file_id", sign).orderBy("page_no"))).where("_n = 1").drop("_n")


def statements(pages: DataFrame) -> DataFrame:
    """LAY-22: a new statement where a page's account number differs from the one before; pages without keep it."""
    w = Window.partitionBy("file_id").orderBy("page_no")
    x = pages.withColumn("_a", F.last("account_no", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_c", F.coalesce(F.col("_a") != F.lag("_a").over(w), F.lit(False)).cast("int"))
    return x.withColumn("stmt_id", F.sum("_c").over(w).cast("int")).drop("_a", "_c")


def fold_metadata(pages: DataFrame, names: Sequence[str], key: Sequence[str] = ("file_id", "stmt_id")) -> DataFrame:
    """LAY-23: the last non-empty value of each field over a statement's pages."""
    real = lambda c: F.nullif(F.trim(c), F.lit(""))
    return pages.groupBy(*key).agg(*[F.max_by(real(c), F.when(real(c).isNotNull(), F.col("page_no"))).alias(c) for c in names])


def first_and_last(pages: DataFrame, names: Sequence[str], key: Sequence[str] = ("file_id",)) -> DataFrame:
    """LAY-24: the last page's value, else the first page's."""
    return pages.groupBy(*key).agg(*[F.coalesce(F.nullif(F.max_by(c, "page_no"), F.lit("")), F.nullif(F.min_by(c, "page_no"), F.lit(""))).alias(c) for c in names])


def without_noise(rows: DataFrame, text: str = "text", reference: str | None = None, bank: str | None = None) -> DataFrame:
    """LAY-25, LAY-26, LAY-27: rows that are neither page furniture nor printed totals, of any bank or of the row's own."""
    out = rows.where(~bank_profiles.is_noise(F.col(text), F.col(reference) if reference else None) & ~bank_profiles.is_summary(F.col(text)))
    return out.where(~bank_profiles.is_bank_noise(F.col(bank), F.col(text))) if bank else out


def without_totals_echo(rows: DataFrame, meta: DataFrame, key: Sequence[str] = ("stmt_id",)) -> DataFrame:
    """LAY-28: undated rows that repeat a printed total go."""
    m = meta.select(*key, "statement_total_debit", "statement_total_credit")
    same = F.coalesce((F.col("debit") == F.col("statement_total_debit")) | (F.col("credit") == F.col("statement_total_credit")), F.lit(False))
    return rows.join(m, list(key), "left").where(~(F.col("date_raw").isNull() & same)).drop("statement_total_debit", "statement_total_credit")


def guarded_dates(rows: DataFrame, meta: DataFrame, key: Sequence[str] = ("stmt_id",), large: float = 1_000_000.0) -> DataFrame:
    """LAY-28: undated rows with an amount take the last date, if they look like entries: letters in the description or reference, a
    balance above zero or a large amount, and neither a page counter nor words of a header nor the printed totals again.
    ``rows(line_no, date_raw, description, reference, row_text, debit, credit, balance)``; null amounts count as none."""
    w = Window.partitionBy(*key).orderBy("line_no")
    m = meta.select(*key, F.col("statement_total_debit").alias("_d"), F.col("statement_total_credit").alias("_c"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    said = F.concat_ws(" ", "description", "reference")
    counter = F.trim(F.regexp_replace(F.coalesce("row_text", F.lit("")), r"\s+", " ")).rlike(r"^\d{1,4}$")
    header = F.upper(F.coalesce("row_text", F.lit(""))).rlike(HEADER_NOISE)
    echo = F.coalesce((F.col("_d") != 0) & (F.col("_c") != 0) & (F.abs(n("debit") - F.col("_d")) <= 0.01) & (F.abs(n("balance") - F.col("_c")) <= 0.01), F.lit(False))
    entry = said.rlike(r"\p{L}") | (n("balance") > 0) | (F.greatest(n("debit"), n("credit")) >= large)
    takes = F.col("date_raw").isNull() & ((n("debit") != 0) | (n("credit") != 0)) & ~counter & ~header & ~echo & entry
    dated = rows.withColumn("_l", F.last("date_raw", ignorenulls=True).over(w)).join(m, list(key), "left")
    return dated.withColumn("date_raw", F.when(takes, F.col("_l")).otherwise(F.col("date_raw"))).drop("_l", "_d", "_c")


def merge_lines(lines: DataFrame, key: Sequence[str] = ("file_id",)) -> DataFrame:
    """LAY-29: a line with a date and an amount or a balance is an entry; the lines after it add their text, and a date to an
    empty value date. Lines before the first entry are dropped."""
    w = Window.partitionBy(*key).orderBy("line_no")
    x = lines.withColumn("_a", F.col("date_raw").isNotNull() & (F.coalesce("amount", "balance").isNotNull())).withColumn("_i", F.sum(F.col("_a").cast("int")).over(w)).where("_i > 0")
    g = x.groupBy(*key, "_i").agg(F.max(F.when(F.col("_a"), F.struct("line_no", "date_raw", "value_date", "amount", "balance"))).alias("h"), F.min(F.when(~F.col("_a") & F.col("date_raw").isNotNull(), F.struct("line_no", "date_raw"))).alias("d"), F.array_sort(F.collect_list(F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.struct("line_no", "text")))).alias("ts"))
    return g.select(*key, "h.line_no", "h.date_raw", F.coalesce("h.value_date", "d.date_raw").alias("value_date"), "h.amount", "h.balance", F.array_join(F.transform("ts", lambda t: t["text"]), " ").alias("description"))


def mend_split_decimals(rows: DataFrame, cell: str, key: Sequence[str] = ("file_id",)) -> DataFrame:
    """LAY-30: ``12,345.`` with ``67`` in the next row, or one decimal with one more digit; the next cell is emptied."""
    w = Window.partitionBy(*key).orderBy("line_no")
    c, n = F.col(cell), F.lead(cell).over(w)
    fits = (c.rlike(r"^[\d,]+\.$") & n.rlike(r"^\d{2}$")) | (c.rlike(r"^[\d,]+\.\d$") & n.rlike(r"^\d$"))
    x = rows.withColumn("_m", F.coalesce(fits, F.lit(False))).withColumn("_j", F.when(F.col("_m"), F.concat(c, n)))
    return x.withColumn(cell, F.when(F.col("_m"), F.col("_j")).when(F.coalesce(F.lag("_m").over(w), F.lit(False)), "").otherwise(c)).drop("_m", "_j")


def mend_split_dates(rows: DataFrame, cell: str = "date_raw", key: Sequence[str] = ("file_id",)) -> DataFrame:
    """LAY-31: ``01-Nov-`` takes the year below it."""
    w = Window.partitionBy(*key).orderBy("line_no")
    n = F.lead(cell).over(w)
    return rows.withColumn(cell, F.when(F.col(cell).rlike(r"^\d{1,2}-[A-Za-z]{3}-$") & n.rlike(r"^20\d{2}$"), F.concat(cell, n)).otherwise(F.col(cell)))


def complete_split_dates(rows: DataFrame, cell: str = "date_raw", value_date: str = "value_date", text: str = "text", key: Sequence[str] = ("file_id",), order: str = "line_no", span: int = scans.SPAN) -> DataFrame:
    """LAY-31 in full: a row whose cell SCL-D1 can't read as a date, but with a day and month in its date cell (in its text, if that is empty), takes the
    year from the cell below if that is a bare year, which is emptied by that; else the first year in its value date and text.

    A year cell that was taken counts as empty, so its own text may hold the next day and month: runs of year cells are read as
    islands behind the row above them. Dates and cells without any day and month stay; without a year anywhere the day and
    month stand alone. Null cells count as empty; rows of equal order have no defined order.
    """
    c = F.trim(F.coalesce(cell, F.lit("")))
    of = lambda s: F.regexp_extract(s, r"\b(\d{1,2}-[A-Za-z]{3})-?\b", 1)
    whole = dates.smart_date(c).isNotNull()
    t = F.coalesce(text, F.lit(""))
    x = rows.withColumns({"_cell": c, "_year": c.rlike(r"^20\d{2}$"), "_whole": whole, "_in_text": of(t)})
    x = x.withColumn("_own", F.when(F.col("_whole"), "").when(F.col("_cell") == "", F.col("_in_text")).otherwise(of(F.col("_cell"))))
    # Whether a row takes the year below it, if its own cell was not taken (rows that begin an island) or was (years).
    x = x.withColumn("_takes", F.when(F.col("_year"), F.col("_in_text") != "").otherwise(F.col("_own") != ""))
    x = scans.scan(x, key, span, order, _island=("sum", (~F.col("_year")).cast("long")))
    island = Window.partitionBy(*key, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_taken", F.col("_year") & (F.col("_island") > 0) & F.coalesce(F.min("_takes").over(island), F.lit(False)))
    x = scans.scan(x, key, span, order, _below=("next", F.struct(F.col(order).alias("at"), F.when(F.col("_taken"), F.col("_cell")).alias("year"))))
    part = F.when(F.col("_taken"), F.col("_in_text")).otherwise(F.col("_own"))
    here = F.regexp_extract(F.concat_ws(" ", F.coalesce(value_date, F.lit("")), t), r"\b(20\d{2})\b", 1)
    year = F.coalesce(F.when(part != "", F.col("_below.year")), F.nullif(here, F.lit("")))
    out = F.when(part != "", F.concat_ws("-", part, year)).when(F.col("_taken"), "").otherwise(F.col(cell))
    return x.withColumn("_out", out).withColumn(cell, F.col("_out")).drop("_cell", "_year", "_whole", "_in_text", "_own", "_takes", "_island", "_taken", "_below", "_out", scans.PART)


def rescue_months(rows: DataFrame, key: Sequence[str] = ("file_id",)) -> DataFrame:
    """LAY-32: a row with an amount and only a month name takes its value date, if an entry precedes it."""
    w = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    bare = F.col("date_raw").rlike(r"^(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?$") & F.col("amount").isNotNull()
    return rows.withColumn("date_raw", F.when(bare & F.last("value_date", ignorenulls=True).over(w).isNotNull(), F.col("value_date")).otherwise(F.col("date_raw")))


def amount_from_right(rows: DataFrame, text: str = "text") -> DataFrame:
    """LAY-33: a dated row with a balance but no amount takes the second-last number, if the last is near the balance; signs count."""
    found = F.regexp_extract_all(text, F.lit(SIGNED), F.lit(0))
    at = lambda i: F.regexp_replace(F.try_element_at(found, F.lit(i)), ",", "").try_cast("decimal(18,2)")
    missing = F.col("date_raw").isNotNull() & F.col("amount").isNull() & (F.abs(at(-1) - F.col("balance")) < 1)
    return rows.withColumn("amount", F.when(missing, at(-2)).otherwise(F.col("amount")))


def carry_dates(rows: DataFrame, key: Sequence[str] = ("file_id",)) -> DataFrame:
    """LAY-34: undated rows with an amount take the last date."""
    w = Window.partitionBy(*key).orderBy("line_no")
    return rows.withColumn("date_raw", F.when(F.col("amount").isNotNull(), F.last("date_raw", ignorenulls=True).over(w)).otherwise(F.col("date_raw")))


def attribute_by_gap(lines: DataFrame, gap: float = 18.0) -> DataFrame:
    """LAY-35: undated text within the gap below an entry belongs to it, other text to the next one."""
    w = Window.partitionBy(*PAGE).orderBy("top")
    x = lines.withColumn("_k", F.sum(F.col("is_anchor").cast("int")).over(w)).withColumn("_y", F.last(F.when(F.col("is_anchor"), F.col("top")), ignorenulls=True).over(w))
    near = F.col("is_anchor") | F.coalesce(F.col("top") - F.col("_y") <= gap, F.lit(False))
    x = x.withColumn("entry", F.when(near, F.col("_k")).otherwise(F.col("_k") + 1))
    g = x.groupBy(*PAGE, "entry").agg(F.max("is_anchor").alias("real"), F.array_sort(F.collect_list(F.struct("top", "text"))).alias("ts"))
    return g.where("real").select(*PAGE, "entry", F.array_join(F.transform("ts", lambda t: t["text"]), " ").alias("description"))


def explode_amounts(lines: DataFrame, boundary: float) -> DataFrame:
    """LAY-36: each amount word of a line with a balance, negative ones too, is an entry; left of the boundary it is a debit."""
    m = lines.where(F.col("text").rlike(f"^{SIGNED}$"))
    last = F.max("x1").over(Window.partitionBy(*PAGE, "line_id"))
    n = F.count("*").over(Window.partitionBy(*PAGE, "line_id"))
    v = F.regexp_replace("text", ",", "").cast("decimal(18,2)")
    x = m.withColumns({"_l": last, "_n": n}).where("_n >= 2 and x1 < _l")
    return x.select(*PAGE, "line_id", "word_seq", F.when(F.col("x1") < boundary, v).otherwise(0).cast("decimal(18,2)").alias("debit"), F.when(F.col("x1") < boundary, 0).otherwise(v).cast("decimal(18,2)").alias("credit"))


def nearest_date(rows: DataFrame, key: Sequence[str] = ("file_id",)) -> DataFrame:
    """LAY-37: the row's date, else that of the nearest row within three (the one above first), else the last known."""
    w = Window.partitionBy(*key).orderBy("line_no")
    near = [f(c, k).over(w) for k in (1, 2, 3) for f, c in ((F.lag, "date_raw"), (F.lead, "date_raw"))]
    return rows.withColumn("nearest_date", F.coalesce("date_raw", *near, F.last("date_raw", ignorenulls=True).over(w)))


def attach_money(rows: DataFrame, key: Sequence[str] = ("file_id",)) -> DataFrame:
    """LAY-39: a dated row without money takes that of the undated row right below it, which goes."""
    w = Window.partitionBy(*key).orderBy("line_no")
    gives = F.col("date_raw").isNull() & F.col("amount").isNotNull() & (F.lag("date_raw").over(w).isNotNull()) & F.lag("amount").over(w).isNull()
    x = rows.withColumn("_g", F.coalesce(gives, F.lit(False))).withColumns({"_t": F.coalesce(F.lead("_g").over(w), F.lit(False)), "_a": F.lead("amount").over(w), "_b": F.lead("balance").over(w)})
    return x.where("not _g").withColumns({"amount": F.when(F.col("_t"), F.col("_a")).otherwise(F.col("amount")), "balance": F.when(F.col("_t"), F.col("_b")).otherwise(F.col("balance"))}).drop("_g", "_t", "_a", "_b")


def page_metadata(pages: DataFrame, text: str = "text") -> DataFrame:
    """LAY-40..42, 44, 45: printed fields of a page, each the first pattern that matches."""
    t = F.coalesce(text, F.lit(""))
    first = lambda *ps: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit("")) for p in ps])
    amount = lambda *ps: F.regexp_replace(first(*ps), ",", "").try_cast("decimal(18,2)")
    n = r"[:\s]+([\d,]+\.\d{2})"
    return pages.withColumns({
        "account_no": first(r"(?i)account (?:no|number)[.:\s]+(\d{10,12})"), "account_name": first(r"(?i)account name[:\s]+([A-Za-z .&]+?)(?:\n|\s{2,}|account|currency|$)"), "period": first(r"(?i)statement period[:\s]+([^\n]+)", r"(?i)\bperiod[:\s]+([^\n]+)"), "currency": F.when(t.rlike(r"(?i)\bUSD\b"), "USD").otherwise("NGN"),
        "statement_total_debit": amount(rf"(?i)total debits?{n}", rf"(?i)total withdrawals?{n}"), "statement_total_credit": amount(rf"(?i)total credits?{n}", rf"(?i)total lodgements?{n}"), "opening_balance": amount(rf"(?i)opening balance{n}"), "closing_balance": amount(rf"(?i)closing balance{n}"), "year": first(r"(?i)period[^\n]*?(20\d{2})", r"(20\d{2})").try_cast("int"),
    })


def largest_total(pages: DataFrame, text: str = "text", edge: int = 5) -> DataFrame:
    """LAY-43: the largest printed total debit and credit on a file's first and last five pages."""
    w = Window.partitionBy("file_id")
    x = pages.withColumns({"_a": F.row_number().over(w.orderBy("page_no")), "_z": F.row_number().over(w.orderBy(F.col("page_no").desc()))}).where((F.col("_a") <= edge) | (F.col("_z") <= edge))
    top = lambda s: F.max(F.regexp_replace(F.regexp_extract(text, rf"(?i)total {s}s?[:\s]+([\d,]+\.\d{{2}})", 1), ",", "").try_cast("decimal(18,2)"))
    return x.groupBy("file_id").agg(top("debit").alias("statement_total_debit"), top("credit").alias("statement_total_credit"))


def text_in_zone(words: DataFrame, left: float, right: float) -> DataFrame:
    """LAY-46: a line's text between two x positions, without dates and amounts."""
    z = words.where((F.col("x0") >= left) & (F.col("x0") < right) & ~F.col("text").rlike(f"^{TOKEN}$") & ~F.col("text").rlike(r"^\d{1,2}[-/]"))
    g = z.groupBy(*PAGE, "line_id").agg(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text"))).alias("ws"))
    return g.select(*PAGE, "line_id", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("description"))
