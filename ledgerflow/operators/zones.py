"""LAY-36 to LAY-38: entries from words by where they stand on the page, for pages whose rows can't be read column by column.

``words(file_id, page_no, line_id, word_seq, text, x0, x1, top)``: lines are numbered from the top of a page. What a line knows by
itself (dates, amounts, zones) is an expression over its own words; what it takes from other lines (a date printed above, an amount
that waits for its balance, the balance before) is a window over its page or statement, so no state is carried by loops.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerflow.functions.money import parse_money
from ledgerflow.functions.text import bind
from ledgerflow.operators.layout import PAGE

MONEY = "decimal(18,2)"
#: How dates, parts of dates and amounts are printed.
DATE = r"\b\d{2}-[A-Za-z]{3}-\d{4}\b"
NUMERIC_DATE = r"\b\d{2}-\d{2}-\d{4}\b"
YEAR_IN_FRONT = r"\b(20\d{2})-\b"
MONTH_DAY = r"\b(\d{2}-\d{2})\b"
DAY_MONTH = r"\b\d{2}-[A-Za-z]{3}-"
YEAR = r"\b20\d{2}\b"
AMOUNT_WORD = r"^(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}$"
AMOUNT_OR_WHOLE = r"^\(?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\)?$|^\(?\d+(?:\.\d{2})?\)?$"
#: Footers of pages with amount lines, without spaces.
FOOTERS = ["DOWNLOADAPP", "CHATWITHLEO", "OURWEBSITE", "HEADOFFICE", "PRIVACYPOLICY", "AFRICA'SGLOBALBANK", "CFC@UBAGROUP.COM"]


@dataclass(frozen=True)
class Zones:
    """Where a scanned layout prints what, in thousandths of the page's width."""

    description: tuple[float, float]
    amount: tuple[float, float]
    credit_from: float
    balance_from: float
    skipped: tuple[str, ...]
    #: Amounts right of ``credit_from`` count before those left of it, wherever they begin.
    by_side: bool = False
    #: Dates may be printed in numbers, or as a year and a month-day apart.
    split_dates: bool = False


#: The zones of two scanned layouts and the words of lines that are no entries.
SCANNED = {
    "uba": Zones((260, 560), (520, 830), 690, 830, ("TOTAL DEBIT", "TOTAL CREDIT", "OPENING BALANCE:", "CLOSING BALANCE:", "BANK STATEMENT")),
    "standard_chartered": Zones((200, 650), (660, 825), 760, 825, ("STATEMENT OF ACCOUNT", "TOTAL DEBIT", "TOTAL CREDIT", "OPENING BALANCE", "CLOSING BALANCE", "IMPORTANT NOTICE", "DEBITS CREDITS", "ENTRY VALUE"), by_side=True, split_dates=True),
}


def lines_of(words: DataFrame) -> DataFrame:
    """A row per line: ``ws``, its words from left to right, ``raw``, their text, and ``top``, their mean height."""
    g = words.groupBy(*PAGE, "line_id").agg(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text", "x1"))).alias("ws"), F.avg("top").alias("top"))
    return g.withColumn("raw", said("ws"))


def said(ws: str | Column) -> Column:
    return F.array_join(F.transform(ws, lambda w: w["text"]), " ")


def between(ws: str | Column, left: float | Column, right: float | Column) -> Column:
    """The words that begin in [left, right)."""
    return F.filter(ws, lambda w: (w["x0"] >= left) & (w["x0"] < right))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _dates(text: Column, last_year: Column | None) -> Column:
    """The entry's and the value date of a line as a struct, null without a date."""
    both = lambda a, b: F.struct(a.alias("date"), b.alias("value_date"))
    found = F.concat(_all(text, NUMERIC_DATE), _all(text, DATE)) if last_year is not None else _all(text, DATE)
    out = F.when(F.size(found) > 0, both(F.get(found, F.lit(0)), F.coalesce(F.get(found, F.lit(1)), F.get(found, F.lit(0)))))
    if last_year is None:
        return out
    years, days = _all(text, YEAR_IN_FRONT, 1), _all(text, MONTH_DAY, 1)
    first, second = F.get(days, F.lit(0)), F.coalesce(F.get(days, F.lit(1)), F.get(days, F.lit(0)))
    dated = lambda y, d: F.concat(y, F.lit("-"), d)
    year = F.get(years, F.lit(0))
    return out.when((F.size(years) > 0) & (F.size(days) > 0), both(dated(year, first), dated(F.coalesce(F.get(years, F.lit(1)), year), second))).when(last_year.isNotNull() & (F.size(days) > 0), both(dated(last_year, first), dated(last_year, second)))


def zone_rows(words: DataFrame, openings: DataFrame, layout: str | Zones = "uba", key: Sequence[str] = ("file_id",)) -> DataFrame:
    """LAY-38: entries of scanned pages. A line with a balance is an entry; its amount is the last one in the amount zone. A line with an
    amount and no balance waits: the next line with a balance and no amount of its own takes its amount, date and text, and then
    nothing waits until the next such line. The printed balance decides side and amount where it contradicts the zone.

    ``openings(key, opening_balance)``; without one the first entry keeps what its zones say. Entries without movement are left out.
    """
    z = SCANNED[layout] if isinstance(layout, str) else layout
    order = Window.partitionBy(*key).orderBy("page_no", "line_id")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = list(dict.fromkeys([*key, *PAGE]))
    upper = F.upper("raw")
    skip = F.exists(F.array(*map(F.lit, z.skipped)), lambda s: F.contains(upper, s))
    bare = lambda t: F.regexp_replace(t, "[—–−]", "")
    value = lambda t: F.regexp_replace(bare(t), ",", "").try_cast(MONEY)
    money = F.filter(F.transform(F.filter("ws", lambda w: bare(w["text"]).rlike(AMOUNT_WORD)), lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), value(w["text"]).alias("v"))), lambda m: m["v"] != 0)
    x = lines_of(words).where(~skip).withColumn("_money", money)
    if z.split_dates:
        x = x.withColumn("_year", F.nullif(F.regexp_extract("raw", YEAR_IN_FRONT, 1), F.lit(""))).where((F.size("_money") > 0) | F.col("_year").isNotNull() | F.col("raw").rlike(f"{DATE}|{NUMERIC_DATE}|{MONTH_DAY}"))
        x = x.withColumn("_dates", _dates(F.col("raw"), F.last("_year", ignorenulls=True).over(past))).drop("_year")
    else:
        x = x.withColumn("_dates", _dates(F.col("raw"), None)).where((F.size("_money") > 0) | F.col("_dates").isNotNull())
    x = x.withColumn("_dates", F.last("_dates", ignorenulls=True).over(past)).where(F.size("_money") > 0)
    inside = F.filter("_money", lambda m: (m["x1"] >= z.amount[0]) & (m["x1"] < z.amount[1]))
    if z.by_side:
        inside = F.concat(F.filter(inside, lambda m: m["x1"] < z.credit_from), F.filter(inside, lambda m: m["x1"] >= z.credit_from))
    x = x.withColumns({"_amount": F.try_element_at(inside, F.lit(-1)), "balance": F.try_element_at(F.filter("_money", lambda m: m["x0"] >= z.balance_from), F.lit(-1))["v"]}).where("_amount is not null or balance is not null")
    waits = F.col("balance").isNull()
    takes = F.col("balance").isNotNull() & F.col("_amount").isNull()
    # Islands end with each line that takes what waits: whatever waited before it is gone.
    x = x.withColumn("_isle", F.coalesce(F.sum(takes.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The last line that waits counts if it is of the same island: in the file's order too, so that lines are not sorted again by island.
    x = x.withColumn("_held", F.last(F.when(waits, F.struct(F.col("_amount").alias("amount"), F.col("raw").alias("raw"), F.col("_dates").alias("dates"), F.col("_isle").alias("isle"))), ignorenulls=True).over(past))
    x = x.where(~waits).withColumn("_held", F.when(takes & (F.col("_held.isle") == F.col("_isle")), F.col("_held")))
    trimmed = F.trim(said(between("ws", *z.description)))
    x = x.withColumns({
        "_a": F.coalesce(F.col("_amount"), F.col("_held.amount")), "description": F.coalesce(F.col("_held.raw"), F.trim(trimmed, F.lit(" |")) if z.by_side else trimmed),
        "_d": F.coalesce("_held.dates", "_dates"), "_before": F.lag("balance").over(order),
    })
    x = x.join(openings.select(*key, "opening_balance"), list(key), "left")
    v, zero = F.coalesce(F.col("_a.v"), F.lit(0).cast(MONEY)), F.lit(0).cast(MONEY)
    left = F.col("_a.x1") < z.credit_from
    debit, credit = F.when(left, v).otherwise(zero), F.when(left, zero).otherwise(v)
    moved = F.col("balance") - F.coalesce("_before", F.col("opening_balance").cast(MONEY))
    wrong = moved.isNotNull() & (moved != 0) & (F.col("_a").isNull() | (F.abs(moved - (credit - debit)) > 0.01))
    out = x.withColumns({"debit": F.when(wrong, F.greatest(-moved, zero)).otherwise(debit).cast(MONEY), "credit": F.when(wrong, F.greatest(moved, zero)).otherwise(credit).cast(MONEY)})
    return out.where("debit <> 0 or credit <> 0").select(*keys, "line_id", F.col("_d.date").alias("date_raw"), F.col("_d.value_date").alias("value_date"), "description", "debit", "credit", "balance")


# --- amount lines ----------------------------------------------------------------------------------------------------


def header_zones(lines: DataFrame) -> DataFrame:
    """LAY-36: ``lines`` with ``_zones``, the zones that a full header line gives: date, value date, text, amounts and balance."""
    any_of = lambda t, ks: F.exists(F.array(*map(F.lit, ks)), lambda k: F.contains(t, k))
    text, debit, credit = ("NARRATION", "REMARKS", "DETAILS", "DESCRIPTION"), ("DEBIT", "WITHDRAWAL"), ("CREDIT", "DEPOSIT", "LODGEMENT")
    full = bind(F.upper("raw"), lambda t: F.contains(t, F.lit("TRANS")) & F.contains(t, F.lit("VALUE")) & F.contains(t, F.lit("BALANCE")) & any_of(t, text) & any_of(t, debit) & any_of(t, credit))
    # Few lines are headers: words are looked at on these only.
    word = lambda ks, k=0: F.when(F.col("_head"), F.get(F.filter("ws", lambda w: any_of(F.upper(w["text"]), ks)), F.lit(k)))
    heads = lines.withColumn("_head", full).withColumns({"_t": word(("TRANS",)), "_v": word(("VALUE",)), "_n": word(text), "_d": word(debit), "_c": word(credit), "_b": word(("BALANCE",)), "_w": word(("DATE",), 1)})
    x = lambda c: F.col(f"{c}.x0").cast("double")
    value_right = F.least(F.when(F.col("_w").isNotNull(), F.col("_w.x1") + 8).otherwise(x("_n") - 6), x("_n") - 4)
    zones = F.struct(
        F.col("top").alias("header_top"), F.greatest(x("_t") - 10, F.lit(0.0)).alias("date_left"), (x("_v") - 4).alias("date_right"), (x("_v") - 4).alias("value_left"), value_right.alias("value_right"),
        F.greatest(value_right - 6, F.lit(150.0)).alias("text_left"), (x("_d") - 8).alias("text_right"), (x("_d") - 30).alias("amount_left"), (x("_c") - 10).alias("debit_right"), (x("_b") - 10).alias("balance_left"),
    )
    given = F.expr(" and ".join(f"{c} is not null" for c in ("_t", "_v", "_n", "_d", "_c", "_b")))
    return heads.withColumn("_zones", F.when(given, zones)).drop("_head", "_t", "_v", "_n", "_d", "_c", "_b", "_w")


def amount_layout(lines: DataFrame) -> DataFrame:
    """LAY-36: per page the zones that its first full header line gives."""
    return header_zones(lines).where("_zones is not null").groupBy(*PAGE).agg(F.min_by("_zones", "line_id").alias("zones"))


def nearby_dates(lines: DataFrame, edges: dict[str, tuple[str, str]], window: WindowSpec) -> DataFrame:
    """LAY-37: ``lines`` with the date printed between two zone edges, for each name in ``edges``: in the row itself; else a day and month
    in it or up to three rows above, with the year nearest to where they stand or within three rows below; else a whole date within three
    rows, above first. What a row shows is read once and then looked at from the rows around."""
    found = lambda t, p: F.get(_all(t, p), F.lit(0))
    seen = lambda t: F.struct(found(t, DATE).alias("full"), found(t, DAY_MONTH).alias("part"), found(t, YEAR).alias("year"))
    shown = {name: bind(said(between("ws", F.col(f"zones.{a}"), F.col(f"zones.{b}"))), seen) for name, (a, b) in edges.items()}
    near = {k: f"_near{k + 3}" for k in range(-3, 4)}
    out = lines.withColumn(near[0], F.struct(*[c.alias(name) for name, c in shown.items()]))
    out = out.withColumns({near[k]: F.lag(near[0], -k).over(window) if k < 0 else F.lead(near[0], k).over(window) for k in near if k})

    def date(name: str) -> Column:
        at = lambda kind, k: F.col(f"{near[k]}.{name}.{kind}")
        tries = [at("full", 0)]
        for k in (0, -1, -2, -3):
            years = F.coalesce(*[at("year", y) for y in dict.fromkeys([k, k + 1, k + 2, 0, 1, 2, 3])])
            tries.append(F.concat(at("part", k), years))
        return F.coalesce(*tries, *[at("full", k) for k in (-1, 1, -2, 2, -3, 3)])

    return out.withColumns({name: date(name) for name in edges}).drop(*near.values())


def clean_text(text: Column) -> Column:
    """Header words, dates and years out of an entry's text."""
    t = F.regexp_replace(text, r"(?i)\bTRANS\b|\bVALUE\b|\bNARRATION\b|\bDEBIT\b|\bCREDIT\b|\bBALANCE\b|\bCHQ\b|\bNO\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, DATE, " "), YEAR, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "), F.lit(" -|/"))


def amount_lines(words: DataFrame, bottom: float = 735.0, reach: float = 22.0) -> DataFrame:
    """LAY-36, LAY-37: every amount on a line that bears a balance is an entry of its own, debit or credit by the boundary that the
    header gives. Dates are looked for around the line, else the last one counts. The text is that of the lines above up to the
    last amount line, if within ``reach``, and of the line itself.

    Gives file_id, page_no, line_id, word_seq, date_raw, value_date, description, debit, credit, balance and raw_text.
    """
    page = Window.partitionBy(*PAGE).orderBy("line_id")
    file = Window.partitionBy("file_id").orderBy("page_no", "line_id")
    past = file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A page's lines are read and sorted once, also for the windows over its file; the header is among them.
    lines = header_zones(lines_of(words)).withColumn("zones", F.first("_zones", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    noise = bind(F.replace(F.upper("raw"), F.lit(" "), F.lit("")), lambda t: F.exists(F.array(*map(F.lit, FOOTERS)), lambda m: F.contains(t, m)))
    body = lines.where((F.col("top") > F.col("zones.header_top") + 6) & (F.col("top") <= bottom) & ~noise)
    value = lambda w: parse_money(w["text"], "bank").cast(MONEY)
    amounts = lambda a, b: F.filter(between("ws", F.col(f"zones.{a}"), b), lambda w: F.trim(w["text"]).rlike(AMOUNT_OR_WHOLE))
    body = nearby_dates(body, {"_date": ("date_left", "date_right"), "_value": ("value_left", "value_right")}, page)
    body = body.withColumns({"_text": said(between("ws", F.col("zones.text_left"), F.col("zones.text_right"))), "_balance": F.try_element_at(amounts("balance_left", F.lit(1000.0)), F.lit(-1)), "_edge": F.col("zones.debit_right")})
    body = body.withColumn("_entries", F.when(F.col("_balance").isNotNull(), amounts("amount_left", F.col("zones.balance_left")))).drop("ws", "zones")
    body = body.withColumn("_bears", F.coalesce(F.size("_entries") > 0, F.lit(False)))
    body = body.withColumn("_isle", F.coalesce(F.sum(F.col("_bears").cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Only lines that bear amounts hand on their dates.
    body = body.withColumn("date_raw", F.last(F.when(F.col("_bears"), F.col("_date")), ignorenulls=True).over(past))
    # Without any value date so far, the first entry's date stays the value date.
    body = body.withColumn("value_date", F.coalesce(F.last(F.when(F.col("_bears"), F.col("_value")), ignorenulls=True).over(past), F.first(F.when(F.col("_bears"), F.col("date_raw")), ignorenulls=True).over(past)))
    # All lines of an island but the last are text above it.
    above = Window.partitionBy(*PAGE, "_isle").orderBy("line_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = body.withColumn("_above", F.collect_list(F.struct("line_id", "top", "_text")).over(above)).where("_bears")
    cut = F.array_max(F.transform(F.filter("_above", lambda r: F.col("top") - r["top"] > reach), lambda r: r["line_id"]))
    near = bind(cut, lambda c: F.filter("_above", lambda r: (r["_text"] != "") & (c.isNull() | (r["line_id"] > c))))
    text = clean_text(F.array_join(F.transform(near, lambda r: r["_text"]), " "))
    each = body.select(*PAGE, "line_id", "date_raw", "value_date", text.alias("description"), value(F.col("_balance")).alias("balance"), F.col("raw").alias("raw_text"), "_edge", F.explode("_entries").alias("_w"))
    left, v, zero = F.col("_w.x1") <= F.col("_edge"), value(F.col("_w")), F.lit(0).cast(MONEY)
    return each.select(*PAGE, "line_id", F.col("_w.word_seq").alias("word_seq"), "date_raw", "value_date", "description", F.when(left, v).otherwise(zero).alias("debit"), F.when(left, zero).otherwise(v).alias("credit"), "balance", "raw_text")
