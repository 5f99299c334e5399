"""LAY-09: cells of a line mended by what they hold, where cuts of columns were off.

Each mend is a step over the line's own words, held as one array; a word that moves to another cell leaves the text, so no word is
used twice. Steps follow in a fixed order: a leading date, a leading reference, a trailing amount, then the nearest number for each
empty amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.layout import PAGE

#: Printed dates, amounts and numbers, the reach of the last two steps, and the columns of amounts.
DATES = [r"^\d{1,2}[-/.]\w{3,}[-/.]\d{2,4}$", r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$", r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$", r"^\s*\d{1,2}\s+\w{3,}\.?\s+\d{2,4}\s*$"]
AMOUNT, NUMBER = r"^-?[\d,]+\.\d{2}$", r"^-?[\d,]+(\.\d+)?$"
ORPHAN_REACH, SNAP_REACH = 30.0, 60.0
AMOUNTS = ("debit", "credit", "balance")


def looks_like_date(text: Column) -> Column:
    found = F.lit(False)
    for p in DATES:
        found = found | text.rlike(p)
    return (F.length(text) >= 6) & found


def looks_like_reference(text: Column) -> Column:
    bare = F.trim(F.trim(text), F.lit("'"))
    return (F.length(bare) >= 6) & bare.rlike(r"\d")


def _without(words: Column, index: Column) -> Column:
    """``words`` without the one at ``index`` (from 0)."""
    return F.concat(F.slice(words, F.lit(1), index), F.slice(words, index + 2, F.greatest(F.size(words) - index - 1, F.lit(0))))


def mended_cells(assigned: DataFrame, cuts: DataFrame, names: list[str], source: str = "description") -> DataFrame:
    """LAY-09: one row per line with the cells ``names``.

    ``assigned(file_id, page_no, line_id, word_seq, text, x0, x1, col_name)``, ``cuts(file_id, page_no, col_name, x_left, x_right)``.
    Of several words in an amount cell the rightmost with a point and a digit counts, else all of them joined.
    """
    edges = cuts.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("col_name", F.struct("x_left", "x_right")))).alias("_cuts"))
    word = F.struct("x0", "word_seq", "text", "x1", "col_name")
    lines = assigned.groupBy(*PAGE, "line_id").agg(F.array_sort(F.collect_list(word)).alias("_ws")).join(edges, list(PAGE))
    columns = list(dict.fromkeys([*names, source, "date", "reference", *AMOUNTS]))
    of = lambda c: F.filter("_ws", lambda w: w["col_name"] == c)
    x = lines.withColumns({f"_{c}": of(c) for c in columns})
    pool = F.col(f"_{source}")
    printed = lambda c: F.map_contains_key("_cuts", c)
    empty = lambda c: printed(c) & (F.size(f"_{c}") == 0)
    # A word's place is that of the rightmost word of the line with the same text.
    place = lambda w: F.try_element_at(F.filter("_ws", lambda o: o["text"] == w["text"]), F.lit(-1))

    def move(df: DataFrame, target: str, index: Column) -> DataFrame:
        """The word of the text at ``index`` (null: none) becomes the cell ``target``."""
        df = df.withColumn("_at", index)
        moved = F.when(F.col("_at").isNotNull(), F.array(F.get(pool, F.col("_at")))).otherwise(F.col(f"_{target}"))
        return df.withColumns({f"_{target}": moved, f"_{source}": F.when(F.col("_at").isNotNull(), _without(pool, F.col("_at"))).otherwise(pool)}).drop("_at")

    first = F.get(pool, F.lit(0))["text"]
    x = move(x, "date", F.when(empty("date") & looks_like_date(first), 0))
    x = move(x, "reference", F.when(empty("reference") & looks_like_reference(first), 0))
    last = F.try_element_at(pool, F.lit(-1))
    right = place(last)["x1"]
    reaches = lambda c: (right >= F.col("_cuts")[c]["x_left"] - ORPHAN_REACH) & (right <= F.col("_cuts")[c]["x_right"])
    orphan = last["text"].rlike(AMOUNT)
    x = x.withColumn("_side", F.when(orphan & empty("debit"), F.when(reaches("debit"), "debit")).when(orphan & empty("credit"), F.when(reaches("credit"), "credit")))
    for c in ("debit", "credit"):
        x = move(x, c, F.when(F.col("_side") == c, F.size(pool) - 1))

    def nearest(c: str) -> Column:
        """Which number of the text is nearest to the middle of column ``c``."""
        middle = (F.col("_cuts")[c]["x_left"] + F.col("_cuts")[c]["x_right"]) / 2
        each = F.transform(pool, lambda w, i: F.struct(F.abs((place(w)["x0"] + place(w)["x1"]) / 2 - middle).alias("d"), i.alias("i"), w["text"].rlike(NUMBER).alias("ok")))
        return F.array_min(F.transform(F.filter(each, lambda r: r["ok"] & (r["d"] < SNAP_REACH)), lambda r: F.struct(r["d"].alias("d"), r["i"].alias("i"))))["i"]

    for c in AMOUNTS:
        x = move(x, c, F.when(empty(c), nearest(c)))
    texts = lambda c: F.transform(f"_{c}", lambda w: w["text"])
    bare = lambda t: F.regexp_replace(t, " ", "")

    def cell(c: str) -> Column:
        if c not in AMOUNTS:
            return F.trim(F.array_join(texts(c), " "))
        pointed = F.try_element_at(F.filter(texts(c), lambda t: F.contains(t, F.lit(".")) & t.rlike(r"\d")), F.lit(-1))
        return F.when(F.size(f"_{c}") > 1, bare(F.coalesce(pointed, F.array_join(texts(c), "")))).otherwise(bare(F.array_join(texts(c), "")))

    return x.select(*PAGE, "line_id", *[cell(c).alias(c) for c in names])
