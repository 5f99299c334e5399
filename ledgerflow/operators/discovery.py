"""LAY-15 to LAY-17: columns of pages whose layout is not known: candidates judged, zones agreed on by the words themselves, columns
read off the page's profile.

All work is per page or file on what is few there: candidate cuts, distinct rounded positions, edges of occupied runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.layout import PAGE
from ledgerflow.operators.repair import looks_like_date

#: Columns of amounts, the detectors of one family of layouts and its hints, and the points that candidates score.
AMOUNT_NAMES = ["debit", "credit", "withdrawal", "withdrawals", "deposit", "deposits", "lodgement", "lodgements"]
FAMILY, FAMILY_HINTS, RIVAL = ["GTBank", "GTCO"], ["gtbank", "gtco"], "Access"
FULL_POINTS, HINT_POINTS, FAMILY_POINTS, RIVAL_POINTS = 2, 50, 10, -5
#: Fixed value: whole amounts count as well.
AMOUNT = r"^-?[\d,]+(?:\.\d{2})?$"
#: What header words say, tried in this order.
SIGNATURES = {
    "date": "DATE|DT|TIME",
    "description": "DESC|PARTICULARS|DETAILS|NARRATION|TRANSACTION|REMARKS|MEMO",
    "debit": "DEBIT|WITHDRAWAL|DR|WK|OUT",
    "credit": "CREDIT|DEPOSIT|CR|IN",
    "balance": "BALANCE|BAL",
    "amount": "AMOUNT|VALUE",
}
#: How far zones reach around the usual edges.
DATE_ZONE, AMOUNT_ZONE, CLUSTER_GAP, SCANNED_PAGES, LEAST_WIDTH = (-10, 50), (-30, 10), 40, 5, 10


def judged_cuts(candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """LAY-15: the candidate that each page takes, with its score.

    ``candidates(file_id, page_no, place, detector, col_name, x_left, x_right)``: ``place`` is the detector's turn; ``hints(file_id, hint)``.
    Cuts count if they are three or more, with a date and an amount, none empty or turned round. The hinted detector is taken
    whatever it scores; under a hint at the family, its better member is; else the best score, the earliest of equals.
    """
    has = lambda names: F.max(F.col("col_name").isin(names).cast("int")) == 1
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    turned = F.coalesce(finite("x_left") & finite("x_right") & (F.col("x_left") >= F.col("x_right")), F.col("x_left").isNull() | F.col("x_right").isNull())
    full = has(["date"]) & has(["debit"]) & has(["credit"])
    g = candidates.groupBy(*PAGE, "place", "detector").agg(F.countDistinct("col_name").alias("n"), (has(["date"]) & has(AMOUNT_NAMES) & (F.max(turned.cast("int")) == 0)).alias("sound"), full.alias("full"))
    g = g.where("sound and n >= 3").join(hints.select("file_id", F.lower(F.coalesce("hint", F.lit(""))).alias("hint")), "file_id", "left")
    hint = F.coalesce("hint", F.lit(""))
    named = (hint != "") & F.contains(hint, F.lower("detector"))
    kin, family = hint.isin(FAMILY_HINTS), F.col("detector").isin(FAMILY)
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = F.col("n") + points(F.col("full"), FULL_POINTS) + points(named, HINT_POINTS) + points(kin & family, FAMILY_POINTS) + points(kin & (F.col("detector") == RIVAL), RIVAL_POINTS)
    x = g.withColumn("score", score.cast("int"))
    rank = F.struct(F.when(named, 2).when(kin & family, 1).otherwise(0).alias("kind"), F.when(named, 0).otherwise(F.col("score")).alias("score"), (-F.col("place")).alias("turn"))
    return x.groupBy(*PAGE).agg(F.max_by(F.struct("detector", "score"), rank).alias("b")).select(*PAGE, "b.detector", "b.score")


def _usual(x: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent ``_x`` of each key, of equals the one met first; from rows ``(keys, _x, n, met)``."""
    return x.groupBy(*keys).agg(F.max_by("_x", F.struct(F.col("n"), (-F.col("met")).alias("turn"))).alias("_x"))


def consensus_zones(words: DataFrame) -> DataFrame:
    """LAY-16: zones of date, debit, credit and balance of each file, by what most words of its first five pages say: the usual left edge
    of dates, and the usual right edges of the amounts right of them, in clusters that a gap of more than 40 parts; the last
    three clusters count. Zones that no cluster gives are (0, 0); files without dates or amounts have none."""
    text = F.trim("text")
    # Pages are ranked, not words: words meet the few pages that count in a hash join, so they are never sorted.
    ranked = words.select(*PAGE).distinct().withColumn("_p", F.row_number().over(Window.partitionBy("file_id").orderBy("page_no")))
    first = words.join(ranked.where(F.col("_p") <= SCANNED_PAGES).select(*PAGE).hint("shuffle_hash"), list(PAGE), "left_semi")
    kind = F.when(looks_like_date(text), "date").when(text.rlike(AMOUNT), "amount")
    met = F.struct("page_no", "word_seq")
    place = F.when(kind == "date", F.bround("x0")).otherwise(F.bround("x1"))
    # Few distinct places are left of a file's words.
    seen = first.withColumn("_kind", kind).where("_kind is not null").groupBy("file_id", "_kind", place.alias("_x")).agg(F.count("*").alias("n"), F.min(met).alias("first"))
    seen = seen.withColumn("met", F.row_number().over(Window.partitionBy("file_id").orderBy("first"))).drop("first")
    dates = _usual(seen.where("_kind = 'date'"), ["file_id"]).select("file_id", F.col("_x").alias("_date"))
    amounts = seen.where("_kind = 'amount'").join(dates, "file_id").where(F.col("_x") > F.col("_date") + DATE_ZONE[1])
    o = Window.partitionBy("file_id").orderBy("_x")
    amounts = amounts.withColumn("_s", F.coalesce(F.col("_x") - F.lag("_x").over(o) > CLUSTER_GAP, F.lit(False)).cast("int")).withColumn("cluster", F.sum("_s").over(o))
    modes = _usual(amounts, ["file_id", "cluster"]).groupBy("file_id").agg(F.array_sort(F.collect_list("_x")).alias("modes")).join(dates, "file_id")
    zone = lambda name, x, by: F.struct(F.lit(name).alias("col_name"), F.coalesce(x + by[0], F.lit(0.0)).alias("x_left"), F.coalesce(x + by[1], F.lit(0.0)).alias("x_right"))
    at = lambda k: F.try_element_at("modes", F.lit(k))
    zones = F.array(zone("date", F.col("_date"), DATE_ZONE), zone("debit", at(-3), AMOUNT_ZONE), zone("credit", at(-2), AMOUNT_ZONE), zone("balance", at(-1), AMOUNT_ZONE))
    return modes.select("file_id", F.explode(zones).alias("z")).select("file_id", "z.*")


def page_profile(words: DataFrame) -> DataFrame:
    """Runs of occupied positions of each page that are wider than ten: how many words cover a position is a running sum of what
    begins less what ends there, and a run lasts while that is above zero."""
    left, right = F.greatest(F.floor("x0"), F.lit(0)).cast("long"), F.floor("x1").cast("long")
    ends = words.where(right > left).select(*PAGE, F.explode(F.array(F.struct(left.alias("x"), F.lit(1).alias("d")), F.struct(right.alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*PAGE, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    o = Window.partitionBy(*PAGE).orderBy("x")
    cover = steps.withColumn("n", F.sum("d").over(o)).withColumn("before", F.col("n") - F.col("d"))
    runs = cover.withColumn("run", F.sum((F.col("before") == 0).cast("int")).over(o)).groupBy(*PAGE, "run").agg(F.min("x").alias("x_left"), F.max("x").alias("x_right"))
    wide = runs.where(F.col("x_right") - F.col("x_left") > LEAST_WIDTH)
    return wide.select(*PAGE, (F.row_number().over(Window.partitionBy(*PAGE).orderBy("x_left")) - 1).alias("col_ord"), "x_left", "x_right")


def _signature(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SIGNATURES.items()):
        out = F.when(F.upper(text).rlike(pattern), name).otherwise(out)
    return out


def discovered_columns(words: DataFrame) -> DataFrame:
    """LAY-17: columns of each page by its profile, named by the words of the line that most looks like a header (date, text, balance) and
    stand over them. Without such a line, or without a date or an amount among the names, by position: the first is the date,
    the last the balance, the widest between them the text, and what stands right of it debit and credit or one amount.

    ``words(file_id, page_no, line_id, word_seq, text, x0, x1)`` -> file_id, page_no, col_ord, col_name (null: unknown), x_left, x_right.
    """
    columns = page_profile(words)
    said = F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text"))), lambda w: w["text"]), " "))
    lines = words.groupBy(*PAGE, "line_id").agg(said.alias("said"))
    hits = sum((F.col("said").rlike(SIGNATURES[k]).cast("int") for k in ("date", "description", "balance")), F.lit(0))
    heads = lines.withColumn("hits", hits).where("hits > 0").groupBy(*PAGE).agg(F.max_by("line_id", F.struct("hits", (-F.col("line_id")).alias("turn"))).alias("line_id"))
    over = words.join(heads, [*PAGE, "line_id"]).select(*PAGE, "word_seq", "x0", ((F.col("x0") + F.col("x1")) / 2).alias("middle"), _signature(F.col("text")).alias("name"))
    inside = F.filter("cols", lambda c: (F.col("middle") >= c["x_left"]) & (F.col("middle") <= c["x_right"]))
    few = columns.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x_left", "x_right", "col_ord"))).alias("cols"))  # of one page
    named = over.join(few, list(PAGE)).withColumn("col_ord", F.get(inside, F.lit(0))["col_ord"]).where("col_ord is not null and name is not null")
    named = named.groupBy(*PAGE, "col_ord").agg(F.max_by("name", F.struct("x0", "word_seq")).alias("named"))
    x = columns.join(named, [*PAGE, "col_ord"], "left").join(heads.select(*PAGE, F.lit(True).alias("headed")), list(PAGE), "left")
    page = Window.partitionBy(*PAGE)
    x = x.withColumns({"n": F.count("*").over(page), "width": F.col("x_right") - F.col("x_left")})
    first, last = F.col("col_ord") == 0, F.col("col_ord") == F.col("n") - 1
    between = ~first & ~last
    widest = lambda test: F.max_by(F.when(test, F.col("col_ord")), F.when(test, F.struct(F.col("width"), (-F.col("col_ord")).alias("turn")))).over(page)
    any_of = lambda *names: F.coalesce(F.max(F.col("named").isin(list(names)).cast("int")).over(page) == 1, F.lit(False))
    fine = any_of("date") & any_of("debit", "credit", "balance", "amount")
    x = x.withColumns({"fine": F.when(F.col("headed").isNotNull(), fine).otherwise(F.col("n") >= 2), "text_at": widest(between)})
    right = between & (F.col("col_ord") > F.col("text_at"))
    x = x.withColumn("n_right", F.sum(right.cast("int")).over(page))
    plain = F.when(first, "date").when(last, "balance").when(F.col("col_ord") == F.col("text_at"), "description")
    placed = plain.when(right & (F.col("n_right") == 2), F.when(F.col("col_ord") == F.col("n") - 3, "debit").otherwise("credit")).when(right & (F.col("n_right") == 1), "amount").otherwise(F.col("named"))
    name = F.when(~F.col("fine"), placed).when(F.col("headed").isNotNull(), F.col("named")).otherwise(plain)
    return x.select(*PAGE, "col_ord", name.alias("col_name"), "x_left", "x_right")
