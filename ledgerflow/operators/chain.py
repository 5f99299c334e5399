"""CHN: audit and repair of amounts and balances against the running balance, as scans over a statement's rows.

Tables have ``stmt_id`` (or the key columns given), ``row_seq``, ``debit``, ``credit``, ``balance`` as decimals. A balance of
zero counts as missing where a docstring says "known". Scans run in two levels over ranges of ``span`` places of ``row_seq``
(``scans``), so that a statement with a third of all rows is shared by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerflow.operators.folds import fold_rows
from ledgerflow.operators.scans import PART, SPAN, after, before, carry, in_ranges, of_range, place, scan, up_to

MONEY = "decimal(18,2)"
KEY = ("stmt_id",)


def money(c: Column | int | str) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast(MONEY)


def known() -> Column:
    return F.when(F.col("balance") != 0, F.col("balance"))


def with_last_known(df: DataFrame, name: str, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """``df`` with the last known balance before each row."""
    return scan(df, key, span, **{name: ("last", known())})


def move() -> Column:
    return F.col("credit") - F.col("debit")


def balance_audit(df: DataFrame, opening: str | None = "opening", key: Sequence[str] = KEY, tolerance: str = "0.05", span: int = SPAN) -> DataFrame:
    """CHN-01: rows whose balance does not follow from the previous claimed one. Both outcomes restart from the claimed
    balance, so the previous row decides; the first row starts from the opening or from itself."""
    start = F.coalesce(F.col(opening), F.col("balance") - move()) if opening else F.col("balance") - move()
    out = scan(df, key, span, _before=("lag", F.col("balance")))
    out = out.withColumn("expected", money(F.coalesce("_before", start) + move())).drop("_before", PART)
    return out.withColumn("diff", money(F.col("balance") - F.col("expected"))).where(F.abs("diff") > F.lit(tolerance).cast(MONEY))


def failed_pages(gaps: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """CHN-02: distinct pages with gaps, ascending."""
    return gaps.groupBy(*key).agg(F.sort_array(F.collect_set("page_no")).alias("failed_pages"))


def statement_audit(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """CHN-03: totals against printed totals (below 0.1; missing counts as zero) and the number of gaps; a missing opening
    counts as zero."""
    m = meta.select(*key, F.coalesce("opening_balance", money(0)).alias("opening"), *(F.coalesce(c, money(0)).alias(c) for c in ("statement_total_debit", "statement_total_credit")))
    gaps = balance_audit(df.drop("opening").join(m.select(*key, "opening"), list(key)), key=key).groupBy(*key).agg(F.count("*").alias("n_gaps"))
    totals = df.groupBy(*key).agg(F.sum("debit").alias("d"), F.sum("credit").alias("c")).join(m, list(key)).join(gaps, list(key), "left")
    off = lambda a, b: money(F.col(a) - F.col(b))
    out = totals.select(*key, off("d", "statement_total_debit").alias("debit_diff"), off("c", "statement_total_credit").alias("credit_diff"), F.coalesce("n_gaps", F.lit(0)).cast("long").alias("n_gaps"))
    match = lambda c: F.abs(c) < F.lit("0.1").cast(MONEY)
    out = out.withColumns({"debit_match": match("debit_diff"), "credit_match": match("credit_diff")})
    return out.withColumn("is_perfect", F.col("debit_match") & F.col("credit_match") & (F.col("n_gaps") == 0))


def reconcile_rows(df: DataFrame, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-04: flag rows off by more than 0.01 from the plain previous balance; an empty movement takes the difference
    and clears the flag."""
    eps = F.lit("0.01").cast(MONEY)
    out = scan(df, key, span, prev=("lag", F.col("balance"))).withColumn("gap", F.col("balance") - (F.col("prev") + move()))
    off = F.coalesce(F.abs("gap") > eps, F.lit(False))
    empty = (F.abs("debit") < eps) & (F.abs("credit") < eps)
    missing = F.col("prev") - F.col("balance")
    fill_d, fill_c = off & empty & (missing > eps), off & empty & (missing < -eps)
    return out.withColumns({"reconciliation_error": off & ~fill_d & ~fill_c, "debit": money(F.when(fill_d, missing).otherwise(F.col("debit"))), "credit": money(F.when(fill_c, -missing).otherwise(F.col("credit")))}).drop("prev", "gap", PART)


def consecutive_issues(df: DataFrame, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-05: per statement, messages of rows that break the chain by more than 0.01, and totals."""
    out = scan(df, key, span, n=("sum", F.lit(1)), _before=("lag", F.col("balance"))).withColumn("e", F.col("_before") + move())
    text = F.format_string("Row %d: Balance mismatch. Expected ~%.2f, got %.2f", F.col("n"), F.col("e").cast("double"), F.col("balance").cast("double"))
    bad = F.when(F.abs(F.col("e") - F.col("balance")) > F.lit("0.01").cast(MONEY), F.struct("row_seq", text.alias("t")))
    g = out.groupBy(*key).agg(F.sum("debit").alias("total_debit"), F.sum("credit").alias("total_credit"), F.array_sort(F.collect_list(bad)).alias("x"))
    return g.select(*key, (F.size("x") == 0).alias("is_valid"), "total_debit", "total_credit", F.transform("x", lambda s: s["t"]).alias("issues"))


def row_status(df: DataFrame, opening: str = "opening", key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-06: Success, Anomaly (more than 0.02 off the last known balance, seeded by the opening) or Pending."""
    prev = F.coalesce("_prev", F.when(F.col(opening) != 0, F.col(opening)))
    off = F.abs(prev + move() - known())
    out = with_last_known(df, "_prev", key, span)
    return out.withColumn("status", F.when(off.isNull(), "Pending").when(off <= F.lit("0.02").cast(MONEY), "Success").otherwise("Anomaly")).drop("_prev", PART)


def drop_static_rows(df: DataFrame, text: str = "narration", key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-07: without levy rows of 1000 or more that have no balance, and without one-sided amounts that leave the
    last kept balance as it was (within 0.01; dropped rows have that balance, so the previous row stands for it)."""
    levy = (F.col("balance") == 0) & (F.greatest("debit", "credit") >= 1000) & F.upper(text).rlike("STAMP DUTY CHARGE|ELECTRONIC MONEY TRANSFER LEVY")
    one_sided = ((F.col("debit") > 0) & (F.col("credit") == 0)) | ((F.col("credit") > 0) & (F.col("debit") == 0))
    prev = F.col("_prev")
    static = one_sided & (F.col("balance") != 0) & (prev != 0) & (F.abs(F.col("balance") - prev) <= F.lit("0.01").cast(MONEY))
    rows = scan(df.where(~levy), key, span, _prev=("lag", F.col("balance")))
    return rows.withColumn("_static", F.coalesce(static, F.lit(False))).where("not _static").drop("_static", "_prev", PART)


def repair_amounts(df: DataFrame, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-08: small amount leaks, from the printed balance."""
    out = with_last_known(df, "_prev", key, span).withColumn("gap", F.when(F.col("balance") != 0, F.col("balance") - (F.col("_prev") + move())))
    d, c, g, eps = F.col("debit"), F.col("credit"), F.col("gap"), F.lit("0.02").cast(MONEY)
    off = F.abs(g) > eps
    both = off & (d > 0) & (c > 0) & (F.abs(g + c) <= eps)
    add_d = off & (d > 0) & (c == 0) & (g < 0) & (F.abs(g) <= 1000)
    add_c = off & (c > 0) & (d == 0) & (g > 0) & (F.abs(g) <= 1000)
    return out.withColumns({"debit": money(F.when(add_d, d - g).otherwise(d)), "credit": money(F.when(both, 0).when(add_c, c + g).otherwise(c))}).drop("gap", "_prev", PART)


def swap_and_snap(df: DataFrame, tolerance: int = 1, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-09: put amounts on the side that explains the balance change, and take its size where neither does."""
    out = with_last_known(df, "_prev", key, span).withColumn("delta", F.when(F.col("balance") != 0, F.col("balance") - F.col("_prev")))
    d, c, x = F.col("debit"), F.col("credit"), F.col("delta")
    as_debit, as_credit = F.abs(x + d) <= tolerance, F.abs(x - c) <= tolerance
    size, moved = F.abs(x), F.coalesce(F.abs(x) > tolerance, F.lit(False))
    only_d, only_c, two, none = moved & (d > 0) & (c == 0), moved & (c > 0) & (d == 0), moved & (d > 0) & (c > 0), moved & (d == 0) & (c == 0)
    swap_d, swap_c = only_d & (F.abs(x - d) <= tolerance) & ~as_debit, only_c & (F.abs(x + c) <= tolerance) & ~as_credit
    keep_d, keep_c = two & as_debit & ~as_credit, two & as_credit & ~as_debit
    rebuilt = two & ~keep_d & ~keep_c
    debit = F.when(swap_d, 0).when(only_d & ~as_debit, size).when(swap_c, c).when(keep_c, 0).when(rebuilt, F.when(x < 0, size).otherwise(0)).when(none & (x < 0), size).otherwise(d)
    credit = F.when(swap_d, d).when(swap_c, 0).when(only_c & ~as_credit, size).when(keep_d, 0).when(rebuilt, F.when(x < 0, 0).otherwise(size)).when(none & (x >= 0), size).otherwise(c)
    return out.withColumns({"debit": money(debit), "credit": money(credit)}).drop("delta", "_prev", PART)


def fill_missing_movement(df: DataFrame, opening: str = "opening", key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-10: an empty movement takes the change from the last known balance (or the opening, if that is not zero)."""
    prev = F.coalesce("_prev", F.when(F.col(opening) != 0, F.col(opening)))
    x = F.when((F.col("debit") == 0) & (F.col("credit") == 0), known() - prev)
    return with_last_known(df, "_prev", key, span).withColumn("_x", x).withColumns({"debit": money(F.when(F.col("_x") < 0, -F.col("_x")).otherwise(F.col("debit"))), "credit": money(F.when(F.col("_x") > 0, F.col("_x")).otherwise(F.col("credit")))}).drop("_x", "_prev", PART)


def movement_override(df: DataFrame, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-11: among rows with a balance, a movement off by more than 0.01, or none, takes the balance change; rows left
    without movement go."""
    rows = scan(df.where("balance != 0"), key, span, _prev=("lag", F.col("balance"))).withColumn("_m", F.col("balance") - F.col("_prev"))
    amount = F.col("debit") + F.col("credit")
    wrong = F.coalesce(((amount != 0) & (F.abs(F.col("_m") - move()) > F.lit("0.01").cast(MONEY))) | (amount == 0), F.lit(False)) & (F.col("_m") != 0)
    out = rows.withColumns({"debit": money(F.when(wrong, F.greatest(-F.col("_m"), money(0))).otherwise(F.col("debit"))), "credit": money(F.when(wrong, F.greatest(F.col("_m"), money(0))).otherwise(F.col("credit")))})
    return out.where("debit != 0 or credit != 0").drop("_m", "_prev", PART)


def flip_in_segments(df: DataFrame, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-12: between two known balances whose difference the movements miss, flip the first row that makes it up. Rows before the
    first known balance and after the last one can't be judged, so they need not meet in one window."""
    out = scan(df.withColumn("_b", known()), key, span, _n=("sum", F.col("_b").isNotNull().cast("long")), _start=("last", F.col("_b")), _next=("next", F.col("_b")))
    out = out.withColumn("_seg", F.col("_n") - F.col("_b").isNotNull().cast("long"))
    apart = F.col("_start").isNull() | F.coalesce("_b", "_next").isNull()
    seg = Window.partitionBy(*key, "_seg", F.when(apart, F.col(PART)))
    out = out.withColumns({"_end": F.max("_b").over(seg), "_sum": F.sum(move()).over(seg)})
    out = out.withColumn("_deficit", F.when(F.col("_seg") > 0, F.col("_end") - F.col("_start") - F.col("_sum")))
    to_c = (F.col("_deficit") != 0) & (F.col("debit") > 0) & (F.col("debit") * 2 == F.col("_deficit"))
    to_d = (F.col("_deficit") != 0) & (F.col("credit") > 0) & (F.col("credit") * -2 == F.col("_deficit"))
    fits = F.coalesce(to_c | to_d, F.lit(False))
    first = fits & (F.min(F.when(fits, F.col("row_seq"))).over(seg) == F.col("row_seq"))
    out = out.withColumns({"_c": first & to_c, "_d": first & ~to_c & to_d})
    swapped = F.coalesce(F.col("_c"), F.lit(False)) | F.coalesce(F.col("_d"), F.lit(False))
    d, c = F.col("debit"), F.col("credit")
    up, down = swapped & F.coalesce(F.col("_c"), F.lit(False)), swapped & F.coalesce(F.col("_d"), F.lit(False))
    out = out.select("*", money(F.when(up, 0).when(down, c).otherwise(d)).alias("_nd"), money(F.when(up, d).when(down, 0).otherwise(c)).alias("_nc"))
    return out.withColumns({"debit": F.col("_nd"), "credit": F.col("_nc")}).drop("_b", "_n", "_next", PART, "_seg", "_start", "_end", "_sum", "_deficit", "_c", "_d", "_nd", "_nc")


def infer_balances(df: DataFrame, backward_first: bool = False, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-13 and CHN-14: missing balances from the last or the next known one and the movements between, in closed form
    by cumulative sums. A null movement counts as zero."""
    w = of_range(key)
    rows = in_ranges(df, span).withColumns({"_b": known(), "_m": F.coalesce(move(), money(0))})
    rows = rows.withColumn("_cum", F.sum("_m").over(up_to(w))).withColumn("_v", F.col("_b") - F.col("_cum"))
    shown = F.when(F.col("_v").isNotNull(), place())

    # _v is what a known balance has besides the movements up to it, counted from its range's start; _from is the sum before the range.
    def carries(ranges: WindowSpec) -> dict[str, Column]:
        start = {"_from": F.coalesce(F.sum("_moved").over(before(ranges)), money(0))}
        return start | {"_c_last": F.last(F.col("_v_last") - F.col("_from"), True).over(before(ranges)), "_c_next": F.first(F.col("_v_next") - F.col("_from"), True).over(after(ranges))}

    out = carry(rows, key, {"_moved": F.sum("_m"), "_v_last": F.max_by("_v", shown), "_v_next": F.min_by("_v", shown)}, carries)
    forward = F.coalesce(F.last("_v", True).over(before(w)), F.col("_c_last") + F.col("_from")) + F.col("_cum")
    backward = F.coalesce(F.first("_v", True).over(after(w)), F.col("_c_next") + F.col("_from")) + F.col("_cum")
    a, b = (backward, forward) if backward_first else (forward, backward)
    out = out.withColumns({"_f": a, "_s": b})
    return out.withColumn("balance", money(F.coalesce("_b", "_f", "_s", money(0)))).drop("_b", "_m", "_cum", "_v", "_from", "_c_last", "_c_next", "_f", "_s", PART)


def mend_truncated_balances(df: DataFrame, opening: str = "opening", raw: str = "raw_balance", key: Sequence[str] = KEY) -> DataFrame:
    """CHN-15: a balance whose printed digits (six or more) are a proper prefix of the expected ones, or that has the expected
    whole units and is less than one off, takes the expected value, which then is the next row's start.

    Each row depends on the mended one before, so a statement's rows are streamed in order; the state is one balance. The first row's
    ``opening`` is the start. Rows with a null amount or balance stay as they are.
    """

    def step(state: tuple, row: tuple) -> tuple:
        (begun, prev), (debit, credit, balance, printed, first) = state, row
        prev = prev if begun else first
        if None in (prev, debit, credit, balance):
            return (True, balance or prev), balance
        expected = prev - debit + credit
        shown, want = re.sub(r"\D", "", printed or ""), re.sub(r"\D", "", f"{abs(expected):.2f}")
        short = 6 <= len(shown) < len(want) and want.startswith(shown)
        close = abs(balance) // 1 == abs(expected) // 1 and abs(balance - expected) <= 1
        if balance != 0 and (short or close):
            return (True, expected), expected
        return (True, balance or prev), balance

    amounts = df.withColumns({c: money(F.col(c)) for c in ("debit", "credit", "balance", opening)})
    return fold_rows(amounts, key, ["row_seq"], ["debit", "credit", "balance", raw, opening], lambda: (False, None), step, "balance", DecimalType(18, 2))


def insert_chain_adjustments(df: DataFrame, least: int = 100_000, text: str = "narration", key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """CHN-16: an explicit row before each row whose balance misses the chain by ``least`` or more."""
    out = with_last_known(df, "_prev", key, span).withColumn("_gap", F.when(F.col("balance") != 0, F.col("balance") - (F.col("_prev") + move())))
    note = F.when(F.col("_gap") < 0, "Inferred chain adjustment (missing debit row).").otherwise("Inferred chain adjustment (missing credit row).")
    seq = F.col("row_seq") * 2
    columns = [c for c in df.columns if c != "row_seq"]
    own = F.struct(seq.alias("row_seq"), *[F.col(c).alias(c) for c in columns], F.lit(False).alias("is_inferred"))
    new = {"debit": money(F.greatest(-F.col("_gap"), money(0))), "credit": money(F.greatest(F.col("_gap"), money(0))), "balance": money(F.col("_prev") + F.col("_gap")), text: note}
    made = F.struct((seq - 1).alias("row_seq"), *[new.get(c, F.col(c)).alias(c) for c in columns], F.lit(True).alias("is_inferred"))
    large = F.coalesce(F.abs("_gap") >= least, F.lit(False))
    return out.select(F.explode(F.when(large, F.array(made, own)).otherwise(F.array(own))).alias("r")).select("r.*")


def _with_totals(df: DataFrame, meta: DataFrame, key: Sequence[str]) -> DataFrame:
    g = df.groupBy(*key).agg(F.sum("debit").alias("cur_debit"), F.sum("credit").alias("cur_credit"), F.max_by("balance", "row_seq").alias("last_balance"), F.max("row_seq").alias("last_seq"), F.max_by("txn_date", "row_seq").alias("txn_date"))
    g = g.join(meta, list(key))
    return g.withColumns({"debit_gap": money(F.col("statement_total_debit") - F.col("cur_debit")), "credit_gap": money(F.col("statement_total_credit") - F.col("cur_credit"))})


def _adjustment(g: DataFrame, key: Sequence[str], debit: Column, credit: Column, balance: Column, reference: str) -> DataFrame:
    rows = g.select(*key, (F.col("last_seq") + 1).alias("row_seq"), "txn_date", money(debit).alias("debit"), money(credit).alias("credit"), money(balance).alias("balance"), F.lit(reference).alias("reference"))
    return rows.where("debit > 0 or credit > 0")


def header_adjustment(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """CHN-17: the trailing row that one-sided shortfalls equal to the closing gap (0.05) imply."""
    g = _with_totals(df, meta, key).withColumn("closing_gap", F.col("last_balance") - F.col("closing_balance"))
    eps, near = F.lit("0.01").cast(MONEY), F.lit("0.05").cast(MONEY)
    dg, cg, x = F.col("debit_gap"), F.col("credit_gap"), F.col("closing_gap")
    as_d = (dg > eps) & (F.abs(cg) <= eps) & (F.abs(dg - x) <= near)
    as_c = ~as_d & (cg > eps) & (F.abs(dg) <= eps) & (F.abs(cg + x) <= near)
    return _adjustment(g, key, F.when(as_d, dg).otherwise(0), F.when(as_c, cg).otherwise(0), F.col("closing_balance"), "INFERRED_HEADER_ADJUSTMENT")


def rounding_adjustment(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """CHN-18: a row for a gap of 0.01 to 1.00 on one side while the other side matches."""
    g = _with_totals(df, meta, key)
    eps = F.lit("0.01").cast(MONEY)
    dg, cg = F.col("debit_gap"), F.col("credit_gap")
    as_d, as_c = (dg >= eps) & (dg <= 1) & (F.abs(cg) <= eps), (cg >= eps) & (cg <= 1) & (F.abs(dg) <= eps)
    d, c = F.when(as_d, dg).otherwise(0), F.when(as_c & ~as_d, cg).otherwise(0)
    return _adjustment(g, key, d, c, F.col("last_balance") - d + c, "INFERRED_ROUNDING_ADJUSTMENT")


def offsetting_adjustment(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """CHN-19: a row with both gaps where they are positive and within 0.02 of each other."""
    g = _with_totals(df, meta, key)
    fits = (F.col("debit_gap") > 0) & (F.abs(F.col("debit_gap") - F.col("credit_gap")) <= F.lit("0.02").cast(MONEY))
    return _adjustment(g, key, F.when(fits, F.col("debit_gap")).otherwise(0), F.when(fits, F.col("credit_gap")).otherwise(0), F.col("last_balance"), "OFFSETTING_ADJUSTMENT")


def discard_copied_total(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """CHN-20: printed debit total set to null where the ledger closes, the printed summary does not, and both printed
    totals are the same copied number."""
    g = _with_totals(df, meta, key)
    close_own = F.abs(F.col("opening_balance") + F.col("cur_credit") - F.col("cur_debit") - F.col("closing_balance")) <= 1
    close_printed = F.abs(F.col("opening_balance") + F.col("statement_total_credit") - F.col("statement_total_debit") - F.col("closing_balance")) > 1
    copied = (F.abs(F.col("statement_total_debit") - F.col("statement_total_credit")) <= F.lit("0.01").cast(MONEY)) & (F.abs("debit_gap") > 1)
    gone = F.coalesce(close_own & close_printed & copied, F.lit(False))
    return g.select(*key, F.when(~gone, F.col("statement_total_debit")).alias("statement_total_debit"), "statement_total_credit", gone.alias("debit_total_discarded"))


def discard_ocr_totals(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """CHN-21: printed totals set aside where either is more than 1.0 off; the closing is the last row's balance."""
    g = _with_totals(df, meta, key)
    off = F.coalesce((F.abs("debit_gap") > 1) | (F.abs("credit_gap") > 1), F.lit(False))
    keep = lambda c: F.when(~off, F.col(c)).alias(c)
    aside = lambda c: F.when(off, F.col(c)).alias(f"ocr_{c}")
    names = ("statement_total_debit", "statement_total_credit")
    return g.select(*key, *map(keep, names), *map(aside, names), F.col("last_balance").alias("closing_balance"))
