"""SCL-M: amounts from text. One cleaning function with the source's reading rules as modes; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: What a money token looks like inside a line (M13, M15) and in the strict column format (M8).
TOKEN = r"\d{1,3}(?:,\d{3})*\.\d{2}"
#: Fixed value: a money token with its minus, where the dash does not join it to a word or number before.
SIGNED = rf"(?:(?<![\w-])-)?{TOKEN}"
GROUPED = r"\d{1,3}(?:,\d{3})+"
STRICT = r"^\d{1,3}(?:,\d{3})*\.\d{2}$"


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("double"))


def _number(text: Column) -> Column:
    return text.try_cast("double")


def parse_money(raw: Column, mode: str = "bank") -> Column:
    """Amount as double under ``mode``; text that cannot be read gives 0, or null in the modes that say so.

    bank M1: commas and symbols dropped, parentheses negative. strict M2: only plain amounts of at most two decimals.
    ledger M3: dotless thousands are minor units, long bare digits are references, dash or parentheses negative.
    tabular M4: as bank, but parentheses are lost. audit M5: first number in the text. capped M6: beyond 1e10 is 0.
    nullable M7: letters or over 15 digits are null. eco M8: the strict column format or null. prefix M9: longest
    numeric prefix. signed M10: a dash anywhere or parentheses negative, null without digits. plain M11: commas dropped.
    or_null M12: null without digits. token M13: the amount if the text is one money token, else null. fidelity M14: comma
    groups without a point are whole units.
    """
    s = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    bare = F.regexp_replace(s, ",", "")
    digits = F.regexp_replace(s, r"[^\d.\-]", "")
    closed = s.startswith("(") & s.endswith(")")
    if mode == "bank":
        v = _zero(_number(digits))
        return F.when(closed, -F.abs(v)).otherwise(v)
    if mode == "strict":
        x = F.trim(F.regexp_replace(s, "[₦N,]", ""))
        return F.when(x.rlike(r"^-?\d+(\.\d{1,2})?$"), _number(x)).otherwise(0.0)
    if mode == "ledger":
        x = F.regexp_replace(s, r"[^\d.]", "")
        grouped = ~s.contains(".") & s.rlike(GROUPED)
        v = F.when(grouped, _number(x) / 100).when(~s.contains(".") & x.rlike(r"^\d{6,}$"), 0.0).otherwise(_number(x))
        v = F.when(F.abs(v) > 1e14, 0.0).otherwise(_zero(v))
        return F.when(s.contains("(") | s.startswith("-") | s.startswith("­"), -v).otherwise(v)
    if mode == "tabular":
        return _zero(_number(digits))
    if mode == "audit":
        x = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[₦N,]", ""), r"\(", "-"), r"\)", "")
        return _zero(_number(F.regexp_extract(x, r"-?\d+\.?\d*", 0)))
    if mode == "capped":
        v = _zero(_number(digits))
        return F.when(F.abs(v) > 1e10, 0.0).otherwise(v)
    if mode == "nullable":
        x = F.regexp_replace(s, r"[,₦N\s]", "")
        count = F.length(F.regexp_replace(x, r"\D", ""))
        return F.when(~x.rlike("[A-Za-z]") & (count > 0) & (count <= 15), _number(x))
    if mode == "eco":
        return F.when(s.rlike(STRICT), _number(bare))
    if mode == "prefix":
        return _zero(_number(F.regexp_extract(F.regexp_replace(s, r"[₦N,\s]", ""), r"^-?\d+(?:\.\d+)?", 0)))
    if mode == "signed":
        x = F.regexp_replace(s, r"[^\d.]", "")
        v = F.when(x.rlike(r"\d"), _number(x))
        return F.when(s.contains("-") | closed, -v).otherwise(v)
    if mode == "plain":
        return _zero(_number(bare))
    if mode == "or_null":
        return F.when(s.rlike(r"\d"), _number(digits))
    if mode == "token":
        return F.when(s.rlike(STRICT), F.round(_number(bare), 2))
    if mode == "fidelity":
        whole = _zero(_number(F.regexp_replace(s, r"\D", "")))
        sign = F.when(s.contains("(") | s.startswith("-") | s.startswith("­"), -1.0).otherwise(1.0)
        return F.when(~s.contains(".") & s.rlike(GROUPED), sign * whole).otherwise(parse_money(raw, "ledger"))
    raise ValueError(f"unknown mode: {mode}")


MODES = ("bank", "strict", "ledger", "tabular", "audit", "capped", "nullable", "eco", "prefix", "signed", "plain", "or_null", "token", "fidelity")


def money_tokens(line: Column) -> Column:
    """SCL-M15: every money token of a line that is above zero, as doubles."""
    found = F.transform(F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.filter(found, lambda x: x > 0)


def clean_amounts(df: DataFrame, columns: list[str], mode: str = "bank") -> DataFrame:
    """``df`` with each text column read as an amount (decimal)."""
    return df.withColumns({c: parse_money(F.col(c), mode).cast(MONEY) for c in columns})


def amount_quality(df: DataFrame, column: str, mode: str = "bank", key: str = "stmt_id") -> DataFrame:
    """Per statement: how many cells were read, empty, not read and negative, and their sum."""
    v, given = parse_money(F.col(column), mode), F.trim(F.coalesce(column, F.lit(""))) != ""
    read = given & v.isNotNull() & ((v != 0) | F.col(column).rlike(r"^[^1-9]*0[^1-9]*$"))
    n = lambda c: F.count_if(c).alias
    return df.groupBy(key).agg(n(read)("n_read"), n(~given)("n_empty"), n(given & ~read)("n_rejected"), n(v < 0)("n_negative"), F.sum(v.cast(MONEY)).alias("total"))
