"""LAY-41, LAY-42: printed fields of statements whose text is broken: labels without spaces or colons, totals with split digits, totals in
the footer of the last page, sentences that go on over the end of a page.

Texts of pages are put together in order before they are searched; a statement's text is at most what a landing file holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Labels of totals and balances.
LABELS = {"opening_balance": "Opening Balance", "closing_balance": "Closing Balance", "statement_total_debit": "Total Debit", "statement_total_credit": "Total Credit"}
#: How totals stand in a footer, whole or with their last digits on the line below.
_AMOUNT = r"[0-9]{1,3}(?:,[0-9]{3})*\."
FOOTER = rf"(?i)\n\s*({_AMOUNT}\d{{2}})\s+({_AMOUNT}\d{{2}})\s*\n\s*\d+\s+of\s+\d+"
BROKEN_FOOTER = rf"(?i)\n\s*({_AMOUNT}\d)\s+({_AMOUNT})\s*\n\s*(\d)\s+(\d{{2}})\s*\n\s*\d+\s+of\s+\d+"
#: Dates of a printed period.
DATE_FORMATS = ["d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "M/d/yyyy"]


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _amount(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^\d.\-]", "").try_cast(MONEY)


def compact_fields(pages: DataFrame, text: str = "text") -> DataFrame:
    """LAY-41: opening, closing and totals after their labels with or without colon and blanks, digits groups apart or not; the account's
    number, name and the period as a summary page prints them. Null where a field is not printed."""
    t = compact(F.col(text))
    amounts = {k: _amount(_found(t, rf"(?i){label}\s*:?\s*([0-9][0-9,\s]*\.\d{{2}})")) for k, label in LABELS.items()}
    day = r"[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}"
    period = rf"(?i)\b({day})\s+to\s+({day})\b"
    name = F.coalesce(_found(t, r"(?i)Bank Statement\s+(.+?)\s+No\s+\d+"), _found(t, r"(?i)Hello\s+(.+?),\s+Here is your Account Summary"))
    return pages.withColumns({**amounts, "account_no": _found(t, r"(?i)\bAccount\s+Number\s+(\d{10,12})\b"), "account_name": F.trim(name), "period": F.concat(_found(t, period, 1), F.lit(" to "), _found(t, period, 2))})


def split_digit_fields(pages: DataFrame, text: str = "text") -> DataFrame:
    """LAY-41: balances and totals of scanned pages. The total debit may be split anywhere, as in ``1,654.0 1 8, 157.69``: up to the
    first whole group with two decimals all digits are one amount; without such a group the text is read as it stands, and is
    zero if it can't be read."""
    t = compact(F.col(text))
    plain = {k: _amount(_found(t, rf"(?i){label.upper()}\s+([0-9][0-9,\s]*\.\d{{2}})")) for k, label in LABELS.items() if k != "statement_total_debit"}
    raw = _found(t, r"(?i)TOTAL DEBIT\s+([0-9][0-9,\s.]*\d)")
    digits = F.regexp_replace(_found(raw, r"^(.*?\d{1,3},\s*\d{3}\.\d{2})"), r"\D", "")
    total = F.when(digits.isNotNull(), (digits.try_cast("decimal(20,0)") / 100).cast(MONEY)).when(raw.isNotNull(), F.coalesce(_amount(raw), F.lit(0).cast(MONEY)))
    return pages.withColumns({**plain, "statement_total_debit": total})


def whole_texts(pages: DataFrame, key: Sequence[str] = ("file_id",), text: str = "text") -> DataFrame:
    """The text of each statement: its pages in order, a line break between."""
    g = pages.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce(text, F.lit("")).alias("t")))).alias("ps"))
    return g.select(*key, F.array_join(F.transform("ps", lambda p: p["t"]), "\n").alias("text"))


def _day(raw: Column) -> Column:
    return F.coalesce(*[F.try_to_date(raw, f) for f in DATE_FORMATS])


def footer_fields(pages: DataFrame, key: Sequence[str] = ("file_id",), text: str = "text") -> DataFrame:
    """LAY-42: per statement, over all its pages together: currency, period and account number in running text, and the totals printed
    above the count of pages in the footer, also where their last digits stand on the next line."""
    x = whole_texts(pages, key, text)
    t, full = compact(F.col("text")), F.col("text")
    said = F.upper(F.trim(_found(t, r"(?i)\bCurrency\s+(.+?)\s+(?:Total\s+Withdrawals|Account\s+Name|Closing\s+Balance)")))
    currency = F.when(F.contains(said, F.lit("DOLLAR")) | (said == "USD"), "USD").when(F.contains(said, F.lit("NAIRA")) | said.isin("NGN", "N"), "NGN")
    period = r"(?i)Statement\s+for\s+\w+\s+(.+?)\s+and\s+\w+\s+(.+?)\s+Opening\s+Balance"
    day = lambda k: F.date_format(_day(_found(t, period, k)), "dd-MMM-yyyy")
    whole = full.rlike(FOOTER)
    total = lambda k: F.when(whole, _amount(_found(full, FOOTER, k))).otherwise(_amount(F.concat(_found(full, BROKEN_FOOTER, k), _found(full, BROKEN_FOOTER, k + 2))))
    return x.select(*key, currency.alias("currency"), F.concat(day(1), F.lit(" to "), day(2)).alias("period"), _found(t, r"(?i)\bAccount\s+No\s+(\d{10,12})\b").alias("account_no"), total(1).alias("statement_total_debit"), total(2).alias("statement_total_credit"))
