"""What is printed differently by each bank, as data (LAY-14, 18 to 20, 25 to 27, 45), and the expressions that read it.

Tables are small and fixed, so they become literals of one expression per column: no join, and nothing to broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signs of a bank in the order they are tried: bank, characters of the head that are read (None: all), groups that
# must be met, groups of alternatives.
BANK_SIGNS: list[tuple[str, int | None, int, list[list[str]]]] = [
    ("ecobank", 1500, 1, [["ecobank"]]),
    ("gtbank", 1500, 1, [["gtco", "guaranty trust"]]),
    ("providus", 1500, 1, [["providus"]]),
    ("zenith", 1500, 1, [["zenith"]]),
    ("access", 1500, 1, [["access bank", "access diamond"]]),
    ("wema", 1500, 1, [["wema bank", "wemabank"]]),
    ("wema", 3500, 3, [["withdrawals"], ["deposits"], ["narration", "description", "remarks", "details", "particulars"]]),
    ("uba", 1500, 1, [["united bank for africa", r"\buba\b"]]),
    ("uba", 1500, 2, [["chq no", "cheque no"], ["narration", "tran date", "trans date"]]),
    ("firstbank", 1500, 1, [["first bank", "firstbank", " fbn "]]),
    ("firstbank", None, 4, [[r"withdrawal\(dr\)", r"withdrawal \(dr\)"], [r"deposit\(cr\)", r"deposit \(cr\)"], [r"ref\. number", "ref number"], ["transaction details"]]),
    ("fidelity", 1500, 1, [["fidelity"]]),
    ("fcmb", 1500, 1, [["fcmb", "first city monument"]]),
    ("wema", 1500, 1, [["wema"]]),
    ("sterling", 1500, 1, [["sterling"]]),
    ("generic", 1500, 1, [["stanbic", "standard chartered"]]),
    ("gtbank", None, 2, [["originating branch"], ["remarks"], [r"trans\. date", "trans date"]]),
    ("ecobank", None, 3, [["value date"], ["transaction date", "tran date"], ["ecobank"]]),
    ("providus", None, 2, [["txn date"], ["val date"]]),
    ("sterling", None, 3, [["money in"], ["money out"], ["narration"]]),
    ("access", None, 1, [["access bank", "access diamond"]]),
    ("access", None, 2, [["posted date"], ["remarks"]]),
    ("access", None, 2, [["transaction details"], ["withdrawal", "lodgement"]]),
    ("zenith", None, 2, [["transaction details"], ["value date"]]),
    ("wema", None, 3, [["withdrawals"], ["deposits"], ["narration"]]),
]
# Words of file names, in the order they are tried, and other spellings of a bank's id.
FILE_NAMES = [("access", ["access"]), ("uba", ["uba"]), ("wema", ["wema"]), ("fcmb", ["fcmb"]), ("zenith", ["zenith"]), ("providus", ["providus"]), ("sterling", ["sterling"]), ("fidelity", ["fidelity"]), ("firstbank", ["fbn", "first bank"]), ("gtbank", ["gtbank", "gt bank", "gtco"])]
ALIASES = {"accessbank": "access", "access_bank": "access", "access-bank": "access", "access bank": "access"}
# Phrases of rows that are no entries, anywhere in the text; whole texts; summary rows; phrases of one bank only.
NOISE_PHRASES = [
    "ACCOUNT SUMMARY", "OPENING BALANCE", "OPENING BAL", "CLOSING BALANCE", "CLOSING BAL", "CURRENT BAL", "TOTAL DEBIT", "TOTAL CREDIT", "EFF. AVAIL. BAL", "CURRENCY", "STATEMENT PERIOD", "PLEASE ADDRESS ALL ENQUIRIES", "P.O.BOX", "REGISTERED OFFICE", "VICTORIA ISLAND",
    "MEMBER OF THE NIGERIA DEPOSIT INSURANCE CORPORATION", "NDIC", "WWW.GTBANK.COM", "AKIN ADESOLA",
]
NOISE_TEXTS = [r"^\s*TOTAL\s+DEBITS?\s*$", r"^\s*TOTAL\s+CREDITS?\s*$", r"^\s*DEBIT\s+TOTAL\s*$", r"^\s*CREDIT\s+TOTAL\s*$"]
SUMMARY_TEXTS = [r"\bPAGE\s+TOTAL\b", r"\bTOTAL\s+(DEBIT|CREDIT|WITHDRAWAL|DEPOSIT|CHARGES?)\b", r"^(TOTAL|GRAND\s+TOTAL)\b", r"\bBALANCE\s+(B/F|C/F|BROUGHT\s+FORWARD|CARRIED\s+FORWARD)\b", r"\bOPENING\s+BALANCE\b", r"\bCLOSING\s+BALANCE\b"]
UBA_FOOTERS = ["DOWNLOAD APP", "CHAT WITH LEO", "OUR WEBSITE", "HEAD OFFICE", "PRIVACY POLICY", "AFRICA'SGLOBALBANK", "CFC@UBAGROUP.COM"]
BANK_NOISE = {
    "zenith": ["OPENING", "OPENING BALANCE", "CLOSING BALANCE", "BALANCE BROUGHT FORWARD", "BALANCE CARRIED FORWARD"],
    "sterling": ["OPENING BALANCE", "CLOSING BALANCE", "AVAILABLE BALANCE", "TOTAL CREDIT", "TOTAL DEBIT", "DATE RANGE", "OPENING", "CLOSING", "BUSINESS-MINIMUM"],
    "fcmb": ["BALANCE BROUGHT FORWARD", "BALANCE CARRIED FORWARD"],
}
# Words that name a column in each bank's header, in any case, in the order they are tried.
HEADERS: dict[str, dict[str, str]] = {
    "gtbank": {"trans_date": r"Trans\.?\s*Date", "value_date": r"Value\.?\s*Date", "reference": r"Refer", "debit": r"Deb", "credit": r"Cred", "balance": r"Bal", "remarks": r"Remarks?"},
    "access": {"trans_date": r"Transaction\.?\s*Date", "value_date": r"Value\.?\s*Date", "reference": r"Ref", "debit": r"Debit|Withdrawals", "credit": r"Credit|Lodgements", "balance": r"Balance", "remarks": r"Description|Narration|Transaction Details"},
    "firstbank": {"trans_date": r"Trans\.?\s*Date", "value_date": r"Value\.?\s*Date", "reference": r"Reference", "debit": r"Debit", "credit": r"Credit", "balance": r"Balance", "remarks": r"Particulars|Details"},
    "zenith": {"trans_date": r"Date", "value_date": r"Value\.?\s*Date", "reference": r"Ref", "debit": r"Debit", "credit": r"Credit", "balance": r"Balance", "remarks": r"Description"},
    "uba": {"trans_date": r"Trans\.?\s*Date", "value_date": r"Value\.?\s*Date", "reference": r"Reference", "debit": r"Debit", "credit": r"Credit", "balance": r"Balance", "remarks": r"Narration"},
    "fidelity": {"trans_date": r"Transaction\s+Date", "value_date": r"Value\s+Date", "channel": r"Channel", "remarks": r"Details", "credit": r"Pay\s*In", "debit": r"Pay\s*Out", "balance": r"Balance"},
    "fcmb": {"trans_date": r"Tran\.?\s*Date", "value_date": r"Value\.?\s*Date", "reference": r"Ref", "debit": r"Debit", "credit": r"Credit", "balance": r"Balance", "remarks": r"Details"},
    "sterling": {"trans_date": r"Trans\.?\s*Date", "value_date": r"Value\.?\s*Date", "reference": r"Reference", "debit": r"Money\s*Out", "credit": r"Money\s*In", "balance": r"Balance", "remarks": r"Narration"},
}
# Printed fields of a statement that are the same in most banks, and those of the banks that differ.
FIELDS = {"account_name": r"Account Name[:\s]+([A-Z\s&]+)", "statement_period": r"Statement Period[:\s]+(.+)", "total_debit": r"Total Debit[:\s]+([\d,]+\.\d{2})", "total_credit": r"Total Credit[:\s]+([\d,]+\.\d{2})", "opening_balance": r"Opening Balance[:\s]+([\d,]+\.\d{2})", "closing_balance": r"Closing Balance[:\s]+([\d,]+\.\d{2})"}
OWN_FIELDS: dict[str, dict[str, str]] = {
    "gtbank": {"account_name": r"CUSTOMER STATEMENT\s*([\s\S]*?)\s*Trans\.\s*Date", "statement_period": r"Statement Period\s*:\s*(.+)", "total_debit": r"Total Debit\s*([\d,]+\.\d{2})", "total_credit": r"Total Credit\s*([\d,]+\.\d{2})", "opening_balance": r"Opening Balance\s*([\d,]+\.\d{2})", "closing_balance": r"Closing Balance\s*([\d,]+\.\d{2})"},
    "access": {"account_name": r"Account Name[:\s]+([A-Z\s&]+?)(?=\s+Total|$)", "statement_period": r"Period[:\s]+(\d{1,2}(?:-|\/)\w{3,}(?:-|\/)\d{2,4})\s+to\s+(\d{1,2}(?:-|\/)\w{3,}(?:-|\/)\d{2,4})", "total_debit": r"Total\s+(?:Debit|Withdrawals)[:\s]+([\d,]+\.\d{2})", "total_credit": r"Total\s+(?:Credit|Deposits|Lodgements)[:\s]+([\d,]+\.\d{2})"},
    "zenith": {"statement_period": r"Period[:\s]+(.+)"},
    "fidelity": {"account_name": r"(?:Account:)\s*(.*?)(?=\s*Currency:|$)", "statement_period": r"From\s+(.+?)\s+to\s+(.+)", "total_debit": r"Total\s+Debits?[:\s]*([\d,]+\.\d{2})", "total_credit": r"Total\s+Credits?[:\s]*([\d,]+\.\d{2})", "opening_balance": r"Opening\s+Balance[:\s]*([\d,]+\.\d{2})", "closing_balance": r"Closing\s+Balance[:\s]*([\d,]+\.\d{2})"},
}
MONEY_FIELDS = ("debit", "credit", "balance")


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def _first(pairs: list[tuple[Column, str]], otherwise: str) -> Column:
    return F.coalesce(*[F.when(test, value) for test, value in pairs], F.lit(otherwise))


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def bank_of(text: Column) -> Column:
    """LAY-18: the first bank whose signs are on the page; ``generic`` without any, or for null or empty text."""
    s = folded(text)
    tests = []
    for bank, head, least, groups in BANK_SIGNS:
        part = F.substring(s, 1, head) if head else s
        tests.append((sum((_any(part, g).cast("int") for g in groups[1:]), _any(part, groups[0]).cast("int")) >= least, bank))
    return _first(tests, "generic")


def guarded_bank(bank: Column, text: Column) -> Column:
    """LAY-19: ``gtbank`` stays if two of its three structural signs or its name are there, ``gtco`` if that word is; else the page's
    own signs decide, and ``generic`` if they say the same again. Other banks stay."""
    s = folded(text)
    signs = next(groups for name, head, _, groups in BANK_SIGNS if name == "gtbank" and head is None)
    sure = sum((_any(s, g).cast("int") for g in signs[1:]), _any(s, signs[0]).cast("int")) >= 2
    found = bank_of(text)
    again = F.when(found == bank, "generic").otherwise(found)
    return F.when((bank == "gtbank") & ~sure & ~_any(s, ["guaranty trust", "gtco"]), again).when((bank == "gtco") & ~s.contains("gtco"), again).otherwise(bank)


def bank_hint(name: Column) -> Column:
    """LAY-20: bank from a file name; ``auto`` where it names none, and for null."""
    return _first([(_any(F.lower(name), words), bank) for bank, words in FILE_NAMES], "auto")


def bank_alias(name: Column) -> Column:
    """LAY-20: a bank's id from the spellings in use; null and empty: ``auto``."""
    s = F.lower(F.trim(F.coalesce(F.nullif(name, F.lit("")), F.lit("auto"))))
    return F.coalesce(*[F.when(s == k, v) for k, v in ALIASES.items()], s)


def is_noise(text: Column, reference: Column | None = None) -> Column:
    """LAY-25: page furniture and printed totals, by phrases anywhere in the description and the reference."""
    s = F.upper(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(reference if reference is not None else F.lit(""), F.lit(""))))
    return _any(s, [re.escape(p) for p in NOISE_PHRASES]) | _any(s, NOISE_TEXTS)


def is_summary(text: Column) -> Column:
    """LAY-26: rows of totals and of balances carried over."""
    return _any(F.upper(F.coalesce(text, F.lit(""))), SUMMARY_TEXTS)


def is_bank_noise(bank: Column, text: Column) -> Column:
    """LAY-27: footers and headers that one bank prints. Null bank or text: no."""
    s = F.upper(F.coalesce(text, F.lit("")))
    out = F.when(bank == "uba", _any(F.replace(s, F.lit(" "), F.lit("")), [re.escape(p.replace(" ", "")) for p in UBA_FOOTERS]))
    for name, words in BANK_NOISE.items():
        own = _any(s, [re.escape(w) for w in words])
        own = own | s.rlike("^BALANCE:") | F.coalesce(text, F.lit("")).rlike("Money In|Narration") if name == "sterling" else own | (s.contains("DEBIT") & s.contains("CREDIT")) if name == "fcmb" else own
        out = out.when(bank == name, own)
    return F.coalesce(out, F.lit(False))


def fields(bank: Column, text: Column) -> dict[str, Column]:
    """LAY-41, 42, 45: a statement's printed fields by its bank's patterns, amounts as decimals, texts up to the end of their line;
    null where nothing matches. Banks without patterns of their own use the common ones."""
    t, out = F.coalesce(text, F.lit("")), {}
    for field, common in FIELDS.items():

        def read(pattern: str, field: str = field) -> Column:
            groups = [F.nullif(F.trim(F.element_at(F.split(F.trim(F.regexp_extract(t, pattern, k + 1)), r"\n"), 1)), F.lit("")) for k in range(re.compile(pattern).groups)]
            found = F.nullif(F.concat_ws(" to ", *groups), F.lit(""))
            return found if field in ("account_name", "statement_period") else F.regexp_replace(found, ",", "").try_cast("decimal(18,2)")

        own = None
        for name, patterns in OWN_FIELDS.items():
            if field in patterns:
                own = F.when(bank == name, read(patterns[field])) if own is None else own.when(bank == name, read(patterns[field]))
        out[field] = read(common) if own is None else own.otherwise(read(common))
    return out


def header_field(bank: Column, cell: Column) -> Column:
    """LAY-14: the column that a header cell names in its bank's layout, else null. A bank whose date column is a plain ``Date``
    has the value date tried first."""
    out = None
    for name, patterns in HEADERS.items():
        order = sorted(patterns, key=lambda f: f == "trans_date")
        own = F.coalesce(*[F.when(cell.rlike(f"(?i){patterns[f]}"), f) for f in order])
        out = F.when(bank == name, own) if out is None else out.when(bank == name, own)
    return out


def header_cuts(words: DataFrame, gap: float = 8.0, least: int = 3, far: float = 10_000.0) -> DataFrame:
    """LAY-12 to 14 for many banks at once. ``words(file_id, page_no, line_id, word_seq, text, x0, x1, bank)``; words of a line closer
    than ``gap`` are one cell. The line that names most columns (three at least; of equals the topmost) is the header; cuts lie
    halfway between anchors, text at its left edge and amounts at their right one. Pages without a header or a known bank: no rows."""
    page, line = ["file_id", "page_no"], ["file_id", "page_no", "line_id"]
    w = Window.partitionBy(*line).orderBy("x0", "word_seq")
    x = words.where(F.col("bank").isin(list(HEADERS))).withColumn("_s", F.coalesce(F.col("x0") - F.lag("x1").over(w) >= gap, F.lit(False)).cast("int")).withColumn("_c", F.sum("_s").over(w))
    cells = x.groupBy(*line, "_c").agg(F.min("bank").alias("bank"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text"))), lambda v: v["text"]), " ").alias("cell"))
    named = cells.withColumn("col_name", header_field(F.col("bank"), F.col("cell"))).where("col_name is not null")
    anchor = F.when(F.col("col_name").isin(*MONEY_FIELDS), F.col("x1")).otherwise(F.col("x0"))
    one = named.groupBy(*line, "bank", "col_name").agg(F.min(anchor).alias("anchor"))
    lines = one.groupBy(*line, "bank").agg(F.count("*").alias("hits"), F.array_sort(F.collect_list(F.struct("anchor", "col_name"))).alias("cols")).where(F.col("hits") >= least)
    best = lines.groupBy(*page, "bank").agg(F.max_by("cols", F.struct("hits", -F.col("line_id"))).alias("cols"))
    half = lambda i, j, end: F.coalesce((F.get("cols", i)["anchor"] + F.get("cols", j)["anchor"]) / 2, F.lit(end))
    at = best.select(*page, "bank", "cols", F.posexplode("cols").alias("col_ord", "c"))
    return at.select(*page, "bank", "col_ord", "c.col_name", half(F.col("col_ord") - 1, F.col("col_ord"), -far).alias("x_left"), half(F.col("col_ord"), F.col("col_ord") + 1, far).alias("x_right"))
