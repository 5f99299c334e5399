"""SCL-T: cleaning of narrations, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letterhead phrases removed from narrations, in this order.
LETTERHEAD = ["PLEASE ADDRESS ALL ENQUIRIES", "P.O.BOX", "VICTORIA IS", "IKOYI", "LAGOS", "RC NO", "RC ", "REGISTERED OFFICE", "MEMBER OF THE NIGERIA DEPOSIT INSURANCE CORPORATION", "NDIC", "WWW.", "PLOT 635, AKIN ADESOLA"]
#: Transfer prefixes in front of a counterparty's name, in this order.
PREFIXES = ["NIP TRANSFER", "COB TRF TO", "COB TRF", "TRF FROM", "NIP FROM", "PP ", "REV PP", "ONB TRANSFER FROM", "POS PURCHASE", "OMNI BO", "TRN IFO NIP OUTWARD ACCOUNT", "LOCAL TRANSFERS OTHER BANKS", r"GAPS\d*", "TRSF IFO", "FT IFO", r"BO\s+[\w\s]+\s+IFO"]
DELIMITERS = [" TO ", " FROM ", " IFO ", ":", ",", "/"]
#: Parts that are no name.
NO_NAMES = ["OPERATIONS", "SALARY", "MAY SALARY", "JUNE SALARY"]
#: Fixed value: spaces outside ASCII, and the soft hyphen.
SPACES = "[  ᠎ -‍    ⁠﻿­]"
#: Letterhead and footer patterns that leak into narrations.
FURNITURE = [r"PLEASE\s+ADDRESS\s+ALL\s+ENQUIRIES", r"P\.?O\.?\s*BOX\s*\d*", r"VICTORIA\s+IS(?:LAND)?", "IKOYI", "LAGOS", r"RC\s*\d+", r"REGISTERED\s+OFFICE", r"MEMBER\s+OF\s+THE\s+NIGERIA\s+DEPOSIT\s+INSURANCE\s+CORPORATION", "NDIC", r"WWW\.\S+\.COM", r"PLOT\s+\d+.*AKIN\s+ADESOLA"]


def _sub(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it and wherever the optimiser
    moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise(raw: Column) -> Column:
    """SCL-T1: upper case without letterhead, phone numbers, long digit runs and marks other than slash and comma."""
    s = F.upper(F.coalesce(raw, F.lit("")))
    for b in LETTERHEAD:
        s = F.replace(s, F.lit(b), F.lit(" "))
    return squeeze(_sub(s, (r"\b0[7-9][0-1]\d{8}\b", " "), (r"\b\d{10,}\b", " "), (r"[^A-Z0-9\s/,]", " ")))


def normalise_front(raw: Column) -> Column:
    """SCL-T2: upper case, letters and digits only."""
    return squeeze(_sub(F.upper(F.coalesce(raw, F.lit(""))), (r"[^A-Z0-9\s]", " ")))


def clean_description(raw: Column) -> Column:
    """SCL-T3: broken suffixes rejoined, header words and a trailing date removed. Compatibility forms of non-ASCII text
    are folded before by ``fold_compatibility``."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), SPACES, " ")
    s = _sub(s, (r"(?i)\bL\s*T\s*D\b", "LTD"), (r"(?i)\bLIMITE\b", "LIMITED"), (r"(?i)\b\d{1,2}/\d{1,2}/\d{4}\s+Details\b", " "), (r"(?i)\bTransaction\s+Date\b", " "), (r"(?i)\bValue\s+Date\b", " "), (r"(?i)\bDetails\b", " "), (r"(?i)\b\d+\s+of\s+\d+\b", " "), (r"\s+\d{1,2}/\d{1,2}/\d{4}\s*$", ""))
    return squeeze(s)


def fold_compatibility(df: DataFrame, column: str) -> DataFrame:
    """NFKC of a column. Spark has no such function: rows that are ASCII send nothing to Python, and the others go in pickled batches,
    which hold a hundred rows at most where Arrow's hold ten thousand, so a worker's memory does not grow with the input."""

    @F.udf("string", useArrow=False)
    def nfkc(part: str | None) -> str | None:
        return None if part is None else unicodedata.normalize("NFKC", part)

    odd = F.col(column).rlike(r"[^\x00-\x7F]")
    return df.withColumn(column, F.when(odd, nfkc(F.when(odd, F.col(column)))).otherwise(F.col(column)))


def narration_words(raw: Column) -> Column:
    """SCL-T4: lower-case words of a cleaned description, with quotes and dashes folded; what keyword rules match."""
    s = _sub(clean_description(raw), ("[‐-―]", "-"), ("[‘’`´]", "'"), ("[“”]", '"'))
    return squeeze(_sub(F.lower(s), (r"[^\p{L}\p{N}@&*'/-]+", " "), (r"[-_/]+", " ")))


def scrub_furniture(raw: Column) -> Column:
    """SCL-T5: narration without letterhead and doubled marks."""
    return squeeze(_sub(F.coalesce(raw, F.lit("")), *[(f"(?i){p}", " ") for p in FURNITURE], (r"[.:,\s]{2,}", " "), (r"[.,\s]+$", ""), (r"^[.:,\s]+", "")))


def entity(norm: Column) -> Column:
    """SCL-T6: the counterparty: prefixes stripped in turn, then for each delimiter the last part that can be a name."""
    e = norm
    for p in PREFIXES:
        e = F.trim(F.regexp_replace(e, f"^{p}", ""))

    def last_name(so_far: Column, delimiter: Column) -> Column:
        parts = F.transform(F.reverse(F.split(so_far, delimiter)), lambda p: F.trim(p))
        fit = F.filter(parts, lambda p: (F.length(p) > 3) & ~p.rlike(r"^\d+$") & ~p.startswith("PP_") & ~p.startswith("GAPS") & ~p.startswith("REV_") & ~F.upper(p).isin(NO_NAMES))
        return F.when(F.contains(so_far, delimiter), F.coalesce(F.get(fit, 0), so_far)).otherwise(so_far)

    e = F.aggregate(F.array(*map(F.lit, DELIMITERS)), e, last_name)
    return F.trim(F.regexp_replace(e, r"\b\d{5,}\b", ""))


def remarks(reference: Column, branch: Column, description: Column) -> Column:
    """SCL-T7: reference, branch (unless the description has it) and description, placeholders left out."""
    real = lambda c: F.when(~F.upper(F.trim(c)).isin("", "-", "N/A", "NIL", "NONE", "NULL"), F.trim(c))
    return F.concat_ws(" ", real(reference), F.when(~F.upper(F.coalesce(description, F.lit(""))).contains(F.upper(branch)), real(branch)), real(description))


def repair_reference(df: DataFrame, text: str = "description") -> DataFrame:
    """SCL-T8: a reference in front of or inside the description moves to its own column, once; the rest is squeezed."""
    found = reference(F.col(text))
    return df.withColumn("reference", F.coalesce(F.nullif(F.trim("reference"), F.lit("")), found)).withColumn(text, squeeze(F.when(F.col("reference").isNotNull(), F.replace(F.col(text), F.col("reference"), F.lit(" "))).otherwise(F.col(text))))


def reference(raw: Column) -> Column:
    """SCL-T9: what follows REF or REF NO, else a trailing slash and ten or more digits."""
    s = F.coalesce(raw, F.lit(""))
    some = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    return F.coalesce(some(r"(?i)\bREF(?:\s*NO)?[:.\s]+([A-Z0-9/]{4,})"), some(r"/(\d{10,})\s*$"))


def drop_noise_tokens(raw: Column, noise: list[str]) -> Column:
    """SCL-T10: without header words and date tokens."""
    return F.array_join(F.filter(F.split(squeeze(F.coalesce(raw, F.lit(""))), " "), lambda t: ~F.upper(t).isin(noise) & ~t.rlike(r"^\d{1,2}[-/](\d{1,2}|[A-Za-z]{3})[-/](\d{2,4})?$")), " ")


def strip_repeated_prefix(raw: Column, verbs: list[str]) -> Column:
    """SCL-T11: words before the first narration verb once each."""
    s = squeeze(F.coalesce(raw, F.lit("")))
    at = F.regexp_instr(s, F.lit("\\b(" + "|".join(verbs) + ")\\b"))
    head = F.array_join(F.array_distinct(F.split(F.trim(F.substring(s, F.lit(1), at - 1)), " ")), " ")
    return F.when(at > 1, F.concat_ws(" ", head, F.substring(s, at, F.length(s)))).otherwise(s)


def or_reference(description: Column, reference_: Column) -> Column:
    """SCL-T12: the description, or the reference where it is empty."""
    return F.coalesce(F.nullif(F.trim(description), F.lit("")), reference_)


def safe_join(*parts: Column) -> Column:
    """SCL-T13: the non-empty parts, one space between."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")), " ")


def has_keyword(words: Column, keyword: str) -> Column:
    """SCL-T14: a single word as a whole word, a phrase as a substring; ``words`` from ``narration_words``, the keyword in
    its lower-case form."""
    k = " ".join(keyword.lower().split())
    if not k:
        return F.lit(False)
    return F.concat(F.lit(" "), words, F.lit(" ")).contains(f" {k} ") if " " not in k else words.contains(k)


def has_any(words: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | has_keyword(words, k)
    return out


def confidence_label(score: Column) -> Column:
    """SCL-T15: High from 0.8, Medium from 0.55, else Low."""
    return F.when(score >= 0.8, "High").when(score >= 0.55, "Medium").otherwise("Low")


def confidence_score(label: Column) -> Column:
    """SCL-T15: the number of a label; 0.85 for others."""
    return F.when(label == "High", 0.9).when(label == "Medium", 0.65).when(label == "Low", 0.5).otherwise(0.85)


#: Fixed values of SCL-T8: a branch, a branch in front of a text, and references that stand for none.
BRANCH = r"^\s*\d{3}\s+[A-Z][A-Z ]+\s*$"
BRANCH_IN_FRONT = r"^\s*(\d{3}\s+[A-Z][A-Z ]+)\s+(.*)$"
PLACEHOLDERS = ["'", "GAP", "'GAP"]


def repair_fields(df: DataFrame, reference_: str = "reference", branch: str = "branch", text: str = "description") -> DataFrame:
    """SCL-T8: reference, branch and text that run into each other, mended in five steps, each on what the one before left: a branch in
    front of the text; a branch in place of the reference; a reference in front of the text, where there is none; words after a
    reference go in front of the text; placeholders are no reference."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    x = df.withColumns({"_r": bare(F.col(reference_)), "_b": bare(F.col(branch)), "_t": bare(F.col(text))})
    r, b, t = F.col("_r"), F.col("_b"), F.col("_t")
    moves = t.rlike(BRANCH_IN_FRONT) & ~b.rlike(BRANCH)
    x = x.withColumns({"_b": F.when(moves, bare(F.regexp_extract(t, BRANCH_IN_FRONT, 1))).otherwise(b), "_t": F.when(moves, bare(F.regexp_extract(t, BRANCH_IN_FRONT, 2))).otherwise(t)})
    swaps = r.rlike(BRANCH) & (b == "")
    x = x.withColumns({"_b": F.when(swaps, r).otherwise(b), "_r": F.when(swaps, "").otherwise(r)})
    first = F.regexp_extract(t, r"^\S+", 0)
    token = F.regexp_replace(first, "^'+|'+$", "")
    gives = ((r == "") | r.isin(PLACEHOLDERS)) & (F.length(token) >= 6) & token.rlike(r"\d")
    x = x.withColumns({"_r": F.when(gives, first).otherwise(r), "_t": F.when(gives, bare(F.substr(t, F.length(first) + 1))).otherwise(t)})
    words = F.split(r, r"\s+")
    spills = F.contains(r, F.lit(" "))
    x = x.withColumns({"_r": F.when(spills, F.get(words, F.lit(0))).otherwise(r), "_t": F.when(spills, bare(F.concat_ws(" ", F.array_join(F.slice(words, 2, 1_000_000), " "), t))).otherwise(t)})
    return x.withColumns({reference_: F.when(r.isin(PLACEHOLDERS), "").otherwise(r), branch: b, text: t}).drop("_r", "_b", "_t")
