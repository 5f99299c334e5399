"""FLT, JON, UDF: filters of the review queue, look-ups as joins, and the hook for an external classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.chain import KEY
from ledgerflow.operators.summary import needs_review

REVIEW = "Review Required"
UNAVAILABLE = "No deterministic rule matched and AI provider is unavailable."


def with_movement(df: DataFrame) -> DataFrame:
    """FLT-01: rows that move money."""
    return df.where("debit <> 0 or credit <> 0")


def not_all_zero(df: DataFrame) -> DataFrame:
    """FLT-02: rows with any figure."""
    return df.where("debit <> 0 or credit <> 0 or balance <> 0")


def side(name: str) -> Column:
    """FLT-04: rows of a side, by amounts other than zero (a negative debit is a debit)."""
    return {"debit": F.col("debit") != 0, "credit": F.col("credit") != 0}.get(name, F.lit(True))


def review_queue(df: DataFrame, show: str = "all") -> DataFrame:
    """FLT-05: all rows, flagged ones, or those of low confidence."""
    return {"review": df.where("review_required"), "low": df.where("confidence_label = 'Low'")}.get(show, df)


def unresolved(df: DataFrame) -> DataFrame:
    """FLT-06."""
    return df.where(needs_review())


def plain_number(c: Column) -> Column:
    """A decimal as a person types it: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(18,2)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def search(df: DataFrame, term: str, text: str = "narration") -> DataFrame:
    """FLT-07: free text over narration, category, date and amounts."""
    t = term.lower()
    return df.where(F.lower(text).contains(t) | F.lower("category").contains(t) | F.col("txn_date").cast("string").contains(t) | plain_number(F.col("debit")).contains(t) | plain_number(F.col("credit")).contains(t))


def visible_words(words: DataFrame, top: float, bottom: float) -> DataFrame:
    """FLT-09: words inside the page's visible area."""
    return words.where(F.col("top").between(top, bottom))


def merge_results(df: DataFrame, results: DataFrame, txn_id: str = "txn_id") -> DataFrame:
    """JON-01: classifier results by id, field by field; of several the last (``seq``) wins."""
    names = ("category", "sub_category", "tax_authority", "confidence_label", "reason", "decision_source", "review_required")
    last = results.groupBy(txn_id).agg(F.max_by(F.struct(*names), "seq").alias("_n"))
    out, got, new = df.join(last, txn_id, "left"), F.col("_n").isNotNull(), lambda c: F.col(f"_n.{c}")
    values = {
        "category": F.coalesce(new("category"), F.lit(REVIEW)), "sub_category": new("sub_category"), "tax_authority": F.coalesce(new("tax_authority"), "tax_authority"), "confidence_label": F.coalesce(new("confidence_label"), F.lit("Low")),
        "reason": F.coalesce(new("reason"), F.lit("Classified by AI fallback.")), "decision_source": F.coalesce(new("decision_source"), F.lit("AI")), "review_required": F.coalesce(new("review_required"), F.lit(False)) | F.coalesce(new("confidence_label") == "Low", F.lit(False)),
    }
    return out.withColumns({c: F.when(got, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_n")


def requested_only(results: DataFrame, requested: DataFrame, txn_id: str = "txn_id") -> DataFrame:
    """JON-02."""
    return results.join(requested.select(txn_id), txn_id, "left_semi")


def check_labels(results: DataFrame, allowed: DataFrame) -> DataFrame:
    """JON-03: labels outside the template become Review Required; unknown confidence becomes Low."""
    ok = allowed.select(F.col("label").alias("category")).distinct().withColumn("_ok", F.lit(True))
    out = results.join(ok, "category", "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    label = F.when(F.col("confidence_label").isin("High", "Medium", "Low"), F.col("confidence_label")).otherwise("Low")
    review = F.coalesce("review_required", F.lit(False)) | F.coalesce(F.col("confidence_label") == "Low", F.lit(False)) | ~F.col("_ok")
    reason = F.when(F.col("_ok"), F.col("reason")).otherwise("AI returned a category outside the selected template.")
    return out.withColumns({"review_required": review, "confidence_label": label, "reason": reason, "decision_source": F.lit("AI"), "category": F.when(F.col("_ok"), F.col("category")).otherwise(REVIEW)}).drop("_ok")


def zip_by_position(df: DataFrame, arrays: DataFrame, key: Sequence[str] = KEY, values: str = "labels") -> DataFrame:
    """JON-04: the n-th element of a statement's result array with its n-th row."""
    each = arrays.select(*key, F.posexplode(values).alias("_p", "label"))
    numbered = df.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy("row_seq")) - 1)
    return numbered.join(each, [*key, "_p"], "left").drop("_p")


def apply_overrides(df: DataFrame, overrides: DataFrame, txn_id: str = "txn_id") -> DataFrame:
    """JON-05: manual categories by id; the latest wins."""
    last = overrides.groupBy(txn_id).agg(F.max_by("category", "seq").alias("_c"))
    hit = F.col("_c").isNotNull()
    values = {"category": F.coalesce("_c", "category"), "decision_source": F.when(hit, "MANUAL").otherwise(F.col("decision_source")), "confidence_label": F.when(hit, "High").otherwise(F.col("confidence_label")), "review_required": F.when(hit, False).otherwise(F.col("review_required"))}
    return df.join(last, txn_id, "left").withColumns(values).drop("_c")


def flag_rows(df: DataFrame, errors: DataFrame, key: Sequence[str] = KEY, score: str = "confidence") -> DataFrame:
    """JON-06: anomaly for rows in the error table, review for weak ones, else ok."""
    bad = errors.select(*key, "row_seq").distinct().withColumn("_e", F.lit(True))
    weak = (F.col("category") == REVIEW) | (F.col(score) < 0.7)
    return df.join(bad, [*key, "row_seq"], "left").withColumn("flag", F.when(F.col("_e"), "anomaly").when(weak, "review").otherwise("ok")).drop("_e")


def with_metadata(df: DataFrame, meta: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """JON-09: each row with its statement's bank and account."""
    return df.join(meta.select(*key, "bank", "account_no"), list(key), "left")


def retry_by_account(missing: DataFrame, candidates: DataFrame) -> DataFrame:
    """JON-10: statements without totals matched by account number with a second extraction that has them."""
    new = candidates.select("account_no", F.col("statement_total_debit").alias("d"), F.col("statement_total_credit").alias("c"))
    out = missing.join(new, "account_no", "left")
    return out.withColumns({"statement_total_debit": F.coalesce("statement_total_debit", "d"), "statement_total_credit": F.coalesce("statement_total_credit", "c")}).drop("d", "c")


RESULT = "txn_id string, category string, sub_category string, tax_authority string, confidence_label string, reason string, review_required boolean"


def external_classifier(df: DataFrame, hook: Callable[[pd.DataFrame], pd.DataFrame] | None = None, allowed: DataFrame | None = None, tax_template: bool = False, batch: int = 35) -> DataFrame:
    """UDF-01: send unresolved rows through ``hook`` in batches and merge what it returns.

    The hook gets a pandas frame of (txn_id, narration, debit, credit) and returns rows of RESULT. A batch that fails twice,
    or no hook at all, gives the fixed fallback. Batches are cut inside each partition; nothing is collected.
    """
    ask = unresolved(df).select("txn_id", "narration", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))
    authority = REVIEW if tax_template else None
    if hook is None:
        fixed = ask.select("txn_id", F.lit(REVIEW).alias("category"), F.lit(None).cast("string").alias("sub_category"), F.lit(authority).cast("string").alias("tax_authority"), F.lit("Low").alias("confidence_label"), F.lit(UNAVAILABLE).alias("reason"), F.lit("SYSTEM").alias("decision_source"), F.lit(True).alias("review_required"), F.lit(0).alias("seq"))
        return merge_results(df, fixed)
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                for attempt in range(2):
                    try:
                        yield hook(part)[columns].assign(failed=False)
                        break
                    except Exception:  # the hook is foreign code; two failures give the fallback
                        if attempt:
                            yield pd.DataFrame({"txn_id": part["txn_id"], "category": REVIEW, "sub_category": None, "tax_authority": authority, "confidence_label": "Low", "reason": UNAVAILABLE, "review_required": True, "failed": True})

    answered = requested_only(ask.mapInPandas(run, RESULT + ", failed boolean"), ask)
    failed = answered.where("failed").withColumn("decision_source", F.lit("SYSTEM"))
    good = answered.where("not failed")
    good = check_labels(good, allowed) if allowed is not None else good.withColumn("decision_source", F.lit("AI"))
    return merge_results(df, good.unionByName(failed).drop("failed").withColumn("seq", F.lit(0)))
