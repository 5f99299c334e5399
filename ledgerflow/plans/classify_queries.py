"""Queries of rules, templates, review and look-ups over the derived ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import chain, review, rules, summary, templates
from ledgerflow.plans.chain_queries import AUDIT_SQL, plain
from ledgerflow.plans.fixtures import LEDGER_SQL, META_SQL, ledger, statement_meta
from ledgerflow.plans.registry import query
from ledgerflow.plans.scalar_queries import CLEAN_SQL, NORM_SQL, WORDS_SQL

# --- rules -----------------------------------------------------------------------------------------------------------

_norm = NORM_SQL.replace("raw", "narration")
_front = r"trim(regexp_replace(regexp_replace(upper(narration), '[^A-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _says(category: str, confidence: float, rule: str | None, source: str) -> str:
    return f"'{category}|{confidence}|{rule or ''}|{source}'"


def _hit(pattern: str) -> str:
    """RE2 has no look-ahead: maintenance followed directly by one of the words is taken out first."""
    word = r"MAINTENANCE\s*(?!FEE|CHG|CHARGE|ACCT|ACCOUNT)"
    text = "nd"
    if word in pattern:
        pattern, text = pattern.replace(word, "MAINTENANCE"), "regexp_replace(nd, 'MAINTENANCE(FEE|CHG|CHARGE|ACCT|ACCOUNT)', ' ', 'g')"
    return f"regexp_matches({text}, '(?i){pattern}')"


def _rule_branches(rows: list[rules.Rule], debit: str, credit: str) -> str:
    out = []
    for r in rules.in_order(rows):
        test = [{"debit": debit, "credit": credit}.get(r.side, "true"), _hit(r.pattern)] + ([f"NOT {_hit(r.exclude)}"] if r.exclude else [])
        out.append(f"WHEN {' AND '.join(test)} THEN {_says(r.category, r.confidence, r.rule_id, 'RULE')}")
    return "\n".join(out)


def _amounts(values: list[float], tolerance: str = "0.01") -> str:
    return "(" + " OR ".join(f"abs(abs(debit) - {v}) <= {tolerance}" for v in values) + ")"


_m = lambda p: f"regexp_matches(nd, '{p}')"
_AMOUNT = f"""WHEN debit <> 0 AND {_amounts([50])} AND {_m("STAMP|LEVY")} THEN {_says("Bank Charges", 1.0, "R010_BANK_STAMP_DUTY", "RULE_SPECIFIC")}
WHEN debit <> 0 AND {_amounts([3.75, 53.75, 26.88])} THEN {_says("Bank Charges", 1.0, "R014_SPECIFIC_AMOUNT_CHARGES", "RULE_SPECIFIC")}
WHEN debit <> 0 AND {_amounts([50, 52.5, 10, 4])} AND ({_m("CHG|FEE|VAT|SMS|COMM|MAINT|LEVY|DUTY")} OR (NOT {_m("TRF|NIP|PAYMENT|PYMT|WEB|POS|ATM|DATA|AIRTIME")} AND NOT {_m("OPENING *BAL")})) THEN {_says("Bank Charges", 0.99, "AMT_STD_FEE", "RULE")}"""


def _rest(is_debit: str) -> str:
    return f"""WHEN {is_debit} AND {_m(rules.CHARGE_WORDS)} AND NOT {_m(rules.NOT_CHARGE_WORDS)} THEN {_says("Bank Charges", 0.8, None, "RULE")}
WHEN {is_debit} AND {_m(rules.MOVE_WORDS)} THEN {_says(rules.OWN_TRANSFER, 0.6, None, "AI_HEURISTIC")} WHEN {is_debit} THEN {_says("Uncategorized Expense", 0.0, None, "AI")} ELSE {_says("Uncategorized Income", 0.0, None, "AI")}"""


_split = "split_part(v, '|', 1) AS category, CAST(split_part(v, '|', 2) AS DOUBLE) AS confidence, nullif(split_part(v, '|', 3), '') AS rule_id, split_part(v, '|', 4) AS decision_source"
CLASSIFIED_SQL = f"""{LEDGER_SQL}, nrm AS (SELECT *, {_norm} AS nd FROM ledger),
ruled AS (SELECT *, CASE {_AMOUNT}
{_rule_branches(rules.built_in(), "debit <> 0", "credit <> 0")}
{_rest("debit <> 0")} END AS v FROM nrm),
classified AS (SELECT * EXCLUDE (v), {_split}, regexp_matches(nd, '{rules.REVERSAL}') AS is_reversal FROM ruled)"""


def classified(spark, sf_dir) -> DataFrame:
    return rules.categorise(ledger(spark, sf_dir))


@query("cls_01_prioritised_rules", f"WITH {CLASSIFIED_SQL} SELECT stmt_id, row_seq, category, confidence, rule_id, decision_source FROM classified")
def _(spark, sf_dir):
    return classified(spark, sf_dir).select("stmt_id", "row_seq", "category", "confidence", "rule_id", "decision_source")


@query("cls_02_front_end_rules", f"""WITH {LEDGER_SQL}, nrm AS (SELECT *, {_front} AS nd, CASE WHEN event_id % 3 = 0 THEN 'Rent' END AS prior FROM ledger),
vs AS (SELECT *, CASE WHEN debit > 0 AND {_amounts([50, 3.75, 52.5, 10, 4], "0.001")} AND NOT {_m("OPENING *BAL")} THEN {_says("Bank Charges", 1.0, "AMT_STD_FEE", "RULE")}
{_rule_branches(rules.FRONT_END, "debit > 0", "credit > 0")} WHEN prior IS NOT NULL THEN {_says("Rent", 0.85, None, "AI")}
{_rest("debit > 0")} END AS v FROM nrm) SELECT stmt_id, row_seq, {_split} FROM vs""")
def _(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("category", F.when(F.col("event_id") % 3 == 0, "Rent"))
    return rules.categorise_front(rows).select("stmt_id", "row_seq", "category", "confidence", "rule_id", "decision_source")


@query("cls_03_amount_rules", f"WITH {CLASSIFIED_SQL} SELECT stmt_id, row_seq, category, rule_id FROM classified WHERE decision_source = 'RULE_SPECIFIC' OR rule_id = 'AMT_STD_FEE'")
def _(spark, sf_dir):
    say = rules.Verdicts()
    rows = ledger(spark, sf_dir).withColumn("nd", rules.text.normalise(F.col("narration"))).withColumn("v", rules.amount_rules(F.col("nd"), F.col("debit"), say))
    return rows.where("v is not null").withColumns(say.columns(F.col("v"))).select("stmt_id", "row_seq", "category", "rule_id")


@query("cls_05_fallbacks", f"WITH {CLASSIFIED_SQL} SELECT category, decision_source, count(*) AS n, CAST(sum(debit) AS DOUBLE) AS debit_total FROM classified WHERE rule_id IS NULL GROUP BY category, decision_source")
def _(spark, sf_dir):
    g = classified(spark, sf_dir).where("rule_id is null").groupBy("category", "decision_source")
    return plain(g.agg(F.count("*").alias("n"), F.sum("debit").alias("debit_total")))


@query("cls_07_reversals", f"WITH {CLASSIFIED_SQL} SELECT stmt_id, count(*) FILTER (is_reversal) AS n_reversals, count(*) AS n FROM classified GROUP BY stmt_id")
def _(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("stmt_id").agg(F.count_if("is_reversal").alias("n_reversals"), F.count("*").alias("n"))


@query("cls_08_unresolved", f"WITH {CLASSIFIED_SQL} SELECT stmt_id, row_seq, category FROM classified WHERE decision_source IN ('AI', 'AI_HEURISTIC') OR category LIKE 'Uncategorized%'")
def _(spark, sf_dir):
    return rules.unresolved(classified(spark, sf_dir)).select("stmt_id", "row_seq", "category")


@query("jon_08_rule_table", f"""WITH {LEDGER_SQL}, nrm AS (SELECT *, {_norm} AS nd FROM ledger), vs AS (SELECT *, CASE {_rule_branches(rules.built_in(), "debit <> 0", "credit <> 0")} END AS v FROM nrm)
SELECT stmt_id, row_seq, nullif(split_part(v, '|', 3), '') AS rule_id FROM vs""")
def _(spark, sf_dir):
    table = spark.createDataFrame([(i, r.rule_id, r.priority, r.side, f"(?i){r.pattern}", r.exclude and f"(?i){r.exclude}", r.category, r.confidence) for i, r in enumerate(rules.built_in())], "rule_ord int, rule_id string, priority int, side string, pattern string, exclude string, category string, confidence double")
    rows = ledger(spark, sf_dir).withColumn("clean_description", rules.text.normalise(F.col("narration")))
    return rules.match_rule_table(rows, table, ["stmt_id", "row_seq"]).select("stmt_id", "row_seq", "rule_id")


# --- templates -------------------------------------------------------------------------------------------------------

_desc = CLEAN_SQL.replace("raw", "narration")
_words = WORDS_SQL.replace("raw", f"({_desc} || '  ' || narration)")


def _kw(k: str) -> str:
    k = " ".join(k.lower().split()).replace("'", "''")
    return f"contains(w, '{k}')" if " " in k else f"contains(' ' || w || ' ', ' {k} ')"


def _any(ks: list[str]) -> str:
    return "(" + " OR ".join(map(_kw, ks)) + ")" if ks else "false"


_scope = {"debit": "debit > 0", "credit": "credit > 0", "both": "true"}


def _said(category: str, confidence: str, reason: str, source: str = "RULE", review: bool = False, authority: str = "") -> str:
    return "'" + "|".join([category, authority, confidence, reason.replace("'", "''"), source, str(review).lower()]) + "'"


_tok = lambda extra="": rf"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(w, '\b({templates.FILLERS}{extra})\b', ' ', 'g'), '[@*&0-9]+', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda t: regexp_matches(t, '^[a-z]{{3,}}$'))"
_ent, _na = _any(templates.ENTITY), _any(templates.NOT_APPLICABLE)
_pos = f"({_kw('pos purchase')} OR {_kw('pos purch')} OR starts_with(w, 'pos '))"
_fee = f"(debit > 0 AND credit <= 0 AND ({' OR '.join(f'abs(debit - {a}) <= 0.01' for a in templates.CHARGE_AMOUNTS)}) AND {_any(templates.CHARGE_WORDS)})"
PERSON_SQL = f"(NOT ({_ent} OR {_pos} OR {_na} OR {_any(templates.NOT_PERSONS)}) AND ({_any(templates.TITLES)} OR (NOT {_any(['cob trf', 'trf to', 'nip transfer'])} AND len({_tok()}) >= 2 AND len(list_filter(list_slice({_tok()}, 1, 4), lambda t: length(t) > 3)) > 0)))"
TRADE_SQL = f"(NOT {_ent} AND NOT {_na} AND {_any(templates.TRADE_CONTEXT)} AND NOT {_any([*templates.TITLES, 'salary', 'payroll'])} AND ({_any(templates.TRADE_HINTS)} OR len({_tok('|pos|purchase')}) BETWEEN 1 AND 3))"


def _template_sql(t: templates.Template) -> str:
    if t.template_id == "firs-sirs-na":
        own = lambda c, conf, why: _said(c, conf, why, "RULE", False, c)
        rev = lambda why, conf="Low": _said("Review Required", conf, why, "SYSTEM", True, "Review Required")
        sirs = t.categories[2]
        body = f"""WHEN {_fee} THEN {own("Not Applicable", "High", "Matched common bank transfer/NIP charge pattern.")} WHEN {_na} THEN {own("Not Applicable", "High", "Matched non-taxable bank item before entity classification.")}
WHEN {_pos} AND {_ent} THEN {own("FIRS", "High", "POS narration contains a strong company/entity indicator.")} WHEN {_pos} THEN {rev("POS merchant name has no strong company/entity indicator.")}
WHEN {_ent} THEN {own("FIRS", "High", "Matched strong company/entity or tax authority indicator.")} WHEN {_kw("limi")} THEN {rev("Possible broken LIMITED suffix needs review.", "Medium")}
WHEN {_any(templates.SALARY)} THEN {rev("Salary/payroll payment requires review.")} WHEN {_any(sirs.include)} AND NOT {_any(sirs.exclude)} THEN {own("SIRS", "Medium", "Matched individual-payment rule keyword.")}
WHEN {TRADE_SQL} THEN {rev("Possible unregistered business/trade name requires review.")} WHEN {PERSON_SQL} THEN {own("SIRS", "Medium", "Narration resembles a personal-name payment.")} ELSE {rev("No deterministic rule matched.")}"""
    else:
        body = " ".join(f"WHEN {_scope[c.applies_to]} AND {_any(c.include)} AND NOT {_any(c.exclude)} THEN {_said(c.output, 'High', f'Matched rule {chr(34)}{c.name}{chr(34)} by keyword.')}" for c in sorted(t.categories, key=lambda c: -c.priority) if c.include)
        body += f" ELSE {_said('Review Required', 'Low', 'No deterministic rule matched.', 'SYSTEM', True)}"
    outside = _said("Out of Scope", "High", f"Template analyzes {t.scope} transactions only.", "SYSTEM")
    return f"""{LEDGER_SQL}, tw AS (SELECT *, {_words} AS w FROM ledger), tv AS (SELECT *, CASE WHEN NOT ({_scope[t.scope]}) THEN {outside} {body} END AS v FROM tw),
templated AS (SELECT * EXCLUDE (v, w), 'txn-' || stmt_id || '-' || row_seq AS txn_id, split_part(v, '|', 1) AS category, nullif(split_part(v, '|', 2), '') AS tax_authority, split_part(v, '|', 3) AS confidence_label, split_part(v, '|', 4) AS reason, split_part(v, '|', 5) AS decision_source, split_part(v, '|', 6) = 'true' AS review_required FROM tv)"""


ALL = templates.built_in_templates()
TEMPLATED_SQL = {k: _template_sql(t) for k, t in ALL.items() if k != "custom"}
FIELDS = ("stmt_id", "row_seq", "category", "tax_authority", "confidence_label", "reason", "decision_source", "review_required")


def templated(spark, sf_dir, template: str = "firs-sirs-na") -> DataFrame:
    return templates.classify(templates.normalise_rows(ledger(spark, sf_dir)), ALL[template])


def _template_query(name: str, template: str) -> None:
    @query(name, f"WITH {TEMPLATED_SQL[template]} SELECT {', '.join(FIELDS)} FROM templated")
    def _(spark, sf_dir):
        return templated(spark, sf_dir, template).select(*FIELDS)


for _name, _t in (("cls_10_tax_tree", "firs-sirs-na"), ("cls_09_debit_expense", "debit-expense"), ("cls_09_credit_income", "credit-income"), ("cls_09_business", "business-category"), ("cls_09_travel", "travel-tour"), ("cls_09_tax_audit", "tax-audit")):
    _template_query(_name, _t)


@query("cls_09_template_table", f"WITH {TEMPLATED_SQL['debit-expense']} SELECT stmt_id, row_seq, CASE WHEN category = 'Out of Scope' THEN 'Review Required' ELSE category END AS category FROM templated")
def _(spark, sf_dir):
    table = templates.template_rows(spark, ALL["debit-expense"])
    rows = templates.normalise_rows(ledger(spark, sf_dir))
    return templates.classify_by_table(rows, table, ["stmt_id", "row_seq"]).select("stmt_id", "row_seq", "category")


_PREDICATES = {"cls_11_common_charge": (templates.common_charge, _fee), "cls_12_person": (templates.is_person, PERSON_SQL), "cls_13_trade_name": (templates.is_trade_name, TRADE_SQL), "cls_14_entity": (templates.has_entity, _ent), "cls_14_pos": (templates.is_pos, _pos)}


def _predicate_query(name: str, f, sql: str) -> None:
    @query(name, f"WITH {LEDGER_SQL}, tw AS (SELECT *, {_words} AS w FROM ledger) SELECT narration, {sql} AS hit, count(*) AS n FROM tw GROUP BY ALL")
    def _(spark, sf_dir):
        rows = templates.normalise_rows(ledger(spark, sf_dir)).withColumn("w", templates.narration_words(F.concat_ws(" ", "description", "reference", "raw_text")))
        return rows.withColumn("hit", f(F.col("w"))).groupBy("narration", "hit").agg(F.count("*").alias("n"))


for _name, (_f, _sql) in _PREDICATES.items():
    _predicate_query(_name, _f, _sql)


@query("cls_16_normalise_rows", f"WITH {LEDGER_SQL} SELECT 'txn-' || stmt_id || '-' || row_seq AS txn_id, {_desc} AS description, 'Review Required' AS category, 'Low' AS confidence_label, CAST(balance AS DOUBLE) AS balance FROM ledger")
def _(spark, sf_dir):
    return plain(templates.normalise_rows(ledger(spark, sf_dir)), "txn_id", "description", "category", "confidence_label", "balance")


# --- filters ---------------------------------------------------------------------------------------------------------

_T = TEMPLATED_SQL["firs-sirs-na"]
_FILTERS = {
    "flt_01_with_movement": (lambda s, d: review.with_movement(ledger(s, d)), f"{LEDGER_SQL}", "ledger", "debit <> 0 OR credit <> 0"),
    "flt_02_not_all_zero": (lambda s, d: review.not_all_zero(ledger(s, d)), f"{LEDGER_SQL}", "ledger", "debit <> 0 OR credit <> 0 OR balance <> 0"),
    "flt_03_scope": (lambda s, d: ledger(s, d).where(templates.in_scope("debit")), f"{LEDGER_SQL}", "ledger", "debit > 0"),
    "flt_04_side": (lambda s, d: ledger(s, d).where(review.side("credit")), f"{LEDGER_SQL}", "ledger", "credit <> 0"),
    "flt_05_review_queue": (lambda s, d: review.review_queue(templated(s, d), "low"), _T, "templated", "confidence_label = 'Low'"),
    "flt_06_unresolved": (lambda s, d: review.unresolved(templated(s, d)), _T, "templated", "review_required OR confidence_label = 'Low'"),
    "flt_07_search": (lambda s, d: review.search(classified(s, d), "7.5"), CLASSIFIED_SQL, "classified", r"contains(lower(narration), '7.5') OR contains(lower(category), '7.5') OR contains(CAST(txn_date AS VARCHAR), '7.5') OR contains(regexp_replace(regexp_replace(CAST(debit AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', ''), '7.5') OR contains(regexp_replace(regexp_replace(CAST(credit AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', ''), '7.5')"),
}


def _filter_query(name: str, make, ctes: str, source: str, where: str) -> None:
    @query(name, f"WITH {ctes} SELECT stmt_id, row_seq FROM {source} WHERE {where}")
    def _(spark, sf_dir):
        return make(spark, sf_dir).select("stmt_id", "row_seq")


for _name, _args in _FILTERS.items():
    _filter_query(_name, *_args)

# --- look-ups --------------------------------------------------------------------------------------------------------


def results(spark, sf_dir) -> DataFrame:
    """Answers of an external classifier for every fourth row: repeated ids, unknown labels and unknown confidences."""
    n = F.col("event_id")
    base = ledger(spark, sf_dir).where(n % 4 == 0).withColumn("txn_id", F.concat(F.lit("txn-"), F.col("stmt_id").cast("string"), F.lit("-"), F.col("row_seq").cast("string")))
    rows = base.select("txn_id", F.when(n % 3 == 0, "FIRS").when(n % 3 == 1, "Nonsense").otherwise("SIRS").alias("category"), F.lit(None).cast("string").alias("sub_category"), F.when(n % 5 == 0, "FIRS").alias("tax_authority"), F.when(n % 7 == 0, "Certain").when(n % 2 == 0, "High").otherwise("Low").alias("confidence_label"), F.concat(F.lit("said "), n.cast("string")).alias("reason"), (n % 8 == 0).alias("review_required"), F.lit("AI").alias("decision_source"), F.lit(0).alias("seq"))
    return rows.unionByName(rows.where("category = 'SIRS'").withColumns({"category": F.lit("Not Applicable"), "seq": F.lit(1)}))


RESULTS_SQL = """r0 AS (SELECT 'txn-' || stmt_id || '-' || row_seq AS txn_id, CASE event_id % 3 WHEN 0 THEN 'FIRS' WHEN 1 THEN 'Nonsense' ELSE 'SIRS' END AS category, CASE WHEN event_id % 5 = 0 THEN 'FIRS' END AS tax_authority,
 CASE WHEN event_id % 7 = 0 THEN 'Certain' WHEN event_id % 2 = 0 THEN 'High' ELSE 'Low' END AS confidence_label, 'said ' || event_id AS reason, event_id % 8 = 0 AS review_required, 0 AS seq FROM ledger WHERE event_id % 4 = 0),
results AS (SELECT * FROM r0 UNION ALL SELECT * REPLACE ('Not Applicable' AS category, 1 AS seq) FROM r0 WHERE category = 'SIRS')"""
_shown = "t.txn_id, coalesce(n.category, t.category) AS category, coalesce(n.tax_authority, t.tax_authority) AS tax_authority, CASE WHEN n.txn_id IS NULL THEN t.decision_source ELSE 'AI' END AS decision_source, CASE WHEN n.txn_id IS NULL THEN t.review_required ELSE n.review_required OR n.confidence_label = 'Low' END AS review_required"


@query("jon_01_merge_results", f"WITH {_T}, {RESULTS_SQL}, n AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY seq DESC) = 1) SELECT {_shown} FROM templated t LEFT JOIN n USING (txn_id)")
def _(spark, sf_dir):
    out = review.merge_results(templated(spark, sf_dir), results(spark, sf_dir))
    return out.select("txn_id", "category", "tax_authority", "decision_source", "review_required")


@query("jon_02_requested_only", f"WITH {_T}, {RESULTS_SQL} SELECT txn_id, category, seq FROM results WHERE txn_id IN (SELECT txn_id FROM templated WHERE review_required OR confidence_label = 'Low')")
def _(spark, sf_dir):
    return review.requested_only(results(spark, sf_dir), review.unresolved(templated(spark, sf_dir))).select("txn_id", "category", "seq")


@query("jon_03_check_labels", f"""WITH {LEDGER_SQL}, {RESULTS_SQL}, x AS (SELECT *, category IN ('FIRS', 'Not Applicable', 'SIRS') AS ok FROM results)
SELECT txn_id, seq, CASE WHEN ok THEN category ELSE 'Review Required' END AS category, CASE WHEN confidence_label IN ('High', 'Medium', 'Low') THEN confidence_label ELSE 'Low' END AS confidence_label,
CASE WHEN ok THEN reason ELSE 'AI returned a category outside the selected template.' END AS reason, review_required OR confidence_label = 'Low' OR NOT ok AS review_required FROM x""")
def _(spark, sf_dir):
    allowed = templates.template_rows(spark, ALL["firs-sirs-na"])
    return review.check_labels(results(spark, sf_dir), allowed).select("txn_id", "seq", "category", "confidence_label", "reason", "review_required")


@query("jon_04_zip_by_position", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq, CASE WHEN row_seq <= 30 THEN 'L' || row_seq END AS label FROM ledger")
def _(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    arrays = rows.select("stmt_id").distinct().select("stmt_id", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("L"), i.cast("string"))).alias("labels"))
    return review.zip_by_position(rows, arrays).select("stmt_id", "row_seq", "label")


@query("jon_05_overrides", f"""WITH {_T}, o AS (SELECT txn_id, max(event_id % 2) AS s FROM templated WHERE event_id % 9 = 0 GROUP BY txn_id)
SELECT t.txn_id, CASE WHEN o.txn_id IS NULL THEN t.category ELSE 'Manual B' END AS category, CASE WHEN o.txn_id IS NULL THEN t.decision_source ELSE 'MANUAL' END AS decision_source, t.review_required AND o.txn_id IS NULL AS review_required FROM templated t LEFT JOIN o USING (txn_id)""")
def _(spark, sf_dir):
    rows = templated(spark, sf_dir)
    first = rows.where("event_id % 9 = 0").select("txn_id", F.lit("Manual A").alias("category"), F.lit(1).alias("seq"))
    out = review.apply_overrides(rows, first.unionAll(first.select("txn_id", F.lit("Manual B"), F.lit(2))))
    return out.select("txn_id", "category", "decision_source", "review_required")


@query("jon_06_flag_rows", f"WITH {CLASSIFIED_SQL}, {AUDIT_SQL} SELECT c.stmt_id, c.row_seq, CASE WHEN g.row_seq IS NOT NULL THEN 'anomaly' WHEN category = 'Review Required' OR confidence < 0.7 THEN 'review' ELSE 'ok' END AS flag FROM classified c LEFT JOIN gaps g ON c.stmt_id = g.stmt_id AND c.row_seq = g.row_seq")
def _(spark, sf_dir):
    return review.flag_rows(classified(spark, sf_dir), chain.balance_audit(ledger(spark, sf_dir))).select("stmt_id", "row_seq", "flag")


@query("jon_09_with_metadata", f"WITH {LEDGER_SQL}, {META_SQL} SELECT stmt_id, row_seq, bank, account_no FROM ledger JOIN statement_meta USING (stmt_id)")
def _(spark, sf_dir):
    return review.with_metadata(ledger(spark, sf_dir), statement_meta(spark, sf_dir)).select("stmt_id", "row_seq", "bank", "account_no")


@query("jon_10_retry_by_account", f"WITH {LEDGER_SQL}, {META_SQL}, c AS (SELECT account_no, 10.0 AS d, 20.0 AS c FROM statement_meta WHERE stmt_id % 10 = 0) SELECT stmt_id, CAST(coalesce(statement_total_debit, d) AS DOUBLE) AS statement_total_debit, CAST(coalesce(statement_total_credit, c) AS DOUBLE) AS statement_total_credit FROM statement_meta LEFT JOIN c USING (account_no)")
def _(spark, sf_dir):
    meta = statement_meta(spark, sf_dir)
    second = meta.where("stmt_id % 10 = 0").select("account_no", F.lit(10).cast("decimal(18,2)").alias("statement_total_debit"), F.lit(20).cast("decimal(18,2)").alias("statement_total_credit"))
    return plain(review.retry_by_account(meta, second), "stmt_id", "statement_total_debit", "statement_total_credit")


@query("udf_01_external_classifier", f"""WITH {_T} SELECT txn_id, category, CASE WHEN q THEN 'Review Required' ELSE tax_authority END AS tax_authority, CASE WHEN q THEN 'SYSTEM' ELSE decision_source END AS decision_source,
CASE WHEN q THEN 'No deterministic rule matched and AI provider is unavailable.' ELSE reason END AS reason FROM (SELECT * REPLACE (CASE WHEN review_required OR confidence_label = 'Low' THEN 'Review Required' ELSE category END AS category), review_required OR confidence_label = 'Low' AS q FROM templated)""")
def _(spark, sf_dir):
    return review.external_classifier(templated(spark, sf_dir), tax_template=True).select("txn_id", "category", "tax_authority", "decision_source", "reason")


@query("cash_flow_summary", f"""WITH {CLASSIFIED_SQL}, r AS (SELECT stmt_id, min_by(balance + debit - credit, row_seq) AS o, max_by(balance, row_seq) AS z, sum(credit - debit) AS m FROM ledger GROUP BY stmt_id)
SELECT c.stmt_id, category, CAST(sum(debit) AS DOUBLE) AS debit_total, CAST(sum(credit) AS DOUBLE) AS credit_total, CAST(sum(credit - debit) AS DOUBLE) AS net_movement, count(*) AS transaction_count,
CAST(any_value(z - (o + m)) AS DOUBLE) AS difference, CASE WHEN abs(any_value(z - (o + m))) <= 0.05 THEN 'Passed' ELSE 'Failed' END AS status FROM classified c JOIN r USING (stmt_id) GROUP BY c.stmt_id, category""")
def cash_flow(spark, sf_dir):
    """Per statement and category: totals, with the statement's reconciliation verdict."""
    rows = classified(spark, sf_dir)
    checks = summary.reconciliation(ledger(spark, sf_dir)).select("stmt_id", "difference", "status")
    return plain(summary.category_summary(rows, ["stmt_id"]).join(checks, "stmt_id"))
