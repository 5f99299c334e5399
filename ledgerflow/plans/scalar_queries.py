"""Column-cleaning queries: printed amounts, dates and narrations made from the ledger, and what the functions read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import dates, money, text
from ledgerflow.plans.chain_queries import plain
from ledgerflow.plans.fixtures import LEDGER_SQL, ledger
from ledgerflow.plans.registry import query

# --- printed cells ---------------------------------------------------------------------------------------------------


def printed(spark, sf_dir) -> DataFrame:
    """The ledger with its amount, date and narration as a statement might print them."""
    amount = ((F.col("debit") + F.col("credit")) * 37).cast("decimal(18,2)")
    f, n = F.format_number(amount, 2), F.col("event_id")
    forms = [amount.cast("string"), f, F.concat(F.lit("("), f, F.lit(")")), F.concat(F.lit("NGN "), f), F.concat(F.lit("₦"), f), F.concat(F.lit("-"), f), F.lit(""), F.lit(None).cast("string"), F.lit("not-a-number"), (n * 1000003).cast("string"), F.replace(f, F.lit("."), F.lit("")), F.concat(F.lit("REF N-"), n.cast("string")), F.concat(f, F.lit(" DR"))]
    d = lambda form: F.date_format("txn_date", form)
    days = [d("dd-MMM-yyyy"), d("d/M/yyyy"), d("yyyy-MM-dd"), d("dd-MMM-yy"), F.concat(d("dd-MMM-"), F.lit("1")), d("dd MMM"), d("yyyy"), F.lit("21:44"), F.lit(""), F.lit(None).cast("string"), F.lit("garbage"), d("d MMM yyyy")]
    tail = [F.lit(""), F.lit(" RC 55 IKOYI, LAGOS"), F.concat(F.lit(" REF NO: AB"), n.cast("string")), F.lit(" 08031234567 P.O.BOX 12 "), F.concat(F.lit("/"), (n + 10000000000).cast("string")), F.concat(F.lit(" "), d("dd/MM/yyyy")), F.lit(" Transaction Date, 3 of 9 -- Details")]
    pick = lambda xs: F.coalesce(*[F.when(n % len(xs) == i, x) for i, x in enumerate(xs)])
    hint = F.when(n % 2 == 0, F.lit("2023 18:27"))
    return ledger(spark, sf_dir).select("stmt_id", "row_seq", "event_id", "txn_date", "narration", pick(forms).alias("amount_text"), pick(days).alias("date_text"), hint.alias("hint"), F.concat("narration", pick(tail)).alias("raw"), F.date_format("txn_date", "M/d/yyyy").alias("us"))


def _case(xs: list[str]) -> str:
    return f"CASE event_id % {len(xs)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"


_f = "format('{:,.2f}', CAST(amount AS DOUBLE))"
_d = lambda form: f"strftime(txn_date, '{form}')"
PRINTED_SQL = f"""{LEDGER_SQL}, pr AS (SELECT *, CAST((debit + credit) * 37 AS DECIMAL(18,2)) AS amount FROM ledger),
printed AS (SELECT stmt_id, row_seq, event_id, txn_date, narration,
{_case(["CAST(amount AS VARCHAR)", _f, f"'(' || {_f} || ')'", f"'NGN ' || {_f}", f"'₦' || {_f}", f"'-' || {_f}", "''", "NULL", "'not-a-number'", "CAST(event_id * 1000003 AS VARCHAR)", f"replace({_f}, '.', '')", "'REF N-' || event_id", f"{_f} || ' DR'"])} AS amount_text,
{_case([_d("%d-%b-%Y"), _d("%-d/%-m/%Y"), _d("%Y-%m-%d"), _d("%d-%b-%y"), _d("%d-%b-1"), _d("%d %b"), _d("%Y"), "'21:44'", "''", "NULL", "'garbage'", _d("%-d %b %Y")])} AS date_text,
CASE WHEN event_id % 2 = 0 THEN '2023 18:27' END AS hint, narration || {_case(["''", "' RC 55 IKOYI, LAGOS'", "' REF NO: AB' || event_id", "' 08031234567 P.O.BOX 12 '", "'/' || (event_id + 10000000000)", "' ' || " + _d("%d/%m/%Y"), "' Transaction Date, 3 of 9 -- Details'"])} AS raw, {_d("%-m/%-d/%Y")} AS us FROM pr)"""

# --- amounts ---------------------------------------------------------------------------------------------------------

_s = "trim(coalesce(amount_text, ''))"
_num = lambda x: f"try_cast({x} AS DOUBLE)"
_digits = rf"regexp_replace({_s}, '[^\d.\-]', '', 'g')"
_bare = f"replace({_s}, ',', '')"
_dots = rf"regexp_replace({_s}, '[^\d.]', '', 'g')"
_all = rf"regexp_replace({_s}, '\D', '', 'g')"
_neg = f"(contains({_s}, '(') OR starts_with({_s}, '-'))"
_grouped = rf"(NOT contains({_s}, '.') AND regexp_matches({_s}, '\d{{1,3}}(?:,\d{{3}})+'))"
_tok = r"'^\d{1,3}(?:,\d{3})*\.\d{2}$'"
_led = rf"(CASE WHEN {_neg} THEN -1 ELSE 1 END) * coalesce(CASE WHEN {_grouped} THEN {_num(_dots)} / 100 WHEN NOT contains({_s}, '.') AND regexp_matches({_dots}, '^\d{{6,}}$') THEN 0 WHEN {_num(_dots)} > 1e14 THEN 0 ELSE {_num(_dots)} END, 0)"
MONEY_SQL = {
    "bank": f"CASE WHEN {_s} LIKE '(%)' THEN -abs(coalesce({_num(_digits)}, 0)) ELSE coalesce({_num(_digits)}, 0) END",
    "strict": rf"CASE WHEN regexp_matches(trim(regexp_replace({_s}, '[₦N,]', '', 'g')), '^-?\d+(\.\d{{1,2}})?$') THEN {_num(f"trim(regexp_replace({_s}, '[₦N,]', '', 'g'))")} ELSE 0 END",
    "ledger": _led,
    "tabular": f"coalesce({_num(_digits)}, 0)",
    "audit": rf"coalesce({_num(rf"nullif(regexp_extract(replace(replace(regexp_replace({_s}, '[₦N,]', '', 'g'), '(', '-'), ')', ''), '-?\d+\.?\d*'), '')")}, 0)",
    "capped": f"CASE WHEN abs({_num(_digits)}) > 1e10 THEN 0 ELSE coalesce({_num(_digits)}, 0) END",
    "nullable": rf"CASE WHEN NOT regexp_matches(regexp_replace({_s}, '[,₦N\s]', '', 'g'), '[A-Za-z]') AND length({_all}) BETWEEN 1 AND 15 THEN {_num(rf"regexp_replace({_s}, '[,₦N\s]', '', 'g')")} END",
    "eco": f"CASE WHEN regexp_matches({_s}, {_tok}) THEN {_num(_bare)} END",
    "prefix": rf"coalesce({_num(rf"nullif(regexp_extract(regexp_replace({_s}, '[₦N,\s]', '', 'g'), '^-?\d+(?:\.\d+)?'), '')")}, 0)",
    "signed": rf"CASE WHEN regexp_matches({_dots}, '\d') THEN CASE WHEN contains({_s}, '-') OR {_s} LIKE '(%)' THEN -1 ELSE 1 END * {_num(_dots)} END",
    "plain": f"coalesce({_num(_bare)}, 0)",
    "or_null": rf"CASE WHEN regexp_matches({_s}, '\d') THEN {_num(_digits)} END",
    "token": f"CASE WHEN regexp_matches({_s}, {_tok}) THEN {_num(_bare)} END",
    "fidelity": f"CASE WHEN {_grouped} THEN CASE WHEN {_neg} THEN -1 ELSE 1 END * {_num(_all)} ELSE {_led} END",
}


def _money_query(number: int, mode: str) -> None:
    @query(f"scl_m{number:02d}_money_{mode}", f"WITH {PRINTED_SQL} SELECT stmt_id, row_seq, amount_text, CASE WHEN v = 0 THEN 0.0 ELSE v END AS amount FROM (SELECT *, CAST({MONEY_SQL[mode]} AS DOUBLE) AS v FROM printed)")
    def _(spark, sf_dir):
        return printed(spark, sf_dir).select("stmt_id", "row_seq", "amount_text", (money.parse_money(F.col("amount_text"), mode) + 0.0).alias("amount"))


for _k, _m in enumerate(money.MODES, 1):
    _money_query(_k, _m)


@query("scl_m15_money_tokens", rf"""WITH {PRINTED_SQL}, x AS (SELECT stmt_id, row_seq, list_filter(list_transform(regexp_extract_all(raw || ' ' || coalesce(amount_text, '') || ' 0.00 12.50', '\d{{1,3}}(?:,\d{{3}})*\.\d{{2}}'), lambda t: CAST(replace(t, ',', '') AS DOUBLE)), lambda v: v > 0) AS found FROM printed)
SELECT stmt_id, row_seq, len(found) AS n_tokens, coalesce(list_sum(found), 0) AS total FROM x""")
def _(spark, sf_dir):
    found = printed(spark, sf_dir).select("stmt_id", "row_seq", money.money_tokens(F.concat("raw", F.lit(" "), F.coalesce("amount_text", F.lit("")), F.lit(" 0.00 12.50"))).alias("found"))
    return found.select("stmt_id", "row_seq", F.size("found").cast("long").alias("n_tokens"), F.aggregate("found", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("scl_m00_amount_quality", rf"""WITH {PRINTED_SQL}, v AS (SELECT stmt_id, amount_text, {_s} <> '' AS given, {MONEY_SQL["bank"]} AS x FROM printed),
w AS (SELECT *, given AND (x <> 0 OR regexp_matches(amount_text, '^[^1-9]*0[^1-9]*$')) AS ok FROM v)
SELECT stmt_id, count(*) FILTER (ok) AS n_read, count(*) FILTER (NOT given) AS n_empty, count(*) FILTER (given AND NOT ok) AS n_rejected, count(*) FILTER (x < 0) AS n_negative, CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) AS total FROM w GROUP BY stmt_id""")
def _(spark, sf_dir):
    return plain(money.amount_quality(printed(spark, sf_dir), "amount_text"))


# --- dates -----------------------------------------------------------------------------------------------------------

_t = "trim(coalesce(date_text, ''))"
_gen = lambda s: rf"CASE WHEN regexp_matches({s}, '^\d{{1,2}}[-/ ][A-Za-z]{{3}}[-/ ]\d{{4}}$') THEN try_strptime(regexp_replace({s}, '[/ .]', '-', 'g'), '%d-%b-%Y') WHEN regexp_matches({s}, '^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}$') THEN try_strptime(regexp_replace({s}, '[/ .]', '-', 'g'), '%d-%m-%Y') WHEN regexp_matches({s}, '^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}$') THEN try_strptime(regexp_replace({s}, '[/ .]', '-', 'g'), '%Y-%m-%d') END"
_year = "coalesce(CASE WHEN hint IS NOT NULL THEN '2023' END, '2024')"
_smart = rf"""CASE WHEN length({_t}) < 4 THEN NULL WHEN regexp_matches({_t}, '^\d{{1,2}}-[A-Za-z]{{3}}-\d{{4}}$') THEN {_t}
WHEN regexp_matches({_t}, '^\d{{1,2}}-[A-Za-z]{{3}}-\d{{2}}$') THEN left({_t}, length({_t}) - 2) || '20' || right({_t}, 2) WHEN regexp_matches({_t}, '^\d{{1,2}}-[A-Za-z]{{3}}-\d$') THEN left({_t}, length({_t}) - 1) || {_year}
WHEN regexp_matches({_t}, '^\d{{1,2}}[\s\-][A-Za-z]{{3,9}}$') THEN replace({_t}, ' ', '-') || '-' || {_year}
WHEN regexp_matches({_t}, '^20\d{{2}}$|^\d{{1,2}}:\d{{2}}(:\d{{2}})?$') THEN NULL ELSE strftime({_gen(_t)}, '%d-%b-%Y') END"""
DATES = {
    "scl_d1_smart_date": (lambda: dates.smart_date(F.col("date_text"), F.col("hint")), _smart),
    "scl_d2_tabular_date": (lambda: dates.tabular_date(F.col("date_text")), f"coalesce(strftime({_gen(_t)}, '%Y-%m-%d'), {_t})"),
    "scl_d3_month_first": (lambda: dates.month_first(F.concat(F.col("row_seq").cast("string"), F.lit(" "), "us")), "strftime(txn_date, '%d-%b-%Y')"),
    "scl_d4_split_day_month": (lambda: dates.split_day_month(F.date_format("txn_date", "dd-MM-"), F.when(F.col("hint").isNotNull(), 2023)), "CASE WHEN hint IS NOT NULL THEN strftime(txn_date, '%d-%b-2023') END"),
    "scl_d5_is_date": (lambda: dates.is_date(F.col("date_text")).cast("string"), rf"CAST(regexp_matches({_t}, '^\d{{1,2}}-[A-Za-z]{{3}}-\d{{4}}$|^\d{{1,2}}/\d{{1,2}}/\d{{4}}$|^\d{{2}}-[A-Za-z]{{3}}-\d{{2}}$|^\d{{4}}-\d{{2}}-\d{{2}}$') AS VARCHAR)"),
    "scl_d6_find_date": (lambda: dates.find_date(F.col("raw")), r"nullif(regexp_extract(raw, '\d{1,2}[-/ ](?:[A-Za-z]{3}|\d{1,2})[-/ ]\d{2,4}'), '')"),
    "scl_d7_month_bucket": (lambda: dates.month_bucket(F.when(F.col("event_id") % 9 != 0, F.col("txn_date"))), "CASE WHEN event_id % 9 <> 0 THEN strftime(txn_date, '%Y-%m') ELSE 'Unknown' END"),
    "scl_d8_front_end_date": (lambda: dates.front_end_date(F.col("date_text")), f"strftime({_gen(_t)}, '%Y-%m-%d')"),
}

# --- narrations ------------------------------------------------------------------------------------------------------

_sq = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _nested(x: str, *rules: tuple[str, str]) -> str:
    for p, to in rules:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


_up = "upper(coalesce(raw, ''))"
for _b in text.LETTERHEAD:
    _up = f"replace({_up}, '{_b}', ' ')"
NORM_SQL = _sq(_nested(_up, (r"\b0[7-9][0-1]\d{8}\b", " "), (r"\b\d{10,}\b", " "), (r"[^A-Z0-9\s/,]", " ")))
CLEAN_SQL = _sq(_nested("coalesce(raw, '')", (r"(?i)\bL\s*T\s*D\b", "LTD"), (r"(?i)\bLIMITE\b", "LIMITED"), (r"(?i)\b\d{1,2}/\d{1,2}/\d{4}\s+Details\b", " "), (r"(?i)\bTransaction\s+Date\b", " "), (r"(?i)\bValue\s+Date\b", " "), (r"(?i)\bDetails\b", " "), (r"(?i)\b\d+\s+of\s+\d+\b", " "), (r"\s+\d{1,2}/\d{1,2}/\d{4}\s*$", "")))
WORDS_SQL = _sq(_nested(f"lower({CLEAN_SQL})", (r"[^\p{L}\p{N}@&*''/-]+", " "), ("[-_/]+", " ")))
_REF = r"coalesce(nullif(regexp_extract(raw, '(?i)\bREF(?:\s*NO)?[:.\s]+([A-Z0-9/]{4,})', 1), ''), nullif(regexp_extract(raw, '/(\d{10,})\s*$', 1), ''))"
NOISE = ["DATE", "TRANSACTION", "DETAILS", "CHARGE", "OF"]
VERBS = ["TRF", "NIP", "PURCHASE", "CHARGE"]
_tokens = f"string_split({_sq('raw')}, ' ')"
_twice = _sq("coalesce(raw || ' ' || raw, '')")
_before = rf"regexp_extract({_twice}, '^(.*?)\b(?:{'|'.join(VERBS)})\b', 1)"
_list_of = f"string_split(trim({_before}), ' ')"
#: Words before the first verb once each, in order; the rest as it is.
_FIRST_WORDS_ONCE = f"CASE WHEN {_before} <> '' THEN concat_ws(' ', array_to_string(list_filter({_list_of}, lambda x, i: list_position({_list_of}, x) = i), ' '), substr({_twice}, length({_before}) + 1)) ELSE {_twice} END"
_verb = r"'\b(" + "|".join(VERBS) + r")\b'"
_head = f"regexp_extract({_sq('raw || raw')}, '^(.*?)' || {_verb}, 1)"
TEXTS = {
    "scl_t01_normalise": (lambda: text.normalise(F.col("raw")), NORM_SQL),
    "scl_t02_normalise_front": (lambda: text.normalise_front(F.col("raw")), _sq(_nested("upper(raw)", (r"[^A-Z0-9\s]", " ")))),
    "scl_t03_clean_description": (lambda: text.clean_description(F.col("raw")), CLEAN_SQL),
    "scl_t04_narration_words": (lambda: text.narration_words(F.col("raw")), WORDS_SQL),
    "scl_t05_scrub_furniture": (lambda: text.scrub_furniture(F.col("raw")), _sq(_nested("raw", *[(f"(?i){p}", " ") for p in text.FURNITURE], (r"[.:,\s]{2,}", " "), (r"[.,\s]+$", ""), (r"^[.:,\s]+", "")))),
    "scl_t07_remarks": (lambda: text.remarks(F.when(F.col("event_id") % 3 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("R"), F.col("event_id").cast("string"))), F.element_at(F.array(F.lit("IKEJA"), F.lit("MARINA"), F.lit(None).cast("string")), (F.col("event_id") % 3 + 1).cast("int")), F.col("narration")),
        "concat_ws(' ', CASE WHEN event_id % 3 <> 0 THEN 'R' || event_id END, CASE WHEN NOT contains(upper(narration), ['IKEJA', 'MARINA', NULL][event_id % 3 + 1]) THEN ['IKEJA', 'MARINA', NULL][event_id % 3 + 1] END, trim(narration))"),
    "scl_t09_reference": (lambda: text.reference(F.col("raw")), _REF),
    "scl_t10_drop_noise_tokens": (lambda: text.drop_noise_tokens(F.col("raw"), NOISE), rf"array_to_string(list_filter({_tokens}, lambda t: upper(t) NOT IN ({', '.join(f"'{n}'" for n in NOISE)}) AND NOT regexp_matches(t, '^\d{{1,2}}[-/](\d{{1,2}}|[A-Za-z]{{3}})[-/](\d{{2,4}})?$')), ' ')"),
    "scl_t11_strip_repeated_prefix": (lambda: text.strip_repeated_prefix(F.concat("raw", F.lit(" "), F.col("raw")), VERBS), _FIRST_WORDS_ONCE),
    "scl_t12_or_reference": (lambda: text.or_reference(F.when(F.col("event_id") % 3 != 0, F.col("narration")).otherwise(F.lit(" ")), F.concat(F.lit("R"), F.col("event_id").cast("string"))), "CASE WHEN event_id % 3 <> 0 THEN trim(narration) ELSE 'R' || event_id END"),
    "scl_t13_safe_join": (lambda: text.safe_join(F.col("hint"), F.lit(" "), F.col("date_text"), F.col("narration")), "array_to_string(list_filter([trim(hint), '', trim(date_text), trim(narration)], lambda p: p IS NOT NULL AND p <> ''), ' ')"),
    "scl_t14_has_keyword": (lambda: F.concat_ws(",", *[text.has_keyword(text.narration_words(F.col("raw")), k).cast("string") for k in ("ltd", "bank charge", "trf")]), f"concat_ws(',', CAST(contains(' ' || {WORDS_SQL} || ' ', ' ltd ') AS VARCHAR), CAST(contains({WORDS_SQL}, 'bank charge') AS VARCHAR), CAST(contains(' ' || {WORDS_SQL} || ' ', ' trf ') AS VARCHAR))"),
    "scl_t15_confidence": (lambda: F.concat_ws(",", text.confidence_label((F.col("event_id") % 100) / 100), text.confidence_score(F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low"), F.lit("x")), (F.col("event_id") % 4 + 1).cast("int"))).cast("string")), "concat_ws(',', CASE WHEN event_id % 100 >= 80 THEN 'High' WHEN event_id % 100 >= 55 THEN 'Medium' ELSE 'Low' END, ['0.9', '0.65', '0.5', '0.85'][event_id % 4 + 1])"),
}


def _value_query(name: str, make, sql: str | None) -> None:
    @query(name, sql and f"WITH {PRINTED_SQL} SELECT stmt_id, row_seq, {sql} AS value FROM printed")
    def _(spark, sf_dir):
        return printed(spark, sf_dir).select("stmt_id", "row_seq", make().alias("value"))


for _name, (_make, _sql) in {**DATES, **TEXTS}.items():
    _value_query(_name, _make, _sql)


def _entity_sql() -> str:
    steps, prev = [], "n0"
    x = "norm"
    for p in text.PREFIXES:
        x = f"trim(regexp_replace({x}, '^{p}', ''))"
    steps.append(f"n0 AS (SELECT stmt_id, row_seq, {x} AS e FROM (SELECT *, {NORM_SQL} AS norm FROM printed))")
    names = ", ".join(f"'{n}'" for n in text.NO_NAMES)
    for k, d in enumerate(text.DELIMITERS, 1):
        fit = rf"list_filter(list_transform(list_reverse(string_split(e, '{d}')), lambda p: trim(p)), lambda p: length(p) > 3 AND NOT regexp_matches(p, '^\d+$') AND NOT starts_with(p, 'PP_') AND NOT starts_with(p, 'GAPS') AND NOT starts_with(p, 'REV_') AND upper(p) NOT IN ({names}))"
        steps.append(f"n{k} AS (SELECT stmt_id, row_seq, CASE WHEN contains(e, '{d}') THEN coalesce({fit}[1], e) ELSE e END AS e FROM {prev})")
        prev = f"n{k}"
    return rf"WITH {PRINTED_SQL}, {', '.join(steps)} SELECT stmt_id, row_seq, trim(regexp_replace(e, '\b\d{{5,}}\b', '', 'g')) AS value FROM {prev}"


@query("scl_t06_entity", _entity_sql())
def _(spark, sf_dir):
    norm = printed(spark, sf_dir).select("stmt_id", "row_seq", text.normalise(F.col("raw")).alias("norm"))
    return norm.select("stmt_id", "row_seq", text.entity(F.col("norm")).alias("value"))


@query("scl_t08_repair_reference", f"""WITH {PRINTED_SQL}, x AS (SELECT stmt_id, row_seq, raw, {_REF} AS r FROM printed)
SELECT stmt_id, row_seq, r AS reference, {_sq("CASE WHEN r IS NOT NULL THEN replace(raw, r, ' ') ELSE raw END")} AS description FROM x""")
def _(spark, sf_dir):
    rows = printed(spark, sf_dir).select("stmt_id", "row_seq", F.col("raw").alias("description"), F.lit("").alias("reference"))
    return text.repair_reference(rows).select("stmt_id", "row_seq", "reference", "description")


@query("scl_t03_fold_compatibility")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("ﬁ "), "text").alias("text"))
    return text.fold_compatibility(docs, "text").select("doc_id", text.clean_description(F.col("text")).alias("value"))


# Reference, branch and text as printed, and as a reader sorts them out.
FIELDS = [
    ("", "", "205 LAGOS MAIN branch rent", "", "205 LAGOS MAIN", "branch rent"), ("'GAP", "", "REF123456 PAID", "REF123456", "", "PAID"), ("205 IKEJA", "", "RENT", "", "205 IKEJA", "RENT"), ("AB12 more words", "x", "RENT", "AB12", "x", "more words RENT"),
    ("GAP", "101 ABA", "205 LAGOS RENT x", "", "101 ABA", "205 LAGOS RENT x"), ("R1", "", "'1234567 RENT", "R1", "", "'1234567 RENT"), ("'", "", "'1234567  RENT", "'1234567", "", "RENT"), ("205 IKEJA", "101 ABA", "123456", "205", "101 ABA", "IKEJA 123456"),
    ("", "", "205 LAGOS 77889900 RENT", "77889900", "205 LAGOS", "RENT"), ("205 IKEJA", "", "88990011 RENT", "88990011", "205 IKEJA", "RENT"), ("", "", "", "", "", ""), (" GAP ", " x ", "short 1", "", "x", "short 1"),
]


@query("scl_t08_repair_fields", f"WITH {LEDGER_SQL} SELECT stmt_id, row_seq, " + ", ".join("[" + ", ".join("'" + f[k].replace("'", "''") + "'" for f in FIELDS) + f"][event_id % {len(FIELDS)} + 1] AS {c}" for k, c in ((3, "reference"), (4, "branch"), (5, "description"))) + " FROM ledger")
def _(spark, sf_dir):
    sample = F.element_at(F.array(*[F.struct(F.lit(f[0]).alias("reference"), F.lit(f[1]).alias("branch"), F.lit(f[2]).alias("description")) for f in FIELDS]), (F.col("event_id") % len(FIELDS) + 1).cast("int"))
    rows = ledger(spark, sf_dir).select("stmt_id", "row_seq", sample.alias("s")).select("stmt_id", "row_seq", "s.*")
    return text.repair_fields(rows)
