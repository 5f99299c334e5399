"""CLS-09..16, UDF-02: category templates. A template is data; applying one is a single column expression over cleaned text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.text import bind, clean_description, has_any, has_keyword, narration_words
from ledgerflow.operators.rules import Verdicts, in_parts

REVIEW = "Review Required"


@dataclass(frozen=True)
class Category:
    name: str
    applies_to: str
    priority: int
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    label: str | None = None

    @property
    def output(self) -> str:
        return self.label or self.name


@dataclass(frozen=True)
class Template:
    template_id: str
    name: str
    scope: str
    categories: list[Category]
    instructions: str = ""
    uncertain_to_review: bool = True
    salary: str = "review"
    trade_name: str = "review"


#: Bank items that are no income or expense of their own.
BANK_NOISE = [
    "stamp duty", "sms alert", "account maintenance", "acct maint", "vat on bank charge", "value added tax on charge", "card charge", "transfer charge",
    "commission", "nip charge", "pos stamp duty", "reversal", "reversed", "failed", "opening balance", "closing balance", "internal transfer",
    "own account transfer", "bank charge", "charges", "vat on bank", "sms", "pos charge", "own account", "loan disbursement",
]
#: Words of companies and tax authorities.
ENTITY = [
    "ltd", "limited", "plc", "enterprise", "enterprises", "ventures", "company", "incorporated", "nigeria limited", "firs", "federal inland revenue",
    "wht", "cit", "tax payment",
]
#: Bank items that no tax applies to.
NOT_APPLICABLE = [
    "stamp duty", "sms alert", "account maintenance", "acct maint", "vat on bank charge", "value added tax on charge", "card charge", "transfer charge",
    "commission", "nip charge", "counter cheque issue charge", "counter chq issue charge", "cheque issue charge", "chq issue charge", "vat counter chq",
    "vat counter cheque", "vat on cheque", "cheque book charge", "cheque charge", "pos stamp duty", "reversal", "reversed", "failed", "opening balance",
    "closing balance", "internal transfer", "own account transfer", "balance brought forward",
]
#: Words of salaries, and amounts and words of usual transfer fees.
SALARY = ["salary", "payroll", "staff salary", "wages"]
CHARGE_AMOUNTS = [1.25, 2.5, 3.75, 6.83, 10, 10.75, 25, 26.88, 50, 53.75, 90.96, 100, 107.5]
CHARGE_WORDS = ["cob trf to", "nip transfer", "nip", "transfer fee", "transfer charge", "cob trf", "trf", "interbank transfer", "bank transfer", "others"]
#: What surrounds trade names, titles of persons, hints at a trade, words that are no person's name.
TRADE_CONTEXT = ["cob trf", "trf to", "transfer to", "nip transfer", "pos purchase"]
TITLES = ["mr", "mrs", "miss", "dr"]
TRADE_HINTS = [
    "oil", "print", "cakes", "eng", "engineering", "office", "music", "mus", "gold", "stores", "superstores", "food", "foods", "market", "ventures",
    "logistics", "cleaning", "medical", "digital", "internet", "subscription", "school", "academy", "studio", "fashion", "pharmacy", "mart", "shop",
    "enterprise", "attainable", "ryteprint", "goldmender", "damac", "palmacedar",
]
NOT_PERSONS = ["vendor", "vendors", "supplier", "subscription", "internet", "merchant", "services", "cleaning", "medical", "digital", "logistics", "tutoring"]
FILLERS = "cob|trf|transfer|to|from|nip|neft|payment|paid|for|on|behalf|beh"


def built_in_templates() -> dict[str, Template]:
    """CLS-15: the built-in sets (fixed values)."""
    sets = [
        Template("firs-sirs-na", "FIRS / SIRS / Not Applicable", "debit", [Category("FIRS", "debit", 90, ENTITY, BANK_NOISE), Category("Not Applicable", "debit", 100, BANK_NOISE), Category("SIRS", "debit", 40, ["mr", "mrs", "miss", "dr", "refund to individual"], ["ltd", "limited", "plc", "enterprise", "ventures", "company"])]),
        Template("credit-income", "Credit-only income analysis", "credit", [
            Category("Customer Payment", "credit", 80, ["payment", "customer", "client", "invoice", "pos", "web payment"], ["loan", "refund"]), Category("Sales Income", "credit", 75, ["sales", "revenue", "receipt"]), Category("Owner Funding", "credit", 70, ["capital", "owner", "director", "funding"]),
            Category("Loan Inflow", "credit", 85, ["loan", "facility", "disbursement"]), Category("Pension Income", "credit", 88, ["pension", "pencom", "ptad", "pfa", "retirement benefit", "retirement savings", "annuity"]), Category("Internal Transfer", "credit", 65, ["internal", "own account", "transfer between", "sweep"]),
            Category("Refund/Reversal", "credit", 90, ["refund", "reversal", "reversed"]), Category("Interest Income", "credit", 80, ["interest"], ["withholding", "wht"]), Category("Unexplained Credit", "credit", 0)]),
        Template("debit-expense", "Debit-only expense analysis", "debit", [
            Category("Supplier Payment", "debit", 60, ["supplier", "invoice", "payment to", "purchase"], BANK_NOISE), Category("Staff/Salary Payment", "debit", 90, ["salary", "payroll", "staff", "allowance", "wages"]), Category("Rent", "debit", 85, ["rent", "lease"]), Category("Transport", "debit", 80, ["transport", "logistics", "uber", "bolt", "fuel"]),
            Category("Repairs & Maintenance", "debit", 75, ["repair", "maintenance", "service"]), Category("Office Expense", "debit", 70, ["office", "stationery", "internet", "subscription"]), Category("Travel", "debit", 82, ["travel", "flight", "hotel", "visa"]), Category("Bank Charges", "debit", 100, BANK_NOISE),
            Category("Tax/Statutory Payment", "debit", 95, ["tax", "firs", "sirs", "vat", "wht", "paye", "pension"]), Category("Loan Repayment", "debit", 86, ["loan repayment", "repayment", "facility"]), Category("Internal Transfer", "debit", 92, ["internal", "own account", "transfer between"]), Category("Cash Withdrawal", "debit", 85, ["cash withdrawal", "atm", "withdrawal"])]),
        Template("business-category", "Business income and expense categorization", "both", [
            Category("Operating Income", "credit", 60, ["operating", "income"]),
            Category("Pension Income", "credit", 59, ["pension", "income"]),
            Category("Customer Payment", "credit", 58, ["customer", "payment"]),
            Category("Supplier Payment", "both", 57, ["supplier", "payment"]),
            Category("Staff Cost", "both", 56, ["staff", "cost"]),
            Category("Rent", "both", 55, ["rent"]),
            Category("Transport", "both", 54, ["transport"]),
            Category("Repairs and Maintenance", "both", 53, ["repairs", "and", "maintenance"]),
            Category("Office/Admin Expense", "both", 52, ["office", "admin", "expense"]),
            Category("Bank Charges & Levies", "both", 51, BANK_NOISE),
            Category("Taxes and Statutory Payments", "both", 50, ["taxes", "and", "statutory", "payments"]),
            Category("Internal Transfer", "both", 49, ["internal", "transfer"]),
            Category("Loan", "both", 48, ["loan"]),
            Category("Refund", "both", 47, ["refund"]),
            Category("Reversal", "both", 46, ["reversal"]),
            Category("Cash Withdrawal", "both", 45, ["cash", "withdrawal"]),
        ]),
        Template("travel-tour", "Travel/tour business classification", "both", [
            Category("Customer Trip Payment", "credit", 75, ["trip", "tour", "package", "customer"]), Category("Flight/Airline Payment", "debit", 90, ["flight", "airline", "ticket", "iata"]), Category("Hotel/Accommodation", "debit", 85, ["hotel", "accommodation", "lodging"]), Category("Visa Processing", "debit", 88, ["visa", "embassy", "vfs"]),
            Category("Insurance", "debit", 80, ["insurance"]), Category("Customer Refund", "debit", 90, ["refund"]), Category("Bank Charges & Taxes", "both", 100, [*BANK_NOISE, "tax", "vat", "wht"])]),
        Template("tax-audit", "Tax audit analysis", "both", [
            Category("Taxable Business Income", "credit", 80, ["payment", "sales", "invoice", "customer"], ["loan", "refund"]), Category("Non-taxable Inflow", "credit", 70, ["capital", "owner", "refund"]), Category("Related Party Transfer", "both", 75, ["director", "shareholder", "related"]),
            Category("Statutory Payment", "debit", 95, ["tax", "firs", "sirs", "vat", "wht", "paye", "pension"]), Category("Individual Payment", "debit", 40, ["mr", "mrs", "miss", "dr"], ["ltd", "limited"]), Category("Bank Charges", "debit", 100, BANK_NOISE)]),
        Template("custom", "Custom analysis", "both", []),
    ]
    return {t.template_id: t for t in sets}


def in_scope(scope: str) -> Column:
    """FLT-03: rows a scope covers, by amounts above zero."""
    return {"debit": F.col("debit") > 0, "credit": F.col("credit") > 0}.get(scope, F.lit(True))


def has_entity(w: Column) -> Column:
    """CLS-14."""
    return has_any(w, ENTITY)


def is_pos(w: Column) -> Column:
    """CLS-14."""
    return has_keyword(w, "pos purchase") | has_keyword(w, "pos purch") | w.startswith("pos ")


def common_charge(w: Column) -> Column:
    """CLS-11: a usual transfer fee: amount, words, debit only."""
    amounts = F.lit(False)
    for a in CHARGE_AMOUNTS:
        amounts = amounts | (F.abs(F.col("debit").cast("double") - a) <= 0.01 + 1e-9)
    return (F.col("debit") > 0) & (F.col("credit") <= 0) & amounts & has_any(w, CHARGE_WORDS)


def _name_tokens(w: Column, extra: str = "") -> Column:
    bare = F.regexp_replace(F.regexp_replace(w, rf"\b({FILLERS}{extra})\b", " "), "[@*&0-9]+", " ")
    return F.filter(F.split(bare, r"\s+"), lambda t: t.rlike("^[a-z]{3,}$"))


def is_person(w: Column) -> Column:
    """CLS-12: a personal name."""
    tokens = _name_tokens(w)
    named = (F.size(tokens) >= 2) & F.exists(F.slice(tokens, 1, 4), lambda t: F.length(t) > 3)
    barred = has_entity(w) | is_pos(w) | has_any(w, NOT_APPLICABLE) | has_any(w, NOT_PERSONS)
    return ~barred & (has_any(w, TITLES) | (~has_any(w, ["cob trf", "trf to", "nip transfer"]) & named))


def is_trade_name(w: Column) -> Column:
    """CLS-13: an unregistered business."""
    few = F.size(_name_tokens(w, "|pos|purchase")).between(1, 3)
    return ~has_entity(w) & ~has_any(w, NOT_APPLICABLE) & has_any(w, TRADE_CONTEXT) & ~has_any(w, [*TITLES, "salary", "payroll"]) & (has_any(w, TRADE_HINTS) | few)


class Results(Verdicts):
    FIELDS = (("category", "string"), ("tax_authority", "string"), ("confidence_label", "string"), ("reason", "string"), ("decision_source", "string"), ("review_required", "boolean"))


def tax_tree(w: Column, t: Template, say: Results) -> Column:
    """CLS-10: entity, individual or not applicable."""
    own = lambda category, confidence, reason: say(category, category, confidence, reason, "RULE", False)
    review = lambda reason, confidence="Low": say(REVIEW, REVIEW, confidence, reason, "SYSTEM", t.uncertain_to_review)
    salary = {"sirs": own("SIRS", "Medium", "Salary/payroll setting treats staff payments as SIRS."), "not_applicable": own("Not Applicable", "Medium", "Salary/payroll setting treats staff payments as Not Applicable.")}.get(t.salary, review("Salary/payroll payment requires review."))
    trade = {"firs": own("FIRS", "Medium", "Unregistered business/trade-name setting treats this row as FIRS."), "sirs": own("SIRS", "Medium", "Unregistered business/trade-name setting treats this row as SIRS.")}.get(t.trade_name, review("Possible unregistered business/trade name requires review."))
    sirs = next((c for c in t.categories if c.output == "SIRS"), Category("SIRS", "debit", 0))
    fee = common_charge(w)
    return (
        F.when(fee, own("Not Applicable", "High", "Matched common bank transfer/NIP charge pattern."))
        .when(has_any(w, NOT_APPLICABLE), own("Not Applicable", "High", "Matched non-taxable bank item before entity classification."))
        .when(is_pos(w) & has_entity(w), own("FIRS", "High", "POS narration contains a strong company/entity indicator."))
        .when(is_pos(w), review("POS merchant name has no strong company/entity indicator."))
        .when(has_entity(w), own("FIRS", "High", "Matched strong company/entity or tax authority indicator."))
        .when(has_keyword(w, "limi"), review("Possible broken LIMITED suffix needs review.", "Medium"))
        .when(has_any(w, SALARY), salary)
        .when(has_any(w, sirs.include) & ~has_any(w, sirs.exclude), own("SIRS", "Medium", "Matched individual-payment rule keyword."))
        .when(is_trade_name(w), trade)
        .when(is_person(w), own("SIRS", "Medium", "Narration resembles a personal-name payment."))
        .otherwise(review("No deterministic rule matched."))
    )


def keyword_rules(w: Column, t: Template, say: Results) -> Column:
    """CLS-09: categories by priority, highest first, ties in order; an empty include list never matches."""
    out = None
    for c in sorted(t.categories, key=lambda c: -c.priority):
        if c.include:
            hit = in_scope(c.applies_to) & has_any(w, c.include)
            hit = hit & ~has_any(w, c.exclude) if c.exclude else hit
            said = say(c.output, None, "High", f'Matched rule "{c.name}" by keyword.', "RULE", False)
            out = F.when(hit, said) if out is None else out.when(hit, said)
    rest = say(REVIEW, None, "Low", "No deterministic rule matched.", "SYSTEM", t.uncertain_to_review)
    return rest if out is None else out.otherwise(rest)


def normalise_rows(df: DataFrame, source_file: str = "") -> DataFrame:
    """CLS-16: defaults, ids and cleaned text for classification. Expects stmt_id, row_seq, narration and amounts."""
    return df.withColumns({
        "txn_id": F.concat(F.lit("txn-"), F.col("stmt_id").cast("string"), F.lit("-"), F.col("row_seq").cast("string")), "source_file": F.lit(source_file), "raw_text": F.coalesce("narration", F.lit("")), "description": clean_description(F.col("narration")),
        "reference": F.lit(""), "sub_category": F.lit(None).cast("string"), "tax_authority": F.lit(None).cast("string"), "category": F.lit(REVIEW), "confidence_label": F.lit("Low"), "reason": F.lit("Extracted from statement."), "decision_source": F.lit("SYSTEM"), "review_required": F.lit(False),
    })


def classify(df: DataFrame, template: Template) -> DataFrame:
    """UDF-02, CLS-09, CLS-10: rows of ``normalise_rows`` classified by a template; a row's text is cleaned once."""
    say = Results()
    outside = say("Out of Scope", None, "High", f"Template analyzes {template.scope} transactions only.", "SYSTEM", False)
    inside = tax_tree if template.template_id == "firs-sirs-na" else keyword_rules
    words = narration_words(F.concat_ws(" ", "description", "reference", "raw_text"))
    number = F.when(~in_scope(template.scope), outside).otherwise(bind(words, lambda w: inside(w, template, say)))
    return df.withColumn("_v", number).withColumns(say.columns(F.col("_v"))).drop("_v")


def template_rows(spark: SparkSession, template: Template) -> DataFrame:
    """A template as a table, one row per category in order."""
    rows = [(i, template.template_id, template.name, template.scope, template.instructions, c.name, c.output, c.applies_to, c.priority, c.include, c.exclude) for i, c in enumerate(template.categories)]
    return spark.createDataFrame(rows, "ord int, template_id string, template_name string, scope string, instructions string, category string, label string, applies_to string, priority int, include array<string>, exclude array<string>")


def classify_by_table(df: DataFrame, rules: DataFrame, row_key: list[str] | None = None, at_once: int = 100) -> DataFrame:
    """CLS-09 with categories kept in a table of any length: compiled like built-in ones, best priority first, ``at_once`` in one expression;
    a row that has its category looks no further. Rows are neither joined nor moved."""
    w = F.col("_words")
    out = df.withColumn("_words", narration_words(F.concat_ws(" ", "description", "reference", "raw_text"))).withColumn("category", F.lit(None).cast("string"))
    ordered = rules.select("ord", "label", "applies_to", "priority", "include", "exclude").orderBy(F.col("priority").desc_nulls_last(), "ord")
    has = lambda ks: F.exists(F.array(*map(F.lit, ks)), lambda k: F.when(k.contains(" "), w.contains(k)).otherwise(F.concat(F.lit(" "), w, F.lit(" ")).contains(F.concat(F.lit(" "), k, F.lit(" ")))))
    side = {"both": F.lit(True), "debit": F.col("debit") > 0, "credit": F.col("credit") > 0}
    for part in in_parts(ordered.toLocalIterator(), at_once):
        found = None
        for r in part:
            if r.applies_to in side and r.include:
                hit = side[r.applies_to] & has(r.include)
                hit = hit & ~has(r.exclude) if r.exclude else hit
                found = F.when(hit, r.label) if found is None else found.when(hit, r.label)
        if found is not None:
            out = out.withColumn("category", F.coalesce("category", found))
    return out.withColumn("category", F.coalesce("category", F.lit(REVIEW))).drop("_words")
