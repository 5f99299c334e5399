"""CLS-01..08: prioritised regex rules compiled into one column expression.

Rules are data. ``compile_rules`` orders them by priority (declaration order breaks ties) and builds first-match CASE branches:
cheap side tests come before the regular expressions, literal patterns compile once per task, and no join or Python is
involved however many rows there are. Rules kept in a table go through ``match_rule_table`` instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import text


@dataclass(frozen=True)
class Rule:
    rule_id: str
    priority: int
    side: str
    category: str
    confidence: float
    pattern: str
    exclude: str | None = None


#: Fixed value: the category of transfers between own accounts.
OWN_TRANSFER = "Inter-Account / Treasury Transfer"

#: The built-in rules in declaration order.
STATIC = [
    Rule("R001_OPENING_BALANCE", 1, "both", "Opening Balance", 1.0, r"OPENING\s+BAL|BAL\s*B\/F|BALANCE\s*BROUGHT|B\/F\b|BROUGHT\s*FORWARD"),
    Rule("R004A_TRANSFER_VIA", 4, "credit", "Operating Income", 0.95, r"\bTRANSFER\s*BETWEEN\s*CUSTOMERS\b.*\bVIA\b"),
    Rule("R004B_GTWORLD", 4, "credit", "Operating Income", 0.92, r"\bGTW(?:ORLD)?\b|\bGTWORLD\b"),
    Rule("R004C_NIP_TRF_FROM", 4, "credit", "Operating Income", 0.93, r"\bNIP\b.*\bTRF(?:FOR|FRM|FROM)?\b|\bTRF\s*FRM\b|\bTRF\s*FROM\b|\bTRFFOR\b"),
    Rule("R004D_GAPS", 4, "credit", "Operating Income", 0.92, r"\bGAPSLITE\b|\bGAPS?\b"),
    Rule("R003_PENSION_INCOME", 3, "credit", "Pension Income", 1.0, r"\bPENSION\b|\bPENCOM\b|\bPTAD\b|\bPFA\b|RETIREMENT\s+BENEFIT|RETIREMENT\s+SAVINGS|ANNUITY"),
    Rule("R005_INWARD_TRANSFERS", 5, "credit", "Operating Income", 0.9, r"NIP\s*FROM|TRF\s*FROM|CREDIT\s*FROM|DEPOSIT\b|INFLOW\b"),
    Rule("R009A_TRANSFER_BETWEEN", 9, "debit", OWN_TRANSFER, 0.90, r"\bTRANSFER BETWEEN CUSTOMERS\b|\bNIBSS\b"),
    Rule("R009B_NIP_TRF_TO", 9, "debit", OWN_TRANSFER, 0.88, r"\bNIP\b.*\bTO\b|\bTRF\s*TO\b|\bTRFTO\b|\bNIP\s*TO\b"),
    Rule("R009C_GTWORLD_GAPS", 9, "debit", OWN_TRANSFER, 0.85, r"\bGTW(?:ORLD)?\b|\bGTWORLD\b|\bGAPSLITE\b|\bGAPS?\b|\bGAP\b"),
    Rule("R010_BANK_STAMP_DUTY", 10, "debit", "Bank Charges", 1.0, r"\bSTAMP\s*DUTY\b"),
    Rule("R011_BANK_CHARGES_CORE", 11, "debit", "Bank Charges", 1.0, r"\bSMS\s*CHARGE\b|\bCOMMISSION\b|\bMAINTENANCE\b|\bACCOUNT\s*MAINTENANCE\b", r"\bTRANSFER BETWEEN CUSTOMERS\b|\bNIP\b|\bGTW(?:ORLD)?\b|\bGTWORLD\b|\bGAPSLITE\b|\bGAPS?\b|\bNIBSS\b|\bTRF\b"),
    Rule("R012_GOVT_LEVIES_TAXES", 12, "debit", "Bank Charges", 1.0, r"\bVAT\b|\bVATCHARGES\b|\bTAX\b|\bLEVY\b", r"\bTRANSFER BETWEEN CUSTOMERS\b|\bNIP\b|\bGTW(?:ORLD)?\b|\bGTWORLD\b|\bGAPSLITE\b|\bGAPS?\b|\bNIBSS\b|\bTRF\b"),
    Rule("R020_WHT_ON_INTEREST_DEBIT", 20, "debit", "WHT Receivable", 1.0, r"CREDIT\s*INTEREST|INTEREST\b", r"OVERDRAFT\s*INTEREST|LOAN\s*INTEREST|INTEREST\s*CHARGE"),
    Rule("R021_INTEREST_INCOME_CREDIT", 21, "credit", "Interest Income", 1.0, r"CREDIT\s*INTEREST|INTEREST\b", r"OVERDRAFT\s*INTEREST|LOAN\s*INTEREST|INTEREST\s*CHARGE"),
    Rule("R022_INTEREST_REVERSAL_DEBIT", 22, "debit", "Interest Reversal / Adjustment", 1.0, r"CURRENT\s*ACT\s*CREDIT\s*INTEREST"),
    Rule("R023_INTEREST_INCOME_SPECIFIC", 23, "credit", "Interest Income", 1.0, r"CURRENT\s*ACT\s*CREDIT\s*INTEREST"),
    Rule("R006A_SALARY_PAYROLL", 6, "debit", "Salaries & Wages", 1.0, r"SALARY\b|PAYROLL\b|WAGES\b|STAFF\s*SAL"),
    Rule("R006B_STAFF_ADVANCE", 6, "debit", "Staff Debtors / Salary Advances", 1.0, r"STAFF\s*LOAN|SALARY\s*ADVANCE|ADVANCE\s*TO\s*STAFF"),
    Rule("R006C_STAFF_WELFARE", 6, "debit", "Staff Welfare", 0.9, r"WELFARE|LUNCH|CATERING|TEAM\s*BONDING|GROCERIES"),
    Rule("R006D_STAFF_TRAINING", 6, "debit", "Staff Training & Development", 0.9, r"TRAINING|WORKSHOP|SEMINAR|COURSE\b|UDEMY|COURSERA"),
    Rule("R007A_EVENT_CONFERENCE", 7, "debit", "Event & Conference Expenses", 1.0, r"SUMMIT|CONFERENCE|HEALTHTECH|KIGALI|NAMETAG|NAME\s*TAGS"),
    Rule("R007B_TRANSPORT_VEHICLE", 7, "debit", "Transport & Logistics", 1.0, r"VEHICLE|TINT|VEHICLE\s*REG|CAR\s*REG|LICENSE|VEHICLE\s*PAPERS|FUEL\b|DIESEL\b|TRANSPORT\b"),
    Rule("R007C_REPAIRS_MAINTENANCE", 7, "debit", "Repairs & Maintenance", 0.9, r"REPAIR|MAINTENANCE\s*(?!FEE|CHG|CHARGE|ACCT|ACCOUNT)|SERVICING|PLUMBING|ELECTRICAL|CARPENTRY"),
    Rule("R008_SECURITY_EXPENSES", 8, "debit", "Security & Safety", 0.95, r"SECURITY\s*EXPENSE|SECURITY\b|POLICE|VIGILANTE|GUARD|ESCORT|SAFETY"),
    Rule("R007D_FOREIGN_EXAM_FEES", 7, "both", "Foreign Exam Fees", 1.0, r"\bSAT\b|TOEFL\b|IELTS\b|GRE\b|GMAT\b"),
    Rule("R007E_EXAM_GENERIC_PASSTHROUGH", 7, "both", "Student Exam Fees (Pass-Through)", 0.95, r"\bEXAM\b|EXAM\s*FEE|REGISTRATION\s*(?:EXAM|FORM|FEE)|ADMISSION|APPLICATION\s*FORM|COMMON\s*ENTRANCE"),
    Rule("R007F_CAPITAL_PROJECT_VALUATION", 7, "debit", "Capital Expenditure (CWIP)", 1.0, r"VALUATION\s*INVOICE|VARIATION\s*INVOICE"),
    Rule("R080_OFFICE_RENT_CORPORATE_SERVICES", 80, "debit", "Office Rent / Lease", 0.92, r"CORPORATE\s*SERVICES|SERVICED\s*OFFICE|ADEOLA\s*ODEKU"),
    Rule("R007H_ADMINISTRATIVE_EXPENSES", 7, "debit", "Administrative Expenses", 0.95, r"MISCELLANEOUS|MISC\b|OFFICE\s*EXP|STATIONERY|PRINTING|COURIER|NEWSPAPER|SUBSCRIPTION|REGISTRATION\b|INTERNET|DATA\s*BUNDLE|AIRTIME"),
    Rule("R090_GENERIC_OUTWARD_TRANSFER", 90, "debit", OWN_TRANSFER, 0.6, r"NIP\s*TO|TRF\s*TO|TRF\s*IFO|LOCAL\s*TRANSFERS"),
]
#: Vendor keywords by category; each is a debit rule of priority 15.
VENDORS = {
    "Utilities & Bills": ["IKEDC", "EKEDC", "PHCN", "KEDCO", "AEDC", "JEDC", "DSTV", "GOTV", "STARTIMES", "SMILE", "SPECTRANET", "OLUSESI WA"],
    "Fuel & Energy": ["TOTALENERGIES", r"TOTAL\s+SERVICE", "NNPC", "OANDO", "BOVAS", r"NORTH\s+WEST", "ETERNAL", "ARDova", "MOBIL", "EVELAND", "DAMAC OIL"],
    "Telecommunications": ["MTN", "AIRTEL", r"GLO\b", "9MOBILE", "ETISALAT"],
    "Staff Welfare & Catering": [r"CHICKEN\s+REPUBLIC", r"THE\s+PLACE", "KFC", "DOMINO", "COLDSTONE", r"MEGA\s+CHICKEN", r"SWEET\s+SENSATION", r"MAMA\s+CASS", r"FOOD\s+COURT", "SHERBET FARMS", "GLOBAL LOKO"],
    "Transport & Logistics": ["UBER", "BOLT", "GIGL", r"GIG\s+LOGISTICS", "DHL", "FEDEX", "UPS", r"RED\s+STAR", "KAVUANI"],
    "Professional Fees": ["LAWYER", "AUDITOR", "CONSULTANT", "RETAINER", "LEGAL", r"COVENANT\s+PARTNER"],
    "Administrative Expenses": ["JUMIA", "KONGA", "AMAZON", "STATIONERY", r"OFFICE\s+DEPOT", r"PAPER\s+PLUS", "SWIFT NETW"],
    "Event & Conference Expenses": ["CJ MULTI TRADE", "HEALTHTECH", "KIGALI", "SUMMIT"],
    "Technical & Operations": ["PROMOTEC", "SUNBETH GLOBAL"],
    "General Vendor": ["GREAT OMA"],
}
#: The front-end rules in declaration order.
FRONT_END = [
    Rule("R001_OPENING_BALANCE", 1, "both", "Opening Balance", 1.0, r"OPENING\s+BAL|BAL\s*B\/F|BALANCE\s*BROUGHT|B\/F\b|BROUGHT\s*FORWARD"),
    Rule("R004_INWARD_TRANSFERS_OVERRIDE", 4, "credit", "Operating Income", 0.95, r"\bTRANSFER\s*BETWEEN\s*CUSTOMERS\b.*\bVIA\b|\bGTW(?:ORLD)?\b|\bGAPSLITE\b|\bGAPS?\b"),
    Rule("R003_PENSION_INCOME", 3, "credit", "Pension Income", 1.0, r"\bPENSION\b|\bPENCOM\b|\bPTAD\b|\bPFA\b|RETIREMENT\s+BENEFIT|RETIREMENT\s+SAVINGS|ANNUITY"),
    Rule("R005_INWARD_TRANSFERS", 5, "credit", "Operating Income", 0.9, r"NIP\s*FROM|TRF\s*FROM|CREDIT\s*FROM|DEPOSIT\b|INFLOW\b"),
    Rule("R006_SALARY_PAYROLL", 6, "debit", "Salaries & Wages", 1.0, r"SALARY\b|PAYROLL\b|WAGES\b|STAFF\s*SAL"),
    Rule("R007_EXPENSE_OVERRIDE", 7, "debit", "Event & Conference Expenses", 1.0, r"SUMMIT|CONFERENCE|HEALTHTECH|KIGALI|NAMETAG|VALUATION\s*INVOICE|VARIATION\s*INVOICE|CORPORATE\s*SERVICES"),
    Rule("R008_SECURITY_EXPENSES", 8, "debit", "Security & Safety", 0.95, r"SECURITY\s*EXPENSE|SECURITY\b|POLICE|VIGILANTE|GUARD|ESCORT|SAFETY"),
    Rule("R009_OUTWARD_TRANSFERS_OVERRIDE", 9, "debit", OWN_TRANSFER, 0.90, r"\bTRANSFER BETWEEN CUSTOMERS\b|\bNIBSS\b|\bTRF\s*TO\b|\bNIP\s*TO\b"),
    Rule("R010_BANK_STAMP_DUTY", 10, "debit", "Bank Charges", 1.0, r"STAMP\s*DUTY|FGN\s*STAMPDUTY"),
    Rule("R011_BANK_CHARGES_CORE", 11, "debit", "Bank Charges", 1.0, r"SMS\s*CHARGE|SMS\b|COMMISSION|COMM\b|TRANSFER\s*CHARGE|BANK\s*CHARGE|MAINTENANCE\s*(?:FEE|CHG|CHARGE)|ACCT\s*MAINT|ACCOUNT\s*MAINT|AMF\b|NIP\s*CHG|NIP\s*FEE|TRF\s*CHG|TRF\s*FEE|UBR\s*CHG"),
    Rule("R012_GOVT_LEVIES_TAXES", 12, "debit", "Bank Charges", 1.0, r"ELECTRONIC\s*MONEY\s*TRANSFER\s*LEVY|EMTL|VAT\b|TAX\b|FGN\s*LEVY|VAT\s*ON\s*CHG|VAT\s*ON\s*TRF|VAT\s*ON\s*NIP"),
    Rule("R020_WHT_ON_INTEREST_DEBIT", 20, "debit", "WHT Receivable", 1.0, r"CREDIT\s*INTEREST|INTEREST\b", r"OVERDRAFT\s*INTEREST|LOAN\s*INTEREST|INTEREST\s*CHARGE"),
    Rule("R021_INTEREST_INCOME_CREDIT", 21, "credit", "Interest Income", 1.0, r"CREDIT\s*INTEREST|INTEREST\b", r"OVERDRAFT\s*INTEREST|LOAN\s*INTEREST|INTEREST\s*CHARGE"),
    Rule("R022_INTEREST_REVERSAL", 22, "debit", "Interest Reversal / Adjustment", 1.0, r"CURRENT\s*ACT\s*CREDIT\s*INTEREST"),
    Rule("R031_STAFF_ADVANCE", 31, "debit", "Staff Debtors / Salary Advances", 1.0, r"STAFF\s*LOAN|SALARY\s*ADVANCE|ADVANCE\s*TO\s*STAFF"),
    Rule("R032_STAFF_WELFARE", 32, "debit", "Staff Welfare", 0.9, r"WELFARE|LUNCH|CATERING|TEAM\s*BONDING|GROCERIES"),
    Rule("R033_STAFF_TRAINING", 33, "debit", "Staff Training & Development", 0.9, r"TRAINING|WORKSHOP|SEMINAR|COURSE\b|UDEMY|COURSERA"),
    Rule("R041_TRANSPORT_VEHICLE", 41, "debit", "Transport & Logistics", 1.0, r"VEHICLE|TINT|VEHICLE\s*REG|CAR\s*REG|LICENSE|VEHICLE\s*PAPERS|FUEL\b|DIESEL\b"),
    Rule("R042_REPAIRS_MAINTENANCE", 42, "debit", "Repairs & Maintenance", 0.9, r"REPAIR|MAINTENANCE\s*(?!FEE|CHG|CHARGE|ACCT|ACCOUNT)|SERVICING|PLUMBING|ELECTRICAL|CARPENTRY"),
    Rule("R049_FOREIGN_EXAM_FEES", 49, "both", "Foreign Exam Fees", 1.0, r"\bSAT\b|TOEFL\b|IELTS\b|GRE\b|GMAT\b"),
    Rule("R050_EXAM_GENERIC_PASSTHROUGH", 50, "both", "Student Exam Fees (Pass-Through)", 0.95, r"\bEXAM\b|EXAM\s*FEE|REGISTRATION\s*(?:EXAM|FORM|FEE)|ADMISSION|APPLICATION\s*FORM|COMMON\s*ENTRANCE"),
    Rule("R060_OFFICE_RENT_CORPORATE_SERVICES", 60, "debit", "Office Rent / Lease", 0.92, r"CORPORATE\s*SERVICES|SERVICED\s*OFFICE|VICTORIA\s*ISLAND|ADEOLA\s*ODEKU"),
    Rule("R070_ADMINISTRATIVE_EXPENSES", 70, "debit", "Administrative Expenses", 0.95, r"MISCELLANEOUS|MISC\b|OFFICE\s*EXP|STATIONERY|PRINTING|COURIER|NEWSPAPER|SUBSCRIPTION|REGISTRATION\b|INTERNET|DATA\s*BUNDLE|AIRTIME"),
    Rule("R090_GENERIC_OUTWARD_TRANSFER", 90, "debit", OWN_TRANSFER, 0.6, r"NIP\s*TO|TRF\s*TO|TRF\s*IFO|LOCAL\s*TRANSFERS"),
]
#: Fallback words.
CHARGE_WORDS = "CHG|COMM|FEE|VAT|TAX|MOBL|SMS|MAINT|LEVY|DUTY"
NOT_CHARGE_WORDS = "SCHOOL|TUITION|EXAM|CLASS|LESSON|TRAINING|COURSE|SEMINAR|LEGAL|LAWYER|CONSULT|AUDIT|PROFESSIONAL|RETAINER|MEMBER|LICENSE|SUBSCRIPTION"
MOVE_WORDS = "TRF|NIP|FRM|TO|MNY|TRANSFER|PYMT|PAYMENT|WEB|POS|ATM"
REVERSAL = r"REVERSAL|REV\b|RET\b|ERR\b|REV\s*TRF"


def vendor_rules() -> list[Rule]:
    return [Rule(f"VEND_{c.replace(' ', '_').upper()}_{i}", 15, "debit", c, 0.95, rf"\b{k}\b") for c, ks in VENDORS.items() for i, k in enumerate(ks)]


def built_in() -> list[Rule]:
    return in_order(STATIC + vendor_rules())


def in_order(rules: list[Rule]) -> list[Rule]:
    """ORD-01: by priority, declaration order within."""
    return sorted(rules, key=lambda r: r.priority)


#: Rules that are passed over with one search.
AT_ONCE = 8


class Verdicts:
    """What rules say, as a literal array. Branches yield small numbers, so a hundred of them stay a small expression, and
    the fields of the chosen one are read off the array."""

    FIELDS = (("category", "string"), ("confidence", "double"), ("rule_id", "string"), ("decision_source", "string"))

    def __init__(self) -> None:
        self.said: list[tuple] = []

    def __call__(self, *values) -> Column:
        self.said.append(values)
        return F.lit(len(self.said))

    def field(self, number: Column, k: int, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v[k]).cast(kind) for v in self.said]), number)

    def columns(self, number: Column) -> dict[str, Column]:
        return {n: self.field(number, k, t) for k, (n, t) in enumerate(self.FIELDS)}


def _first(branches: list[tuple[Column, Column]]) -> Column:
    out = F.when(*branches[0])
    for b in branches[1:]:
        out = out.when(*b)
    return out


def _first_of(branches: list[tuple[str | None, str, Column, Column]], norm: Column, side: dict[str, Column]) -> Column:
    """Number of the first branch (pattern, side, test, verdict) that holds, null if none does. Branches stand in groups, and a group whose
    patterns don't occur in the text is passed over with one search for all of them, since most rows match few rules."""
    groups: list[list] = []
    for branch in branches:
        joins = groups and len(groups[-1]) < AT_ONCE and branch[0] is not None and groups[-1][-1][0] is not None
        groups[-1].append(branch) if joins else groups.append([branch])
    found = []
    for g in groups:
        one = _first([(test, verdict) for *_, test, verdict in g])
        if len(g) > 1:
            sides = dict.fromkeys(which for _, which, *_ in g)
            occurs = {k: norm.rlike("(?i)" + "|".join(f"(?:{pattern})" for pattern, which, *_ in g if which == k)) for k in sides}
            one = F.when(reduce(or_, [side[k] & hit if k in side else hit for k, hit in occurs.items()]), one)
        found.append(one)
    return F.coalesce(*found)


def compile_rules(rules: list[Rule], norm: Column, is_debit: Column, is_credit: Column, say: Verdicts) -> Column:
    """CLS-01: number of the first rule that matches, null if none does."""
    side = {"debit": is_debit, "credit": is_credit}
    branches = []
    for r in in_order(rules):
        hit = norm.rlike(f"(?i){r.pattern}")
        hit = side[r.side] & hit if r.side in side else hit
        # Patterns that may mean something else inside a longer one (references, flags, quotes, names) are tested alone.
        alone = re.search(r"\\[0-9kQ]|\(\?(?![:!=])", r.pattern)
        branches.append((None if alone else r.pattern, r.side, hit & ~norm.rlike(f"(?i){r.exclude}") if r.exclude else hit, say(r.category, r.confidence, r.rule_id, "RULE")))
    return _first_of(branches, norm, side) if branches else F.lit(None).cast("int")


def _near(amount: Column, values: list[float], tolerance: float = 0.01) -> Column:
    return F.exists(F.array(*map(F.lit, values)), lambda v: F.abs(amount - v) <= tolerance + 1e-9)


def amount_rules(norm: Column, debit: Column, say: Verdicts) -> Column:
    """CLS-03: standard fees by amount, before the rules; debit rows only."""
    a = F.abs(debit.cast("double"))
    charge, move = norm.rlike("CHG|FEE|VAT|SMS|COMM|MAINT|LEVY|DUTY"), norm.rlike("TRF|NIP|PAYMENT|PYMT|WEB|POS|ATM|DATA|AIRTIME")
    own = (debit != 0) & _near(a, [3.75, 53.75, 26.88])
    fee = (debit != 0) & _near(a, [50.0, 52.5, 10.0, 4.0])
    stamp = (debit != 0) & _near(a, [50.0]) & norm.rlike("STAMP|LEVY")
    out = F.when(stamp, say("Bank Charges", 1.0, "R010_BANK_STAMP_DUTY", "RULE_SPECIFIC")).when(own, say("Bank Charges", 1.0, "R014_SPECIFIC_AMOUNT_CHARGES", "RULE_SPECIFIC"))
    return out.when(fee & (charge | (~move & ~norm.rlike(r"OPENING\s*BAL"))), say("Bank Charges", 0.99, "AMT_STD_FEE", "RULE"))


def front_amount_rules(norm: Column, debit: Column, say: Verdicts) -> Column:
    """CLS-04: the front-end's fee amounts, unless the row is an opening balance."""
    return F.when((debit > 0) & _near(debit.cast("double"), [50.0, 3.75, 52.5, 10.0, 4.0], 0.001) & ~norm.rlike(r"OPENING\s*BAL"), say("Bank Charges", 1.0, "AMT_STD_FEE", "RULE"))


def fallback(norm: Column, is_debit: Column, say: Verdicts) -> Column:
    """CLS-05: charge words, transfer words, else uncategorised by side."""
    charge = is_debit & norm.rlike(CHARGE_WORDS) & ~norm.rlike(NOT_CHARGE_WORDS)
    out = F.when(charge, say("Bank Charges", 0.8, None, "RULE")).when(is_debit & norm.rlike(MOVE_WORDS), say(OWN_TRANSFER, 0.6, None, "AI_HEURISTIC"))
    return out.when(is_debit, say("Uncategorized Expense", 0.0, None, "AI")).otherwise(say("Uncategorized Income", 0.0, None, "AI"))


def accepted_prior(prior: Column) -> Column:
    """CLS-06: the category that a row already has, unless it is a placeholder."""
    return F.when(~prior.isin("", "Unallocated", "Uncategorized", "Review Required"), prior)


def is_reversal(norm: Column) -> Column:
    """CLS-07."""
    return norm.rlike(REVERSAL)


def categorise(df: DataFrame, narration: str = "narration", rules: list[Rule] | None = None) -> DataFrame:
    """CLS-01, 03, 05, 07: ``df`` with clean_description, entity, is_reversal, category, confidence, rule_id, decision_source."""
    out, say = df.withColumn("clean_description", text.normalise(F.col(narration))), Verdicts()
    norm, debit = F.col("clean_description"), F.col("debit")

    def found(n: Column) -> Column:
        return F.coalesce(amount_rules(n, debit, say), compile_rules(rules or built_in(), n, debit != 0, F.col("credit") != 0, say), fallback(n, debit != 0, say))

    out = out.withColumns({"_v": text.bind(norm, found), "is_reversal": is_reversal(norm), "entity": text.entity(norm)})
    return out.withColumns(say.columns(F.col("_v"))).drop("_v")


def categorise_front(df: DataFrame, narration: str = "narration", prior: str = "category") -> DataFrame:
    """CLS-02, 04, 06: the front-end's rules over a row that may have a category, which is taken at 0.85 where no rule
    matches."""
    out, say = df.withColumns({"clean_description": text.normalise_front(F.col(narration)), "_prior": accepted_prior(F.col(prior))}), Verdicts()
    norm, debit = F.col("clean_description"), F.col("debit")
    by_rule = text.bind(norm, lambda n: F.coalesce(front_amount_rules(n, debit, say), compile_rules(FRONT_END, n, debit > 0, F.col("credit") > 0, say)))
    out = out.withColumns({"_v": by_rule, "_f": text.bind(norm, lambda n: fallback(n, debit > 0, say))})
    out = out.withColumn("_kept", F.col("_v").isNull() & F.col("_prior").isNotNull()).withColumn("_v", F.coalesce("_v", "_f"))
    taken = {"category": F.col("_prior"), "confidence": F.lit(0.85), "rule_id": F.lit(None).cast("string"), "decision_source": F.lit("AI")}
    return out.withColumns({n: F.when(F.col("_kept"), taken[n]).otherwise(c) for n, c in say.columns(F.col("_v")).items()}).drop("_v", "_f", "_kept", "_prior")


def unresolved(classified: DataFrame) -> DataFrame:
    """CLS-08: rows for the external classifier: nothing but a guess decided them."""
    return classified.where("decision_source in ('AI', 'AI_HEURISTIC') or category like 'Uncategorized%'")


def in_parts(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield part


class TableVerdicts(Verdicts):
    FIELDS = (("rule_id", "string"), ("category", "string"), ("confidence", "double"))


def match_rule_table(df: DataFrame, rules: DataFrame, row_key: list[str] | None = None, norm: str = "clean_description", at_once: int = 100) -> DataFrame:
    """JON-08: rules kept in a table of any length (rule_ord, rule_id, priority, side, pattern, exclude, category, confidence), best per row.

    They are compiled like the built-in ones, in order, ``at_once`` in one expression; a row that has its rule looks no further. Rows are
    neither joined nor moved, and a pattern is compiled once per task.
    """
    text_, out = F.col(norm), df
    names = [n for n, _ in TableVerdicts.FIELDS]
    kinds = "struct<" + ", ".join(f"{n}: {t}" for n, t in TableVerdicts.FIELDS) + ">"
    out = out.withColumn("_best", F.lit(None).cast(kinds))
    side = {"both": F.lit(True), "debit": F.col("debit") != 0, "credit": F.col("credit") != 0}
    for part in in_parts(rules.orderBy("priority", "rule_ord").toLocalIterator(), at_once):
        say, branches = TableVerdicts(), []
        for r in part:
            if r.side in side and r.pattern is not None:
                hit = side[r.side] & text_.rlike(r.pattern)
                branches.append((hit & ~text_.rlike(r.exclude) if r.exclude is not None else hit, say(r.rule_id, r.category, r.confidence)))
        if branches:
            number = F.when(F.col("_best").isNull(), _first(branches))
            out = out.withColumn("_n", number).withColumn("_best", F.coalesce("_best", F.when(F.col("_n").isNotNull(), F.struct(*[c.alias(n) for n, c in say.columns(F.col("_n")).items()]))))
    return out.withColumns({n: F.col(f"_best.{n}") for n in names}).drop("_best", "_n")
