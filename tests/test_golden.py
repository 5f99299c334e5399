"""Known rows: amounts, narrations, template verdicts, and loops against their closed forms."""

import random
from decimal import Decimal

import pytest
from ledgerflow.functions import dates, money, text
from ledgerflow.operators import chain, review, rules, templates
from ledgerflow.streaming import ledger_stream
from pyspark.sql import functions as F

TAX = templates.built_in_templates()["firs-sirs-na"]


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("3,590.00", 3590.0), ("NGN 1,234.56", 1234.56), ("(2,500.00)", -2500.0), ("", 0.0), (None, 0.0), ("not-a-number", 0.0)])
def test_bank_amounts(spark, raw, want):
    assert one(spark, raw, money.parse_money(F.col("v"))) == want


@pytest.mark.parametrize(("mode", "raw", "want"), [("ledger", "1,290,00000", 1290000.0), ("ledger", "12345678", 0.0), ("tabular", "(5.00)", 5.0), ("nullable", "N-10153", -10153.0), ("nullable", "AB12", None), ("strict", "1.234", 0.0), ("prefix", "12.50abc", 12.5), ("fidelity", "1,234,567", 1234567.0), ("eco", "12.5", None)])
def test_amount_modes(spark, mode, raw, want):
    assert one(spark, raw, money.parse_money(F.col("v"), mode)) == want


@pytest.mark.parametrize(("raw", "want"), [("15-Jan-21", "15-Jan-2021"), ("1-JAN-2026", "1-JAN-2026"), ("21 Jan", "21-Jan-2024"), ("2024", None), ("21:44", None), ("3/4/2025", "03-Apr-2025"), ("junk text", None)])
def test_smart_dates(spark, raw, want):
    assert one(spark, raw, dates.smart_date(F.col("v"))) == want


def test_cleaned_text(spark):
    assert "ltd" in one(spark, "OFFICE LAND L TD", text.narration_words(F.col("v"))).split()
    assert one(spark, "STAMP DUTY CHARGE - 04-01-2022 07/04/2024", text.clean_description(F.col("v"))) == "STAMP DUTY CHARGE - 04-01-2022"
    assert "07/04/2024" not in one(spark, "07/04/2024 Details COB TRF TO ABC", text.clean_description(F.col("v")))
    assert one(spark, "COB TRF 99 TO JOHN OKORO 1234567", text.entity(F.col("v"))) == "JOHN OKORO"


def rows(spark, cases):
    return spark.createDataFrame([(1, i, n, Decimal(str(d)), Decimal(str(c)), Decimal("0")) for i, (n, d, c) in enumerate(cases)], "stmt_id long, row_seq long, narration string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)")


def test_tax_template(spark):
    cases = [
        ("STAMP  DUTY  CHARGE  - 25-01-2021", 50, 0, "Not Applicable"), ("SMS ALERT CHARGES 15JAN 21", 10, 0, "Not Applicable"), ("COB TRF TO SWIFT NETW **4891 Internet Subscription", 53.75, 0, "Not Applicable"), ("COB TRF TO ADESHOLA H **5089 To purchase Facemasks", 10.75, 0, "Not Applicable"),
        ("Counter Cheque Issue Charge", 50, 0, "Not Applicable"), ("VAT- Counter Chq Issue Charge", 3.75, 0, "Not Applicable"), ("COB TRF TO PALMACEDAR **7638 CLEANING SERVICES", 75250, 0, "Review Required"), ("COB TRF TO DAMAC OIL", 10000, 0, "Review Required"), ("COB TRF TO CAKES BIRE", 10000, 0, "Review Required"),
        ("POS PURCHASE @2057HM54-FOODIES HOT AND SPIC LA", 5000, 0, "Review Required"), ("Transfer from OKOJIE OPEYEMI", 0, 5000, "Out of Scope"), ("OFFICE LAND L TD", 1000, 0, "FIRS"),
    ]
    out = templates.classify(templates.normalise_rows(rows(spark, [c[:3] for c in cases])), TAX).orderBy("row_seq").collect()
    assert [r.category for r in out] == [c[3] for c in cases]


def test_custom_template_and_hook(spark):
    custom = templates.Template("custom-1", "Pension Review", "credit", [templates.Category("Pension Income", "credit", 90, ["pension", "ptad", "pfa", "retirement benefit"])])
    df = templates.normalise_rows(rows(spark, [("PTAD pension payment retirement benefit", 0, 250000), ("Office rent payment", 50000, 0), ("Unclear", 0, 9)]))
    out = templates.classify(df, custom)
    assert [r.category for r in out.orderBy("row_seq").collect()] == ["Pension Income", "Out of Scope", "Review Required"]
    fallback = review.external_classifier(out).where("narration = 'Unclear'").first()
    assert (fallback.decision_source, fallback.reason) == ("SYSTEM", review.UNAVAILABLE)

    def hook(frame):
        return frame.assign(category="Pension Income", sub_category=None, tax_authority=None, confidence_label="High", reason="said", review_required=False)

    def broken(frame):
        raise RuntimeError("down")

    labels = spark.createDataFrame([("Pension Income",)], "label string")
    assert review.external_classifier(out, hook, labels).where("narration = 'Unclear'").first().category == "Pension Income"
    assert review.external_classifier(out, broken).where("narration = 'Unclear'").first().decision_source == "SYSTEM"


def test_rules(spark):
    out = rules.categorise(rows(spark, [("PTAD PENSION MAY", 0, 10), ("ACCOUNT MAINTENANCE FEE", 99, 0), ("SMS CHARGE", 26.88, 0), ("ZZZ", 1, 0), ("ZZZ", 0, 1)])).orderBy("row_seq").collect()
    assert [r.rule_id for r in out] == ["R003_PENSION_INCOME", "R007C_REPAIRS_MAINTENANCE", "R014_SPECIFIC_AMOUNT_CHARGES", None, None]
    assert [r.category for r in out][3:] == ["Uncategorized Expense", "Uncategorized Income"]


def infer(balances, moves):
    b = list(balances)
    for _ in range(20):
        for i in range(1, len(b)):
            if b[i] == 0 and b[i - 1] != 0:
                b[i] = b[i - 1] + moves[i]
        for i in range(len(b) - 2, -1, -1):
            if b[i] == 0 and b[i + 1] != 0:
                b[i] = b[i + 1] - moves[i + 1]
    return b


def test_inferred_balances_match_the_loop(spark):
    rng, data, want = random.Random(3), [], {}
    for s in range(60):
        moves = [rng.randint(-500, 500) or 7 for _ in range(12)]
        total, true = 100_000, []
        for m in moves:
            total += m
            true.append(total)
        shown = [0 if rng.random() < 0.5 else b for b in true]
        want[s] = infer(shown, moves)
        data += [(s, i, Decimal(max(-m, 0)), Decimal(max(m, 0)), Decimal(b)) for i, (m, b) in enumerate(zip(moves, shown, strict=True))]
    df = spark.createDataFrame(data, "stmt_id long, row_seq long, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)")
    got = {}
    for r in chain.infer_balances(df).orderBy("stmt_id", "row_seq").collect():
        got.setdefault(r.stmt_id, []).append(int(r.balance))
    assert got == want


def test_truncated_balances_carry_on(spark):
    data = [(1, 1, "100000.00", "1250.00", "101,250.00"), (1, 2, "101250.00", "250.50", "10150050"), (1, 3, "0", "10.00", ""), (1, 4, "101500.90", "0", "101,500.90")]
    df = spark.createDataFrame([(s, n, Decimal(100_000), Decimal(0), Decimal(c), Decimal("101250.00") if n == 1 else Decimal("1015005.00") if n == 2 else Decimal(b), raw) for s, n, b, c, raw in data], "stmt_id long, row_seq long, opening decimal(18,2), debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), raw_balance string")
    cut = df.withColumn("raw_balance", F.when(F.col("row_seq") == 2, "1015005").otherwise(F.col("raw_balance")))
    assert [float(r.balance) for r in chain.mend_truncated_balances(cut).orderBy("row_seq").collect()] == [101250.0, 101500.5, 0.0, 101500.5]


def test_stream(spark, tmp_path):
    df = rows(spark, [("SALARY MAY", 11, 0), ("NIP FROM X", 0, 5)])
    df.write.parquet(str(tmp_path / "in"))
    out = ledger_stream.categorise_stream(ledger_stream.read_ledger(spark, str(tmp_path / "in"), df.schema))
    q = out.writeStream.format("memory").queryName("categorised").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.category for r in spark.sql("select category from categorised").collect()} == {"Salaries & Wages", "Operating Income"}


def test_rule_tables_of_any_length(spark):
    """Several parts of compiled rules, ties in order, nulls and unknown sides, against a loop; no join in the plan."""
    import re

    random.seed(1)
    rows = [(k, f"r{k}", random.choice([1, 2, 3, None]), random.choice(["both", "debit", "credit", "none"]), random.choice([rf"\bw{k % 40}\b", None, "zz"]), random.choice([None, None, "x"]), f"c{k}", k / 100) for k in range(250)]
    table = spark.createDataFrame(rows, "rule_ord int, rule_id string, priority int, side string, pattern string, exclude string, category string, confidence double").repartition(3)
    data = [(i, " ".join(random.choices([*[f"w{k}" for k in range(60)], "x"], k=2)), random.choice([0.0, 5.0]), random.choice([0.0, 7.0])) for i in range(300)]
    df = spark.createDataFrame(data, "id long, clean_description string, debit double, credit double")

    def best(said, debit, credit):
        for _, rule, _, side, pattern, exclude, category, confidence in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            if {"both": True, "debit": debit != 0, "credit": credit != 0}.get(side) and pattern and re.search(pattern, said) and not (exclude and re.search(exclude, said)):
                return rule, category, confidence
        return None, None, None

    for at_once in (7, 100, 1000):
        out = rules.match_rule_table(df, table, at_once=at_once)
        assert "Join" not in out._jdf.queryExecution().toString()
        assert [(r.rule_id, r.category, r.confidence) for r in out.orderBy("id").collect()] == [best(*d[1:]) for d in data]
    assert rules.match_rule_table(df, table.limit(0)).where("rule_id is null").count() == 300


def test_category_tables_of_any_length(spark):
    template = templates.built_in_templates()["debit-expense"]
    said = ["SALARY MAY", "UBER TRIP", "SMS ALERT CHARGE", "rent and transport", "nothing known", "ATM CASH WITHDRAWAL"]
    rows = templates.normalise_rows(spark.createDataFrame([(1, i, s, 5.0, 0.0) for i, s in enumerate(said)], "stmt_id long, row_seq long, narration string, debit double, credit double"))
    want = [r.category for r in templates.classify(rows, template).orderBy("row_seq").collect()]
    for at_once in (1, 5, 100):
        out = templates.classify_by_table(rows, templates.template_rows(spark, template), at_once=at_once)
        assert [r.category for r in out.orderBy("row_seq").collect()] == want and "Join" not in out._jdf.queryExecution().toString()
