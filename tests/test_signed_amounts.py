"""Amounts and balances below zero are amounts: columns, lines and entries count and read them with their sign."""

from decimal import Decimal

from ledgerflow.operators import layout
from ledgerflow.sources import tabular


def test_money_columns_count_negative_balances(spark):
    words = spark.createDataFrame([(1, 0, k, t, x - 40.0, x) for k, (t, x) in enumerate([("5.00", 400.0), ("0.00", 500.0), ("-1,234.56", 600.0), ("7.00", 400.0), ("0.00", 500.0), ("-9.00", 600.0), ("A-9.00", 700.0)])], "file_id long, page_no int, word_seq long, text string, x0 double, x1 double")
    got = {(r.col_name, r.x1, r.n) for r in layout.money_columns(words).collect()}
    assert got == {("debit", 400, 2), ("credit", 500, 2), ("balance", 600, 2)}


def test_amount_from_right_beside_a_negative_balance(spark):
    lines = spark.sql("select * from values (1, '01-Jan-2024', null, -1234.56, 'RENT 50.00 -1,234.56'), (2, '01-Jan-2024', null, 9.00, 'RENT -50.00 9.00'), (3, '01-Jan-2024', null, -9.00, 'RENT 50.00 9.00') t(line_no, date_raw, amount, balance, text)").selectExpr("line_no", "date_raw", "cast(amount as decimal(18,2)) amount", "cast(balance as decimal(18,2)) balance", "text")
    got = {r.line_no: r.amount for r in layout.amount_from_right(lines).collect()}
    assert got == {1: Decimal("50.00"), 2: Decimal("-50.00"), 3: None}


def test_explode_amounts_on_lines_with_a_negative_balance(spark):
    words = spark.createDataFrame([(1, 0, 1, k, t, x - 40.0, x) for k, (t, x) in enumerate([("RENT", 200.0), ("5.00", 400.0), ("7.00", 500.0), ("-1,234.56", 600.0)])], "file_id long, page_no int, line_id int, word_seq long, text string, x0 double, x1 double")
    got = sorted((r.word_seq, r.debit, r.credit) for r in layout.explode_amounts(words, 450).collect())
    assert got == [(1, Decimal("5.00"), Decimal("0.00")), (2, Decimal("0.00"), Decimal("7.00"))]


def test_anchored_lines_with_negative_balances(spark):
    day = "02-Jan-2024 02-Jan-2024"
    lines = spark.createDataFrame([(1, 1, f"{day} RENT 5.00 1.00"), (1, 2, "more"), (1, 3, f"{day} FUEL 3.00 -2.00"), (1, 4, f"{day} PAY 1,000.00 -1.00")], "file_id long, line_no int, line string")
    got = [(r.line_no, r.description, r.debit, r.credit, r.balance) for r in tabular.anchored_lines(lines).orderBy("line_no").collect()]
    d = Decimal
    assert got == [(1, "RENT", d("0.00"), d("5.00"), d("1.00")), (3, "more FUEL", d("3.00"), d("0.00"), d("-2.00")), (4, "PAY", d("0.00"), d("1000.00"), d("-1.00"))]
