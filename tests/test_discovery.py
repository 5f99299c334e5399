"""Columns found by candidates, by consensus and by profile against loops; printed fields by hand."""

import random
import re
from collections import Counter, defaultdict
from decimal import Decimal as D

import pytest
from ledgerflow.operators import discovery, printed_fields, repair

WORDS = "file_id long, page_no int, line_id int, word_seq long, text string, x0 double, x1 double"


def page(spark, lines, file_id=1):
    rows = [(file_id, p, n, n * 100 + k, t, float(a), float(b)) for p, n, ws in lines for k, (t, a, b) in enumerate(ws)]
    return spark.createDataFrame(rows, WORDS)


# --- LAY-15 ----------------------------------------------------------------------------------------------------------

GOOD = [("date", 0, 50), ("debit", 50, 90), ("credit", 90, 120)]


@pytest.mark.parametrize(("hint", "candidates", "want"), [
    (None, [("UBA", GOOD), ("Wema", [*GOOD, ("balance", 120, 150)])], ("Wema", 6)),
    (None, [("UBA", GOOD), ("Wema", GOOD)], ("UBA", 5)),
    (None, [("UBA", GOOD), ("Wema", [("date", 0, 50), ("a", 0, 1), ("b", 1, 2), ("c", 2, 3), ("d", 3, 4), ("e", 4, 5)])], ("UBA", 5)),  # no amount
    (None, [("UBA", GOOD), ("Wema", [*GOOD, ("balance", 150, 120)])], ("UBA", 5)),  # turned round
    (None, [("UBA", [*GOOD[:2], ("balance", 90, float("inf"))]), ("Wema", GOOD[:2])], ("UBA", 3)),
    ("the uba one", [("Wema", [*GOOD, ("balance", 120, 150)]), ("UBA", [*GOOD[:2], ("x", 1, 2)])], ("UBA", 53)),
    ("uba wema", [("Wema", GOOD), ("UBA", [*GOOD, ("x", 1, 2)])], ("Wema", 55)),  # the first that is hinted at
    ("gtbank", [("Access", [*GOOD, *[(f"c{i}", i, i + 1) for i in range(20)]]), ("GTCO", GOOD)], ("GTCO", 15)),
    ("gtco", [("Access", GOOD), ("UBA", GOOD[:2]), ("GTBank", [("date", 5, 5), ("debit", 0, 1), ("credit", 1, 2)])], ("Access", 0)),
    ("auto", [("UBA", GOOD[:2])], None),
])
def test_judged_cuts(spark, hint, candidates, want):
    rows = [(1, 0, k, d, c, float(a), float(b)) for k, (d, cuts) in enumerate(candidates) for c, a, b in cuts]
    cuts = spark.createDataFrame(rows, "file_id long, page_no int, place int, detector string, col_name string, x_left double, x_right double")
    out = discovery.judged_cuts(cuts, spark.createDataFrame([(1, hint)], "file_id long, hint string")).collect()
    assert [(r.detector, r.score) for r in out] == ([want] if want else [])


# --- LAY-16 ----------------------------------------------------------------------------------------------------------


def consensus_loop(rows):
    pages = sorted({r[1] for r in rows})[:5]
    dates, sums = [], []
    for r in sorted(r for r in rows if r[1] in pages):
        text = r[4].strip()
        if len(text) >= 6 and any(re.match(p, text) for p in repair.DATES):
            dates.append(round(r[5], 0))
        if re.match(discovery.AMOUNT, text):
            sums.append(round(r[6], 0))
    if not dates:
        return []
    date = Counter(dates).most_common(1)[0][0]
    right = [x for x in sums if x > date + 50]
    clusters = []
    for x in sorted(set(right)):
        if not clusters or x - clusters[-1][-1] > 40:
            clusters.append([])
        clusters[-1].append(x)
    if not right:
        return []
    modes = [Counter(x for x in right if x in c).most_common(1)[0][0] for c in clusters]
    zone = lambda k: (modes[-k] - 30, modes[-k] + 10) if len(modes) >= k else (0, 0)
    return [("balance", *zone(1)), ("credit", *zone(2)), ("date", date - 10, date + 50), ("debit", *zone(3))]


def test_consensus_as_a_loop_counts_it(spark):
    random.seed(2)
    rows = []
    for f in range(25):
        for p in range(random.choice([1, 3, 8])):
            for n in range(random.choice([2, 6])):
                for k in range(4):
                    x = random.choice([30, 31.5, 32.5, 100, 300, 340, 341, 400, 402, 500, 560, 561])
                    rows.append((f, p, n, n * 10 + k, random.choice(["01-Jan-2024", "2024-01-01", "5.00", "1,000", "77", "x", " 3.25 "]), float(x), x + random.choice([10.0, 20.5, 21.5])))
    got = defaultdict(list)
    for r in discovery.consensus_zones(spark.createDataFrame(rows, WORDS)).orderBy("file_id", "col_name").collect():
        got[r.file_id].append((r.col_name, r.x_left, r.x_right))
    want = {f: w for f in range(25) if (w := consensus_loop([r for r in rows if r[0] == f]))}
    assert dict(got) == want and len(want) > 15


# --- LAY-17 ----------------------------------------------------------------------------------------------------------


def profile_loop(lines):
    """Pixel by pixel, and names as a reader gives them."""
    busy = [False] * 1100
    for _, _, ws in lines:
        for _, a, b in ws:
            for k in range(max(0, int(a)), int(b)):
                busy[k] = True
    columns, start = [], None
    for k, on in enumerate(busy):
        if on and start is None:
            start = k
        elif not on and start is not None:
            columns.append([None, start, k])
            start = None
    columns = [c for c in columns if c[2] - c[1] > 10]
    best, head = 0, None
    for _, _, ws in lines:
        said = " ".join(w[0] for w in ws).upper()
        hits = sum(bool(re.search(discovery.SIGNATURES[k], said)) for k in ("date", "description", "balance"))
        if hits > best:
            best, head = hits, ws
    if head:
        for t, a, b in head:
            name = next((k for k, p in discovery.SIGNATURES.items() if re.search(p, t.upper())), None)
            at = next((c for c in columns if c[1] <= (a + b) / 2 <= c[2]), None)
            if at and name:
                at[0] = name
    elif len(columns) >= 2:
        columns[0][0], columns[-1][0] = "date", "balance"
        free = [c for c in columns if not c[0]]
        if free:
            max(free, key=lambda c: c[2] - c[1])[0] = "description"
    names = {c[0] for c in columns}
    if "date" not in names or not names & {"debit", "credit", "balance", "amount"}:
        if columns:
            columns[0][0] = "date"
        if len(columns) > 1:
            columns[-1][0] = "balance"
        inner = columns[1:-1]
        if inner:
            text = max(inner, key=lambda c: c[2] - c[1])
            text[0] = "description"
            rest = inner[inner.index(text) + 1 :]
            for c, name in zip(rest, {2: ["debit", "credit"], 1: ["amount"]}.get(len(rest), []), strict=False):
                c[0] = name
    return [tuple(c) for c in columns]


HEADER = [("Date", 30, 60), ("Details", 120, 180), ("Debit", 300, 340), ("Credit", 400, 440), ("Balance", 500, 560)]


def test_ragged_columns_by_hand(spark):
    """Edges that differ from row to row, a valley of one pixel, and a word that bridges two columns on one page."""
    body = [(0, n, [("01-Jan", 28 + n, 70 - n), ("RENT", 120, 130 + 30 * n), ("PAID", 130 + 30 * n, 150 + 30 * n), ("5.00", 310 - n, 345), ("9.00", 505, 559 + n)]) for n in range(1, 4)]
    out = discovery.discovered_columns(page(spark, [(0, 0, HEADER), *body])).orderBy("col_ord").collect()
    assert [(r.col_name, r.x_left, r.x_right) for r in out] == [("date", 29, 69), ("description", 120, 240), ("debit", 300, 345), ("credit", 400, 440), ("balance", 500, 562)]


def test_random_pages_pixel_by_pixel(spark):
    random.seed(8)
    vocabulary = ["Date", "Value", "Narration", "Debit", "Credit", "Bal", "x", "7.00", "INTO", "9"]
    rows, want = [], {}
    for f in range(60):
        lines = []
        for n in range(random.randrange(1, 4)):
            ws = sorted((float(random.randrange(-3, 900)) + random.choice([0, 0.5, 0.9]), random.choice([0.2, 5, 12, 40, 90]), random.choice(vocabulary if f % 3 else vocabulary[6:])) for _ in range(random.randrange(1, 7)))
            lines.append((0, n, [(t, a, a + w) for a, w, t in ws]))
        rows += [(f, 0, n, n * 100 + k, t, a, b) for _, n, ws in lines for k, (t, a, b) in enumerate(ws)]
        want[f] = profile_loop(lines)
    got = defaultdict(list)
    for r in discovery.discovered_columns(spark.createDataFrame(rows, WORDS)).orderBy("file_id", "col_ord").collect():
        got[r.file_id].append((r.col_name, r.x_left, r.x_right))
    assert dict(got) == {f: w for f, w in want.items() if w}


# --- LAY-41, LAY-42 --------------------------------------------------------------------------------------------------


def fields(spark, f, texts, names):
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "file_id long, page_no int, text string")
    return [tuple(r[n] for n in names) for r in f(df).orderBy("file_id").collect()]


def test_split_totals(spark):
    texts = ["TOTAL DEBIT 1,654.0 1 8, 157.69 TOTAL CREDIT 2,000.00", "Total  Debit\n1,654,018,157.69", "TOTAL DEBIT 157.69", "TOTAL DEBIT 1 2 3.45 x", "TOTAL DEBIT 12, 345.67 89", "OPENING BALANCE 1 234.50 CLOSING BALANCE 9.00", None, "TOTAL DEBIT: 5.00", "TOTAL DEBIT 1.2.3"]
    got = fields(spark, printed_fields.split_digit_fields, texts, ["statement_total_debit", "statement_total_credit", "opening_balance", "closing_balance"])
    money = lambda x: None if x is None else D(x)
    assert got == [tuple(map(money, r)) for r in [("1654018157.69", "2000.00", None, None), ("1654018157.69", None, None, None), ("157.69", None, None, None), ("123.45", None, None, None), ("12345.67", None, None, None), (None, None, "1234.50", "9.00"), (None,) * 4, (None,) * 4, ("0.00", None, None, None)]]


def test_compact_labels(spark):
    texts = ["Opening Balance: 1 200.50 ClosingBalance5 Closing Balance7.00 Account Number 0123456789 January 1, 2024 to Mar 31, 2024", "Hello ADE  BELLO, Here is your Account Summary Total Debit:3,0 00.00 Total Credit 4.00", "Bank Statement MR X Y No 7", ""]
    got = fields(spark, printed_fields.compact_fields, texts, ["opening_balance", "closing_balance", "statement_total_debit", "statement_total_credit", "account_no", "account_name", "period"])
    assert got == [(D("1200.50"), D("7.00"), None, None, "0123456789", None, "January 1, 2024 to Mar 31, 2024"), (None, None, D("3000.00"), D("4.00"), None, "ADE BELLO", None), (None,) * 5 + ("MR X Y", None), (None,) * 7]


def test_totals_over_the_end_of_a_page(spark):
    pages = [
        (1, 2, "rows\n1,000.00 2,000.00"), (1, 3, "3 of 3"), (1, 1, "Statement for between 01-Jan-2024 and and 31 March"), (2, 1, "Currency US Dollar\nAccount Name X\n12,345.6 9,876.\n7 54\n1 of 1"), (3, 1, None), (3, 2, "Currency NGN Total"), (3, 3, "Withdrawals Account No 0123456789"),
        (4, 1, "Statement for period 1 January 2024"), (4, 2, "and ending 31-Mar-2024 Opening"), (4, 3, "Balance 5.00"),
    ]
    out = printed_fields.footer_fields(spark.createDataFrame(pages, "file_id long, page_no int, text string").repartition(4)).orderBy("file_id").collect()
    assert [tuple(r)[1:] for r in out] == [(None, None, None, D("1000.00"), D("2000.00")), ("USD", None, None, D("12345.67"), D("9876.54")), ("NGN", None, "0123456789", None, None), (None, "01-Jan-2024 to 31-Mar-2024", None, None, None)]
