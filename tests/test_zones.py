"""Entries by zones: known pages, and loops that carry the state from line to line against the windows."""

import random
import re
from collections import defaultdict
from decimal import Decimal as D

import pytest
from ledgerflow.operators import repair, zones

WORDS = "file_id long, page_no int, line_id int, word_seq long, text string, x0 double, x1 double, top double"


def frame(spark, lines):
    """``lines``: (file_id, page_no, line_id, top, [(text, x0, x1)])."""
    rows = [(f, p, n, k, t, float(a), float(b), float(top)) for f, p, n, top, ws in lines for k, (t, a, b) in enumerate(ws)]
    return spark.createDataFrame(rows, WORDS)


# --- LAY-38 ----------------------------------------------------------------------------------------------------------


def scan_loop(lines, opening, z):
    """One statement's entries, line by line."""
    out, before, date, year, held = [], opening, (None, None), None, None
    for *_, ws in sorted(lines):
        ws = sorted(ws, key=lambda w: w[1])
        raw = " ".join(w[0] for w in ws)
        if any(s in raw.upper() for s in z.skipped):
            continue
        found = (re.findall(zones.NUMERIC_DATE, raw) if z.split_dates else []) + re.findall(zones.DATE, raw)
        if found:
            date = (found[0], found[1] if len(found) > 1 else found[0])
        if z.split_dates:
            years, days = re.findall(zones.YEAR_IN_FRONT, raw), re.findall(zones.MONTH_DAY, raw)
            year = years[0] if years else year
            if not found and days and year:
                date = (f"{year}-{days[0]}", f"{(years[1] if len(years) > 1 else year)}-{days[1] if len(days) > 1 else days[0]}")
        money = [(a, b, D(t.replace(",", ""))) for t, a, b in ((re.sub("[—–−]", "", t), a, b) for t, a, b in ws) if re.fullmatch(zones.AMOUNT_WORD, t) and float(t.replace(",", ""))]
        balances = [m for m in money if m[0] >= z.balance_from]
        amounts = [m for m in money if z.amount[0] <= m[1] < z.amount[1]]
        if z.by_side:
            amounts.sort(key=lambda m: m[1] >= z.credit_from)
        if not balances:
            held = (amounts[-1], raw, date) if amounts else held
            continue
        balance, when = balances[-1][2], date
        text = " ".join(t for t, a, _ in ws if z.description[0] <= a < z.description[1]).strip()
        text = text.strip(" |") if z.by_side else text
        amount = amounts[-1] if amounts else None
        if amount is None and held:
            amount, text = held[0], held[1]
            when, held = held[2] if held[2][0] else date, None
        v = amount[2] if amount else D(0)
        debit, credit = (v, D(0)) if amount and amount[1] < z.credit_from else (D(0), v)
        if before is not None:
            moved = balance - before
            if moved and (not amount or abs(moved - (credit - debit)) > D("0.01")):
                debit, credit = max(-moved, D(0)), max(moved, D(0))
        before = balance
        if debit or credit:
            out.append((*when, text, debit, credit, balance))
    return out


def test_pending_amounts_by_hand(spark):
    """An amount waits for the next line that has a balance only; a line with both leaves it waiting."""
    lines = [
        (1, 0, 1, 10, [("01-Jan-2024", 50, 120), ("02-Jan-2024", 150, 220), ("RENT", 270, 300), ("200.00", 600, 660), ("800.00", 850, 900)]),
        (1, 0, 2, 20, [("SALARY", 270, 330), ("50.00", 700, 750)]),  # waits
        (1, 0, 3, 30, [("03-Jan-2024", 50, 120), ("FEE", 270, 290), ("10.00", 600, 650), ("790.00", 850, 900)]),
        (1, 0, 4, 40, [("840.00", 850, 900)]),  # takes the salary
        (1, 1, 1, 10, [("790.00", 850, 900)]),  # nothing waits: by the balance
        (1, 1, 2, 20, [("Total Debit", 200, 300), ("999.00", 600, 650), ("1.00", 850, 900)]),
        (1, 1, 3, 30, [("WRONG", 270, 300), ("90.00", 600, 650), ("880.00", 850, 900)]),  # printed as a debit
        (1, 1, 4, 40, [("STILL", 270, 300), ("880.00", 850, 900)]),
    ]
    opening = spark.createDataFrame([(1, D("1000.00"))], "file_id long, opening_balance decimal(18,2)")
    out = zones.zone_rows(frame(spark, lines), opening).orderBy("page_no", "line_id").collect()
    assert [(r.date_raw, r.value_date, r.description, r.debit, r.credit) for r in out] == [
        ("01-Jan-2024", "02-Jan-2024", "RENT", D("200.00"), D("0.00")), ("03-Jan-2024", "03-Jan-2024", "FEE", D("10.00"), D("0.00")),
        ("01-Jan-2024", "02-Jan-2024", "SALARY 50.00", D("0.00"), D("50.00")), ("03-Jan-2024", "03-Jan-2024", "", D("50.00"), D("0.00")), ("03-Jan-2024", "03-Jan-2024", "WRONG", D("0.00"), D("90.00")),
    ]


@pytest.mark.parametrize("layout", ["uba", "standard_chartered"])
def test_random_pages_as_a_loop_reads_them(spark, layout):
    random.seed(9)
    z = zones.SCANNED[layout]
    parts = [
        lambda: (random.choice(["01-Jan-2024", "02-Feb-2024", "03-04-2024", "2024-", "05-06", "2023-07-08", "x"]), 40, 120), lambda: (random.choice(["RENT", "|", "TOTAL", "DEBIT", "NIP"]), random.choice([205, 265, 400, 640]), 700),
        lambda: (random.choice(["1,200.00", "35.50", "0.00", "—7.00", "-8.00", "12"]), random.choice([500, 590, 640]), random.choice([519, 520, 660, 689, 690, 700, 759, 760, 800, 824, 825, 829, 830])), lambda: (random.choice(["900.00", "1,000.00", "0.00", "935.50"]), random.choice([824, 825, 830, 850]), 900),
    ]
    lines, by = [], defaultdict(list)
    for f in range(12):
        for p in range(2):
            for n in range(30):
                ws = [make() for make in parts if random.random() < 0.55]
                if ws:
                    lines.append((f, p, n, n * 10, ws))
                    by[f].append(lines[-1])
    openings = {f: D("500.00") if f % 3 else None for f in range(11)}
    got = defaultdict(list)
    known = spark.createDataFrame(list(openings.items()), "file_id long, opening_balance decimal(18,2)")
    for r in zones.zone_rows(frame(spark, lines), known, layout).orderBy("file_id", "page_no", "line_id").collect():
        got[r.file_id].append((r.date_raw, r.value_date, r.description, r.debit, r.credit, r.balance))
    assert dict(got) == {f: rows for f in by if (rows := scan_loop(by[f], openings.get(f), z))} and sum(map(len, got.values())) > 100


# --- LAY-36, LAY-37 --------------------------------------------------------------------------------------------------

HEAD = [("TRANS", 35.9, 63.7), ("DATE", 66.1, 87.9), ("VALUE", 100.1, 127.0), ("DATE", 129.5, 151.3), ("NARRATION", 197.2, 245.5), ("DEBIT", 343.9, 368.1), ("CREDIT", 425.8, 456.3), ("BALANCE", 507.0, 545.2)]


def entries(out):
    return [(r.file_id, r.page_no, r.line_id, r.date_raw, r.value_date, r.description, r.debit, r.credit, r.balance) for r in out.orderBy("file_id", "page_no", "line_id", "word_seq").collect()]


def test_every_printed_amount_is_an_entry(spark):
    lines = [
        (1, 1, 0, 100, HEAD), (1, 1, 1, 116, [("Gift", 161.2, 176.8), ("79", 179.5, 190.6)]),
        (1, 1, 2, 126, [("04-Jan-2026", 33.7, 89.8), ("03-Jan-2026", 97.4, 153.6), ("55,000.00", 435.7, 480.1), ("254,715.86", 515.1, 565.2)]),
        (1, 1, 3, 146, [("CHQ100", 161.2, 200.1), ("TRF", 202.8, 222.2)]),
        (1, 1, 4, 156, [("13-Jan-2026", 33.7, 89.8), ("13-Jan-2026", 97.4, 153.6), ("100,000.00", 345.1, 395.1), ("154,715.86", 515.1, 565.2)]),
        (1, 1, 5, 186, [("02-Feb-", 33.7, 68.7), ("02-Feb-", 97.4, 132.4), ("Transfer", 161.2, 198.4), ("from", 201.1, 221.1)]),
        (1, 1, 6, 196, [("20,000.00", 435.7, 480.1), ("174,715.86", 515.1, 565.2), ("LATIFAT", 223.8, 263.7)]),
        (1, 1, 7, 206, [("2026", 33.7, 55.9), ("2026", 97.4, 119.7)]), (1, 1, 8, 730, [("Chat", 160, 180), ("with Leo", 181, 220), ("5.00", 435, 480), ("6.00", 515, 560)]), (1, 1, 9, 740, [("7.00", 435, 480), ("8.00", 515, 560)]),
        (2, 1, 0, 100, HEAD[:-1]), (2, 1, 1, 120, [("1.00", 345, 395), ("2.00", 515, 560)]),
    ]
    got = entries(zones.amount_lines(frame(spark, lines)))
    assert [x[3:8] for x in got] == [
        ("04-Jan-2026", "03-Jan-2026", "Gift 79", D("0.00"), D("55000.00")), ("13-Jan-2026", "13-Jan-2026", "CHQ100 TRF", D("100000.00"), D("0.00")), ("02-Feb-2026", "02-Feb-2026", "Transfer from LATIFAT", D("0.00"), D("20000.00")),
    ]


def amount_loop(lines, z):
    """Entries of one file whose pages share a header, line by line."""
    out, last, last_value = [], None, None
    text = lambda ws, a, b: " ".join(w[0] for w in sorted(ws, key=lambda w: w[1]) if a <= w[1] < b)
    pages = defaultdict(list)
    for _, p, n, top, ws in sorted(lines):
        if n:
            pages[p].append((n, top, ws))

    def date(rows, i, a, b, fallback):
        at = lambda k: text(rows[k][2], a, b) if 0 <= k < len(rows) else ""
        if m := re.search(zones.DATE, at(i)):
            return m[0]
        for k in range(i, i - 4, -1):
            if m := re.search(zones.DAY_MONTH, at(k)):
                for y in (k, k + 1, k + 2, i, i + 1, i + 2, i + 3):
                    if n := re.search(zones.YEAR, at(y)):
                        return m[0] + n[0]
        for k in (i - 1, i + 1, i - 2, i + 2, i - 3, i + 3):
            if m := re.search(zones.DATE, at(k)):
                return m[0]
        return fallback

    for p, rows in sorted(pages.items()):
        amounts = {}
        for i, (_, _, ws) in enumerate(rows):
            ok = lambda w: re.match(zones.AMOUNT_OR_WHOLE, w[0].strip())
            balances = [w for w in sorted(ws, key=lambda w: w[1]) if z["balance_left"] <= w[1] < 1000 and ok(w)]
            found = [w for w in sorted(ws, key=lambda w: w[1]) if z["amount_left"] <= w[1] < z["balance_left"] and ok(w)]
            if balances and found:
                amounts[i] = (balances[-1], found)
        for i, (balance, found) in amounts.items():
            parts, k = [], i - 1
            while k >= 0 and k not in amounts and rows[i][1] - rows[k][1] <= 22:
                parts.insert(0, text(rows[k][2], z["text_left"], z["text_right"]))
                k -= 1
            parts.append(text(rows[i][2], z["text_left"], z["text_right"]))
            said = " ".join(x for x in parts if x)
            for p_ in (r"(?i)\b(?:TRANS|VALUE|NARRATION|DEBIT|CREDIT|BALANCE|CHQ|NO)\b", zones.DATE, zones.YEAR):
                said = re.sub(p_, " ", said)
            said = re.sub(r"\s+", " ", said).strip(" -|/")
            for w in found:
                day = date(rows, i, z["date_left"], z["date_right"], last)
                value = date(rows, i, z["value_left"], z["value_right"], last_value or day)
                last, last_value = day or last, value or last_value
                v = D(re.sub(r"[^\d.]", "", w[0])) * (-1 if w[0].startswith("(") and w[0].endswith(")") else 1)
                b = D(re.sub(r"[^\d.]", "", balance[0])) * (-1 if balance[0].startswith("(") and balance[0].endswith(")") else 1)
                out.append((1, p, rows[i][0], day, value, said, v if w[2] <= z["debit_right"] else D(0), D(0) if w[2] <= z["debit_right"] else v, b))
    return out


def test_random_amount_lines_as_a_loop_reads_them(spark):
    random.seed(12)
    dates = ["04-Jan-2026", "05-Feb-", "2026", "2025", "13-Mar-2025", "x"]
    parts = [
        lambda: (random.choice(dates), 33.7, 89.8), lambda: (random.choice(dates), 97.4, 153.6), lambda: (random.choice(["Gift", "CHQ", "Value NO", "-a/", "2024 b"]), 161.2, 176.8), lambda: (random.choice(["1,000.00", "5", "(7.50)", "0.00", "N/A"]), 345.1, 395.1),
        lambda: (random.choice(["20.00", "x"]), 435.7, 480.1), lambda: (random.choice(["900.00", "(3.00)", "-"]), 515.1, 565.2),
    ]
    for trial in range(6):
        lines = []
        for p in range(3):
            lines.append((1, p, 0, 100, HEAD))
            top = 110
            for n in range(1, 40):
                top += random.choice([8, 10, 15, 23])
                ws = [make() for make in parts if random.random() < (0.25 if trial % 2 else 0.5)]
                if ws and top < 730:
                    lines.append((1, p, n, top, ws))
        df = frame(spark, lines)
        z = zones.amount_layout(zones.lines_of(df)).where("page_no = 0").first().zones
        assert entries(zones.amount_lines(df)) == amount_loop(lines, z)


# --- LAY-09 ----------------------------------------------------------------------------------------------------------

CUTS = {"date": (0, 100), "reference": (100, 200), "description": (200, 400), "debit": (400, 500), "credit": (500, 600), "balance": (600, 700)}


def mend_loop(ws, cuts):
    ws = sorted(ws, key=lambda w: w[1])
    cells = {c: [w for w in ws if w[3] == c] for c in cuts}
    text = cells["description"]
    place = lambda t: next(w for w in reversed(ws) if w[0] == t)
    if "date" in cuts and not cells["date"] and text and len(text[0][0]) >= 6 and any(re.match(p, text[0][0]) for p in repair.DATES):
        cells["date"].append(text.pop(0))
    if "reference" in cuts and not cells["reference"] and text and len(text[0][0].strip().strip("'")) >= 6 and re.search(r"\d", text[0][0]):
        cells["reference"].append(text.pop(0))
    if text and (not cells.get("debit") or not cells.get("credit")) and re.match(repair.AMOUNT, text[-1][0]):
        x1 = place(text[-1][0])[2]
        for c in ("debit", "credit"):
            if c in cuts and not cells[c]:
                if cuts[c][0] - 30 <= x1 <= cuts[c][1]:
                    cells[c].append(text.pop())
                break
    for c in ("debit", "credit", "balance"):
        if c in cuts and not cells[c]:
            far = lambda w: abs((place(w[0])[1] + place(w[0])[2]) / 2 - sum(cuts[c]) / 2)  # noqa: E731, B023
            near = [(far(w), i) for i, w in enumerate(text) if re.match(repair.NUMBER, w[0]) and far(w) < 60]
            if near:
                cells[c].append(text.pop(min(near)[1]))
    out = {}
    for c, held in cells.items():
        t = [w[0] for w in held]
        if c in repair.AMOUNTS and len(t) > 1:
            pointed = [x for x in t if "." in x and re.search(r"\d", x)]
            t = [pointed[-1]] if pointed else ["".join(t)]
        out[c] = " ".join(t).strip()
    return out


@pytest.mark.parametrize("columns", [list(CUTS), ["date", "description", "credit", "balance"], ["description", "debit"]])
def test_mended_cells_as_a_loop_mends_them(spark, columns):
    random.seed(7)
    cuts = {c: CUTS[c] for c in columns}
    tokens = ["01-Jan-2024", "2024-01-02", "1/2/24", "REF123456", "'AB12345", "RENT", "1,200.00", "35.50", "-7.00", "77", "12,5", "a.b", "9."]
    rows, want = [], []
    for n in range(300):
        ws = []
        for k in range(random.randrange(1, 8)):
            x0 = random.randrange(0, 650)
            ws.append((random.choice(tokens), float(x0), float(x0 + random.choice([20, 40, 60])), random.choice([*columns, "description", "description"])))
        ws.sort(key=lambda w: w[1])
        rows += [(1, 0, n, k, t, a, b, c) for k, (t, a, b, c) in enumerate(ws)]
        want.append(tuple(mend_loop(ws, cuts)[c] for c in columns))
    words = spark.createDataFrame(rows, "file_id long, page_no int, line_id int, word_seq long, text string, x0 double, x1 double, col_name string")
    edges = spark.createDataFrame([(1, 0, c, float(a), float(b)) for c, (a, b) in cuts.items()], "file_id long, page_no int, col_name string, x_left double, x_right double")
    got = repair.mended_cells(words, edges, columns).orderBy("line_id").collect()
    assert [tuple(r[c] for c in columns) for r in got] == want
