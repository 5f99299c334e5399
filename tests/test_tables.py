"""Tables with padded, shifted and continued cells, and fields that run into each other: by hand and against loops."""

import random
import re
from collections import defaultdict

from ledgerflow.functions import text
from ledgerflow.sources import tables

CELLS = "file_id long, row_idx int, cells array<string>"


def test_layouts_by_hand(spark):
    a = ["Date", "Transaction Details", "Reference", "Value Date", "Withdrawals", "Lodgements", "Balance"]
    b = ["Posted Date", "Value Date", "Ref", "Debit", "Credit", "Balance", "Originating Branch", "Remarks"]
    rows = [
        (1, 0, ["Statement", None]), (1, 1, a), (1, 2, ["01-Jan-2024", "RENT\nMAY", "R1", "02-Jan-2024", "5.00", "", "95.00"]), (1, 3, ["02-Jan-2024", "PAD", "", "R2", "", "03-Jan-2024", "", "", "7.00", "102.00"]), (1, 4, ["Opening Balance", "x", "", "", "", "", "1.00"]),
        (1, 5, ["03-Jan-2024", "short", "", "", "1.00", "2.00"]), (1, 6, ["not a date", "x", "", "", "1.00", "", "2.00"]), (1, 7, [" 4/1/2024 ", "", "", "", "(1.00)", "", "2.00"]),
        (2, 0, b), (2, 1, ["01-Jan-2024", "02-Jan-2024", "R", "5.00", "", "95.00", "LAGOS", "RENT"]), (2, 2, ["05-Jan-2024", "PAD", "", "R2", "", "", "", "", "7.00", "102.00"]), (2, 3, ["06-Jan-2024", "", "R", "5.00", "", "95.00", "LAGOS"]),
        (3, 0, ["01-Jan-2024", "no header", "", "", "", "4.00", "8.00"]), (3, 2, a), (4, 0, None), (4, 1, []),
    ]
    out = tables.layout_rows(spark.createDataFrame(rows, CELLS)).orderBy("file_id", "row_idx").collect()
    assert [tuple(r) for r in out] == [
        (1, 2, "details", "01-Jan-2024", "RENT MAY", "R1", "02-Jan-2024", 5.0, 0.0, 95.0), (1, 3, "padded", "02-Jan-2024", "PAD", "R2", "03-Jan-2024", 0.0, 7.0, 102.0), (1, 7, "details", "04-Jan-2024", "No Description", "", None, -1.0, 0.0, 2.0),
        (2, 1, "branches", "01-Jan-2024", "RENT", "R", "02-Jan-2024", 5.0, 0.0, 95.0), (2, 2, "padded", "05-Jan-2024", "PAD", "R2", None, 0.0, 7.0, 102.0), (3, 0, "details", "01-Jan-2024", "no header", "", None, 0.0, 4.0, 8.0),
    ]


def test_continued_tables_by_hand(spark):
    head = ["Transaction\nDate", "Remarks", "Value Date", "Debit", "Credit", "Balance"]
    rows = [
        (1, 0, 0, ["", "carried text", "", ""]), (1, 0, 1, ["x", "y"]), (1, 0, 2, head), (1, 0, 3, ["", "before any", "", "", "", ""]), (1, 0, 4, ["01-Jan-2024", "TRF REF: AB12 , to ADE", "02-Jan-2024", "5.00\n9.00", "", "95.00\n1"]), (1, 0, 5, [None, "goes on", None, None, None, None]),
        (1, 1, 0, ["", "over the page", "", ""]), (1, 1, 1, ["02-Jan-2024", "", "BRANCH", "7.00", "", "88.00"]), (1, 1, 2, ["03-Jan-2024", "OPENING BALANCE", "", "1.00", "", "2.00"]), (1, 1, 3, ["", "still the second", "", "", ""]), (1, 1, 4, ["04-Jan-2024", "no movement", "", "", "", "88.00"]), (1, 1, 5, ["", "lost with it", "", ""]),
        (2, 0, 0, ["", "only text", "", ""]), (3, 0, 0, ["Day date", "", "left", "12345", "x", "y", "balance"]), (3, 0, 1, ["01-Jan-2024", "", "", "", "3.00", "4.00", "5.00"]), (3, 0, 2, ["02-Jan-2024", "n", "TEXT", "q", "3.00", "", "5.00"]),
    ]
    out = tables.continued_table_rows(spark.createDataFrame(rows, "file_id long, page_no int, row_idx int, cells array<string>")).orderBy("file_id", "page_no", "row_idx").collect()
    assert [tuple(r)[1:] for r in out] == [
        (0, 4, "01-Jan-2024", "02-Jan-2024", "REF: AB12", "REF: AB12 TRF  , to ADE goes on over the page before any", 5.0, 0.0, 95.0), (1, 1, "02-Jan-2024", "BRANCH", "", "BRANCH still the second", 7.0, 0.0, 88.0),
        (0, 1, "01-Jan-2024", "", "", "", 3.0, 4.0, 5.0), (0, 2, "02-Jan-2024", "TEXT", "", "TEXT", 3.0, 0.0, 5.0),
    ]


def continue_loop(rows):
    """One file whose pages have the guessed places, row by row."""
    out, last, early = [], None, []
    for _, _, _, cells in rows:
        if len(cells) < 4:
            continue
        cell = lambda k, c=cells: " ".join((c[k] or "").split()) if 0 <= k < len(c) else ""
        day, said = cell(0), cell(1)
        dated = re.fullmatch(r"\d{2}-[A-Za-z]{3}-\d{4}", day)
        if dated and not said:
            said = next((cell(1 + k) for k in (-1, 1, 2, -2) if 0 <= 1 + k < len(cells) and 1 + k not in (0, 3, 4, 5) and cell(1 + k)), "")
        if dated and not any(k in f"{day} {said}".upper() for k in tables.NO_ENTRY):
            m = re.search(tables.REFERENCE, said)
            whole = " ".join(x for x in [m[0], re.sub(tables.REFERENCE, "", said).strip(" ,;")] if x) if m else said
            amount = lambda k, c=cells: float(next((x.strip() for x in (c[k] or "").split("\n") if x.strip()), "0")) if k < len(c) else 0.0
            last = [day, [whole], amount(3), amount(4)]
            out.append(last)
        elif not day and said:
            (last[1] if last else early).append(said)
    if out:
        out[0][1] += early
    return [(d, " ".join(x).strip(), a, b) for d, x, a, b in out if a or b]


def test_random_tables_as_a_loop_reads_them(spark):
    random.seed(3)
    options = [["", "", "01-Jan-2024", "02-Feb-2024", "x"], ["", "TEXT", "REF12 a", "refno: 7 b;", "Closing Balance", "b\nc"], ["", "03-Jan-2024", "v"], ["", "5.00", "1.00\n2.00"], ["", "\n7.50"], ["", "9.00"]]
    rows = [(f, p, n, [random.choice(o) for o in options[: random.choice([3, 4, 6, 6, 6])]]) for f in range(20) for p in range(2) for n in range(12)]
    got = defaultdict(list)
    for r in tables.continued_table_rows(spark.createDataFrame(rows, "file_id long, page_no int, row_idx int, cells array<string>")).orderBy("file_id", "page_no", "row_idx").collect():
        got[r.file_id].append((r.date_raw, r.description, r.debit, r.credit))
    want = {f: w for f in range(20) if (w := continue_loop([r for r in rows if r[0] == f]))}
    assert dict(got) == want and sum(map(len, got.values())) > 60


def fields_loop(ref, branch, said):
    ref, branch, said = ((x or "").strip() for x in (ref, branch, said))
    m = re.match(text.BRANCH_IN_FRONT, said)
    if m and not re.match(text.BRANCH, branch):
        branch, said = m[1].strip(), m[2].strip()
    if re.match(text.BRANCH, ref) and not branch:
        branch, ref = ref, ""
    first = said.split()[0] if said else ""
    token = first.strip("'")
    if (not ref or ref in text.PLACEHOLDERS) and len(token) >= 6 and re.search(r"\d", token):
        ref, said = first, said[len(first) :].strip()
    if " " in ref:
        ref, *rest = ref.split()
        said = " ".join([*rest, said]).strip()
    return ("" if ref in text.PLACEHOLDERS else ref, branch, said)


BY_HAND = [
    (("", "", "205 LAGOS MAIN branch rent"), ("", "205 LAGOS MAIN", "branch rent")), (("'GAP", "", "REF123456 PAID"), ("REF123456", "", "PAID")), (("205 IKEJA", "", "RENT"), ("", "205 IKEJA", "RENT")), (("AB12 more words", "x", "RENT"), ("AB12", "x", "more words RENT")),
    (("GAP", "101 ABA", "205 LAGOS RENT x"), ("", "101 ABA", "205 LAGOS RENT x")), (("R1", "", "'1234567 RENT"), ("R1", "", "'1234567 RENT")), ((None, None, None), ("", "", "")), (("205 IKEJA", "101 ABA", "123456"), ("205", "101 ABA", "IKEJA 123456")),
]


def test_fields_that_run_into_each_other(spark):
    random.seed(6)
    pool = ["", " ", "GAP", "'", "'GAP", "205 IKEJA", "101 ABA TOWN ", "AB12 more", "REF123456", "'1234567", "RENT", "205 LAGOS MAIN branch", "x\ty"]
    rows = [w for w, _ in BY_HAND] + [(random.choice([*pool, None]), random.choice(pool), " ".join(random.choices(pool, k=random.randrange(3)))) for _ in range(400)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, reference string, branch string, description string")
    got = [tuple(r)[1:] for r in text.repair_fields(df).orderBy("id").collect()]
    assert got[: len(BY_HAND)] == [want for _, want in BY_HAND] and got == [fields_loop(*r) for r in rows]
