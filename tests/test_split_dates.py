"""Dates split over rows against a plain loop, with short ranges and over random cells."""

import random
import re

from ledgerflow.operators import layout


def loop(rows):
    """Rows of one file in order, each (line_no, cell, value date, text), cells emptied as they are taken."""
    cells = [(c or "").strip() for _, c, *_ in rows]
    out = []
    for i, (_, raw, value, text) in enumerate(rows):
        cell, text = cells[i], text or ""
        emptied = cell == "" and (raw or "").strip() != ""
        if re.fullmatch(r"\d{1,2}-[A-Za-z]{3}-\d{4}", cell):
            out.append(raw)
            continue
        m = re.search(r"\b(\d{1,2}-[A-Za-z]{3})-?\b", cell or text)
        if not m:
            out.append("" if emptied else raw)
            continue
        if i + 1 < len(rows) and re.fullmatch(r"20\d{2}", cells[i + 1]):
            year, cells[i + 1] = cells[i + 1], ""
        else:
            here = re.search(r"\b(20\d{2})\b", f"{value or ''} {text}")
            year = here[1] if here else None
        out.append(f"{m[1]}-{year}" if year else m[1])
    return out


def test_random_cells_are_as_in_the_loop(spark):
    random.seed(31)
    cell = lambda: random.choice(["01-Nov-", "2024", "2025", " 2026 ", "2025", "2024", "", None, "11-Mar-2021", "paid", "7-Feb-"])
    text = lambda: random.choice(["", None, "05-Dec- more", "since 2019", "3-Jun-2018 and 2017", "no date", "12-Julius", "09-Sep"])
    rows = [(f, k, cell(), random.choice([None, "", "10-Feb-2022"]), text()) for f in (None, 1, 2, 3) for k in range(160)]
    want = {}
    for f in (None, 1, 2, 3):
        own = [r[1:] for r in rows if r[0] == f]
        want |= {(f, r[0]): o for r, o in zip(own, loop(own), strict=True)}
    df = spark.createDataFrame(random.sample(rows, len(rows)), "file_id long, line_no long, date_raw string, value_date string, text string")
    for span in (7, 1 << 17):
        out = layout.complete_split_dates(df, span=span)
        assert out.columns == df.columns
        assert {(r.file_id, r.line_no): r.date_raw for r in out.collect()} == want
    assert layout.complete_split_dates(df.limit(0)).count() == 0
