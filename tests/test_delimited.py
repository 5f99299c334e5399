"""Delimited files against Python's own reader, and by hand."""

import csv
import io
import random
import time

from ledgerflow.sources import tabular
from pyspark.sql import functions as F


def mine(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    out = {k: [] for k in range(len(texts))}
    for r in sorted(tabular.cell_rows(df).collect()):
        assert r.row_idx == len(out[r.file_id])
        out[r.file_id].append(list(r.cells))
    return [out[k] for k in range(len(texts))]


def python_reader(text):
    return [[c.strip() for c in row] for row in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in row) or len(row) > 1]


BY_HAND = [
    ('a,b\n1,"two\nlines ""q"""\n', [["a", "b"], ["1", 'two\nlines "q"']]),
    ('"x,y",z\r\n"",""\r\n', [["x,y", "z"], ["", ""]]),
    (",,\n,a,\n", [["", "", ""], ["", "a", ""]]),
    ('5" pipe,he said "no",3\n', [['5" pipe', 'he said "no"', "3"]]),
    ('"a"b,c\n', [["ab", "c"]]),
    ("\n\n  \na\n\nb", [["a"], ["b"]]),
    ('﻿"Date",Balance\r1,2', [["Date", "Balance"], ["1", "2"]]),
    ('a,"never closed\nb,c\n', [["a", "never closed\nb,c"]]),
    ("", []), (None, []), ('"', [[""]]), ("é,ß\nend", [["é", "ß"], ["end"]]),
]


def test_by_hand(spark):
    assert mine(spark, [t for t, _ in BY_HAND]) == [w for _, w in BY_HAND]


def test_random_files_as_python_reads_them(spark):
    random.seed(4)
    texts = []
    for _ in range(80):
        out = io.StringIO(newline="")
        rows = [["".join(random.choice('ab",\n\r 0é') for _ in range(random.randrange(6))) for _ in range(random.randrange(2, 6))] for _ in range(random.randrange(1, 8))]
        csv.writer(out, quoting=random.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator=random.choice(["\n", "\r\n"])).writerows(rows)
        texts.append(out.getvalue())
    got, want = mine(spark, texts), [python_reader(t) for t in texts]
    assert got == want and any('"' in c and "\n" in c for f in got for r in f for c in r)


def test_a_file_of_megabytes_takes_linear_time(spark):
    row = '1,"' + "long ""text"", " * 2000 + '",' + "x" * 5000 + ",3\n"
    texts = [row * 100, '"' + 'a""' * 1_000_000 + '",b\n']
    began = time.time()
    first, second = mine(spark, texts)
    assert len(first) == 100 and {len(r) for r in first} == {4} and len(second) == 1 and len(second[0][0]) == 2_000_000
    assert time.time() - began < 40


def test_landing_to_rows(spark, tmp_path):
    """Through the gate, the decoding and the header search to ledger rows."""
    (tmp_path / "one.csv").write_bytes('Statement of account\nTrans Date,Narration,Ref,Debit,Credit,Balance\n01/02/2024,"RENT, ""MAY""\nsecond line",x,"1,500.00",,"8,500.00"\n'.encode())
    (tmp_path / "two.csv").write_bytes("Date,Details description,x,Debit,Credit,Balance\r\n02/02/2024,CAFÉ,x,,20.00,30.00\r\n".encode("latin-1"))
    (tmp_path / "bad.csv").write_bytes(b"a,\x00b")
    out = tabular.project_rows(tabular.read_csv_folder(spark, str(tmp_path)))
    rows = sorted((r.file_id.rsplit("/", 1)[1], r.date_raw, r.description, r.debit, r.credit, r.balance) for r in out.collect())
    assert rows == [("one.csv", "01/02/2024", 'RENT, "MAY"\nsecond line', 1500.0, 0.0, 8500.0), ("two.csv", "02/02/2024", "CAFÉ", 0.0, 20.0, 30.0)]
    assert "Python" not in out._jdf.queryExecution().toString() and out.where(F.col("file_id").contains("bad")).count() == 0
