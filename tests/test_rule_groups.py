"""Rules are passed over in groups, and the first rule that holds is still the one that counts."""

import random
import re

from ledgerflow.operators import rules
from pyspark.sql import functions as F


def test_groups_give_the_first_rule_that_holds(spark):
    random.seed(4)
    # References and flags keep their meaning: such patterns stand alone.
    patterns = [r"\bA\b", "B|C", r"D\s*E", r"(X)\1", "F(?!G)", "(?s)H.I", "J.*K", "AB|BA", "(C|D)F", r"\bGH", "K$", "^B"]
    table = [rules.Rule(f"r{k}", random.randrange(9), random.choice(["debit", "credit", "both"]), "c", 1.0, random.choice(patterns), random.choice([None, None, "A", "K"])) for k in range(40)]
    rows = [("".join(random.choice("ABCDEFGHIJKX x") for _ in range(random.randrange(9))), random.choice([0, 1]), random.choice([0, 1])) for _ in range(600)] + [("", 1, 1), (None, 1, 0), ("XX", 1, 1), ("xx", 0, 1)]
    df = spark.createDataFrame(rows, "t string, d int, c int")
    say = rules.Verdicts()
    number = rules.compile_rules(table, F.col("t"), F.col("d") != 0, F.col("c") != 0, say)
    out = df.withColumn("number", number)

    def first(t, d, c):
        for r in rules.in_order(table):
            if {"debit": d, "credit": c, "both": 1}[r.side] and t is not None and re.search(r.pattern, t, re.I) and not (r.exclude and re.search(r.exclude, t, re.I)):
                return r.rule_id
        return None

    got = [(r.t, r.d, r.c, r.number and say.said[r.number - 1][2]) for r in out.collect()]
    assert got == [(t, d, c, first(t, d, c)) for t, d, c in rows] and len({x[3] for x in got}) > 8
    assert "(?i)(?:" in out._jdf.queryExecution().optimizedPlan().toString()
