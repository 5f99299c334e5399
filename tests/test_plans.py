"""What plans must not do: read and sort a ledger again for each part of a page, or sort words that only meet a page's few cuts."""

import __spark_entry__ as entry
from ledgerflow.plans import fixtures


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_ledger_is_sorted_once(spark, sf):
    assert _plan(fixtures.ledger(spark, sf)).count("Sort [") == 1


def test_table_rows_read_the_ledger_once(spark, sf):
    assert _plan(entry.queries()["src_14_table_rows"](spark, sf)).count("FileScan") == 1


def test_consensus_zones_rank_pages_not_words(spark):
    from ledgerflow.operators import discovery

    words = spark.createDataFrame([(1, 7, 1, "01-Jan-2024", 30.0, 90.0)], "file_id long, page_no int, word_seq long, text string, x0 double, x1 double")
    plan = discovery.consensus_zones(words)._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" not in plan and "LeftSemi" in plan


def test_words_meet_cuts_without_being_sorted(spark):
    from ledgerflow.operators import layout

    rows = [(0, "a", 0.0, 185.0), (1, "b", 170.0, 425.0), (2, "c", 425.0, 545.0)]
    words = spark.createDataFrame([(f, 0, k, t, 60.0 * k, 60.0 * k + 40) for f in (1, 2) for k, t in enumerate(["x", "1.00", "-", "7", "(2)", "a", "b", "3.00", "d", "e"])], "file_id long, page_no int, word_seq long, text string, x0 double, x1 double")
    cuts = spark.createDataFrame([(f, 0, *r) for f in (1, 2) for r in rows], "file_id long, page_no int, col_ord int, col_name string, x_left double, x_right double")
    for mode in ("left", "edge", "middle", "near", "overlap"):
        alike, own = layout.assign(words, rows, mode), layout.assign(words, cuts, mode)
        assert sorted(map(tuple, alike.collect())) == sorted(map(tuple, own.collect())) and alike.count()
        assert "Exchange" not in _plan(alike) and "SortMergeJoin" not in _plan(own) and "BroadcastHashJoin" not in _plan(own)


def test_zone_rows_are_not_sorted_again_by_island(spark, sf):
    plan = entry.queries()["lay_38_zone_rows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Sort [" in line and "_isle" in line]


def test_amount_lines_read_the_ledger_once_and_look_at_each_line_once(spark, sf):
    plan = _plan(entry.queries()["lay_36_amount_lines"](spark, sf))
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("regexp_extract") <= 6


def test_cells_read_the_ledger_once_for_words_and_header_and_are_grouped_once(spark, sf):
    plan = _plan(entry.queries()["lay_14_cells"](spark, sf))
    assert plan.count("FileScan") <= 3 and "Union" not in plan and plan.count("collect_list(") <= 2 * 2


def test_wide_cells_are_the_cells_side_by_side(spark):
    from ledgerflow.operators import layout

    rows = [(1, 0, k // 3, k, None if k == 4 else f"w{k}", float(-k % 5), ["a", "b", "other"][k % 4 % 3]) for k in range(14)]
    words = spark.createDataFrame(rows, "file_id long, page_no int, line_id int, word_seq long, text string, x0 double, col_name string")
    want, got = layout.wide(layout.cells_of(words), ["a", "b", "c"]), layout.wide_cells(words, ["a", "b", "c"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns and got.count() == 5
