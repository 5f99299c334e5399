"""Spark against DuckDB on the smallest tables: some queries of each family, or with ``ALL_SQL=1`` all that have SQL but those of
training-data operators, which takes some eleven minutes."""

import math
import os

import __spark_entry__ as entry
import duckdb
import pytest
from ledgerflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "cash_flow_summary", "chn_01_balance_audit", "chn_09_swap_and_snap", "chn_12_flip_in_segments", "chn_16_insert_chain_adjustments", "scl_m03_money_ledger", "scl_d1_smart_date", "scl_t06_entity", "cls_10_tax_tree", "jon_01_merge_results",
    "agg_04_validate_totals", "snk_08_metric_sheet", "ord_06_nearest_totals", "src_07_project_rows", "lay_14_cells", "lay_29_merge_lines",
    "lay_18_bank_of", "lay_19_guarded_bank", "lay_27_bank_noise", "lay_28_guarded_dates", "lay_45_profile_fields", "lay_14_header_cuts", "lay_11_pick_number",
    "src_13_printed_layouts", "src_14_table_rows", "scl_t08_repair_fields", "lay_15_judged_cuts", "lay_16_consensus_zones", "lay_17_discovered_columns", "lay_41_split_totals", "lay_41_compact_fields", "lay_42_footer_fields", "lay_09_mended_cells", "lay_36_amount_lines", "lay_38_zone_rows", "src_02_quoted_cells",
]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 4) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL) if os.environ.get("ALL_SQL") else NAMES)
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert mine == sorted((tuple(map(plain, r)) for r in want), key=str) and mine


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150
