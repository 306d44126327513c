"""Registered queries against their comparison SQL, at the smallest scale.

A spread of queries runs by default; TIDEWATCH_ALL=1 runs every one.
"""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
DEFAULT = [
    "flagship_rule_to_records", "p17_evidence", "b3_previous_period", "b9_null_entity_is_a_group", "a3_match_merge", "a12_run_group_members", "a13_unique_group_times",
    "a19_first_wins_submission", "a20_sql_recheck", "m7_mentions", "d9_stale_leases", "d14_timeout_mentions", "r9_overview_counters", "r16_timeout_status",
    "w6_five_tables_in_one_job", "w9_before_image_check", "w13_late_events_miss_closed_windows", "w14_latest_window_zero_filled", "w21_json_lines", "s6_typed_rows",
]
CHOSEN = registry.own() if os.environ.get("TIDEWATCH_ALL") else DEFAULT


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else repr(float(value))
    return str(value)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def test_every_query_has_comparison_sql():
    """The queries of this library; those on training data have tests of their own."""
    assert set(registry.own()) <= set(SQL)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, database, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = database.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in result.fetchall())
    assert ours == theirs
