"""Every registered query plans without a pair-building join and answers."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
# Cheap ones from every group; tools/compare.py runs all of them.
CHECKED = [
    "pass_gate", "canonical_frame", "window_score", "state_compare", "overlap_anti", "estimates_view", "fold_expansion",
    "causal_last_n", "lock_edges", "debounce", "qualification_median", "quality_decision", "gps_epoch", "tle_guard",
    "parse_antennas", "track_lines", "oem_lines", "consider_covariance", "held_out_prediction", "profile_expansion",
    "group_expansion_sql", "angle_files", "measurement_files", "multi_pass_rows", "top_fraction_status", "phase_scan", "pass_information_one",
]
# One-row totals meet these two on purpose.
ONE_ROW = {"interval_orbit_score"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_operators_are_covered():
    from passledger.plans.registry import OPERATORS

    found = {o for text in OPERATORS.values() for o in text.split()}
    wanted = {f"{p}{i:02d}" for p, n in (("S", 26), ("F", 14), ("J", 20), ("A", 35), ("W", 12), ("T", 5), ("U", 4), ("X", 27), ("E", 16), ("R", 8), ("D", 4)) for i in range(1, n + 1)}
    assert wanted - found == set()


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = entry.queries()[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    if name not in ONE_ROW:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cursor = db.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == want
