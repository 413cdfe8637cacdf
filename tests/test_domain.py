"""Edge cases of selection, planning, scoring, sequences and study rules."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from passledger.operators import planning, scoring, selectors, sequences, study
from passledger.plans import catalog
from passledger.sources import gps, measurements, oem, products

NAN, INF = float("nan"), float("inf")


def _telemetry(spark, rows):
    return spark.createDataFrame(
        rows, "id int, carrier_lock string, doppler_hz double, ebn0 double, elevation_deg double"
    )


def test_selectors_at_their_thresholds(spark):
    frame = _telemetry(
        spark,
        [
            (1, "Locked", 10.0, 3.0, 20.0), (2, "Locked", NAN, 9.0, 20.0), (3, "Locked", None, 9.0, 20.0),
            (4, "Unlocked", 10.0, 9.0, 20.0), (5, "Locked", 100000.0, 9.0, 20.0), (6, "Locked", 10.0, NAN, 20.0),
            (7, "Locked", 10.0, 5.0, 1.0), (8, None, 0.1, 9.0, 89.0), (9, "Locked", INF, 9.0, 20.0),
            (10, "Locked", 0.05, 5.01, 88.9),
        ],
    )

    def kept(rule):
        return {r.id for r in frame.where(rule).collect()}

    assert kept(selectors.locked_finite()) == {1, 5, 6, 7, 10}
    assert kept(selectors.QualityRule().column()) == {1, 7, 10}
    assert kept(selectors.strict()) == {5, 10}
    assert kept(selectors.timing()) == {1, 4, 5, 6}


def test_selector_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        selectors.QualityRule(least_ebn0_db=NAN)
    with pytest.raises(ValueError):
        selectors.QualityRule(offset_below_hz=-1.0)
    with pytest.raises(ValueError):
        selectors.gate_reason(0)


def _passes(spark, n, craft="V"):
    return spark.createDataFrame(
        [(f"P{i:02d}", craft, i * 1000, i * 1000 + 500, ) for i in range(n)],
        "contact_id string, spacecraft_id string, start_us long, stop_us long",
    )


def test_fold_counts(spark):
    folds = planning.fold_expansion(planning.pass_order(_passes(spark, 4))).collect()
    # Per method: 4 full fits and 2 + 3 + 4 omissions.
    assert len(folds) == 2 * (4 + 9)
    first = [f for f in folds if f.prefix_count == 1]
    assert len(first) == 2 and all(f.holdout_id is None and f.training_count == 1 for f in first)


def test_group_counts(spark):
    passes = _passes(spark, 5)
    plan = planning.group_expansion(passes, passes.where("contact_id <> 'P00'"))
    count = {(r.method, r.strategy): r["count"] for r in plan.groupBy("method", "strategy").count().collect()}
    assert count == {
        ("timing", "single"): 5, ("timing", "cumulative"): 5, ("sgp4_L+n", "rolling"): 2,
        ("sgp4_L+n", "cumulative"): 4, ("full_state", "cumulative"): 4,
    }


def test_causal_groups_never_look_ahead(spark):
    passes = _passes(spark, 6)
    groups = planning.causal_groups(passes.where("contact_id <> 'P02'"), passes, (1, 3)).collect()
    by = {(g.anchor_id, g["size"]): g for g in groups}
    assert by["P04", 3].contact_ids == ["P01", "P03", "P04"] and by["P04", 3].status == "ready"
    assert by["P01", 3].status == "warm_up" and by["P01", 3].contact_ids == ["P00", "P01"]
    assert by["P02", 1].status == "screening_failed" and by["P02", 1].contact_ids == []


def _history(spark, times):
    return spark.createDataFrame(
        [(1, "fitted", t * 1_000_000, 3.0, 4.0, 0.0, 0.0, 0.0, 1.0) for t in times],
        "fit_id int, solution string, t_us long, dx_m double, dy_m double, dz_m double, dvx_m_s double, dvy_m_s double, dvz_m_s double",
    )


@pytest.mark.parametrize(
    "times, coverage",
    [
        (range(0, 7200, 60), "complete"),
        (range(1200, 7200, 60), "partial"),
        (range(0, 4000, 60), "partial"),
        ([t for t in range(0, 7200, 60) if not 2400 < t < 2700], "partial"),
        (range(6000, 7200, 60), "unavailable"),
    ],
)
def test_window_coverage(spark, times, coverage):
    windows = spark.createDataFrame([(1, "fitted", 900_000_000, 4_500_000_000)], "fit_id int, solution string, start_us long, stop_us long")
    row = scoring.window_score(_history(spark, times), windows, ["fit_id", "solution"], bucket_us=600_000_000).first()
    assert row.coverage == coverage
    assert (row.position_rmse_m == pytest.approx(5.0)) if coverage == "complete" else row.position_rmse_m is None


def test_qualification_with_failures(spark):
    rows = [
        ("a", True, True, 1.0, "complete"), ("a", True, True, 3.0, "complete"), ("a", False, True, None, "complete"),
        ("b", False, True, None, "complete"), ("b", True, False, 1.0, "complete"), ("b", True, True, 1.0, "complete"),
        ("c", True, True, 1.0, "partial"), ("d", True, True, None, "complete"),
    ]
    frame = spark.createDataFrame(rows, "k string, success boolean, accepted boolean, position_rmse_km double, coverage string")
    got = {r.k: (r.median_km, r.status) for r in study.qualification(frame, ["k"]).collect()}
    assert got["a"] == (3.0, "available")
    assert got["b"] == (None, "not_attained")
    assert got["c"] == (None, "uncovered")
    assert got["d"] == (None, "unscored")


def test_population_keeps_non_attaining_members(spark):
    rows = [("m", 2.0, h, h is not None and h <= 8, h is not None and h <= 16, h is not None) for h in (4.0, 12.0, None, None)]
    events = spark.createDataFrame(
        rows, "method string, threshold_km double, first_attainment_hours double, attained_by_8h boolean, attained_by_16h boolean, attained_by_24h boolean"
    )
    row = study.population_attainment(events).first()
    assert (row.spacecraft_count, row.attained_count, row.fifty_percent_hours) == (4, 2, 12.0)
    late = study.population_attainment(events.where("first_attainment_hours IS NULL OR first_attainment_hours > 5")).first()
    assert late.fifty_percent_hours is None


def test_debounce_restarts_after_a_probe(spark):
    word = "LLLLLULLLUU"
    rows = spark.createDataFrame([("c", i, x) for i, x in enumerate(word)], "k string, i long, v string")
    out = sequences.debounce(rows, ["k"], ["i"], F.floor(F.col("i") / 4).cast("long"), "v", 2)
    run, want = 0, []
    for i, x in enumerate(word):
        run = run + 1 if i and run and word[i - 1] == x else 1
        if run == 2:
            want.append(i)
            run = 0
    assert sorted(r.i for r in out.collect()) == want


@pytest.mark.parametrize(
    "locks, status, midpoint",
    [("0110", "lock_window_midpoint", 1.5), ("1100", "open_at_start", None), ("0011", "open_at_end", None), ("0000", "no_lock_window", None)],
)
def test_lock_edges(spark, locks, status, midpoint):
    probes = spark.createDataFrame([("s", i, float(i), x == "1") for i, x in enumerate(locks)], "s string, probe_index long, offset_s double, locked boolean")
    row = sequences.lock_edges(probes, ["s"]).first()
    assert (row.status, row.midpoint_s) == (status, midpoint)


def test_coverage_check_finds_holes(spark):
    rows = [("a", 1, 0, 50), ("a", 2, 40, 100), ("b", 1, 0, 50), ("b", 2, 60, 100), ("c", 1, 0, 90), ("d", 1, 10, 100)]
    frame = spark.createDataFrame(rows, "k string, segment int, first_us long, last_us long")
    got = {r.k: r.covered for r in sequences.coverage_check(frame, ["k"], 5, 100, bucket_us=30).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_measurement_columns_are_required(spark):
    with pytest.raises(ValueError, match="missing columns"):
        measurements.canonical_measurements(spark.createDataFrame([(1,)], "contact_id int"))
    with pytest.raises(ValueError, match="identifier"):
        measurements.contact_scan(spark.createDataFrame([(1,)], "a int"), "c", F.lit(0), F.lit(1), ["a; drop"], order_by="a")


def test_gps_column_choice():
    assert gps.export_columns(["Time", "x_bestxyz_x_pos_f.m"], {"x": "bestxyz_x_pos_f."}) == {"x": "x_bestxyz_x_pos_f.m"}
    with pytest.raises(ValueError):
        gps.export_columns(["a1", "a2"], {"a": "a"})


def _message(*extra, frame="EME2000"):
    head = ["CCSDS_OEM_VERS = 2.0", "ORIGINATOR = X", *extra, "META_START", "CENTER_NAME = Earth", f"REF_FRAME = {frame}", "TIME_SYSTEM = UTC", "META_STOP"]
    return [*head, "2026-05-04T00:00:00.000 6800 0 0 0 7.5 0", "COMMENT x", "2026-05-04T00:01:00 6800 1 0 0 7.5"]


def test_oem_ingest(spark):
    rows = []
    for name, lines in (("good", _message()), ("twice", _message("ORIGINATOR = Y")), ("frame", _message(frame="MARS"))):
        rows += [(name, i + 1, text) for i, text in enumerate(lines)]
    classified = oem.classify(spark.createDataFrame(rows, "file string, line_no long, text string"))
    found = {r.file: r.findings for r in oem.message_findings(classified).collect()}
    assert found == {"good": "", "twice": "duplicate keyword", "frame": "unsupported reference frame"}
    states = oem.states(classified).where("file = 'good'").orderBy("line_no").collect()
    assert states[0].x == 6800e3 and states[0].vy == 7500.0 and states[0].t_us == 1777852800000000
    assert states[0].reason == "" and states[1].reason != ""


def test_resume_skips_finished_attempts(spark):
    planned = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "run string, digest string")
    finished = spark.createDataFrame([("a", "1"), ("b", "other")], "run string, digest string")
    assert {r.run for r in products.pending_attempts(planned, finished, ["run", "digest"]).collect()} == {"b", "c"}


def test_quality_reasons(spark):
    fits = spark.createDataFrame(
        [(1, 2, 2, 10, 5.0, "", 1, False, True), (2, 1, 2, 0, None, "", 1, True, False), (3, None, None, None, None, "no replay", 2, False, True)],
        "fit_id int, rank int, parameter_count int, degrees_of_freedom int, condition_number double, diagnostic_reason string, requested_passes int, active_bounds boolean, success boolean",
    )
    samples = spark.createDataFrame([(1, "a", 300), (2, "a", 10), (3, "a", 300)], "fit_id int, contact_id string, retained long")
    got = {r.fit_id: r for r in study.quality_decision(fits, samples).collect()}
    assert got[1].quality_accepted and got[1].rejection_reasons == ""
    assert got[2].rejection_reasons == (
        "rank; no_freedom; fewer than 250 retained samples per fit; at_a_bound; fit/preparation unsuccessful"
    )
    assert got[3].rejection_reasons == "no replay; no_counts"


def test_moments(spark):
    row = _history(spark, range(3)).agg(*scoring.error_moments(scoring.POSITION, "position", "m")).first()
    assert row.position_rmse_m == 5.0 and row.position_variance_m2 == 0.0 and math.isclose(row.dx_m_mean, 3.0)


def test_message_lines_keep_their_numbers_across_splits(spark, tmp_path):
    texts = {f"m{i}.oem": [f"{i}-{k} = {'x' * (k % 50)}" for k in range(400 * i + 3)] for i in range(4)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\r\n".join(lines) if name == "m2.oem" else "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 12
        got = {(r.file.rsplit("/", 1)[1], r.line_no): r.text for r in oem.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, k + 1): line for name, lines in texts.items() for k, line in enumerate(lines)}


def test_file_digests_read_in_pieces(spark, tmp_path):
    contents = {"one": b"x", "many": bytes(range(256)) * 9_000, "odd name.txt": "é".encode() * 4_001}
    (tmp_path / "below").mkdir()
    for i, (name, content) in enumerate(contents.items()):
        (tmp_path / ("below" if i % 2 else ".") / name).write_bytes(content)
    got = {r["name"]: (r["sha256"], r["byte_count"]) for r in products.file_digests(spark, str(tmp_path), piece=1_000).collect()}
    assert got == {name: (hashlib.sha256(c).hexdigest(), len(c)) for name, c in contents.items()}


def test_rows_of_requested_contacts(spark):
    rows = [(3, "b", "S", "Y"), (1, "a", "S", "Y"), (2, "a", "S", "Y"), (5, "d", "S", "Z")]
    samples = spark.createDataFrame(rows, "ts_us long, contact_id string, spacecraft_id string, system_id string")
    contacts = spark.createDataFrame([(c, "S", "Y") for c in "abcd"], "contact_id string, spacecraft_id string, system_id string")

    def load(ids, **options):
        requests = spark.createDataFrame(list(enumerate(ids)), "ordinal int, contact_id string")
        return [(r.ordinal, r.contact_id, r.ts_us) for r in measurements.load_rows(requests, contacts, samples, **options).collect()]

    assert load("ba") == [(0, "b", 3), (1, "a", 1), (1, "a", 2)] and load("aa") == [(0, "a", 1), (0, "a", 2), (1, "a", 1), (1, "a", 2)]
    assert load("acb", allow_empty=True) == [(0, "a", 1), (0, "a", 2), (2, "b", 3)]
    for ids, code in (("ac", "no_samples"), ("ax", "unknown_contact"), ("ad", "system_mismatch"), (["a", " "], "blank_id")):
        with pytest.raises(ValueError, match=code):
            load(ids)
    assert load(["d", "x", "c", "b"], strict=False) == [(3, "b", 3)]


def test_plan_by_table_function(spark):
    planning.register_table_functions(spark)
    rows = [("A", f"c{k}", 10 * k, 10 * (9 - k) + 5) for k in range(6)] + [("B", "d", 1, 2)]
    passes = spark.createDataFrame(rows, "spacecraft_id string, contact_id string, start_us long, stop_us long").repartition(5)
    passes.createOrReplaceTempView("few_passes")
    columns = ["spacecraft_id", "method", "strategy", "family_rank", "first_ordinal", "last_ordinal", "pass_count", "last_contact_id", "checkpoint_us"]
    want = {tuple(r) for r in planning.group_expansion(passes, passes).select(*columns).collect()}
    found = [tuple(r) for r in spark.sql("SELECT * FROM plan_groups(TABLE(few_passes))").select(*columns).collect()]
    assert set(found) == want and len(found) == len(want)
    with pytest.raises(Exception, match="stop_us"):
        spark.sql("SELECT * FROM plan_groups(TABLE(SELECT 'A' AS spacecraft_id, 'c' AS contact_id, 1L AS start_us))").collect()


def test_status_of_selected_groups(spark):
    rows = [(1, "a", 5, 6, 1.0), (1, "b", 6, 6, 2.0), (2, "c", 7, 5, 1.0), (2, "d", 8, None, 1.0)]
    frame = spark.createDataFrame(rows, "fit_id int, contact_id string, stop_us long, rank int, trace double")
    got = planning.fraction_status(planning.top_fraction(frame, ["fit_id"], "trace", 0.5), ["fit_id"])
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1, 0, 0, "ready"), (2, 2, 0, 1, 1, "selection_failed")}


@pytest.fixture(scope="module")
def many_customers(spark, tmp_path_factory):
    """The orders of sf0.001, and again with customers and orders as in a table sixty times sf0.1."""
    folder = str(tmp_path_factory.mktemp("customers"))
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    moved = orders.withColumns({"o_custkey": F.col("o_custkey") + 899_000, "o_orderkey": F.col("o_orderkey") + 36_000_000})
    orders.unionByName(moved).write.parquet(folder + "/orders.parquet")
    return folder


def _as_its_sql(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    want = duck.execute(catalog.CHECKS[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_catalogue_numbers_of_many_customers(spark, many_customers):
    _as_its_sql(spark, many_customers, "parse_spacecraft")


def test_identities_of_many_customers(spark, many_customers):
    _as_its_sql(spark, many_customers, "ephemeris_identity")
