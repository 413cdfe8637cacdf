"""Sequential steps and streams fed file by file."""

import functools
import math
import shutil

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from passledger.plans import catalog, streams
from passledger.session import scratch_path
from passledger.streaming import acquisition as acq
from passledger.streaming import commands
from passledger.streaming import filters as flt
from passledger.streaming import runner
from passledger.streaming.runner import drain, replay, run_available, table_stream


def test_offset_filter_accepts_irregular_cadence():
    config, held = flt.OffsetFilterConfig(), None
    for second, value, count in ((0, 1.0, 1), (2, 1.1, 2), (5, 1.2, 3)):
        held, status, _ = flt.offset_step(held, "e", second * 10**6, value, 0.01, config)
        assert held[7] == count
    assert held[8] == 0 and held[1] == 5 * 10**6 and held[4] > 0


def test_offset_filter_rejects_outliers_without_counting():
    config = flt.OffsetFilterConfig()
    held, _, _ = flt.offset_step(None, "e", 0, 0.0, 0.01, config)
    held, _, _ = flt.offset_step(held, "e", 10**6, 0.01, 0.01, config)
    after, status, nis = flt.offset_step(held, "e", 2 * 10**6, 100.0, 0.01, config)
    assert status == "gated" and nis > 9 and after[7] == held[7] and abs(after[2]) < 1


def test_offset_filter_resets():
    config = flt.OffsetFilterConfig()
    held, _, _ = flt.offset_step(None, "e", 0, 1.0, 0.01, config)
    held, status, _ = flt.offset_step(held, "new", 10**6, 4.0, 0.01, config)
    assert status == "reset" and held[7] == 1 and held[2] == 4.0
    held, status, _ = flt.offset_step(held, "new", 30 * 10**6, 6.0, 0.01, config)
    assert status == "reset" and held[7] == 1 and held[2] == 6.0
    assert flt.offset_step(held, "new", 31 * 10**6, math.nan, 0.01, config)[1] == "invalid"


def test_doppler_step_matches_the_textbook_update():
    config = flt.DopplerFilterConfig(gate=None)
    x, p = np.zeros(3), np.diag(config.initial_variance)
    z, r, f, s = -2990.0, 4.0, -3000.0, -4.4
    got, cov, accepted, nis = flt.doppler_step(x, p, 10.0, (z, r, f, s), config)
    prior = p + np.diag(config.process_rates) * 10
    h = np.array([s, 1.0, f / config.centre_hz])
    spread = h @ prior @ h + r
    gain = prior @ h / spread
    assert accepted and got == pytest.approx(gain * (z - f))
    assert cov == pytest.approx(prior - np.outer(gain, h @ prior), abs=1e-6)
    assert nis == pytest.approx((z - f) ** 2 / spread)


def _sweep(steps, config, each=3):
    held, events = acq.Acquisition(), []
    for second, (offset, locked) in enumerate(s for s in steps for _ in range(each)):
        events += held.take(second * 10**6, offset, locked, config)
    return held, [(e[0], e[3]) for e in events if e[0] != "probe"], events


@pytest.mark.parametrize(
    "steps, last",
    [
        ([(0, False), (1, True), (2, True), (3, False), (1.5, True)], ("tracking", "")),
        ([(0, False), (1, True), (2, True), (3, False), (1.5, False)], ("reset", "middle_unlocked")),
        ([(0, True)], ("reset", "open_at_start")),
        ([(0, False), (1, False), (2, False), (3, False), (4, True)], ("reset", "no_window")),
        ([(0, False), (1, True), (2, True), (3, True), (4, False)], ("reset", "open_at_end")),
        ([(0, False), (1, True), (2, False), (1, True), (1, False)], ("reset", "lock_lost")),
    ],
)
def test_acquisition_paths(steps, last):
    held, seen, events = _sweep(steps, acq.AcquisitionConfig(sweep_points=4))
    assert seen[-1] == last
    if "middle" in last[1] or last[0] == "tracking":
        assert [e[1] for e in events if e[0] == "midpoint"] == [1.5]


def test_acquisition_stops_at_the_time_limit():
    _, seen, _ = _sweep([(0, False)] * 3, acq.AcquisitionConfig(time_limit_s=5.0))
    assert seen == [("reset", "time_over")]


def test_acquisition_count_restarts_on_change():
    held, seen = acq.Acquisition(), []
    for locked in (False, False, True, False, False, False):
        seen.append(len(held.take(0, 0.0, locked, acq.AcquisitionConfig())))
    assert seen == [0, 0, 0, 0, 0, 1]


@pytest.mark.parametrize(
    "changes, code",
    [
        (dict(model_version="x"), "version"), (dict(target_s=math.nan), "number"), (dict(converged=False), "unsettled"),
        (dict(samples=1), "unsettled"), (dict(variance=9.0), "variance"), (dict(nis=99.0), "innovation"), (dict(event_us=0), "age"),
        (dict(nis=None), "number"), (dict(), None),
    ],
)
def test_objections(spark, changes, code):
    row = dict(
        t_us=10**7, event_us=10**7, profile_version="profile-1", model_version="model-1", target_s=1.0, variance=0.1, nis=1.0,
        converged=True, samples=5,
    ) | changes
    schema = "t_us long, event_us long, profile_version string, model_version string, target_s double, variance double, nis double, converged boolean, samples long"
    assert spark.createDataFrame([tuple(row.values())], schema).select(acq.objection(acq.ControlConfig())).first()[0] == code


def test_control_starts_at_the_applied_offset():
    config = acq.ControlConfig(maximum_step_s=9.0, maximum_rate=9.0)
    loop, action, _, requested = acq.respond(None, 10**7, "e", None, 1.0, 0.9, config)
    assert action == "enable" and requested == 0.9
    loop, *answer = acq.respond(loop, 10**7 + 1, "e", None, 1.0, 0.9, config)
    assert answer == ["reject", "interval", None]
    loop, action, _, requested = acq.respond(loop, 2 * 10**7, "e", None, 1.0, 0.9, config)
    assert action == "dry_run" and requested == pytest.approx(0.9)
    assert acq.respond(loop, 3 * 10**7, "e", None, 1.0, 0.995, config)[1] == "hold"
    loop, *answer = acq.respond(loop, 4 * 10**7, "f", None, 1.0, 0.9, config)
    assert answer[1] == "ephemeris"
    assert acq.respond(loop, 5 * 10**7, "e", None, 1.0, 0.9, config)[2] == "broken"


def test_table_stream_reads_a_file_and_a_folder(spark):
    base = scratch_path(spark, "tables")
    rows = spark.range(1000)
    rows.repartition(4).write.parquet(f"{base}/events.parquet")
    rows.write.parquet(f"{base}/events2.parquet")
    assert drain(table_stream(spark, base, "events"), "folder").count() == 1000
    assert drain(table_stream(spark, "/root/testdata/sf0.001", "nation"), "file").count() == 25
    with pytest.raises(Exception):
        table_stream(spark, base, "event")


def _files(spark, batches, schema):
    path = scratch_path(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, batches, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_files(spark, batches, schema))


def _state_rows(query):
    return [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]


DOPPLER = "contact_id string, t_us long, sequence long, observed_hz double, variance_hz2 double, predicted_hz double, slope_hz_s double"


def test_rows_wait_for_the_watermark_and_late_ones_are_told(spark):
    def row(t, z=-3000.0, contact="c"):
        return (contact, t * 10**6, 0, z, 4.0, -3000.0, -4.0)

    batches = [[row(20), row(10), row(30)], [row(15), row(60), row(50, math.nan)], [row(12), row(70), row(55)], [row(200, contact="other")]]
    path = scratch_path(spark, "live")
    live = flt.doppler_filter(_stream(spark, batches, DOPPLER), lateness="8 seconds", idle_s=60.0)
    query = run_available(live, path)
    rows = spark.read.parquet(path).collect()
    # 15 comes behind 20 in the file but before the watermark has passed 20; 12 comes when 20 is out.
    assert [(r.t_us // 10**6, r.status) for r in sorted(rows, key=lambda r: (r.t_us, r.status))] == [
        (10, "accepted"), (12, "late"), (15, "accepted"), (20, "accepted"), (30, "accepted"), (50, "invalid"), (55, "accepted"), (60, "accepted"), (70, "accepted"),
    ]
    table = [row(t) for t in (10, 15, 20, 30, 55, 60, 70)] + [row(50, math.nan)]
    want = {r.t_us: r for r in flt.doppler_filter(spark.createDataFrame(table, DOPPLER)).collect()}
    for r in rows:
        assert r.status == "late" and r.time_offset_s is None or r == want[r.t_us]
    # What is left is the row of the other contact: c was silent for a minute.
    assert max(_state_rows(query)) > 1 and _state_rows(query)[-1] == 1


def test_replay_empties_the_state(spark):
    batches = [[("c", t * 10**6, 0, -3000.0, 4.0, -3000.0, -4.0) for t in part] for part in ((5, 1, 9), (2, 7), (8, 3, 3))]
    stream = _stream(spark, batches, DOPPLER)
    seen = []

    def build(rows):
        seen.append(flt.doppler_filter(rows, lateness="1 hour"))
        return seen[-1]

    got = replay(stream, build, "replayed").collect()
    assert sorted(r.t_us // 10**6 for r in got) == [1, 2, 3, 3, 5, 7, 8, 9] and {r.status for r in got} == {"accepted"}
    table = spark.createDataFrame([r for part in batches for r in part], DOPPLER)
    assert sorted(map(repr, got)) == sorted(map(repr, flt.doppler_filter(table).collect()))


def test_polynomial_and_its_slope():
    nodes, values = [-3.0, -1.0, 0.5, 2.0], np.array([1.0, 4.0, -2.0, 0.5])
    divided, level = [values[0]], values
    for order in range(1, 4):
        level = (level[1:] - level[:-1]) / (np.array(nodes)[order:] - np.array(nodes)[:-order])
        divided.append(level[0])
    poly = np.polynomial.Polynomial.fit(nodes, values, 3)
    for shift in (-3.0, 0.0, 1.3, 4.0):
        value, slope = flt.along(nodes, divided, shift)
        assert value == pytest.approx(poly(shift)) and slope == pytest.approx(poly.deriv()(shift))


def test_bent_prediction_finds_an_offset_of_seconds(spark):
    """A straight line at zero offset misses what the polynomial at the offset finds."""
    rate, true = 1 / 60, 4.0
    nodes = [5.0 * k - 17.5 for k in range(8)]
    rows = []
    for k in range(60):
        t = 3.0 * k
        values, divided = 8000 * np.cos((t + np.array(nodes)) * rate), []
        for order in range(8):
            divided.append(float(values[0]))
            values = (values[1:] - values[:-1]) / (np.array(nodes)[order + 1 :] - np.array(nodes)[: -order - 1])
        rows.append(("c", int(t * 1e6), k, 8000 * math.cos((t + true) * rate), 1.0, nodes, divided, 8000 * math.cos(t * rate), -8000 * rate * math.sin(t * rate)))
    frame = spark.createDataFrame(
        rows, "contact_id string, t_us long, sequence long, observed_hz double, variance_hz2 double, node_s array<double>, node_hz array<double>, predicted_hz double, slope_hz_s double"
    )
    config = flt.DopplerFilterConfig(gate=None, process_rates=(1e-9, 1e-9, 0.0), initial_variance=(25.0, 1.0, 1e-6))
    x, p, before = np.zeros(3), np.diag(config.initial_variance), 0.0
    for k in range(60):  # the same filter with the orbit in closed form
        t = 3.0 * k
        p = p + np.diag(config.process_rates) * (t - before)
        value, slope = 8000 * math.cos((t + x[0]) * rate), -8000 * rate * math.sin((t + x[0]) * rate)
        ratio = (config.centre_hz + x[2]) / config.centre_hz
        h = np.array([slope * ratio, 1.0, value / config.centre_hz])
        gain = p @ h / (h @ p @ h + 1.0)
        x = x + gain * (8000 * math.cos((t + true) * rate) - value * ratio - x[1])
        keep = np.eye(3) - np.outer(gain, h)
        p, before = keep @ p @ keep.T + np.outer(gain, gain), t
    last = lambda f: f.orderBy(F.desc("t_us")).first().time_offset_s
    assert last(flt.doppler_filter(frame, config)) == pytest.approx(x[0], abs=1e-6) and abs(x[0] - true) < 0.05
    assert abs(last(flt.doppler_filter(frame.drop("node_s", "node_hz"), config)) - x[0]) > 0.02


@pytest.mark.parametrize("once", [True, False])
def test_confirmation_and_timeout(spark, once):
    issued = [[(i, i * 10**6, float(i)) for i in range(6)], [(99, 500 * 10**6, 0.0)], []]
    read = [
        # The readback of 5 comes before its command does, that of 4 at its deadline, that of 7 without any.
        [(0, 1, 0, 0.0, 1), (0, 2, 0, 0.0, 2), (1, 2, 0, 1.0, 1), (2, 3, 0, 9.0, 1), (5, 6, 0, 5.0, 1), (7, 8, 0, 7.0, 1)],
        [(3, 4, 60, 3.0, 1), (4, 34, 0, 4.0, 1), (99, 501, 0, 0.0, 1), (3, 40, 0, 3.0, 2)],
    ]
    c = _stream(spark, [issued[0][:5], issued[0][5:] + issued[1]], "command_id long, issued_us long, requested_s double")
    b = _stream(spark, read, "effective_command_id long, second long, age long, applied_s double, line long")
    second = F.col("second") * 10**6
    b = b.select("effective_command_id", second.alias("observed_us"), second.alias("event_us"), (second + F.col("age") * 10**6).alias("arrived_us"), "applied_s", "line")
    told = replay(commands.exchanges(c, b), lambda rows: commands.confirmed(rows, timeout_s=30, lateness="100 seconds", once=once), "told")
    got = {(r.command_id, r.event, r.line) for r in told.collect()}
    # Wrong value, stale, too late and absent readbacks do not confirm.
    assert {g for g in got if g[1] == "confirmation_timeout"} == {(2, "confirmation_timeout", None), (3, "confirmation_timeout", None)}
    both = {(0, 1), (1, 1), (4, 1), (5, 1), (99, 1)} | (set() if once else {(0, 2)})
    assert {(k, line) for k, event, line in got if event == "confirmed"} == both
    assert (7, "unmatched", 1) in got


def test_exchange_state_is_the_open_commands(spark):
    c = _stream(spark, [[(i, i * 10**6, 0.0) for i in range(50)], [(90, 200 * 10**6, 0.0)], [(91, 210 * 10**6, 0.0)]], "command_id long, issued_us long, requested_s double")
    b = _stream(spark, [[(i, 50 * 10**6, 50 * 10**6, 50 * 10**6, 0.0, 1) for i in range(25)]], "effective_command_id long, observed_us long, event_us long, arrived_us long, applied_s double, line long")
    path = scratch_path(spark, "open")
    query = run_available(commands.confirmed(commands.exchanges(c, b), timeout_s=60, lateness="1 second"), path)
    # The confirmed are gone at once, the others at their deadlines; two are open.
    assert _state_rows(query)[0] == 25 and _state_rows(query)[-1] == 2
    assert spark.read.parquet(path).groupBy("event").count().collect().__len__() == 2


@pytest.fixture(scope="module")
def dealt_events(spark, tmp_path_factory):
    """The events as one file, and as part files without any order in time."""
    one, many = (tmp_path_factory.mktemp(n) for n in ("one", "many"))
    shutil.copy("/root/testdata/sf0.001/events.parquet", one / "events.parquet")
    rows = spark.read.parquet(str(one / "events.parquet"))
    rows.repartition(3, F.xxhash64("event_id")).write.parquet(str(many / "events.parquet"))
    return str(one), str(many)


@pytest.mark.parametrize("name", ["doppler_filter", "offset_filter", "lock_acquisition", "control_decisions"])
def test_batch_cuts_do_not_matter(spark, monkeypatch, dealt_events, name):
    one, many = dealt_events
    want = catalog.QUERIES[name](spark, one).collect()
    monkeypatch.setattr(streams, "table_stream", functools.partial(table_stream, files=1))
    got = catalog.QUERIES[name](spark, many).collect()
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))


def test_answers_are_joined_without_a_call_for_each_command(spark):
    """Some 3,000 commands over three files a side: as the processor tells them, by Spark's join of streams."""
    times = [[(i, (60 + i) * 10**6, i % 10 / 4) for i in range(k, 3_000, 3)] for k in range(3)]
    c = _stream(spark, times, "command_id long, issued_us long, requested_s double")
    reads = [[(i, (60 + i + i % 40) * 10**6, i % 10 / 4 + (i % 7 == 0), line) for i in range(k, 3_100, 3) for line in (1, 2)] for k in (2, 0, 1)]
    b = _stream(spark, reads, "effective_command_id long, observed_us long, applied_s double, line long")
    b = b.withColumns({"event_us": F.col("observed_us"), "arrived_us": F.col("observed_us") + F.col("effective_command_id") % 7 * 10**6})
    rows = commands.exchanges(c, b)
    told = [replay(rows, lambda r: build(r, timeout_s=30, lateness="3200 seconds"), "told") for build in (functools.partial(commands.confirmed, once=False), commands.answered)]
    want, got = [sorted(map(repr, t.select(told[0].columns).where("event <> 'unmatched'").collect())) for t in told]
    assert got == want and any("confirmed" in g for g in got) and any("timeout" in g for g in got)
    path = scratch_path(spark, "answered")
    progress = run_available(commands.answered(rows, timeout_s=30, lateness="3200 seconds"), path).recentProgress
    assert {o.operatorName for p in progress for o in p.stateOperators} == {"symmetricHashJoin"}


def test_a_short_key_costs_few_calls_of_its_state(spark):
    calls, held = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def made(*values):
                calls.append(f"{self.name}.{call}")
                if call in ("appendValue", "put", "update"):
                    held.setdefault(self.name, []).extend(values)
                return held.get(self.name, []) if self.name == "waiting" else None

            return made

    class Handle(State):
        getListState = getValueState = staticmethod(lambda name, _: State(name))

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    schema = spark.createDataFrame([], DOPPLER).drop("contact_id").schema
    processor = runner.InOrder(schema, "x double", "t_us long", lambda *_: ([], None), lambda *_: [], 60.0)
    processor.init(Handle("handle"))
    rows = [Row(*schema.names)(t * 10**6, 0, None, 4.0, -3000.0, -4.0) for t in range(50)]
    assert list(processor.handleInputRows(("c",), iter(rows), Now())) == []
    assert len(calls) <= 4 and len(held["waiting"]) == 1
    assert held["waiting"][0][0] == [r.t_us for r in rows] and math.isnan(held["waiting"][0][2][0])
