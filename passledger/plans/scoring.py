"""Queries for state comparison and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.operators import joins, scoring
from passledger.plans.registry import query
from passledger.plans.rounding import r, rd
from passledger.plans.standins import DAY_US, HOUR_US, MINUTE_US, ORIGIN_US, Tables

_P2 = "(dx_m*dx_m + dy_m*dy_m + dz_m*dz_m)"
_V2 = "(dvx_m_s*dvx_m_s + dvy_m_s*dvy_m_s + dvz_m_s*dvz_m_s)"


def _side(t: Tables, solution: str) -> DataFrame:
    """Mean state error per object, segment and epoch: one row per key."""
    return (
        t.state_errors.where(F.col("solution") == solution)
        .groupBy(F.col("fit_id").alias("object_id"), "segment", "t_us")
        .agg(F.avg("dx_m").alias("x"), F.avg("dy_m").alias("y"), F.avg("dvx_m_s").alias("vx"))
    )


@query(
    "state_compare",
    "J05",
    f"""
    WITH @state_errors, m AS (SELECT fit_id AS object_id, segment, t_us, solution, avg(dx_m) AS x, avg(dy_m) AS y, avg(dvx_m_s) AS vx
        FROM state_errors GROUP BY ALL),
    p AS (SELECT * FROM m WHERE solution = 'fitted'), q AS (SELECT * FROM m WHERE solution = 'source')
    SELECT object_id, segment, t_us, {rd('p.x - q.x')} AS dx, {rd('p.y - q.y')} AS dy, {rd('p.vx - q.vx')} AS dvx,
      p.x IS NULL OR q.x IS NULL AS unmatched FROM p FULL JOIN q USING (object_id, segment, t_us)""",
)
def state_compare(t: Tables) -> DataFrame:
    out = joins.compare_states(_side(t, "fitted"), _side(t, "source"), ["x", "y", "vx"])
    return out.select(
        "object_id", "segment", "t_us", r("dx").alias("dx"), r("dy").alias("dy"),
        r("dvx").alias("dvx"), "unmatched",
    )


@query(
    "same_samples",
    "J06",
    """
    WITH @state_errors, k AS (SELECT fit_id, segment, t_us, count(DISTINCT solution) AS n,
       max(CASE solution WHEN 'source' THEN 1 ELSE 0 END) AS s, max(CASE solution WHEN 'prior' THEN 1 ELSE 0 END) AS p,
       max(CASE solution WHEN 'fitted' THEN 1 ELSE 0 END) AS f FROM state_errors GROUP BY 1, 2, 3)
    SELECT fit_id, count(*) AS sample_keys, count(*) FILTER (s = 0) AS missing_source, count(*) FILTER (p = 0) AS missing_prior,
      count(*) FILTER (f = 0) AS missing_fitted, bool_and(n = 3) AS identical FROM k GROUP BY fit_id""",
)
def same_samples(t: Tables) -> DataFrame:
    return joins.same_samples(t.state_errors, ["fit_id"], ["source", "prior", "fitted"])


_START, _STOP = ORIGIN_US + 3 * HOUR_US, ORIGIN_US + 4 * HOUR_US
_COVER = f"""
    tt AS (SELECT DISTINCT fit_id, solution, t_us FROM state_errors),
    g AS (SELECT *, t_us - lag(t_us) OVER w AS gap, lag(t_us) OVER w AS prev FROM tt WINDOW w AS (PARTITION BY fit_id, solution ORDER BY t_us)),
    e AS (SELECT fit_id, solution, min(t_us) AS low, max(t_us) AS high, median(gap) AS cadence_us,
        count(*) FILTER (t_us BETWEEN {_START} AND {_STOP}) AS window_times,
        min(t_us) FILTER (t_us BETWEEN {_START} AND {_STOP}) AS f, max(t_us) FILTER (t_us BETWEEN {_START} AND {_STOP}) AS l,
        max(gap) FILTER (t_us BETWEEN {_START} AND {_STOP} AND prev >= {_START}) AS widest FROM g GROUP BY 1, 2),
    c AS (SELECT fit_id, solution, window_times, CAST(cadence_us AS DOUBLE) AS cadence_us,
        coalesce(window_times >= 2 AND low <= {_START} + 1 AND high >= {_STOP} - 1 AND f < {_START} + cadence_us
          AND l > {_STOP} - cadence_us AND widest <= cadence_us * 1.5, false) AS complete FROM e)"""


def _windows(t: Tables) -> DataFrame:
    return (
        t.state_errors.select("fit_id", "solution")
        .distinct()
        .withColumn("start_us", F.lit(_START))
        .withColumn("stop_us", F.lit(_STOP))
    )


@query(
    "hour_coverage",
    "A06",
    f"WITH @state_errors, {_COVER} SELECT fit_id, solution, window_times, cadence_us, complete FROM c",
)
def hour_coverage(t: Tables) -> DataFrame:
    out = scoring.hour_coverage(
        t.state_errors, _windows(t), ["fit_id", "solution"], bucket_us=HOUR_US
    )
    return out.drop("start_us", "stop_us")


def _score_check(after: str) -> str:
    shown = [
        ("position_rmse_m", f"sqrt(avg({_P2}))", 6),
        ("position_mean_m", f"avg(sqrt({_P2}))", 6),
        ("position_variance_m2", f"var_pop(sqrt({_P2}))", 5),
        ("velocity_rmse_m_s", f"sqrt(avg({_V2}))", 6),
        ("dx_m_mean", "avg(dx_m)", 6),
        ("dx_m_variance", "var_pop(dx_m)", 5),
    ]
    inner = ", ".join(f"{sql} AS {n}" for n, sql, _ in shown)
    outer = ", ".join(
        f"CASE WHEN complete THEN {rd(n, d)} END AS {n}" for n, _, d in shown
    )
    return f"""
    WITH @state_errors, {_COVER}, s AS (SELECT fit_id, solution, count(*) AS sample_count, min(t_us) AS first_sample_us,
       max(t_us) AS last_sample_us, {inner} FROM state_errors WHERE t_us {after} {_START} AND t_us <= {_STOP} GROUP BY 1, 2)
    SELECT c.fit_id, c.solution, coalesce(sample_count, 0) AS sample_count,
      CASE WHEN sample_count IS NULL THEN 'unavailable' WHEN complete THEN 'complete' ELSE 'partial' END AS coverage,
      first_sample_us, last_sample_us,
      CASE WHEN complete THEN '' ELSE 'hour_uncovered' END AS reason, {outer}
    FROM c LEFT JOIN s ON s.fit_id = c.fit_id AND s.solution = c.solution"""


def _score_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "fit_id", "solution", "sample_count", "coverage", "first_sample_us", "last_sample_us", "reason",
        r("position_rmse_m").alias("position_rmse_m"),
        r("position_mean_m").alias("position_mean_m"),
        r("position_variance_m2", 5).alias("position_variance_m2"),
        r("velocity_rmse_m_s").alias("velocity_rmse_m_s"),
        r("dx_m_mean").alias("dx_m_mean"),
        r("dx_m_variance", 5).alias("dx_m_variance"),
    )


@query("window_score", "A05", _score_check(">="))
def window_score(t: Tables) -> DataFrame:
    return _score_columns(
        scoring.window_score(t.state_errors, _windows(t), ["fit_id", "solution"], bucket_us=HOUR_US)
    )


@query("forecast_hour_score", "A13", _score_check(">"))
def forecast_hour_score(t: Tables) -> DataFrame:
    return _score_columns(
        scoring.window_score(
            t.state_errors, _windows(t), ["fit_id", "solution"], bucket_us=HOUR_US, exclude_start=True
        )
    )


@query(
    "error_moments",
    "A07",
    f"""
    WITH @state_errors SELECT fit_id, solution, {rd(f'sqrt(avg({_P2}))')} AS rmse, {rd(f'avg(sqrt({_P2}))')} AS mean,
      {rd(f'var_pop(sqrt({_P2}))', 5)} AS variance, {rd('avg(dx_m)')} AS dx_mean, {rd('var_pop(dx_m)', 5)} AS dx_var,
      {rd('avg(dy_m)')} AS dy_mean, {rd('var_pop(dz_m)', 5)} AS dz_var, {rd(f'avg(sqrt({_V2}))')} AS velocity_mean
    FROM state_errors GROUP BY 1, 2""",
)
def error_moments(t: Tables) -> DataFrame:
    moments = scoring.error_moments(scoring.POSITION, "position", "m")
    moments += scoring.error_moments(scoring.VELOCITY, "velocity", "m_s")
    out = t.state_errors.groupBy("fit_id", "solution").agg(*moments)
    return out.select(
        "fit_id", "solution", r("position_rmse_m").alias("rmse"), r("position_mean_m").alias("mean"),
        r("position_variance_m2", 5).alias("variance"), r("dx_m_mean").alias("dx_mean"),
        r("dx_m_variance", 5).alias("dx_var"), r("dy_m_mean").alias("dy_mean"),
        r("dz_m_variance", 5).alias("dz_var"), r("velocity_mean_m_s").alias("velocity_mean"),
    )


@query(
    "state_error_summary",
    "A08",
    f"""
    WITH @state_errors SELECT fit_id, count(*) AS sample_count, {rd(f'sqrt(avg({_P2}))')} AS position_rms_m,
      {rd(f'sqrt(avg({_V2}))')} AS velocity_rms_m_s, {rd(f'max(sqrt({_P2}))')} AS position_max_m, {rd(f'max(sqrt({_V2}))')} AS velocity_max_m_s
    FROM state_errors GROUP BY fit_id""",
)
def state_error_summary(t: Tables) -> DataFrame:
    out = scoring.error_summary(t.state_errors.groupBy("fit_id"), scoring.POSITION, scoring.VELOCITY)
    return out.select("fit_id", "sample_count", *[r(c).alias(c) for c in out.columns[2:]])


@query(
    "residual_distribution",
    "A09",
    f"""
    WITH @state_errors, n AS (SELECT fit_id, solution, sqrt({_P2}) AS d FROM state_errors WHERE NOT (fit_id % 9 = 0 AND solution = 'prior')),
    k AS (SELECT DISTINCT fit_id, solution FROM state_errors)
    SELECT k.fit_id, k.solution, count(d) AS count, {rd('sqrt(avg(d*d))')} AS rms, {rd('median(d)')} AS median,
      {rd('quantile_cont(d, 0.95)')} AS p95, {rd('max(d)')} AS max
    FROM k LEFT JOIN n ON n.fit_id = k.fit_id AND n.solution = k.solution GROUP BY 1, 2""",
)
def residual_distribution(t: Tables) -> DataFrame:
    hidden = (F.col("fit_id") % 9 == 0) & (F.col("solution") == "prior")
    frame = t.state_errors.withColumn(
        "dx_m", F.when(hidden, float("nan")).otherwise(F.col("dx_m"))
    )
    out = scoring.residual_distribution(frame, ["fit_id", "solution"], scoring.POSITION)
    return out.select(
        "fit_id", "solution", "count", *[r(c).alias(c) for c in ("rms", "median", "p95", "max")]
    )


@query(
    "coverage_gaps",
    "A10",
    f"""
    WITH @telemetry, g AS (SELECT contact_id, ts_us, lag(ts_us) OVER (PARTITION BY contact_id ORDER BY ts_us) AS prev FROM telemetry)
    SELECT contact_id, prev AS start_us, ts_us AS stop_us, {rd('(ts_us - prev) / 1e6')} AS duration_s
    FROM g WHERE ts_us - prev > {40 * HOUR_US}""",
)
def coverage_gaps(t: Tables) -> DataFrame:
    epochs = t.telemetry.select("contact_id", F.col("ts_us").alias("t_us"))
    out = scoring.coverage_gaps(epochs, ["contact_id"], limit_us=40 * HOUR_US, bucket_us=DAY_US)
    return out.withColumn("duration_s", r("duration_s"))


@query(
    "coverage_edges",
    "A10",
    f"""
    WITH @telemetry SELECT contact_id, min(ts_us) AS first_us, max(ts_us) AS last_us,
      {rd(f'(min(ts_us) - {ORIGIN_US}) / 1e6')} AS backward_s, {rd(f'({ORIGIN_US + 31 * DAY_US} - max(ts_us)) / 1e6')} AS forward_s,
      {rd('median(event_id * 7919 % 90000) / 1e3')} AS median_latency_s FROM telemetry GROUP BY 1""",
)
def coverage_edges(t: Tables) -> DataFrame:
    epochs = t.telemetry.select(
        "contact_id",
        F.col("ts_us").alias("t_us"),
        (F.col("ts_us") + F.col("event_id") * 7919 % 90000 * 1000).alias("packet_us"),
        F.lit(ORIGIN_US).alias("start_us"),
        F.lit(ORIGIN_US + 31 * DAY_US).alias("stop_us"),
    )
    out = scoring.coverage_edges(epochs, ["contact_id"])
    return out.select(
        "contact_id", "first_us", "last_us",
        *[r(c).alias(c) for c in ("backward_s", "forward_s", "median_latency_s")],
    )


@query(
    "holdout_score",
    "A11 X16",
    f"""
    WITH @residuals SELECT contact_id, count(*) AS holdout_samples, {rd('sqrt(avg(residual_hz*residual_hz))')} AS holdout_raw_rmse_hz,
      {rd('sqrt(var_pop(residual_hz))', 5)} AS holdout_shape_rmse_hz, {rd('-avg(residual_hz)')} AS holdout_fitted_bias_hz FROM residuals GROUP BY 1""",
)
def holdout_score(t: Tables) -> DataFrame:
    out = scoring.holdout_score(t.residuals, ["contact_id"])
    return out.select(
        "contact_id", "holdout_samples", r("holdout_raw_rmse_hz").alias("holdout_raw_rmse_hz"),
        r("holdout_shape_rmse_hz", 5).alias("holdout_shape_rmse_hz"),
        r("holdout_fitted_bias_hz").alias("holdout_fitted_bias_hz"),
    )


@query(
    "interval_samples",
    "J02",
    f"""
    WITH w AS (SELECT o_orderkey AS window_id, o_custkey AS user_id, {ORIGIN_US} + (o_orderkey * 7 % 700) * {HOUR_US} AS start_us,
        {ORIGIN_US} + (o_orderkey * 7 % 700 + 1 + o_orderkey % 40) * {HOUR_US} AS stop_us FROM orders)
    SELECT window_id, count(*) AS samples, CAST(sum(event_id) AS BIGINT) AS ids FROM w JOIN events e
      ON e.user_id = w.user_id AND epoch_us(ts) BETWEEN start_us AND stop_us GROUP BY 1""",
)
def interval_samples(t: Tables) -> DataFrame:
    from passledger.operators.ranges import interval_join

    start = F.lit(ORIGIN_US) + (F.col("o_orderkey") * 7 % 700) * HOUR_US
    windows = t.table("orders").select(
        F.col("o_orderkey").alias("window_id"),
        F.col("o_custkey").alias("user_id"),
        start.alias("start_us"),
        (start + (1 + F.col("o_orderkey") % 40) * HOUR_US).alias("stop_us"),
    )
    points = t.table("events").select(
        "event_id", "user_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("t_us")
    )
    inside = interval_join(
        points, windows, ["user_id"], "t_us", "start_us", "stop_us", width=12 * HOUR_US, salts=2
    )
    return inside.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("event_id").alias("ids")
    )


@query(
    "gps_in_span",
    "J03",
    """
    WITH @telemetry, span AS (SELECT contact_id, min(ts_us) AS a, max(ts_us) AS b FROM telemetry
        WHERE carrier_lock = 'Locked' AND isfinite(doppler_hz) AND elevation_deg > 20 GROUP BY 1)
    SELECT contact_id, count(*) AS fixes, min(ts_us) AS first_us FROM telemetry JOIN span USING (contact_id)
    WHERE carrier_lock = 'Unlocked' AND ts_us BETWEEN a AND b GROUP BY 1""",
)
def gps_in_span(t: Tables) -> DataFrame:
    from passledger.operators.ranges import interval_join
    from passledger.operators.selectors import locked_finite

    span = (
        t.telemetry.where(locked_finite() & (F.col("elevation_deg") > 20))
        .groupBy("contact_id")
        .agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    )
    fixes = t.telemetry.where(F.col("carrier_lock") == "Unlocked").select("contact_id", "ts_us")
    return (
        interval_join(fixes, span, ["contact_id"], "ts_us", "a", "b", width=DAY_US)
        .groupBy("contact_id")
        .agg(F.count(F.lit(1)).alias("fixes"), F.min("ts_us").alias("first_us"))
    )


@query(
    "interval_orbit_score",
    "A12",
    f"""
    WITH @state_errors, w AS (SELECT p_partkey AS window_id, p_partkey * 7 % (SELECT count(*) FROM supplier) AS fit_id,
        {ORIGIN_US} + (p_partkey % 9) * {HOUR_US} AS start_us, {ORIGIN_US} + (p_partkey % 9) * {HOUR_US} + (p_partkey % 30) * {MINUTE_US} + 1 AS stop_us FROM part)
    SELECT window_id, count(dx_m) AS samples, {rd(f'sqrt(avg({_P2})) / 1000')} AS position_rmse_km,
      {rd(f'sqrt(avg({_V2}))')} AS velocity_rmse_m_s, CASE WHEN count(dx_m) = 0 THEN 'no_samples' ELSE '' END AS reason
    FROM w LEFT JOIN (SELECT * FROM state_errors WHERE solution = 'fitted') s ON s.fit_id = w.fit_id AND t_us BETWEEN start_us AND stop_us GROUP BY 1""",
)
def interval_orbit_score(t: Tables) -> DataFrame:
    total = t.table("supplier").agg(F.count(F.lit(1)).alias("_n"))
    start = F.lit(ORIGIN_US) + (F.col("p_partkey") % 9) * HOUR_US
    windows = (
        t.table("part")
        .join(F.broadcast(total))  # one row
        .select(
            F.col("p_partkey").alias("window_id"),
            (F.col("p_partkey") * 7 % F.col("_n")).alias("fit_id"),
            start.alias("start_us"),
            (start + (F.col("p_partkey") % 30) * MINUTE_US + 1).alias("stop_us"),
        )
    )
    states = t.state_errors.where(F.col("solution") == "fitted")
    out = scoring.interval_orbit_score(states, windows, ["fit_id"], "window_id", width_us=HOUR_US)
    return out.select(
        "window_id", "samples", r("position_rmse_km").alias("position_rmse_km"),
        r("velocity_rmse_m_s").alias("velocity_rmse_m_s"), "reason",
    )
