"""Queries for interpolation, scans, fits, covariances and service rows.

Each user of the events table stands for an object on a circular orbit in closed
form; each event is a Doppler sample of it with a known shift, pass bias, noise
and outliers. The numbers exercise the operators and say nothing about orbits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.functions import geometry as geo
from passledger.functions.scalars import PARAMETER_UNITS, curvature_weight
from passledger.operators import estimate, interpolate, service
from passledger.plans.registry import query
from passledger.plans.rounding import NUDGE, r, rd
from passledger.plans.standins import HOUR_US, ORIGIN_US, Tables

MU = 3.986004418e14
GRID_US = 60_000_000
_C = interpolate.COMPONENTS


def circular(user: Column, seconds: Column) -> list[Column]:
    """Closed-form state of the stand-in object at seconds from the origin."""
    a = F.lit(6900000.0) + (user % 100) * 1000.0
    rate = F.sqrt(F.lit(MU) / (a * a * a))
    theta = F.radians((user * 37 % 360).cast("double")) + rate * seconds
    tilt, node = F.radians((40 + user % 60).cast("double")), F.radians((user * 11 % 360).cast("double"))
    c, s = F.cos(theta), F.sin(theta)
    ci, si, co, so = F.cos(tilt), F.sin(tilt), F.cos(node), F.sin(node)

    def turned(u: Column, w: Column, size: Column) -> list[Column]:
        return [size * (co * u - so * w * ci), size * (so * u + co * w * ci), size * w * si]

    return turned(c, s, a) + turned(-s, c, a * rate)


def orbit_table(t: Tables) -> DataFrame:
    """A state per minute and object, ten minutes beyond the samples."""
    users = t.table("events").select(F.col("user_id").alias("object_no")).distinct()
    grid = users.withColumn("_k", F.explode(F.expr("sequence(-10L, 100L)")))
    seconds = F.col("_k") * 60.0
    state = circular(F.col("object_no"), seconds)
    return grid.select(
        "object_no", F.lit(0).alias("segment"), (F.lit(ORIGIN_US) + F.col("_k") * GRID_US).alias("t_us"),
        *[v.alias(n) for v, n in zip(state, _C)],
    )


def samples(t: Tables) -> DataFrame:
    """Doppler samples of every object with their truth columns."""
    u = F.col("user_id")
    micros = F.expr("unix_micros(CAST(ts AS TIMESTAMP))")
    base = t.table("events").select(
        "event_id", u.alias("object_no"), F.lit(0).alias("segment"), u.alias("fit_id"),
        (F.lit(ORIGIN_US) + micros % 5_400_000_000).alias("t_us"),
        F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").alias("decade"), "value",
    )
    u = F.col("object_no")
    lat, lon = F.radians((u % 120 - 60).cast("double")), F.radians((u * 7 % 360).cast("double"))
    frame = base.select(
        "*", F.concat_ws("-", F.concat(F.lit("C"), "object_no"), "decade").alias("contact_id"),
        (6378137.0 * F.cos(lat) * F.cos(lon)).alias("station_x"),
        (6378137.0 * F.cos(lat) * F.sin(lon)).alias("station_y"),
        (6378137.0 * F.sin(lat)).alias("station_z"),
        F.lit(400e6).alias("centre_hz"), F.lit(2.0).alias("sigma_hz"), F.lit(ORIGIN_US).alias("epoch_us"),
        ((u % 11 - 5) * 0.8).alias("true_shift_s"),
        F.degrees(F.sqrt(F.lit(MU) / F.pow(F.lit(6900000.0) + (u % 100) * 1000.0, F.lit(3.0)))).alias("motion_deg_s"),
    )
    seconds = (F.col("t_us") - ORIGIN_US) / 1e6 + F.col("true_shift_s")
    state = circular(F.col("object_no"), seconds)
    place, velocity = geo.station_inertial(
        geo.vector("station_x", "station_y", "station_z"), F.col("t_us") / 1e6
    )
    _, rate = geo.range_and_rate(state[:3], state[3:], place, velocity)
    noise = (F.col("value") % 7 - 3) * 0.3 + F.when(F.col("event_id") % 25 == 0, 2000.0).otherwise(0.0)
    observed = geo.doppler(rate, F.col("centre_hz")) + (F.col("decade") * 30 - 20) + noise
    return frame.withColumn("observed_hz", observed)


def observations(t: Tables) -> DataFrame:
    return interpolate.attach(
        samples(t), orbit_table(t), ["object_no", "segment"], bucket_us=HOUR_US
    )


# The same in DuckDB text.
_OBS = f"""
    ob AS (SELECT event_id, user_id AS u, {ORIGIN_US} + epoch_us(ts) % 5400000000 AS t_us, (epoch_us(ts) % 5400000000) / 1e6 AS s, CAST(floor((day(ts) - 1) / 10) AS INTEGER) AS decade,
       (value % 7 - 3) * 0.3 + CASE WHEN event_id % 25 = 0 THEN 2000.0 ELSE 0.0 END AS noise, (user_id % 11 - 5) * 0.8 AS sh, 6900000.0::DOUBLE + (user_id % 100) * 1000.0 AS a,
       radians(user_id * 37 % 360) AS th, cos(radians(40 + user_id % 60)) AS ci, sin(radians(40 + user_id % 60)) AS si, cos(radians(user_id * 11 % 360)) AS co, sin(radians(user_id * 11 % 360)) AS so,
       6378137.0 * cos(radians(user_id % 120 - 60)) * cos(radians(user_id * 7 % 360)) AS ex, 6378137.0 * cos(radians(user_id % 120 - 60)) * sin(radians(user_id * 7 % 360)) AS ey, 6378137.0 * sin(radians(user_id % 120 - 60)) AS ez,
       0.7790572732640 + (({ORIGIN_US} + epoch_us(ts) % 5400000000) / 1e6 - 946728000.0) / 86400.0 * 1.00273781191135448 AS turns FROM events),
    oc AS (SELECT *, sqrt({MU!r} / (a * a * a)) AS n, (turns - floor(turns)) * (2 * 3.141592653589793) AS era FROM ob),
    os AS (SELECT *, cos(era) * ex - sin(era) * ey AS gx, sin(era) * ex + cos(era) * ey AS gy, ez AS gz FROM oc)"""


def _sql_state(shift: str) -> list[str]:
    c, s = f"cos(th + n * (s + {shift}))", f"sin(th + n * (s + {shift}))"

    def turned(u: str, w: str, size: str) -> list[str]:
        return [f"{size} * (co * {u} - so * {w} * ci)", f"{size} * (so * {u} + co * {w} * ci)", f"{size} * {w} * si"]

    return turned(c, s, "a") + turned(f"(-{s})", c, "a * n")


def _sql_doppler(source: str, shift: str, out: str, keep: str = "*") -> str:
    """CTEs giving {out}: every row of source with f, the Doppler at a shift."""
    x, y, z, vx, vy, vz = _sql_state(shift)
    w = geo.EARTH_RATE
    return f"""
    {out}_p AS (SELECT {keep}, {x} - gx AS dx, {y} - gy AS dy, {z} - gz AS dz, {vx} + {w!r} * gy AS wx, {vy} - {w!r} * gx AS wy, {vz} AS wz FROM {source}),
    {out} AS (SELECT *, -(wx * dx + wy * dy + wz * dz) / sqrt(dx * dx + dy * dy + dz * dz) * 400e6 / 299792458.0 AS f FROM {out}_p)"""


@query(
    "interpolated_states",
    "W09",
    f"WITH {_OBS} SELECT event_id, {', '.join(f'{rd(v, 0 if i < 3 else 3)} AS {n}' for i, (v, n) in enumerate(zip(_sql_state('0.0'), _C)))} FROM os",
)
def interpolated_states(t: Tables) -> DataFrame:
    out = observations(t)
    shown = [r(v, 0 if i < 3 else 3).alias(n) for i, (v, n) in enumerate(zip(interpolate.values(), _C))]
    return out.select("event_id", *shown)


@query(
    "doppler_prediction",
    "E01 D02",
    f"""WITH {_OBS}, {_sql_doppler('os', '0.0', 'p0')}, q AS (SELECT * EXCLUDE (dx, dy, dz, wx, wy, wz), f AS f0 FROM p0), qq AS (SELECT * EXCLUDE (f) FROM q), {_sql_doppler('qq', 'sh', 'p1')}
    SELECT event_id, {rd('f0', 1)} AS predicted_hz, {rd('f0 - (f + decade * 30 - 20 + noise)', 1)} AS residual_hz FROM p1""",
)
def doppler_prediction(t: Tables) -> DataFrame:
    out = estimate.evaluate(observations(t))
    # Without a shift a sample's residual is its bias and noise, decimals that may lie exactly between
    # two printed values: there the interpolation, good to some 2e-8 Hz on this grid, must not decide.
    nudge = F.when(F.col("true_shift_s") == 0, 1e-7).otherwise(NUDGE)
    return out.select(
        "event_id", r("predicted_hz", 1).alias("predicted_hz"), r("residual_hz", 1, nudge).alias("residual_hz")
    )


_SCAN = f"""{_OBS}, {_sql_doppler('os', 'sh', 'tru')}, ot AS (SELECT * EXCLUDE (dx, dy, dz, wx, wy, wz, f), f + decade * 30 - 20 + noise AS observed FROM tru),
    oz AS (SELECT *, unnest(list_transform(range(0, 25), lambda i: -6.0 + i * 0.5)) AS off FROM ot), {_sql_doppler('oz', 'off', 'pr')},
    sm AS (SELECT u, CAST(off AS DOUBLE) AS off, decade, count(*) AS m, sum((f - observed) / 2) AS sr, sum(pow((f - observed) / 2, 2)) AS rr FROM pr GROUP BY 1, 2, 3),
    co_ AS (SELECT u, off, 0.5 * sum(rr - sr * sr / m) AS cost FROM sm GROUP BY 1, 2)"""


@query(
    "timing_scan",
    "E02",
    f"WITH {_SCAN} SELECT u AS fit_id, arg_min(off, (cost, off)) AS offset_s, {rd('min(cost)', 0)} AS cost, count(*) AS candidates FROM co_ GROUP BY 1",
)
def timing_scan(t: Tables) -> DataFrame:
    scan = estimate.timing_scan(observations(t), lower_s=-6.0, upper_s=6.0, step_s=0.5)
    return estimate.best_offset(scan).withColumn("cost", r("cost", 0))


@query("robust_timing_scan", "E02 A30")
def robust_timing_scan(t: Tables) -> DataFrame:
    scan = estimate.timing_scan(
        observations(t), lower_s=-6.0, upper_s=6.0, step_s=1.0, loss="soft_l1", loss_scale=5.0, rounds=2
    )
    return estimate.best_offset(scan).withColumn("cost", r("cost", 2))


@query(
    "phase_scan",
    "E03 A32",
    f"""WITH {_OBS}, {_sql_doppler('os', 'sh', 'tru')}, ot AS (SELECT * EXCLUDE (dx, dy, dz, wx, wy, wz, f), f + decade * 30 - 20 + noise AS observed FROM tru),
    oz AS (SELECT *, unnest(range(-30, 31)) AS deg FROM ot), {_sql_doppler('oz', '(deg / degrees(n))', 'pr')},
    d AS (SELECT u, deg, decade, f - observed AS z FROM pr), m AS (SELECT *, greatest(-150000, least(150000, -median(z) OVER (PARTITION BY u, deg, decade))) AS b FROM d),
    c AS (SELECT u, deg, 25 * sum(sqrt(1 + pow((z + b) / 10, 2)) - 1) AS cost FROM m GROUP BY 1, 2)
    SELECT u AS fit_id, CAST(arg_min(deg, (cost, deg)) AS DOUBLE) AS offset_s, {rd('min(cost)', 2)} AS cost, count(*) AS candidates FROM c GROUP BY 1""",
)
def phase_scan(t: Tables) -> DataFrame:
    return estimate.best_offset(estimate.phase_scan(observations(t), loss="soft_l1", loss_scale=5.0)).withColumn(
        "cost", r("cost", 2)
    )


def _fitted(t: Tables, drift: bool) -> DataFrame:
    return estimate.joint_fit(observations(t), drift=drift, loss="soft_l1", loss_scale=3.0, steps=12, tolerance_s=1e-4, tolerance_hz=1e-2)


@query("joint_fit", "E04")
def joint_fit(t: Tables) -> DataFrame:
    out = _fitted(t, drift=False)
    truth = (F.col("fit_id") % 11 - 5) * 0.8
    return out.select(
        "fit_id", "contact_id", r("offset_s", 4).alias("offset_s"), r("bias_hz", 2).alias("bias_hz"),
        (F.abs(F.col("offset_s") - truth) < 0.05).alias("recovered"), "converged", "at_bound",
    )


@query("drift_fit", "E05")
def drift_fit(t: Tables) -> DataFrame:
    out = _fitted(t, drift=True)
    return out.select(
        "fit_id", "contact_id", r("offset_s", 3).alias("offset_s"), r("drift", 6).alias("drift"),
        r("bias_hz", 1).alias("bias_hz"), "at_bound",
    )


# --- sums, covariances, conditioning -------------------------------------------------

_W = "(1 / (sigma_hz * sigma_hz))"


@query(
    "normal_equations",
    "A31 X09",
    f"""WITH @residuals SELECT fit_id, contact_id, count(*) AS rows, {rd(f'sum(j_time * j_time * {_W})')} AS n_j_time_j_time, {rd(f'sum(j_time * j_bias * {_W})')} AS n_j_time_j_bias,
      {rd(f'sum(j_bias * j_bias * {_W})')} AS n_j_bias_j_bias, {rd(f'sum(j_time * residual_hz * {_W})', 4)} AS g_j_time, {rd(f'sum(j_bias * residual_hz * {_W})', 4)} AS g_j_bias,
      {rd(f'sum(residual_hz * residual_hz * {_W})', 2)} AS rr FROM residuals GROUP BY 1, 2""",
)
def normal_equations(t: Tables) -> DataFrame:
    out = estimate.normal_equations(t.residuals, ["fit_id", "contact_id"], ["j_time", "j_bias"])
    digits = {"g_j_time": 4, "g_j_bias": 4, "rr": 2}
    return out.select("fit_id", "contact_id", "rows", *[r(c, digits.get(c, 6)).alias(c) for c in out.columns[3:]])


@query(
    "median_bias",
    "A32",
    f"""WITH @residuals, g AS (SELECT contact_id, residual_hz / sigma_hz AS r_, CASE WHEN pass_no = 7 AND fit_id % 9 = 0 THEN 0.0 ELSE 1 / sigma_hz END AS h FROM residuals)
    SELECT contact_id, count(*) FILTER (h = 0) AS zero_sensitivity, CASE WHEN count(*) FILTER (h = 0) = 0 THEN {rd('greatest(-150.0, least(150.0, -median(r_ / h)))')} END AS bias_hz FROM g GROUP BY 1""",
)
def median_bias(t: Tables) -> DataFrame:
    rows = t.residuals.select(
        "contact_id", (F.col("residual_hz") / F.col("sigma_hz")).alias("r"),
        F.when((F.col("pass_no") == 7) & (F.col("fit_id") % 9 == 0), 0.0).otherwise(1 / F.col("sigma_hz")).alias("h"),
    )
    out = estimate.median_biases(rows, ["contact_id"], lower=-150.0, upper=150.0)
    return out.withColumn("bias_hz", r("bias_hz"))


_N2 = f"""nn AS (SELECT fit_id, sum(j_time * j_time * {_W}) AS a, sum(j_time * j_rate * {_W}) AS b, sum(j_rate * j_rate * {_W}) AS c, sum(j_time * j_bias * {_W}) AS p, sum(j_rate * j_bias * {_W}) AS q,
    sum(residual_hz * residual_hz * {_W}) AS rr, count(*) AS n FROM residuals GROUP BY 1)"""


@query(
    "consider_covariance",
    "E06",
    f"""WITH @residuals, {_N2}, i AS (SELECT *, a + 4.0 AS ia, c + 0.25 AS ic, (a + 4.0) * (c + 0.25) - b * b AS det FROM nn),
    k AS (SELECT *, ic / det AS p11, -b / det AS p12, ia / det AS p22 FROM i), z AS (SELECT *, -(p11 * p + p12 * q) AS s1, -(p12 * p + p22 * q) AS s2 FROM k),
    o AS (SELECT fit_id, unnest(['j_time', 'j_time', 'j_rate', 'j_rate']) AS parameter, unnest(['j_time', 'j_rate', 'j_time', 'j_rate']) AS other, unnest([p11, p12, p12, p22]) AS v,
      unnest([p11 + 9 * s1 * s1, p12 + 9 * s1 * s2, p12 + 9 * s1 * s2, p22 + 9 * s2 * s2]) AS w FROM z)
    SELECT fit_id, parameter, other, {rd('v', 6)} AS unconsidered, {rd('w', 6)} AS covariance FROM o""",
)
def consider_covariance(t: Tables) -> DataFrame:
    sums = estimate.normal_equations(t.residuals, ["fit_id"], ["j_time", "j_rate", "j_bias"])
    out = estimate.consider_covariance(sums, "fit_id", {"j_time": 0.5, "j_rate": 2.0}, {"j_bias": 3.0})
    return out.select(
        "fit_id", "parameter", "other", r("unconsidered", 6).alias("unconsidered"), r("covariance", 6).alias("covariance")
    )


@query("pass_information", "E07")
def pass_information(t: Tables) -> DataFrame:
    """Six stand-in orbit columns per line item, weighted for the soft loss."""
    w = curvature_weight(F.col("residual_hz") / F.col("sigma_hz"), "soft_l1", 100.0)
    rows = t.residuals.select(
        F.col("fit_id").cast("long").alias("fit_id"),
        (w * F.col("j_bias")).alias("bias"),
        (w * F.col("j_time")).alias("c1"), (w * F.col("j_rate")).alias("c2"),
        (w * F.sin(F.col("residual_hz"))).alias("c3"), (w * F.cos(F.col("residual_hz") * 2)).alias("c4"),
        (w * F.col("j_time") * F.col("j_rate")).alias("c5"),
        F.when(F.col("fit_id") % 5 == 0, w * F.col("j_time") * 2).otherwise(w * F.sin(F.col("j_rate") * 5)).alias("c6"),
    )
    out = estimate.pass_information(rows, "fit_id", "bias", ["c1", "c2", "c3", "c4", "c5", "c6"])
    return out.select(
        "fit_id", "samples", "rank", r("fim_condition", 2).alias("fim_condition"),
        r("inverse_information_trace", 6).alias("inverse_information_trace"),
    )


@query(
    "pass_information_one",
    "E07",
    f"""WITH @residuals, g AS (SELECT fit_id, pow(1 + pow(residual_hz / sigma_hz / 100.0, 2), -0.75) AS w, j_bias AS b, j_time AS a FROM residuals),
    s AS (SELECT fit_id, count(*) AS samples, sum(w * a * w * a) - pow(sum(w * a * w * b), 2) / sum(w * b * w * b) AS left_over FROM g GROUP BY 1)
    SELECT fit_id, samples, 1 AS rank, CAST(1 AS DOUBLE) AS fim_condition, {rd('1 / left_over', 6)} AS inverse_information_trace FROM s""",
)
def pass_information_one(t: Tables) -> DataFrame:
    """One orbit column, where what projection leaves has a closed form."""
    w = curvature_weight(F.col("residual_hz") / F.col("sigma_hz"), "soft_l1", 100.0)
    rows = t.residuals.select(F.col("fit_id").cast("long").alias("fit_id"), (w * F.col("j_bias")).alias("bias"), (w * F.col("j_time")).alias("c1"))
    out = estimate.pass_information(rows, "fit_id", "bias", ["c1"])
    return out.select("fit_id", "samples", "rank", r("fim_condition", 2).alias("fim_condition"), r("inverse_information_trace", 6).alias("inverse_information_trace"))


@query(
    "fit_conditioning",
    "E08 E11",
    f"""WITH @residuals, g AS (SELECT fit_id, pow(1 + pow(residual_hz / sigma_hz / 100.0, 2), -0.75) AS w, j_time / sigma_hz AS a, j_rate / sigma_hz * 10 AS b FROM residuals),
    s AS (SELECT fit_id, sum(w * a * w * a) AS aa, sum(w * a * w * b) AS ab, sum(w * b * w * b) AS bb, count(*) AS n FROM g GROUP BY 1),
    e AS (SELECT *, sqrt((aa - bb) * (aa - bb) + 4 * ab * ab) AS d FROM s)
    SELECT fit_id, 2 AS rank, 2 AS parameter_count, n - 2 AS degrees_of_freedom, {rd('sqrt((aa + bb + d) / (aa + bb - d))', 5)} AS condition_number, {rd('-ab / sqrt(aa * bb)', 6)} AS correlation FROM e""",
)
def fit_conditioning(t: Tables) -> DataFrame:
    w = curvature_weight(F.col("residual_hz") / F.col("sigma_hz"), "soft_l1", 100.0)
    rows = t.residuals.select(
        F.col("fit_id").cast("long").alias("fit_id"), (w * F.col("j_time") / F.col("sigma_hz")).alias("a"),
        (w * F.col("j_rate") / F.col("sigma_hz") * 10).alias("b"),
    )
    out = estimate.conditioning(rows, "fit_id", ["a", "b"]).drop("reason")
    return out.withColumn("condition_number", r("condition_number", 5)).withColumn("correlation", r("correlation", 6))


_FITS = "ff AS (SELECT s_suppkey AS fit_id, s_suppkey % 7 <> 3 AS success, s_suppkey % 5 = 1 AS at_bound, CASE WHEN s_suppkey % 4 = 2 THEN 'soft_l1' ELSE 'linear' END AS loss FROM supplier)"


@query(
    "residual_covariance",
    "E09",
    f"""WITH @residuals, {_N2}, {_FITS}, d AS (SELECT *, concat_ws('; ', CASE WHEN NOT success THEN 'not_converged' END, CASE WHEN at_bound THEN 'at_a_bound' END,
      CASE WHEN loss <> 'linear' THEN 'loss_not_linear' END) AS why, a * c - b * b AS det FROM nn JOIN ff USING (fit_id))
    SELECT fit_id, why AS unavailable_reason, CASE WHEN why = '' THEN {rd('rr / (n - 2) * c / det', 5)} END AS variance_first, CASE WHEN why = '' THEN {rd('-rr / (n - 2) * b / det', 5)} END AS covariance,
      CASE WHEN why = '' THEN {rd('rr / (n - 2) * a / det', 5)} END AS variance_second FROM d""",
)
def residual_covariance(t: Tables) -> DataFrame:
    sums = estimate.normal_equations(t.residuals, ["fit_id"], ["j_time", "j_rate"])
    fits = t.table("supplier").selectExpr(
        "s_suppkey AS fit_id", "s_suppkey % 7 <> 3 AS success", "s_suppkey % 5 = 1 AS at_bound",
        "CASE WHEN s_suppkey % 4 = 2 THEN 'soft_l1' ELSE 'linear' END AS loss",
    )
    out = estimate.residual_covariance(sums, fits, "fit_id", "j_time", "j_rate")
    return out.select("fit_id", "unavailable_reason", *[r(c, 5).alias(c) for c in out.columns[2:]])


@query(
    "bias_pruning",
    "E10",
    """WITH v AS (SELECT o_orderkey // 6 AS fit_id, o_orderkey AS contact_id, o_totalprice / 1000 AS bv, CASE WHEN o_orderkey // 6 % 8 = 0 THEN 'no fit' ELSE '' END AS why FROM orders),
    k AS (SELECT fit_id, count(*) FILTER (bv <= 300) AS kept, count(*) AS n, max(why) AS w FROM v GROUP BY 1)
    SELECT fit_id, contact_id, CASE WHEN w <> '' THEN true ELSE bv <= 300 END AS kept, CASE WHEN w <> '' THEN w WHEN k.kept = 0 THEN 'none_left'
      WHEN k.kept = n THEN 'all_kept' ELSE 'refit' END AS note FROM v JOIN k USING (fit_id)""",
)
def bias_pruning(t: Tables) -> DataFrame:
    variances = t.table("orders").selectExpr(
        "o_orderkey div 6 AS fit_id", "o_orderkey AS contact_id", "o_totalprice / 1000 AS bias_variance",
        "CASE WHEN o_orderkey div 6 % 8 = 0 THEN 'no fit' ELSE '' END AS unavailable_reason",
    )
    return estimate.prune_passes(variances, 300.0)


@query(
    "held_out_prediction",
    "E12 A11 J07",
    f"""WITH @residuals, p AS (SELECT fit_id, contact_id, count(*) AS n, sum({_W}) AS w, sum(j_time * {_W}) AS wj, sum(residual_hz * {_W}) AS wr, sum(j_time * j_time * {_W}) AS wjj, sum(j_time * residual_hz * {_W}) AS wjr FROM residuals GROUP BY 1, 2),
    q AS (SELECT *, wjj - wj * wj / w AS A, wjr - wj * wr / w AS G FROM p), z AS (SELECT q.fit_id, q.contact_id, q.n, -(sum(o.G)) / sum(o.A) AS s FROM q JOIN q o ON o.fit_id = q.fit_id AND o.contact_id <> q.contact_id GROUP BY 1, 2, 3),
    h AS (SELECT z.*, residual_hz + s * j_time AS e FROM z JOIN residuals r ON r.contact_id = z.contact_id)
    SELECT fit_id, contact_id, n AS holdout_samples, {rd('s', 5)} AS shift_s, {rd('sqrt(avg(e * e))', 4)} AS holdout_raw_rmse_hz, {rd('sqrt(var_pop(e))', 4)} AS holdout_shape_rmse_hz, {rd('-avg(e)', 4)} AS holdout_fitted_bias_hz FROM h GROUP BY 1, 2, 3, 4""",
)
def held_out_prediction(t: Tables) -> DataFrame:
    out = estimate.held_out(t.residuals)
    digits = {"shift_s": 5}
    return out.select(
        "fit_id", "contact_id", "holdout_samples",
        *[r(c, digits.get(c, 4)).alias(c) for c in out.columns[3:]],
    )


# --- trajectory comparison -------------------------------------------------------------

_SWEPT = (-1.0, 1.0, 0.25)
_OFFSETS = sorted({-1.0 + 0.25 * i for i in range(9)} | set(estimate.ALWAYS_SCORED))


def _reference(t: Tables) -> DataFrame:
    """Reference states that lead the table by 0.35 s and carry its stencils."""
    points = samples(t).select("event_id", "object_no", "segment", "t_us")
    truth = circular(F.col("object_no"), (F.col("t_us") - ORIGIN_US) / 1e6 + 0.35)
    tied = interpolate.attach(points, orbit_table(t), ["object_no", "segment"], bucket_us=HOUR_US)
    return tied.select("*", *[v.alias(f"r_{n}") for v, n in zip(truth, _C)])


def _sql_pairs(source: str, shift: str) -> str:
    p = ", ".join(f"{v} AS p_{n}" for v, n in zip(_sql_state(shift), _C))
    q = ", ".join(f"{v} AS r_{n}" for v, n in zip(_sql_state("0.35"), _C))
    return f"SELECT *, {p}, {q} FROM {source}"


_D2 = " + ".join(f"avg(pow(p_{c} - r_{c}, 2))" for c in "xyz")
_DV2 = " + ".join(f"avg(pow(p_v{c} - r_v{c}, 2))" for c in "xyz")
_SWEEP = f"""{_OBS}, oz AS (SELECT *, CAST(unnest([{', '.join(repr(o) for o in _OFFSETS)}]) AS DOUBLE) AS off FROM os), pp AS ({_sql_pairs('oz', 'off')}),
    sc AS (SELECT u AS object_no, off AS offset_s, count(*) AS sample_count, {rd(f'sqrt({_D2})', 2)} AS position_rms_m, {rd(f'sqrt({_DV2})', 4)} AS velocity_rms_m_s,
      {rd('sqrt(avg(pow(((p_x - r_x) * r_x + (p_y - r_y) * r_y + (p_z - r_z) * r_z) / sqrt(r_x * r_x + r_y * r_y + r_z * r_z), 2)))', 2)} AS radial_rms_m FROM pp GROUP BY 1, 2)"""


@query(
    "trajectory_sweep",
    "E15 A29 X04",
    f"WITH {_SWEEP} SELECT * FROM sc",
)
def trajectory_sweep(t: Tables) -> DataFrame:
    out = estimate.trajectory_sweep(_reference(t), "object_no", estimate.sweep_column(*_SWEPT))
    return out.select(
        "object_no", "offset_s", "sample_count", r("position_rms_m", 2).alias("position_rms_m"),
        r("velocity_rms_m_s", 4).alias("velocity_rms_m_s"), r("radial_rms_m", 2).alias("radial_rms_m"),
    )


@query(
    "sweep_optimum",
    "E15 T05",
    f"WITH {_SWEEP}, b AS (SELECT object_no, arg_min(offset_s, (position_rms_m, offset_s)) AS best_offset_s FROM sc GROUP BY 1) SELECT object_no, best_offset_s, true AS interior FROM b",
)
def sweep_optimum(t: Tables) -> DataFrame:
    best = estimate.sweep_optimum(_reference(t), "object_no", estimate.sweep_column(*_SWEPT))
    return best.select("object_no", "best_offset_s", "interior")


@query(
    "preservation_check",
    "E16 J05",
    f"""WITH {_OBS}, pp AS ({_sql_pairs('os', '(0.35 + (u % 5) * 0.0005)')}),
    z AS (SELECT u AS object_no, sqrt({_D2}) AS prms, max(sqrt(pow(p_x - r_x, 2) + pow(p_y - r_y, 2) + pow(p_z - r_z, 2))) AS pmax, sqrt({_DV2}) AS vrms, max(sqrt(pow(p_vx - r_vx, 2) + pow(p_vy - r_vy, 2) + pow(p_vz - r_vz, 2))) AS vmax FROM pp GROUP BY 1)
    SELECT object_no, {rd('prms', 4)} AS position_rms_m, {rd('pmax', 4)} AS position_max_m, {rd('vrms', 5)} AS velocity_rms_m_s, prms < 10 AND pmax < 20 AND vrms < 0.01 AND vmax < 0.02 AS accepted FROM z""",
)
def preservation_check(t: Tables) -> DataFrame:
    points = samples(t).select("object_no", "t_us")
    seconds = (F.col("t_us") - ORIGIN_US) / 1e6
    left = circular(F.col("object_no"), seconds + (0.35 + (F.col("object_no") % 5) * 0.0005))
    right = circular(F.col("object_no"), seconds + 0.35)
    pairs = points.select(
        "object_no", *[v.alias(f"p_{n}") for v, n in zip(left, _C)], *[v.alias(f"r_{n}") for v, n in zip(right, _C)]
    )
    out = estimate.preservation_check(pairs, ["object_no"])
    return out.select(
        "object_no", r("position_rms_m", 4).alias("position_rms_m"), r("position_max_m", 4).alias("position_max_m"),
        r("velocity_rms_m_s", 5).alias("velocity_rms_m_s"), "accepted",
    )


# --- service rows ------------------------------------------------------------------------

_MODELS = "['lofi-time', 'lofi-time-frequency', 'lofi-elements', 'hifi']"
_OPT = "['least-squares', 'robust', 'timing-scan', 'phase-scan']"
_REQ = f"""rq AS (SELECT o_orderkey AS request_id, {_MODELS}[o_orderkey % 4 + 1] AS model, {_OPT}[o_orderkey // 4 % 4 + 1] AS optimizer, CASE WHEN o_orderkey % 5 = 0 THEN 150.0 END AS ov FROM orders),
    op AS (SELECT * FROM (VALUES {', '.join(f"({n!r}, {loss!r}, {s!r}, [{', '.join(repr(m) for m in ms)}])" for n, loss, s, ms in service.OPTIMIZERS)}) v(optimizer, loss, loss_scale, models)),
    rs AS (SELECT request_id, model, rq.optimizer, loss, CAST(coalesce(ov, loss_scale) AS DOUBLE) AS loss_scale, CASE WHEN NOT list_contains(models, model) THEN 'optimizer is incompatible with the forward model'
       WHEN ov IS NOT NULL AND loss = 'linear' THEN 'loss_scale is only effective for robust-loss profiles' ELSE '' END AS reason FROM rq JOIN op ON op.optimizer = rq.optimizer)"""


def _requests(t: Tables) -> DataFrame:
    models, opts = F.array(*[F.lit(m) for m in service.OPTIMIZERS[0][3]]), F.array(*[F.lit(o[0]) for o in service.OPTIMIZERS])
    key = F.col("o_orderkey")
    return t.table("orders").select(
        key.alias("request_id"), F.element_at(models, (key % 4 + 1).cast("int")).alias("model"),
        F.element_at(opts, (F.expr("o_orderkey div 4") % 4 + 1).cast("int")).alias("optimizer"),
        F.when(key % 5 == 0, 150.0).alias("loss_scale_override"),
    )


@query("resolve_requests", "E13 D04", f"WITH {_REQ} SELECT * FROM rs")
def resolve_requests(t: Tables) -> DataFrame:
    return service.resolve_requests(_requests(t), service.optimizers(t.spark))


_PARAMS = ", ".join(f"({m!r}, {i}, {n!r}, {a!r}, {lo!r}, {hi!r}, {s!r})" for i, (m, n, a, lo, hi, s) in enumerate(service.PROFILE_PARAMETERS))
_UNIT_CASE = "CASE WHEN starts_with(name, 'pass_bias_hz:') THEN 'Hz' " + " ".join(
    f"WHEN name = {k!r} THEN {v!r}" for k, v in PARAMETER_UNITS.items()
) + " END"


@query(
    "profile_expansion",
    "E13 X21",
    f"""WITH {_REQ}, pm AS (SELECT * FROM (VALUES {_PARAMS}) v(model, place, name, initial, lower_bound, upper_bound, scale)),
    a AS (SELECT request_id, model FROM rs WHERE reason = ''), ct AS (SELECT l_orderkey AS request_id, l_linenumber AS ordinal, concat('K', min(l_partkey)) AS contact_id FROM lineitem GROUP BY 1, 2),
    x AS (SELECT request_id, 0 AS part, place, name, initial, lower_bound, upper_bound, scale FROM a JOIN pm ON pm.model = a.model UNION ALL
      SELECT request_id, 1, ordinal, concat('pass_bias_hz:', contact_id), 0, -150000, 150000, 200 FROM a JOIN ct USING (request_id))
    SELECT request_id, name, part, CAST(place AS BIGINT) AS place, CAST(CASE WHEN name = 'time_offset_s' AND request_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 2.5 ELSE initial END AS DOUBLE) AS initial, CAST(lower_bound AS DOUBLE) AS lower_bound, CAST(upper_bound AS DOUBLE) AS upper_bound,
      CAST(scale AS DOUBLE) AS scale, {_UNIT_CASE} AS unit FROM x""",
)
def profile_expansion(t: Tables) -> DataFrame:
    resolved = service.resolve_requests(_requests(t), service.optimizers(t.spark))
    contacts = t.table("lineitem").groupBy(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("ordinal")
    ).agg(F.concat(F.lit("K"), F.min("l_partkey")).alias("contact_id"))
    overrides = t.table("orders").where("o_orderstatus = 'F'").selectExpr(
        "o_orderkey AS request_id", "'time_offset_s' AS name", "2.5D AS initial"
    )
    return service.expand_parameters(resolved, contacts, service.model_parameters(t.spark), overrides)


@query(
    "parameter_rows",
    "E14",
    f"""WITH f AS (SELECT o_orderkey AS fit_id, unnest([0, 1, 2]) AS ordinal, unnest(['time_offset_s', concat('pass_bias_hz:P', o_orderkey), 'mean_longitude_deg']) AS parameter_name, unnest(['estimate', 'estimate', 'fixed']) AS role,
      unnest([o_totalprice / 1000, CAST(o_custkey AS DOUBLE), 1.5]) AS value, unnest([o_totalprice / 100, 4.0, 0.25]) AS v FROM orders)
    SELECT fit_id, ordinal, parameter_name, role, value, CASE ordinal WHEN 0 THEN 's' WHEN 1 THEN 'Hz' ELSE 'deg' END AS unit, CASE WHEN fit_id % 4 <> 0 THEN {rd('sqrt(v)')} END AS standard_uncertainty,
      CASE WHEN ordinal = 1 THEN concat('P', fit_id) END AS contact_id FROM f""",
)
def parameter_rows(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    fits = t.table("orders").select(
        key.alias("fit_id"),
        F.array(F.lit("time_offset_s"), F.concat(F.lit("pass_bias_hz:P"), key), F.lit("mean_longitude_deg")).alias("names"),
        F.array(F.lit("estimate"), F.lit("estimate"), F.lit("fixed")).alias("roles"),
        F.array(F.col("o_totalprice") / 1000, F.col("o_custkey").cast("double"), F.lit(1.5)).alias("values"),
        F.when(key % 4 != 0, F.array(F.col("o_totalprice") / 100, F.lit(4.0), F.lit(0.25))).alias("variances"),
    )
    out = service.parameter_rows(fits)
    return out.withColumn("standard_uncertainty", r("standard_uncertainty"))


@query(
    "profile_versions",
    "D04",
    """WITH s AS (SELECT o_custkey AS name, o_orderkey AS version, o_orderpriority AS definition FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_custkey AS name, o_orderkey AS version, CASE WHEN s.definition IS NULL THEN 'new' WHEN o_orderkey % 12 = 0 THEN 'profile_changed' ELSE 'unchanged' END AS status
    FROM orders LEFT JOIN s ON s.name = o_custkey AND s.version = o_orderkey""",
)
def profile_versions(t: Tables) -> DataFrame:
    offered = t.table("orders").selectExpr(
        "o_custkey AS name", "o_orderkey AS version",
        "CASE WHEN o_orderkey % 12 = 0 THEN 'edited' ELSE o_orderpriority END AS definition",
    )
    stored = t.table("orders").where("o_orderstatus <> 'P'").selectExpr(
        "o_custkey AS name", "o_orderkey AS version", "o_orderpriority AS definition"
    )
    return service.profile_changes(stored, offered)
