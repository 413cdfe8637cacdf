"""Queries for scalar rules and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.functions import geometry as geo
from passledger.functions import scalars as sc
from passledger.plans.registry import query
from passledger.plans.rounding import r, rd
from passledger.plans.standins import Tables

# One satellite and one station vector per line item.
_VECTORS = """
  l_orderkey AS obs, l_linenumber AS line,
  (7000000 + l_quantity * 1000) * cos(radians(l_orderkey % 360)) AS px, (7000000 + l_quantity * 1000) * sin(radians(l_orderkey % 360)) AS py, l_tax * 10000000 AS pz,
  -7500 * sin(radians(l_orderkey % 360)) AS vx, 7500 * cos(radians(l_orderkey % 360)) AS vy, l_discount * 10000 AS vz,
  6378000.0 AS sx, CAST(l_partkey * 10 AS DOUBLE) AS sy, l_quantity * 1000 AS sz,
  l_extendedprice / 1000 AS ex, l_quantity AS ey, l_discount * 100 AS ez
"""


def _vectors(t: Tables) -> DataFrame:
    from passledger.plans.standins import _split

    return t.table("lineitem").selectExpr(*_split(_VECTORS.replace("6378000.0", "6378000.0D")))


_VIEW = f"v AS (SELECT {_VECTORS} FROM lineitem)"
_REL = "q AS (SELECT *, px - sx AS dx, py - sy AS dy, pz - sz AS dz, vx AS wx, vy - 465 AS wy, vz AS wz FROM v), g AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS rho FROM q), h AS (SELECT *, (wx*dx + wy*dy + wz*dz) / rho AS rr FROM g)"


def _parts():
    p, v = geo.vector("px", "py", "pz"), geo.vector("vx", "vy", "vz")
    s = geo.vector("sx", "sy", "sz")
    return p, v, s, [F.lit(0.0), F.lit(465.0), F.lit(0.0)]


@query(
    "range_and_doppler",
    "X01 X02",
    f"WITH {_VIEW}, {_REL} SELECT obs, line, {rd('rho', 4)} AS range_m, {rd('rr', 5)} AS range_rate, {rd('-rr * 400e6 / 299792458.0 + line', 4)} AS doppler_hz FROM h",
)
def range_and_doppler(t: Tables) -> DataFrame:
    distance, rate = geo.range_and_rate(*_parts())
    doppler = geo.doppler(rate, F.lit(400e6), F.col("line"))
    return _vectors(t).select(
        "obs", "line", r(distance, 4).alias("range_m"), r(rate, 5).alias("range_rate"),
        r(doppler, 4).alias("doppler_hz"),
    )


@query(
    "range_rate_partials",
    "X03",
    f"""WITH {_VIEW}, {_REL} SELECT obs, line, {rd('(wx - rr * dx / rho) / rho * 1e3', 6)} AS h1, {rd('(wy - rr * dy / rho) / rho * 1e3', 6)} AS h2, {rd('(wz - rr * dz / rho) / rho * 1e3', 6)} AS h3,
      {rd('dx / rho')} AS h4, {rd('dy / rho')} AS h5, {rd('dz / rho')} AS h6 FROM h""",
)
def range_rate_partials(t: Tables) -> DataFrame:
    rows = geo.range_rate_partials(*_parts())
    shown = [r(x * 1e3 if i < 3 else x).alias(f"h{i + 1}") for i, x in enumerate(rows)]
    return _vectors(t).select("obs", "line", *shown)


@query(
    "rtn_projection",
    "X04",
    f"""WITH {_VIEW}, c AS (SELECT *, py*vz - pz*vy AS nx, pz*vx - px*vz AS ny, px*vy - py*vx AS nz, sqrt(px*px + py*py + pz*pz) AS pr FROM v),
    d AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS nn FROM c), u AS (SELECT *, px/pr AS ax, py/pr AS ay, pz/pr AS az, nx/nn AS bx, ny/nn AS by_, nz/nn AS bz FROM d)
    SELECT obs, line, {rd('ex*ax + ey*ay + ez*az')} AS radial, {rd('ex*(by_*az - bz*ay) + ey*(bz*ax - bx*az) + ez*(bx*ay - by_*ax)')} AS tangential, {rd('ex*bx + ey*by_ + ez*bz')} AS normal FROM u""",
)
def rtn_projection(t: Tables) -> DataFrame:
    p, v, _, _ = _parts()
    axes = geo.rtn_error(geo.vector("ex", "ey", "ez"), p, v)
    names = ("radial", "tangential", "normal")
    return _vectors(t).select("obs", "line", *[r(a).alias(n) for a, n in zip(axes, names)])


_ELEMENTS = "o_orderkey AS id, (o_orderkey % 90) / 100.0 + 0.001 AS ecc, 1.0 + o_orderkey % 170 AS inc, CAST(o_orderkey * 7 % 360 AS DOUBLE) AS raan, CAST(o_orderkey * 13 % 360 AS DOUBLE) AS argp, CAST(o_orderkey * 17 % 360 AS DOUBLE) AS ma"


@query(
    "equinoctial_elements",
    "X05 X06",
    f"""WITH e AS (SELECT {_ELEMENTS} FROM orders) SELECT id, {rd('ecc * cos(radians(raan + argp))')} AS f, {rd('ecc * sin(radians(raan + argp))')} AS g,
      {rd('tan(radians(inc) * 0.5) * cos(radians(raan))')} AS h, {rd('tan(radians(inc) * 0.5) * sin(radians(raan))')} AS k, (raan + argp + ma) % 360 AS longitude_deg,
      {rd('ecc')} AS eccentricity, {rd('inc')} AS inclination_deg, {rd('ma', 5)} AS anomaly_deg FROM e""",
)
def equinoctial_elements(t: Tables) -> DataFrame:
    from passledger.plans.standins import _split

    frame = t.table("orders").selectExpr(
        *_split(_ELEMENTS.replace("100.0", "100.0D").replace("0.001", "0.001D").replace("1.0 +", "1.0D +"))
    )
    there = frame.select(
        "id", *[x.alias(n) for n, x in geo.equinoctial(*[F.col(c) for c in ("ecc", "inc", "raan", "argp", "ma")]).items()]
    )
    back = geo.classical(*[F.col(c) for c in ("f", "g", "h", "k", "longitude_deg")])
    # The angle may come back as 360 less a rounding error; zero is meant.
    anomaly = F.pmod(F.round(back["mean_anomaly_deg"], 6), F.lit(360.0))
    return there.select(
        "id", r("f").alias("f"), r("g").alias("g"), r("h").alias("h"), r("k").alias("k"), "longitude_deg",
        r(back["eccentricity"]).alias("eccentricity"), r(back["inclination_deg"]).alias("inclination_deg"),
        r(anomaly, 5).alias("anomaly_deg"),
    )


_TLE = "concat('1 ', lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0'), 'U 98067A   ', lpad(CAST(o_custkey AS VARCHAR), 14, '0'), ' -.00001234  00000-0 -12345-4 0  ', lpad(CAST(o_orderkey % 9999 AS VARCHAR), 4, '0'))"


def tle_lines(t: Tables) -> DataFrame:
    from pyspark.sql import functions as fn

    body = fn.expr(_TLE.replace("AS VARCHAR", "AS STRING"))
    return t.table("orders").select(
        fn.col("o_orderkey").alias("id"), "o_totalprice", fn.rpad(body, 68, " ").alias("body")
    )


@query(
    "tle_guard",
    "X07",
    f"""WITH b AS (SELECT o_orderkey AS id, o_totalprice, rpad({_TLE}, 68, ' ') AS body FROM orders),
    c AS (SELECT id, body, length(regexp_replace(body, '[^-]', '', 'g')) + CAST(list_sum(list_transform(regexp_extract_all(body, '[0-9]'), lambda x: CAST(x AS INTEGER))) AS INTEGER) AS tot FROM b),
    l AS (SELECT id, CASE WHEN id % 5 = 0 THEN substring(body, 1, 60) ELSE concat(body, tot % 10) END AS line, tot % 10 AS checksum FROM c)
    SELECT id, checksum, length(line) = 69 AS valid, trim(substring(line, 3, 5)) AS catalog,
      CASE WHEN id % 3 = 0 THEN NULL ELSE concat(line, '|', '2 x') END AS body_lines FROM l""",
)
def tle_guard(t: Tables) -> DataFrame:
    sums = tle_lines(t).withColumn("checksum", sc.tle_checksum(F.col("body")))
    lines = sums.withColumn(
        "line",
        F.when(F.col("id") % 5 == 0, F.substring("body", 1, 60)).otherwise(
            F.concat("body", F.col("checksum").cast("string"))
        ),
    )
    # One line too many in every third text.
    text = F.concat(
        F.when(F.col("id") % 3 == 0, "a\nb\n").otherwise("NAME\n\n"), F.col("line"), F.lit("\r\n2 x  \n")
    )
    return lines.select(
        "id", "checksum", sc.tle_line_valid(F.col("line"), 1).alias("valid"),
        F.trim(F.substring("line", 3, 5)).alias("catalog"),
        F.array_join(sc.tle_body(text), "|").alias("body_lines"),
    )


_Z = "(residual_hz / sigma_hz / 50)"
_RHO = {
    "linear": f"{_Z}*{_Z}",
    "soft_l1": f"2 * (sqrt(1 + {_Z}*{_Z}) - 1)",
    "huber": f"CASE WHEN {_Z}*{_Z} <= 1 THEN {_Z}*{_Z} ELSE 2 * abs({_Z}) - 1 END",
    "cauchy": f"ln(1 + {_Z}*{_Z})",
    "arctan": f"atan({_Z}*{_Z})",
}


@query(
    "robust_loss",
    "X08 X09 A30",
    f"WITH @residuals SELECT fit_id, {', '.join(rd(f'1250.0 * sum({sql})', 2) + f' AS {k}' for k, sql in _RHO.items())}, {rd(f'sum(pow(1 + {_Z}*{_Z}, -0.75))', 5)} AS weight FROM residuals GROUP BY 1",
)
def robust_loss(t: Tables) -> DataFrame:
    from passledger.operators.estimate import robust_cost

    white = t.residuals.withColumn("white", F.col("residual_hz") / F.col("sigma_hz"))
    return white.groupBy("fit_id").agg(
        *[r(robust_cost(F.col("white"), k, 50.0), 2).alias(k) for k in _RHO],
        r(F.sum(sc.curvature_weight(F.col("white"), "soft_l1", 50.0)), 5).alias("weight"),
    )


_LEAP = "CASE " + " ".join(f"WHEN {{0}} >= {s} THEN {n}" for s, n in reversed(sc.LEAP_SECONDS)) + " END"


@query(
    "gps_epoch",
    "X10",
    f"""WITH p AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) / 1000 AS packet_ms, CASE WHEN o_orderkey % 50 = 0 THEN 700000000.0 ELSE o_orderkey * 7919.0 % 604800000 END AS sow_ms FROM orders),
    a AS (SELECT *, packet_ms / 1000 + {_LEAP.format('packet_ms / 1000')} - 19 - 315964800 AS now_s FROM p),
    g AS (SELECT *, round_even((now_s - sow_ms / 1000) / 604800, 0) * 604800 + sow_ms / 1000 + 315964800 AS gps FROM a),
    u AS (SELECT *, gps - ({_LEAP.format('gps')} - 19) AS utc FROM g)
    SELECT id, CASE WHEN sow_ms < 604800000 THEN round(gps - ({_LEAP.format('utc')} - 19), 3) END AS epoch_unix_s FROM u""",
)
def gps_epoch(t: Tables) -> DataFrame:
    frame = t.table("orders").selectExpr(
        "o_orderkey AS id", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) / 1000 AS packet_ms",
        "CASE WHEN o_orderkey % 50 = 0 THEN 700000000.0D ELSE o_orderkey * 7919.0D % 604800000 END AS sow_ms",
    )
    epoch = sc.gps_epoch(F.col("packet_ms"), F.col("sow_ms"))
    return frame.select("id", F.round(epoch, 3).alias("epoch_unix_s"))


@query(
    "time_text",
    "X11 X13",
    f"""WITH @telemetry, z AS (SELECT event_id, ts_us, make_timestamp(ts_us) AS d FROM telemetry)
    SELECT event_id, strftime(d, '%Y-%m-%dT%H:%M:%S.%fZ') AS query_text, strftime(d, '%Y-%m-%dT%H:%M:%S.%f') AS product_text,
      concat(strftime(d, '%d %b %Y %H:%M:%S.'), substring(strftime(d, '%f'), 1, 3)) AS gregorian_text,
      ts_us AS parsed_us, ts_us - ts_us % 1000000 AS parsed_second_us, NULL::BIGINT AS parsed_junk_us, {rd('ts_us / 1e6 / 86400.0 + 40587.0 - 29999.5')} AS utc_mjd, {rd('(ts_us / 1e6 + 37) / 86400.0 + 40587.0 - 29999.5')} AS tai_mjd FROM z""",
)
def time_text(t: Tables) -> DataFrame:
    us = F.col("ts_us")
    seconds = F.concat(F.substring(sc.micros_to_text(us, "query"), 1, 19), F.lit("Z"))
    junk = F.concat(F.lit("not a time "), F.col("event_id").cast("string"))
    return t.telemetry.select(
        "event_id",
        sc.micros_to_text(us, "query").alias("query_text"),
        sc.micros_to_text(us, "product").alias("product_text"),
        sc.micros_to_text(us, "gregorian").alias("gregorian_text"),
        sc.text_to_micros(sc.micros_to_text(us, "query")).alias("parsed_us"),
        sc.text_to_micros(seconds).alias("parsed_second_us"),
        sc.text_to_micros(junk).alias("parsed_junk_us"),
        r(sc.utc_mjd(us / 1e6)).alias("utc_mjd"),
        r(sc.tai_mjd(us / 1e6)).alias("tai_mjd"),
    )


@query(
    "safe_coercion",
    "X12",
    """SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number,
      CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false WHEN 'purchase' THEN NULL WHEN 'error' THEN false ELSE true END AS flag,
      CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN event_type ELSE concat(event_type, ',', user_id) END AS joined FROM events""",
)
def safe_coercion(t: Tables) -> DataFrame:
    word = F.expr(
        "CASE event_type WHEN 'click' THEN ' Yes ' WHEN 'view' THEN 'off' WHEN 'purchase' THEN 'maybe' WHEN 'error' THEN NULL ELSE 'ON' END"
    )
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    left = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    right = F.when(F.col("event_id") % 4 >= 2, F.col("user_id").cast("string"))
    return t.table("events").select(
        "event_id", raw.try_cast("double").alias("number"), sc.parse_boolean(word).alias("flag"),
        sc.join_present(F.array(left, right)).alias("joined"),
    )


_E2 = 0.0066943799901413165


@query(
    "geodetic_to_ecef",
    "X14",
    f"""WITH g AS (SELECT c_custkey AS id, radians(c_custkey % 179 - 89) AS la, radians(c_custkey * 7 % 360 - 180) AS lo, c_acctbal AS al FROM customer),
    n AS (SELECT *, 6378137.0 / sqrt(1 - {_E2} * sin(la) * sin(la)) AS b FROM g)
    SELECT id, {rd('(b + al) * cos(la) * cos(lo)', 4)} AS x, {rd('(b + al) * cos(la) * sin(lo)', 4)} AS y, {rd(f'(b * (1 - {_E2}) + al) * sin(la)', 4)} AS z FROM n""",
)
def geodetic_to_ecef(t: Tables) -> DataFrame:
    lat = (F.col("c_custkey") % 179 - 89).cast("double")
    lon = (F.col("c_custkey") * 7 % 360 - 180).cast("double")
    xyz = geo.geodetic_to_ecef(lat, lon, F.col("c_acctbal"))
    return t.table("customer").select(
        F.col("c_custkey").alias("id"), *[r(v, 4).alias(n) for v, n in zip(xyz, "xyz")]
    )


@query(
    "station_inertial",
    "X15",
    f"""WITH @telemetry, a AS (SELECT event_id, 6378137.0 * cos(radians(event_id % 360)) AS ex, 6378137.0 * sin(radians(event_id % 360)) AS ey,
       0.7790572732640 + (ts_us / 1e6 - 946728000.0) / 86400.0 * 1.00273781191135448 AS turns FROM telemetry),
    b AS (SELECT *, (turns - floor(turns)) * (2 * 3.141592653589793) AS era FROM a)
    SELECT event_id, {rd('cos(era) * ex - sin(era) * ey', 1)} AS x, {rd('sin(era) * ex + cos(era) * ey', 1)} AS y, {rd('-7.292115146706979e-5 * (sin(era) * ex + cos(era) * ey)', 4)} AS vx FROM b""",
)
def station_inertial(t: Tables) -> DataFrame:
    angle = F.radians((F.col("event_id") % 360).cast("double"))
    ecef = [6378137.0 * F.cos(angle), 6378137.0 * F.sin(angle), F.lit(0.0)]
    position, velocity = geo.station_inertial(ecef, F.col("ts_us") / 1e6)
    return t.telemetry.select(
        "event_id", r(position[0], 1).alias("x"), r(position[1], 1).alias("y"), r(velocity[0], 4).alias("vx")
    )


@query(
    "solution_identity",
    "X18",
    """SELECT o_orderkey AS id, sha256(concat('{"model":"sgp4","source":"E', o_custkey, '","epoch_us":', epoch_us(o_orderdate), ',"values":[', o_orderkey, ',', o_custkey, ']}')) AS solution_id FROM orders""",
)
def solution_identity(t: Tables) -> DataFrame:
    from passledger.operators.estimate import solution_identity as identity

    return t.table("orders").select(
        F.col("o_orderkey").alias("id"),
        identity(
            F.lit("sgp4"), F.concat(F.lit("E"), "o_custkey"),
            F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP))"), F.array("o_orderkey", "o_custkey"),
        ).alias("solution_id"),
    )


@query(
    "decimal_frequency",
    "X19",
    """WITH f AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(2200000000 AS DECIMAL(20,9)) - CAST(round(l_extendedprice, 2) AS DECIMAL(20,9)) * CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 1000 END AS v FROM lineitem)
    SELECT id, line, CASE WHEN v > 0 THEN CAST(CAST(v AS DECIMAL(30,6)) AS VARCHAR) END AS frequency FROM f""",
)
def decimal_frequency(t: Tables) -> DataFrame:
    value = F.round("l_extendedprice", 2)
    small = sc.scaled_frequency(F.lit(2200000000), value, 1000, -1)
    large = sc.scaled_frequency(F.lit(2200000000), value, 1000000, -1)
    chosen = F.when(F.col("l_linenumber") == 7, large).otherwise(small)
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        chosen.cast("decimal(38,6)").cast("string").alias("frequency"),
    )


@query(
    "active_bounds",
    "X20",
    """SELECT l_orderkey AS id, l_linenumber AS line, concat_ws(';', CASE WHEN least(l_quantity - 1, 50 - l_quantity) <= 1e-6 THEN 'quantity' END,
      CASE WHEN least(l_tax, 0.08 - l_tax) <= 1e-8 THEN 'tax' END) AS active FROM lineitem""",
)
def active_bounds(t: Tables) -> DataFrame:
    from passledger.operators.estimate import active_bounds as listed

    def spec(name, value, low, high, scale):
        return F.struct(
            F.lit(name).alias("name"), value.alias("value"), F.lit(low).alias("lower_bound"),
            F.lit(high).alias("upper_bound"), F.lit(scale).alias("scale"),
        )

    parameters = F.array(
        spec("quantity", F.col("l_quantity"), 1.0, 50.0, 1.0), spec("tax", F.col("l_tax"), 0.0, 0.08, 0.01)
    )
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.array_join(listed(parameters), ";").alias("active"),
    )


_NAMES = list(sc.PARAMETER_UNITS)


@query(
    "parameter_units",
    "X21",
    f"""WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 16 THEN 'unknown' WHEN o_orderkey % 17 = 15 THEN concat('pass_bias_hz:P', o_orderkey)
       ELSE [{', '.join(repr(n) for n in _NAMES)}][o_orderkey % 17 + 1] END AS name FROM orders)
    SELECT id, CASE WHEN starts_with(name, 'pass_bias_hz:') THEN 'Hz' ELSE map_extract(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in sc.PARAMETER_UNITS.items())}}}, name)[1] END AS unit FROM n""",
)
def parameter_units(t: Tables) -> DataFrame:
    place = (F.col("o_orderkey") % 17).cast("int")
    known = F.array(*[F.lit(n) for n in _NAMES])
    name = (
        F.when(place == 16, "unknown")
        .when(place == 15, F.concat(F.lit("pass_bias_hz:P"), "o_orderkey"))
        .otherwise(F.try_element_at(known, place + 1))
    )
    return t.table("orders").select(F.col("o_orderkey").alias("id"), sc.parameter_unit(name).alias("unit"))


@query(
    "named_vector",
    "X22",
    """SELECT o_orderkey AS id, concat('{"custkey":', o_custkey, ',"order":', o_orderkey, ',"twice":', 2 * o_orderkey, '}') AS parameters FROM orders""",
)
def named_vector(t: Tables) -> DataFrame:
    names = F.array(F.lit("twice"), F.lit("order"), F.lit("custkey"))
    values = F.array(2 * F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_custkey"))
    return t.table("orders").select(
        F.col("o_orderkey").alias("id"), sc.named_values_json(names, values).alias("parameters")
    )


@query(
    "slew_step",
    "X23",
    f"""WITH v AS (SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice / 10000 - 4 AS rw, l_quantity / 25 - 1 AS ap, l_tax * 100 AS dt FROM lineitem)
    SELECT id, line, {rd('least(greatest(least(greatest(rw, -5.0), 5.0), ap - least(0.5, 0.1 * dt)), ap + least(0.5, 0.1 * dt))')} AS requested FROM v""",
)
def slew_step(t: Tables) -> DataFrame:
    step = sc.slew_step(
        F.col("l_extendedprice") / 10000 - 4, F.col("l_quantity") / 25 - 1, F.col("l_tax") * 100,
        limit_s=5.0, step_s=0.5, rate=0.1,
    )
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), r(step).alias("requested")
    )


@query(
    "freshness",
    "X24 R07",
    """WITH @telemetry SELECT event_id, (event_id * 7 % 12 - 2) BETWEEN 0 AND 5 AS usable FROM telemetry""",
)
def freshness(t: Tables) -> DataFrame:
    arrived = F.col("ts_us") + (F.col("event_id") * 7 % 12 - 2) * 1_000_000
    return t.telemetry.select("event_id", sc.fresh(F.col("ts_us"), arrived, 5.0).alias("usable"))


@query(
    "sweep_values",
    "X25 X26",
    f"""WITH b AS (SELECT o_orderkey AS id, -(o_orderkey % 5 + 1.0) AS lo, o_orderkey % 4 + 1.25 AS hi, 0.5 AS st FROM orders),
    s AS (SELECT id, hi, list_transform(range(0, CAST(floor((hi - lo) / st) AS BIGINT) + 1), lambda i: CAST(lo + i * st AS DOUBLE)) AS g,
       list_sort(list_distinct(list_concat(list_transform(range(0, CAST(ceil((hi - lo) / st) AS BIGINT)), lambda i: CAST(lo + i * st AS DOUBLE)), [CAST(hi AS DOUBLE), 0.0::DOUBLE]))) AS c FROM b),
    z AS (SELECT id, CASE WHEN g[-1] < hi - 1e-6 THEN list_append(g, CAST(hi AS DOUBLE)) ELSE g END AS g, c FROM s)
    SELECT id, len(g) AS probes, {rd('list_sum(g)')} AS probe_sum, len(c) AS candidates, {rd('list_sum(c)')} AS candidate_sum, c[1] AS first_candidate FROM z""",
)
def sweep_values(t: Tables) -> DataFrame:
    bounds = t.table("orders").selectExpr(
        "o_orderkey AS id", "-(o_orderkey % 5 + 1.0D) AS lo", "o_orderkey % 4 + 1.25D AS hi"
    )
    step = F.lit(0.5)
    probes = sc.sweep_values(F.col("lo"), F.col("hi"), step)
    candidates = sc.timing_candidates(F.col("lo"), F.col("hi"), step)

    def total(values):
        return r(F.aggregate(values, F.lit(0.0), lambda a, x: a + x))

    return bounds.select(
        "id", F.size(probes).cast("long").alias("probes"), total(probes).alias("probe_sum"),
        F.size(candidates).cast("long").alias("candidates"), total(candidates).alias("candidate_sum"),
        F.element_at(candidates, 1).alias("first_candidate"),
    )


@query(
    "prior_provenance",
    "X27",
    f"""WITH b AS (SELECT o_orderkey AS id, concat('SAT', chr(10), rpad({_TLE}, 68, ' '), chr(10), '2 ', o_custkey) AS text, concat(rpad({_TLE}, 68, ' '), chr(10), '2 ', o_custkey) AS lines, epoch_us(o_orderdate) AS us FROM orders)
    SELECT id, sha256(lines) AS tle_lines_sha256, sha256(text) AS source_text_sha256, us AS available_us FROM b""",
)
def prior_provenance(t: Tables) -> DataFrame:
    from passledger.sources.products import prior_provenance as provenance

    texts = tle_lines(t).join(
        t.table("orders").selectExpr(
            "o_orderkey AS id", "o_custkey", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS submitted_us"
        ),
        "id",
    ).select(
        "id", F.concat_ws("\n", F.lit("SAT"), "body", F.concat(F.lit("2 "), "o_custkey")).alias("tle"), "submitted_us"
    )
    return provenance(texts).select("id", "tle_lines_sha256", "source_text_sha256", "available_us")


