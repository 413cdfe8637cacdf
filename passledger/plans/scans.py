"""Queries for scans, selection and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.operators import selectors as sel
from passledger.plans.registry import query
from passledger.plans.standins import HOUR_US, ORIGIN_US, Tables
from passledger.session import scratch_path
from passledger.sources import measurements as ms


def _provider_frame(t: Tables) -> DataFrame:
    """The telemetry as a provider would deliver it."""
    names = {v: k for k, v in ms.PROVIDER_COLUMNS.items()}
    return (
        t.telemetry.withColumn("timestamp", F.timestamp_micros("ts_us"))
        .withColumn("antenna_name", F.concat(F.lit("Antenna "), "system_id"))
        .withColumn("tracking_epoch_offset_s", F.lit(None).cast("string"))
        .withColumnsRenamed(names)
    )


def _plain(column: str):
    """NaN shown as null, so both engines print the row alike."""
    return F.when(~F.isnan(column), F.col(column)).alias(column)


@query(
    "canonical_frame",
    "S01 S02 S04",
    """
    WITH @telemetry SELECT ts_us, contact_id, spacecraft_id, system_id,
      concat('Antenna ', system_id) AS antenna_name,
      CAST(NULL AS DOUBLE) AS tracking_epoch_offset_s, azimuth_deg, elevation_deg,
      carrier_lock, ebn0, CASE WHEN NOT isnan(doppler_hz) THEN doppler_hz END AS doppler_hz
    FROM telemetry""",
)
def canonical_frame(t: Tables) -> DataFrame:
    frame = ms.canonical_measurements(ms.rename_provider_columns(_provider_frame(t)))
    good, _ = ms.split_identity(frame)
    return good.select(
        F.unix_micros("timestamp").alias("ts_us"),
        *[f.name for f in ms.MEASUREMENTS.fields[1:-1]],
        _plain("doppler_hz"),
    )


@query(
    "identity_quarantine",
    "S02",
    """
    WITH @telemetry, d AS (SELECT ts_us,
        CASE WHEN event_id % 41 = 0 THEN NULL ELSE contact_id END AS contact_id,
        CASE WHEN event_id % 43 = 0 THEN NULL ELSE system_id END AS system_id FROM telemetry)
    SELECT contact_id IS NULL AS no_contact, system_id IS NULL AS no_system, count(*) AS n
    FROM d WHERE contact_id IS NULL OR system_id IS NULL GROUP BY 1, 2""",
)
def identity_quarantine(t: Tables) -> DataFrame:
    damaged = _provider_frame(t).withColumns(
        {
            "contact_id": F.when(F.col("event_id") % 41 != 0, F.col("contact_id")),
            "system_id": F.when(F.col("event_id") % 43 != 0, F.col("system_id")),
        }
    )
    _, bad = ms.split_identity(ms.canonical_measurements(ms.rename_provider_columns(damaged)))
    return bad.groupBy(
        F.col("contact_id").isNull().alias("no_contact"),
        F.col("system_id").isNull().alias("no_system"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "contact_scan",
    "S03",
    f"""
    WITH @telemetry SELECT ts_us, system_id, elevation_deg, carrier_lock FROM telemetry
    WHERE contact_id = 'C7-1' AND ts_us BETWEEN {ORIGIN_US + 240 * HOUR_US} AND {ORIGIN_US + 400 * HOUR_US}""",
)
def contact_scan(t: Tables) -> DataFrame:
    return ms.contact_scan(
        t.telemetry,
        "C7-1",
        F.lit(ORIGIN_US + 240 * HOUR_US),
        F.lit(ORIGIN_US + 400 * HOUR_US),
        ["ts_us", "system_id", "elevation_deg", "carrier_lock", "ts_us"],
        order_by="ts_us",
    )


@query(
    "multi_pass_load",
    "S05",
    """
    WITH @telemetry, @contacts,
    req AS (SELECT c_custkey AS ordinal, concat('C', c_custkey, '-', c_custkey % 4) AS contact_id FROM customer),
    d AS (SELECT contact_id, count(*) AS samples,
        count(DISTINCT CASE WHEN event_id % 211 = 0 THEN 'X' ELSE system_id END) AS systems FROM telemetry GROUP BY 1)
    SELECT ordinal, req.contact_id, coalesce(samples, 0) AS samples,
      CASE WHEN c.spacecraft_id IS NULL THEN 'unknown_contact'
           WHEN systems > 1 THEN 'system_mismatch' ELSE 'loaded' END AS status
    FROM req LEFT JOIN contacts c ON c.contact_id = req.contact_id LEFT JOIN d ON d.contact_id = req.contact_id
    """,
)
def multi_pass_load(t: Tables) -> DataFrame:
    requests, delivered = _requests(t)
    return ms.load_passes(requests, t.contacts, delivered)


def _requests(t: Tables) -> tuple[DataFrame, DataFrame]:
    requests = t.table("customer").select(
        F.col("c_custkey").alias("ordinal"),
        F.concat_ws(
            "", F.lit("C"), F.col("c_custkey"), F.lit("-"), F.col("c_custkey") % 4
        ).alias("contact_id"),
    )
    delivered = t.telemetry.withColumn(
        "system_id", F.when(F.col("event_id") % 211 == 0, "X").otherwise(F.col("system_id"))
    )
    return requests, delivered


@query(
    "multi_pass_rows",
    "S05",
    """
    WITH @telemetry, @contacts,
    req AS (SELECT c_custkey AS ordinal, concat('C', c_custkey, '-', c_custkey % 4) AS contact_id FROM customer),
    d AS (SELECT contact_id, count(DISTINCT CASE WHEN event_id % 211 = 0 THEN 'X' ELSE system_id END) AS systems FROM telemetry GROUP BY 1)
    SELECT ordinal, t.contact_id, t.event_id, t.ts_us, t.elevation_deg
    FROM req JOIN contacts c ON c.contact_id = req.contact_id JOIN d ON d.contact_id = req.contact_id AND systems = 1 JOIN telemetry t ON t.contact_id = req.contact_id
    """,
)
def multi_pass_rows(t: Tables) -> DataFrame:
    requests, delivered = _requests(t)
    rows = ms.load_rows(requests, t.contacts, delivered, strict=False)
    return rows.select("ordinal", "contact_id", "event_id", "ts_us", "elevation_deg")


@query(
    "measurement_files",
    "S01 S04",
    f"""
    WITH @telemetry SELECT contact_id, ts_us, elevation_deg, carrier_lock, CASE WHEN NOT isnan(doppler_hz) THEN doppler_hz END AS doppler_hz FROM telemetry
    WHERE contact_id = 'C7-1' AND ts_us BETWEEN {ORIGIN_US + 240 * HOUR_US} AND {ORIGIN_US + 400 * HOUR_US}""",
)
def measurement_files(t: Tables) -> DataFrame:
    """A provider's files, read by their path; a bounded fetch of one contact reaches the scan as a filter."""
    path = scratch_path(t.spark, "provider")
    _provider_frame(t).write.partitionBy("spacecraft_id").parquet(path)
    frame = ms.read_measurements(t.spark, path)
    start, stop = (F.timestamp_micros(F.lit(ORIGIN_US + h * HOUR_US)) for h in (240, 400))
    kept = ms.contact_scan(
        frame, "C7-1", start, stop, ["contact_id", "timestamp", "elevation_deg", "carrier_lock", "doppler_hz"], order_by="timestamp", time_column="timestamp"
    )
    return kept.select("contact_id", F.unix_micros("timestamp").alias("ts_us"), "elevation_deg", "carrier_lock", _plain("doppler_hz"))


_META = ["spacecraft_id", "system_id", "station_id", "tle_line1", "tle_line2"]


@query(
    "derive_contacts",
    "S06",
    """
    WITH @telemetry, r AS (SELECT *, concat('station ', system_id) AS station_id,
      concat('1 ', lpad(substring(spacecraft_id, 2), 5, '0'), 'U') AS tle_line1,
      concat('2 ', lpad(CASE WHEN event_id % 977 = 0 THEN '9' ELSE substring(spacecraft_id, 2) END, 5, '0')) AS tle_line2
      FROM telemetry)
    SELECT contact_id, min(ts_us) AS start_us, max(ts_us) AS stop_us, min(spacecraft_id) AS spacecraft_id,
      min(system_id) AS system_id, min(station_id) AS station_id, min(tle_line1) AS tle_line1, min(tle_line2) AS tle_line2,
      concat('parquet:tle:', sha256(min(concat(tle_line1, chr(10), tle_line2)))) AS prior_id,
      trim(substring(min(tle_line1), 3, 5)) AS catalog,
      CASE WHEN count(DISTINCT tle_line2) > 1 THEN 'metadata_varies' ELSE '' END AS reason
    FROM r GROUP BY contact_id""",
)
def derive_contacts(t: Tables) -> DataFrame:
    craft = F.substring("spacecraft_id", 2, 9)
    odd = F.when(F.col("event_id") % 977 == 0, "9").otherwise(craft)
    recorded = t.telemetry.withColumns(
        {
            "station_id": F.concat(F.lit("station "), "system_id"),
            "tle_line1": F.concat(F.lit("1 "), F.lpad(craft, 5, "0"), F.lit("U")),
            "tle_line2": F.concat(F.lit("2 "), F.lpad(odd, 5, "0")),
        }
    )
    return ms.contacts_from_telemetry(recorded, _META)


@query(
    "model_input_rows",
    "S24",
    """
    WITH @passes, c AS (SELECT pass_no // 6 AS fit_id, pass_no % 6 AS ordinal, contact_id, system_id, pass_no FROM passes),
    f AS (SELECT fit_id, system_id, min(ordinal) AS seen FROM c GROUP BY 1, 2),
    rx AS (SELECT *, dense_rank() OVER (PARTITION BY fit_id ORDER BY seen) - 1 AS receiver_index FROM f),
    p AS (SELECT *, dense_rank() OVER (PARTITION BY fit_id ORDER BY ordinal) - 1 AS pass_index FROM c)
    SELECT p.fit_id, l_orderkey AS observation, l_linenumber AS line, receiver_index, pass_index, 4.0::DOUBLE AS variance_hz2
    FROM p JOIN rx ON rx.fit_id = p.fit_id AND rx.system_id = p.system_id JOIN lineitem ON l_orderkey = p.pass_no""",
)
def model_input_rows(t: Tables) -> DataFrame:
    contacts = t.passes.select(
        F.floor(F.col("pass_no") / 6).alias("fit_id"),
        (F.col("pass_no") % 6).alias("ordinal"),
        "contact_id",
        "system_id",
    )
    observations = t.table("lineitem").select(
        F.concat(F.lit("P"), "l_orderkey").alias("contact_id"),
        F.col("l_orderkey").alias("observation"),
        F.col("l_linenumber").alias("line"),
    )
    return ms.model_input_rows(contacts, observations, 4.0).drop("contact_id")


def _selected(name: str, operators: str, condition, where: str) -> None:
    """One query per selector: kept rows and their sums by contact."""

    @query(
        name,
        operators,
        f"""
        WITH @telemetry SELECT contact_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, min(ts_us) AS first_us
        FROM telemetry WHERE {where} GROUP BY contact_id""",
    )
    def run(t: Tables) -> DataFrame:
        return (
            t.telemetry.where(condition())
            .groupBy("contact_id")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum("event_id").alias("ids"),
                F.min("ts_us").alias("first_us"),
            )
        )


_LOCKED = "carrier_lock = 'Locked' AND isfinite(doppler_hz)"
_selected("select_locked", "F01 D01", sel.locked_finite, _LOCKED)
_selected(
    "select_timing",
    "F02",
    sel.timing,
    "isfinite(doppler_hz) AND abs(doppler_hz) >= 0.1 AND elevation_deg > 1 AND elevation_deg < 89",
)
_selected(
    "select_quality",
    "F03",
    lambda: sel.QualityRule().column(),
    f"{_LOCKED} AND isfinite(ebn0) AND ebn0 >= 3 AND abs(doppler_hz) < 100000",
)
_selected("select_strict", "F04", sel.strict, f"{_LOCKED} AND isfinite(ebn0) AND ebn0 > 5")


@query(
    "selector_dispatch",
    "F06 D01",
    f"""
    WITH @telemetry SELECT 'default' AS rule, count(*) AS n FROM telemetry WHERE {_LOCKED}
    UNION ALL SELECT 'gated', count(*) FROM telemetry WHERE {_LOCKED} AND ebn0 >= 6 AND abs(doppler_hz) < 40000
    UNION ALL SELECT 'explicit', count(*) FROM telemetry WHERE isfinite(doppler_hz) AND abs(doppler_hz) >= 0.1
      AND elevation_deg > 1 AND elevation_deg < 89""",
)
def selector_dispatch(t: Tables) -> DataFrame:
    frame = t.telemetry
    variants = {
        "default": sel.rows_to_fit(frame),
        "gated": sel.rows_to_fit(frame, sel.QualityRule(6.0, 40_000.0)),
        "explicit": sel.rows_to_fit(frame, lambda d: d.where(sel.timing())),
    }
    parts = [
        kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        for rule, kept in variants.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "select_by_request",
    "F05",
    """
    WITH @telemetry, q AS (SELECT c_custkey AS request_id, concat('C', c_custkey, '-', g) AS contact_id,
      CAST(c_nationkey AS DOUBLE) AS min_elevation_deg, CAST(c_custkey % 5000 AS DOUBLE) AS min_abs_doppler_hz, 60000.0 AS max_abs_doppler_hz,
      CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 2.0 END AS min_ebn0_db
      FROM customer, (SELECT unnest([0, 1, 2]) AS g))
    SELECT request_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM telemetry JOIN q USING (contact_id)
    WHERE isfinite(doppler_hz) AND elevation_deg >= min_elevation_deg
      AND abs(doppler_hz) BETWEEN min_abs_doppler_hz AND max_abs_doppler_hz
      AND (min_ebn0_db IS NULL OR ebn0 >= min_ebn0_db) GROUP BY request_id""",
)
def select_by_request(t: Tables) -> DataFrame:
    from passledger.operators.ranges import salted_join

    requests = (
        t.table("customer")
        .select(
            F.col("c_custkey").alias("request_id"),
            F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("_g"),
            F.col("c_nationkey").cast("double").alias("min_elevation_deg"),
            (F.col("c_custkey") % 5000).cast("double").alias("min_abs_doppler_hz"),
            F.lit(60000.0).alias("max_abs_doppler_hz"),
            F.when(F.col("c_custkey") % 3 != 0, 2.0).alias("min_ebn0_db"),
        )
        .withColumn(
            "contact_id", F.concat_ws("", F.lit("C"), "request_id", F.lit("-"), F.col("_g"))
        )
        .drop("_g")
    )
    joined = salted_join(t.telemetry, requests, ["contact_id"], F.col("event_id"), salts=4)
    return (
        joined.where(sel.by_request())
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    )


_COUNTS = f"""
    WITH @telemetry, @contacts, n AS (SELECT contact_id, count(*) AS raw_samples,
      count(*) FILTER ({_LOCKED}) AS locked_samples,
      count(*) FILTER ({_LOCKED} AND ebn0 >= 3 AND abs(doppler_hz) < 100000) AS retained_samples
      FROM telemetry GROUP BY contact_id)"""
_REASON = """CASE WHEN retained_samples >= 20 THEN ''
      ELSE concat(retained_samples, ' of 20') END"""


@query(
    "selection_counts",
    "A01",
    f"""{_COUNTS}, w AS (SELECT contact_id FROM contacts UNION ALL SELECT concat('N', c_custkey) FROM customer)
    SELECT w.contact_id, coalesce(raw_samples, 0) AS raw_samples, coalesce(locked_samples, 0) AS locked_samples,
      coalesce(retained_samples, 0) AS retained_samples FROM w LEFT JOIN n ON n.contact_id = w.contact_id""",
)
def selection_counts(t: Tables) -> DataFrame:
    absent = t.table("customer").select(F.concat(F.lit("N"), "c_custkey").alias("contact_id"))
    wanted = t.contacts.select("contact_id").unionByName(absent)
    return sel.selection_counts(wanted, t.telemetry, sel.QualityRule().column())


@query(
    "pass_gate",
    "A02",
    f"""{_COUNTS} SELECT c.contact_id, raw_samples, locked_samples, retained_samples, {_REASON} AS reason
    FROM contacts c JOIN n ON n.contact_id = c.contact_id""",
)
def pass_gate(t: Tables) -> DataFrame:
    counts = sel.selection_counts(t.contacts.select("contact_id"), t.telemetry, sel.QualityRule().column())
    return counts.withColumn("reason", sel.gate_reason(20))


@query(
    "inventory",
    "A03",
    f"""{_COUNTS}, tn AS (SELECT contact_id, count(*) FILTER (isfinite(doppler_hz) AND abs(doppler_hz) >= 0.1
        AND elevation_deg > 1 AND elevation_deg < 89) AS timing_samples FROM telemetry GROUP BY 1)
    SELECT c.contact_id, start_us, raw_samples, retained_samples, locked_samples,
      locked_samples - retained_samples AS quality_excluded_samples, raw_samples - retained_samples AS excluded_samples,
      {_REASON} AS exclusion_reason, timing_samples,
      CASE WHEN timing_samples >= 301 THEN '' ELSE concat(timing_samples, ' timing samples; need 301') END AS timing_reason
    FROM contacts c JOIN n ON n.contact_id = c.contact_id JOIN tn ON tn.contact_id = c.contact_id""",
)
def inventory(t: Tables) -> DataFrame:
    counts = sel.selection_counts(
        t.contacts.select("contact_id", "start_us"), t.telemetry, sel.QualityRule().column()
    )
    timing = t.telemetry.groupBy("contact_id").agg(F.count_if(sel.timing()).alias("timing_samples"))
    return (
        counts.join(timing, "contact_id")
        .select(
            "contact_id",
            "start_us",
            "raw_samples",
            "retained_samples",
            "locked_samples",
            (F.col("locked_samples") - F.col("retained_samples")).alias("quality_excluded_samples"),
            (F.col("raw_samples") - F.col("retained_samples")).alias("excluded_samples"),
            sel.gate_reason(20).alias("exclusion_reason"),
            "timing_samples",
            F.when(F.col("timing_samples") >= 301, "")
            .otherwise(F.concat_ws("", "timing_samples", F.lit(" timing samples; need 301")))
            .alias("timing_reason"),
        )
        .orderBy("start_us", "contact_id")
    )


@query(
    "contact_window_check",
    "F07",
    """
    WITH @telemetry, @contacts, m AS (SELECT contact_id, ts_us, CASE WHEN event_id % 211 = 0 THEN 'X' ELSE system_id END AS system_id,
        spacecraft_id FROM telemetry)
    SELECT c.contact_id, count(*) FILTER (m.spacecraft_id <> c.spacecraft_id) AS wrong_spacecraft,
      count(*) FILTER (m.system_id <> c.system_id) AS wrong_system,
      count(*) FILTER (m.ts_us NOT BETWEEN c.start_us + 3600000000 AND c.stop_us) AS outside,
      bool_and(m.ts_us BETWEEN c.start_us + 3600000000 AND c.stop_us AND m.system_id = c.system_id) AS accepted
    FROM contacts c JOIN m ON m.contact_id = c.contact_id GROUP BY c.contact_id""",
)
def contact_window_check(t: Tables) -> DataFrame:
    from passledger.operators.joins import window_violations

    window = t.contacts.withColumn("start_us", F.col("start_us") + HOUR_US)
    measured = t.telemetry.withColumn(
        "system_id", F.when(F.col("event_id") % 211 == 0, "X").otherwise(F.col("system_id"))
    )
    return window_violations(window, measured)


@query(
    "gps_timing_screen",
    "F08",
    """
    WITH g AS (SELECT l_orderkey AS packet, l_linenumber AS line, epoch_us(l_shipdate) AS packet_us,
      CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE epoch_us(l_shipdate) + (l_partkey % 300 - 150) * 1000000 END AS ep_us,
      l_partkey % 23 = 0 AS conflict FROM lineitem)
    SELECT CASE WHEN ep_us IS NULL THEN 'no_receiver_epoch' WHEN conflict THEN 'receiver_epoch_conflict'
      WHEN abs(packet_us - ep_us) > 120000000 THEN 'packet_latency' ELSE 'kept' END AS reason,
      count(*) AS n, CAST(sum(packet) AS BIGINT) AS packets FROM g GROUP BY 1""",
)
def gps_timing_screen(t: Tables) -> DataFrame:
    packet = F.expr("unix_micros(CAST(l_shipdate AS TIMESTAMP))")
    epoch = F.when(
        F.col("l_partkey") % 19 != 0, packet + (F.col("l_partkey") % 300 - 150) * 1_000_000
    )
    reason = sel.timing_rejection(packet, epoch, F.col("l_partkey") % 23 == 0)
    return (
        t.table("lineitem")
        .groupBy(F.coalesce(reason, F.lit("kept")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("packets"))
    )


_GPS = """
    g AS (SELECT l_orderkey AS packet, l_linenumber AS line,
      CASE WHEN l_partkey % 29 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 6750 + l_quantity * 8 END AS x,
      l_discount * 100 AS y, l_tax * 100 AS z,
      l_discount / 2 AS sx, l_tax / 2 + 0.001 AS sy, 0.01 AS sz,
      4.5 + l_quantity / 8 AS vx, l_discount AS vy, l_tax AS vz,
      l_discount AS svx, l_tax + 0.001 AS svy, 0.01 AS svz FROM lineitem)"""


def gps_rows(t: Tables) -> DataFrame:
    return t.table("lineitem").selectExpr(
        "l_orderkey AS packet",
        "l_linenumber AS line",
        "CASE WHEN l_partkey % 29 = 0 THEN double('NaN') ELSE 6750 + l_quantity * 8 END AS x",
        "l_discount * 100 AS y",
        "l_tax * 100 AS z",
        "l_discount / 2 AS sx",
        "l_tax / 2 + 0.001 AS sy",
        "0.01D AS sz",
        "4.5 + l_quantity / 8 AS vx",
        "l_discount AS vy",
        "l_tax AS vz",
        "l_discount AS svx",
        "l_tax + 0.001 AS svy",
        "0.01D AS svz",
    )


@query(
    "gps_position_screen",
    "F09",
    f"""
    WITH {_GPS} SELECT CASE WHEN NOT isfinite(x) THEN 'nonfinite_position_or_sigma'
      WHEN NOT sqrt(x*x + y*y + z*z) BETWEEN 6800 AND 7100 THEN 'orbital_radius'
      WHEN least(sx, sy, sz) <= 0 OR sqrt(sx*sx + sy*sy + sz*sz) > 0.1 THEN 'position_uncertainty' ELSE 'kept' END AS reason,
      count(*) AS n, CAST(sum(packet) AS BIGINT) AS packets FROM g GROUP BY 1""",
)
def gps_position_screen(t: Tables) -> DataFrame:
    return (
        gps_rows(t)
        .groupBy(F.coalesce(sel.position_rejection(), F.lit("kept")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("packet").alias("packets"))
    )


@query(
    "gps_velocity_screen",
    "F10",
    f"""
    WITH {_GPS} SELECT least(svx, svy, svz) > 0 AND sqrt(vx*vx + vy*vy + vz*vz) > 5 AND sqrt(vx*vx + vy*vy + vz*vz) < 10
      AND sqrt(svx*svx + svy*svy + svz*svz) <= 0.1 AS valid, count(*) AS n, CAST(sum(packet) AS BIGINT) AS packets FROM g GROUP BY 1""",
)
def gps_velocity_screen(t: Tables) -> DataFrame:
    return (
        gps_rows(t)
        .groupBy(sel.velocity_valid().alias("valid"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("packet").alias("packets"))
    )


@query(
    "hourly_holdout",
    "F11",
    """
    WITH @telemetry SELECT ts_us // 86400000000 AS day, count(*) FILTER (ts_us % 3600000000 >= 3000000000) AS withheld,
      count(*) AS n FROM telemetry GROUP BY 1""",
)
def hourly_holdout(t: Tables) -> DataFrame:
    return t.telemetry.groupBy(F.expr("ts_us div 86400000000").alias("day")).agg(
        F.count_if(sel.hourly_holdout(F.col("ts_us"))).alias("withheld"),
        F.count(F.lit(1)).alias("n"),
    )


_SOURCES = """
    s AS (SELECT pass_no AS id, CASE WHEN pass_no % 17 = 0 THEN '' ELSE spacecraft_id END AS spacecraft_id,
      concat('E', pass_no % 50) AS ephemeris_id, start_us, CASE WHEN pass_no % 13 = 0 THEN start_us ELSE stop_us END AS end_us,
      CASE priority WHEN '1-URGENT' THEN 'Scheduled' WHEN '2-HIGH' THEN 'CONFIRMED' WHEN '3-MEDIUM' THEN 'booked'
        ELSE 'cancelled' END AS state FROM passes)"""


def source_contacts(t: Tables) -> DataFrame:
    return t.passes.selectExpr(
        "pass_no AS id",
        "CASE WHEN pass_no % 17 = 0 THEN '' ELSE spacecraft_id END AS spacecraft_id",
        "concat('E', pass_no % 50) AS ephemeris_id",
        "start_us",
        "CASE WHEN pass_no % 13 = 0 THEN start_us ELSE stop_us END AS end_us",
        "CASE priority WHEN '1-URGENT' THEN 'Scheduled' WHEN '2-HIGH' THEN 'CONFIRMED' "
        "WHEN '3-MEDIUM' THEN 'booked' ELSE 'cancelled' END AS state",
    )


@query(
    "eligible_source_contacts",
    "F12",
    f"""
    WITH @passes, {_SOURCES} SELECT id, spacecraft_id, start_us FROM s WHERE spacecraft_id <> '' AND ephemeris_id <> ''
      AND end_us > start_us AND end_us - start_us >= 480000000
      AND lower(state) IN ('scheduled', 'confirmed', 'booked', 'active')""",
)
def eligible_source_contacts(t: Tables) -> DataFrame:
    kept = source_contacts(t).where(sel.eligible_source(480_000_000))
    return kept.select("id", "spacecraft_id", "start_us")


@query(
    "prior_available",
    "F13",
    """
    WITH @passes SELECT pass_no, CASE WHEN start_us + (pass_no % 40 - 10) * 60000000 > stop_us
      THEN 'source prior unavailable at checkpoint' ELSE '' END AS reason FROM passes""",
)
def prior_available(t: Tables) -> DataFrame:
    available = F.col("start_us") + (F.col("pass_no") % 40 - 10) * 60_000_000
    return t.passes.select(
        "pass_no",
        F.when(available > F.col("stop_us"), "source prior unavailable at checkpoint")
        .otherwise("")
        .alias("reason"),
    )


@query(
    "training_after_checkpoint",
    "F14",
    """
    WITH @passes, m AS (SELECT l_orderkey, max(epoch_us(o_orderdate) + (l_partkey % 1700) * 1000000 + (o_orderkey % 24) * 3600000000) AS last_us
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT pass_no, last_us, CASE WHEN last_us > stop_us THEN 'training observation after contact completion' ELSE '' END AS reason
    FROM passes JOIN m ON l_orderkey = pass_no""",
)
def training_after_checkpoint(t: Tables) -> DataFrame:
    # Only the latest offset per pass crosses the join, one row per pass.
    latest = t.table("lineitem").groupBy(F.col("l_orderkey").alias("pass_no")).agg(
        F.max((F.col("l_partkey") % 1700) * 1_000_000).alias("_offset")
    )
    last = F.col("start_us") + F.col("_offset")
    return t.passes.join(latest, "pass_no").select(
        "pass_no",
        last.alias("last_us"),
        F.when(last > F.col("stop_us"), "training observation after contact completion")
        .otherwise("")
        .alias("reason"),
    )


@query(
    "scoring_epochs",
    "A04",
    """
    WITH @telemetry, s AS (SELECT contact_id, min(ts_us) AS first_us, avg(ts_us - 1704067200000000) AS mean_us FROM telemetry
      WHERE carrier_lock = 'Locked' AND isfinite(doppler_hz) GROUP BY contact_id)
    SELECT contact_id, CAST(round(mean_us) AS BIGINT) + 1704067200000000 AS centre_us,
      least(first_us, CAST(round(mean_us) AS BIGINT) + 1704067200000000 - 1800000000) - 1000000 AS epoch_us FROM s""",
)
def scoring_epochs(t: Tables) -> DataFrame:
    from passledger.operators.scoring import scoring_epochs as compute

    return compute(t.telemetry.where(sel.locked_finite()), ["contact_id"], "ts_us")
