"""Tracking data messages: Doppler (TRACK) and pointing (ANGLE) exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.functions.geometry import finite
from passledger.functions.scalars import all_reasons, micros_to_text
from passledger.operators.ordered import neighbour
from passledger.operators.ranges import salted_join
from passledger.operators.sequences import collapse_equal
from passledger.sources import files

_DAY_US = 86_400_000_000


def _stamp() -> Column:
    return micros_to_text(F.col("t_us"), "product")


def track_observations(rows: DataFrame, contacts: DataFrame) -> DataFrame:
    """Frequencies per epoch after identity checks; equal epochs must agree.

    ``rows`` holds contact_id, station, t_us, transmit_hz and receive_hz as exact
    decimals; ``contacts`` contact_id and antenna.
    """
    checked = salted_join(
        rows, contacts.select("contact_id", "antenna"), ["contact_id"], F.col("t_us")
    )
    grouped = collapse_equal(
        checked.withColumn("_station_ok", F.col("station") == F.col("antenna")),
        ["contact_id", "t_us"],
        ["transmit_hz", "receive_hz", "_station_ok"],
    )
    return grouped.select(
        "contact_id", "t_us", "transmit_hz", "receive_hz",
        all_reasons(
            [
                (~F.col("_station_ok"), "station_mismatch"),
                (
                    F.col("transmit_hz").isNull() | F.col("receive_hz").isNull(),
                    "frequency_range",
                ),
                (F.col("conflict"), "epoch_conflict"),
            ]
        ).alias("reason"),
    )


def track_lines(observations: DataFrame) -> DataFrame:
    """Data lines: the transmit frequency only where it changes."""
    stepped = neighbour(
        observations, ["contact_id"], ["t_us"], F.floor(F.col("t_us") / _DAY_US).cast("long"),
        ["transmit_hz"], "_prev",
    )
    changed = F.col("_prev").isNull() | (F.col("transmit_hz") != F.col("_prev.transmit_hz"))

    def line(key: str, column: str) -> Column:
        value = F.col(column).cast("decimal(38,6)").cast("string")
        return F.concat_ws(" ", F.lit(f"{key} ="), _stamp(), value)

    lines = F.array_compact(
        F.array(
            F.when(changed, F.struct(F.lit(0).alias("part"), line("TRANSMIT_FREQ_1", "transmit_hz").alias("text"))),
            F.struct(F.lit(1).alias("part"), line("RECEIVE_FREQ_1", "receive_hz").alias("text")),
        )
    )
    return stepped.select("contact_id", "t_us", F.explode(lines).alias("_l")).select(
        "contact_id", "t_us", "_l.part", "_l.text"
    )


def angle_observations(rows: DataFrame, contacts: DataFrame) -> DataFrame:
    """Pointing per epoch: both coordinates or neither; equal epochs must agree."""
    pointed = rows.where(F.col("angle_1").isNotNull() | F.col("angle_2").isNotNull())
    checked = salted_join(
        pointed, contacts.select("contact_id", "antenna"), ["contact_id"], F.col("t_us")
    )
    grouped = collapse_equal(
        checked.withColumn("_station_ok", F.col("station") == F.col("antenna")),
        ["contact_id", "t_us"],
        ["angle_1", "angle_2", "_station_ok"],
    )
    half = F.col("angle_1").isNull() | F.col("angle_2").isNull()
    return grouped.select(
        "contact_id", "t_us", "angle_1", "angle_2",
        all_reasons(
            [
                (half, "half_angle"),
                (~half & ~(finite(F.col("angle_1")) & finite(F.col("angle_2"))), "angle_range"),
                (~F.col("_station_ok"), "station_mismatch"),
                (F.col("conflict"), "epoch_conflict"),
            ]
        ).alias("reason"),
    )


def angle_lines(observations: DataFrame) -> DataFrame:
    def line(number: int) -> Column:
        return F.concat_ws(
            " ", F.lit(f"ANGLE_{number} ="), _stamp(), F.format_string("%.6f", F.col(f"angle_{number}"))
        )

    return observations.select(
        "contact_id", "t_us", F.posexplode(F.array(line(1), line(2))).alias("part", "text")
    )


def header_lines(
    contacts: DataFrame, *, kind: str, originator: str, created: str, turnaround: tuple[int, int] = (240, 221), integration_s: str = "1.0"
) -> DataFrame:
    """Header and metadata lines per contact.

    ``contacts`` holds contact_id, antenna, location, latitude, longitude,
    altitude, ecef_x/y/z, spacecraft, cospar, catalog, band, pedestal_offset_m
    calibration_date and, for TRACK, correction_doppler_hz; null calibration prints
    UNKNOWN for pointing files.
    """
    if kind not in ("TRACK", "ANGLE"):
        raise ValueError("kind must be TRACK or ANGLE")
    # Fixed values from here on: comments and keywords of the export format.
    title = "Radiometric Tracking Data" if kind == "TRACK" else "Antenna Pointing Angles"
    pedestal = F.when(
        F.col("pedestal_offset_m").isNotNull(),
        F.concat(F.lit("Lg="), F.col("pedestal_offset_m").cast("string"), F.lit(" meters")),
    ).otherwise("UNKNOWN")
    calibrated = F.coalesce(F.col("calibration_date").cast("string"), F.lit("UNKNOWN"))
    calibration_label = (
        F.concat(F.lit("COMMENT "), "band", F.lit("-band TLT calibration date: "), calibrated)
        if kind == "TRACK"
        else F.concat(F.lit("COMMENT TLT calibration date: "), calibrated)
    )
    shared = [
        F.lit("CCSDS_TDM_VERS = 2.0"),
        F.lit(f"COMMENT {title}"),
        F.concat_ws(" ", F.lit("COMMENT Ground antenna:"), "antenna", "location"),
        F.format_string(
            "COMMENT WGS84 coordinates: lat=%s, long=%s, alt=%s", "latitude", "longitude", "altitude"
        ),
        F.format_string("COMMENT ECEF coordinates: X=%.3f, Y=%.3f, Z=%.3f", "ecef_x", "ecef_y", "ecef_z"),
        F.concat(F.lit("COMMENT Pedestal offset: "), pedestal),
        calibration_label,
        F.concat(F.lit("COMMENT Spacecraft: "), "spacecraft"),
        F.concat(F.lit("COMMENT COSPAR: "), "cospar", F.lit(" Catalog: "), "catalog"),
        F.lit(f"CREATION_DATE = {created}"),
        F.lit(f"ORIGINATOR = {originator}"),
        F.lit(""),
        F.lit("META_START"),
        *([F.lit("COMMENT Range Tracking Data: Mode 4=Doppler only")] if kind == "TRACK" else []),
        F.lit("TIME_SYSTEM = UTC"),
        F.concat(F.lit("PARTICIPANT_1 = "), "antenna"),
        F.concat(F.lit("PARTICIPANT_2 = "), "cospar"),
    ]
    own = (
        [F.lit("MODE = SEQUENTIAL"), F.concat(F.lit("TRANSMIT_BAND = "), "band"),
         F.concat(F.lit("RECEIVE_BAND = "), "band"), F.lit(f"TURNAROUND_NUMERATOR = {turnaround[0]}"),
         F.lit(f"TURNAROUND_DENOMINATOR = {turnaround[1]}"), F.lit(f"INTEGRATION_INTERVAL = {integration_s}"),
         F.lit("INTEGRATION_REF = END"), F.concat(F.lit("CORRECTION_DOPPLER = "), F.col("correction_doppler_hz").cast("string")),
         F.lit("CORRECTIONS_APPLIED = NO"), F.lit("PATH = 1,2,1")]
        if kind == "TRACK"
        else [F.concat(F.lit("RECEIVE_BAND = "), "band"), F.lit("ANGLE_TYPE = AZEL")]
    )
    closing = [F.lit("META_STOP"), F.lit(""), F.lit("DATA_START")]
    return contacts.select(
        "contact_id", F.lit(-1).cast("long").alias("t_us"),
        F.posexplode(F.array(*shared, *own, *closing)).alias("part", "text"),
    )


def write_exports(header: DataFrame, data: DataFrame, path: str) -> None:
    """One file per contact, ``contact_id=....txt``: header lines, then data in time order, then the end."""
    end = header.select("contact_id").distinct().select(
        "contact_id", F.lit(2**62).alias("t_us"), F.lit(0).alias("part"), F.lit("DATA_STOP").alias("text")
    )
    files.write_keyed(header.unionByName(data).unionByName(end), "contact_id", ("t_us", "part"), path)


def read_angles(lines: DataFrame) -> DataFrame:
    """Lines of ANGLE files (contact_id, value) with time and angle of those that hold one; nulls elsewhere."""
    told = F.regexp_extract("value", r"^ANGLE_([12]) = (\S+) (\S+)$", 0) != ""
    part = lambda i: F.regexp_extract("value", r"^ANGLE_([12]) = (\S+) (\S+)$", i)
    number = F.when(told, part(3).cast("double"))
    return lines.select(
        "contact_id", "value", F.when(told, part(2)).alias("epoch"),
        *[F.when(told & (part(1) == str(i)), number).alias(f"angle_{i}") for i in (1, 2)],
    )
