"""Scalar rules of the tracking domain as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from passledger.functions.geometry import finite

MICROS = 1_000_000

# Whole TAI-UTC seconds from the first Unix second they apply.
LEAP_SECONDS = (
    (63072000, 10), (78796800, 11), (94694400, 12), (126230400, 13),
    (157766400, 14), (189302400, 15), (220924800, 16), (252460800, 17),
    (283996800, 18), (315532800, 19), (362793600, 20), (394329600, 21),
    (425865600, 22), (489024000, 23), (567993600, 24), (631152000, 25),
    (662688000, 26), (709948800, 27), (741484800, 28), (773020800, 29),
    (820454400, 30), (867715200, 31), (915148800, 32), (1136073600, 33),
    (1230768000, 34), (1341100800, 35), (1435708800, 36), (1483228800, 37),
)
GPS_EPOCH_UNIX = 315964800
GPS_WEEK = 604800
TAI_MINUS_GPS = 19
MJD_AT_UNIX_EPOCH = 40587.0
MJD_TOOL_OFFSET = 2430000.0 - 2400000.5

# Unit by parameter name.
PARAMETER_UNITS = {
    "time_offset_s": "s",
    "center_frequency_offset_hz": "Hz",
    "mean_longitude_deg": "deg",
    "mean_motion_rev_per_day": "rev/day",
    "equinoctial_f": "1",
    "equinoctial_g": "1",
    "equinoctial_h": "1",
    "equinoctial_k": "1",
    "bstar": "1/Earth radii",
    "position_x_m": "m",
    "position_y_m": "m",
    "position_z_m": "m",
    "velocity_x_m_s": "m/s",
    "velocity_y_m_s": "m/s",
    "velocity_z_m_s": "m/s",
}
BIAS_PREFIX = "pass_bias_hz:"


def loss_rho(residual: Column, kind: str, scale: float) -> Column:
    """The loss of one whitened residual, before the factor scale squared."""
    z = (residual / F.lit(float(scale))) * (residual / F.lit(float(scale)))
    if kind == "linear":
        return z
    if kind == "soft_l1":
        return 2.0 * (F.sqrt(1.0 + z) - 1.0)
    if kind == "huber":
        return F.when(z <= 1.0, z).otherwise(2.0 * F.sqrt(z) - 1.0)
    if kind == "cauchy":
        return F.log1p(z)
    if kind == "arctan":
        return F.atan(z)
    raise ValueError(f"unknown loss {kind!r}")


def loss_rho_block(residual: np.ndarray, kind: str, scale: float) -> np.ndarray:
    """``loss_rho`` of a block of numbers in a task."""
    z = (residual / scale) * (residual / scale)
    if kind == "linear":
        return z
    if kind == "soft_l1":
        return 2.0 * (np.sqrt(1.0 + z) - 1.0)
    if kind == "huber":
        return np.where(z <= 1.0, z, 2.0 * np.sqrt(z) - 1.0)
    if kind == "cauchy":
        return np.log1p(z)
    if kind == "arctan":
        return np.arctan(z)
    raise ValueError(f"unknown loss {kind!r}")


def curvature_weight(residual: Column, kind: str, scale: float) -> Column:
    if kind == "linear":
        return F.lit(1.0)
    if kind == "soft_l1":
        z = residual / F.lit(float(scale))
        return F.pow(1.0 + z * z, F.lit(-0.75))
    raise ValueError("curvature weights exist for linear and soft_l1 loss")


def slope_weight(residual: Column, kind: str, scale: float) -> Column:
    """Derivative of the loss by z: the weight of one row in a robust step."""
    z = (residual / F.lit(float(scale))) * (residual / F.lit(float(scale)))
    if kind == "linear":
        return F.lit(1.0)
    if kind == "soft_l1":
        return 1.0 / F.sqrt(1.0 + z)
    if kind == "huber":
        return F.when(z <= 1.0, F.lit(1.0)).otherwise(1.0 / F.sqrt(z))
    if kind == "cauchy":
        return 1.0 / (1.0 + z)
    if kind == "arctan":
        return 1.0 / (1.0 + z * z)
    raise ValueError(f"unknown loss {kind!r}")


def _once(value: Column, rule) -> Column:
    """Apply a rule that uses its argument several times, evaluating it once."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def _leap_count(value: Column, starts) -> Column:
    table = F.array(*[F.lit(float(s)) for s in starts])
    return _once(value, lambda v: F.size(F.filter(table, lambda s: s <= v)))


def tai_minus_utc(unix_s: Column) -> Column:
    """Whole leap seconds at a UTC second; they grow by one from ten."""
    count = _leap_count(unix_s, [start for start, _ in LEAP_SECONDS])
    return F.when(unix_s >= LEAP_SECONDS[0][0], count + (LEAP_SECONDS[0][1] - 1))


def gps_epoch(packet_ms: Column, week_ms: Column) -> Column:
    """UTC seconds of a receiver epoch: the week nearest to the packet time.

    Null for a second of week outside the week.
    """
    week_s = week_ms / 1000.0
    packet_s = packet_ms / 1000.0
    gps_now = packet_s + tai_minus_utc(packet_s) - TAI_MINUS_GPS - GPS_EPOCH_UNIX
    week = F.rint((gps_now - week_s) / GPS_WEEK)
    # GPS time counted from the Unix epoch runs ahead of UTC by the leap seconds
    # since its own epoch; the table of starts is shifted to that scale.
    ahead = [start + seconds - TAI_MINUS_GPS for start, seconds in LEAP_SECONDS]
    first = LEAP_SECONDS[0][1] - 1 - TAI_MINUS_GPS
    table = F.array(*[F.lit(float(s)) for s in ahead])
    utc = _once(
        week * GPS_WEEK + week_s + GPS_EPOCH_UNIX,
        lambda v: v - (F.size(F.filter(table, lambda s: s <= v)) + first),
    )
    return F.when(finite(week_s) & (week_s >= 0) & (week_s < GPS_WEEK), utc)


def text_to_micros(text: Column) -> Column:
    """Unix microseconds of an ISO time with or without fraction and zone."""
    cleaned = F.regexp_replace(F.trim(text), "[zZ]$", "+00:00")
    stamp = F.coalesce(
        F.try_to_timestamp(cleaned, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")),
        F.try_to_timestamp(cleaned, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX")),
        F.try_to_timestamp(cleaned),
    )
    return F.unix_micros(stamp)


def micros_to_text(micros: Column, style: str) -> Column:
    """Output forms: query language, product files, reports, tool scripts."""
    pattern = {
        "query": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
        "product": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        "report": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
        "gregorian": "dd MMM yyyy HH:mm:ss.SSS",
    }[style]
    return F.date_format(F.timestamp_micros(micros), pattern)


def utc_mjd(unix_s: Column) -> Column:
    return unix_s / 86400.0 + MJD_AT_UNIX_EPOCH - MJD_TOOL_OFFSET


def tai_mjd(unix_s: Column) -> Column:
    return utc_mjd(unix_s + tai_minus_utc(unix_s))


def parse_boolean(value: Column) -> Column:
    """Form and JSON booleans; null becomes false, other words become null."""
    word = F.lower(F.trim(value))
    return (
        F.when(value.isNull(), False)
        .when(word.isin("true", "1", "yes", "on"), True)
        .when(word.isin("false", "0", "no", "off", ""), False)
    )


def join_present(items: Column) -> Column:
    kept = F.filter(items, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, ","))


def derived_identity(prefix: str, *parts: Column) -> Column:
    """Stable identity: prefix and 24 hex digits over NUL-joined parts."""
    joined = F.concat_ws("\0", *parts)
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def scaled_frequency(centre: Column, value: Column, unit: float | int, sign: int) -> Column:
    """Centre plus a signed scaled offset, exact; null unless positive."""
    exact = centre.cast("decimal(20,9)") + F.lit(sign).cast("decimal(1,0)") * (
        F.coalesce(value.cast("decimal(20,9)"), F.lit(0).cast("decimal(20,9)"))
        * F.lit(int(unit)).cast("decimal(10,0)")
    ).cast("decimal(30,9)")
    exact = exact.cast("decimal(38,9)")
    return F.when(exact > 0, exact)


def at_bound(value: Column, lower: Column, upper: Column, scale: Column) -> Column:
    return F.least(value - lower, upper - value) <= scale * 1e-6


def parameter_unit(name: Column) -> Column:
    units = F.create_map(*[F.lit(x) for pair in PARAMETER_UNITS.items() for x in pair])
    return F.when(name.startswith(BIAS_PREFIX), "Hz").otherwise(F.try_element_at(units, name))


def named_values_json(names: Column, values: Column) -> Column:
    """Names zipped to values as JSON with sorted keys."""
    pairs = F.array_sort(F.arrays_zip(names.alias("k"), values.alias("v")))
    return F.to_json(F.map_from_entries(pairs))


def clamp(value: Column, lower: Column, upper: Column) -> Column:
    return F.least(F.greatest(value, lower), upper)


def slew_step(
    raw: Column,
    applied: Column,
    elapsed_s: Column,
    *,
    limit_s: float,
    step_s: float,
    rate: float,
) -> Column:
    """A requested offset clamped by absolute limit, step and rate."""
    bounded = clamp(raw, F.lit(-limit_s), F.lit(limit_s))
    move = F.least(F.lit(step_s), rate * elapsed_s)
    return clamp(bounded, applied - move, applied + move)


def fresh(event_us: Column, now_us: Column, max_age_s: float) -> Column:
    age = now_us - event_us
    return F.coalesce((age >= 0) & (age <= int(max_age_s * MICROS)), F.lit(False))


def sweep_values(lower: Column, upper: Column, step: Column, tolerance: float = 1e-6) -> Column:
    count = F.floor((upper - lower) / step).cast("int")
    grid = F.transform(F.sequence(F.lit(0), count), lambda i: lower + i * step)
    return F.when(
        F.element_at(grid, -1) < upper - tolerance, F.concat(grid, F.array(upper))
    ).otherwise(grid)


def timing_candidates(lower: Column, upper: Column, step: Column) -> Column:
    """Half-open grid plus the upper end and zero, unique and ascending."""
    count = F.ceil((upper - lower) / step).cast("int")
    grid = F.when(
        count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: lower + i * step)
    ).otherwise(F.array().cast("array<double>"))
    return F.array_sort(F.array_distinct(F.concat(grid, F.array(upper, F.lit(0.0)))))


def tle_checksum(line: Column) -> Column:
    """Digit sum plus one per minus sign over the first 68 characters, mod 10."""
    body = F.substring(line, 1, 68)
    minus = F.length(body) - F.length(F.regexp_replace(body, "-", ""))
    digits = F.regexp_replace(body, "[^0-9]", "")
    total = F.lit(0)
    for digit in range(1, 10):
        count = F.length(digits) - F.length(F.replace(digits, F.lit(str(digit)), F.lit("")))
        total = total + digit * count
    return F.pmod(total + minus, F.lit(10))


def tle_line_valid(line: Column, number: int) -> Column:
    return (
        (F.length(line) == 69)
        & (F.octet_length(line) == 69)
        & line.startswith(f"{number} ")
    )


def tle_body(text: Column) -> Column:
    """The non-blank lines of a TLE text; only two or three lines are accepted."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.regexp_replace(x, "\r", ""))),
        lambda x: F.length(F.trim(x)) > 0,
    )
    return F.when(F.size(lines).isin(2, 3), F.slice(lines, -2, 2))


def first_reason(rules: Sequence[tuple[Column, str]], otherwise: str | None = "") -> Column:
    """The text of the first rule that holds."""
    chain = None
    for condition, text in rules:
        chain = F.when(condition, text) if chain is None else chain.when(condition, text)
    return chain.otherwise(F.lit(otherwise))


def all_reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """Texts of every rule that holds, each once, in order."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return F.array_join(F.array_distinct(found), "; ")
