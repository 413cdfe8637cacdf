"""Orbit and Doppler scores: coverage, moments, distributions, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.functions.geometry import finite, norm, vector
from passledger.operators.ordered import exact_percentiles, neighbour
from passledger.operators.ranges import interval_join

POSITION = ("dx_m", "dy_m", "dz_m")
VELOCITY = ("dvx_m_s", "dvy_m_s", "dvz_m_s")
_ORIGIN = 1_704_067_200_000_000


def scoring_epochs(selected: DataFrame, keys: Sequence[str], time_column: str) -> DataFrame:
    """Mean epoch and an earlier propagation epoch per group, in microseconds."""
    relative = F.col(time_column) - F.lit(_ORIGIN)
    grouped = selected.groupBy(*keys).agg(
        F.min(time_column).alias("_first"), F.avg(relative).alias("_mean")
    )
    centre = F.round("_mean").cast("long") + F.lit(_ORIGIN)
    return grouped.select(
        *keys,
        centre.alias("centre_us"),
        (F.least(F.col("_first"), centre - 1_800_000_000) - 1_000_000).alias("epoch_us"),
    )


def error_moments(columns: Sequence[str], kind: str, unit: str) -> list[Column]:
    """RMSE, mean and population variance of the norm; signed component moments."""
    parts = vector(*columns)
    length = norm(parts)
    squares = parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]
    moments = [
        F.sqrt(F.avg(squares)).alias(f"{kind}_rmse_{unit}"),
        F.avg(length).alias(f"{kind}_mean_{unit}"),
        F.var_pop(length).alias(f"{kind}_variance_{unit}2"),
    ]
    for column in columns:
        moments.append(F.avg(column).alias(f"{column}_mean"))
        moments.append(F.var_pop(column).alias(f"{column}_variance"))
    return moments


def error_summary(keys_frame, position: Sequence[str], velocity: Sequence[str]) -> DataFrame:
    """Count, RMS and maximum of position and velocity norms of a grouped frame."""
    p, v = norm(vector(*position)), norm(vector(*velocity))
    return keys_frame.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sqrt(F.avg(p * p)).alias("position_rms_m"),
        F.sqrt(F.avg(v * v)).alias("velocity_rms_m_s"),
        F.max(p).alias("position_max_m"),
        F.max(v).alias("velocity_max_m_s"),
    )


def hour_coverage(
    history: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    *,
    bucket_us: int,
    strict: bool = True,
) -> DataFrame:
    """Coverage class of a window per group.

    ``windows`` gives start_us and stop_us per group (and optionally low_us and
    high_us, the reference's own bounds). Complete means: the bounds contain the
    window to a microsecond, first and last sample lie within one median cadence
    of its ends, and no gap exceeds one and a half cadences.
    """
    keys = list(keys)
    times = history.select(*keys, "t_us").distinct()
    stepped = neighbour(
        times, keys, ["t_us"], F.floor(F.col("t_us") / bucket_us).cast("long"), ["t_us"], "_prev"
    ).withColumn("_gap", F.col("t_us") - F.col("_prev.t_us"))
    cadence = exact_percentiles(stepped, keys, "_gap", {"cadence_us": 0.5})
    extent = times.groupBy(*keys).agg(
        F.min("t_us").alias("_low"), F.max("t_us").alias("_high")
    )
    inside = stepped.join(windows, keys).where(
        F.col("t_us").between(F.col("start_us"), F.col("stop_us"))
    )
    # A gap counts only between two samples of the window.
    held = F.when(F.col("_prev.t_us") >= F.col("start_us"), F.col("_gap"))
    selected = inside.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("window_times"),
        F.min("t_us").alias("first_us"),
        F.max("t_us").alias("last_us"),
        F.max(held).alias("widest_gap_us"),
    )
    joined = (
        windows.join(extent, keys, "left").join(cadence, keys, "left").join(selected, keys, "left")
    )
    low = F.col("low_us") if "low_us" in windows.columns else F.col("_low")
    high = F.col("high_us") if "high_us" in windows.columns else F.col("_high")
    bounded = (low <= F.col("start_us") + 1) & (high >= F.col("stop_us") - 1)
    complete = (
        (F.col("window_times") >= 2)
        & (bounded if strict else F.lit(True))
        & (F.col("first_us") < F.col("start_us") + F.col("cadence_us"))
        & (F.col("last_us") > F.col("stop_us") - F.col("cadence_us"))
        & (F.col("widest_gap_us") <= F.col("cadence_us") * 1.5)
    )
    return joined.select(
        *keys,
        "start_us",
        "stop_us",
        F.coalesce("window_times", F.lit(0)).alias("window_times"),
        "cadence_us",
        F.coalesce(complete, F.lit(False)).alias("complete"),
    )


def window_score(
    history: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    *,
    bucket_us: int,
    exclude_start: bool = False,
    require_full_hour: bool = True,
) -> DataFrame:
    """Score of each group in its window; errors only where it is complete."""
    keys = list(keys)
    coverage = hour_coverage(
        history, windows, keys, bucket_us=bucket_us, strict=require_full_hour
    )
    after = (
        F.col("t_us") > F.col("start_us") if exclude_start else F.col("t_us") >= F.col("start_us")
    )
    moments = [
        *error_moments(POSITION, "position", "m"),
        *error_moments(VELOCITY, "velocity", "m_s"),
    ]
    scored = (
        history.join(windows.select(*keys, "start_us", "stop_us"), keys)
        .where(after & (F.col("t_us") <= F.col("stop_us")))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.min("t_us").alias("first_sample_us"),
            F.max("t_us").alias("last_sample_us"),
            *moments,
        )
    )
    names = scored.columns[len(keys) + 3 :]
    shown = F.col("complete") if require_full_hour else F.lit(True)
    return coverage.join(scored, keys, "left").select(
        *keys,
        "start_us",
        "stop_us",
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        F.when(F.col("sample_count").isNull(), "unavailable")
        .when(F.col("complete"), "complete")
        .otherwise("partial")
        .alias("coverage"),
        "first_sample_us",
        "last_sample_us",
        F.when(~shown, "hour_uncovered")
        .otherwise("")
        .alias("reason"),
        *[F.when(shown, F.col(n)).alias(n) for n in names],
    )


def residual_distribution(
    residuals: DataFrame, keys: Sequence[str], components: Sequence[str]
) -> DataFrame:
    """Count, RMS, median, p95 and maximum of the norm over finite rows."""
    usable = F.lit(True)
    for c in components:
        usable = usable & finite(F.col(c))
    everyone = residuals.select(*keys).distinct()
    norms = residuals.where(usable).select(*keys, norm(vector(*components)).alias("_norm"))
    basic = norms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.sqrt(F.avg(F.col("_norm") * F.col("_norm"))).alias("rms"),
        F.max("_norm").alias("max"),
    )
    ranked = exact_percentiles(norms, keys, "_norm", {"median": 0.5, "p95": 0.95})
    return (
        everyone.join(basic, list(keys), "left")
        .join(ranked, list(keys), "left")
        .fillna(0, ["count"])
    )


def coverage_gaps(
    epochs: DataFrame, keys: Sequence[str], *, limit_us: int, bucket_us: int
) -> DataFrame:
    """Gaps longer than the limit, one row each."""
    stepped = neighbour(
        epochs, keys, ["t_us"], F.floor(F.col("t_us") / bucket_us).cast("long"), ["t_us"], "_prev"
    )
    gap = F.col("t_us") - F.col("_prev.t_us")
    return stepped.where(gap > limit_us).select(
        *keys,
        F.col("_prev.t_us").alias("start_us"),
        F.col("t_us").alias("stop_us"),
        (gap / 1e6).alias("duration_s"),
    )


def coverage_edges(epochs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extrapolation at both ends of the fit span and the median packet latency."""
    edges = epochs.groupBy(*keys).agg(
        F.min("t_us").alias("first_us"),
        F.max("t_us").alias("last_us"),
        F.min("start_us").alias("_start"),
        F.max("stop_us").alias("_stop"),
    )
    late = epochs.withColumn("_late", F.col("packet_us") - F.col("t_us"))
    latency = exact_percentiles(late, keys, "_late", {"_median": 0.5})
    return edges.join(latency, list(keys)).select(
        *keys,
        "first_us",
        "last_us",
        ((F.col("first_us") - F.col("_start")) / 1e6).alias("backward_s"),
        ((F.col("_stop") - F.col("last_us")) / 1e6).alias("forward_s"),
        (F.col("_median") / 1e6).alias("median_latency_s"),
    )


def holdout_score(residuals: DataFrame, keys: Sequence[str], column: str = "residual_hz") -> DataFrame:
    """Raw RMSE, RMSE about the mean, and the bias that removes the mean."""
    value = F.col(column)
    return residuals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("holdout_samples"),
        F.sqrt(F.avg(value * value)).alias("holdout_raw_rmse_hz"),
        F.sqrt(F.var_pop(value)).alias("holdout_shape_rmse_hz"),
        (-F.avg(value)).alias("holdout_fitted_bias_hz"),
        F.bool_and(finite(value)).alias("finite"),
    )


def interval_orbit_score(
    states: DataFrame, windows: DataFrame, keys: Sequence[str], window_id: str, *, width_us: int
) -> DataFrame:
    """Vector RMSE of the states inside each window, with a reason when none."""
    inside = interval_join(
        states, windows, keys, "t_us", "start_us", "stop_us", width=width_us
    )
    p, v = vector(*POSITION), vector(*VELOCITY)
    scored = inside.groupBy(window_id).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.sqrt(F.avg(norm(p) * norm(p))) / 1000).alias("position_rmse_km"),
        F.sqrt(F.avg(norm(v) * norm(v))).alias("velocity_rmse_m_s"),
    )
    return windows.select(window_id).join(scored, window_id, "left").select(
        window_id,
        F.coalesce("_n", F.lit(0)).alias("samples"),
        "position_rmse_km",
        "velocity_rmse_m_s",
        F.when(F.col("_n").isNull(), "no_samples")
        .otherwise("")
        .alias("reason"),
    )
