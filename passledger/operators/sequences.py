"""Ordered sequences: duplicates, changes, coverage, lock windows, debounce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.functions.scalars import first_reason
from passledger.operators.ordered import neighbour, ordinal, prefix
from passledger.operators.ranges import salted_join


def best_duplicate(fixes: DataFrame, keys: Sequence[str], sigma: str, line: str) -> DataFrame:
    """Mark the fix with the smallest sigma per epoch; the first line wins ties."""
    best = fixes.groupBy(*keys).agg(F.min(F.struct(sigma, line)).alias("_best"))
    joined = salted_join(fixes, best, list(keys), F.col(line))
    return joined.withColumn(
        "reason",
        F.when(F.struct(sigma, line) == F.col("_best"), "").otherwise("duplicate_epoch"),
    ).drop("_best")


def conflicting_epochs(
    times: DataFrame, packet: str, line: str, epoch_us: str, tolerance_us: int = 1
) -> DataFrame:
    """Per packet: the last epoch, and whether it ever moved by more than 1 µs."""
    stepped = neighbour(
        times, [packet], [line], F.floor(F.col(line) / 100_000).cast("long"), [epoch_us], "_prev"
    )
    moved = F.abs(F.col(epoch_us) - F.col(f"_prev.{epoch_us}")) > tolerance_us
    return stepped.groupBy(packet).agg(
        F.max_by(epoch_us, line).alias(epoch_us),
        F.coalesce(F.bool_or(moved), F.lit(False)).alias("conflict"),
    )


def coverage_check(
    segments: DataFrame, keys: Sequence[str], start_us: int, stop_us: int, *, bucket_us: int
) -> DataFrame:
    """Whether ordered segments cover the window without a hole."""
    begun = prefix(
        segments,
        keys,
        ["first_us", "last_us", "segment"],
        F.floor(F.col("first_us") / bucket_us).cast("long"),
        {"_reached": ("max", F.col("last_us"))},
        inclusive=False,
    )
    reached = F.greatest(F.coalesce("_reached", F.lit(start_us)), F.lit(start_us))
    hole = (F.col("first_us") > reached) & (reached < stop_us)
    return begun.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(hole).alias("holes"),
        (
            ~F.bool_or(hole) & (F.greatest(F.max("last_us"), F.lit(start_us)) >= stop_us)
        ).alias("covered"),
    )


def duplicate_epochs(samples: DataFrame, keys: Sequence[str], column: str = "t_us") -> DataFrame:
    return samples.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def emit_on_change(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, column: str
) -> DataFrame:
    """Rows whose value differs from the row before, the first one included."""
    stepped = neighbour(rows, keys, order, bucket, [column], "_prev")
    changed = F.col("_prev").isNull() | ~F.col(column).eqNullSafe(F.col(f"_prev.{column}"))
    return stepped.where(changed).drop("_prev")


def collapse_equal(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key; conflicting values at one key are flagged."""
    whole = F.struct(*values)
    grouped = rows.groupBy(*keys).agg(
        F.min(whole).alias("_low"), F.max(whole).alias("_high"), F.count(F.lit(1)).alias("copies")
    )
    return grouped.select(
        *keys,
        *[F.col(f"_low.{v}").alias(v) for v in values],
        "copies",
        (~F.col("_low").eqNullSafe(F.col("_high"))).alias("conflict"),
    )


def lock_edges(probes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lock window of a sweep: edges, midpoint, or why there is none.

    ``probes`` holds probe_index (0, 1, ...), offset_s and locked. Two grouped
    passes replace a walk over the sweep.
    """
    keys = list(keys)
    first = probes.groupBy(*keys).agg(
        F.min(F.when(F.col("locked"), F.col("probe_index"))).alias("_left"),
        F.min_by(
            "offset_s", F.when(F.col("locked"), F.col("probe_index"))
        ).alias("left_edge_s"),
    )
    later = salted_join(probes, first, keys, F.col("probe_index"))
    unlocked = F.when(
        ~F.col("locked") & (F.col("probe_index") > F.col("_left")), F.col("probe_index")
    )
    ended = later.groupBy(*keys).agg(
        F.first("_left").alias("_left"),
        F.first("left_edge_s").alias("left_edge_s"),
        F.min(unlocked).alias("_unlock"),
    )
    edge = salted_join(probes, ended, keys, F.col("probe_index"))
    closed = edge.groupBy(*keys).agg(
        F.first("_left").alias("_left"),
        F.first("_unlock").alias("_unlock"),
        F.first("left_edge_s").alias("left_edge_s"),
        F.max(
            F.when(F.col("probe_index") == F.col("_unlock") - 1, F.col("offset_s"))
        ).alias("right_edge_s"),
    )
    status = first_reason(
        [
            (F.col("_left").isNull(), "no_lock_window"),
            (F.col("_left") == 0, "open_at_start"),
            (F.col("_unlock").isNull(), "open_at_end"),
        ],
        "lock_window_midpoint",
    )
    whole = F.col("status") == "lock_window_midpoint"
    return closed.withColumn("status", status).select(
        *keys,
        "status",
        F.when(whole, F.col("left_edge_s")).alias("left_edge_s"),
        F.when(whole, F.col("right_edge_s")).alias("right_edge_s"),
        F.when(whole, (F.col("left_edge_s") + F.col("right_edge_s")) / 2).alias("midpoint_s"),
    )


def debounce(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: str,
    consecutive: int,
) -> DataFrame:
    """One probe per ``consecutive`` equal samples; a change restarts the count."""
    placed = ordinal(samples, keys, order, bucket, "_at")
    stepped = neighbour(placed, keys, order, bucket, [value], "_prev")
    changed = F.col("_prev").isNull() | ~F.col(value).eqNullSafe(F.col(f"_prev.{value}"))
    started = prefix(
        stepped.withColumn("_start", F.when(changed, F.col("_at"))).drop("_prev"),
        keys,
        order,
        bucket,
        {"_from": ("max", F.col("_start"))},
    )
    run = F.col("_at") - F.col("_from") + 1
    return started.where(F.pmod(run, F.lit(consecutive)) == 0).drop("_at", "_from", "_start")


def sweep_bracket(scores: DataFrame, keys: Sequence[str], offset: str, score: str) -> DataFrame:
    """Best offset and its two grid neighbours; an end optimum has one of them."""
    keys = list(keys)
    best = scores.groupBy(*keys).agg(
        F.min(F.struct(F.col(score).alias("score"), F.col(offset).alias("offset"))).alias("_best")
    )
    around = salted_join(scores, best, keys, F.col(offset))
    at = F.col("_best.offset")
    return around.groupBy(*keys).agg(
        F.first("_best.offset").alias("best_offset_s"),
        F.first("_best.score").alias("best_score"),
        F.max(F.when(F.col(offset) < at, F.col(offset))).alias("below_s"),
        F.min(F.when(F.col(offset) > at, F.col(offset))).alias("above_s"),
    ).withColumn("interior", F.col("below_s").isNotNull() & F.col("above_s").isNotNull())
