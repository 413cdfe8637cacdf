"""Interval, as-of and overlap joins on integer time keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.operators.ordered import prefix


def salted_join(
    large: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Column,
    *,
    salts: int = 8,
    how: str = "inner",
) -> DataFrame:
    """Equi join of a large side with one lookup row per key.

    The large side of a hot key is spread by ``spread`` over ``salts`` parts and
    the lookup row is repeated for each part.
    """
    left = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    point: str,
    start: str,
    stop: str,
    *,
    width: int,
    left_open: bool = False,
    salts: int = 1,
) -> DataFrame:
    """Rows of ``points`` inside the closed intervals of the same key.

    Both sides get a slot number of ``width`` time units, which turns the range
    condition into an equi join; an interval is repeated once per slot it meets.
    """
    slot = "_slot"
    left = points.withColumn(slot, F.floor(F.col(point) / F.lit(width)).cast("long"))
    right = intervals.withColumn(
        slot,
        F.explode(
            F.sequence(
                F.floor(F.col(start) / F.lit(width)).cast("long"),
                F.floor(F.col(stop) / F.lit(width)).cast("long"),
            )
        ),
    )
    after = F.col(point) > F.col(start) if left_open else F.col(point) >= F.col(start)
    inside = after & (F.col(point) <= F.col(stop))
    on = [*keys, slot]
    if salts > 1:
        joined = salted_join(left, right, on, F.col(point), salts=salts)
    else:
        joined = left.join(right, on)
    return joined.where(inside).drop(slot)


def as_of(
    queries: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    at: str,
    known: str,
    columns: Sequence[str],
    *,
    width: int,
    name: str = "latest",
) -> DataFrame:
    """Latest history row at or before each query, as a struct or null.

    Both inputs are merged into one ordered stream and the last history row is
    carried forward, so no pair of rows is ever built.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in columns])
    past = history.select(
        *keys,
        F.col(known).alias("_at"),
        F.lit(0).alias("_kind"),
        payload.alias("_payload"),
        F.xxhash64(payload).alias("_tie"),
        F.lit(None).cast(queries.select(F.struct("*")).schema[0].dataType).alias("_row"),
    )
    ask = queries.select(
        *keys,
        F.col(at).alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast(past.schema["_payload"].dataType).alias("_payload"),
        F.xxhash64(F.struct("*")).alias("_tie"),
        F.struct(*queries.columns).alias("_row"),
    )
    merged = past.unionByName(ask)
    carried = prefix(
        merged,
        keys,
        ["_at", "_kind", "_tie"],
        F.floor(F.col("_at") / F.lit(width)).cast("long"),
        {name: ("last", F.col("_payload"))},
    )
    return carried.where("_kind = 1").select("_row.*", name)


def without_overlap(
    candidates: DataFrame,
    bookings: DataFrame,
    keys: Sequence[str],
    start: str,
    stop: str,
    *,
    booked_start: str,
    booked_stop: str,
    width: int,
) -> DataFrame:
    """Candidates that overlap no booking of the same key.

    A candidate [s, e) overlaps some booking exactly when the greatest booking
    end among bookings that start before e lies after s. One running maximum
    answers that, however many bookings a key holds.
    """
    keys = list(keys)
    booked = bookings.select(
        *keys,
        F.col(booked_start).alias("_at"),
        F.lit(1).alias("_kind"),
        F.col(booked_stop).alias("_end"),
        F.xxhash64(booked_start, booked_stop).alias("_tie"),
        F.lit(None).cast(candidates.select(F.struct("*")).schema[0].dataType).alias("_row"),
    )
    asked = candidates.select(
        *keys,
        F.col(stop).alias("_at"),
        # At an equal time the candidate comes first: a booking that starts
        # when the candidate ends does not touch it.
        F.lit(0).alias("_kind"),
        F.lit(None).cast(booked.schema["_end"].dataType).alias("_end"),
        F.xxhash64(F.struct("*")).alias("_tie"),
        F.struct(*candidates.columns).alias("_row"),
    )
    carried = prefix(
        booked.unionByName(asked),
        keys,
        ["_at", "_kind", "_tie"],
        F.floor(F.col("_at") / F.lit(width)).cast("long"),
        {"_busy_until": ("max", F.col("_end"))},
    )
    free = F.col("_busy_until").isNull() | (F.col("_busy_until") <= F.col(f"_row.{start}"))
    return carried.where((F.col("_kind") == 0) & free).select("_row.*")
