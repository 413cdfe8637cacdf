"""Ordered computations that never put one whole key into one task.

A plain window sorts every row of a key in a single task. Here a caller gives a
``bucket`` that never decreases along the order (an hour, a day, a value band).
Windows run inside (key, bucket), one small row per bucket carries the totals of
earlier buckets across, and the two are added up. The results equal those of the
plain window; a key with a third of all rows spreads over its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _GROUP, _SALT = "_bucket", "_group", "_salt"
# Tasks that share one very frequent value; a power of two.
_SALTS = 8


def _ordering(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _within(kind: str, column: Column, window) -> Column:
    if kind == "count":
        return F.count(column).over(window)
    if kind == "last":
        return F.last(column, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](column).over(window)


def _summary(kind: str, column: Column, order: Column, descending: bool) -> Column:
    if kind == "count":
        return F.count(column)
    if kind == "last":
        pick = F.min_by if descending else F.max_by
        return pick(column, F.when(column.isNotNull(), order))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](column)


def _combine(kind: str, before: Column, inside: Column) -> Column:
    if kind in ("count", "sum"):
        total = F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
        return total if kind == "count" else F.when(
            before.isNotNull() | inside.isNotNull(), total
        )
    if kind == "last":
        return F.coalesce(inside, before)
    return (F.greatest if kind == "max" else F.least)(before, inside)


def prefix(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Mapping[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    descending: bool = False,
) -> DataFrame:
    """Add running values over the rows up to (or strictly before) each row.

    ``values`` maps an output name to (kind, column); kinds are count, sum, max,
    min and last (the latest non-null value). ``order`` must be total within a key.
    Null keys are one key, and a null bucket is one bucket: first in ascending, last
    in descending order, where a null order value stands too.
    """
    # One struct names a group: it is never null, so groups with null parts join and
    # the window, the totals and the join share a partitioning.
    rows = frame.withColumn(_GROUP, F.struct(*keys, (-bucket if descending else bucket).alias(_BUCKET)))
    position = F.struct(*[F.col(c) for c in order])
    inside = (
        Window.partitionBy(_GROUP)
        .orderBy(*_ordering(order, descending))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    place = F.col(f"{_GROUP}.{_BUCKET}")
    earlier = (
        Window.partitionBy(F.struct(F.lit(0), *[F.col(f"{_GROUP}.`{k}`") for k in keys]))
        .orderBy(place.asc_nulls_last() if descending else place.asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = rows.groupBy(_GROUP).agg(
        *[
            _summary(kind, column, position, descending).alias(f"_total_{name}")
            for name, (kind, column) in values.items()
        ]
    )
    carried = totals.select(
        _GROUP,
        *[
            _within("sum" if kind == "count" else kind, F.col(f"_total_{name}"), earlier)
            .alias(f"_before_{name}")
            for name, (kind, _) in values.items()
        ],
    )
    local = rows.select(
        "*",
        *[
            _within(kind, column, inside).alias(f"_inside_{name}")
            for name, (kind, column) in values.items()
        ],
    )
    return local.join(carried, _GROUP).select(
        *frame.columns,
        *[
            _combine(kind, F.col(f"_before_{name}"), F.col(f"_inside_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )


def ordinal(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "ordinal",
    *,
    descending: bool = False,
) -> DataFrame:
    """1-based position of each row within its key."""
    return prefix(
        frame, keys, order, bucket, {name: ("count", F.lit(1))}, descending=descending
    )


def neighbour(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: Sequence[str],
    name: str,
    *,
    following: bool = False,
) -> DataFrame:
    """The row before (or after) each row as one struct, null at the end."""
    return prefix(
        frame,
        keys,
        order,
        bucket,
        {name: ("last", F.struct(*columns))},
        inclusive=False,
        descending=following,
    )


def value_band(value: Column, resolution: int = 1024) -> Column:
    """A band index that never decreases with the value: linear near zero,
    logarithmic beyond, so the bands follow the data over any range. NaN has the
    last band, as it sorts behind all numbers."""
    finite = F.least(F.abs(value), F.lit(1e300))
    band = F.floor(F.signum(value) * F.log1p(finite) * resolution).cast("long")
    return F.when(F.isnan(value), F.lit(1 << 62)).otherwise(band)


def exact_percentiles(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    *,
    resolution: int = 1024,
) -> DataFrame:
    """Exact interpolated percentiles without holding a key in one task.

    Rows are dealt out once by key, value band and a salt, before anything is held, so a
    task holds its share of the shuffle and not all of its part of the input. Bands that
    hold the wanted ranks are found from the band counts; only their rows go on, equal
    ones as one counted row for each salt, and only they are ordered. Null values are
    left out, null keys are one key, and NaN counts as greater than any number.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    rows = frame.where(number.isNotNull()).select(
        F.struct(*(keys or [F.lit(0).alias("_")])).alias(_GROUP),
        number.alias("_v"),
        F.spark_partition_id().bitwiseAND(_SALTS - 1).alias(_SALT),
    )
    # Without nulls the join below adds no filter of its own, and the band is no column
    # under the exchange that one use could drop: both uses read the same exchange.
    band = F.coalesce(value_band(F.col("_v"), resolution), F.lit(0))
    dealt = rows.repartition(_GROUP, band, _SALT).withColumn(_BUCKET, band)
    counts = dealt.groupBy(_GROUP, _BUCKET, _SALT).agg(F.count(F.lit(1)).alias("_c"))
    # A band has a row for each of its salts, so frames go by its value.
    upto = Window.partitionBy(_GROUP).orderBy(_BUCKET)
    bands = counts.select(
        _GROUP,
        _BUCKET,
        F.lag(_BUCKET).over(upto).alias("_last"),
        F.coalesce(F.sum("_c").over(upto.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        F.sum("_c").over(upto).alias("_upto"),
        F.sum("_c").over(Window.partitionBy(_GROUP)).alias("_n"),
    )
    at = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in fractions.items()}
    low = {name: F.floor(a).cast("long") for name, a in at.items()}
    high = {name: F.ceil(a).cast("long") for name, a in at.items()}
    inside = [(high[name] >= F.col("_from")) & (low[name] < F.col("_upto")) for name in fractions]
    wanted = (
        bands.where((F.col("_last").isNull() | (F.col("_last") != F.col(_BUCKET))) & reduce(or_, inside))
        .select(_GROUP, _BUCKET, "_from", "_n", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias(_SALT))
    )
    within = [_GROUP, _BUCKET, _SALT]
    counted = dealt.join(wanted.hint("shuffle_hash"), within).groupBy(*within, "_from", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(_GROUP, _BUCKET).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_end", F.col("_from") + F.sum("_c").over(running)).withColumn(
        "_start", F.col("_end") - F.col("_c")
    )

    def holder(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))

    picked = placed.groupBy(_GROUP, "_n").agg(
        *[holder(rank[name]).alias(f"_{side}_{name}") for side, rank in (("lo", low), ("hi", high)) for name in fractions]
    )

    def between(name: str) -> Column:
        lo, hi, part = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), at[name] - low[name]
        return F.when((part == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * part)

    return picked.select(*[F.col(f"{_GROUP}.`{k}`").alias(k) for k in keys], *[between(name).alias(name) for name in fractions])
