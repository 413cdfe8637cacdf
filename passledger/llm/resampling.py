"""Importance resampling towards a target corpus: documents are drawn without replacement.

Hashed word runs are counted in the documents and in the target texts. A document's
weight is the sum of its runs' log ratios, read from an array; Gumbel noise fixed by its
id makes the highest scores a weighted draw. The last drawn key is found by weighted
median-of-medians: every partition tells the median of its remaining keys and how many
they are, the weighted median of those is the pivot, and the side without the cutoff
goes, a quarter of the keys at the least. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passledger.llm.common import appended, plain_words, text_slices, whole
from passledger.session import scratch_path

BUCKETS = 10_000
#: A draw's order: score falling, then doc_id rising (null last), then n_features falling.
_KEY = ["k_score", "k_null", "k_id", "k_features"]


class _Buckets(dict):
    """Bucket of a feature, remembered for up to a million features."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


def features_of(text: str, longest: int) -> tuple[list[bytes], int]:
    """All runs of up to ``longest`` words, joined by a space, and the number of words."""
    words = plain_words(text)
    found = list(words)
    for n in range(2, longest + 1):
        found += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return found, len(words)


def bucket_counts(frame: DataFrame, longest: int = 1, buckets: int = BUCKETS, column: str = "text") -> np.ndarray:
    """How often each bucket's features stand in all texts of ``frame``; null texts have none.

    A task answers with at most ``buckets`` sums, and so does the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sums = _Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for text in part.column("text"):
                    found = features_of(text.as_py(), longest)[0]
                    sums += np.bincount(np.fromiter(map(number.__getitem__, found), np.int64, len(found)), minlength=buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["bucket", "n"])

    rows = frame.select(whole(column).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    counts = np.zeros(buckets, dtype=np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, the log ratio of target to source frequency in thousandths, one added to each count."""
    s, t, size = float(source.sum() + len(source)), float(target.sum() + len(target)), len(source)
    return np.array(
        [math.floor(1000 * math.log((float(target[i]) + 1) * s / ((float(source[i]) + 1) * t))) for i in range(size)], np.int64
    )


def scored(frame: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024, column: str = "text") -> DataFrame:
    """``frame`` with n_words, n_features, weight and score.

    A text without words (null, empty) has weight 0 and still a score. A null doc_id
    counts as the empty text in the noise. Columns of these names are replaced.
    """
    buckets = len(gain)

    def make(texts: list[str]) -> list[pa.Array]:
        number, rows = _Buckets(buckets), []
        for text in texts:
            found, words = features_of(text, longest)
            own = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
            rows.append((words, len(found), int(gain[own].sum())))
        return [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))]

    rows = appended(frame, "n_words bigint, n_features bigint, weight bigint", make, column)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def cutoff(keys: DataFrame, place: int) -> tuple[int, ...]:
    """The key at ``place`` (from 0) in the rising order of all rows of ``keys`` (long columns).

    A round is one job over what remains and answers with one row a partition. Of the
    keys on the pivot's side of a partition's median at least half are beyond the pivot,
    and such partitions hold half of all keys.
    """
    names = keys.columns
    fields = [f"{side}_{c}" for side in ("low", "high") for c in names]
    schema = "n_low bigint, n_same bigint, n_high bigint, " + ", ".join(f"`{f}` bigint" for f in fields)
    low = high = pivot = None

    def side(rows: np.ndarray) -> list[int | None]:
        if not len(rows):
            return [None] * rows.shape[1]
        order = np.lexsort(rows.T[::-1])
        return rows[order[(len(rows) - 1) // 2]].tolist()

    def summary(at):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches if b.num_rows]
            if not parts:
                return
            rows = np.concatenate(parts)
            below, same = np.zeros(len(rows), bool), np.full(len(rows), at is not None)
            for i, value in enumerate(at or ()):
                below |= same & (rows[:, i] < value)
                same &= rows[:, i] == value
            above = ~below & ~same
            values = [int(below.sum()), int(same.sum()), int(above.sum()), *side(rows[below]), *side(rows[above])]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], names=["n_low", "n_same", "n_high", *fields])

        return run

    key = F.struct(*names)
    literal = lambda at: F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(at, names)])
    while True:
        left = keys
        if low is not None:
            left = left.where(key > literal(low))
        if high is not None:
            left = left.where(key < literal(high))
        told = left.mapInArrow(summary(pivot), schema).collect()
        below, same = sum(r["n_low"] for r in told), sum(r["n_same"] for r in told)
        if pivot is not None and below <= place < below + same:
            return pivot
        down = place < below
        if pivot is not None and down:
            high = pivot
        elif pivot is not None:
            low, place = pivot, place - below - same
        name, count = ("low", "n_low") if down else ("high", "n_high")
        medians = sorted((tuple(r[f"{name}_{c}"] for c in names), r[count]) for r in told if r[count])
        if not medians:
            raise ValueError("place is beyond the last key")
        half, seen = sum(n for _, n in medians) / 2, 0
        for pivot, n in medians:  # noqa: B007
            seen += n
            if seen >= half:
                break


def numbered(frame: DataFrame, order: list[str], column: str) -> DataFrame:
    """``frame`` with the place of each row (from 1) in ``order``, by ranges of the order.

    The ranges are written before they are counted, so every task that is run again
    finds the same rows.
    """
    spark = frame.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path = scratch_path(spark, "ranges")
    frame.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema("_range int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)).parquet(path)
    seen, starts = 0, []
    for row in sorted(rows.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        starts.append((row["_range"], seen))
        seen += row["count"]
    begin = spark.createDataFrame(starts, "_range int, _start long")
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        rows.withColumn(column, here.cast("long")).join(F.broadcast(begin), "_range")
        .withColumn(column, F.col(column) + F.col("_start")).drop("_range", "_start")
    )


def drawn(
    frame: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``frame`` (doc_id, text).

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (rounded
    down) get a rank from 1; the others' is null. Equal scores go by smaller doc_id,
    null last; repeated rows are drawn one by one. Empty tables give no row, an empty
    target a gain by the documents alone.
    """
    spark = frame.sparkSession
    docs = frame.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    path = scratch_path(spark, "scores")
    rows = scored(docs, gain, longest, seed).drop("text")
    rows.select(
        "*", (-F.col("score")).alias("k_score"), F.col("doc_id").isNull().cast("long").alias("k_null"),
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("k_id"), (-F.col("n_features")).alias("k_features"),
    ).write.parquet(path)
    rows = spark.read.schema(
        "doc_id long, n_words long, n_features long, weight long, score long, k_score long, k_null long, k_id long, k_features long"
    ).parquet(path)
    told = rows.where(F.col("n_words") >= least_words)
    keep = told.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not keep:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    last = F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(cutoff(told.select(*_KEY), keep - 1), _KEY)])
    won = (F.col("n_words") >= least_words) & (F.struct(*_KEY) <= last)
    winners = numbered(rows.where(won).select(*out, *_KEY), _KEY, "rank")
    # of rows equal to the last drawn one, those beyond the number to draw are not drawn
    winners = winners.select(*out, F.when(F.col("rank") <= keep, F.col("rank")).alias("rank"))
    return rows.where(~won).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(winners)
