"""Orbit ephemeris messages (KVN): ingest, validation, selection, writing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passledger.functions.geometry import finite, norm, vector
from passledger.functions.scalars import all_reasons, micros_to_text, text_to_micros
from passledger.operators.ordered import neighbour, prefix
from passledger.sources import files

# What a message may declare.
FRAMES = ("GCRF", "EME2000", "ITRF", "TEME", "ICRF")
TIME_SYSTEMS = ("UTC", "TAI", "TT")
_LINES_PER_BUCKET = 100_000


def read_lines(spark: SparkSession, source: str) -> DataFrame:
    """Numbered lines of every message under a path, one job for all files.

    A large message is read in splits. Inside one a task's rows are in the order of the
    file; across them the line counts of earlier splits are carried.
    """
    lines = spark.read.text(source).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_place"), F.col("value").alias("text"),
    )
    numbered = prefix(lines, ["file"], ["_split", "_place"], F.col("_split"), {"line_no": ("count", F.lit(1))})
    return numbered.select("file", "line_no", "text")


def classify(lines: DataFrame) -> DataFrame:
    """Each line with its segment number and mode: header, metadata or data."""
    text = F.trim("text")
    useful = lines.withColumn("text", text).where(
        (F.col("text") != "") & ~F.col("text").startswith("COMMENT")
    )
    marked = prefix(
        useful,
        ["file"],
        ["line_no"],
        F.floor(F.col("line_no") / _LINES_PER_BUCKET).cast("long"),
        {
            "segment": ("sum", F.when(F.col("text") == "META_START", 1).otherwise(0)),
            "_stops": ("sum", F.when(F.col("text") == "META_STOP", 1).otherwise(0)),
        },
    )
    return marked.withColumn("mode", _mode()).drop("_stops")


def _mode() -> Column:
    return (
        F.when(F.col("segment") == 0, "header")
        .when(F.col("segment") == F.col("_stops"), "data")
        .when(F.col("segment") == F.col("_stops") + 1, "metadata")
        .otherwise("broken")
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """``classify`` of the messages that ``write_messages`` left, counted while a task streams a file."""

    def started() -> Callable[[pa.Array], dict[str, pa.Array]]:
        seen = {"segment": 0, "_stops": 0}

        def told(texts: pa.Array) -> dict[str, pa.Array]:
            trimmed, out = pc.utf8_trim(texts, " "), {}
            for name, mark in (("segment", "META_START"), ("_stops", "META_STOP")):
                counts = seen[name] + np.cumsum(pc.equal(trimmed, mark).to_numpy(zero_copy_only=False), dtype=np.int64)
                seen[name] = int(counts[-1])
                out[name] = pa.array(counts)
            return out

        return told

    lines = files.read_keyed(spark, path, started, "segment long, _stops long").withColumn("text", F.trim("text"))
    useful = lines.where((F.col("text") != "") & ~F.col("text").startswith("COMMENT"))
    return useful.withColumn("mode", _mode()).drop("_stops")


def keywords(classified: DataFrame) -> DataFrame:
    """Keyword rows with the number of times each was given in its section."""
    pairs = classified.where(F.col("text").contains("=") & F.col("mode").isin("header", "metadata"))
    key = F.trim(F.substring_index("text", "=", 1))
    value = F.trim(F.expr("substring(text, instr(text, '=') + 1)"))
    return pairs.groupBy("file", "segment", "mode", key.alias("key")).agg(
        F.min(value).alias("value"), F.count(F.lit(1)).alias("copies")
    )


def states(classified: DataFrame) -> DataFrame:
    """Typed states in metres; a line that is no state keeps a reason."""
    rows = classified.where(
        (F.col("mode") == "data") & (F.col("text") != "META_STOP") & ~F.col("text").contains("=")
    ).withColumn("_p", F.split("text", r"\s+"))
    numbers = [F.try_element_at("_p", F.lit(i + 2)).try_cast("double") for i in range(6)]
    names = ("x", "y", "z", "vx", "vy", "vz")
    typed = rows.select(
        "file", "segment", "line_no",
        text_to_micros(F.concat(F.element_at("_p", 1), F.lit("Z"))).alias("t_us"),
        *[(n * 1000.0).alias(c) for n, c in zip(numbers, names)],
        F.size("_p").alias("_fields"),
    )
    bad = F.col("_fields") != 7
    for c in ("t_us", *names):
        bad = bad | F.col(c).isNull()
    return typed.withColumn(
        "reason", F.when(bad, "expected epoch and six state components").otherwise("")
    ).drop("_fields")


def message_findings(classified: DataFrame) -> DataFrame:
    """Per file: duplicate keywords, wrong centre, frame, time system or layout."""
    pair = F.col("text").contains("=") & F.col("mode").isin("header", "metadata")
    key = F.when(pair, F.trim(F.substring_index("text", "=", 1)))
    given = F.when(pair, F.trim(F.expr("substring(text, instr(text, '=') + 1)")))
    # The lines are read once: few rows for each file are left after the first step.
    keys = classified.groupBy("file", "segment", "mode", key.alias("key")).agg(
        F.min(given).alias("value"), F.count(F.lit(1)).alias("lines"), F.count_if(F.col("text") != "META_STOP").alias("_inside")
    )

    def value(name: str) -> Column:
        return F.max(F.when(F.col("key") == name, F.upper("value")))

    def total(mode: str, count: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("mode") == mode, F.col(count))), F.lit(0))

    declared = keys.groupBy("file").agg(
        F.max(F.when(F.col("key").isNotNull(), F.col("lines"))).alias("_copies"),
        value("CENTER_NAME").alias("_centre"),
        value("REF_FRAME").alias("_frame"),
        value("TIME_SYSTEM").alias("_time"),
        F.count_if(F.col("key") == "REF_FRAME_EPOCH").alias("_epoch"),
        total("broken", "lines").alias("_broken"),
        total("data", "_inside").alias("samples"),
        F.max("segment").alias("segments"),
    )
    return declared.select(
        "file", "segments", "samples",
        all_reasons(
            [
                (F.col("_copies") > 1, "duplicate keyword"),
                (F.coalesce("_centre", F.lit("")) != "EARTH", "only Earth-centred messages are supported"),
                (~F.coalesce("_frame", F.lit("")).isin(*FRAMES), "unsupported reference frame"),
                (~F.coalesce("_time", F.lit("")).isin(*TIME_SYSTEMS), "unsupported time system"),
                (F.col("_epoch") > 0, "a frame epoch needs an explicit adapter"),
                (F.col("_broken") > 0, "sections out of order"),
                (F.col("samples") == 0, "incomplete or empty message"),
            ]
        ).alias("findings"),
    )


def validate_grid(
    frame: DataFrame, key: str, start_us: Column, stop_us: Column, cadence_us: Column
) -> DataFrame:
    """Whether a product lies on its whole grid, ordered, finite and in low orbit."""
    bucket = F.floor(F.col("t_us") / 86_400_000_000).cast("long")
    stepped = neighbour(frame, [key], ["t_us", "line_no"], bucket, ["t_us", "line_no"], "_prev")
    radius, speed = norm(vector("x", "y", "z")), norm(vector("vx", "vy", "vz"))
    usable = F.lit(True)
    for c in ("x", "y", "z", "vx", "vy", "vz"):
        usable = usable & finite(F.col(c))
    off = (F.col("t_us") - start_us) % cadence_us != 0
    grouped = stepped.groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("t_us").alias("first_us"),
        F.max("t_us").alias("last_us"),
        F.count_if(off).alias("_off"),
        F.count_if(
            (F.col("t_us") <= F.col("_prev.t_us")) | (F.col("line_no") < F.col("_prev.line_no"))
        ).alias("_back"),
        F.count_if(~usable).alias("_odd"),
        F.count_if((radius <= 6378e3) | (radius >= 10000e3) | (speed >= 12e3)).alias("_far"),
    )
    expected = F.expr("1") * ((stop_us - start_us) / cadence_us + 1).cast("long")
    return grouped.select(
        key, "samples",
        all_reasons(
            [
                (
                    (F.col("samples") != expected)
                    | (F.col("first_us") != start_us)
                    | (F.col("last_us") != stop_us)
                    | (F.col("_off") > 0),
                    "epochs do not match the requested grid",
                ),
                ((F.col("_back") > 0) | (F.col("_odd") > 0), "nonfinite states or nonincreasing epochs"),
                (F.col("_far") > 0, "states are inconsistent with a low orbit"),
            ]
        ).alias("findings"),
    )


def reference_samples(
    frame: DataFrame, start_us: Column, stop_us: Column, *, after_start: bool = False
) -> DataFrame:
    """Actual samples of the window; segments stay apart."""
    opened = F.col("t_us") > start_us if after_start else F.col("t_us") >= start_us
    return frame.where(opened & (F.col("t_us") <= stop_us))


def message_lines(
    frame: DataFrame, objects: DataFrame, *, originator: str, created: str
) -> DataFrame:
    """Numbered lines of one message per object, one segment per history.

    ``frame`` holds object_id, segment, t_us and metres; ``objects`` object_id and
    object_name. Lines sort by (object_id, segment, t_us, part).
    """
    if not originator.strip() or not created.strip():
        raise ValueError("originator and creation date must be explicit")
    header = [
        "CCSDS_OEM_VERS = 3.0",
        f"CREATION_DATE = {created}",
        f"ORIGINATOR = {originator}",
        "",
    ]
    none = F.lit(-1).cast("long")
    head = objects.select(
        "object_id", none.alias("segment"), none.alias("t_us"),
        F.posexplode(F.array(*[F.lit(x) for x in header])).alias("part", "text"),
    )
    extent = frame.groupBy("object_id", "segment").agg(
        F.min("t_us").alias("_first"), F.max("t_us").alias("_last")
    )
    fields = [
        F.lit("META_START"),
        F.concat(F.lit("OBJECT_NAME = "), "object_name"),
        F.concat(F.lit("OBJECT_ID = "), F.col("object_id").cast("string")),
        F.lit("CENTER_NAME = EARTH"),
        F.lit("REF_FRAME = GCRF"),
        F.lit("TIME_SYSTEM = UTC"),
        F.concat(F.lit("START_TIME = "), micros_to_text(F.col("_first"), "product")),
        F.concat(F.lit("STOP_TIME = "), micros_to_text(F.col("_last"), "product")),
        F.lit("META_STOP"),
    ]
    meta = extent.join(objects, "object_id").select(
        "object_id", F.col("segment").cast("long").alias("segment"), none.alias("t_us"),
        F.posexplode(F.array(*fields)).alias("part", "text"),
    )
    body = frame.select(
        "object_id", F.col("segment").cast("long").alias("segment"), "t_us", F.lit(0).alias("part"),
        F.concat_ws(
            " ",
            micros_to_text(F.col("t_us"), "product"),
            *[F.format_string("%.6f", F.col(c) / 1000.0) for c in ("x", "y", "z")],
            *[F.format_string("%.9f", F.col(c) / 1000.0) for c in ("vx", "vy", "vz")],
        ).alias("text"),
    )
    return head.unionByName(meta).unionByName(body)


def write_messages(lines: DataFrame, path: str, order: tuple[str, ...] = ("segment", "t_us", "part")) -> None:
    """One file per object, ``object_id=....txt``. One task writes it, streaming its sorted lines."""
    files.write_keyed(lines, "object_id", order, path)
