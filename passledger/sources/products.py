"""Result files, provenance, digests and descriptors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passledger.functions.scalars import first_reason
from passledger.sources.files import located


def prior_provenance(priors: DataFrame) -> DataFrame:
    """Digests of the element lines and of the whole text, and availability."""
    lines = F.array_join(F.slice(F.split("tle", "\n"), -2, 2), "\n")
    return priors.withColumns(
        {
            "tle_lines_sha256": F.sha2(lines, 256),
            "source_text_sha256": F.sha2("tle", 256),
            "available_us": F.col("submitted_us"),
        }
    )


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("header", True).csv(path)


def pending_attempts(planned: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Planned attempts without a finished record of the same identity and digest."""
    return planned.join(finished.select(*keys), keys, "left_anti")


def write_attempts(results: DataFrame, path: str, partition: str) -> None:
    """Each attempt once: a rerun replaces only the partitions it holds."""
    (
        results.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def _opened(path: str):
    """A stream of the bytes at a path as Spark names it."""
    system, inner = located(path)
    return system.open_input_stream(inner, compression=None)


def file_digests(spark: SparkSession, source: str, piece: int = 1 << 20) -> DataFrame:
    """name, sha256 and byte_count of every file below a path.

    Only the names are scanned; a task hashes its files in pieces of ``piece`` bytes through
    pyarrow's file systems, so a file of any size takes the memory of one piece. Spark's
    scan leaves out files of no bytes, and so does this.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                with _opened(path) as stream:
                    while part := stream.read(piece):
                        digest.update(part)
                        size += len(part)
                rows.append((path.rsplit("/", 1)[-1], digest.hexdigest(), size))
            names, digests, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["name", "sha256", "byte_count"]
            )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path")
    return files.mapInArrow(run, "name string, sha256 string, byte_count long")


def verify_manifest(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Files listed against files found: missing, unlisted or changed."""
    listed = manifest.select("name", F.col("sha256").alias("_listed"))
    return listed.join(digests.select("name", F.col("sha256").alias("_found")), "name", "full_outer").select(
        "name",
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("_listed").isNull(), "unlisted")
        .when(F.col("_found") != F.col("_listed"), "changed")
        .otherwise("verified")
        .alias("status"),
    )


def distinct_contents(artifacts: DataFrame, payload: str, name: str) -> DataFrame:
    """Equal bytes once, under their digest, with the number of names."""
    return artifacts.groupBy(F.sha2(payload, 256).alias("sha256")).agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(name).alias("first_name"),
        F.max(F.octet_length(payload)).alias("byte_count"),
    )


def artifact_rows(artifacts: DataFrame, payload: str, provenance: list[str]) -> DataFrame:
    binary = F.col(payload).cast("binary")
    return artifacts.select(
        "artifact_id", "kind", "filename", "content_type",
        F.sha2(binary, 256).alias("sha256"),
        F.octet_length(binary).alias("byte_count"),
        F.to_json(F.struct(*provenance)).alias("provenance"),
    )


def append_audit(records: DataFrame, path: str) -> None:
    """One JSON line per lifecycle event; earlier lines are never rewritten."""
    records.write.mode("append").json(path)


DESCRIPTOR = (
    "format_version int, model string, object_id string, solution_id string, "
    "tle_lines array<string>, offsets array<double>"
)


def save_descriptors(solutions: DataFrame) -> DataFrame:
    """Each solution as a lossless JSON descriptor."""
    body = F.struct(
        F.lit(1).alias("format_version"), F.lit("sgp4").alias("model"),
        "object_id", "solution_id", "tle_lines", "offsets",
    )
    return solutions.select("solution_id", F.to_json(body).alias("descriptor"))


def load_descriptors(descriptors: DataFrame) -> DataFrame:
    """Descriptors back as columns, with the reason a bad one is refused."""
    flat = descriptors.select(F.from_json("descriptor", DESCRIPTOR).alias("_d")).select("_d.*")
    numbers = F.coalesce(
        F.forall("offsets", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        F.lit(False),
    )
    return flat.withColumn(
        "reason",
        first_reason(
            [
                (
                    ~F.coalesce((F.col("format_version") == 1) & (F.col("model") == "sgp4"), F.lit(False)),
                    "format",
                ),
                (
                    (F.coalesce(F.size("offsets"), F.lit(0)) != 7) | ~numbers,
                    "offsets",
                ),
                (F.coalesce(F.size("tle_lines"), F.lit(0)) != 2, "tle_lines"),
            ]
        ),
    )
