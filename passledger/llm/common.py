"""What the text operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passledger.session import configure

#: The white space of the contracts, space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: By byte of UTF-8: A-Z in lower case, letters, digits and all above ASCII as they are, the others a space.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)


def plain_words(text: str) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case, in UTF-8."""
    return text.encode().translate(_PLAIN).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def kept_in_worker(key, build: Callable[[], object]):
    """A value built once in each Python worker and used by all its tasks.

    Functions travel by value, so their globals do not outlive a task; the ``sys``
    module does. Only values of bounded size belong here.
    """
    store = sys.__dict__.setdefault("_passledger_llm", {})
    if key not in store:
        store[key] = build()
    return store[key]


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows, so that a slice holds about ``limit`` bytes of ``column``.

    Rows stay whole; a longer text is a slice of its own.
    """
    sizes = [len(s.as_buffer()) if s.is_valid else 0 for s in batch.column(batch.schema.get_field_index(column))]
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def labelled_sample(
    frame: DataFrame, label: str, per_label: int, longest: int = 20_000, seed: int = 7
) -> list[tuple[str, object]]:
    """At most ``per_label`` (text, label) pairs of every label value, on the driver.

    The bound is a parameter: a row takes part with a probability fixed by its
    label's count, in the order of a hash of its text, and only texts of up to
    ``longest`` code points are training rows. What is collected is bounded by
    ``per_label * longest`` characters a label, however large the table is.
    """
    usable = frame.where(F.col(label).isNotNull() & (F.char_length(whole()) <= longest)).select(
        whole().alias("text"), F.col(label).alias("label")
    )
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not counts:
        return []
    share = F.coalesce(
        *[F.when(F.col("label") == F.lit(k), F.lit(min(1.0, 1.3 * per_label / n + 20 / n))) for k, n in counts.items()],
        F.lit(0.0),
    )
    order = F.xxhash64("text", F.lit(seed))
    drawn = (
        usable.withColumn("draw", order)
        .where((F.pmod(F.col("draw"), F.lit(1_000_003)) / F.lit(1_000_003.0)) < share)
        .dropDuplicates(["draw", "label"])
        .collect()
    )
    taken: dict = {}
    for row in sorted(drawn, key=lambda r: (r["draw"], str(r["label"]))):
        group = taken.setdefault(row["label"], [])
        if len(group) < per_label:
            group.append((row["text"], row["label"]))
    return [pair for key in sorted(taken, key=str) for pair in taken[key]]


def learnable(labels: DataFrame, column: str, divisor: int, out: int) -> DataFrame:
    """(doc_id, label) of the labels to learn from: those whose crc32(doc_id) modulo ``divisor`` is not ``out``."""
    return labels.where(remainder("doc_id", divisor) != out).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("label")
    ).dropna()


def labelled_texts(documents: DataFrame, labels: DataFrame, per_label: int, longest: int) -> list[tuple[str, object]]:
    """At most ``per_label`` (text, label) pairs of every label value, on the driver.

    Ids are drawn from ``labels`` (doc_id, label) by a hash, about three times as many as
    wanted, and only their texts of up to ``longest`` code points are read: the drawn
    ids are a bounded list, so the documents are scanned once and not shuffled. A
    repeated id counts once, with its smallest label.
    """
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if not counts:
        return []
    share = F.coalesce(
        *[F.when(F.col("label") == F.lit(k), F.lit(min(1.0, 3.0 * per_label / n))) for k, n in counts.items()], F.lit(0.0)
    )
    drawn = labels.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)) < share)
    label_of: dict[int, object] = {}
    for row in sorted(drawn.collect(), key=lambda r: (r["doc_id"], str(r["label"]))):
        label_of.setdefault(row["doc_id"], row["label"])
    if not label_of:
        return []
    wanted = documents.sparkSession.createDataFrame([(k,) for k in label_of], "doc_id long")
    texts = (
        documents.where(F.char_length(whole()) <= longest)
        .select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
        .join(F.broadcast(wanted), "doc_id").withColumn("draw", F.xxhash64("doc_id", F.lit(11))).collect()
    )
    taken: dict[object, dict[int, str]] = {}
    for row in sorted(texts, key=lambda r: (r["draw"], r["doc_id"], r["text"])):
        group = taken.setdefault(label_of[row["doc_id"]], {})
        if len(group) < per_label:
            group.setdefault(row["doc_id"], row["text"])
    return [(text, label) for label in sorted(taken, key=str) for text in taken[label].values()]


def appended(
    frame: DataFrame, columns: str, make: Callable[[list[str]], list[pa.Array]], text: str = "text", limit: int = 4_000_000
) -> DataFrame:
    """``frame`` with the columns of the DDL ``columns``, made from whole texts.

    ``make`` gets the texts of a slice of rows (null as empty) and answers with an array
    for each new column. All other columns pass through; columns of the same names are
    replaced.
    """
    added = StructType.fromDDL(columns)
    plain = frame.drop(*added.names)
    inner = "_text"
    while inner.lower() in (c.lower() for c in plain.columns):
        inner += "_"
    schema = StructType([*plain.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, inner, limit):
                made = make([t.as_py() for t in part.column(part.num_columns - 1)])
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return plain.withColumn(inner, whole(text)).mapInArrow(run, schema)
