"""Many text files, one for each key, written, listed and read in tasks.

Spark's own writer makes a folder for each key, renames every file in the driver and
lists all of them there again. Here a task writes the files of its keys into one folder,
so the driver sees a folder for each task, however many files there are. pyarrow opens
the files: the folder must be one that it and all executors reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NO_KEY = "__HIVE_DEFAULT_PARTITION__"  # as Spark names a null key
_PIECE = 1 << 20


def located(path: str):
    """The file system of a path as Spark names it, and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Buffer]]:
    """Each run of one key and the bytes of its lines, which lie side by side."""
    keys, texts = batch.column("key"), batch.column("text")
    starts = [0, *(np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1), len(keys)]
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    for a, b in zip(starts, starts[1:]):
        yield keys[int(a)].as_py(), data.slice(int(ends[a]), int(ends[b] - ends[a]))


def write_keyed(lines: DataFrame, key: str, order: Sequence[str], path: str) -> int:
    """A file ``key=value.txt`` for each value of ``key``: its ``text`` in ``order``. Returns their number.

    A key is one file, so one task streams its sorted lines; null texts are empty lines.
    A file has its name only when it is whole, so a task that is run again leaves no part.
    """
    target = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = located(target)
        folder = f"{root}/{context.partitionId():06d}"
        part = f"{folder}/.{context.taskAttemptId()}.part"
        name, stream, count = None, None, 0

        def close() -> None:
            stream.close()
            final = f"{folder}/{quote(f'{key}={name}', safe='= ')}.txt"
            try:
                system.move(part, final)
            except OSError:  # HDFS does not move onto the file of an earlier attempt
                system.delete_file(final)
                system.move(part, final)

        for batch in batches:
            if not batch.num_rows:
                continue
            for value, content in _runs(batch):
                if value != name:
                    if stream is None:
                        system.create_dir(folder, recursive=True)
                    else:
                        close()
                    name, stream, count = value, system.open_output_stream(part, compression=None), count + 1
                stream.write(content)
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["files"])

    # A number of its own: partitions of few bytes and many files must not be merged.
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.repartition(tasks, key).sortWithinPartitions(key, *order).select(
        F.coalesce(F.col(key).cast("string"), F.lit(_NO_KEY)).alias("key"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text")
    )
    return placed.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


def _below(spark: SparkSession, path: str, read: Callable, schema: str) -> DataFrame:
    """``read(system, root, files)`` over the files of each task's folder below ``path``."""
    from pyarrow import fs

    target = path.rstrip("/")
    system, root = located(target)
    folders = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory)
    if not folders:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(target)
        for batch in batches:
            for number in batch.column("id").to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{root}/{folders[number]}"))
                files = [
                    (unquote(i.base_name.removesuffix(".txt").partition("=")[2]), f"{folders[number]}/{i.base_name}", i.size)
                    for i in found if not i.base_name.startswith(".")
                ]
                yield from read(system, root, files)

    return spark.range(0, len(folders), 1, len(folders)).mapInArrow(run, schema)


def _pieces(stream) -> Iterator[pa.Array]:
    """Lines of a stream in order, a piece of it at a time."""
    held = []
    while part := stream.read(_PIECE):
        cut = part.rfind(b"\n") + 1
        if cut:
            yield pa.array(b"".join([*held, part[:cut]]).splitlines(), pa.binary()).cast(pa.string())
            held = []
        held.append(part[cut:])
    if last := b"".join(held):
        yield pa.array(last.splitlines(), pa.binary()).cast(pa.string())


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small batches as fewer ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_keyed(spark: SparkSession, path: str, per_line: Callable[[], Callable[[pa.Array], dict[str, pa.Array]]] | None = None, more: str = "") -> DataFrame:
    """Numbered lines (key, file, line_no, text) of every file that ``write_keyed`` left.

    A file is streamed by one task, as it was written. ``per_line`` starts a file and gives
    the function that takes its lines piece by piece, for the columns ``more`` beside them.
    """

    def read(system, root: str, files: list[tuple]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for key, file, _ in files:
                number, told = 0, per_line() if per_line else lambda texts: {}
                with system.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for texts in _pieces(stream):
                        n = len(texts)
                        columns = {
                            "key": pa.repeat(key, n), "file": pa.repeat(file, n),
                            "line_no": pa.array(np.arange(number + 1, number + n + 1)), "text": texts, **told(texts),
                        }
                        number += n
                        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        yield from _gathered(each())

    return _below(spark, path, read, "key string, file string, line_no long, text string" + (f", {more}" if more else ""))


def digests(spark: SparkSession, path: str, piece: int = _PIECE) -> DataFrame:
    """key, sha256 and byte_count of every file that ``write_keyed`` left, hashed in pieces."""
    import hashlib

    def read(system, root: str, files: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, file, _ in files:
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(f"{root}/{file}", compression=None) as stream:
                while part := stream.read(piece):
                    digest.update(part)
                    size += len(part)
            rows.append((key, digest.hexdigest(), size))
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["key", "sha256", "byte_count"]
        )

    return _below(spark, path, read, "key string, sha256 string, byte_count long")
