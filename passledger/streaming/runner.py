"""Start and finish helpers shared by the streaming operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from passledger.session import scratch_path

#: Fixed value: the time of the row that ends a replay, 9000-01-01; no sample is that late.
END_US = 221_845_392_000_000_000
_STATE_SETTINGS = {
    # Timers and list states need this store; a commit writes what changed, not the whole state.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def table_stream(spark: SparkSession, folder: str, table: str, files: int = 1_000) -> DataFrame:
    """A table's files as a stream; new files become new batches of at most ``files``.

    The table is one file or a folder of part files; the pattern names just it, since
    a stream takes a pattern for either and a plain path only for a folder.
    """
    path = f"{folder.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema  # fails where there is no table
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path[:-1] + "[t]")


def run_available(stream: DataFrame, path: str, settle: bool = True):
    """Process all that is available into the table at ``path``; another call goes on from there.

    With ``settle`` a last batch without rows runs the timers that the final watermark reached.
    """
    spark = stream.sparkSession
    settings = _STATE_SETTINGS | {"spark.sql.streaming.noDataMicroBatches.enabled": str(settle).lower()}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        running = (
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", path + "-state")
            .trigger(availableNow=True).start(path)
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    running.awaitTermination()
    return running


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process all that is available into a table in the shared folder."""
    path = scratch_path(stream.sparkSession, label)
    run_available(stream, path)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def replay(rows: DataFrame, build: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What the stream ``build(rows)`` tells of all rows available, and of their end.

    The stream is run to the end of ``rows`` and then, from its checkpoint, over one
    more row of ``END_US`` in t_us and nulls elsewhere. That row moves the watermark past
    every timer, so whatever waits for later rows comes out and the state is emptied.
    """
    spark = rows.sparkSession
    path, end = scratch_path(spark, label), scratch_path(spark, label + "-end")
    spark.createDataFrame([], rows.schema).write.parquet(end)
    closing = spark.readStream.schema(rows.schema).parquet(end)
    stream = build(rows.unionByName(closing))
    run_available(stream, path, settle=False)
    last = [F.lit(END_US if f.name == "t_us" else None).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(end)
    run_available(stream, path)
    return spark.read.schema(stream.schema).parquet(path)


def timed(rows: DataFrame, lateness: str) -> DataFrame:
    """Rows with a watermark on t_us, without the row that ends a replay.

    The watermark's column goes, so a row behind the watermark still reaches the
    processor, which says what becomes of it.
    """
    at = rows.withColumn("_at", F.timestamp_micros("t_us")).withWatermark("_at", lateness)
    return at.where(F.col("_at") < F.timestamp_micros(F.lit(END_US))).select(*rows.columns)


def framed(rows: list[tuple], output: str) -> pd.DataFrame:
    fields = [f.split() for f in output.split(", ")]
    frame = pd.DataFrame(rows, columns=[f[0] for f in fields])
    return frame.astype({name: "Int64" for name, kind in fields if kind == "long"})


def _plain(value, kind: DataType):
    """A value as Python keeps it: lists instead of arrays, NaN for a double that is null."""
    if isinstance(kind, ArrayType):
        return None if value is None else [_plain(v, kind.elementType) for v in value]
    return math.nan if value is None and isinstance(kind, DoubleType) else value


class InOrder(StatefulProcessor):
    """Feeds ``advance`` the rows of a key in (t_us, sequence) order.

    Rows wait in a list until the watermark is past them; a timer at the earliest one
    releases them. A row older than one already released goes to ``late`` instead. A key
    that was silent for ``idle_s`` seconds of event time is forgotten.

    Most keys have few rows, so a key's calls are what costs: rows wait as columns, one
    entry for each call that brought some, and state and timers that cannot be there are not asked for.
    """

    def __init__(self, rows: StructType, held: str, output: str, advance: Callable, late: Callable, idle_s: float):
        self.columns, self.kinds = rows.names, [f.dataType for f in rows]
        self.waits = StructType([StructField(f.name, ArrayType(f.dataType)) for f in rows])
        self.held, self.output = held, Row(*[f.split()[0] for f in output.split(", ")])
        self.advance, self.late, self.idle_ms = advance, late, int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.known = handle.getValueState("known", self.held)
        self.released = handle.getValueState("released", "t_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, at = [], None
        for row in rows:
            at = at or [row.__fields__.index(c) for c in self.columns]
            new.append(tuple(_plain(row[i], kind) for i, kind in zip(at, self.kinds)))
        yield from self._release(tuple(key), new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._release(tuple(key), None, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _columns(rows: list[tuple]) -> tuple:
        return tuple(map(list, zip(*rows)))

    def _table(self, rows: list[tuple]) -> dict[str, list]:
        return {c: [r[i] for r in rows] for i, c in enumerate(self.columns)}

    def _release(self, key: tuple, new: list[tuple] | None, watermark_ms: int) -> Iterator[Row]:
        """``new`` is None where a timer ran out."""
        time, sequence = self.columns.index("t_us"), self.columns.index("sequence")
        waited = [r for part in self.waiting.get() for r in zip(*(_plain(v, ArrayType(k)) for v, k in zip(part, self.kinds)))]
        rows = waited + (new or [])
        ready = [r for r in rows if r[time] // 1000 < watermark_ms]
        rest = [r for r in rows if r[time] // 1000 >= watermark_ms]
        known = self.released.get() if ready or not waited else None
        last = known[0] if known else None
        held = None
        if ready:
            ready.sort(key=lambda r: (r[time], r[sequence] is None, r[sequence] or 0))
            past = sum(r[time] < last for r in ready) if last is not None else 0
            out = self.late(key, self._table(ready[:past])) if past else []
            more, held = self.advance(key, self._table(ready[past:]), self.known.get() if known else None)
            last = max(ready[-1][time], last if last is not None else ready[-1][time])
            for row in out + more:
                yield self.output(*[None if v is None or v != v else v for v in row])
        wake = min(r[time] for r in rest) // 1000 + 1 if rest else last // 1000 + self.idle_ms if last is not None else None
        if wake is not None and wake <= watermark_ms:  # only silence can be over
            wake = None
            if known:
                self.known.clear()
                self.released.clear()
        elif ready:
            self.released.update((last,))
            if held is not None:
                self.known.update(held)
        if rest and ready:
            self.waiting.put([self._columns(rest)])
        elif rest and new:
            self.waiting.appendValue(self._columns(new))
        elif waited and not rest:
            self.waiting.clear()
        # When a timer runs out no other one is behind the watermark but that of ``wake``, and a
        # key that neither waited nor was released before has none.
        if new is not None and (waited or known):
            for timer in list(self.handle.listTimers()):
                if timer > watermark_ms and timer != wake:
                    self.handle.deleteTimer(timer)
        if wake is not None:
            self.handle.registerTimer(wake)

    def close(self) -> None:
        pass


def keyed(
    samples: DataFrame, keys: list[str], advance: Callable, late: Callable, output: str, state: str, lateness: str, idle_s: float
) -> DataFrame:
    """Rows of every key through ``advance`` in (t_us, sequence) order.

    ``advance`` (key, rows, held) returns output rows and what to hold; held is None at
    first. A table is ordered as a whole and a task holds one batch of rows whatever the
    size of a key. A stream holds rows until the watermark, ``lateness`` behind the
    latest row, is past them, so its answer does not depend on how its rows fall into
    batches; ``late`` (key, rows) says what comes of rows behind those already taken.
    """
    if samples.isStreaming:
        processor = InOrder(samples.drop(*keys).schema, state, output, advance, late, idle_s)
        return timed(samples, lateness).groupBy(*keys).transformWithState(processor, output, "Append", "eventTime")

    def run_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = held = None
        for rows in frames:
            at, out = list(zip(*(rows[k] for k in keys))), []
            edges = [i for i in range(len(at)) if not i or at[i] != at[i - 1]]
            for start, stop in zip(edges, [*edges[1:], len(at)]):
                held = held if at[start] == last else None
                last = at[start]
                more, held = advance(last, rows[start:stop], held)
                out += more
            if out:
                yield framed(out, output)

    return samples.repartition(*keys).sortWithinPartitions(*keys, "t_us", "sequence").mapInPandas(run_sorted, output)
