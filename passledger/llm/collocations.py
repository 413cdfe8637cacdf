"""Phrase collocations by top-order marginalisation.

Every word of a text opens one window: itself and the words that lead it by one to four
places, padded behind the end of its piece. Only these longest windows are counted;
ROLLUP sums them to all shorter prefixes, and the empty prefix of a language is its
number of words. No order is counted on its own.

A window is padded from where two or three neighbouring words together are too rare,
since no phrase over them can be a candidate. Such runs are counted by a hash, and
those that are frequent enough set a bit of a map of fixed size. A bit set by chance, or
a map that fills up, only lets rare windows through; the counts of candidates and of all
their parts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passledger.llm.common import text_slices, whole
from passledger.session import cut_lineage

LONGEST = 5
#: Maps of frequent runs (of two words, of three), the bits of one, and those that one group of it holds.
MAPS, MAP_BITS, GROUP_BITS = 2, 27, 20
_WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
_END = b"."
#: By byte of UTF-8: A-Z in lower case, tab a space, the ends of pieces a full stop.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def pieces(text: str) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case; a full stop stands where a piece ends."""
    return text.encode().translate(_TABLE).replace(_END, b" . ").split()


class _Numbers(dict):
    """Words numbered as they come; the end of a piece is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, word numbers, words by number) of slices of texts; texts end with a piece."""
    for batch in batches:
        for part in text_slices(batch, "text", limit):
            by_language: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
                by_language.setdefault(lang, []).append(text.as_py())
            for lang, texts in by_language.items():
                number, found = _Numbers(), []
                for text in texts:
                    words = pieces(text)
                    found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    found.append(np.zeros(1, np.int32))
                yield lang, np.concatenate(found), list(number)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = left * np.uint64(0x9E3779B97F4A7C15) + right
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def _runs(lang: str, words: list[bytes], numbers: np.ndarray, maps: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the runs one word longer than those of the last map, and marks where runs are in each map.

    ``maps`` are of runs of two words, three and so on. A run takes part if both runs
    inside it that are a word shorter are in their map.
    """
    own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    at = np.flatnonzero((numbers[:-1] != 0) & (numbers[1:] != 0))
    value = _mixed(own[numbers[at]] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())), own[numbers[at + 1]])
    marks = []
    for longer, content in enumerate(maps, 2):
        place = (value & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
        there = (np.frombuffer(content, np.uint8)[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
        mark = np.zeros(len(numbers) + LONGEST, bool)
        mark[at[there]] = True
        marks.append(mark)
        both = there & mark[at + 1]
        at = at[both]
        value = _mixed(value[both], own[numbers[at + longer]])
    return value.view(np.int64), marks


def frequent_runs(rows: DataFrame, shorter: list, least: int, limit: int) -> bytes:
    """A map of 2 ** ``MAP_BITS`` bits, set where a run of words is found ``least`` times.

    The runs have two words more than there are maps of ``shorter`` ones (broadcast), and
    are counted over all rows (lang, text); the map is made in groups, so that neither a
    task nor the driver holds more than the map.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, words in _parts(batches, limit):
            value, n = np.unique(_runs(lang, words, numbers, [m.value for m in shorter])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["run", "n"])

    def group(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << GROUP_BITS, np.uint8)
        bits[table.column("bit").to_numpy() & ((1 << GROUP_BITS) - 1)] = 1
        number = table.column("bit")[0].as_py() >> GROUP_BITS
        return pa.table({"number": pa.array([number], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()])})

    counted = rows.mapInArrow(hashes, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    bit = (F.col("run").bitwiseAND((1 << MAP_BITS) - 1)).cast("int").alias("bit")
    found = counted.where(F.col("n") >= least).select(bit).distinct()
    parts = found.groupBy(F.shiftright("bit", GROUP_BITS)).applyInArrow(group, "number int, bits binary").collect()
    size = (1 << GROUP_BITS) // 8
    out = bytearray((1 << MAP_BITS) // 8)
    for row in parts:
        out[row["number"] * size : (row["number"] + 1) * size] = row["bits"]
    return bytes(out)


def padded_windows(rows: DataFrame, maps: list, limit: int) -> DataFrame:
    """(lang, w1 to w5, n) of all windows of ``rows`` (lang, text); empty words pad them.

    ``maps`` are broadcast maps of frequent runs. Equal windows of one slice are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, words in _parts(batches, limit):
            marks = _runs(lang, words, numbers, [m.value for m in maps])[1]
            joined = marks[0][: len(numbers)]
            count = np.bincount(numbers[(numbers != 0) & ~joined], minlength=len(words))
            single, first = np.flatnonzero(count), np.flatnonzero(joined)
            lead = np.zeros((LONGEST, len(first)), np.int32)
            lead[0] = numbers[first]
            going, ahead = np.ones(len(first), bool), np.append(numbers, np.zeros(LONGEST, np.int32))
            for k in range(1, LONGEST):
                for back, mark in enumerate(marks[:k], 1):
                    going &= mark[first + k - back]
                lead[k] = np.where(going, ahead[first + k], 0)
            lead = lead[:, np.lexsort(lead[::-1])]
            new = np.append(True, (lead[:, 1:] != lead[:, :-1]).any(axis=0)) if len(first) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            text = pa.array([b"", *words[1:]], pa.binary()).cast(pa.string())
            none = np.zeros(len(single), np.int32)
            columns = [
                text.take(pa.array(np.append(single if k == 0 else none, lead[k][starts]))) for k in range(LONGEST)
            ]
            n = np.append(count[single], np.diff(np.append(starts, len(first)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *columns, pa.array(n)], names=["lang", *_WORDS, "n"])

    return rows.mapInArrow(run, "lang string, " + ", ".join(f"{w} string" for w in _WORDS) + ", n bigint")


def phrase_counts(frame: DataFrame, least: int = 100, limit: int = 8_000_000) -> DataFrame:
    """(lang, words, n) of every phrase of up to five words found at least ``least`` times.

    The row without words counts all words of a language, whatever its number. Null
    texts count as empty, a null lang is ``und``.
    """
    rows = frame.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole().alias("text"))
    maps: list = []
    for _ in range(MAPS):
        maps.append(frame.sparkSession.sparkContext.broadcast(frequent_runs(rows, list(maps), least, limit)))
    counted = padded_windows(rows, maps, limit).rollup("lang", *_WORDS).agg(F.sum("n").alias("n"))
    # a prefix that ends in padding says the same as the shorter one; Catalyst moves this below the sums
    for word in _WORDS:
        counted = counted.where(F.coalesce(F.col(word), F.lit("-")) != "")
    words = F.filter(F.array(*_WORDS), lambda w: w.isNotNull())
    return counted.where(F.col("lang").isNotNull() & ((F.col("n") >= least) | F.col("w1").isNull())).select("lang", words.alias("words"), "n")


def collocations(frame: DataFrame, least: int = 100, best: int = 2_000, contained: int = 100, limit: int = 8_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of two to five words of each language.

    ``frame`` has lang and text. ``a`` counts the phrase, ``l`` and ``r`` the parts of its
    weakest cut, ``n`` the words of the language; score is floor(1000 a n / (l r)). A
    phrase inside a longer one of at least ``contained`` hundredths of its count goes.
    An empty table gives no row; repeated rows count again, other columns are not read.
    """
    counts = cut_lineage(phrase_counts(frame, least, limit))
    size = F.size("words")
    told = counts.where(size > 0)
    total = counts.where(size == 0).select("lang", F.col("n").alias("total"))
    candidates = told.where(size > 1).withColumnRenamed("n", "a")

    inner = F.explode(
        F.filter(
            F.flatten(
                F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(
                    F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("words", i, k)))
            ),
            lambda w: F.size(w) > 1,
        )
    )
    longer = candidates.where(size > 2).select("lang", inner.alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("above"))
    kept = candidates.join(longer, ["lang", "words"], "left").where(F.col("above").isNull() | (100 * F.col("above") < contained * F.col("a")))

    cuts = kept.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("words", F.lit(1), F.col("k"))).withColumn("rest", F.slice("words", F.col("k") + 1, size - F.col("k")))
    cuts = (
        cuts.join(told.select("lang", F.col("words").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(told.select("lang", F.col("words").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .join(total, "lang")
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("over", wide("a") * wide("total") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", wide("l") * wide("r"))
    weakest = cuts.select("lang", "words", "a", "k", "l", "r", F.col("total").alias("n"), F.expr("over div under").alias("score"))
    weakest = weakest.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "words", "cut.*")
    rows = weakest.withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
