"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap.

Items are cut into entries of ``ENTRY`` words and indexed; every window of twice as many
words of a document, each beginning ``ENTRY`` after the last, is a query, so that any
entry lies whole in some window. Impacts are divided by what an entry scores against
itself: a window that holds an entry scores 1, whatever its length. Sums of block maxima
rule out blocks of entries, WAND finds the entries above the threshold in the others,
and a match counts when the item's question and answer are found around the window.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import appended, whole
from passledger.session import scratch_path

ENTRY, BLOCK = 32, 4
GROUPS, PIECE = 128, 128  # of blocks, and runs summed at once
_K1, _B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")
_MATCH = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last line is the answer, without a second line the last sentence; without a
    second sentence the whole text is both."""
    lines = [line for line in text.splitlines() if words_of(line)]
    if len(lines) < 2:
        lines = [s for s in re.split(r"(?<=[.!?])\s+", text) if words_of(s)]
    if len(lines) < 2:
        return words_of(text), words_of(text)
    return words_of(" ".join(lines[:-1])), words_of(lines[-1])


def entries_of(text: str) -> list[list[str]]:
    """Runs of at most ``ENTRY`` words of about one length."""
    words = words_of(text)
    count = -(-len(words) // ENTRY)
    return [words[len(words) * i // count : len(words) * (i + 1) // count] for i in range(count)]


def overlap(part: list[str], there: list[str], n: int = 3) -> float:
    """The share of a part's runs of ``n`` words (all of it if shorter) that ``there`` has."""
    n = min(n, len(part))
    have = {tuple(there[i : i + n]) for i in range(len(there) - n + 1)}
    runs = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(r in have for r in runs) / max(len(runs), 1)


class Index:
    """Inverted index of entries with impacts, and their maxima by block of entries.

    Blocks of word ``row`` are ``block[start[row]:start[row + 1]]`` with their maxima in
    ``top``; the postings of one lie at ``first[j]:first[j + 1]``, so the index takes
    memory by its postings alone.
    """

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], total: int, mean: float):
        self.items = [(item, *question_and_answer(text), len(words_of(text))) for item, text in items]
        self.owner: list[int] = []
        self.number: dict[str, int] = {}
        found: list[tuple[int, int, float]] = []
        for place, (_, text) in enumerate(items):
            for words in entries_of(text):
                entry = len(self.owner)
                self.owner.append(place)
                impact = {}
                for word in dict.fromkeys(words):
                    times, seen = words.count(word), frequency.get(word, 1)
                    idf = math.log(1 + (total - seen + 0.5) / (seen + 0.5))
                    impact[word] = idf * times * (_K1 + 1) / (times + _K1 * (1 - _B + _B * len(words) / mean))
                whole_ = sum(impact.values())
                found += [(self.number.setdefault(w, len(self.number)), entry, v / whole_) for w, v in impact.items()]
        found.sort()
        row, self.entry, self.value = (np.array(c, k) for c, k in zip(zip(*found) if found else ((), (), ()), (np.int64, np.int64, float)))
        self.blocks = -(-len(self.owner) // BLOCK)
        key = row * max(self.blocks, 1) + self.entry // BLOCK
        opens = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.first = np.append(opens, len(key))
        self.block = self.entry[opens] // BLOCK
        self.top = np.maximum.reduceat(self.value, opens) if len(key) else np.zeros(0)
        self.start = np.searchsorted(row[opens], np.arange(len(self.number) + 1))
        #: Maxima by groups of neighbouring blocks, at most ``GROUPS`` of them, as a matrix for all words at once.
        self.groups = min(self.blocks, GROUPS)
        self.group = self.block * max(self.groups, 1) // max(self.blocks, 1)
        self.coarse = np.zeros((len(self.number), self.groups), dtype=np.float32)
        np.maximum.at(self.coarse, (row[opens], self.group), self.top.astype(np.float32))

    def within(self, places: list[int], least: float) -> list[tuple[int, float]]:
        """WAND over the postings of one block, a place of ``block`` for each word: (entry, score) of at least ``least``."""
        cursors = []
        for j in places:
            low, high = self.first[j], self.first[j + 1]
            cursors.append([list(zip(self.entry[low:high].tolist(), self.value[low:high].tolist())), 0, float(self.top[j])])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, None
            for cursor in cursors:
                bound += cursor[2]
                if bound >= least - 1e-6:
                    pivot = cursor[0][cursor[1]][0]
                    break
            if pivot is None:
                break
            if cursors[0][0][cursors[0][1]][0] == pivot:
                score = 0.0
                for cursor in cursors:
                    own, at, _ = cursor
                    if own[at][0] == pivot:
                        score += own[at][1]
                        cursor[1] += 1
                if score >= least - 1e-9:
                    found.append((pivot, score))
            else:
                for cursor in cursors:
                    while cursor[1] < len(cursor[0]) and cursor[0][cursor[1]][0] < pivot:
                        cursor[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return found

    def retrieve(self, words: list[str], least: float) -> dict[int, list[tuple[float, int]]]:
        """By item place, (score, first word of the window) of all windows of at least ``least``.

        Words are summed by runs of ``ENTRY`` over the groups of blocks, two runs are a
        window, and only groups that can reach ``least`` are looked into.
        """
        found: dict[int, list[tuple[float, int]]] = {}
        if not self.owner or not words:
            return found
        rows = np.array(list(map(self.number.get, words, repeat(-1))), dtype=np.int64)
        there = np.flatnonzero(rows >= 0)
        runs, many = -(-len(words) // ENTRY), len(self.number)
        once = np.unique(there // ENTRY * many + rows[there])  # a word counts once in a run
        rows = once % many
        cuts = np.searchsorted(once, np.arange(runs + 1) * many)
        for start in range(0, max(runs - 1, 1), PIECE):
            own_cuts = cuts[start : start + PIECE + 2]
            own_rows = rows[own_cuts[0] : own_cuts[-1]]
            if not len(own_rows):
                continue
            begin = own_cuts[:-1] - own_cuts[0]
            sums = np.add.reduceat(self.coarse[own_rows], np.minimum(begin, len(own_rows) - 1))
            sums[begin == own_cuts[1:] - own_cuts[0]] = 0
            if len(sums) > 1:
                sums = sums[:-1] + sums[1:]
            for window, group in zip(*np.nonzero(sums >= least - 1e-4)):
                low, high = own_cuts[window], own_cuts[min(window + 2, len(own_cuts) - 1)]
                own = np.unique(rows[low:high])
                if self.coarse[own, group].sum() < least - 1e-4:
                    continue
                for entry, score in self.above(own, group, least):
                    found.setdefault(self.owner[entry], []).append((score, int(start + window) * ENTRY))
        return found

    def above(self, rows: np.ndarray, group: int, least: float) -> list[tuple[int, float]]:
        """(entry, score) of at least ``least`` of a group of blocks, by their maxima and WAND."""
        places = np.concatenate([np.arange(self.start[r], self.start[r + 1]) for r in rows])
        places = places[self.group[places] == group]
        blocks = self.block[places]
        if not len(places):
            return []
        base, found = blocks.min(), []
        for block in np.flatnonzero(np.bincount(blocks - base, weights=self.top[places]) >= least - 1e-6):
            found += self.within(places[blocks == base + block].tolist(), least)
        return found

    def matches(self, text: str, least: float, question: float, answer: float) -> list[dict]:
        words = words_of(text)
        found = []
        for place, hits in self.retrieve(words, least).items():
            item, asked, answered, size = self.items[place]
            best = None
            for score, start in sorted(hits, reverse=True):
                around = words[max(0, start - size) : start + 2 * ENTRY + size]
                q, a = overlap(asked, around), overlap(answered, around)
                if q >= question and a >= answer and (best is None or (q + a, score) > best):
                    best = (q + a, score)
                    row = {"item_id": item, "score": score, "question": q, "answer": a}
            if best:
                found.append(row)
        return sorted(found, key=lambda r: (r["item_id"] is None, r["item_id"]))


def _items(benchmark: DataFrame, shards: int) -> DataFrame:
    text = whole()
    return benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), text.alias("text"), F.pmod(F.xxhash64(text), F.lit(shards)).alias("shard")
    ).distinct()


def _vocabulary(items: DataFrame) -> DataFrame:
    """(shard, word, entry) with a row for each distinct word of each entry, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text")):
                for words in entries_of(text.as_py()):
                    rows += [(shard, w, len(words) if i == 0 else None) for i, w in enumerate(sorted(set(words)))]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "word", "length"])

    return items.mapInArrow(run, "shard bigint, word string, length bigint")


def with_matches(
    frame: DataFrame, benchmark: DataFrame, least: float = 0.6, question: float = 0.6, answer: float = 0.6,
    shard_characters: int = 8_000_000, column: str = "matches",
) -> DataFrame:
    """Every row of ``frame`` (with a text column) and ``column``, the items found in it.

    ``benchmark`` has item_id and text. An index holds about ``shard_characters`` of item
    text and is broadcast, so its size is bounded however large the benchmark is; word
    statistics are those of all items, and every text meets every index. A benchmark
    beyond one index takes a scan of the texts for each; a scan keeps only a digest of
    the texts that match, and the rows meet their matches by it at the end. Null texts
    count as empty, items without words are never found, equal items are one, a null
    item_id is reported as null. A column of that name is replaced.
    """
    spark = frame.sparkSession
    size = benchmark.agg(F.sum(F.char_length(whole())).alias("n")).first()["n"] or 0
    shards = max(-(-size // shard_characters), 1)
    items = _items(benchmark, shards)
    vocabulary = _vocabulary(items)
    counted = vocabulary.agg(F.count("length").alias("n"), F.avg("length").alias("mean")).first()
    total, mean = counted["n"], counted["mean"] or 1.0
    frequency = vocabulary.groupBy("word").agg(F.count("*").alias("n"))

    def index(shard: int):
        own = [(r["item_id"], r["text"]) for r in items.where(F.col("shard") == shard).collect()]
        known = frequency.join(vocabulary.where(F.col("shard") == shard).select("word").distinct(), "word", "left_semi")
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        return spark.sparkContext.broadcast(Index(own, {r["word"]: r["n"] for r in known.collect()}, total, mean))

    if shards == 1:
        return _searched(frame, column, index(0), least, question, answer)
    path, digest = scratch_path(spark, "matches"), F.sha2(whole().cast("binary"), 256)
    for shard in range(shards):
        met = _searched(frame.select(whole().alias("text")), "met", index(shard), least, question, answer)
        met.where(F.size("met") > 0).select(digest.alias("_text_digest"), "met").distinct().write.mode("append").parquet(path)
    told = spark.read.schema(f"_text_digest string, met {_MATCH}").parquet(path)
    told = told.groupBy("_text_digest").agg(F.flatten(F.collect_list("met")).alias("_met_here"))
    rows = frame.drop(column).withColumn("_text_digest", digest).join(told, "_text_digest", "left")
    found = F.coalesce("_met_here", F.array().cast(_MATCH)).alias(column)
    return rows.select(*[F.col(f"`{c}`") for c in frame.columns if c.lower() != column.lower()], found)


def _searched(frame: DataFrame, column: str, index, least: float, question: float, answer: float) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def make(texts: list[str]) -> list[pa.Array]:
        own = index.value
        return [pa.array([own.matches(t, least, question, answer) for t in texts], kind)]

    return appended(frame, f"`{column}` {_MATCH}", make)


def contaminated(frame: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, score, question, answer) of every match of every row of ``frame``."""
    rows = with_matches(frame.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **options)
    return rows.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def drop_contaminated(frame: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``frame`` without a match, with all their columns."""
    here = "_matches_here"
    return with_matches(frame, benchmark, column=here, **options).where(F.size(here) == 0).drop(here)
