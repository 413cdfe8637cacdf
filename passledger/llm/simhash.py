"""Near-duplicates by SimHash, found with the keys of a Golay code.

The 64 bits are three segments of 22, 21 and 21 bits. The binary Golay code of length
23 is perfect with radius 3, and the codewords within distance 4 of a word are one, or
six whose differences from it share no position; so two words that differ in at most
two bits always have such a codeword in common. Its number is a key of 12 bits.

Fingerprints that differ in at most four bits are met by pigeonhole:

* a segment has no error: it is equal, and of the others one has at most two errors
  and shares a codeword;
* every segment has an error: the worst has at most two and shares a codeword, the
  others have one each, so one half of each is equal.

Every case is a key of 33 or 34 bits. What shares a key is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import text_slices, whole
from passledger.llm.components import components
from passledger.session import cut_lineage, scratch_path

#: Fixed value: the generator polynomial of the code.
_GENERATOR = 0xC75
_SEGMENTS = ((42, 22), (21, 21), (0, 21))
_SHINGLE, _SEED = 4, 42
_SALTS = 32  # parts a group's fingerprints are dealt over when they learn its name


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


def golay_patterns() -> np.ndarray:
    """For each of the 2,048 syndromes the error patterns of weight up to 4; unused places are -1."""
    single = [_remainder(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = pattern = 0
            for p in places:
                syndrome ^= single[p]
                pattern |= 1 << p
            found[syndrome].append(pattern)
    table = np.full((2048, 6), -1, dtype=np.int64)
    for syndrome, patterns in enumerate(found):
        table[syndrome, : len(patterns)] = patterns
    return table


class Golay:
    """Numbers of the codewords within distance 4 of a word."""

    def __init__(self):
        self.patterns = golay_patterns()
        self.high = np.array([_remainder(i << 12) for i in range(2048)])
        self.low = np.array([_remainder(i) for i in range(4096)])

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword numbers, six for each word, and which of them there are."""
        found = self.patterns[self.high[words >> 12] ^ self.low[words & 4095]]
        return (words[:, None] ^ np.maximum(found, 0)) >> 11, found >= 0


def keys_of(code: Golay, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its fingerprint); prints are unsigned."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in _SEGMENTS]
    near = [code.near(p) for p in parts]
    halves = [(p >> 11, p & 2047) for p in parts]
    rows, keys, family = np.arange(len(prints)), [], 0
    owners = []

    def add(numbers, there, rest):
        nonlocal family
        keys.append((np.int64(family) << 50 | rest[:, None] << 12 | numbers)[there])
        owners.append(np.broadcast_to(rows[:, None], numbers.shape)[there])
        family += 1

    for exact in range(3):
        for coded in range(3):
            if exact != coded:
                add(*near[coded], parts[exact])
    for coded in range(3):
        one, two = (i for i in range(3) if i != coded)
        for a in halves[one]:
            for b in halves[two]:
                add(*near[coded], a << 11 | b)
    return np.concatenate(keys), np.concatenate(owners)


def fingerprints(frame: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text) and print (the 64 bits as a signed bigint) of every row of ``frame``.

    Words are split at white space after lower-casing A-Z; a bit is set when it is set
    in more than half of the shingles' hashes. A text of fewer words than a shingle has
    the one shingle of all its words; one without words, or null, has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = fingerprints_of([t.as_py() for t in part.column("text")])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array(found.view(np.int64))], names=["doc_id", "digest", "print"]
                )

    rows = frame.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, digest binary, print bigint")


def _digest() -> Column:
    return F.unhex(F.sha2(whole().cast("binary"), 256))


def fingerprints_of(texts: list[str], block: int = 100_000) -> np.ndarray:
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    totals = np.zeros(len(texts), dtype=np.int64)
    hashes: list[int] = []
    spans: list[tuple[int, int]] = []  # text, first of its hashes in the block

    def settle():
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, [at for _, at in spans], axis=0, dtype=np.int64)
        np.add.at(counts, [row for row, _ in spans], sums)
        hashes.clear()
        spans.clear()

    digest = xxhash.xxh64_intdigest
    for row, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-1]]
        width = min(_SHINGLE, len(words))
        total = totals[row] = len(words) - width + 1
        for first in range(0, total, block):
            last = min(first + block, total)
            spans.append((row, len(hashes)))
            hashes.extend(
                [digest(joined[a : b - 1], _SEED) for a, b in zip(starts[first:last], ends[first + width - 1 : last + width - 1])]
            )
            if len(hashes) >= block:
                settle()
    if hashes:
        settle()
    set_ = counts * 2 > totals[:, None]
    return np.packbits(set_, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the fingerprints at most ``most`` bits apart."""
    links: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= most
            hit = rest[near]
            links += [(at, int(h)) for h in hit]
            queue += hit.tolist()
            rest = rest[~near]
    return links


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Arrays (key, print) and whether they end with a key's last row."""
    key, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        prints = np.concatenate([prints, batch.column("print").to_numpy().view(np.uint64)])
        cut = np.searchsorted(key, key[-1])
        yield key[:cut], prints[:cut], True
        key, prints = key[cut:], prints[cut:]
        while len(key) > _BLOCK * 2:  # one key: hand out whole blocks
            yield key[:_BLOCK], prints[:_BLOCK], False
            key, prints = key[_BLOCK:], prints[_BLOCK:]
    yield key, prints, True


_BLOCK = 4_096
_LINKS = "a bigint, b bigint, key bigint, block int"


def _link_batch(a, b, key=None, block=None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64)),
            pa.nulls(n, pa.int64()) if key is None else pa.array(np.full(n, key, np.int64)),
            pa.nulls(n, pa.int32()) if block is None else pa.array(np.full(n, block, np.int32)),
        ],
        names=["a", "b", "key", "block"],
    )


def _linked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links inside each key's group. A group of more than a block is cut into blocks,
    whose rows come out once more so that every two blocks can meet elsewhere."""
    open_key, number = None, 0
    for key, prints, ends in _sorted_groups(batches):
        if not len(key):
            continue
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        two = first[size == 2]
        if open_key is not None and open_key == key[0]:
            two = two[two > 0]
        close = np.bitwise_count(prints[two] ^ prints[two + 1]) <= most
        if close.any():
            yield _link_batch(prints[two[close]], prints[two[close] + 1])
        a, b = [], []
        for at, count in zip(first, size):
            own = prints[at : at + count]
            cut = open_key is not None and open_key == key[at]
            if count > 2 or cut:
                for start in range(0, count, _BLOCK):
                    part = own[start : start + _BLOCK]
                    for i, j in forest(part, most):
                        a.append(part[i])
                        b.append(part[j])
                    if cut or count > _BLOCK or not ends:
                        if open_key != key[at]:
                            open_key, number = key[at], 0
                        yield _link_batch(part, part, key[at], number)
                        number += 1
            if len(a) > 50_000:
                yield _link_batch(a, b)
                a, b = [], []
        if a:
            yield _link_batch(a, b)


def _across(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of two blocks of a key that lie together."""
    held, group = [], None

    def found():
        prints = np.array(held, dtype=np.int64).view(np.uint64)
        pairs = forest(prints, most)
        if pairs:
            i, j = np.array(pairs).T
            yield _link_batch(prints[i], prints[j])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "one", "two", "print"))):
            if row[:3] != group and held:
                yield from found()
                held = []
            group = row[:3]
            held.append(row[3])
    if held:
        yield from found()


def links(prints: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints at most ``most`` bits apart.

    ``prints`` has one row for each distinct fingerprint (print). A key's group gives a
    spanning forest, not its pairs; a task never holds more than two blocks of it.
    """
    if most > 4:
        raise ValueError("the keys meet fingerprints of up to four differing bits")
    spark = prints.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            values = batch.column("print").to_numpy().view(np.uint64)
            for at in range(0, len(values), 1_000):
                part = values[at : at + 1_000]
                keys, rows = keys_of(code, part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["key", "print"])

    path = scratch_path(spark, "simhash-links")
    (
        prints.select("print").mapInArrow(keyed, "key bigint, print bigint")
        .repartition("key").sortWithinPartitions("key", "print")
        .mapInArrow(lambda batches: _linked(batches, most), _LINKS)
        .write.parquet(path)
    )
    stored = spark.read.schema(_LINKS).parquet(path)
    inside = stored.where("key IS NULL").select("a", "b")
    blocks = stored.where("key IS NOT NULL")
    if not blocks.limit(1).count():
        return inside
    last = blocks.groupBy("key").agg(F.max("block").alias("last"))
    met = (
        blocks.join(last, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .where("other <> block")
        .select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), F.col("a").alias("print"))
        .repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
        .mapInArrow(lambda batches: _across(batches, most), _LINKS)
    )
    return inside.unionByName(met.select("a", "b"))


def grouped(frame: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, digest, print, root and component_id of every row of ``frame`` (doc_id, text).

    ``root`` is a fingerprint of the row's group, the same for all of the group.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, "simhash-prints")
    fingerprints(frame).write.parquet(path)
    rows = spark.read.schema("doc_id bigint, digest binary, print bigint").parquet(path)
    distinct = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # only linked fingerprints take part; a group of any size is dealt over salts
    hung = cut_lineage(components(links(distinct, most)).withColumnRenamed("node", "print").join(distinct.drop("copies"), "print"))
    least = hung.groupBy("root").agg(F.min("first_id").alias("least_id"))
    roots = least.join(distinct, F.col("root") == F.col("print")).select("root", F.least("least_id", "first_id").alias("component_id"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    members = hung.withColumn("salt", F.pmod(F.hash("print"), F.lit(_SALTS))).join(roots.withColumn("salt", salts), ["root", "salt"])
    named = members.select("print", "root", "component_id").unionByName(roots.select(F.col("root").alias("print"), "root", "component_id"))
    classes = cut_lineage(
        distinct.join(named, "print", "left").select(
            "print", F.coalesce("root", "print").alias("root"), "copies",
            F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    # fingerprints that hold a thousandth of the rows or more are a thousand at most
    frequent = F.col("copies") * 1_000 >= (classes.agg(F.sum("copies").alias("n")).first()["n"] or 0)
    often, seldom = F.broadcast(classes.where(frequent).drop("copies")), classes.where(~frequent).drop("copies")
    return rows.join(often, "print").unionByName(rows.join(often, "print", "left_anti").join(seldom, "print"))


def near_groups(frame: DataFrame, most: int = 4) -> DataFrame:
    """Every row of ``frame`` (doc_id, text) with its fingerprint and group.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    that can be reached over fingerprints at most ``most`` bits apart. Equal
    fingerprints are one node, so copies cost one row; a null text counts as empty, and
    texts without words are linked to each other. A null doc_id never names a group
    that has another; repeated rows are each returned.
    """
    return grouped(frame, most).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(frame: DataFrame, most: int = 4) -> DataFrame:
    """One row of ``frame`` for each group, with all its columns.

    It is a row whose doc_id names the group; of several with that doc_id (or none) the
    text with the smallest digest stays, once.
    """
    rows = grouped(frame, most).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = rows.groupBy("root").agg(F.min(F.struct("digest", "doc_id")).alias("own"))
    id_ = F.col("doc_id").cast("long")
    key = ["_x_digest", "_x_id", "_x_none"]
    here = frame.withColumns({key[0]: _digest(), key[1]: F.coalesce(id_, F.lit(0).cast("long")), key[2]: id_.isNull()})
    kept = kept.select(
        F.col("own.digest").alias(key[0]), F.coalesce("own.doc_id", F.lit(0).cast("long")).alias(key[1]), F.col("own.doc_id").isNull().alias(key[2])
    )
    return here.join(kept, key, "left_semi").dropDuplicates(key).drop(*key)
