"""Exact dedup: every class of equal texts is owned by one terminal node of a radix trie.

Texts are compared after deleting white space. Each scan task inserts its texts into
a Patricia trie whose terminal nodes hold the best row so far and a count; when the
trie grows too large, its largest subtree is written out. The terminals are then dealt
by length and content hash, and the tries of one (length, hash) group merge them, again
over the full byte strings. A document finds its owner by length and SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import SPACE, whole

_DELETE = SPACE.encode()
_TERMINALS = "size int, digest bigint, body binary, chars bigint, owner bigint, copies bigint"


class Node:
    __slots__ = ("label", "children", "rank", "copies")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.rank: tuple | None = None  # the best row that ends here
        self.copies = 0


class RadixTrie:
    """Compressed trie over byte strings; ``held`` is about what its labels take."""

    def __init__(self):
        self.root = Node(b"")
        self.held = 0
        self.by_branch: dict[int, int] = {}

    def insert(self, key: bytes, rank: tuple, copies: int) -> None:
        """``rank`` sorts rows: the smallest owns the text."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.children[key[at]] = child
                self.held += len(child.label) + 200
                self.by_branch[key[0]] = self.by_branch.get(key[0], 0) + len(child.label) + 200
            elif not key.startswith(child.label, at):
                shared = self._shared(child.label, key, at)
                middle = Node(child.label[:shared])
                child.label = child.label[shared:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                self.held += 200
                self.by_branch[key[0]] += 200
                child = middle
            node = child
            at += len(child.label)
        if node.rank is None or rank < node.rank:
            node.rank = rank
        node.copies += copies

    @staticmethod
    def _shared(label: bytes, key: bytes, at: int) -> int:
        low, high = 1, min(len(label), len(key) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if key.startswith(label[:middle], at):
                low = middle
            else:
                high = middle - 1
        return low

    @staticmethod
    def _walk(node: Node, above: bytes) -> Iterator[tuple[bytes, tuple, int]]:
        todo = [(node, above)]
        while todo:
            node, above = todo.pop()
            key = above + node.label
            if node.rank is not None:
                yield key, node.rank, node.copies
            todo.extend((child, key) for child in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, tuple, int]]:
        """Hands out the terminals of the largest subtree and forgets it."""
        branch = max(self.by_branch, key=self.by_branch.get)
        self.held -= self.by_branch.pop(branch)
        yield from self._walk(self.root.children.pop(branch), b"")

    def drain(self) -> Iterator[tuple[bytes, tuple, int]]:
        yield from self._walk(self.root, b"")
        self.__init__()


def _rank(chars: int, owner: int | None) -> tuple:
    return (-chars, owner is None, owner or 0)


def _owner(rank: tuple) -> int | None:
    return None if rank[1] else rank[2]


def _batches(terminals: Iterator[tuple[bytes, tuple, int]], limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(k) for k, _, _ in rows], pa.int32()),
                pa.array([xxhash.xxh64_intdigest(k) - (1 << 63) for k, _, _ in rows], pa.int64()),
                pa.array([k for k, _, _ in rows], pa.binary()),
                pa.array([-r[0] for _, r, _ in rows], pa.int64()),
                pa.array([_owner(r) for _, r, _ in rows], pa.int64()),
                pa.array([c for _, _, c in rows], pa.int64()),
            ],
            names=["size", "digest", "body", "chars", "owner", "copies"],
        )

    for row in terminals:
        rows.append(row)
        held += len(row[0]) + 40
        if held > limit:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def owners(frame: DataFrame, memory: int = 48_000_000) -> DataFrame:
    """One row for each distinct text: size, sha, chars and keep_id of the row that stays, and group_size.

    ``memory`` is the number of bytes a scan task's trie may hold before a subtree
    is spilled.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()

        def terminals():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                    text = text.as_py()
                    body = text.encode("utf-8", "surrogatepass").translate(None, _DELETE)
                    trie.insert(body, _rank(len(text), doc.as_py()), 1)
                    while trie.held > memory:
                        yield from trie.spill()
            yield from trie.drain()

        yield from _batches(terminals())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, group = RadixTrie(), None

        def terminals():
            nonlocal group
            for batch in batches:
                columns = [batch.column(c) for c in ("size", "digest", "body", "chars", "owner", "copies")]
                for size, digest, body, chars, owner, copies in zip(*columns):
                    if (size, digest) != group:
                        yield from trie.drain()
                        group = (size, digest)
                    trie.insert(body.as_py(), _rank(chars.as_py(), owner.as_py()), copies.as_py())
            yield from trie.drain()

        rows = []
        for key, rank, copies in terminals():
            rows.append((len(key), hashlib.sha256(key).hexdigest(), -rank[0], _owner(rank), copies))
            if len(rows) == 20_000:
                yield _owned(rows)
                rows = []
        if rows:
            yield _owned(rows)

    return (
        frame.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
        .mapInArrow(combine, _TERMINALS)
        .repartition("size", "digest")
        .sortWithinPartitions("size", "digest")
        .mapInArrow(merge, "size int, sha string, chars bigint, keep_id bigint, group_size bigint")
    )


def _owned(rows: list[tuple]) -> pa.RecordBatch:
    size, sha, chars, keep, copies = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(size, pa.int32()), pa.array(sha, pa.string()), pa.array(chars, pa.int64()), pa.array(keep, pa.int64()),
            pa.array(copies, pa.int64()),
        ],
        names=["size", "sha", "chars", "keep_id", "group_size"],
    )


def _content() -> list[Column]:
    """Size and digest of a text as texts are compared."""
    body = F.translate(whole(), SPACE, "")
    return [F.octet_length(body).cast("int"), F.sha2(body.cast("binary"), 256)]


def exact_groups(frame: DataFrame) -> DataFrame:
    """Every row of ``frame`` (doc_id, text) with the row that stays for its text.

    Returns doc_id, keep_id, group_size, kept, text_sha256. A null text counts as
    empty, and empty texts are equal to each other. Of equal texts the one with the
    most code points stays, then the smallest doc_id; a null doc_id comes last, and
    rows that repeat the doc_id of the one that stays are kept with it. Other columns
    are ignored; an empty table gives an empty result.
    """
    size, sha = _content()
    rows = frame.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), sha.alias("sha"))
    return rows.join(owners(frame), ["size", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(frame: DataFrame) -> DataFrame:
    """One row of ``frame`` for each distinct text, with all its columns.

    It is the row that ``exact_groups`` keeps; of several rows with its doc_id (or none)
    and as many code points one stays. A row travels by its text and id, so that only
    rows that repeat both come together.
    """
    size, sha = _content()
    id_ = F.col("doc_id").cast("long")
    here = frame.withColumns(
        {
            "_x_size": size, "_x_sha": sha, "_x_chars": F.char_length(whole()).cast("long"),
            "_x_id": F.coalesce(id_, F.lit(0).cast("long")), "_x_none": id_.isNull(),
        }
    )
    key = ["_x_size", "_x_sha", "_x_chars", "_x_id", "_x_none"]
    kept = owners(frame).select(
        F.col("size").alias(key[0]), F.col("sha").alias(key[1]), F.col("chars").alias(key[2]),
        F.coalesce("keep_id", F.lit(0).cast("long")).alias(key[3]), F.col("keep_id").isNull().alias(key[4]),
    )
    return here.join(kept, key, "left_semi").dropDuplicates(key).drop(*key)
