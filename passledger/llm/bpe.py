"""Byte-level BPE by longest matches and backtracking, and its inverse.

The bytes of a piece are read as Latin-1 characters, so that an Aho-Corasick automaton
over the vocabulary finds the longest token at every position in one pass. The encoder
takes longest tokens, falls back to shorter prefixes where two neighbours could not
stand side by side in a merge order, and never visits a dead position twice: the work
is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import appended, kept_in_worker


_INNER_SPACE = re.compile(r"\s (?:\s|$)")


class Vocabulary:
    """Tokens by rank and what the encoder needs to know of them.

    A token that merging its own bytes never yields can only stand for a whole piece;
    the automaton leaves it out.
    """

    def __init__(self, raw: bytes, remembered: int = 200_000):
        import ahocorasick

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.remembered = remembered
        self.fit: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.cuts: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merged(token, rank)
                if len(parts) != 2:
                    continue
                self.halves[rank] = parts
            self.size[rank] = len(token)
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        for rank, size in self.size.items():
            token = self.tokens[rank]
            prefixes = (self.ranks.get(token[:n]) for n in range(size - 1, 0, -1))
            self.shorter[rank] = next((p for p in prefixes if p in self.size), -1)
        self.automaton.make_automaton()

    def merged(self, token: bytes, below: int) -> tuple[int, ...]:
        """Merges bytes by rank, using ranks under ``below`` only."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= below:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side.

        Undoes the merges next to the border from the latest to the earliest; a merge
        across the border that would have come first rules the pair out. Of equal
        ranks the one further left comes first.
        """
        key = left << 32 | right
        known = self.fit.get(key)
        if known is not None:
            return known
        bound, fine = len(self.tokens) + (1 << 30), True
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < bound:
                fine = False
                break
            if left in halves and (left > right or right not in halves):
                bound, left = left, halves[left][1]
            elif right in halves:
                bound, right = right + 1, halves[right][0]
            else:
                break
        if len(self.fit) >= 5 * self.remembered:
            self.fit.clear()
        self.fit[key] = fine
        return fine

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        n, size, shorter, fits = len(piece), self.size, self.shorter, self.fits
        longest = [-1] * n
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            end = at + size[token]
            if alive[end] and (last < 0 or fits(last, token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # nothing can start here after what stands before
                alive[at] = 0
                token = out.pop()  # its end is dead now, so a shorter one follows
                at -= size[token]
        return out

    def encode(self, pattern, text: str) -> list[int]:
        """Ids of the whole text.

        No match of the pattern starts with a non-space and goes on behind a space, so
        a text can be cut before every single space, and the ids of such a cut are
        remembered. A text with a space inside a run of white space is not cut.
        """
        ids: list[int] = []
        if _INNER_SPACE.search(text):
            for piece in pattern.findall(text):
                ids.extend(self._piece(piece))
            return ids
        cuts, get = self.cuts, self.cuts.get
        head, *rest = text.split(" ")
        for piece in pattern.findall(head):
            ids.extend(self._piece(piece))
        for cut in rest:
            found = get(cut)
            if found is None:
                found = [i for piece in pattern.findall(" " + cut) for i in self._piece(piece)]
                if len(cut) <= 64:
                    if len(cuts) >= self.remembered:
                        cuts.clear()
                    cuts[cut] = found = tuple(found)
            ids.extend(found)
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece)
        if found is None:
            found = tuple(self.encode_piece(piece.encode()))
            if len(piece) <= 64:
                if len(self.pieces) >= self.remembered:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def vocabulary(raw: bytes) -> Vocabulary:
    """One vocabulary for each file and worker; its size is that of the file."""
    return kept_in_worker(("bpe", hashlib.sha256(raw).hexdigest()), lambda: Vocabulary(raw))


def tokenized(frame: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Every row of ``frame`` with ``ids`` (array of int) and ``decoded`` (binary).

    ``ranks_file`` is a file of the driver in the layout of tiktoken, ``pattern`` the
    expression whose matches are encoded separately, as the tiktoken library does for
    ordinary text. The text is encoded whole; null counts as empty and gives no ids.
    ``decoded`` is read back from the ids. Columns of these two names are replaced.
    """
    raw = frame.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())

    def make(texts: list[str]) -> list[pa.Array]:
        import regex

        own = vocabulary(raw.value)
        compiled = kept_in_worker(("pattern", pattern), lambda: regex.compile(pattern))
        ids = [own.encode(compiled, t) for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.binary())]

    return appended(frame, "ids array<int>, decoded binary", make)


def digests(rows: DataFrame) -> list:
    """n_tokens, ids_sha256 and decoded_sha256 of ``tokenized`` rows."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
