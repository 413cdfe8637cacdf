"""Language identification by prediction by partial matching.

Every language has byte contexts of order 0 to ``ORDER``. A symbol seen in a context
costs ``-log2(count / (total + distinct))`` bits there, an unseen one the escape
``-log2(distinct / (total + distinct))`` and then its cost in the next shorter context;
below order 0 it costs 8 bits. The statistics are frozen after learning, so the code
length of a text is exact and a text's cost does not depend on other texts.

Texts are read as their letters in lower case, every other run as one space.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from passledger.llm.common import appended, labelled_sample

ORDER = 4
NOTHING = "und"
_LEAD = b" " * ORDER


def letters_of(pattern, text: str | None) -> bytes:
    return " ".join(pattern.findall(text.lower())).encode() if text else b""


def windows(data: np.ndarray) -> np.ndarray:
    """For each byte after the lead, it and its ``ORDER`` predecessors as one number."""
    n = len(data) - ORDER
    found = np.zeros(n, dtype=np.uint64)
    for back in range(ORDER + 1):
        found |= data[ORDER - back : ORDER - back + n].astype(np.uint64) << np.uint64(8 * back)
    return found


@dataclass
class Contexts:
    """Frozen costs of one language by order: sorted grams and contexts with bits."""

    grams: list[np.ndarray] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def learn(cls, texts: list[bytes]) -> Contexts:
        own = cls()
        parts = [windows(np.frombuffer(_LEAD + t, dtype=np.uint8)) for t in texts if t]
        seen = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        for order in range(ORDER + 1):
            grams, counts = np.unique(seen & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True)
            contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
            distinct = np.diff(np.append(first, len(grams)))
            total = np.add.reduceat(counts, first) if len(grams) else counts
            base = np.log2(total + distinct) if len(grams) else np.zeros(0)
            own.grams.append(grams)
            own.bits.append((np.repeat(base, distinct) - np.log2(counts)).astype(np.float64))
            own.contexts.append(contexts)
            own.escapes.append(base - np.log2(distinct) if len(grams) else base)
        return own

    def cost(self, seen: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window."""
        total = np.zeros(len(seen))
        open_ = np.arange(len(seen))
        for order in range(ORDER, -1, -1):
            gram = seen[open_] & np.uint64((1 << 8 * (order + 1)) - 1)
            at, hit = _find(self.grams[order], gram)
            total[open_[hit]] += self.bits[order][at[hit]]
            open_, gram = open_[~hit], gram[~hit]
            if not len(open_):
                return total
            at, known = _find(self.contexts[order], gram >> np.uint64(8))
            total[open_[known]] += self.escapes[order][at[known]]
        total[open_] += 8.0
        return total


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def code_lengths(models: list[Contexts], texts: list[bytes], piece: int = 2_000_000) -> np.ndarray:
    """Bits of every text under every model; a text longer than ``piece`` goes piecewise."""
    bits = np.zeros((len(texts), len(models)))
    group, held = [], 0

    def settle():
        seen = [windows(np.frombuffer(data, dtype=np.uint8)) for _, data in group]
        values, inverse = np.unique(np.concatenate(seen), return_inverse=True)
        starts = np.cumsum([0, *map(len, seen)])[:-1]
        rows = np.array([row for row, _ in group])
        for column, model in enumerate(models):
            np.add.at(bits[:, column], rows, np.add.reduceat(model.cost(values)[inverse], starts))

    for row, text in enumerate(texts):
        data = _LEAD + text
        for start in range(0, len(text), piece):
            group.append((row, data[start : start + piece + ORDER]))
            held += len(group[-1][1])
            if held >= piece:
                settle()
                group, held = [], 0
    if group:
        settle()
    return bits


def learned(frame: DataFrame, per_language: int = 250, longest: int = 20_000) -> tuple[list[str], list[Contexts]]:
    """Contexts of every language of ``frame`` (text, lang).

    Fitted on a bounded sample: at most ``per_language`` texts of each language, none
    longer than ``longest`` code points.
    """
    import regex

    pattern = regex.compile(r"\p{L}+")
    texts: dict[str, list[bytes]] = {}
    for text, lang in labelled_sample(frame, "lang", per_language, longest):
        texts.setdefault(lang, []).append(letters_of(pattern, text))
    names = sorted(texts)
    return names, [Contexts.learn(texts[n]) for n in names]


def predicted(frame: DataFrame, names: list[str], models: list[Contexts]) -> DataFrame:
    """Every row of ``frame`` (with a text column), lang_pred and score.

    The language with the shortest code wins, of equal ones the first by name. The
    score is its share when a language weighs 2 to the power of minus its bits. A text
    that is null or has no letter is ``und`` with score 0, as is every text when no
    language was learned. Texts are read whole; repeated rows are scored alike. Columns
    of the two names are replaced.
    """

    def make(texts: list[str]) -> list[pa.Array]:
        import regex

        pattern = regex.compile(r"\p{L}+")
        read = [letters_of(pattern, t) for t in texts]
        langs = np.full(len(read), NOTHING, dtype=object)
        score = np.zeros(len(read))
        if models:
            bits = code_lengths(models, read)
            best = bits.argmin(axis=1)
            weight = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0))
            some = np.array([bool(t) for t in read])
            langs[some] = np.array(names, dtype=object)[best[some]]
            score[some] = (1.0 / weight.sum(axis=1))[some]
        return [pa.array(langs, pa.string()), pa.array(score, pa.float64())]

    return appended(frame, "lang_pred string, score double", make)
