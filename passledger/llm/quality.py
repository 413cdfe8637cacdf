"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WIDTH`` code points. A passage is described by
the shares of character classes and of pairs of neighbouring classes, and by how much
of it repeats; a layer encodes it, a gated attention gives it a weight within its
document, and the weighted mean of the codes is scored. Only document labels are known;
the attention learns which passages carry them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from passledger.llm.common import appended, labelled_texts

WIDTH = 400
CLASSES = 16
#: The ASCII characters with a class of their own, by class number.
_OWN = {3: " ", 4: "\n", 5: ".", 6: ",", 7: "!", 8: "|", 9: "$%&#*^~=+", 10: "0123456789", 11: "@/\\_:;", 12: "'\"-()[]", 13: "<>{}`?"}
INPUTS = CLASSES + CLASSES * CLASSES + 3
HIDDEN, GATE = 16, 8


def _class_table() -> np.ndarray:
    found = np.full(0x250, 14, dtype=np.uint8)
    for code in range(0x250):
        char = chr(code)
        if char.isalpha():
            found[code] = 1 if char.islower() else 2
    for number, chars in _OWN.items():
        found[[ord(c) for c in chars]] = number
    return found


_TABLE = _class_table()


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the number of the first passage of each text.

    An empty text is one empty passage. The passages cover the whole text.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-lengths // WIDTH))
    first = np.cumsum(counts) - counts
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    passage = first[owner] + (np.arange(len(codes)) - begin[owner]) // WIDTH
    total = int(counts.sum())
    size = np.bincount(passage, minlength=total).astype(np.float64)
    kind = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], 15).astype(np.int64)
    safe = np.maximum(size, 1.0)
    out = np.zeros((total, INPUTS), dtype=np.float32)
    out[:, :CLASSES] = np.bincount(passage * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) / safe[:, None]
    if len(codes) > 1:
        inside = passage[1:] == passage[:-1]
        pair = (passage[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
        out[:, CLASSES : CLASSES + CLASSES**2] = (
            np.bincount(pair[inside], minlength=total * CLASSES**2).reshape(total, CLASSES**2) / safe[:, None]
        )
    np.sqrt(out, out=out)
    out[:, -3] = _distinct(codes, passage, total, 6)
    out[:, -2] = _distinct(codes, passage, total, 12)
    out[:, -1] = size / WIDTH
    return out, first


def _distinct(codes: np.ndarray, passage: np.ndarray, total: int, n: int) -> np.ndarray:
    """The share of a passage's n-grams of characters that are not repeats; 1 if it has none."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.ones(total)
    gram = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + m]
    own = passage[:m]
    inside = own == passage[n - 1 :]
    gram = (gram ^ (gram >> np.uint64(31))) & np.uint64((1 << 40) - 1)
    keys = np.sort((own[inside].astype(np.uint64) << np.uint64(40)) | gram[inside])
    new = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    all_ = np.bincount(own[inside], minlength=total)
    return np.where(all_ > 0, np.bincount((new >> np.uint64(40)).astype(np.int64), minlength=total) / np.maximum(all_, 1), 1.0)


class Attention:
    """Gated attention over passage codes, trained by Adam on document labels."""

    NAMES = ("encode", "shift", "tanh", "gate", "weigh", "out", "bias")

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.p = {
            "encode": draw.normal(0, INPUTS**-0.5, (INPUTS, HIDDEN)), "shift": np.zeros(HIDDEN),
            "tanh": draw.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "gate": draw.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "weigh": draw.normal(0, GATE**-0.5, GATE), "out": draw.normal(0, HIDDEN**-0.5, HIDDEN), "bias": np.zeros(1),
        }
        self.middle, self.spread = np.zeros(INPUTS), np.ones(INPUTS)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        counts = np.diff(np.append(first, len(x)))
        x = (x - self.middle) / self.spread
        code = np.tanh(x @ p["encode"] + p["shift"])
        a, g = np.tanh(code @ p["tanh"]), 1 / (1 + np.exp(-(code @ p["gate"])))
        logit = (a * g) @ p["weigh"]
        top = np.repeat(np.maximum.reduceat(logit, first), counts)
        weight = np.exp(logit - top)
        weight /= np.repeat(np.add.reduceat(weight, first), counts)
        bag = np.add.reduceat(code * weight[:, None], first)
        score = 1 / (1 + np.exp(-np.clip(bag @ p["out"] + p["bias"][0], -60, 60)))
        return {"x": x, "code": code, "a": a, "g": g, "weight": weight, "bag": bag, "score": score, "counts": counts}

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.forward(*passages(texts))["score"]

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 250, rate: float = 0.01, decay: float = 1e-4, prior: float = 0.8) -> Attention:
        """``prior`` is the share of label 1 that the rows are weighted to."""
        x, first = passages(texts)
        self.middle, self.spread = x.mean(axis=0).astype(float), x.std(axis=0).astype(float) + 0.02
        balance = np.where(labels > 0.5, prior / max(labels.mean(), 1e-9), (1 - prior) / max(1 - labels.mean(), 1e-9))
        first_moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        second_moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            grads = self._gradients(self.forward(x, first), first, labels, balance)
            for k, v in self.p.items():
                grad = grads[k] + decay * v
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * grad
                second_moment[k] = 0.99 * second_moment[k] + 0.01 * grad**2
                v -= rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradients(self, f: dict, first: np.ndarray, labels: np.ndarray, balance: np.ndarray) -> dict:
        p = self.p
        error = (f["score"] - labels) * balance / len(labels)
        spread = lambda v: np.repeat(v, f["counts"], axis=0)
        d_bag = spread(error[:, None] * p["out"])
        d_weight = (d_bag * f["code"]).sum(axis=1)
        d_logit = f["weight"] * (d_weight - spread(np.add.reduceat(f["weight"] * d_weight, first)))
        d_ag = d_logit[:, None] * p["weigh"]
        d_a, d_g = d_ag * f["g"] * (1 - f["a"] ** 2), d_ag * f["a"] * f["g"] * (1 - f["g"])
        d_code = d_bag * f["weight"][:, None] + d_a @ p["tanh"].T + d_g @ p["gate"].T
        d_in = d_code * (1 - f["code"] ** 2)
        return {
            "encode": f["x"].T @ d_in, "shift": d_in.sum(axis=0), "tanh": f["code"].T @ d_a, "gate": f["code"].T @ d_g,
            "weigh": (f["a"] * f["g"]).T @ d_logit, "out": f["bag"].T @ error, "bias": error.sum(keepdims=True),
        }


def learned(documents: DataFrame, labels: DataFrame, per_label: int = 900, longest: int = 20_000) -> Attention:
    """Fits on a bounded sample: at most ``per_label`` texts of each label, none longer than
    ``longest`` code points. ``labels`` has doc_id and label. Without rows of both labels
    the score stays near one half."""
    sample = labelled_texts(documents, labels, per_label, longest)
    model = Attention()
    if len({label for _, label in sample}) == 2:
        model.fit([t for t, _ in sample], np.array([float(label) for _, label in sample]))
    return model


def scored(frame: DataFrame, model, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Every row of ``frame`` (with a text column), score and predicted, under ``names``.

    ``model.scores`` rates whole texts from 0 to 1; predicted is 1 from ``threshold`` on.
    A null text counts as empty and has the score of an empty text; repeated rows are
    scored alike. Columns of the two names are replaced.
    """

    def make(texts: list[str]) -> list[pa.Array]:
        score = np.asarray(model.scores(texts), dtype=np.float64)
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return appended(frame, f"`{names[0]}` double, `{names[1]}` int", make, limit=2_000_000)


def drop_rejected(frame: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``frame`` that score at least ``threshold``, with all their columns."""
    return scored(frame, model, threshold, ("_score_here", "_predicted_here")).where("_predicted_here = 1").select(*frame.columns)
