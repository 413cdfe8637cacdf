"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as words; a window holds ``SPAN`` of them and starts ``STEP`` after the
last, so windows overlap and cover the whole text. A word enters as a vector of its own
and the mean of the vectors of its character 4-grams, both found by hash. Two gated
recurrent layers read a window in either direction, attention pools their states, and
the window is scored; a text has the score of its worst window. Only labels of texts are
known, so training goes on with the windows that score highest.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from passledger.llm.common import labelled_texts

SPAN, STEP = 16, 8
BUCKETS = 1 << 15
WORD, CHAR, HIDDEN, ATTEND = 10, 14, 12, 10
_WORDS = re.compile(r"[^\W\d_]+")


class Lexicon:
    """Distinct words of some texts and the windows over them; word 0 fills up."""

    def __init__(self, texts: list[str]):
        numbers: dict[str, int] = {"": 0}
        rows, self.first, at = [], [], 0
        for text in texts:
            ids = [numbers.setdefault(w, len(numbers)) for w in _WORDS.findall(text.lower())]
            count = max(1, -(-(len(ids) - (SPAN - STEP)) // STEP))
            padded = np.zeros((count - 1) * STEP + SPAN, dtype=np.int32)
            padded[: len(ids)] = ids
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, SPAN)[::STEP])
            self.first.append(at)
            at += count
        self.windows = np.concatenate(rows) if rows else np.zeros((0, SPAN), dtype=np.int32)
        self.first = np.array(self.first, dtype=np.int64)
        self._hash(list(numbers))

    def _hash(self, words: list[str]) -> None:
        """Bucket of each word and of its 4-grams, one for each character, with a space at both ends."""
        joined = " " + " ".join(words) + "  "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        before, at, after = codes[:-3], codes[1:-2], codes[2:-1]
        last = np.where(after == 32, after, codes[3:])  # nothing of the next word
        gram = np.zeros(len(at), dtype=np.uint64)
        for part in (before, at, after, last):
            gram = (gram + part) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(29)
        keep = at != 32
        self.grams = (gram % np.uint64(BUCKETS)).astype(np.int64)[keep]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.lengths = lengths
        self.owner = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(self.grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        inner = at[keep] * (np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        total = np.zeros(len(words), dtype=np.uint64)
        np.add.at(total, self.owner, inner ^ (inner >> np.uint64(32)))
        self.word = (total % np.uint64(BUCKETS)).astype(np.int64)


class Network:
    """Parameters and both passes; trained by Adam in numpy."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        size = WORD + CHAR
        normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": normal(BUCKETS, WORD, scale=0.01), "char": normal(BUCKETS, CHAR, scale=0.02)}
        for side in ("f", "b"):
            self.p |= {side + "x": normal(size, 3 * HIDDEN, scale=size**-0.5), side + "h": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), side + "o": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"att": normal(2 * HIDDEN, ATTEND, scale=0.2), "v": normal(ATTEND, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.array([-1.0], np.float32)}

    def inputs(self, lex: Lexicon) -> np.ndarray:
        p = self.p
        mean = np.zeros((len(lex.word), CHAR), np.float32)
        if len(lex.grams):
            some = lex.lengths > 0
            starts = (np.cumsum(lex.lengths) - lex.lengths)[some]
            mean[some] = np.add.reduceat(p["char"][lex.grams], starts, axis=0) / lex.lengths[some, None]
        return np.concatenate([p["word"][lex.word], mean], axis=1)

    def _run(self, side: str, rows: np.ndarray, projected: np.ndarray, trace: list | None) -> np.ndarray:
        u = self.p[side + "h"]
        h = np.zeros((len(rows), HIDDEN), np.float32)
        states = np.empty((SPAN, len(rows), HIDDEN), np.float32)
        for t in range(SPAN) if side == "f" else range(SPAN - 1, -1, -1):
            x, own = projected[rows[:, t]], h @ u
            zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
            filled = (rows[:, t] > 0)[:, None]
            after = np.where(filled, n + z * (h - n), h)
            if trace is not None:
                trace.append((t, h, z, r, n, own[:, 2 * HIDDEN :], filled))
            h = states[t] = after
        return states

    def forward(self, lex: Lexicon, rows: np.ndarray, keep: bool = False) -> dict:
        p, x = self.p, self.inputs(lex)
        traces = {"f": [] if keep else None, "b": [] if keep else None}
        s = np.concatenate([self._run(k, rows, x @ p[k + "x"] + p[k + "o"], traces[k]) for k in ("f", "b")], axis=2)
        a = np.tanh(s @ p["att"])
        logit = np.where(rows.T > 0, a @ p["v"], np.float32(-30.0))
        weight = np.exp(logit - logit.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (s * weight[:, :, None]).sum(axis=0)
        score = 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["bias"][0], -40, 40)))
        return {"x": x, "s": s, "a": a, "weight": weight, "pooled": pooled, "score": score, "traces": traces}

    def window_scores(self, lex: Lexicon, block: int = 8_192) -> np.ndarray:
        """Scores of all windows, in blocks of bounded memory."""
        found = [self.forward(lex, lex.windows[i : i + block])["score"] for i in range(0, len(lex.windows), block)]
        return np.concatenate(found) if found else np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        lex = Lexicon(texts)
        return np.maximum.reduceat(self.window_scores(lex), lex.first).astype(float)

    def gradients(self, lex: Lexicon, rows: np.ndarray, labels: np.ndarray) -> dict:
        p, f = self.p, self.forward(lex, rows, keep=True)
        error = ((f["score"] - labels) / len(labels)).astype(np.float32)
        g = {"out": f["pooled"].T @ error, "bias": error.sum(keepdims=True)}
        d_pooled = error[:, None] * p["out"]
        d_s = f["weight"][:, :, None] * d_pooled
        d_weight = (f["s"] * d_pooled).sum(axis=2)
        d_logit = f["weight"] * (d_weight - (f["weight"] * d_weight).sum(axis=0))
        d_logit = np.where(rows.T > 0, d_logit, np.float32(0))
        g["v"] = np.tensordot(d_logit, f["a"], axes=([0, 1], [0, 1]))
        d_a = d_logit[:, :, None] * p["v"] * (1 - f["a"] ** 2)
        g["att"] = np.tensordot(f["s"], d_a, axes=([0, 1], [0, 1]))
        d_s += d_a @ p["att"].T
        d_x = np.zeros_like(f["x"])
        for side, part in (("f", d_s[:, :, :HIDDEN]), ("b", d_s[:, :, HIDDEN:])):
            self._back(side, rows, f, part, g, d_x)
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], lex.word, d_x[:, :WORD])
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], lex.grams, (d_x[:, WORD:] / np.maximum(lex.lengths, 1)[:, None])[lex.owner])
        return g

    def _back(self, side: str, rows: np.ndarray, f: dict, d_s: np.ndarray, g: dict, d_x: np.ndarray) -> None:
        u, w = self.p[side + "h"], self.p[side + "x"]
        d_u, d_projected = np.zeros_like(u), np.zeros((len(d_x), 3 * HIDDEN), np.float32)
        carried = np.zeros((len(rows), HIDDEN), np.float32)
        for t, h, z, r, n, own, filled in reversed(f["traces"][side]):
            d_h = carried + d_s[t]
            live = np.where(filled, d_h, np.float32(0))
            d_n = live * (1 - z) * (1 - n**2)
            d_z = live * (h - n) * z * (1 - z)
            d_r = d_n * own * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_u += h.T @ d_own
            np.add.at(d_projected, rows[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
            carried = np.where(filled, live * z + d_own @ u.T, d_h)
        g[side + "h"], g[side + "x"], g[side + "o"] = d_u, f["x"].T @ d_projected, d_projected.sum(axis=0)
        d_x += d_projected @ w.T

    def fit(self, texts: list[str], labels: np.ndarray, rounds: int = 7, batch: int = 512, rate: float = 0.01, seed: int = 1, steps: int = 200) -> Network:
        """First all windows take the label of their text, then only each text's worst ones.

        A small sample goes on past ``rounds`` until it has made ``steps`` steps.
        """
        draw = np.random.default_rng(seed)
        lex = Lexicon(texts)
        text_of = np.repeat(np.arange(len(texts)), np.diff(np.append(lex.first, len(lex.windows))))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = turn = 0
        while turn < rounds or 0 < step < steps:
            order = draw.permutation(len(lex.windows))
            if turn:
                score = self.window_scores(lex)
                order = np.lexsort((-score, text_of))
                rank = np.arange(len(order)) - lex.first[text_of[order]]
                toxic = labels[text_of[order]] > 0.5
                wanted = np.where(toxic, (rank < 1) | (score[order] > 0.9), (rank < 4) | (score[order] > 0.05))
                order = draw.permutation(order[wanted])
            else:
                order = order[: 40 * batch]
            for at in range(0, len(order), batch):
                picked = order[at : at + batch]
                used, local = np.unique(lex.windows[picked], return_inverse=True)
                part, local = _narrowed(lex, used), local.reshape(len(picked), SPAN)
                if used[0]:  # keep 0 as the filler
                    local = local + 1
                grads = self.gradients(part, local, labels[text_of[picked]])
                step += 1
                pace = rate * (0.5 if turn > rounds // 2 and step > steps // 2 else 1.0)
                for k, v in self.p.items():
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                    v -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            turn += 1
        return self


def _narrowed(lex: Lexicon, used: np.ndarray) -> Lexicon:
    """The lexicon of some words only, the filler first."""
    if not len(used) or used[0]:
        used = np.concatenate([[0], used])
    part = object.__new__(Lexicon)
    part.word, part.lengths = lex.word[used], lex.lengths[used]
    starts = np.cumsum(lex.lengths) - lex.lengths
    part.grams = np.concatenate([lex.grams[starts[i] : starts[i] + lex.lengths[i]] for i in used])
    part.owner = np.repeat(np.arange(len(used)), part.lengths)
    return part


def learned(documents: DataFrame, labels: DataFrame, per_label: int = 1_200, longest: int = 4_000) -> Network:
    """Fits on a bounded sample: at most ``per_label`` texts of each label, none longer than
    ``longest`` code points. ``labels`` has doc_id and label. Without rows of both labels
    nothing is learned and all scores are low."""
    sample = labelled_texts(documents, labels, per_label, longest)
    network = Network()
    if len({label for _, label in sample}) == 2:
        network.fit([t for t, _ in sample], np.array([float(label) for _, label in sample], np.float32))
    return network
