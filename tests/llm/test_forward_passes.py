"""The classifiers' forward passes against plain loops, and faults of constant templates."""

import math
import random

import numpy as np
import pytest

from passledger.llm import quality, toxicity
from passledger.llm.template import TemplateError, compiled

TEXTS = ["", "a", "You total fool, nobody wants you here!", "word " * 60, "É ñ 日本 😀. " * 30, " \n\t", "x" * 1_500]


def sigmoid(v):
    return 1 / (1 + math.exp(-max(-60, min(60, v))))


def test_attention_by_loops():
    model = quality.Attention(seed=9)
    draw = np.random.default_rng(1)
    model.middle, model.spread = draw.normal(size=quality.INPUTS), 0.5 + draw.random(quality.INPUTS)
    p, want = model.p, []
    for text in TEXTS:
        rows = quality.passages([text])[0]
        codes, logits = [], []
        for row in rows:
            x = [(float(v) - m) / s for v, m, s in zip(row, model.middle, model.spread)]
            code = [math.tanh(sum(a * w for a, w in zip(x, p["encode"][:, j])) + p["shift"][j]) for j in range(quality.HIDDEN)]
            gates = [
                math.tanh(sum(c * w for c, w in zip(code, p["tanh"][:, j]))) * sigmoid(sum(c * w for c, w in zip(code, p["gate"][:, j]))) for j in range(quality.GATE)
            ]
            codes.append(code)
            logits.append(sum(g * w for g, w in zip(gates, p["weigh"])))
        weights = [math.exp(v) for v in logits]
        bag = [sum(w * c[j] for w, c in zip(weights, codes)) / sum(weights) for j in range(quality.HIDDEN)]
        want.append(sigmoid(sum(b * o for b, o in zip(bag, p["out"])) + p["bias"][0]))
    assert model.scores(TEXTS) == pytest.approx(want, abs=1e-9)


def test_recurrent_network_by_loops():
    model, draw = toxicity.Network(seed=4), random.Random(2)
    texts = TEXTS + [" ".join(draw.choices("you are a fool idiot and so on hate it all".split(), k=40))]
    p, want = model.p, []
    for text in texts:
        lex = toxicity.Lexicon([text])
        x, scores = model.inputs(lex), []
        for row in lex.windows:
            states = {}
            for side in "fb":
                h, found = np.zeros(toxicity.HIDDEN), [None] * toxicity.SPAN
                for t in range(toxicity.SPAN) if side == "f" else reversed(range(toxicity.SPAN)):
                    if row[t] > 0:
                        a, b = x[row[t]].astype(float) @ p[side + "x"] + p[side + "o"], h @ p[side + "h"]
                        new = []
                        for j in range(toxicity.HIDDEN):
                            z, r = sigmoid(a[j] + b[j]), sigmoid(a[toxicity.HIDDEN + j] + b[toxicity.HIDDEN + j])
                            n = math.tanh(a[2 * toxicity.HIDDEN + j] + r * b[2 * toxicity.HIDDEN + j])
                            new.append((1 - z) * n + z * h[j])
                        h = np.array(new)
                    found[t] = h
                states[side] = found
            both = [np.concatenate([states["f"][t], states["b"][t]]) for t in range(toxicity.SPAN)]
            logits = [float(np.tanh(s @ p["att"]) @ p["v"]) if row[t] > 0 else -30.0 for t, s in enumerate(both)]
            weights = [math.exp(v) for v in logits]
            pooled = sum(w * s for w, s in zip(weights, both)) / sum(weights)
            scores.append(sigmoid(float(pooled @ p["out"] + p["bias"][0])))
        want.append(max(scores))
    assert model.scores(texts) == pytest.approx(want, abs=2e-5)


@pytest.mark.parametrize("source", ["{{ 'a' - 1 }}", "{{ 1 < 'a' }}", "{{ none + 'x' }}", "{% if false %}{{ x | nothing }}{% endif %}", "{% if 1 == 1 %}a{% else %}{{ x | nothing }}{% endif %}"])
def test_constant_faults_are_template_errors(source):
    with pytest.raises(TemplateError):
        compiled(source)
