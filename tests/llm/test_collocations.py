"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passledger.llm import collocations
from tests.llm.test_operators import EDGE, SCHEMA, SMALL, texts

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, best=2_000, contained=100):
    """Every phrase counted by itself, every pair of phrases compared."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    told = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inside = lambda p, q: any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2))
    out = []
    for p, a in told.items():
        if any(q[0] == p[0] and len(q) > len(p) and 100 * b >= contained * a and inside(p, q) for q, b in told.items()):
            continue
        lang, words = p[0], p[1:]
        score, _, l, r = min(
            (1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]])
            for k in range(1, len(words))
        )
        out.append((lang, " ".join(words), a, l, r, n[lang], score))
    found = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        found += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:best])]
    return sorted(found)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "x", "x", "x", "x", 0) for i, (g, t) in enumerate(rows)], SCHEMA).repartition(5)


def found(rows, **options):
    got = collocations.collocations(rows, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("least,best,contained,limit", [(3, 2_000, 100, 8_000_000), (12, 7, 60, 3_000), (1, 50, 100, 200)])
def test_collocations(spark, least, best, contained, limit):
    draw = random.Random(least)
    vocabulary = ["a", "B", "b", "é", "new", "york", "city", "of", "w1", "日本"]
    rows = [(draw.choice(["en", "de", None, "und"]), " ".join(draw.choices(vocabulary, weights=range(1, 11), k=draw.randrange(12)))) for _ in range(80)]
    rows += [("en", "New York City of\tnew york, new york. city\nof")] * 9 + [("fr", text) for _, text in EDGE if len(text or "") < 100]
    rows += [("xx", "same " * 300), ("xx", None), ("", "a b a b a b a b"), ("en", "\x1c a\x1cb \x00 x\x85y")]
    assert found(frame(spark, rows), least=least, best=best, contained=contained, limit=limit) == brute(rows, least, best, contained)


def test_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").collect()]
    rows += [("en", "word " * 40_000), ("en", "x" * 300_000)]
    assert found(frame(spark, rows), least=25) == brute(rows, 25)


def test_a_full_map_of_pairs_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAP_BITS", 4)
    monkeypatch.setattr(collocations, "GROUP_BITS", 3)
    rows = [("en", text) for _, text in texts()[:40]]
    assert found(frame(spark, rows), least=5) == brute(rows, 5)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", [], 9 * 10**15), ("en", ["a"], 3 * 10**12), ("en", ["b"], 7 * 10**12), ("en", ["a", "b"], 2 * 10**12)], "lang string, words array<string>, n long"
    )
    old, collocations.phrase_counts = collocations.phrase_counts, lambda *_: counts
    try:
        row = collocations.collocations(frame(spark, [])).first()
    finally:
        collocations.phrase_counts = old
    assert row["score"] == 1000 * 2 * 10**12 * 9 * 10**15 // (3 * 10**12 * 7 * 10**12)


def test_empty(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [("en", None), (None, "")])) == []


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("aAé .,\t\n\x0b\r\x1c\x85!:\x00"), max_size=30))
def test_pieces(text):
    want = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER))]
    got, own = [], []
    for word in [*collocations.pieces(text), b"."]:
        if word == b".":
            got.append(own)
            own = []
        else:
            own.append(word.decode())
    assert got == want
