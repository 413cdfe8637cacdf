"""Importance resampling against a plain loop."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passledger.llm import resampling
from tests.llm.test_operators import EDGE, SMALL, documents, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(rows, target, percent, least_words, longest):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(doc, *features(text, longest)) for doc, text in rows]
    s = Counter(bucket(f) for _, found, _ in own for f in found)
    t = Counter(bucket(f) for text in target for f in features(text, longest)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    told = []
    for doc, found, words in own:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        told.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in told if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    cut = len(able) * percent // 100
    out = Counter((*r[:4], i + 1 if i < cut else None) for i, r in enumerate(able))
    return out + Counter((*r[:4], None) for r in told if r[4] < least_words)


def found(frame, target, **options):
    rows = resampling.drawn(frame, target, **options)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return Counter(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("percent,least_words,longest", [(10, 20, 1), (100, 0, 1), (35, 1, 3), (1, 10**9, 1)])
def test_drawn(spark, percent, least_words, longest):
    rows = EDGE + [(i, "Same words here") for i in range(900, 940)] + [(77, "twice the same row")] * 7 + texts()
    random.Random(3).shuffle(rows)
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()] + [None, "", "words words"]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = found(documents(spark, rows).repartition(5), goal, percent=percent, least_words=least_words, longest=longest)
    assert got == brute(rows, target, percent, least_words, longest)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert not found(none, none)
    assert found(documents(spark, EDGE), none, percent=50, least_words=1) == brute(EDGE, [], 50, 1, 1)


def test_cutoff_is_the_key_at_every_place(spark):
    draw = random.Random(5)
    rows = [(draw.choice([-5, 0, 3, 2**40]), draw.randrange(4)) for _ in range(60)] + [(7, 7)] * 30
    keys = spark.createDataFrame(rows, "a long, b long").repartition(6)
    for place in (0, 1, 17, 44, 45, 60, 88, 89):
        assert resampling.cutoff(keys, place) == sorted(rows)[place]
    with pytest.raises(ValueError):
        resampling.cutoff(keys, 90)


def test_numbered_is_the_global_order(spark):
    frame = spark.range(5_000).select((F.col("id") * 7919 % 5003).alias("v"))
    assert all(r["place"] == i + 1 for i, r in enumerate(sorted(resampling.numbered(frame, ["v"], "place").collect())))
