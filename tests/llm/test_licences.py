"""Licence scans against plain searches."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from passledger.llm import licences
from passledger.llm.common import plain_words
from tests.llm.test_operators import EDGE, MIDDLE, documents, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    """n_words, n_base, first, last and labels by looking at every place."""
    words = words_of(text)
    hits = [
        (i, label) for phrase, label in licences.PHRASES for own in [phrase.split()]
        for i in range(len(words)) if words[i : i + len(own)] == own
    ]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def longest_runs(words, sequences):
    """For every place the length of the longest run ending there that some sequence holds."""
    out = []
    for end in range(1, len(words) + 1):
        size = 0
        while size < end and any(
            words[end - size - 1 : end] == s[i : i + size + 1] for s in sequences for i in range(len(s) - size)
        ):
            size += 1
        out.append(size)
    return out


def brute_spans(words, templates, least, share, gap):
    """Anchors by comparing every place of a text with every place of a template; chains by full search."""
    tokens = [words_of(text) for _, text in templates]
    statistic = longest_runs(words, tokens + [p.split() for p, _ in licences.PHRASES]) + [0]
    found = []
    for number, own in enumerate(tokens):
        anchors = [
            (end - size, end, at, at + size) for end in range(1, len(words) + 1) for size in [statistic[end - 1]]
            if size >= least and statistic[end] != size + 1
            for at in range(len(own) - size + 1) if own[at : at + size] == words[end - size : end]
        ]
        anchors.sort(key=lambda a: (a[0], a[2]))
        best = []
        for a in anchors:
            value = (a[1] - a[0], a[0])
            for b, (covered, first) in list(zip(anchors, best)):
                cut = max(0, b[1] - a[0], b[3] - a[2])
                if b[1] + gap >= a[0] and a[1] > b[1] and cut < a[1] - a[0] and covered + a[1] - a[0] - cut > value[0]:
                    value = (covered + a[1] - a[0] - cut, first)
            best.append(value)
        taken = []
        for (covered, first), a in sorted(zip(best, anchors), key=lambda c: (-c[0][0], c[0][1], c[1][1])):
            if covered >= share * len(own) and all(a[1] <= x or first >= y for x, y in taken):
                taken.append((first, a[1]))
                found.append((templates[number][0], number, first, a[1] - 1, covered))
    return sorted(found, key=lambda s: (s[2], s[1]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=4), st.text("abcd", max_size=40))
def test_matching_statistics(sequences, text):
    automaton = licences.SuffixAutomaton([[c.encode() for c in s] for s in sequences], 2)
    told = dict.fromkeys(range(len(text)), 0)
    for place, state, size in automaton.statistics([c.encode() for c in text]):
        told[place] = size
        run = text[place + 1 - size : place + 1]
        if size >= 2:
            assert automaton.ends[state] == [
                (n, e) for n, s in enumerate(sequences) for e in range(size, len(s) + 1) if s[e - size : e] == run
            ]
    assert list(told.values()) == longest_runs(list(text), [list(s) for s in sequences])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([x for _, t in licences.TEMPLATES[:6] for x in re.split(r"[,.;:]", t)] + ["mit license", "zz", "the"]), max_size=8))
def test_spans(parts):
    words = plain_words(" ".join(parts))
    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES, 4, 0.8, 8)
    told = [(s["label"], s["template"], s["first_word"], s["last_word"], s["covered"]) for s in scanner.scan(words)[1]]
    assert told == brute_spans([w.decode() for w in words], licences.TEMPLATES, 4, 0.8, 8)


def test_notices_are_found_with_gaps_and_changes():
    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES, 4, 0.8, 8)
    for number, (label, text) in enumerate(licences.TEMPLATES):
        words = plain_words("Some words before. " + text + " and after")
        assert (label, 3, 2 + len(plain_words(text))) in [
            (s["label"], s["first_word"], s["last_word"]) for s in scanner.scan(words)[1] if s["template"] == number
        ]
    words = plain_words(licences.TEMPLATES[0][1])
    words[40:41] = [b"other", b"words", b"here"]
    assert [s["label"] for s in scanner.scan(words)[1]] == ["mit"]
    many = scanner.scan(plain_words("Released under the MIT License.\n" * 20_000))
    assert len(many[0]) == len(many[1]) == 20_000


def test_edges(spark):
    rows = EDGE + [
        (20, "MIT-License / mit license"), (21, "The Apache\nLicense; GENERAL public LICENSE"), (22, "mit licenses permit license"),
        (23, "Licensed under CC BY-NC 4.0."), (24, "mit"), (25, "ñmit license mit licenseñ"), (25, "ñmit license mit licenseñ"),
    ]
    frame = licences.licence_digests(documents(spark, rows))
    got = [tuple(r) for r in frame.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((r[:6] for r in got), key=key) == sorted(((doc, *base(text)) for doc, text in rows), key=key)
    labels = {r[0]: (r[6], r[7]) for r in got}
    assert labels[20] == ("mit", 1.0) and labels[21] == ("apache,gpl", 1.0) and labels[23] == ("cc-by-nc", 1.0) and labels[24] == ("", 0.0)
    kept = licences.with_licences(documents(spark, rows))
    assert kept.columns == [*documents(spark, rows).columns, "n_words", "phrases", "spans"]
    assert not licences.licence_digests(documents(spark, [])).collect()


def test_query(spark):
    rows = entry.queries()["op12_licences"](spark, MIDDLE).collect()
    for row, (doc, text) in zip(sorted(rows), texts(MIDDLE)):
        spans = brute_spans(words_of(text), licences.TEMPLATES, 4, 0.8, 8) if re.search("(?i)licen|permi", text) else []
        labels = {x for x in [*base(text)[4].split(","), *(s[0] for s in spans)] if x}
        shares = [s[4] / len(words_of(licences.TEMPLATES[s[1]][1])) for s in spans]
        assert tuple(row) == (doc, *base(text), ",".join(sorted(labels)), 1.0 if base(text)[1] else max(shares, default=0.0))
    assert {r["labels"] for r in rows} >= {"", "mit", "apache", "gpl", "cc-by-nc"}
