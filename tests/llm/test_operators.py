"""The text operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from passledger.llm import bpe, chat, contamination, exact, html, language, quality, simhash, toxicity, warc
from passledger.llm.common import learnable
from passledger.llm.template import TemplateError, compiled, fold, parse, FILTERS
from tools.compare import TABLES, rows_of

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, matches string, _text string, kept int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "mine", "mine", "mine", "mine", 0) for i, t in rows], SCHEMA)


EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (5, "ab"), (None, "ab"), (6, "x" * 300_000), (7, "word " * 40_000),
    (8, "É ñ 日本 😀"), (9, None), (None, None),
]


def texts(folder=SMALL):
    return duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY 1").fetchall()


def answers(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


# --- exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    return Counter(
        (doc, min(groups[b])[3], len(groups[b]), doc == min(groups[b])[3], hashlib.sha256(b.encode()).hexdigest())
        for doc, text in rows for b in [re.sub(r"[\x20\x09-\x0D]", "", text or "")]
    )


def test_exact_groups(spark):
    rows = EDGE + texts()
    found = answers(exact.exact_groups(documents(spark, rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(found) == brute_exact(rows)


def test_exact_spills(spark):
    rows = texts()
    full = {tuple(r) for r in exact.owners(documents(spark, rows)).collect()}
    assert {tuple(r) for r in exact.owners(documents(spark, rows), memory=5_000).collect()} == full


def test_exact_keeps_columns(spark):
    kept = exact.drop_copies(documents(spark, EDGE))
    assert kept.columns == documents(spark, EDGE).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([3, 4, 6, 7, 8])


REPEATED = [
    (1, "a b c d e"), (1, "a b c d e"), (1, "zz"), (1, "z z"), (1, "z\tz"), (None, "q r s t u"), (None, "q r s t u"), (None, None), (2, ""), (2, ""),
    (3, "q r s t u"), (4, "Zz"), (1, "Zz"),
]


def test_exact_keeps_one_row_of_each_text(spark):
    kept = answers(exact.drop_copies(documents(spark, REPEATED)), "doc_id", "text")
    assert Counter((i, (t or "").replace("\t", " ")) for i, t in kept) == Counter(
        [(1, "a b c d e"), (1, "z z"), (3, "q r s t u"), (2, ""), (1, "Zz")]
    )
    assert exact.drop_copies(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=30))
def test_trie(keys):
    trie = exact.RadixTrie()
    for i, key in enumerate(keys):
        trie.insert(key, (0, False, i), 1)
    spilled = list(trie.spill()) if trie.by_branch else []
    got = {k: (r[2], c) for k, r, c in [*spilled, *trie.drain()]}
    assert got == {k: (keys.index(k), keys.count(k)) for k in keys}


# --- BPE


@pytest.fixture(scope="module")
def vocabulary():
    raw = open(bpe.public_ranks(), "rb").read()
    return bpe.Vocabulary(raw)


@pytest.fixture(scope="module")
def theirs(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sétan日!1")), max_size=60))
def test_bpe_as_tiktoken(vocabulary, theirs, text):
    import regex

    ids = vocabulary.encode(regex.compile(bpe.public_pattern()), text)
    assert ids == theirs.encode_ordinary(text)
    assert vocabulary.decode(ids) == text.encode()


def test_bpe_query(spark, theirs):
    rows = EDGE + texts()
    found = bpe.tokenized(documents(spark, rows), bpe.public_ranks(), bpe.public_pattern())
    assert found.columns[-2:] == ["ids", "decoded"] and found.columns[0] == "doc_id"
    got = Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in found.collect())
    assert got == Counter((i, tuple(theirs.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    digest = {r["doc_id"]: r for r in entry.queries()["op5_byte_bpe"](spark, SMALL).collect()}
    for i, t in texts():
        ids = theirs.encode_ordinary(t)
        assert digest[i]["n_tokens"] == len(ids)
        assert digest[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


# --- language


def test_code_lengths_are_exact():
    models = [language.Contexts.learn([b"abracadabra", b"abc"])]
    seen = Counter()
    for t in (b"abracadabra", b"abc"):
        data = b"    " + t
        for i in range(4, len(data)):
            for order in range(5):
                seen[data[i - order : i + 1]] += 1

    def bits(context, symbol):
        if context is None:
            return 8.0
        after = {g[-1]: n for g, n in seen.items() if len(g) == len(context) + 1 and g[:-1] == context}
        shorter = context[1:] if context else None
        if not after:
            return bits(shorter, symbol)
        total = sum(after.values()) + len(after)
        return -np.log2(after[symbol] / total) if symbol in after else -np.log2(len(after) / total) + bits(shorter, symbol)

    for text in (b"abrac", b"zzz", b"", b"cab"):
        data = b"    " + text
        want = sum(bits(data[i - 4 : i], data[i]) for i in range(4, len(data)))
        assert language.code_lengths(models, [text])[0, 0] == pytest.approx(want)
        assert language.code_lengths(models, [text, text], piece=2)[1, 0] == pytest.approx(want)


def test_language_held_out(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{MIDDLE}/documents.parquet'").fetchall())
    rows = entry.queries()["op6_language_id"](spark, MIDDLE).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) > 0.97


def test_language_edges(spark):
    names, models = language.learned(documents(spark, [(1, "the cat"), (2, None)]))
    got = answers(language.predicted(documents(spark, EDGE), names, models), "doc_id", "lang_pred", "score")
    assert len(got) == len(EDGE) and {p for i, p, s in got if i in (1, 2, 3, 9)} == {"und"}
    assert language.predicted(documents(spark, []), [], []).count() == 0
    assert {r["lang_pred"] for r in language.predicted(documents(spark, EDGE), [], []).collect()} == {"und"}


# --- quality and toxicity


def test_quality_held_out(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{MIDDLE}/labels.parquet'").fetchall())
    rows = [r for r in entry.queries()["op7_quality"](spark, MIDDLE).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95


def gradients_agree(model, loss, gradients):
    for name, value in model.p.items():
        place = np.unravel_index(np.argmax(np.abs(gradients[name])), value.shape)
        before, step = value[place], 1e-4
        value[place] = before + step
        high = loss()
        value[place] = before - step
        low = loss()
        value[place] = before
        assert gradients[name][place] == pytest.approx((high - low) / (2 * step), rel=1e-2, abs=1e-5)


def cross_entropy(score, labels):
    return -(labels * np.log(score) + (1 - labels) * np.log(1 - score)).mean()


def test_quality_gradients():
    model, bags, labels = quality.Attention(), ["some text " * 90, "!!! ### " * 70, "", "One. Two."], np.array([1.0, 0, 0, 1])
    x, first = quality.passages(bags)
    grads = model._gradients(model.forward(x, first), first, labels, np.ones(4))
    gradients_agree(model, lambda: cross_entropy(model.forward(x, first)["score"], labels), grads)


def test_toxicity_gradients():
    model, lex = toxicity.Network(), toxicity.Lexicon(["the cat sat on a mat " * 5, "you are bad", ""])
    model.p = {k: v.astype(np.float64) * 5 for k, v in model.p.items()}
    rows, labels = lex.windows[:4], np.array([1.0, 0, 1, 0])
    grads = model.gradients(lex, rows, labels.astype(np.float32))
    gradients_agree(model, lambda: cross_entropy(model.forward(lex, rows)["score"].astype(np.float64), labels), grads)


def test_toxicity_windows_cover_all_words():
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100)]
    for n in (0, 1, 7, 16, 17, 24, 25, 100):
        lex = toxicity.Lexicon([" ".join(words[:n])])
        assert set(lex.windows.ravel()) - {0} == set(range(1, n + 1))


def test_toxicity_learns_stems():
    draw = random.Random(4)
    syllables = ["ba", "ko", "li", "ten", "dor", "mi", "sa", "ru"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randrange(1, 4)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(240)]
    def spoilt(text):  # one word in sixteen or so
        words = text.split()
        for at in draw.sample(range(60), 4):
            words[at] = "grumf" + word()
        return " ".join(words)

    bad = [spoilt(t) for t in clean[:120]]
    labels = np.array([1.0] * 100 + [0.0] * 100, np.float32)
    model = toxicity.Network().fit(bad[:100] + clean[120:220], labels, batch=64)
    score = model.scores(bad[100:] + clean[220:])
    assert (score[:20] >= 0.3).mean() >= 0.9 and (score[20:] < 0.3).mean() >= 0.9


@pytest.mark.parametrize("model", [quality.Attention(), toxicity.Network()])
def test_scores_edges(spark, model):
    got = quality.scored(documents(spark, EDGE), model)
    assert got.columns[:9] == [c for c in documents(spark, EDGE).columns if c != "score"] and got.count() == len(EDGE)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.scored(documents(spark, []), model).count() == 0


def test_learning_rows_leave_out_the_held_out(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    ids = {r["doc_id"] for r in learnable(labels, "quality", 5, 0).collect()}
    assert ids == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 0}


# --- SimHash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(rows):
    prints = np.array([brute_print(t) for _, t in rows], dtype=np.uint64)
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4):
            a, b = find(i), find(i + 1 + int(j))
            group[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        members[find(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return Counter((doc, f"{int(prints[i]):016x}", least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_golay_keys_meet():
    draw, code = np.random.default_rng(1), simhash.Golay()
    one = draw.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    for bits in range(5):
        two = one.copy()
        for i in range(len(two)):
            for b in draw.choice(64, bits, replace=False):
                two[i] ^= np.uint64(1) << np.uint64(b)
        keys = [defaultdict(set), defaultdict(set)]
        for found, prints in zip(keys, (one, two)):
            for key, row in zip(*simhash.keys_of(code, prints)):
                found[row].add(key)
        assert all(keys[0][i] & keys[1][i] for i in range(len(one)))


def test_near_groups(spark):
    rows = [r for r in EDGE if len(r[1] or "") < 1000] + texts()
    found = answers(simhash.near_groups(documents(spark, rows)), "doc_id", "fingerprint", "component_id")
    assert Counter(found) == brute_groups(rows)


def test_links_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 5)
    draw = np.random.default_rng(2)
    centre = np.uint64(0x123456789ABCDEF0)
    prints = {int(centre)}
    for _ in range(150):
        p = centre
        for b in draw.choice(64, draw.integers(1, 8), replace=False):
            p ^= np.uint64(1) << np.uint64(b)
        prints.add(int(p))
    values = np.array(sorted(prints), dtype=np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "print long")
    got = {tuple(sorted(r)) for r in simhash.links(frame).collect()}
    number = {int(v): i for i, v in enumerate(values.view(np.int64))}

    def classes(pairs):
        group = list(range(len(values)))
        find = lambda i: i if group[i] == i else find(group[i])
        for a, b in pairs:
            a, b = find(a), find(b)
            group[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(values))]

    near = [(i, j) for i in range(len(values)) for j in range(i) if np.bitwise_count(values[i] ^ values[j]) <= 4]
    assert classes([(number[a], number[b]) for a, b in got]) == classes(near)
    assert {(number[a], number[b]) for a, b in got} <= set(near) | {(j, i) for i, j in near}


def test_near_copies_drop(spark):
    for rows in (EDGE, REPEATED):
        frame = documents(spark, rows)
        kept = simhash.drop_near_copies(frame)
        assert kept.columns == frame.columns
        groups = simhash.grouped(frame).select("root", "component_id").distinct().collect()
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["component_id"] for r in groups)
    # a name held by several groups: one row of each
    assert Counter(answers(kept, "doc_id", "text"))[(1, "a b c d e")] == 1


# --- decontamination


def test_wand_against_brute_force():
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet' ORDER BY 1").fetchall()
    seen, lengths = Counter(), []
    for _, t in items:
        for e in contamination.entries_of(t):
            seen.update(set(e))
            lengths.append(len(e))
    index = contamination.Index(items, seen, len(lengths), float(np.mean(lengths)))
    for _, text in texts()[:80]:
        words = contamination.words_of(text)
        for least in (0.2, 0.6):
            want = set()
            for start in range(0, max(len(words) - contamination.ENTRY, 1), contamination.ENTRY):
                score = Counter()
                for w in set(words[start : start + 2 * contamination.ENTRY]):
                    for j in range(*index.start[index.number[w] : index.number[w] + 2]) if w in index.number else ():
                        for at in range(index.first[j], index.first[j + 1]):
                            score[index.entry[at]] += index.value[at]
                want |= {(index.owner[e], start) for e, s in score.items() if s >= least - 1e-9}
            assert {(p, s) for p, hits in index.retrieve(words, least).items() for _, s in hits} == want


def test_leaks_are_found(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet' ORDER BY 1").fetchall()
    filler = " ".join(t for _, t in texts()[:3])
    rows = [(i, f"{filler[: 37 * i]} {t.upper()} {filler}") for i, t in items[:12]] + [(100, filler), *EDGE]
    bench = spark.createDataFrame([*items, (None, None), (77, ""), (78, "  "), items[0]], "item_id long, text string")
    for size in (400_000, 3_000):
        got = answers(contamination.contaminated(documents(spark, rows), bench, shard_characters=size), "doc_id", "item_id")
        assert sorted(got) == [(i, i) for i, _ in items[:12]]
    left = contamination.drop_contaminated(documents(spark, rows), bench)
    assert left.columns == documents(spark, rows).columns and left.count() == 1 + len(EDGE)
    assert contamination.contaminated(documents(spark, rows), bench.limit(0)).count() == 0


# --- HTML


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=7), st.data())
def test_minimum_cut(worth, data):
    pairs = list(itertools.combinations(range(len(worth)), 2))
    edges = [(i, j, data.draw(st.integers(0, 6))) for i, j in pairs]
    cost = lambda side: sum((-min(w, 0) if s else max(w, 0)) for w, s in zip(worth, side)) + sum(w for i, j, w in edges if side[i] != side[j])
    assert cost(html.minimum_cut(worth, edges)) == min(map(cost, itertools.product([False, True], repeat=len(worth))))


PAGE = """<html><head><title>T</title></head><body><header><h2>Site</h2><a href=/>Home</a></header>
<div class="cookie-notice">We use cookies to make this site work properly for all our readers.</div>
<div id="content"><h1>Big &amp; title</h1><p>Para <b>one</b>  is here with <a href=x>a link</a> &lt;inside&gt;.</p>
<div class="ad-box">Buy this now, it is a really great product with many features.</div><p>Short.<ul><li>Item one</li></ul>
<script>var x="</p>";</script><form>Name <input> <label>send us your name please</label></form></div>
<section id="comments"><p>I think that this is a really great article, thank you very much for it.</p></section>
<aside>See also other things in the sidebar that are interesting to read.</aside><footer>© 2020</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Big & title\n\nPara one is here with a link <inside>.\n\nShort.\n\nItem one"
    for page in ("", "<", "<!-- x", "<script>x", "<div>" * 3000 + "</p>" * 3000, '<a "' * 3000, "&&;&#xZ;"):
        assert isinstance(html.main_text(page), str)


ARTICLE = "<h1>Big title</h1><p>%s</p><p>%s</p>" % ("The first passage has a lot to say. " * 4, "So does the second one. " * 6)
MAIN = html.main_text(f"<html><body><article>{ARTICLE}</article></body></html>")
NAV = "<nav><a href=/>Home</a> <a href=/b>Other pages of the site</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta name=a><body>{NAV}<article>{ARTICLE}</article></body></html>",
        f"<html><head><title>T</title>{NAV}<article>{ARTICLE}</article></html>",
        f"<head><style>p {{}}</style></head>{NAV}<article>{ARTICLE}</article>",
        f"<body><form action=/ method=post>{NAV}<main>{ARTICLE}</main></form></body>",
        f"<body><form>{NAV}<div>{ARTICLE}</div></form></body>",
        f"<body><form>{NAV}<form><article>{ARTICLE}</article></form></body>",
        f"<body><datalist><option>Red<option>Green <b>one</b> or so</datalist><article>{ARTICLE}</article></body>",
        f"<body><div><span><option>Red</span></div><article>{ARTICLE}</article></body>",
        f"<body><select><option>Red<option>Green</select><article>{ARTICLE}</article></body>",
        f"<body><svg/><article>{ARTICLE}</article><math display=block /></body>",
        f"<body><svg><path d=x /><text>Drawn</text></svg><article>{ARTICLE}</article></body>",
        f"<body><article>{ARTICLE}</article><form><label>Send us your name and your address please</label></form></body>",
    ],
)
def test_main_text_of_other_pages(page):
    assert MAIN.startswith("Big title") and "second" in MAIN
    assert html.main_text(page) == MAIN


def test_main_text_edges(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r["page_id"], r["n_chars"]) for r in got) == Counter({(1, len(html.main_text(PAGE))): 2, (None, 0): 1, (2, 0): 1})


# --- chat


def test_template_language():
    run = lambda source, messages=(), **given: list(compiled(source)(list(messages), **given))
    text = lambda *a, **k: "".join(p for p, _ in run(*a, **k))
    assert text("{% if x == 1 and not y %}a{% elif x > 1 %}b{% else %}c{% endif %}", x=2) == "b"
    assert text("{% for m in messages %}{{ loop.index }}{{ m.t | upper }};{% endfor %}", [{"t": "a"}, {"t": None or "b"}]) == "1A;2B;"
    assert run("x{% generation %}{{ 'y' }}{% endgeneration %}") == [("x", False), ("y", True)]
    assert text("{% set a = 'q' + \"r\" %}{{ (a + 'n\\n') | trim }}{{ none }}{{ 'q' in a }}") == "qrnTrue"
    assert fold(parse("a{{ 'b' + 'c' }}{% if 1 < 2 %}d{% endif %}{% if false and x %}e{% endif %}"), FILTERS) == ("all", [("text", "abcd")])
    for bad in ("{{ a( }}", "{% if x %}", "{% endfor %}", "{{ f() }}", "{{ x.__class__ }}", "{{ 'a }}", "{% for 1 in x %}{% endfor %}", "{{ x | nothing }}"):
        with pytest.raises(TemplateError):
            compiled(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>[ROLE]"]), st.text(alphabet=list("ab\\<>/s[]INSTROLE \n"), max_size=25)), max_size=5))
def test_chat_round_trip(messages):
    render = compiled(chat.TEMPLATE, {"guard": chat.guard})
    turns = list(chat.turns_of(render([{"role": r, "text": t} for r, t in messages])))
    assert [chat.read_turn(c) for c, _ in turns] == messages
    said = [chat.unguard(c[a:b]) for c, spans in turns for a, b in spans]
    assert said == [t for r, t in messages if r == "assistant"]


def test_controls_stand_only_where_the_template_puts_them():
    for control in chat.CONTROLS:
        assert control not in chat.guard(f"a{control}\\{control}b") and chat.unguard(chat.guard(control * 2)) == control * 2


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (None, 0, "assistant", "y"), (1, 0, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", chat.F.lit(1))
    got = {r["conv_id"]: r for r in chat.conversation_digests(frame).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0 and got[None]["loss_sha256"] == hashlib.sha256(b"y").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nx\nuser\n\nuser\n\n").hexdigest()
    chunks = chat.formatted(frame).where("conv_id = 1").orderBy("place").collect()
    assert "".join(c["chunk"] for c in chunks) == "<s>[ROLE][/ROLE]x</s><s>[INST]  [/INST]</s><s>[INST]  [/INST]</s>"
    assert chat.conversation_digests(frame.limit(0)).count() == 0


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://x/{i}\r\nX: y", f"<p>page {i % 7}</p>" * (i % 5 + 1)) for i in range(300)] + [(900, None, None), (901, "u", ""), (None, "u", "zz")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    folder = str(tmp_path / "archives")
    manifest = warc.write_archives(frame, folder, archive_bytes=2_000, learn_from=3_000)
    assert manifest.count() > 2 and manifest.agg({"records": "sum"}).first()[0] == len(pages)
    best = defaultdict(list)
    for i, _, h in pages:
        best[h or ""].append(i if i is not None else -1)
    want = Counter()
    for i, _, h in pages:
        body, top = (h or "").encode(), max(best[h or ""])
        again = i is not None and i < top
        want[(i, len(body), warc.payload_digest(body), "revisit" if again else "response", top if again else None)] += 1
    got = warc.read_archives(manifest, folder)
    assert Counter(tuple(r) for r in got.collect()) == want
    for r in manifest.collect():
        head = open(r["path"], "rb").read(8)
        assert head[:4] == bytes.fromhex("5d2a4d18")
    alone = warc.read_archives(warc.write_archives(frame, folder + "2", smallest=30), folder + "2").where("payload_bytes < 30")
    assert {r["record_type"] for r in alone.collect()} == {"response"}


def test_warc_edges(spark, tmp_path):
    folder = str(tmp_path / "archives")
    schema = "page_id long, url string, html string, path string, records string, payload string"
    pages = [(5, "u", "same"), (5, "v", "same"), (4, "w", "same"), (6, "x", "y" * 30_000_000), (7, "x", None)]
    frame = spark.createDataFrame([(*p, "mine", "mine", "mine") for p in pages], schema)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived(spark, frame).collect())
    assert got == Counter({(5, 4, "response", None): 2, (4, 4, "revisit", 5): 1, (6, 30_000_000, "response", None): 1, (7, 0, "response", None): 1})
    assert warc.archived(spark, frame.limit(0)).count() == 0
    many = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(uuid(), 50) AS html").repartition(2)
    manifest = warc.write_archives(many, folder, archive_bytes=20_000, learn_from=3_000)
    counts = {k: warc.read_archives(manifest, folder, k).rdd.getNumPartitions() for k in (1, 2)}
    assert counts[1] == manifest.count() and counts[2] == -(-manifest.count() // 2)


# --- queries


@pytest.mark.parametrize("name", ["op2_chat_format", "op4_main_text", "op8_exact_dedup", "op9_warc"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    frame = entry.queries()[name](spark, SMALL)
    cursor = db.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == want


def test_pipeline(spark):
    """Each stage against a plain version of it, on the stage's own input."""
    import corpus_pipeline
    from passledger.llm.common import table

    docs = table(spark, SMALL, "documents")
    items = duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()
    held = [" ".join(contamination.words_of(t)) for (t,) in items]
    for (name, stage), number in zip(corpus_pipeline.STAGES, (7, 8, 1, 3, 5)):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        rows = stage(spark, docs, SMALL)
        after = {r["doc_id"] for r in rows.collect()}
        if number == 8:
            assert after == {i for (i, keep, *_) in brute_exact(before) if i == keep}
        elif number == 1:
            assert after == {i for i, _, least in brute_groups(before) if i == least}
        elif number == 3:
            assert after == {i for i, t in before if not any(h in " ".join(contamination.words_of(t)) for h in held)}
        else:
            assert after <= {i for i, _ in before} and len(after) > 0.7 * len(before)
        if number != 5:
            assert rows.columns == docs.columns
            docs = rows.cache()
    assert corpus_pipeline.run(spark, SMALL).count() == len(after)
