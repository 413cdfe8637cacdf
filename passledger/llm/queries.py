"""Registered queries of the text operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passledger.llm import bpe, chat, collocations, contamination, exact, html, language, licences, quality, resampling, simhash, toxicity, warc
from passledger.llm.common import learnable, remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def held_out(docs: DataFrame, divisor: int, out: int) -> DataFrame:
    return docs.select("doc_id", (remainder("doc_id", divisor) == out).alias("held_out"), "text")


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return register


@query(
    "op8_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
    g AS (SELECT body, count(*) AS group_size,
                 arg_min(doc_id, {'c': -chars, 'd': doc_id}) AS keep_id FROM n GROUP BY body)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
    FROM n JOIN g USING (body)
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.tokenized(table(spark, folder, "documents").select("doc_id", "text"), bpe.public_ranks(), bpe.public_pattern())
    return rows.select("doc_id", *bpe.digests(rows))


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    names, models = language.learned(docs.where(remainder("doc_id", 3) != 1))
    return language.predicted(held_out(docs, 3, 1), names, models).drop("text")


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.learned(docs, learnable(table(spark, folder, "labels"), "quality", 5, 0))
    return quality.scored(held_out(docs, 5, 0), model).drop("text")


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learned(docs, learnable(table(spark, folder, "labels"), "toxic", 4, 2))
    return quality.scored(held_out(docs, 4, 2), model).drop("text")


@query(
    "op9_warc",
    r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, strlen(body) AS payload_bytes,
                 list_aggregate(list_transform(string_split(sha1(body), ''),
                     lambda h: right('000' || bin(instr('0123456789abcdef', h) - 1), 4)), 'string_agg', '') AS bits,
                 max(page_id) OVER (PARTITION BY body) AS first_id FROM p)
    SELECT page_id, payload_bytes,
           list_aggregate(list_transform(range(32),
               lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, CAST(i * 5 + k + 1 AS INT), 1) AS INT) * CAST(pow(2, 4 - k) AS INT)))::INT, 1)),
               'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id < first_id THEN first_id END AS refers_to
    FROM d
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(spark, table(spark, folder, "pages"))


@query(
    "op2_chat_format",
    r"""
    WITH m AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
    g AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
                    + length(regexp_replace(text, '<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]', '\0#', 'g')) - length(text) AS guarded,
                 length(role) + length(role) - length(replace(role, '\', ''))
                    + length(regexp_replace(role, '<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]', '\0#', 'g')) - length(role) AS guarded_role
          FROM m)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
           CAST(sum(7 + guarded + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 0 ELSE 13 + guarded_role END) AS BIGINT) AS formatted_chars
    FROM g GROUP BY conv_id
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(rows.unionByName(chat.hostile(spark)))


@query("op1_simhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query(
    "op4_main_text",
    r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
    b AS (SELECT page_id, url, list_transform(
              string_split(regexp_replace(regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(h1|p)>', chr(1), 'g'), chr(1)),
              lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x,
                  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a),
    c AS (SELECT page_id, url, coalesce(list_aggregate(list_filter(parts, lambda x: x <> ''), 'string_agg', chr(10) || chr(10)), '') AS text FROM b)
    SELECT page_id, url, text, length(text) AS n_chars FROM c
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html.extracted(pages, html.learned(pages))


@query("op3_decontaminate")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op11_resampling",
    r"""
    WITH tab AS (
        SELECT list(c ORDER BY i) AS crc FROM (
            SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
    w AS (SELECT doc_id, unnest(words) AS word FROM d),
    f AS (SELECT word, xor(list_reduce(list_transform(range(CAST(length(hex(word)) / 2 AS BIGINT)),
                     lambda i: CAST('0x' || substr(hex(word), CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
                 lambda c, x: xor(c >> 8, crc[CAST(xor(c, x) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
          FROM (SELECT word FROM w UNION SELECT word FROM b), tab),
    s AS (SELECT bucket, count(*) AS s FROM w JOIN f USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM b JOIN f USING (word) GROUP BY bucket),
    g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)
                     / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS gain
          FROM (SELECT DISTINCT bucket FROM f) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    k AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN f USING (word) JOIN g USING (bucket) GROUP BY doc_id),
    r AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
          FROM d LEFT JOIN k USING (doc_id)),
    o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN place <= (SELECT count(*) FROM o) * 10 // 100 THEN place END AS rank
    FROM r LEFT JOIN o USING (doc_id)
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.drawn(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_licences")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_digests(table(spark, folder, "documents"))


@query(
    "op13_collocations",
    r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
    i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
    g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM i, range(1, 6) r(k) WHERE i + k - 1 <= len(ws)),
    f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, k, phrase, n AS a FROM f WHERE k > 1),
    kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a
                 AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
    cut AS (SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS one,
                   array_to_string(string_split(phrase, ' ')[j + 1 : ], ' ') AS two
            FROM kept, range(1, 5) r(j) WHERE j < k),
    s AS (SELECT cut.lang, cut.phrase, a, j, x.n AS l, y.n AS r, t.n,
                 CAST(1000::HUGEINT * a * t.n // (x.n::HUGEINT * y.n) AS BIGINT) AS score
          FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = two JOIN t ON t.lang = cut.lang),
    m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM s),
    o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m WHERE place = 1)
    SELECT * FROM o WHERE rank <= 2000
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents").select("lang", "text"))
