"""The numbered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidara.llm import byte_bpe, exact_dedup, fill_middle, filter_audit, html_text, language, licenses, packing, pieces, quality, simhash, token_files, url_filter
from incidara.llm.support import read_table, settle, shared_path


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(read_table(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(read_table(spark, sf_dir, "documents"), width=3, radius=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = language.learn(docs.filter(~language.held_out()))
    rows = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.identify(rows, profiles, keep=["doc_id", "held_out"])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_tokens(read_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.token_digests(spark, path)


#: Rules of the url query: action, host, path.
URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _op5_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    ranked = sorted(URL_RULES, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)
    pick = lambda what: "CASE " + " ".join(f"WHEN {fits(r[1], r[2])} THEN '{what(r)}'" for r in ranked) + " END"
    has = lambda terms: f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}])({terms})([^\\p{{L}}\\p{{N}}]|$)')::INT"
    return f"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), judged AS (
  SELECT *, {pick(lambda r: r[1] + r[2])} AS rule, {pick(lambda r: r[0])} AS action,
         {has("|".join(url_filter.STRICT))} AS strict, {" + ".join(has(t) for t in url_filter.SOFT)} AS soft
  FROM parts
)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN strict > 0 OR soft >= {url_filter.SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("content", 256).alias("decoded_sha256")
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).drop("permissive")


def _op8_sql() -> str:
    """Phrases by joins on words; of tags, those whose expression has no parentheses, exceptions or references (no table has others)."""
    rows = lambda kind, pairs: [f"('{p}', '{kind}', '{label}')" for p, label in pairs]
    phrases = rows("base", licenses.BASE) + rows("notice", (*licenses.NOTICES, *licenses.VERSIONED)) + rows("grant", ((p, "") for p in licenses.GRANTS))
    one = "(?:" + "|".join(re.escape(i) for i in sorted(licenses.IDENTIFIERS, key=len, reverse=True)) + ")(?:\\+|-only|-or-later)?"
    ends = "(?:" + "|".join(map(re.escape, licenses.COMMENT_ENDS)).replace("'", "''") + ")?"
    return rf"""
WITH phrases AS (
  SELECT phrase, kind, label, string_split(phrase, ' ') AS parts FROM (VALUES {", ".join(phrases)}) AS t(phrase, kind, label)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), places AS (
  SELECT r, i, words, words[i] AS word FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM docs)
), found AS (
  SELECT r, i, kind, label, phrase FROM places JOIN phrases ON word = parts[1] AND array_to_string(list_slice(words, i, i + len(parts) - 1), ' ') = phrase
), base AS (
  SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM found WHERE kind = 'base' GROUP BY r
), notices AS (
  SELECT r, list(DISTINCT label) AS labels FROM (SELECT r, arg_max(label, length(phrase)) AS label FROM found WHERE kind = 'notice' GROUP BY r, i) GROUP BY r
), tags AS (
  SELECT r, lower(tag) AS tag FROM (SELECT r, unnest(regexp_extract_all(text, '(?i)spdx-license-identifier:([^\n\r]*)', 1)) AS tag FROM docs)
  WHERE regexp_full_match(lower(tag), '[ \t]*{one}(?:[ \t]+(?:and|or)[ \t]+{one})*[ \t]*{ends}[ \t]*')
), tagged AS (
  SELECT r, list(DISTINCT label) AS labels FROM (
    SELECT r, unnest(list_transform(regexp_extract_all(tag, '{one}'), lambda x: regexp_replace(x, '(\+|-only|-or-later)$', ''))) AS label FROM tags) GROUP BY r
), all_labels AS (
  SELECT docs.*, base.n_base, base.first_word, base.last_word, base.labels AS base_list, tagged.r IS NOT NULL AS parsed,
         list_distinct(list_concat(coalesce(base.labels, []), coalesce(notices.labels, []), coalesce(tagged.labels, []))) AS all_list,
         EXISTS (SELECT 1 FROM found WHERE found.r = docs.r AND kind = 'grant') AS granted
  FROM docs LEFT JOIN base USING (r) LEFT JOIN notices USING (r) LEFT JOIN tagged USING (r)
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base_list), ','), '') AS base_labels, coalesce(array_to_string(list_sort(all_list), ','), '') AS labels,
       (CASE WHEN parsed THEN {licenses.SCORE_EXPRESSION} WHEN granted AND len(all_list) > 0 THEN {licenses.SCORE_GRANT}
             WHEN len(all_list) > 0 THEN {licenses.SCORE_PHRASE} ELSE 0 END)::DOUBLE AS score
FROM all_labels
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = settle(packing.cut(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1))
    return packing.pack(pieces)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS lines,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: translate(trim(regexp_replace(x, '[ \t\v\f\r]+', ' ', 'g')),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda x: x <> '') AS normal
  FROM docs
), windows AS (
  SELECT r, i, list_slice(words, i, i + 4) AS five FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), again AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, five) > 1
), repeats AS (
  SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM again) GROUP BY r
), lines AS (
  SELECT host, text, line, min(i) AS place, arg_min(context, i) AS context, count(*) AS times, len(string_split(line, ' ')) AS n
  FROM (SELECT host, text, i, normal[i] AS line, coalesce(normal[i - 1], '') || chr(10) || coalesce(normal[i + 1], '') AS context
        FROM (SELECT host, text, normal, unnest(range(1, len(normal) + 1)) AS i FROM w))
  GROUP BY host, text, line
), over_limit AS (
  SELECT host, line, count(*) AS texts, count(DISTINCT context) AS contexts FROM lines GROUP BY host, line HAVING count(*) > 20
), flagged AS (
  SELECT l.*, o.texts, o.line IS NULL AS own, sum(l.n * l.times) OVER part AS whole, sum(CASE WHEN o.line IS NULL THEN l.n * l.times ELSE 0 END) OVER part AS own_words,
         last_value(CASE WHEN o.line IS NULL THEN l.line END IGNORE NULLS) OVER (PARTITION BY l.host, l.text ORDER BY place) AS before,
         last_value(CASE WHEN o.line IS NULL THEN l.line END IGNORE NULLS) OVER (PARTITION BY l.host, l.text ORDER BY place DESC) AS after
  FROM lines l LEFT JOIN over_limit o USING (host, line)
  WINDOW part AS (PARTITION BY l.host, l.text)
), boilerplate AS (
  SELECT host, line FROM over_limit WHERE 2 * contexts >= texts
  UNION
  SELECT host, line FROM flagged WHERE NOT own AND 100 * own_words >= 25 * whole
  GROUP BY host, line, texts HAVING 2 * count(DISTINCT coalesce(before, '') || chr(10) || coalesce(after, '')) >= texts
), shared AS (
  SELECT host, text, sum(n)::BIGINT AS n, sum(n * times) AS gone, max(whole) AS whole FROM flagged JOIN boilerplate USING (host, line) GROUP BY host, text
), measured AS (
  SELECT w.doc_id, len(words) AS n_words,
         length(regexp_replace(w.text, '[ \t\n\v\f\r]+', '', 'g')) AS word_chars,
         length(w.text) - length(translate(w.text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(shared.n, 0) AS shared_words, coalesce(100 * (whole - gone) < 25 * whole, false) AS depleted
  FROM w LEFT JOIN repeats USING (r) LEFT JOIN shared ON shared.host = w.host AND shared.text = w.text
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT depleted AS kept, shared_words
FROM failed
"""


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.restore(fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS seed
  FROM documents
), seeded AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || seed[1:8])::BIGINT AS h1, ('0x' || seed[9:16])::BIGINT AS h2,
         ('0x' || seed[17:24])::BIGINT AS h3, ('0x' || seed[25:32])::BIGINT AS h4
  FROM docs
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM seeded
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.replay(filter_audit.failures(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words
  FROM documents
), known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), firsts AS (
  SELECT text, min(doc_id) AS doc_id FROM docs GROUP BY text
), failed AS (
  SELECT d.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic,
         MAP {'A': len(d.words) < 200, 'B': 100 * len(list_distinct(d.words)) < 50 * len(d.words),
              'C': 100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 2 * length(d.text),
              'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(f.doc_id < d.doc_id, false)} AS fails
  FROM docs d JOIN firsts f USING (text) LEFT JOIN known k ON k.doc_id = d.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l) JOIN letters d ON d.l NOT IN (a.l, b.l, c.l)
  JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), replayed AS (
  SELECT *, list_position(list_transform(string_split(filter_order, ''), lambda x: fails[x]), true) AS hit,
         len(list_filter(map_values(fails), lambda x: x)) AS n_fails
  FROM failed CROSS JOIN orders
), steps AS (
  SELECT *, coalesce(nullif(hit, 0), 6) AS first, filter_order[step] AS letter FROM replayed CROSS JOIN (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, step::INT AS step, letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
         count(*) FILTER (fails[letter] AND first < step) AS redundant, count(*) FILTER (fails[letter] AND n_fails = 1) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, letter
)
SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM counted
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_language_id": op3_language_id,
        "op4_token_files": op4_token_files,
        "op5_url_filter": op5_url_filter,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_html_text": op7_html_text,
        "op8_license_scan": op8_license_scan,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_quality_rules": op10_quality_rules,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_url_filter": _op5_sql(), "op8_license_scan": _op8_sql(), "op10_quality_rules": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_filter_audit": OP13_SQL}
