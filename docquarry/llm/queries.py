"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.common import table


def op1_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.chat_hmm import chat_digest

    return chat_digest(table(spark, sf_dir, "conversations"))


#: Rules of the registered query on pages.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op2_url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.url_links import judge

    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.simhash_golay import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.line_bitmaps import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from docquarry.llm.token_store import token_digest

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_langid_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.langid_hd import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_suffix_bcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.suffix_bcr import repeats_digest

    return repeats_digest(table(spark, sf_dir, "documents"))


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.media_jpeg import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.decontam import contamination_digest

    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from docquarry.llm.bpe_stream import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.html_blocks import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.bag_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.vector_codes import codes_digest

    return codes_digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_hmm, op2_url_links, op3_simhash_golay, op4_line_bitmaps, op5_token_store, op6_langid_hyperdimensional, op7_suffix_bcr, op8_progressive_jpeg, op9_decontaminate,
        op10_bpe_transducer, op11_html_blocks, op12_bag_search, op13_vector_codes,
    )
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Product codes: each round a nearest entry for each part, then the entries' new components."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT p.r, p.part, any_value(p.v) AS v, min(CAST(p.norm - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) * {entries} + c.entry) AS best
  FROM p JOIN c{r} c ON p.part = c.part GROUP BY p.r, p.part)"""
    moved = """
c{n} AS MATERIALIZED (
  WITH s AS (
    SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS DOUBLE) AS x
    FROM (SELECT part, best % {entries} AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL),
  m AS (SELECT part, entry, list(x ORDER BY i) AS v FROM s GROUP BY ALL)
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m ON c.part = m.part AND c.entry = m.entry)"""
    steps = [nearest.format(r=0, entries=entries)]
    for r in range(rounds):
        steps += [moved.format(r=r, n=r + 1, entries=entries), nearest.format(r=r + 1, entries=entries)]
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding, len(embedding) // {parts} AS d
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT *, list_inner_product(v, v) AS norm
  FROM (SELECT r, part, list_transform(embedding[part * d + 1 : (part + 1) * d], lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM k, range({parts}) t(part))),
c0 AS (SELECT part, r AS entry, v FROM p WHERE r < {entries}),{",".join(steps)},
e AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c{rounds}))
SELECT k.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN e USING (r), h
"""


ORACLE_SQL: dict[str, str] = {
    "op2_url_links": rf"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
rules(h, q, say) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (
  SELECT page_id, host, path, html,
         (SELECT max_by(h || q, length(h || q)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
         (SELECT max_by(say, length(h || q)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS said
  FROM p),
s AS (
  SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN said = 'block' THEN 1.0 ELSE 0.0 END) AS distrust
  FROM j WHERE host <> '' GROUP BY host),
l AS (
  SELECT host AS src, translate(d, '{_UP}', '{_LOW}') AS dst
  FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1))) AS d FROM j WHERE host <> '')),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY ALL),
f AS (
  SELECT 0 AS kind, src AS host, dst AS too, 0.85 * n / sum(n) OVER (PARTITION BY src) AS share FROM e
  UNION ALL SELECT 1, dst, src, 0.85 * n / sum(n) OVER (PARTITION BY src) FROM e),
r AS (
  SELECT 0 AS step, 0 AS kind, host, trust AS mass FROM s UNION ALL SELECT 0, 1, host, distrust FROM s
  UNION ALL
  SELECT any_value(r.step) + 1, r.kind, f.too, sum(r.mass * f.share) FROM r JOIN f ON r.kind = f.kind AND r.host = f.host
  WHERE r.mass > 1e-12 GROUP BY r.kind, f.too),
g AS (
  SELECT host, coalesce(sum(mass) FILTER (kind = 0), 0) AS trust, coalesce(sum(mass) FILTER (kind = 1), 0) AS distrust FROM r GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.said, CASE WHEN g.distrust >= 0.5 - 1e-7 AND g.distrust > g.trust + 1e-7 THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN g ON j.host = g.host
""",
    "op4_line_bitmaps": rf"""
WITH l AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
k AS (SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL AND k.doc_id <> c.top) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (c.key IS NULL OR k.doc_id = c.top), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.r
""",
    "op9_decontaminate": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, grams.n AS n FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op12_bag_search": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
t AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM b) GROUP BY ALL),
v AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
c AS (SELECT r, doc_id, term, v.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS part FROM t JOIN v USING (term), s),
x AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM c JOIN b USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 10
""",
    "op13_vector_codes": _codes_sql(),
}
