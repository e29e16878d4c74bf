"""DuckDB SQL of the registered queries: the same results by plain, sequential or set-based rules."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

_LINES = r"list_filter([trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR x IN regexp_split_to_array({0}, '\r\n|[\n\r\x0b\f]')], lambda x: x <> '')"
_NORM = r"replace(lower(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '\s+([A-F]?\d{{1,3}})$', '')), 'ß', 'ss')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_EST = "CAST(trunc(len({0}) * CAST(1.3 AS DOUBLE)) AS BIGINT) + 1"
_HEADS = r"({0} <> '' AND NOT regexp_matches({0}, '^\d{{1,3}}$') AND len(" + _WORDS + r") <= 10 AND right({0}, 1) NOT IN ('.', ';', ',', ':'))"
_BOILER = r"(regexp_matches({0}, '(?i)^SECTION\s+[A-F]:') OR regexp_matches({0}, '(?i)^\d{{4}}\s+Formula\s+1') OR contains({0}, 'Fédération Internationale de l') OR contains({0}, 'Federation Internationale de l') OR regexp_matches({0}, '(?i)^\s*Issue\s+\d+\s*[A-F]?\d*\s*$') OR regexp_matches({0}, '^\d+\s+[A-F]$') OR regexp_matches({0}, '^[A-F]\d{{1,3}}$'))"

_K = "o_orderkey"
_ORDER_PAGES = rf"""op AS (SELECT 'cust-' || o_custkey AS source_filename, {_K} AS page,
  CASE WHEN {_K} % 5 = 0 THEN 'Contents' || chr(10) || 'A1' || chr(10) || ({_K} % 90) WHEN {_K} % 5 = 1 THEN array_to_string(['1','2','3','A2','4','5'], chr(10))
       WHEN {_K} % 5 = 2 THEN 'A1.1.1 text' ELSE 'x' || chr(10) || 'A' || ({_K} % 300) || chr(10) || 'rest' END AS raw_text FROM orders)"""
_SIGNAL = r"(regexp_matches(raw_text, '(?im)^\s*CONTENTS') OR len(list_filter(" + _LINES.format("raw_text") + r", lambda x: regexp_matches(x, '^\d{1,3}$'))) >= 5)"
_LABEL = "list_filter((" + _LINES.format("raw_text") + r")[1:12], lambda x: regexp_matches(x, '^[A-F]\d{1,3}$'))[1]"
_START = f"bs AS (SELECT source_filename, coalesce(min(page) FILTER (regexp_matches(raw_text, '(?m)^\\s*[A-F]\\d+\\.\\d+\\.\\d+\\b')), 1) AS body_start FROM op GROUP BY 1)"
_LETTER = f"substr('ABCDEF', CAST({_K} % 6 + 1 AS INT), 1)"
_ORDER_LINES = rf"""ol AS (SELECT 'cust-' || o_custkey AS source_filename, {_K} AS page,
  CASE WHEN {_K} % 11 = 0 THEN 'ARTICLE ' || {_LETTER} || ({_K} % 9 + 1) || ':' WHEN {_K} % 11 = 1 THEN 'ARTICLE ' || {_LETTER} || ({_K} % 9 + 1) || ': TITLE ' || ({_K} % 9 + 1)
       WHEN {_K} % 11 < 5 THEN {_LETTER} || ({_K} % 9 + 1) || '.' || ({_K} % 4 + 1) WHEN {_K} % 11 = 5 THEN 'Governance: part ' || ({_K} % 9 + 1) WHEN {_K} % 11 = 6 THEN '17'
       WHEN {_K} % 11 < 9 THEN 'Overview of part ' || ({_K} % 9 + 1) ELSE 'The body of part ' || ({_K} % 9 + 1) || ' says that ' || o_orderpriority || '.' END AS line FROM orders),
ls AS (SELECT source_filename, page, line, row_number() OVER (PARTITION BY source_filename ORDER BY page) AS seq FROM ol)"""
_KIND = r"CASE WHEN regexp_matches(line, '^ARTICLE\s+([A-F]\d+)\s*:\s*(.*)$') THEN 'article' WHEN regexp_matches(line, '^([A-F]\d+(?:\.\d+)+)\s*$') THEN 'number' WHEN regexp_matches(line, '(?i)^(Advisory Committee|Governance)\s*:') THEN 'annotation' ELSE 'body' END"

O = ORACLE_SQL
O["normalize_date"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders"
O["front_matter"] = f"""SELECT {_K}, CASE WHEN {_K} % 3 > 0 THEN {_K} % 50 END AS issue_number,
  CASE WHEN {_K} % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN {_K} % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS publication_date,
  CASE WHEN {_K} % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS wmsc_approval_date FROM orders"""
O["front_matter"] = f"""WITH t AS (SELECT {_K}, (CASE WHEN {_K} % 3 > 0 THEN 'Issue ' || ({_K} % 50) ELSE '' END) || (CASE WHEN {_K} % 4 > 0 THEN chr(10) || 'Date: ' || strftime(o_orderdate, '%d/%m/%Y') ELSE '' END)
  || (CASE WHEN {_K} % 5 > 0 THEN chr(10) || 'WMSC approval date: ' || strftime(o_orderdate, '%d/%m/%Y') ELSE '' END) AS t FROM orders),
x AS (SELECT {_K}, nullif(regexp_extract(t, '(?i)Issue\\s+(\\d+)', 1), '') AS i, nullif(regexp_extract(t, '(?i)Date:\\s*(\\d{{2}}/\\d{{2}}/\\d{{4}})', 1), '') AS d, nullif(regexp_extract(t, '(?i)WMSC approval date:\\s*(\\d{{2}}/\\d{{2}}/\\d{{4}})', 1), '') AS w FROM t)
SELECT {_K}, CAST(i AS BIGINT) AS issue_number, d[7:10] || '-' || d[4:5] || '-' || d[1:2] AS publication_date, w[7:10] || '-' || w[4:5] || '-' || w[1:2] AS wmsc_approval_date FROM x"""
O["detect_section"] = f"""WITH s AS (SELECT {_K}, CASE WHEN {_K} % 3 = 0 THEN {_LETTER} WHEN {_K} % 3 = 1 THEN 'D' END AS section FROM orders)
SELECT {_K}, section, CASE WHEN {_K} % 3 < 2 THEN 'SECTION D: GENERAL' WHEN section IS NOT NULL THEN 'SECTION ' || section END AS title FROM s"""
O["page_label"] = f"WITH {_ORDER_PAGES} SELECT page, {_LABEL} AS page_label FROM op"
O["corpus_hash"] = "SELECT CAST(floor(doc_id / 64) AS BIGINT) AS volume, substr(sha1(string_agg('doc-' || doc_id || n_chars, '' ORDER BY 'doc-' || doc_id)), 1, 16) AS corpus_hash FROM documents GROUP BY 1"
O["index_roundtrip"] = "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS BIGINT) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings"
O["jsonl_roundtrip"] = "SELECT * FROM conversations"
_DOC_LINES = f"dl AS (SELECT doc_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS pos FROM (SELECT doc_id, {_LINES.format('text')} AS ls FROM documents))"
O["normalize_line"] = f"WITH {_DOC_LINES} SELECT doc_id, pos, {_NORM.format('line')} AS norm FROM dl"
O["heading_like"] = f"WITH {_DOC_LINES} SELECT doc_id, pos, {_HEADS.format('line')} AS heading_like FROM dl"
O["band_filter"] = """WITH b AS (SELECT l_returnflag, l_linestatus, l_quantity * 16 AS y0, l_quantity * 16 + l_linenumber * 8 AS y1, l_linenumber = 7 AS flat FROM lineitem)
SELECT l_returnflag, l_linestatus, NOT flat AND (y0 / 800 <= 0.1 OR y1 / 800 >= 0.9) AS in_band, count(*) AS n FROM b GROUP BY ALL"""
_VOL = f"""pg AS (SELECT 'vol-' || CAST(floor(doc_id / 64) AS BIGINT) AS source_filename, doc_id % 64 + 1 AS page, text, string_split(text, chr(10)) AS ls FROM documents),
bk AS (SELECT source_filename, page, unnest(ls) AS b, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM pg),
bl AS (SELECT source_filename, page, unnest({_LINES.format('b')}) AS line FROM bk WHERE (i * CAST(800 AS DOUBLE) / n) / 800 <= 0.1 OR ((i + 1) * CAST(800 AS DOUBLE) / n) / 800 >= 0.9),
ct AS (SELECT source_filename, {_NORM.format('line')} AS norm, count(DISTINCT page) AS n_pages FROM bl GROUP BY 1, 2),
rl AS (SELECT ct.* FROM ct JOIN (SELECT source_filename, greatest(2, CAST(trunc(count(*) * CAST(0.05 AS DOUBLE)) AS INT)) AS least_ FROM pg GROUP BY 1) USING (source_filename) WHERE length(norm) >= 6 AND n_pages >= least_),
al AS (SELECT source_filename, page, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS pos, unnest(x) AS line FROM (SELECT source_filename, page, {_LINES.format('text')} AS x FROM pg)),
sb AS (SELECT al.*, (rl.norm IS NOT NULL OR {_BOILER.format('line')}) AS removed FROM al LEFT JOIN rl ON al.source_filename = rl.source_filename AND rl.norm = {_NORM.format('line')})"""
O["recurring_lines"] = f"WITH {_VOL} SELECT source_filename, norm, n_pages FROM rl"
O["strip_boilerplate"] = f"WITH {_VOL} SELECT source_filename, page, pos, removed FROM sb"
O["clean_document"] = f"""WITH {_VOL},
op AS (SELECT source_filename, page, text AS raw_text FROM pg), {_START},
tx AS (SELECT source_filename, page, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '') AS t, count(*) FILTER (removed) AS n_removed FROM sb GROUP BY 1, 2)
SELECT op.source_filename, op.page, {_LABEL} AS page_label, sha1(coalesce(t, '')) AS text_sha1, page < body_start AND {_SIGNAL} AS is_toc, coalesce(n_removed, 0) AS n_removed
FROM op JOIN bs USING (source_filename) LEFT JOIN tx USING (source_filename, page)"""
O["toc_signal"] = f"WITH {_ORDER_PAGES} SELECT page, {_SIGNAL} AS signal FROM op"
O["body_start"] = f"WITH {_ORDER_PAGES}, {_START} SELECT * FROM bs"
O["toc_pages"] = f"WITH {_ORDER_PAGES}, {_START} SELECT source_filename, page, page < body_start AND {_SIGNAL} AS is_toc FROM op JOIN bs USING (source_filename)"
O["table_pages"] = """WITH c AS (SELECT l_orderkey % 2000 AS page, floor(l_quantity * 3 / 40) AS c, floor((l_extendedprice % 120) / 12) AS r FROM lineitem),
r AS (SELECT page, r, count(*) AS n, count(DISTINCT c) AS k FROM c GROUP BY 1, 2)
SELECT 'lineitem' AS source_filename, page, sum(n) >= 8 AND count(*) FILTER (k >= 2) >= 4 AS has_table FROM r GROUP BY page"""
O["equation_pages"] = r"""WITH m AS (SELECT page_id, length(regexp_replace(html, '[^=≤≥±×÷√∑∫∂∞≈≠→←°µΩπλ]', '', 'g')) AS s, len(regexp_extract_all(html, '\b\w\^?-?\d\b')) AS p FROM pages)
SELECT page_id, s >= 3 OR (s >= 1 AND p >= 3) AS has_equation FROM m"""
O["visual_kinds"] = """WITH g AS (SELECT l_orderkey, max(l_extendedprice / 1e6) >= 0.03 AS i, sum(l_quantity) AS p, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN i THEN 'image' END, CASE WHEN p >= 40 THEN 'diagram' END, CASE WHEN p >= 40 THEN 'drawing' END, CASE WHEN n > 3 THEN 'table' END, CASE WHEN p % 2 = 1 THEN 'equation' END], lambda x: x IS NOT NULL), ',') AS kinds FROM g"""
O["line_stream"] = f"WITH {_ORDER_LINES} SELECT source_filename, seq, line, page FROM ls"
O["parent_of"] = f"""WITH n AS (SELECT {_K}, 'A' || {_K} || CASE WHEN {_K} % 3 > 0 THEN '.' || ({_K} % 7) ELSE '' END || CASE WHEN {_K} % 3 > 1 THEN '.12' ELSE '' END AS number FROM orders)
SELECT {_K}, number, CASE {_K} % 3 WHEN 1 THEN 'A' || {_K} WHEN 2 THEN 'A' || {_K} || '.' || ({_K} % 7) END AS parent FROM n"""
O["classify_lines"] = f"WITH {_ORDER_LINES} SELECT page, {_KIND} AS kind FROM ol"
_PARSE = rf"""{_ORDER_LINES},
k AS (SELECT ls.*, {_KIND.replace('(line', '(ls.line')} AS kind, nx.line AS nxt, CASE WHEN nx.line IS NULL THEN false ELSE {_HEADS.format('nx.line')} END AS nh
      FROM (SELECT * FROM ls) ls LEFT JOIN (SELECT source_filename AS f, seq - 1 AS s, line FROM ls) nx ON ls.source_filename = nx.f AND ls.seq = nx.s),
step AS (
  SELECT source_filename, CAST(1 AS BIGINT) AS seq FROM ls WHERE seq = 1
  UNION ALL
  SELECT k.source_filename, k.seq + CASE WHEN k.kind = 'number' OR (k.kind = 'article' AND trim(regexp_extract(k.line, '^ARTICLE\s+([A-F]\d+)\s*:\s*(.*)$', 2)) = '' AND k.nh) THEN 2 ELSE 1 END
  FROM step JOIN k ON step.source_filename = k.source_filename AND step.seq = k.seq),
p AS (SELECT k.* FROM k JOIN step USING (source_filename, seq)),
q AS (SELECT *, kind IN ('article', 'number') AS starts,
        CASE WHEN kind = 'article' THEN coalesce(nullif(trim(regexp_extract(line, '^ARTICLE\s+([A-F]\d+)\s*:\s*(.*)$', 2)), ''), CASE WHEN nh THEN nxt END) WHEN kind = 'number' AND nh THEN nxt END AS title FROM p),
r AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER w AS record, last_value(title IGNORE NULLS) OVER w AS last_title FROM q WINDOW w AS (PARTITION BY source_filename ORDER BY seq ROWS UNBOUNDED PRECEDING)),
pa AS (SELECT source_filename, CAST(record AS BIGINT) AS article_seq,
        max(CASE WHEN starts THEN coalesce(nullif(regexp_extract(line, '^ARTICLE\s+([A-F]\d+)\s*:\s*(.*)$', 1), ''), line) END) AS article_number,
        max(CASE WHEN starts THEN CASE WHEN kind = 'number' AND NOT nh THEN last_title ELSE title END END) AS heading,
        coalesce(string_agg(CASE WHEN kind = 'number' AND NOT nh THEN nxt WHEN kind = 'body' THEN line END, chr(10) ORDER BY seq), '') AS text, max(CASE WHEN starts THEN page END) AS page
       FROM r WHERE record > 0 GROUP BY 1, 2 HAVING text <> '' OR coalesce(heading, '') <> '')"""
O["parse_articles"] = f"WITH RECURSIVE {_PARSE} SELECT source_filename, article_seq, article_number, CASE WHEN contains(article_number, '.') THEN regexp_replace(article_number, '\\.[^.]*$', '') END AS parent_article, heading, text, page FROM pa"
O["token_estimate"] = f"SELECT doc_id, {_EST.format(_WORDS.format('text'))} AS token_estimate FROM documents"


def _windows(most: int, step: int) -> str:
    return f"""wd AS (SELECT doc_id, lang, text, {_WORDS.format('text')} AS w FROM documents),
ch AS (SELECT doc_id, lang, text AS whole, CAST(0 AS BIGINT) AS chunk_index, text FROM wd WHERE len(w) BETWEEN 1 AND {most}
  UNION ALL SELECT doc_id, lang, text, i, array_to_string(w[i * {step} + 1 : i * {step} + {most}], ' ') FROM (SELECT *, unnest(generate_series(0, (len(w) - 1) // {step})) AS i FROM wd WHERE len(w) > {most}))"""


_CH = _windows(269, 223)
O["chunk_windows"] = f"WITH {_windows(100, 80)} SELECT doc_id, chunk_index, sha1(text) AS piece_sha1 FROM ch"
O["chunk_regulation"] = f"""WITH {_CH} SELECT substr(sha1('doc-' || doc_id || '|A' || doc_id || '|' || chunk_index), 1, 16) AS chunk_id, 'doc-' || doc_id AS source_filename, lang AS section, 'A' || doc_id AS article_number, chunk_index,
  sha1(text) AS text_sha1, {_EST.format(_WORDS.format('text'))} AS token_estimate, 'Art. A' || doc_id || ' (Section ' || lang || ', pdf p.1)' AS label FROM ch"""
O["chunk_offsets"] = f"""WITH RECURSIVE {_CH},
st AS (SELECT doc_id, whole, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM ch WHERE chunk_index = 0
  UNION ALL
  SELECT doc_id, whole, i, greatest(cur, a + n - 1), a, a + n FROM (
    SELECT st.doc_id, st.whole, st.i + 1 AS i, st.cur, length(ch.text) AS n, CASE WHEN position(ch.text[1:40] IN substr(st.whole, st.cur + 1)) > 0 THEN st.cur + position(ch.text[1:40] IN substr(st.whole, st.cur + 1)) - 1 ELSE st.cur END AS a
    FROM st JOIN ch ON st.doc_id = ch.doc_id AND ch.chunk_index = st.i + 1))
SELECT 'doc-' || doc_id AS source_filename, i AS chunk_index, a AS char_start, b AS char_end FROM st WHERE i >= 0"""
O["chunk_fixed_window"] = f"""WITH w AS (SELECT CAST(floor(doc_id / 16) AS BIGINT) AS v, doc_id, unnest({_WORDS.format('text')}) AS x, generate_subscripts({_WORDS.format('text')}, 1) AS i FROM documents),
n AS (SELECT v, doc_id, x, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) - 1 AS p FROM w),
e AS (SELECT v, doc_id, x, p, unnest(generate_series(greatest(0, (p - 269) // 223), p // 223)) AS k FROM n),
c AS (SELECT v, k, arg_min(doc_id, p) AS d, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS m FROM e WHERE p >= k * 223 AND p < k * 223 + 269 GROUP BY 1, 2)
SELECT substr(sha1('vol-' || v || '|fw:A' || d || '|' || k), 1, 16) AS chunk_id, 'vol-' || v AS source_filename, 'A' || d AS article_number, k AS chunk_index, sha1(t) AS text_sha1, CAST(trunc(m * CAST(1.3 AS DOUBLE)) AS BIGINT) + 1 AS token_estimate FROM c"""
O["chunk_id"] = "SELECT conv_id, turn, substr(sha1('conv-' || conv_id || '|' || coalesce(role, '') || '|' || turn), 1, 16) AS chunk_id, 'Art. ' || coalesce(role, '') || ' (Section A, pdf p.' || turn || ')' AS label FROM conversations"
O["l2_normalize"] = """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) * 3 FOR x IN embedding] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS s FROM v)
SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS BIGINT) AS i, round(unnest(e) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) + CAST(0 AS DOUBLE) AS x FROM n"""


def _cells(source: str, key: str, text: str, dim: int, name: str) -> str:
    return f"""{name}t AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {source}),
{name} AS (SELECT id, ('0x' || md5(t)[1:2])::INT % {dim} AS bucket, CAST(sum(CASE WHEN md5(t)[15:15] IN ('8','9','a','b','c','d','e','f') THEN 1 ELSE -1 END) AS BIGINT) AS value FROM {name}t GROUP BY 1, 2 HAVING value <> 0)"""


O["hash_embed"] = f"WITH {_cells('documents', 'doc_id', 'text', 256, 'c')} SELECT id AS doc_id, CAST(bucket AS BIGINT) AS bucket, value FROM c"
O["metadata_filter"] = "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source = 'src3'"


def _nearest(where: str) -> str:
    return f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS s
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) - 1 AS rank FROM p)
SELECT query_id, vec_id, round(s, 4) AS similarity, rank FROM r WHERE rank < 8"""


O["vector_topk"] = _nearest("true")
# exact top-k: every neighbour of these tables is found
O["vector_topk_quantised"] = O["vector_topk_graph"] = O["vector_topk"]
O["vector_topk_filtered"] = _nearest("v.label IN (1, 2, 3)")
O["vector_topk_graph_filtered"] = O["vector_topk_filtered"]
O["normalize_query"] = f"SELECT conv_id, turn, {_SQUEEZE.format('text')} AS query FROM conversations"
O["tokenize"] = "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS BIGINT) AS n, sha1(array_to_string(regexp_extract_all(lower(text), '[A-Za-z0-9]+'), ' ')) AS tokens_sha1 FROM documents"
_BM = f"""{_CH},
tk AS (SELECT doc_id * 1048576 + chunk_index AS vec_id, lang, CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) = 0 THEN [chr(1)] ELSE regexp_extract_all(lower(text), '[a-z0-9]+') END AS t FROM ch),
po AS (SELECT vec_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT vec_id, unnest(t) AS term, len(t) AS n FROM tk) GROUP BY 1, 2),
sz AS (SELECT count(*) AS n_docs, sum(len(t)) / count(*) AS avgdl FROM tk),
ra AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM po GROUP BY 1), sz),
tm AS (SELECT term, df, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(raw) FROM ra) ELSE raw END AS idf FROM ra),
qs AS (SELECT item_id AS query_id, {_SQUEEZE.format('text')} AS query FROM benchmark),
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM qs),
hs AS (SELECT query_id, vec_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avgdl))) AS s FROM qt JOIN tm USING (term) JOIN po USING (term), sz GROUP BY 1, 2)"""


def _bm25(k: int, where: str = "true") -> str:
    return f"""{_BM},
bf AS (SELECT query_id, tk.vec_id, round(coalesce(s, 0), 6) AS score FROM qs CROSS JOIN tk LEFT JOIN hs USING (query_id, vec_id) WHERE {where}),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM bf QUALIFY rank < {k})"""


_VEC = f"""{_cells("(SELECT doc_id * 1048576 + chunk_index AS vec_id, text FROM ch)", "vec_id", "text", 64, "vc")},
{_cells("qs", "query_id", "query", 64, "qc")},
vn AS (SELECT id, sqrt(sum(value * value)) AS n FROM vc GROUP BY 1), qn AS (SELECT id, sqrt(sum(value * value)) AS n FROM qc GROUP BY 1),
dp AS (SELECT qc.id AS query_id, vc.id AS vec_id, sum(qc.value * vc.value) AS s FROM qc JOIN vc USING (bucket) GROUP BY 1, 2),
vf AS (SELECT query_id, tk.vec_id, round(coalesce(s / (vn.n * qn.n), 0), 6) AS similarity FROM qs CROSS JOIN tk LEFT JOIN dp USING (query_id, vec_id) LEFT JOIN vn ON vn.id = tk.vec_id LEFT JOIN qn ON qn.id = qs.query_id)"""


def _vec(k: int) -> str:
    return f"{_VEC}, vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) - 1 AS rank FROM vf QUALIFY rank < {k})"


O["evaluate_run"] = f"""WITH {_BM},
bf AS (SELECT query_id, vec_id, vec_id // 1048576 AS doc_id, round(coalesce(s, 0), 6) AS score FROM qs CROSS JOIN tk LEFT JOIN hs USING (query_id, vec_id)),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'doc-' || doc_id, vec_id) - 1 AS rank FROM bf QUALIFY rank < 8),
g AS (SELECT DISTINCT query_id, doc_id FROM qs JOIN (SELECT doc_id, {_SQUEEZE.format('text')} AS body FROM documents) ON query <> '' AND contains(body, query)),
e AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT query_id, count(DISTINCT doc_id) AS found, min(rank) AS top FROM g JOIN br USING (query_id, doc_id) GROUP BY 1),
a AS (SELECT e.n IS NOT NULL AS held, coalesce(found, 0)::DOUBLE / n AS recall, coalesce(1::DOUBLE / (top + 1), 0) AS rr, CASE WHEN top IS NULL THEN 0 ELSE 1 END AS hit FROM qs LEFT JOIN e USING (query_id) LEFT JOIN h USING (query_id))
SELECT count(*) AS n_cases, count(*) FILTER (held) AS n_answerable, round(coalesce(avg(recall) FILTER (held), 0), 4) AS recall_at_k, round(coalesce(avg(rr) FILTER (held), 0), 4) AS mrr,
  round(coalesce(avg(hit) FILTER (held), 0), 4) AS article_hit_rate, 0::DOUBLE AS citation_accuracy, 0::DOUBLE AS unsupported_claim_rate, round(coalesce(avg(CASE WHEN held THEN 1 ELSE 0 END), 0), 4) AS unanswerable_handling,
  0::DOUBLE AS answer_term_coverage, 8 AS k FROM a"""
O["retrieve_bm25_stored"] = f"WITH {_bm25(8)} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM br"
O["retrieve_bm25_stored_filtered"] = f"WITH {_bm25(8, 'tk.lang = ' + chr(39) + 'fr' + chr(39))} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM br"
_scaled = lambda x: f"CASE WHEN max({x}) OVER w - min({x}) OVER w < 1e-12 THEN 0 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"
O["evaluate_matrix"] = f"""WITH {_BM}, {_VEC},
bf AS (SELECT query_id, vec_id, round(coalesce(s, 0), 6) AS score FROM qs CROSS JOIN tk LEFT JOIN hs USING (query_id, vec_id)),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'doc-' || (vec_id // 1048576), vec_id) - 1 AS rank FROM bf QUALIFY rank < 32),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, 'doc-' || (vec_id // 1048576), vec_id) - 1 AS rank FROM vf QUALIFY rank < 32),
cf(config, retriever, alpha, k, depth) AS (VALUES (0, 'bm25', 0.5::DOUBLE, 4, 4), (1, 'bm25', 0.5, 8, 8), (2, 'vector', 0.5, 8, 8), (3, 'hybrid', 0.5, 8, 32), (4, 'hybrid', 0.25, 4, 16)),
hv AS (SELECT config, alpha, k, query_id, vec_id, rank AS a, {_scaled("similarity")} AS x FROM vr JOIN cf ON retriever = 'hybrid' AND rank < depth WINDOW w AS (PARTITION BY config, query_id)),
hb AS (SELECT config, alpha, k, query_id, vec_id, rank AS b, {_scaled("score")} AS y FROM br JOIN cf ON retriever = 'hybrid' AND rank < depth WINDOW w AS (PARTITION BY config, query_id)),
hm AS (SELECT config, k, query_id, vec_id, a, b, round(alpha * coalesce(x, 0) + (1 - alpha) * coalesce(y, 0), 6) AS score FROM hv FULL JOIN hb USING (config, alpha, k, query_id, vec_id)),
hr AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, a NULLS LAST, b) - 1 AS rank FROM hm),
r AS (
  SELECT config, query_id, vec_id // 1048576 AS doc_id, rank FROM br JOIN cf ON retriever = 'bm25' AND rank < k
  UNION ALL SELECT config, query_id, vec_id // 1048576, rank FROM vr JOIN cf ON retriever = 'vector' AND rank < k
  UNION ALL SELECT config, query_id, vec_id // 1048576, rank FROM hr WHERE rank < k),
g AS (SELECT DISTINCT query_id, doc_id FROM qs JOIN (SELECT doc_id, {_SQUEEZE.format('text')} AS body FROM documents) ON query <> '' AND contains(body, query)),
e AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT config, query_id, count(DISTINCT doc_id) AS found, min(rank) AS top FROM g JOIN r USING (query_id, doc_id) GROUP BY 1, 2),
a AS (SELECT cf.config, retriever, alpha, k, e.n IS NOT NULL AS held, coalesce(found, 0)::DOUBLE / n AS recall, coalesce(1::DOUBLE / (top + 1), 0) AS rr, CASE WHEN top IS NULL THEN 0 ELSE 1 END AS hit
  FROM cf CROSS JOIN qs LEFT JOIN e USING (query_id) LEFT JOIN h ON h.config = cf.config AND h.query_id = qs.query_id)
SELECT config, retriever, alpha, k, count(*) AS n_cases, count(*) FILTER (held) AS n_answerable, round(coalesce(avg(recall) FILTER (held), 0), 4) AS recall_at_k, round(coalesce(avg(rr) FILTER (held), 0), 4) AS mrr,
  round(coalesce(avg(hit) FILTER (held), 0), 4) AS article_hit_rate, 0::DOUBLE AS citation_accuracy, 0::DOUBLE AS unsupported_claim_rate, round(coalesce(avg(CASE WHEN held THEN 1 ELSE 0 END), 0), 4) AS unanswerable_handling,
  0::DOUBLE AS answer_term_coverage FROM a GROUP BY 1, 2, 3, 4"""
O["bm25_stats"] = f"WITH {_BM} SELECT CASE WHEN term = chr(1) THEN chr(0) ELSE term END AS term, df, round(idf, 6) AS idf, n_docs, round(avgdl, 4) AS avgdl FROM tm, sz"
O["retrieve_bm25"] = f"WITH {_bm25(8)} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM br"
O["retrieve_bm25_filtered"] = f"WITH {_bm25(8, 'tk.lang = ' + chr(39) + 'fr' + chr(39))} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM br"
O["retrieve_vector"] = f"WITH {_BM}, {_vec(8)} SELECT query_id, vec_id, round(similarity, 4) AS similarity, rank FROM vr"
O["retrieve_hybrid"] = f"""WITH {_bm25(32)}, {_vec(32)},
v AS (SELECT query_id, vec_id, rank AS a, CASE WHEN max(similarity) OVER w - min(similarity) OVER w < 1e-12 THEN 0 ELSE (similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w) END AS x FROM vr WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, vec_id, rank AS b, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS y FROM br WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT query_id, vec_id, a, b, round(0.5::DOUBLE * coalesce(x, 0) + 0.5::DOUBLE * coalesce(y, 0), 6) AS score FROM v FULL JOIN b USING (query_id, vec_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, a NULLS LAST, b) - 1 AS rank FROM m)
SELECT query_id, vec_id, round(score, 4) AS score, rank FROM r WHERE rank < 8"""
O["min_max"] = """SELECT o_custkey, o_orderkey, round(CASE WHEN max(o_totalprice) OVER w - min(o_totalprice) OVER w < 1e-12 THEN 0 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END, 6) AS x
FROM orders WINDOW w AS (PARTITION BY o_custkey)"""
O["rerank_identity"] = "SELECT o_orderkey, o_totalprice AS score, o_totalprice AS rerank_score FROM orders"
O["dedup_key"] = f"SELECT doc_id, {_SQUEEZE.format('lower(text)')}[1:160] AS dedup_key FROM documents"
_PACKED = f"""{_bm25(8)},
c AS (SELECT br.query_id, br.rank, substr(sha1('doc-' || doc_id || '|A' || doc_id || '|' || chunk_index), 1, 16) AS chunk_id, {_SQUEEZE.format('lower(text)')}[1:160] AS key, {_EST.format(_WORDS.format('text'))} AS tokens
      FROM br JOIN ch ON br.vec_id = ch.doc_id * 1048576 + ch.chunk_index),
s AS (SELECT query_id, CAST(-1 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS keys, CAST(NULL AS VARCHAR) AS chunk_id, CAST(NULL AS VARCHAR) AS fate FROM qs
  UNION ALL
  SELECT query_id, rank, CASE WHEN fate = 'selected' THEN used + tokens ELSE used END, CASE WHEN fate = 'selected' THEN list_append(keys, key) ELSE keys END, chunk_id, fate FROM (
    SELECT s.query_id, c.rank, s.used, s.keys, c.key, c.tokens, c.chunk_id,
      CASE WHEN list_contains(s.keys, c.key) THEN 'duplicate_of_selected' WHEN s.used + c.tokens > 900 AND len(s.keys) > 0 THEN 'budget_exhausted' ELSE 'selected' END AS fate
    FROM s JOIN c ON s.query_id = c.query_id AND c.rank = s.rank + 1))"""
O["pack_context"] = f"WITH RECURSIVE {_PACKED} SELECT query_id, chunk_id, fate FROM s WHERE rank >= 0"
O["query_trace"] = f"""WITH RECURSIVE {_PACKED}
SELECT qs.query_id, any_value(qs.query) AS query, CAST(count(*) AS BIGINT) AS n_candidates, count(*) FILTER (fate = 'selected') AS n_selected, CAST(max(used) AS INT) AS token_estimate
FROM qs JOIN s ON qs.query_id = s.query_id AND s.rank >= 0 GROUP BY 1"""
_AN = """an AS (SELECT conv_id * 1048576 + turn AS query_id, conv_id, turn, CASE WHEN (conv_id * 7 + turn) % 5 = 0 THEN 'UNANSWERABLE ' || text
  WHEN (conv_id * 7 + turn) % 5 < 3 THEN text || ' [Art. A' || ((conv_id * 7 + turn) % 9) || ' (Section A, pdf p.1)] [Art. A' || ((conv_id * 7 + turn) % 4) || '.2 (Section A, pdf p.1)]' ELSE text END AS answer FROM conversations)"""
O["unanswerable_flag"] = f"WITH {_AN} SELECT conv_id, turn, starts_with(answer, 'UNANSWERABLE') AS unanswerable FROM an"
O["extract_citations"] = rf"""WITH {_AN}, a AS (SELECT query_id, answer FROM an),
c AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\[Art\.\s+([A-F]\d+(?:\.\d+)*)', 1)) AS n FROM a WHERE NOT starts_with(answer, 'UNANSWERABLE')),
o AS (SELECT query_id, i AS chunk_id, 'A' || i || CASE WHEN i > 4 THEN '' ELSE '.2' END AS article_number FROM a, generate_series(0, 8) g(i))
SELECT o.query_id, o.chunk_id, o.article_number FROM o JOIN c ON o.query_id = c.query_id AND o.article_number = c.n"""
O["corpus_diagnostics"] = rf"""WITH RECURSIVE {_PARSE}, {_ORDER_PAGES}, {_START},
g AS (SELECT source_filename, count(*) AS page_count, count(*) FILTER (page < body_start AND {_SIGNAL}) AS n_toc_pages, count({_LABEL}) AS labelled FROM op JOIN bs USING (source_filename) GROUP BY 1),
a AS (SELECT source_filename, count(*) AS n_articles FROM pa GROUP BY 1)
SELECT source_filename, page_count, n_toc_pages, coalesce(n_articles, 0) AS n_articles, least(coalesce(n_articles, 0), 15) AS n_first,
  array_to_string(list_filter(['no issue number on page 1', 'no approval date on page 1', CASE WHEN n_toc_pages = 0 THEN 'no contents pages' END, CASE WHEN n_articles IS NULL THEN 'no articles' END,
    CASE WHEN labelled < page_count * 0.5 THEN 'page labels on ' || labelled || '/' || page_count || ' pages' END], lambda x: x IS NOT NULL), '; ') AS warnings
FROM g LEFT JOIN a USING (source_filename)"""
O["article_match"] = f"""WITH x AS (SELECT {_K}, 'D' || ({_K} % 4) AS e, 'D' || ({_K} % 40) || CASE WHEN {_K} % 3 = 0 THEN '.1' ELSE '' END AS r FROM orders)
SELECT {_K}, starts_with(r, e) AS plain, r = e OR starts_with(r, e || '.') AS strict FROM x"""
_CASES = f"""cs AS (SELECT {_K} AS case_id, {_K} % 4 > 0 AS answerable, CASE WHEN {_K} % 10 = 9 THEN [] ELSE ['D' || ({_K} % 5), 'D' || ({_K} % 7)] END AS ex, CASE WHEN {_K} % 6 = 5 THEN [] ELSE ['BODY', 'rules', o_orderpriority] END AS tm,
  ['D' || ({_K} % 11), 'D' || ({_K} % 5), 'D' || ({_K} % 13)] AS re, ['D' || ({_K} % 11), 'D' || ({_K} % 5)] AS cx, CASE WHEN {_K} % 3 = 0 THEN [] WHEN {_K} % 2 = 0 THEN ['D' || ({_K} % 11)] ELSE ['D' || ({_K} % 17)] END AS ci,
  CASE WHEN {_K} % 8 = 7 THEN NULL ELSE 'the body says ' || lower(o_orderpriority) END AS an, {_K} % 16 < 3 AS un FROM orders),
sc AS (SELECT case_id, answerable,
  CASE WHEN answerable AND len(ex) > 0 THEN len(list_filter(ex, lambda e: len(list_filter(re, lambda r: starts_with(r, e))) > 0)) / len(ex) END AS recall,
  CASE WHEN answerable AND len(ex) > 0 THEN coalesce(1.0::DOUBLE / list_position([len(list_filter(ex, lambda e: starts_with(r, e))) > 0 FOR r IN re], true), 0) END AS rr,
  CASE WHEN answerable AND len(ex) > 0 THEN CASE WHEN len(list_filter(ex, lambda e: len(list_filter(re, lambda r: starts_with(r, e))) > 0)) > 0 THEN 1.0::DOUBLE ELSE 0 END END AS hit,
  CASE WHEN answerable AND len(ex) > 0 AND len(ci) > 0 THEN CASE WHEN len(list_filter(ex, lambda e: len(list_filter(ci, lambda r: starts_with(r, e))) > 0)) > 0 THEN 1.0::DOUBLE ELSE 0 END END AS cited,
  CASE WHEN an IS NOT NULL AND NOT un THEN CASE WHEN len(ci) = 0 OR len(list_filter(ci, lambda c: NOT list_contains(cx, c))) > 0 THEN 1.0::DOUBLE ELSE 0 END END AS unsupported,
  CASE WHEN answerable <> un THEN 1.0::DOUBLE ELSE 0 END AS handled,
  CASE WHEN an IS NOT NULL AND NOT un AND len(tm) > 0 THEN len(list_filter(tm, lambda t: contains(lower(an), lower(t)))) / len(tm) END AS coverage FROM cs)"""
for _name, _column in {"recall_at_k": "recall", "mrr": "rr", "hit_rate": "hit", "citation_accuracy": "cited", "unsupported_rate": "unsupported", "unanswerable_handling": "handled", "term_coverage": "coverage"}.items():
    O[_name] = f"WITH {_CASES} SELECT case_id, round({_column}, 4) AS {_column} FROM sc"
O["metric_summary"] = f"""WITH {_CASES} SELECT count(*) AS n_cases, count(*) FILTER (answerable) AS n_answerable, round(coalesce(avg(recall), 0), 4) AS recall_at_k, round(coalesce(avg(rr), 0), 4) AS mrr, round(coalesce(avg(hit), 0), 4) AS article_hit_rate,
  round(coalesce(avg(cited), 0), 4) AS citation_accuracy, round(coalesce(avg(unsupported), 0), 4) AS unsupported_claim_rate, round(coalesce(avg(handled), 0), 4) AS unanswerable_handling, round(coalesce(avg(coverage), 0), 4) AS answer_term_coverage, CAST(8 AS BIGINT) AS k FROM sc"""
del O
