"""The queries as DuckDB SQL, written from the operators' meaning and sharing no code with them but fixed values."""

from __future__ import annotations

from ..config import ChunkConfig
from ..functions.text import NAME_RULES, ROLE_ALIASES, URL_EXTRA
from ..operators import prompt
from ..operators.rank import FUNCTIONAL, ROLE_TYPES, TECHNICAL
from ..sources.fixtures import DOC_TYPES, PIECE, ROLES
from . import literals as lit

ORACLE: dict[str, str] = {}


def quoted(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"{x}::BIGINT" if isinstance(x, int) else str(x)


def values(rows, columns: str) -> str:
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) v({columns}))"


def listed(xs) -> str:
    return "(" + ", ".join(map(quoted, xs)) + ")"


SPACE = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}', ' ', 'g'), ' ')"


def hash_id(t: str, source: str = "source", page: str = "page_number") -> str:
    return f"substr(sha256({norm(t)} || '|' || {source} || '|' || {page}), 1, 32)"


def pick(xs, key: str) -> str:
    return f"(ARRAY[{', '.join(map(quoted, xs))}])[{key} % {len(xs)} + 1]"


DOCS = f"""docs AS (
  SELECT doc_id, text, source, {pick(DOC_TYPES, "doc_id")} AS doc_type, {pick(DOC_TYPES, "doc_id")} || '_' || doc_id || '.pdf' AS file_name,
    CAST(doc_id % 5 AS INTEGER) AS page_number, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""
ASKED = f"asked AS (SELECT item_id AS query_id, text, embedding AS vector, {pick(ROLES, 'item_id')} AS role FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"

ORACLE["text_normalize"] = f"SELECT doc_id, {norm('text')} AS text, length({norm('text')}) AS chars FROM documents"
ORACLE["text_hash_id"] = f"WITH {DOCS} SELECT doc_id, {hash_id('text')} AS id FROM docs"

_names = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(n, {quoted(k)})' for k in keys)} THEN '{kind}'" for kind, keys in NAME_RULES) + " ELSE 'unknown' END"
ORACLE["doc_type_from_name"] = f"WITH {DOCS}, a AS (SELECT file_name AS name FROM docs UNION ALL SELECT name FROM {values(lit.NAMES, 'name')}) SELECT name, {_names} AS doc_type FROM (SELECT name, lower(name) AS n FROM a)"

# A url's parts: scheme, then a place behind two slashes, then the path up to ?, then the query up to #.
URL_PARTS = f"""u AS (
  SELECT url, CASE WHEN regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN s ELSE 'https://' || s END AS w
  FROM (SELECT url, regexp_replace(regexp_replace(url, '^{SPACE}', ''), '{SPACE}$', '') AS s FROM (SELECT url FROM pages UNION ALL SELECT url FROM {values(lit.URLS, 'url')}))),
v AS (SELECT url, lower(regexp_extract(w, '^([^:]*):', 1)) AS scheme, regexp_replace(regexp_extract(w, '^[^:]*:(.*)$', 1, 's'), '#.*$', '', 's') AS rest FROM u),
p AS (SELECT url, scheme, CASE WHEN starts_with(rest, '//') THEN lower(regexp_extract(rest, '^//([^/?]*)', 1)) ELSE '' END AS place,
  CASE WHEN starts_with(rest, '//') THEN regexp_replace(rest, '^//[^/?]*', '') ELSE rest END AS tail FROM v),
q AS (SELECT url, scheme, place, regexp_extract(tail, '^([^?]*)', 1) AS path, regexp_extract(tail, '^[^?]*\\?(.*)$', 1, 's') AS query FROM p)"""
_tokens = "regexp_extract_all(lower(path), '[a-z0-9_]+')"
_types = "CASE " + " ".join(f"WHEN list_has_any({_tokens}, [{', '.join(map(quoted, keys + URL_EXTRA.get(kind, ())))}]) THEN '{kind}'" for kind, keys in NAME_RULES) + " ELSE 'web' END"
ORACLE["doc_type_from_url"] = f"WITH {URL_PARTS} SELECT url, {_types} AS doc_type FROM q"
_normal = f"""CASE WHEN trim(regexp_replace(url, '{SPACE}', ' ', 'g')) = '' THEN '' ELSE
  scheme || '://' || place || CASE WHEN path = '' THEN '/' WHEN regexp_matches(scheme, '^(ftp|hdl|prospero|https?|shttp|rtspu?|sips?|mms|sftp|tel)$') THEN regexp_replace(path, ';[^/]*$', '') ELSE path END
  || CASE WHEN query <> '' THEN '?' || query ELSE '' END END"""
ORACLE["url_normalize"] = f"WITH {URL_PARTS} SELECT url, {_normal} AS normal FROM q"
_allow = " OR ".join(f"regexp_matches(url, '{p}')" for p in lit.POLICY_ALLOW)
_deny = " OR ".join(f"regexp_matches(url, '{p}')" for p in lit.POLICY_DENY)
ORACLE["url_policy"] = f"""
SELECT url, (host = 'example.com' OR ends_with(host, '.example.com')) AND ok AS allowed, ends_with(host, 'example.com') AND ok AS allowed_by_suffix
FROM (SELECT url, regexp_extract(url, '^https://([^/:]*)', 1) AS host, ({_allow}) AND NOT ({_deny}) AS ok FROM {values(lit.POLICY, 'url')})
"""

# For pages as the fixtures' are: no nested or unclosed dropped elements.
_no = r"html"
for _tag in ("script", "style", "noscript", "nav", "footer", "header", "aside"):
    _no = rf"regexp_replace({_no}, '<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'gs')"
_plain = rf"regexp_replace(regexp_replace({_no}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', chr(1), 'gs')"


def _chars(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&')"


_page_text = norm(_chars(f"replace({_plain}, chr(1), ' ')"))
_page_title = f"trim({_chars(chr(114) + 'egexp_extract(html, ' + quoted('<title>(.*?)</title>') + ', 1, ' + quoted('s') + ')')})"
ORACLE["html_text_title"] = f"SELECT page_id, {_page_text} AS text, {_page_title} AS title FROM pages"
_base = r"regexp_extract(url, '^[a-z]+://[^/?#]*')"
ORACLE["html_links"] = rf"""
SELECT page_id, i - 1 AS pos, {_base} || replace(l[i], '&amp;', '&') AS link
FROM (SELECT page_id, url, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))
"""
ORACLE["web_documents"] = f"""
WITH {URL_PARTS}, r AS (SELECT DISTINCT url, {_normal} AS source, {_types} AS doc_type FROM q)
SELECT source, doc_type, {_page_title} AS title, sha256({_page_text}) AS text_sha256 FROM pages JOIN r USING (url) WHERE length({_page_text}) >= 100
"""
ORACLE["min_len_filter"] = f"SELECT doc_id FROM documents WHERE length({norm('text')}) >= 20"

_c = ChunkConfig()


def chunk_ctes(technical=_c.technical_types, merge_tail: bool = False) -> str:
    """Greedy windows over words by their summed lengths; assumes that every word is shorter than a chunk."""
    tech = f"doc_type IN {listed(technical)}" if technical else "false"
    ends = f"""SELECT doc_id, k AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total, trim(array_to_string(w[lo:hi], ' ')) AS text FROM win JOIN sums USING (doc_id)"""
    merged = f"""SELECT doc_id, chunk_index, CASE WHEN short THEN chunk_total - 1 ELSE chunk_total END AS chunk_total,
      CASE WHEN short AND chunk_index = chunk_total - 1 THEN text || ' ' || tail ELSE text END AS text
      FROM (SELECT *, chunk_total >= 2 AND length(tail) < greatest({_c.min_text_len}, {int(0.25 * _c.size)}) AS short FROM (SELECT *, last_value(text) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM parts))
      WHERE NOT (short AND chunk_index = chunk_total)"""
    return f"""{DOCS},
words AS (SELECT doc_id, string_split({norm('text')}, ' ') AS w, CASE WHEN {tech} THEN {_c.technical_size} ELSE {_c.size} END AS size, CASE WHEN {tech} THEN {_c.technical_overlap} ELSE {_c.overlap} END AS share
  FROM docs WHERE length({norm('text')}) >= {_c.min_text_len}),
sums AS (SELECT doc_id, any_value(w) AS w, any_value(size) AS size, any_value(share) AS share, list(c ORDER BY i) AS c FROM (
  SELECT doc_id, w, size, share, i, sum(length(w[i]) + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)) GROUP BY doc_id),
win AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS lo, CAST(len(list_filter(c, lambda x: x <= size)) AS BIGINT) AS hi FROM sums
  UNION ALL
  SELECT doc_id, k + 1, lo2, CAST(len(list_filter(c, lambda x: x - CASE WHEN lo2 = 1 THEN 0 ELSE c[lo2 - 1] END <= size)) AS BIGINT)
  FROM (SELECT win.doc_id, k, c, size, CAST(least(hi + 1, 1 + len(list_filter(list_prepend(0, c[1:hi]), lambda x: x < greatest(c[hi] - share, c[hi + 1] - size)))) AS BIGINT) AS lo2
    FROM win JOIN sums USING (doc_id) WHERE hi < len(c))),
parts AS ({ends}),
made AS ({merged if merge_tail else "SELECT * FROM parts"}),
chunks AS (SELECT docs.* EXCLUDE (text), chunk_index, chunk_total, made.text, {hash_id('made.text', 'docs.source', 'docs.page_number')} AS id FROM made JOIN docs USING (doc_id) WHERE length(made.text) >= {_c.min_text_len}),
passages AS (SELECT * FROM (SELECT *, doc_id * 100000 + chunk_index AS ingest_seq, row_number() OVER (PARTITION BY id ORDER BY doc_id * 100000 + chunk_index DESC) AS place FROM chunks) WHERE place = 1)"""


_CHUNK_COLUMNS = "SELECT doc_id, chunk_index, chunk_total, text, id FROM chunks"
CHUNKS = f"WITH RECURSIVE {chunk_ctes()}"
ORACLE["chunk_standard"] = f"WITH RECURSIVE {chunk_ctes(())} {_CHUNK_COLUMNS}"
ORACLE["chunk_by_profile"] = f"{CHUNKS} {_CHUNK_COLUMNS}"
ORACLE["chunk_merge_tail"] = f"WITH RECURSIVE {chunk_ctes(merge_tail=True)} {_CHUNK_COLUMNS}"
ORACLE["chunk_stats"] = f"{CHUNKS} SELECT doc_type, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest, min(length(text)) AS shortest, count(DISTINCT id) AS ids FROM chunks GROUP BY doc_type"
ORACLE["store_upsert_last_wins"] = f"{CHUNKS} SELECT id, ingest_seq, doc_id FROM passages"
ORACLE["store_reingest_idempotent"] = f"{CHUNKS} SELECT doc_type, count(*) AS rows, CAST(sum(ingest_seq + 1) AS BIGINT) AS seqs FROM passages GROUP BY doc_type"
ORACLE["store_delete_ids"] = f"{CHUNKS} SELECT doc_type, count(*) AS rows FROM passages WHERE toxic IS DISTINCT FROM 1 GROUP BY doc_type"
ORACLE["store_delete_filter"] = f"WITH {DOCS} SELECT doc_id, doc_type, CAST(coalesce(quality, -1) AS BIGINT) AS quality FROM docs WHERE NOT coalesce(quality = 0 AND doc_type = 'api', false)"
ORACLE["store_filter_eq"] = f"WITH {DOCS} SELECT doc_id FROM docs WHERE quality IS NULL AND page_number = 0"
ORACLE["store_count"] = f"WITH {DOCS} SELECT count(*) AS rows FROM docs WHERE quality = 1"


def dense_cte(score: str, rows: str = "embeddings", k: int = 20, key: str = "vec_id", vector: str = "embedding", name: str = "near") -> str:
    said = score.format(a="CAST(a.vector AS DOUBLE[])", b=f"CAST(e.{vector} AS DOUBLE[])")
    return f"""{name} AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM (SELECT query_id, e.{key} AS id, round({said}, 6) AS score FROM asked a, {rows} e WHERE a.vector IS NOT NULL AND e.{vector} IS NOT NULL)) WHERE rank <= {k})"""


COSINE = "list_cosine_similarity({a}, {b})"
ORACLE["dense_cosine"] = f"WITH {ASKED}, {dense_cte(COSINE)} SELECT * FROM near"
ORACLE["dense_index"] = ORACLE["dense_cosine"]
ORACLE["dense_msearch"] = f"WITH asked AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings), {dense_cte(COSINE, k=5)} SELECT * FROM near"
ORACLE["dense_dot"] = f"WITH {ASKED}, {dense_cte('list_inner_product({a}, {b})')} SELECT * FROM near"
ORACLE["dense_l2"] = f"WITH {ASKED}, {dense_cte('0.0 - list_distance({a}, {b})')} SELECT * FROM near"
ORACLE["dense_filtered"] = f"WITH {ASKED}, {dense_cte(COSINE, '(SELECT * FROM embeddings WHERE label = 3)')} SELECT * FROM near"
ORACLE["dense_batch"] = f"""
WITH {ASKED}, s AS (SELECT query_id, label, vec_id AS id, round({COSINE.format(a="CAST(vector AS DOUBLE[])", b="CAST(embedding AS DOUBLE[])")}, 6) AS score FROM asked, embeddings WHERE vector IS NOT NULL)
SELECT query_id, label, score, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS r FROM s) WHERE r = 1
"""


def bm25_cte(rows: str, key: str) -> str:
    tokens = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda t: t <> '')"
    return f"""toks AS (SELECT {key} AS id, {tokens} AS w FROM {rows}),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM toks) GROUP BY ALL),
lens AS (SELECT id, len(w) AS len FROM toks),
total AS (SELECT count(*) AS n, avg(len) AS avglen FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, total),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens}) AS term FROM asked) GROUP BY ALL),
said AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avglen))), 6) AS score
  FROM qt JOIN idfs USING (term) JOIN post USING (term) JOIN lens USING (id), total GROUP BY ALL)) WHERE rank <= 20)"""


BM25 = f"WITH {ASKED}, {bm25_cte('documents', 'doc_id')}"
ORACLE["bm25_stats"] = f"""
WITH t AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '{SPACE}')) AS term FROM documents),
d AS MATERIALIZED (SELECT term, count(*) AS df FROM t WHERE term <> '' GROUP BY term),
r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, (SELECT count(*) AS n FROM documents))
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 9) AS idf FROM r
"""
ORACLE["bm25_topk"] = f"{BM25} SELECT query_id, id, score, rank FROM said"
ORACLE["bm25_blocks"] = ORACLE["bm25_topk"]
ORACLE["bm25_postfilter"] = f"{BM25} SELECT query_id, id, rank FROM said WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)"


def fused_cte(k: int) -> str:
    return f"""lists AS (SELECT query_id, id, 0 AS l, rank FROM near UNION ALL SELECT query_id, id, 1, rank FROM said),
fused AS (SELECT query_id, id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS pos FROM (
  SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(l * 1000 + rank) AS f FROM lists GROUP BY ALL)) WHERE pos <= {k})"""


ORACLE["rrf_fuse"] = f"{BM25}, {dense_cte(COSINE)}, {fused_cte(30)} SELECT * FROM fused"


def dedupe_cte(rows: str, name: str) -> str:
    return f"""{name} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos) FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, substr(coalesce(text, ''), 1, 80) ORDER BY pos) AS same FROM {rows}) WHERE same = 1))"""


_likes = " OR ".join(f"(lower(role) = '{r}' AND doc_type IN {listed(t)})" for r, t in ROLE_TYPES.items())


def prefer_cte(rows: str, name: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN {_likes} THEN 0 ELSE 1 END, pos) AS pos) FROM {rows}) WHERE pos <= {k})"""


def interleave_cte(rows: str, name: str, tail: str = "pos > f + t") -> str:
    return f"""kinds AS (SELECT *, count(CASE WHEN kind = 0 THEN 1 END) OVER (PARTITION BY query_id) AS f, count(CASE WHEN kind = 1 THEN 1 END) OVER (PARTITION BY query_id) AS t,
    row_number() OVER (PARTITION BY query_id, kind ORDER BY pos) AS turn
  FROM (SELECT *, CASE WHEN doc_type IN {listed(FUNCTIONAL)} THEN 0 WHEN doc_type IN {listed(TECHNICAL)} THEN 1 END AS kind FROM {rows})),
{name} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY a, b, c) AS pos) FROM (
  SELECT *, 0 AS a, turn AS b, kind AS c FROM kinds WHERE f > 0 AND t > 0 AND kind IS NOT NULL
  UNION ALL SELECT *, 1, pos, 0 FROM kinds WHERE f = 0 OR t = 0 OR ({tail})))"""


RANKED = f"WITH {DOCS}, ranked AS (SELECT *, CAST(page_number AS BIGINT) AS query_id, {pick(ROLES, 'page_number')} AS role, row_number() OVER (PARTITION BY page_number ORDER BY doc_id) AS pos FROM docs)"
ORACLE["dedupe_head80"] = f"{RANKED}, {dedupe_cte('ranked', 'd')} SELECT query_id, pos, doc_id FROM d"
ORACLE["role_rerank"] = f"{RANKED}, {prefer_cte('ranked', 'd', 50)} SELECT query_id, pos, doc_id FROM d"
ORACLE["interleave"] = f"{RANKED}, {interleave_cte('ranked', 'd')} SELECT query_id, pos, doc_id FROM d"
ORACLE["interleave_complete"] = f"{RANKED}, {interleave_cte('ranked', 'd', 'kind IS NULL')} SELECT query_id, pos, doc_id FROM d"

_with_vectors = "(SELECT id, embedding FROM passages JOIN embeddings ON vec_id = doc_id)"
HYBRID = f"""WITH RECURSIVE {chunk_ctes()}, {ASKED}, {bm25_cte('passages', 'id')}, {dense_cte(COSINE, _with_vectors, key="id")}, {fused_cte(30)},
hits AS (SELECT f.query_id, f.id, f.score, f.pos, a.role, p.text, p.source, p.doc_type, p.file_name, p.page_number FROM fused f JOIN passages p USING (id) JOIN asked a ON a.query_id = f.query_id),
{dedupe_cte('hits', 'once')}, {prefer_cte('once', 'liked', 20)}, {interleave_cte('liked', 'mixed')}, best AS (SELECT * FROM mixed WHERE pos <= 10)"""
ORACLE["hybrid_search"] = f"{HYBRID} SELECT query_id, pos, id, score FROM best"
CONTEXT = """ctx AS (SELECT query_id, coalesce(string_agg('--- DOCUMENT CHUNK ' || pos || ' ---' || chr(10) || 'SOURCE: ' || file_name || ' (Page ' || page_number || ')' || chr(10) || 'CATEGORY: ' || doc_type || ' / text' || chr(10) || 'CONTENT: ' || b.text || chr(10), chr(10) ORDER BY pos), 'No relevant documentation found.') AS context
  FROM asked LEFT JOIN best b USING (query_id) GROUP BY query_id)"""
ORACLE["context_blocks"] = f"{HYBRID}, {CONTEXT} SELECT * FROM ctx"
_role = f"coalesce(map_extract(MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in ROLE_ALIASES.items())}}}, lower(trim(coalesce(role, ''))))[1], 'developer')"
_openings = " ".join(f"WHEN '{n}' THEN {quoted(o + (f'CONTEXT LEGEND:' + chr(10) + prompt.LEGEND + chr(10) * 2 if legend else ''))}" for n, (o, legend) in prompt.TEMPLATES.items())
ORACLE["prompt_by_role"] = f"""{HYBRID}, {CONTEXT}
SELECT query_id, sha256(CASE {_role} {_openings} END || 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION:' || chr(10) || text || chr(10)) AS user_sha256 FROM asked JOIN ctx USING (query_id)"""
ORACLE["role_alias"] = f"SELECT role, {_role} AS resolved FROM {values(lit.ROLES, 'role')}"

ORACLE["chat_payload"] = """
SELECT conv_id, 'default' AS model, 0.2::DOUBLE AS temperature, NULL::DOUBLE AS top_p, 100::BIGINT AS max_tokens, count(*) + 2 AS n,
  sha256('system:be brief' || chr(10) || 'user:go on' || chr(10) || string_agg(coalesce(role, '') || ':' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS messages_sha256
FROM conversations GROUP BY conv_id
"""
ORACLE["gemini_payload"] = "SELECT item_id, 'user' AS role, text AS user, 'be brief' AS system, 0.9::DOUBLE AS top_p, NULL::VARCHAR AS max_tokens FROM benchmark"
ORACLE["response_text"] = f"SELECT id, trim(coalesce(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.choices[0].message.content') END, '')) AS text FROM {values(lit.BODIES, 'id, body')}"
ORACLE["content_text"] = f"SELECT id, trim(coalesce(array_to_string(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.candidates[0].content.parts[*].text') END, ''), '')) AS text FROM {values(lit.CONTENTS, 'id, body')}"
ORACLE["sse_deltas"] = f"""
WITH d AS (SELECT stream_id, ord, trim(substr(line, 6)) AS data FROM {values(lit.SSE, 'stream_id, ord, line')} WHERE starts_with(line, 'data:')),
e AS (SELECT *, max(CASE WHEN data = '[DONE]' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ord) AS done FROM d)
SELECT stream_id, ord, delta FROM (SELECT stream_id, ord, CASE WHEN json_valid(data) THEN json_extract_string(data, '$.choices[0].delta.content') END AS delta FROM e WHERE done = 0) WHERE delta <> ''
"""
ORACLE["http_status_class"] = f"SELECT status, CASE WHEN status // 100 = 2 THEN 'ok' WHEN status = 429 THEN 'rate_limited' WHEN status // 100 = 5 THEN 'retriable' ELSE 'failed' END AS outcome FROM {values(lit.STATUS, 'status')}"
ORACLE["backoff_schedule"] = f"SELECT attempt, \"limited\", round(least(0.8::DOUBLE * pow(1.8::DOUBLE, attempt - 1) * CASE WHEN \"limited\" THEN 1.5 ELSE 1 END, 10), 9) AS seconds FROM {values(lit.ATTEMPTS, 'attempt, \"limited\"')}"

_rects = values([(p, o, *b) for p, o, _, b, _ in lit.DRAWINGS if b], "page_key, ord, x0, y0, x1, y1")
_lines = values([(p, o, *map(float, (*pts[0], *pts[-1]))) for p, o, kind, b, pts in lit.DRAWINGS if not b and kind in ("line", "curve") and len(pts) >= 2], "page_key, ord, px, py, qx, qy")
GEOMETRY = f"""WITH t AS (SELECT page_key, ord, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, {norm('text')} AS text FROM {values(lit.BLOCKS, 'page_key, ord, x0, y0, x1, y1, text')}),
b AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM t WHERE text <> ''),
r AS (SELECT page_key, ord, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, (x0::DOUBLE + x1::DOUBLE) / 2 AS cx, (y0::DOUBLE + y1::DOUBLE) / 2 AS cy FROM {_rects}),
inn AS (SELECT * FROM (SELECT r.page_key, r.ord, b.text, row_number() OVER (PARTITION BY r.page_key, r.ord ORDER BY length(b.text) DESC, b.ord) AS k FROM r JOIN b ON r.page_key = b.page_key AND b.x0 >= r.x0 - 1.5 AND b.y0 >= r.y0 - 1.5 AND b.x1 <= r.x1 + 1.5 AND b.y1 <= r.y1 + 1.5) WHERE k = 1),
nea AS (SELECT * FROM (SELECT r.page_key, r.ord, b.text, (r.cx - b.cx) ** 2 + (r.cy - b.cy) ** 2 AS d, row_number() OVER (PARTITION BY r.page_key, r.ord ORDER BY (r.cx - b.cx) ** 2 + (r.cy - b.cy) ** 2, b.ord) AS k FROM r JOIN b ON r.page_key = b.page_key) WHERE k = 1 AND d <= 36 * 36),
n AS (SELECT r.page_key, r.ord, r.cx, r.cy, split_part(coalesce(inn.text, nea.text), ' ', 1) AS id FROM r LEFT JOIN inn USING (page_key, ord) LEFT JOIN nea ON nea.page_key = r.page_key AND nea.ord = r.ord WHERE length(split_part(coalesce(inn.text, nea.text), ' ', 1)) >= 2),
l AS (SELECT page_key, ord, px::DOUBLE AS px, py::DOUBLE AS py, qx::DOUBLE AS qx, qy::DOUBLE AS qy FROM {_lines}),
pts AS (SELECT page_key, ord, 'p' AS e, px AS x, py AS y FROM l UNION ALL SELECT page_key, ord, 'q', qx, qy FROM l),
snap AS (SELECT * FROM (SELECT pts.page_key, pts.ord, e, n.id, (x - n.cx) ** 2 + (y - n.cy) ** 2 AS d, row_number() OVER (PARTITION BY pts.page_key, pts.ord, e ORDER BY (x - n.cx) ** 2 + (y - n.cy) ** 2, n.ord) AS k FROM pts JOIN n ON n.page_key = pts.page_key) WHERE k = 1 AND d <= 64 * 64),
lab AS (SELECT * FROM (SELECT l.page_key, l.ord, b.text, ((px + qx) / 2 - b.cx) ** 2 + ((py + qy) / 2 - b.cy) ** 2 AS d, row_number() OVER (PARTITION BY l.page_key, l.ord ORDER BY ((px + qx) / 2 - b.cx) ** 2 + ((py + qy) / 2 - b.cy) ** 2, b.ord) AS k FROM l JOIN b ON b.page_key = l.page_key) WHERE k = 1 AND d <= 48 * 48),
ed AS (SELECT p.page_key, p.ord, p.id AS "from", q.id AS "to", CASE WHEN length(lab.text) < 200 THEN lab.text END AS label FROM snap p JOIN snap q ON p.page_key = q.page_key AND p.ord = q.ord AND p.e = 'p' AND q.e = 'q' AND p.id <> q.id LEFT JOIN lab ON lab.page_key = p.page_key AND lab.ord = p.ord),
ti AS (SELECT page_key, arg_min(text, place) AS title FROM (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY y0, ord) AS place FROM b) WHERE place <= 6 AND length(text) BETWEEN 3 AND 80 GROUP BY page_key)"""
ORACLE["diagram_nodes"] = f"{GEOMETRY} SELECT page_key, ord, id FROM n"
ORACLE["diagram_edges"] = f"{GEOMETRY} SELECT * FROM ed"
ORACLE["diagram_title"] = f"{GEOMETRY} SELECT * FROM ti"
ORACLE["diagram_text"] = f"""{GEOMETRY},
nn AS (SELECT page_key, string_agg(id, ', ' ORDER BY ord) AS s FROM n GROUP BY page_key),
ee AS (SELECT page_key, string_agg("from" || ' -> ' || "to" || coalesce(' (' || label || ')', ''), '; ' ORDER BY ord) AS s FROM ed GROUP BY page_key)
SELECT page_key, '--- DOCUMENT CHUNK (ERD) ---' || chr(10) || 'SOURCE: ' || file_name || ' (Page ' || page_number || ')' || chr(10) || 'CATEGORY: erd' || chr(10) || 'TITLE: ' || coalesce(title, '') || chr(10) || 'NODES: ' || nn.s || chr(10) || 'EDGES: ' || coalesce(ee.s, '') AS summary
FROM nn JOIN {values(lit.DIAGRAM_PAGES, 'page_key, file_name, page_number')} USING (page_key) LEFT JOIN ee USING (page_key) LEFT JOIN ti USING (page_key)"""

_links = []
for _url, _, _hrefs in lit.SITE:
    for _i, _h in enumerate(_hrefs):
        _h = _h.split("#")[0]
        _links.append((_url, _i, _h if ":" in _h else "https://s.org/" + _h.lstrip("/")))
ORACLE["crawl_bfs"] = f"""
WITH RECURSIVE page AS (SELECT url, words FROM {values([(u, n) for u, n, _ in lit.SITE], 'url, words')}), link AS (SELECT a, pos, b FROM {values(_links, 'a, pos, b')} WHERE regexp_matches(b, '^https://s\\.org/') AND NOT contains(b, '/private/')),
walk AS (SELECT 'https://s.org/' AS url, 0 AS depth, [0] AS way UNION ALL SELECT b, depth + 1, list_append(way, pos) FROM walk JOIN link ON a = url JOIN page ON page.url = walk.url WHERE depth < 8),
first_ AS (SELECT url, depth, way FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, way) AS k FROM walk) WHERE k = 1),
ok AS (SELECT url, depth, row_number() OVER (ORDER BY depth, way) AS pos FROM first_ JOIN page USING (url) WHERE words * 5 - 1 >= 100)
SELECT pos, CAST(depth AS BIGINT) AS depth, url FROM ok WHERE pos <= {lit.SITE_PAGES}
"""
ORACLE["page_kinds"] = f"""
WITH p AS (SELECT page_key, {norm('text')} AS t, has_images AS m, erd_summary AS e, {norm('ocr_text')} AS o FROM {values(lit.PAGE_ROWS, 'page_key, text, has_images, erd_summary, ocr_text')})
SELECT page_key, 'text' AS chunk_kind, t AS text FROM p WHERE length(t) >= 20
UNION ALL SELECT page_key, 'erd', e FROM p WHERE length(e) >= 20
UNION ALL SELECT page_key, 'ocr', o FROM p WHERE m AND length(t) < 20 AND length(o) >= 20
"""

ORACLE["crawl_live"] = ORACLE["crawl_bfs"]
_article = norm(_chars(r"regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', ' ', 'gs')"))
ORACLE["html_main_text"] = f"SELECT page_id, CASE WHEN length(html) % 2 = 0 THEN {_article} ELSE {_page_text} END AS text, {_page_title} AS title FROM pages"
_office = f"{pick(DOC_TYPES, 'doc_id')} || '_' || doc_id || '.docx'"
ORACLE["docx_documents"] = f"""
SELECT '/docs/' || name AS source, name AS file_name, {_names} AS doc_type, 'text' AS chunk_kind, sha256(said) AS text_sha256
FROM (SELECT {_office} AS name, lower({_office}) AS n, {norm('text')} AS said FROM documents) WHERE length(said) >= 20
"""
ORACLE["robots_rules"] = f"""
WITH {URL_PARTS}, r AS (SELECT DISTINCT url, place, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM q)
SELECT page_id, length(place) % 2 = 1 OR NOT (starts_with(path, '/en/') OR starts_with(path, '/es')) AS robots_ok FROM pages JOIN r USING (url)
"""
ORACLE["store_promote"] = f"WITH {DOCS} SELECT doc_type, count(*) AS rows FROM docs WHERE quality = 1 GROUP BY doc_type"
WRITTEN = f"""WITH {DOCS}, written AS (
  SELECT doc_id, doc_type, CASE WHEN toxic = 1 THEN 'new words for ' ELSE '' END || text AS text FROM docs
  WHERE NOT coalesce(quality = 0 AND toxic = 0, false) AND NOT (doc_type = 'erd' AND quality IS NULL))"""
ORACLE["store_parts"] = f"{WRITTEN} SELECT CAST(doc_id AS VARCHAR) AS id, doc_type, sha256(text) AS text_sha256 FROM written"
ORACLE["store_index"] = f"""{WRITTEN}, t AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '{SPACE}')) AS term FROM written)
SELECT term, count(*) AS df FROM t WHERE term <> '' GROUP BY term"""
ORACLE["generate_answers"] = """
SELECT item_id, CASE WHEN length(text) % 5 = 0 THEN '' ELSE trim('said: ' || text) END AS answer, CASE WHEN length(text) % 5 = 0 THEN 'HTTP 400: {"error":"no"}' END AS error FROM benchmark
"""
_pdf = f"{pick(DOC_TYPES, 'doc_id')} || '_' || doc_id || '.pdf'"
ORACLE["pdf_documents"] = f"""
WITH f AS (SELECT doc_id, {_pdf} AS name, lower({_pdf}) AS n, {norm('text')} AS said FROM documents),
p AS (
  SELECT name, n, 1::BIGINT AS page_number, 'text' AS chunk_kind, said FROM f WHERE length(said) >= 20
  UNION ALL SELECT name, n, 2, 'text', 'Model of a document 1:n order_' || doc_id || ' head line_' || doc_id || ' rows' FROM f
  UNION ALL SELECT name, n, 2, 'erd', '--- DOCUMENT CHUNK (ERD) ---' || chr(10) || 'SOURCE: ' || name || ' (Page 2)' || chr(10) || 'CATEGORY: erd' || chr(10) || 'TITLE: Model of a document' || chr(10)
    || 'NODES: order_' || doc_id || ', line_' || doc_id || chr(10) || 'EDGES: order_' || doc_id || ' -> line_' || doc_id || ' (1:n)' FROM f)
SELECT '/docs/' || name AS source, {_names} AS doc_type, page_number, chunk_kind, sha256(said) AS text_sha256 FROM p
"""
ORACLE["stream_ingest"] = f"{CHUNKS} SELECT DISTINCT id, sha256(text) AS text_sha256 FROM chunks"

# The later state's documents; what was too short before has come new.
_later = chunk_ctes().replace("SELECT doc_id, text, source,", "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'Now with another beginning. ' || text ELSE text END AS text, source,", 1)
ORACLE["ingest_diff"] = f"""
WITH RECURSIVE {_later},
n AS (SELECT file_name AS source, CASE WHEN doc_id % 10 = 3 AND (SELECT length({norm('text')}) FROM documents x WHERE x.doc_id = docs.doc_id) < {_c.min_text_len} THEN 1 ELSE doc_id % 10 END AS d, (SELECT count(DISTINCT c.text) FROM chunks c WHERE c.doc_id = docs.doc_id) AS passages FROM docs WHERE length({norm('text')}) >= {_c.min_text_len})
SELECT source, CASE d WHEN 1 THEN 'added' WHEN 2 THEN 'removed' WHEN 3 THEN 'changed' ELSE 'same' END AS change, CASE WHEN d = 2 THEN 0 ELSE passages END AS passages FROM n
"""
_xy = lambda *k: ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 1000 AS {c}" for i, c in k)
ORACLE["spatial_nearest"] = f"""
WITH p AS (SELECT vec_id, label, {_xy((0, "x"), (1, "y"))} FROM embeddings),
d AS (SELECT a.vec_id AS ord, b.vec_id AS near, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.label % 2 = 0 AND b.label % 2 = 1)
SELECT ord, near FROM d WHERE d2 <= 48.0 * 48.0 QUALIFY row_number() OVER (PARTITION BY ord ORDER BY d2, near) = 1
"""
ORACLE["spatial_inside"] = f"""
WITH p AS (SELECT vec_id, {_xy((0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "x"), (5, "y"))} FROM embeddings)
SELECT q.vec_id AS box, count(*) AS points, min(p.vec_id) AS first FROM p q JOIN p ON p.x >= q.a - 1.5 AND p.x <= q.a + abs(q.c) + 1.5 AND p.y >= q.b - 1.5 AND p.y <= q.b + abs(q.d) + 1.5
GROUP BY q.vec_id
"""
ORACLE["store_count_approx"] = "SELECT count(DISTINCT coalesce(text, '')) AS n, true AS within FROM documents"
ORACLE["stream_answers"] = f"""
SELECT conv_id || '-' || turn AS stream_id, text AS answer, CAST(ceil(length(text) / {PIECE}.0) AS BIGINT) AS pieces, conv_id % 7 <> 0 AS complete
FROM conversations WHERE role = 'assistant' AND text <> ''
"""
ORACLE["store_filter_pruned"] = f"""WITH {DOCS}, written AS (SELECT docs.*, d.source AS src, CASE WHEN toxic = 1 THEN 'new words for ' ELSE '' END || docs.text AS said FROM docs JOIN documents d USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS id, 'type' AS "by", sha256(said) AS text_sha256 FROM written WHERE doc_type = 'schema'
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'source', sha256(said) FROM written WHERE src = 'src3' AND quality IS NULL
"""
ORACLE["robots_native"] = f"""
WITH {URL_PARTS}, r AS (SELECT DISTINCT url, place, CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS t FROM q)
SELECT page_id, CASE WHEN length(place) % 2 = 1 THEN starts_with(t, '/es/1') OR NOT starts_with(t, '/es/') WHEN regexp_matches(t, '^/.*\\.html$') THEN false WHEN starts_with(t, '/en/') THEN true ELSE NOT (starts_with(t, '/fr/') OR regexp_matches(t, '^/.*/2')) END AS robots_ok
FROM pages JOIN r USING (url)
"""
