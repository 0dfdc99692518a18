"""SQL for DuckDB that states the result of each query in its own way, over the same tables."""

from __future__ import annotations

_WS = r"[\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{_WS}+', ''), '{_WS}+\z', '')"


def _text(expr: str) -> str:
    return f"SELECT load_id, {expr} AS text FROM loaded_docs WHERE markdown_content IS NOT NULL"


_ACCEPT = r"regexp_matches(lower(file_name), '\.(pdf|html|docx)$')"
_HEX = "regexp_full_match(content_hash, '[0-9a-f]{64}')"

_CLASSIFY = f"""
    WITH good AS (SELECT file_name, content_hash FROM disk_files WHERE {_ACCEPT}),
    cls AS (
        SELECT file_name, 'deleted' AS change FROM ledger WHERE file_name NOT IN (SELECT file_name FROM disk_files)
        UNION ALL SELECT file_name, 'ignored' FROM disk_files WHERE NOT coalesce({_ACCEPT}, false)
        UNION ALL SELECT file_name, 'new' FROM good WHERE file_name NOT IN (SELECT file_name FROM ledger)
        UNION ALL SELECT g.file_name, CASE WHEN coalesce(g.content_hash = l.content_hash AND regexp_full_match(g.content_hash, '[0-9a-f]{{64}}'), false) THEN 'unchanged' ELSE 'modified' END
                  FROM good g JOIN ledger l USING (file_name)
    )"""

_LINES = """
    WITH ln AS (
        SELECT load_id, unnest(generate_series(0, len(s) - 1))::INT AS pos, unnest(s) AS line
        FROM (SELECT load_id, string_split(markdown_content, chr(10)) AS s FROM loaded_docs WHERE markdown_content IS NOT NULL)
    )"""

# Symbol lines line by line: a run of lines without a letter or digit goes from its first line that no pipe row follows
# (the guard looks past blank lines) to its last that ends with a newline; a single empty line stays.
_NO_SYMBOLS = rf"""{_LINES},
    fl AS (
        SELECT *, NOT regexp_matches(line, '[\pL\pN_]') AS sym, max(pos) OVER (PARTITION BY load_id) AS fin,
            first_value(CASE WHEN {_strip("line")} <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY load_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM ln
    ),
    rn AS (SELECT *, pos - row_number() OVER (PARTITION BY load_id, sym ORDER BY pos) AS run, coalesce(regexp_matches(nxt, '^{_WS}*\|.*\|{_WS}*$'), false) AS guard FROM fl),
    ed AS (SELECT *, min(pos) FILTER (NOT guard AND pos < fin) OVER w AS s, max(pos) FILTER (pos < fin) OVER w AS e FROM rn WINDOW w AS (PARTITION BY load_id, sym, run)),
    gone AS (SELECT load_id, pos, line, coalesce(sym AND pos BETWEEN s AND e AND (e > s OR line <> ''), false) AS gone FROM ed),
    nosym AS (SELECT load_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM gone WHERE NOT gone GROUP BY load_id)"""

_HEAD = rf"""{_LINES},
    hd AS (
        SELECT load_id, pos, length(regexp_extract(line, '^(#{{1,6}}){_WS}+', 1))::INT AS level, {_strip(rf"regexp_extract(line, '(?s)^#{{1,6}}{_WS}+(.*)$', 1)")} AS title
        FROM ln WHERE regexp_matches(line, '^#{{1,6}}{_WS}')
    ),
    span AS (  -- a heading is open up to the next one that is not deeper
        SELECT a.load_id, a.pos, a.level, a.title, coalesce(min(b.pos), 2147483647) AS until
        FROM hd a LEFT JOIN hd b ON b.load_id = a.load_id AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL
    ),
    crumb AS (
        SELECT l.load_id, l.pos, any_value(l.line) AS line, coalesce(string_agg(s.title, ' > ' ORDER BY s.level), '') AS breadcrumb
        FROM ln l LEFT JOIN span s ON s.load_id = l.load_id AND l.pos >= s.pos AND l.pos < s.until GROUP BY l.load_id, l.pos
    )"""

_BLOCKS = rf"""{_HEAD},
    live AS (SELECT c.*, h.pos IS NOT NULL AS is_head FROM crumb c LEFT JOIN hd h ON h.load_id = c.load_id AND h.pos = c.pos WHERE h.pos IS NOT NULL OR {_strip("c.line")} <> ''),
    stepped AS (SELECT *, CASE WHEN is_head OR coalesce(lag(is_head) OVER (PARTITION BY load_id ORDER BY pos), true) THEN 1 ELSE 0 END AS starts FROM live),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY load_id ORDER BY pos) AS block FROM stepped),
    blk AS (SELECT load_id, block::BIGINT AS block, bool_or(is_head) AS is_head, arg_min(breadcrumb, pos) AS breadcrumb, {_strip("string_agg(line, chr(10) ORDER BY pos)")} AS body FROM numbered GROUP BY load_id, block)"""

# What a row and a separator are; a table is a row, a separator, and rows.
_ROW, _SEPARATOR = r"^\s*\|[^\n]+\|\s*", r"\s*\|[\s:|\-]*\|\s*"
_TABLE = rf"(?m)(?:{_ROW}\n{_SEPARATOR}\n(?:{_ROW}\n?)+)"

_SEGMENTS = rf"""
    WITH cut AS (
        SELECT load_id, string_split(regexp_replace(markdown_content, '{_TABLE}', chr(1) || chr(2) || chr(1), 'g'), chr(1)) AS parts, regexp_extract_all(markdown_content, '{_TABLE}') AS tabs
        FROM loaded_docs WHERE markdown_content IS NOT NULL
    ),
    each AS (SELECT load_id, unnest(generate_series(1, len(parts))) AS n, unnest(parts) AS part, tabs FROM cut),
    told AS (SELECT load_id, n, part = chr(2) AS is_table, CASE WHEN part = chr(2) THEN tabs[(count(*) FILTER (part = chr(2)) OVER (PARTITION BY load_id ORDER BY n))] ELSE part END AS raw FROM each),
    seg AS (SELECT load_id, n, is_table, {_strip("raw")} AS body FROM told),
    kept AS (SELECT load_id, row_number() OVER (PARTITION BY load_id ORDER BY n)::INT AS segment, is_table, body FROM seg WHERE body <> ''),
    tab AS (SELECT load_id, row_number() OVER (PARTITION BY load_id ORDER BY segment)::INT AS table_no, body FROM kept WHERE is_table)"""


def _columns(body: str) -> str:
    return rf"""list_filter(list_transform(string_split(string_split({body}, chr(10))[1], '|'), lambda x: {_strip("x")}), lambda x: x <> '')"""


_EMITTED = """
    WITH em AS (SELECT row_id, chunk_id, created_at, embedding, landed_at - created_at >= INTERVAL 1 DAY AS late FROM chunks),
    one AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY chunk_id, late ORDER BY created_at DESC, row_id DESC) = 1),
    idx AS (SELECT chunk_id, row_id FROM one WHERE NOT late AND embedding IS NOT NULL),
    bat AS (SELECT chunk_id, row_id FROM one WHERE late AND embedding IS NOT NULL)"""

_STALE = f"""{_CLASSIFY},
    stale AS (SELECT file_name, file_name || '::' || unnest(generate_series(1, chunk_count)) AS chunk_id FROM cls JOIN ledger USING (file_name) WHERE change IN ('deleted', 'modified') AND chunk_count > 0)"""

_V = "(SELECT row_id AS id, embedding::DOUBLE[] AS v FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"

_HITS = f"""
    WITH v AS {_V},
    sc AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sc QUALIFY rank <= 5),
    rt AS (SELECT query_id, max(score) AS best, count(*) FILTER (score >= 0.6)::BIGINT AS relevant FROM hits GROUP BY query_id)"""

_INDEXED = f"SELECT d.file_name, d.content_hash, 'indexed' AS status, coalesce(l.chunk_count, 0) AS chunk_count, d.modified_at AS last_indexed_at FROM disk_files d JOIN cls USING (file_name) LEFT JOIN ledger l USING (file_name) WHERE change IN ('new', 'modified')"

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"

_CARD = r"\b[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}\b"

SQL: dict[str, str] = {
    "cdc_classify": f"{_CLASSIFY} SELECT file_name, change FROM cls",
    **{f"cdc_{x}": f"{_CLASSIFY} SELECT file_name FROM cls WHERE change = '{x}'" for x in ("new", "modified", "unchanged", "deleted")},
    "stale_ids": f"{_STALE} SELECT file_name, chunk_id FROM stale",
    "cdc_pending": f"""{_CLASSIFY} SELECT file_name FROM cls WHERE change IN ('new', 'modified')
        AND file_name NOT IN (SELECT file_name FROM loaded_docs WHERE markdown_content IS NOT NULL AND file_name IS NOT NULL)
        AND file_name NOT IN (SELECT file_name FROM pipeline_errors WHERE stage = 'load' AND attempt >= 3 AND file_name IS NOT NULL)""",
    "retry_counts": "SELECT file_name, coalesce(stage, 'unknown') AS stage, count(*) AS failures, max(attempt) AS last_attempt FROM pipeline_errors GROUP BY ALL",
    "retry_exhausted": "SELECT DISTINCT file_name FROM pipeline_errors WHERE attempt >= 3",
    "doc_latest": "SELECT file_name, load_id FROM loaded_docs QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY loaded_at DESC NULLS LAST, load_id DESC) = 1",
    "content_hash": "SELECT load_id, sha256(markdown_content) AS content_hash FROM loaded_docs",
    "ledger_lookup": "SELECT d.file_name, l.content_hash AS ledger_hash, l.status AS ledger_status, l.chunk_count AS ledger_chunks FROM disk_files d LEFT JOIN ledger l USING (file_name)",
    "ledger_upsert": f"""{_CLASSIFY} SELECT file_name, content_hash, status, chunk_count, last_indexed_at FROM ledger WHERE file_name NOT IN (SELECT file_name FROM cls WHERE change IN ('new', 'modified'))
        UNION ALL {_INDEXED}""",
    "ledger_delete": "SELECT file_name, content_hash, status, chunk_count, last_indexed_at FROM ledger WHERE file_name IN (SELECT file_name FROM disk_files)",
    "ledger_names": "SELECT file_name FROM ledger",
    "vector_upsert": f"{_EMITTED} SELECT chunk_id, row_id FROM bat UNION ALL SELECT chunk_id, row_id FROM idx WHERE chunk_id NOT IN (SELECT chunk_id FROM bat)",
    "vector_delete": f"{_EMITTED}, st AS ({_STALE} SELECT chunk_id FROM stale) SELECT chunk_id, row_id FROM idx WHERE chunk_id NOT IN (SELECT chunk_id FROM st)",
    "verify_sample": f"{_EMITTED}, ask AS (SELECT chunk_id FROM bat ORDER BY row_id LIMIT 50), n AS (SELECT count(*) AS asked, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM idx)) AS found FROM ask) SELECT asked, found, asked > 0 AND found = asked AS verified FROM n",
    "verify_all": f"{_EMITTED}, n AS (SELECT count(*) AS asked, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM idx)) AS found FROM bat) SELECT asked, found, asked > 0 AND found = asked AS verified FROM n",
    "clean_symbol_lines": f"{_NO_SYMBOLS} SELECT load_id, t AS text FROM nosym",
    "clean_full": rf"""{_NO_SYMBOLS},
        a AS (SELECT load_id, regexp_replace(t, '(?im)^{_WS}*(page{_WS}+\p{{Nd}}+{_WS}+of{_WS}+\p{{Nd}}+|-{_WS}*\p{{Nd}}+{_WS}*-){_WS}*$', '', 'g') AS t FROM nosym),
        b AS (SELECT load_id, replace(regexp_replace(regexp_replace(t, '!\[[^\n]*?\]\([^\n]*?\)', '', 'g'), '<[^>]+>', '', 'g'), chr(0), '') AS t FROM a),
        c AS (SELECT load_id, {_strip("regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM b)
        SELECT d.load_id, coalesce(c.text, '') AS text FROM loaded_docs d LEFT JOIN c USING (load_id)""",
    "clean_page_markers": _text(rf"regexp_replace(markdown_content, '(?im)^{_WS}*(page{_WS}+\p{{Nd}}+{_WS}+of{_WS}+\p{{Nd}}+|-{_WS}*\p{{Nd}}+{_WS}*-){_WS}*$', '', 'g')"),
    "clean_images": _text(r"regexp_replace(markdown_content, '!\[[^\n]*?\]\([^\n]*?\)', '', 'g')"),
    "clean_tags": _text("regexp_replace(markdown_content, '<[^>]+>', '', 'g')"),
    "clean_nul": _text("replace(markdown_content, chr(0), '')"),
    "collapse_newlines": _text(r"regexp_replace(markdown_content, '\n{3,}', chr(10) || chr(10), 'g')"),
    "strip_text": _text(_strip("markdown_content")),
    "strip_invisible": _text("replace(replace(replace(markdown_content, chr(8203), ''), chr(65279), ''), chr(160), ' ')"),
    "ligatures": _text("replace(replace(replace(replace(replace(replace(replace(markdown_content, chr(64257), 'fi'), chr(64258), 'fl'), chr(64256), 'ff'), chr(64259), 'ffi'), chr(64260), 'ffl'), chr(339), 'oe'), chr(230), 'ae')"),
    "dehyphenate": _text(r"regexp_replace(markdown_content, '([a-zA-Z]+)-\n([a-zA-Z]+)', '\1\2', 'g')"),
    "collapse_spaces": _text(r"regexp_replace(markdown_content, '[ \t]+', ' ', 'g')"),
    "pii_email": _text(f"regexp_replace(markdown_content, '{_EMAIL}', '<EMAIL_ADDRESS>', 'g')"),
    "pii_ssn": _text(r"regexp_replace(markdown_content, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '<US_SSN>', 'g')"),
    "pii_phone": _text(r"regexp_replace(markdown_content, '(\+[0-9]{1,3}[ .-])?(\([0-9]{3}\) |\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b', '<PHONE_NUMBER>', 'g')"),
    "pii_card": rf"""
        WITH n AS (SELECT load_id, markdown_content AS t, unnest(list_distinct(regexp_extract_all(markdown_content, '{_CARD}'))) AS x FROM loaded_docs),
        d AS (SELECT *, list_transform(list_reverse(string_split(regexp_replace(x, '[ -]', '', 'g'), '')), lambda c: c::INT) AS d FROM n),
        good AS (SELECT load_id, x FROM d WHERE len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(d, lambda c, i: CASE WHEN i % 2 = 1 THEN c WHEN c > 4 THEN 2 * c - 9 ELSE 2 * c END)) % 10 = 0),
        per AS (SELECT load_id, list(x ORDER BY length(x) DESC, x) AS xs FROM good GROUP BY load_id)
        SELECT load_id, CASE WHEN xs IS NULL THEN markdown_content ELSE list_reduce(list_prepend(markdown_content, xs), lambda a, x: replace(a, x, '<CREDIT_CARD>')) END AS text
        FROM loaded_docs LEFT JOIN per USING (load_id) WHERE markdown_content IS NOT NULL""",
    "html_markdown": rf"""
        WITH x AS (SELECT doc_id, {_strip(f"regexp_replace(coalesce(source, ''), '{_WS}+', ' ', 'g')")} AS h, {_strip(f"regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')")} AS p FROM documents)
        SELECT doc_id || '.html' AS file_name, concat_ws(chr(10) || chr(10), CASE WHEN h <> '' THEN '# ' || h END, CASE WHEN p <> '' THEN p END) AS markdown FROM x""",
    "md_lines": f"{_LINES} SELECT load_id, pos, line FROM ln",
    "md_headings": f"{_HEAD} SELECT load_id, pos, level, title FROM hd",
    "breadcrumbs": f"{_HEAD} SELECT load_id, pos, breadcrumb FROM crumb",
    "md_blocks": f"{_BLOCKS} SELECT load_id, block, breadcrumb, body FROM blk",
    "propagate_headers": f"""{_BLOCKS} SELECT d.load_id, coalesce(string_agg(CASE WHEN NOT is_head AND breadcrumb <> '' AND body <> '' THEN '**[Context: ' || breadcrumb || ']**' || chr(10) || body ELSE body END, chr(10) || chr(10) ORDER BY block), '') AS markdown
        FROM (SELECT DISTINCT load_id FROM loaded_docs WHERE markdown_content IS NOT NULL) d LEFT JOIN blk ON blk.load_id = d.load_id GROUP BY d.load_id""",
    "md_segments": f"{_SEGMENTS} SELECT load_id, segment, is_table, body FROM kept",
    "md_tables": f"{_SEGMENTS} SELECT load_id, table_no, body FROM tab",
    "table_columns": f"{_SEGMENTS} SELECT load_id, table_no, array_to_string({_columns('body')}, '|') AS columns FROM tab",
    "table_summary": f"{_SEGMENTS} SELECT load_id, table_no, 'Table with columns ' || array_to_string({_columns('body')}, ', ') || '; ' || (len(list_filter(string_split(body, chr(10)), lambda x: {_strip('x')} <> '')) - 2) || ' rows.' AS summary FROM tab",
    "has_code_block": "SELECT row_id, coalesce(contains(raw_payload, '```'), false) AS has_code_block FROM chunks",
    "chunk_metadata": f"""SELECT row_id, metadata.file_name AS file_name, coalesce(metadata.is_table_summary, false) AS is_table, CASE WHEN metadata.is_table_summary THEN 'table summary' ELSE 'text' END AS chunk_type,
        CASE WHEN metadata.is_table_summary THEN array_to_string({_columns(_strip('raw_payload'))}, '|') END AS columns FROM chunks""",
    "hash_embedding": r"""
        WITH w AS (SELECT row_id, unnest(string_split_regex(lower(content_to_embed), '[^\pL\pN]+')) AS w FROM chunks),
        h AS (SELECT row_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w WHERE w <> ''),
        s AS (SELECT row_id, ((h // 2) % 64)::INT AS slot, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY ALL),
        n AS (SELECT row_id, sqrt(sum(x * x)) AS n FROM s GROUP BY row_id)
        SELECT row_id, slot, round(x / n, 9) AS weight FROM s JOIN n USING (row_id) WHERE x <> 0""",
    "cosine_pairs": """WITH c AS (SELECT chunk_id, row_id, embedding::DOUBLE[] AS v FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
        SELECT chunk_id, a.row_id AS id_a, b.row_id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM c a JOIN c b USING (chunk_id) WHERE a.row_id < b.row_id""",
    "vector_topk": f"{_HITS} SELECT query_id, id, rank, round(score, 6) AS score FROM hits",
    "grade_relevance": f"{_HITS} SELECT query_id, id, score >= 0.6 AS relevant FROM hits",
    "route": f"{_HITS} SELECT query_id, round(best, 6) AS best, relevant, CASE WHEN relevant > 0 THEN 'generate' ELSE 'fallback' END AS route FROM rt",
    "fallback_union": f"""{_HITS},
        sec AS (SELECT q.id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 9) AS score FROM v q JOIN rt ON rt.query_id = q.id AND rt.relevant = 0, embeddings e WHERE len(e.embedding) = 64),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sec QUALIFY rank <= 5)
        SELECT query_id, 'primary' AS origin, id, rank FROM hits WHERE score >= 0.6 UNION ALL SELECT query_id, 'secondary', id, rank FROM best""",
    "context_assembly": f"{_HITS} SELECT query_id, count(*) AS parts, string_agg(raw_payload, chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN chunks ON row_id = id WHERE score >= 0.6 GROUP BY query_id",
    "gate_load": f"""WITH f AS (SELECT DISTINCT file_name FROM disk_files WHERE {_ACCEPT}), l AS (SELECT DISTINCT file_name FROM loaded_docs WHERE markdown_content IS NOT NULL), a AS (SELECT file_name, max(attempt) AS n FROM pipeline_errors WHERE stage = 'load' GROUP BY 1),
        c AS (SELECT count(*) AS files, count(l.file_name) AS loaded, count(*) FILTER (l.file_name IS NULL AND coalesce(a.n, 0) < 3) AS retryable FROM f LEFT JOIN l USING (file_name) LEFT JOIN a ON a.file_name = f.file_name)
        SELECT *, CASE WHEN retryable > 0 THEN 'retry' WHEN loaded = 0 THEN 'exit' ELSE 'split' END AS decision FROM c""",
    "gate_chunks": """WITH n AS (SELECT count(*) AS chunks, count(*) FILTER (trim(coalesce(content_to_embed, '')) = '' OR (coalesce(metadata.is_table_summary, false) AND length(trim(content_to_embed)) < 10)) AS malformed FROM chunks)
        SELECT *, CASE WHEN chunks = 0 OR malformed > 0 THEN 'retry' ELSE 'embed' END AS decision FROM n""",
    "gate_embeddings": "WITH n AS (SELECT count(*) AS chunks, count(embedding) AS embedded FROM chunks) SELECT *, CASE WHEN chunks = 0 OR embedded < chunks THEN 'retry' ELSE 'index' END AS decision FROM n",
    "chunks_per_file": "SELECT d.file_name, d.content_hash, count(c.row_id) AS chunk_count FROM disk_files d LEFT JOIN chunks c ON c.metadata.file_name = d.file_name GROUP BY ALL",
    "error_report": "SELECT coalesce(stage, 'unknown') AS stage, error_file, function_name, count(*) AS errors, count(DISTINCT file_name) AS files, max(occurred_at) AS last_at FROM pipeline_errors GROUP BY ALL",
}
