"""The SQL of the queries of `source_queries`."""

from __future__ import annotations

_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_STATUS = r"coalesce(nullif(lower(regexp_replace(status, '^\s+|\s+$', '', 'g')), ''), 'todo')"
_FIRST = f"f AS (SELECT *, {_STATUS} AS st, row_number() OVER (PARTITION BY url ORDER BY file_id) AS rn, row_number() OVER (PARTITION BY url ORDER BY file_id DESC) AS back FROM files WHERE url IS NOT NULL)"


def _m(v: str) -> str:
    return f"CASE WHEN length({v}) <= 4 THEN left({v}, 1) || repeat('*', length({v}) - 1) WHEN length({v}) <= 8 THEN left({v}, 1) || repeat('*', length({v}) - 2) || right({v}, 1) ELSE left({v}, 2) || repeat('*', length({v}) - 4) || right({v}, 2) END"


_N = "lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0')"
_G = "'00000000-0000-0000-0000-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')"

SQL: dict[str, str] = {
    "announcement_fields": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN trim(p_name) END AS titel, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'tweede' ELSE 'https://d.example/' || p_partkey END AS pdf_url FROM part",
    "module_menu": "SELECT n_regionkey, array_to_string(list(lower(n_name) ORDER BY n_name), ',') || CASE WHEN bool_or(n_name = 'KENYA') THEN '' ELSE ',kenya' END AS modules FROM nation GROUP BY n_regionkey",
    "item_links": "SELECT 'https://s.example/m/' || p_partkey || '/' AS base, CASE WHEN p_partkey % 7 > 0 THEN unnest(CASE WHEN p_partkey % 7 = 0 THEN ['x'] WHEN p_partkey % 3 = 0 THEN ['https://s.example/g/showannex/' || p_partkey || '.docx'] ELSE ['https://s.example/g/showannex/' || p_partkey || '.docx', 'https://s.example/m/' || p_partkey || '/f/showdoc/' || p_partkey || '.PDF?x=1'] END) END AS url, p_partkey % 7 = 0 AS mislukt FROM part",
    "meeting_levels": "SELECT l_orderkey || '-' || n AS doc_id, 'https://r.example/' || l_orderkey || '/' || n AS url, CASE WHEN n % 2 = 0 THEN 'docx' ELSE 'pdf' END AS ext, CASE WHEN n % 3 = 0 THEN flag ELSE 'stuk' || n || CASE WHEN n % 2 = 0 THEN '.DOCX' ELSE '' END END AS titel, r_name AS agendatype, '2024-05-06' AS vergaderdatum, CASE WHEN n <= 2 THEN 'vergadering' WHEN n <= 4 THEN 'agendapunt 3' ELSE 'lijstitem' END AS niveau, n = 4 AS vertrouwelijk FROM (SELECT l_orderkey, l_linenumber AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL) LEFT JOIN region ON r_regionkey = l_orderkey % 3 AND l_orderkey % 3 > 0 WHERE n < 7",
    "portal_pages": f"SELECT 'https://p.example/api-public/document/' || {_G} AS url, CASE WHEN p_partkey % 2 = 0 THEN 'xlsx' ELSE 'pdf' END AS ext, CASE WHEN p_partkey % 3 > 0 THEN 'Plan ' || p_brand || ' - ' ELSE '' END || 'kaart ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.XLSX' ELSE '' END AS titel, {_G} AS doc_id FROM part",
    "paged_search": "SELECT r_name AS slice, 'https://d.example/' || replace(n_name, ' ', '_') AS url, n_name AS titel FROM nation JOIN region ON n_regionkey = r_regionkey",
    "decoded_files": "SELECT n_nationkey || '.docx' AS path, 'ok' AS status, 0 AS i, 'document' AS loc, n_name || chr(10) || n_nationkey || ' | b' AS tekst FROM nation UNION ALL SELECT n_nationkey || '.pptx', 'ok', k, 'dia ' || (k + 1), n_name || ' ' || [2, 10][k + 1] FROM nation, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT n_nationkey || '.pdf', 'ok', k, 'pagina ' || (k + 1), [n_name, CAST(n_nationkey AS VARCHAR)][k + 1] FROM nation, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT n_nationkey || '.xlsx', 'unreadable', NULL, NULL, NULL FROM nation",
    "redacted": f"SELECT c_custkey, 'mail ' || {_m('a')} || ' of bel ' || {_m('n')} || ', kamer ' || c_custkey % 1000 AS tekst FROM (SELECT c_custkey, 'klant' || c_custkey || '@post.example' AS a, {_N} AS n FROM customer)",
    "hidden_sheet_findings": f"SELECT c_custkey, 'Verborgen tabblad' AS soort, 'Middel' AS ernst, {_m('c_mktsegment')} AS waarde_masked FROM customer WHERE c_custkey % 3 = 0",
    "email_by_chunk": f"""WITH c AS (SELECT rij_id, unnest(list_filter(chunks, lambda x: length(x.text) > 0)) AS c FROM bron_document),
t AS (SELECT rij_id, c.idx AS chunk_idx, coalesce(c.loc, '') AS locatie, c.text AS text FROM c
UNION ALL SELECT rij_id, 0, 'document', text FROM bron_document WHERE length(text) > 0 AND rij_id NOT IN (SELECT rij_id FROM c)
UNION ALL SELECT rij_id, 2147483647, 'metadata', array_to_string(list_transform(list_sort(list_filter(map_entries(meta), lambda e: e.value <> '')), lambda e: e.key || ': ' || e.value), chr(10)) FROM bron_document)
SELECT rij_id, chunk_idx, locatie, CAST(sum(len(regexp_extract_all(text, '{_EMAIL}'))) AS BIGINT) AS n FROM t GROUP BY ALL HAVING n > 0""",
    "stream_email": f"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}')) AS n FROM documents WHERE len(regexp_extract_all(text, '{_EMAIL}')) > 0",
    "robots_gate": r"SELECT file_id, NOT coalesce(length(h) > 0 AND length(h) % 2 = 0 AND starts_with(p, '/d') AND NOT starts_with(p, '/documenten'), false) AS mag FROM (SELECT file_id, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:\d+$', '', 'g')) AS h, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) AS p FROM files)",
    "manifest_marked": f"WITH {_FIRST} SELECT a.url, a.file_id, coalesce(CASE WHEN b.rn > 1 THEN b.sha256 END, a.sha256) AS sha256, coalesce(CASE WHEN b.rn > 1 THEN b.local_path END, a.local_path) AS local_path, coalesce(CASE WHEN b.rn > 1 THEN b.note END, a.note) AS note, b.st AS status FROM f a JOIN f b ON a.url = b.url AND a.rn = 1 AND b.back = 1",
    "manifest_claimed": f"WITH {_FIRST} SELECT url, 'busy' AS status FROM f WHERE rn = 1 AND st = 'todo'",
    "manifest_requeued": f"WITH {_FIRST} SELECT CASE WHEN st = 'busy' THEN 'todo' ELSE st END AS toestand, count(*) AS n FROM f WHERE rn = 1 GROUP BY ALL",
    "manifest_migrated": "SELECT file_id, url, CAST(NULL AS VARCHAR) AS titel, CAST(NULL AS VARCHAR) AS herkomst FROM files",
    "document_split": "SELECT bron, count(*) AS n, CASE WHEN text IS NOT NULL OR coalesce(len(chunks), 0) > 0 THEN 'tekst' WHEN url IS NOT NULL THEN 'adres' ELSE 'geen' END AS deel FROM bron_document GROUP BY ALL",
    "report_shown": "SELECT finding_id, regexp_extract(local_path, '([^/]*)$', 1) AS local_path, ernst FROM findings WHERE ernst NOT IN ('Middel', 'Laag')",
    "text_digest": "SELECT doc_id, sha256(text) AS sha256, true AS heen_en_terug FROM documents",
    "number_tables": r"SELECT o_orderkey, (d >= 12 AND l <= d * 0.25 AND (contains(t, ',') OR contains(t, '%') OR len(regexp_extract_all(t, '\.')) >= 2)) OR (d >= 18 AND l <= d * 0.15) AS tabel FROM (SELECT o_orderkey, t, len(regexp_extract_all(t, '\d')) AS d, len(regexp_extract_all(t, '[A-Za-z]')) AS l FROM (SELECT o_orderkey, o_orderkey || ' ' || CAST(o_totalprice AS DECIMAL(12, 2)) || ' ' || o_custkey || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN '9.876.543,00' ELSE o_orderpriority END AS t FROM orders))",
    "retry_waits": "SELECT r_regionkey AS poging, s AS toestand, g AS gevraagd, greatest(CASE g WHEN '60' THEN 60 WHEN '5000' THEN 900 ELSE 0 END, CASE WHEN s = 429 THEN [300, 600, 900, 900, 900][r_regionkey + 1] ELSE [5, 15, 45, 120, 120][r_regionkey + 1] END) AS wacht FROM region, (SELECT unnest([429, 503]) AS s), (SELECT unnest([NULL, '60', '5000', 'Wed']) AS g)",
}
