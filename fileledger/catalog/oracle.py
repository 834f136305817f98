"""The same queries in SQL for DuckDB, written on their own over the same tables."""

from __future__ import annotations

# Fixed values, as in `inputs`.
_SUFFIXES = (
    "['.txt', '.csv', '.json', '.log', '.tmp', '.bak', '.old', '.temp', "
    "'.swp', '.swo', '.txt~', '', '.pdf', '.jpeg', '.md', '.TXT']"
)
_STATES = "['pending', 'queued', 'running', 'done', 'error', 'retry']"


def _files(shared_names: bool = False) -> str:
    number = "CAST(doc_id AS VARCHAR)"
    if shared_names:
        name = f"""lang || CASE WHEN doc_id % 5 = 0
           THEN {_SUFFIXES}[(doc_id + 1) % 16 + 1] || '_' || CAST(doc_id + 1 AS VARCHAR)
           ELSE raw_ext END"""
        path = f"'/' || source || '/' || {number} || '/' || {name}"
    else:
        path = f"'/' || source || '/' || lang || '/' || {number} || raw_ext"
        name = f"{number} || raw_ext"
    return f"""
raw AS (
  SELECT *, {_SUFFIXES}[doc_id % 16 + 1] AS raw_ext
  FROM (
    SELECT doc_id, source, lang, text AS content FROM documents
    UNION ALL
    SELECT doc_id + 1000000000, source, lang, '' FROM documents WHERE doc_id % 50 = 0
  )
),
named AS (
  SELECT doc_id AS file_id, source, lang, content, {path} AS path, {name} AS name,
         CAST(octet_length(encode(content)) AS BIGINT) AS size, sha256(content) AS sha256,
         TIMESTAMP '2020-01-01' + to_days(CAST(doc_id * 7919 % 2000 AS INTEGER))
           + to_seconds(doc_id * 31 % 86400)
           + to_microseconds(CAST(doc_id % 4 * 250000 AS BIGINT)) AS started
  FROM raw
),
dated AS (
  SELECT *, CASE WHEN file_id % 37 <> 0 THEN started END AS created,
         started + to_days(CAST(file_id % 300 AS INTEGER)) AS modified
  FROM named
),
files AS (
  SELECT *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext,
         CASE WHEN file_id % 29 <> 0
              THEN modified + to_days(CAST(file_id * 13 % 400 AS INTEGER)) END AS accessed,
         CAST(json_object('titulo', content,
                          'tags', json_object('source', source, 'lang', lang),
                          'linhas', len(string_split(content, chr(10)))) AS VARCHAR) AS metadata
  FROM dated
)"""


_LEDGER = f"""
ledger AS (
  SELECT doc_id * 2 + k AS work_id,
         CASE WHEN doc_id % 40 = 3 THEN -doc_id ELSE doc_id END AS file_id,
         CASE k WHEN 0 THEN 'hash' ELSE 'analyze' END AS kind,
         {_STATES}[(doc_id + 2 * k) % 6 + 1] AS status,
         0 AS priority,
         CAST((doc_id // 6 + k) % 4 AS INTEGER) AS attempts,
         3 AS max_attempts
  FROM documents, (VALUES (0), (1)) AS kinds(k)
),
tiers AS (
  SELECT doc_id AS file_id, octet_length(encode(text)) * (1 + doc_id % 5 * 500) AS size
  FROM documents
)"""

_TIER = """CAST(CASE WHEN size < 1024 THEN 100 WHEN size < 1048576 THEN 50
     WHEN size < 10485760 THEN 10 ELSE 1 END AS INTEGER)"""


def _copies(min_size: int = 0) -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY created NULLS FIRST, file_id) AS place
  FROM files
),
groups AS (
  SELECT sha256,
         count(*) FILTER (WHERE size >= {min_size}) AS "count",
         CAST(sum(size) FILTER (WHERE size >= {min_size}) AS BIGINT) AS total_size,
         count(*) AS members,
         max(CASE WHEN place = 1 THEN size END) AS keeper_size,
         max(CASE WHEN place = 1 THEN file_id END) AS keeper_id,
         max(CASE WHEN place = 1 THEN path END) AS keeper_path
  FROM ranked GROUP BY sha256
  HAVING count(*) FILTER (WHERE size >= {min_size}) > 1
)"""


def _groups_sql(min_size: int) -> str:
    return f"""WITH {_files()}, {_copies(min_size)}
SELECT sha256, "count", total_size, total_size - keeper_size AS wasted_size, keeper_id, keeper_path,
       'Keep oldest: ' || keeper_path AS suggestion
FROM groups ORDER BY total_size DESC, sha256"""


_REMOVABLE = "removable AS (SELECT r.* FROM ranked r JOIN groups USING (sha256) WHERE place > 1)"

_TEXT = """len(string_split({t}, chr(10))) AS linhas, length({t}) AS caracteres,
  NOT regexp_matches({t}, '[^\\s]') AS vazio"""

_GATE = """CASE
  WHEN size > 16384 THEN 'file too large'
  WHEN ext NOT IN ('.pdf', '.docx', '.xlsx', '.pptx', '.txt', '.jpg', '.png', '.mp3', '.mp4')
    THEN 'extension ' || ext || ' not in analysis list' END"""

# Media types of the suffixes handed out; the others have none.
_MIMES = (
    "('.txt', 'text/plain'), ('.csv', 'text/csv'), ('.json', 'application/json'), "
    "('.pdf', 'application/pdf'), ('.jpeg', 'image/jpeg'), ('.md', 'text/markdown')"
)


def _plan(shared_names: bool = False) -> str:
    return f"""
{_files(shared_names)}, {_copies()}, {_REMOVABLE}, {_LEDGER},
present AS (
  SELECT path FROM files
  WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
),
wanted AS (
  SELECT file_id FROM removable
  UNION SELECT file_id FROM ledger WHERE file_id < 0
),
judged AS (
  SELECT w.file_id, f.path, f.name,
         CASE WHEN f.path IS NULL THEN 'not found'
              WHEN p.path IS NULL THEN 'file not found' END AS reason
  FROM wanted w LEFT JOIN files f USING (file_id) LEFT JOIN present p ON p.path = f.path
),
plan AS (
  SELECT file_id, path,
         CASE WHEN reason IS NULL AND count(*) OVER (PARTITION BY reason, name) > 1
              THEN '/quarantine/20260101_000000_same/' || CAST(file_id AS VARCHAR) || '/' || name
              WHEN reason IS NULL THEN '/quarantine/20260101_000000/' || name END AS destination,
         CASE WHEN reason IS NULL THEN 'moved' ELSE 'skipped' END AS action,
         reason
  FROM judged
),
returned AS (
  SELECT path, name FROM files WHERE file_id IN (SELECT doc_id FROM labels WHERE quality = 1)
)"""


_OUTCOMES = f"""{_LEDGER},
folded AS (
  SELECT work_id,
         CASE WHEN status <> 'running' THEN status
              WHEN file_id < 0 OR abs(file_id) % 5 = 0
                THEN CASE WHEN attempts + 1 >= max_attempts THEN 'error' ELSE 'retry' END
              ELSE 'done' END AS status,
         CASE WHEN status = 'running' AND (file_id < 0 OR abs(file_id) % 5 = 0)
              THEN attempts + 1 ELSE attempts END AS attempts,
         CASE WHEN status <> 'running' THEN NULL
              WHEN file_id < 0 THEN 'File not found in database'
              WHEN abs(file_id) % 5 = 0 THEN 'failed' END AS error,
         CASE WHEN status = 'running' THEN TIMESTAMP '2026-01-01' END AS finished_at,
         status = 'running' AS ran
  FROM ledger
)"""

_SEARCH = """WITH {files}
SELECT file_id, path, name, ext, size, metadata FROM files
WHERE EXISTS (SELECT 1 FROM json_tree(files.metadata) AS t
              WHERE t.type = 'VARCHAR' AND t.atom ->> '$' LIKE '%{keyword}%')
ORDER BY path"""

ORACLE: dict[str, str] = {
    "content_hash": f"WITH {_files()} SELECT file_id, path, sha256 FROM files",
    "results_by_range": f"""WITH {_files()}
SELECT file_id, path, CASE WHEN file_id IN (SELECT doc_id FROM labels) THEN sha256 END AS sha256 FROM files""",
    "files_on_disk": f"""WITH {_files()}
SELECT file_id, size, sha256, CAST(NULL AS VARCHAR) AS error FROM files WHERE size >= 4096""",
    "copies_on_disk": f"""WITH {_files()}
SELECT file_id, sha256, copies
FROM (SELECT file_id, sha256, count(*) OVER (PARTITION BY sha256) AS copies FROM files) WHERE copies > 1""",
    "text_stats": f"SELECT doc_id, {_TEXT.format(t='text')} FROM documents",
    "text_stats_pages": f"SELECT page_id, {_TEXT.format(t='html')} FROM pages",
    "text_stats_conversations": (
        f"SELECT conv_id, turn, {_TEXT.format(t='text')} FROM conversations"
    ),
    "files_left": f"""WITH {_files()}
SELECT file_id, path, size FROM files WHERE file_id NOT IN (SELECT doc_id FROM labels)""",
    "metadata_gate": f"""WITH {_files()}, gated AS (SELECT *, {_GATE} AS reason FROM files)
SELECT file_id,
       CASE WHEN reason IS NOT NULL THEN NULL WHEN ext = '.txt' THEN 'text' ELSE 'pdf' END
         AS extractor,
       CASE WHEN reason IS NOT NULL THEN CAST(json_object('skipped', reason) AS VARCHAR) END AS skip
FROM gated""",
    "metadata_documents": f"""WITH {_files()},
gated AS (SELECT *, {_GATE} AS reason, {_TEXT.format(t='content')} FROM files)
SELECT file_id,
       CAST(CASE WHEN reason IS NOT NULL THEN json_object('skipped', reason)
            WHEN ext = '.txt'
              THEN json_object('linhas', linhas, 'caracteres', caracteres, 'vazio', vazio)
            ELSE json_object('erro', 'no extractor installed for pdf') END AS VARCHAR) AS metadata
FROM gated""",
    "duplicate_groups": _groups_sql(0),
    "duplicate_groups_min_size": _groups_sql(1024),
    "duplicate_members": f"""WITH {_files()}, {_copies()}
SELECT sha256, file_id, path, name, size, created, modified, place = 1 AS is_keeper
FROM ranked JOIN groups USING (sha256)
ORDER BY total_size DESC, sha256, created NULLS FIRST, file_id""",
    "merged_results": f"""WITH {_files()} SELECT file_id, path, sha256, metadata FROM files""",
    "next_work_batch_large": f"""WITH {_LEDGER},
queued AS (
  SELECT work_id, l.file_id, CASE WHEN work_id % 7 = 0 THEN NULL ELSE kind END AS kind,
         CASE WHEN work_id % 11 = 0 THEN NULL WHEN size IS NOT NULL THEN {_TIER} ELSE priority END AS priority
  FROM ledger l LEFT JOIN tiers USING (file_id)
  WHERE status IN ('pending', 'queued') OR (status = 'retry' AND attempts < max_attempts)
)
SELECT * FROM queued
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY priority DESC NULLS LAST, work_id) <= 2000""",
    "duplicate_report": f"""WITH {_files()}, {_copies()},
paged AS (
  SELECT *, (place - 1) // 16 AS page FROM ranked JOIN groups USING (sha256)
)
SELECT sha256, CAST(page AS BIGINT) AS page,
       CASE WHEN page = 0 THEN "count" END AS "count",
       CASE WHEN page = 0 THEN total_size END AS total_size,
       CASE WHEN page = 0 THEN total_size - keeper_size END AS wasted_size, keeper_id,
       string_agg(CAST(file_id AS VARCHAR) || '|' || path || '|' || name || '|' || size || '|'
         || coalesce(CAST(epoch_us(created) AS VARCHAR), '') || '|' || epoch_us(modified), ','
         ORDER BY created NULLS FIRST, file_id) AS files,
       CASE WHEN page = 0 THEN 'Keep oldest: ' || keeper_path END AS suggestion
FROM paged GROUP BY sha256, page, "count", total_size, keeper_size, keeper_id, keeper_path""",
    "duplicate_numbers": f"""WITH {_files()}, {_copies()}
SELECT sha256, place AS number, file_id, path FROM ranked JOIN groups USING (sha256)""",
    "report_items_of_duplicates": f"""WITH {_files()}, {_copies()}, {_REMOVABLE}
SELECT file_id, path, size FROM removable""",
    "files_sharing_a_size": f"""WITH {_files()}
SELECT file_id, path, size FROM files
WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)""",
    "large_files": f"""WITH {_files()}
SELECT file_id, path, name, ext, size, round_even(size / 1048576.0, 2) AS size_mb, modified
FROM files WHERE size >= 8192 ORDER BY size DESC, file_id""",
    "old_files": f"""WITH {_files()}
SELECT file_id, path, name, size, accessed, modified,
       CAST(floor((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(accessed)) / 86400000000.0)
            AS INTEGER) AS days_idle
FROM files WHERE accessed < TIMESTAMP '2026-01-01' - INTERVAL 365 DAY
ORDER BY accessed, file_id""",
    "temp_files": f"""WITH {_files()}
SELECT file_id, path, name, ext, size, modified FROM files
WHERE ext LIKE '%.tmp' OR ext LIKE '%.bak' OR ext LIKE '%.old' OR ext LIKE '%.log'
   OR ext LIKE '%.temp' OR ext LIKE '%.swp' OR ext LIKE '%.swo' OR ext LIKE '%~'
ORDER BY size DESC, file_id""",
    "empty_files": f"""WITH {_files()}
SELECT file_id, path, name, ext, modified FROM files WHERE size = 0 ORDER BY path""",
    "metadata_search": _SEARCH.format(files=_files(), keyword="src1"),
    "metadata_search_wildcard": _SEARCH.format(files=_files(), keyword="_ation%,"),
    "file_suffix": f"WITH {_files()} SELECT file_id, name, ext FROM files",
    "iso_times": """WITH events AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END AS ts
  FROM events)
SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0
    THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS "at"
FROM events""",
    "url_suffix": """WITH named AS (
  SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS name FROM pages)
SELECT page_id, name, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM named""",
    "mime_type": f"""WITH {_files()}, mimes AS (
  SELECT * FROM (VALUES {_MIMES}) AS known(mime_ext, mime_type))
SELECT file_id, name, coalesce(mime_type, 'application/octet-stream') AS mime
FROM files LEFT JOIN mimes ON mime_ext = ext""",
    "attribute_flags": """SELECT doc_id, coalesce(nullif(concat_ws(',',
    CASE WHEN doc_id & 1 <> 0 THEN 'readonly' END, CASE WHEN doc_id & 2 <> 0 THEN 'hidden' END,
    CASE WHEN doc_id & 4 <> 0 THEN 'system' END, CASE WHEN doc_id & 32 <> 0 THEN 'archive' END),
    ''), 'normal') AS attrs
FROM documents""",
    "parse_size": """SELECT doc_id, CAST(trunc(CASE doc_id % 8
    WHEN 0 THEN CAST(n_chars AS DOUBLE) WHEN 1 THEN CAST(n_chars AS DOUBLE)
    WHEN 2 THEN (n_chars + 0.5) * 1024.0 WHEN 3 THEN n_chars * 1048576.0
    WHEN 4 THEN n_chars * 1073741824.0 WHEN 5 THEN (n_chars + 0.25) * 1099511627776.0 END) AS BIGINT)
  AS bytes
FROM documents""",
    "scan_inventory": f"""WITH {_files()}, mimes AS (
  SELECT * FROM (VALUES {_MIMES}) AS known(mime_ext, mime_type))
SELECT path, name, ext, size, created, modified, accessed,
       coalesce(nullif(concat_ws(',',
         CASE WHEN file_id & 1 <> 0 THEN 'readonly' END, CASE WHEN file_id & 2 <> 0 THEN 'hidden' END,
         CASE WHEN file_id & 4 <> 0 THEN 'system' END,
         CASE WHEN file_id & 32 <> 0 THEN 'archive' END), ''), 'normal') AS attrs,
       'unknown' AS owner, coalesce(mime_type, 'application/octet-stream') AS mime
FROM files LEFT JOIN mimes ON mime_ext = ext""",
    "resume_new_files": f"""WITH {_files()}, known AS (
  SELECT path FROM files WHERE file_id IN (SELECT doc_id FROM labels))
SELECT path, name, ext, size FROM files
WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.path = files.path)""",
    "rejected_files": f"""WITH {_files()}
SELECT path || '+' AS path, CASE file_id % 30 WHEN 0 THEN 'not a regular file'
       WHEN 10 THEN 'symbolic link' ELSE 'Permission denied' END AS reason
FROM files WHERE file_id % 10 = 0""",
    "append_twice": f"""WITH {_files()}, known AS (
  SELECT path FROM files WHERE file_id IN (SELECT doc_id FROM labels)),
added AS (SELECT * FROM files WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.path = files.path))
SELECT path, 1 AS times FROM added""",
    "scan_totals": f"""WITH {_files()}
SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM files""",
    "refresh_inventory": f"""WITH {_files()}
SELECT file_id, path, size FROM files
WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "work_fan_out": f"""WITH {_files()}
SELECT file_id * 2 + k AS work_id, file_id,
       CASE k WHEN 0 THEN 'hash' ELSE 'analyze' END AS kind, 'pending' AS status, 0 AS priority,
       0 AS attempts, 3 AS max_attempts, TIMESTAMP '2026-01-01' AS created_at
FROM files, (VALUES (0), (1)) AS kinds(k)
WHERE file_id NOT IN (SELECT doc_id FROM labels)""",
    "missing_work": f"""WITH {_files()}, {_LEDGER}
SELECT f.file_id * 2 + k AS work_id, f.file_id,
       CASE k WHEN 0 THEN 'hash' ELSE 'analyze' END AS kind, 'pending' AS status
FROM files f, (VALUES (0), (1)) AS kinds(k)
WHERE f.file_id NOT IN (SELECT file_id FROM ledger)""",
    "size_tier_priority": f"""WITH {_LEDGER}
SELECT work_id, l.file_id, kind, status,
       CASE WHEN status = 'queued' AND size IS NOT NULL THEN {_TIER} ELSE priority END AS priority,
       status = 'queued' AND size IS NOT NULL AS changed
FROM ledger l LEFT JOIN tiers USING (file_id)""",
    "next_work_batch": f"""WITH {_LEDGER},
queued AS (
  SELECT work_id, l.file_id, kind,
         CASE WHEN size IS NOT NULL THEN {_TIER} ELSE priority END AS priority
  FROM ledger l LEFT JOIN tiers USING (file_id)
  WHERE status IN ('pending', 'queued') OR (status = 'retry' AND attempts < max_attempts)
)
SELECT * FROM queued
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY priority DESC, work_id) <= 100""",
    "ledger_advance": f"""WITH {_LEDGER},
judged AS (
  SELECT *, status = 'retry' AND attempts < max_attempts AS again FROM ledger)
SELECT work_id, kind, CASE WHEN status = 'pending' OR again THEN 'queued' ELSE status END AS status,
       CASE WHEN again THEN attempts + 1 ELSE attempts END AS attempts,
       status = 'pending' OR again AS changed
FROM judged""",
    "ledger_changes": f"""WITH {_LEDGER}
SELECT count(*) AS changed FROM ledger
WHERE status = 'pending' OR (status = 'retry' AND attempts < max_attempts)""",
    "work_left": f"""WITH {_LEDGER}
SELECT work_id, kind, status FROM ledger
WHERE status IN ('pending', 'queued', 'running') OR (status = 'retry' AND attempts < max_attempts)""",
    "ledger_outcomes": f"""WITH {_OUTCOMES}
SELECT work_id, status, attempts, error, finished_at FROM folded""",
    "ledger_outcome_totals": f"""WITH {_OUTCOMES}
SELECT count(*) FILTER (WHERE status = 'done') AS processed,
       count(*) FILTER (WHERE status <> 'done') AS errors
FROM folded WHERE ran""",
    "ledger_stats": f"""WITH {_LEDGER}
SELECT kind, status, count(*) AS items FROM ledger GROUP BY kind, status""",
    "ledger_stats_by_kind": f"""WITH {_LEDGER}
SELECT kind, count(*) FILTER (WHERE status = 'pending') AS pending,
       count(*) FILTER (WHERE status = 'queued') AS queued,
       count(*) FILTER (WHERE status = 'running') AS running,
       count(*) FILTER (WHERE status = 'done') AS done,
       count(*) FILTER (WHERE status = 'error') AS error,
       count(*) FILTER (WHERE status = 'retry') AS retry
FROM ledger GROUP BY kind""",
    "ledger_prune_orphans": f"""WITH {_LEDGER}
SELECT work_id, file_id, kind FROM ledger WHERE file_id IN (SELECT doc_id FROM documents)""",
    "quarantine_plan": f"WITH {_plan()} SELECT * FROM plan",
    "quarantine_plan_shared_names": f"WITH {_plan(shared_names=True)} SELECT * FROM plan",
    "quarantine_collisions": f"""WITH {_plan(shared_names=True)}
SELECT count(*) AS moved, count(DISTINCT destination) AS places FROM plan WHERE action = 'moved'""",
    "quarantine_totals": f"WITH {_plan()} SELECT action, count(*) AS files FROM plan GROUP BY action",
    "quarantine_list": f"""WITH {_plan()}
SELECT path AS original_path, destination AS quarantine_path,
       TIMESTAMP '2026-01-01' AS quarantine_date, file_id,
       destination IN (SELECT '/quarantine/20260101_000000/' || name FROM returned) AS "exists"
FROM plan WHERE action = 'moved'""",
    "restore_plan": f"""WITH {_plan()},
requests AS (SELECT '/quarantine/20260101_000000/' || name AS quarantine_path FROM removable)
SELECT quarantine_path, p.path AS original_path,
       CASE WHEN p.path IS NULL OR back.path IS NOT NULL THEN 'refused' ELSE 'restored' END AS action,
       CASE WHEN p.path IS NULL THEN 'Quarantine metadata not found'
            WHEN back.path IS NOT NULL THEN 'Original path already exists' END AS reason
FROM requests LEFT JOIN plan p ON p.destination = quarantine_path
LEFT JOIN returned back ON back.path = p.path""",
    "clean_plan": f"""WITH {_files()}, {_copies()}, {_REMOVABLE}
SELECT file_id, path, size, 'delete' AS action FROM removable""",
    "clean_totals": f"""WITH {_files()}, {_copies()}, {_REMOVABLE}
SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM removable""",
    "clean_preview": f"""WITH {_files()}, {_copies()}, {_REMOVABLE},
placed AS (SELECT path, row_number() OVER (ORDER BY path) AS line FROM removable)
SELECT CAST(line AS INTEGER) AS line, '  - ' || path AS text FROM placed WHERE line <= 10
UNION ALL
SELECT 11, '  ... and ' || CAST(count(*) - 10 AS VARCHAR) || ' more' FROM removable
HAVING count(*) > 10
ORDER BY 1""",
}
# The same rows, from tables that lie otherwise.
ORACLE |= {
    "resume_new_files_bucketed": ORACLE["resume_new_files"],
    "refresh_inventory_bucketed": ORACLE["refresh_inventory"],
    "report_items_of_array": ORACLE["report_items_of_duplicates"],
    "metadata_search_postings": ORACLE["metadata_search"],
    "metadata_search_postings_wildcard": ORACLE["metadata_search_wildcard"],
}
