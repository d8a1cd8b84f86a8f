"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from .sources.derive import ctes

STRIP = "regexp_replace(regexp_replace(regexp_replace({0}, ' - Scene.*', '', 'i'), ' - CD.*', '', 'i'), ' - Bonus.*| Bonus.*', '', 'i')"
STEM_TITLE = STRIP.format("stem")
NATURAL = r"regexp_replace(regexp_replace(lower({0}), '(\d+)', '000000000000\1', 'g'), '0+(\d{{12}})', '\1', 'g')"
LIBRARY_TITLE = r"CASE WHEN regexp_matches({0}, '^(.*?) # \d+ - .*$') THEN regexp_extract({0}, '^(.*? # \d+) - .*$', 1) WHEN regexp_matches({0}, '^(.*?) - Scene_\d+.*$') THEN regexp_extract({0}, '^(.*?) - Scene_\d+.*$', 1) ELSE {0} END"

SCANNED = "scanned AS (SELECT * FROM media_files WHERE lower(ext) IN ('mp4', 'mkv'))"
ROLLUP = f"rollup_ AS (SELECT lower(t) AS title_key, arg_min(t, path) AS title, CAST(sum(size) AS BIGINT) AS title_size, count(*) AS n_files, min(path) AS title_path FROM (SELECT *, {STEM_TITLE} AS t FROM scanned) x GROUP BY lower(t))"
PRESENCE = """presence AS (SELECT lower(split_part(title, ' # ', 1)) AS base_key, bool_or(NOT contains(title, ' # ')) AS has_unnumbered,
  count(DISTINCT CASE WHEN contains(title, ' # ') THEN lower(title) END) AS n_numbered FROM library GROUP BY 1)"""
MATCHED = rf"""first_ AS (SELECT lower(title) AS lib_key, arg_min(id, id) AS id, arg_min(filesize, id) AS lib_size, arg_min(dimensions, id) AS dimensions, arg_min(duration, id) AS duration FROM library GROUP BY 1),
t1 AS (SELECT *, {LIBRARY_TITLE.format('title')} AS db_title,
  CASE WHEN regexp_matches(title, '^(.*?)\s+#\s+\d+(\s+-\s+.*)?$') THEN regexp_extract(title, '^(.*?)\s+#\s+\d+(\s+-\s+.*)?$', 1) END AS b FROM rollup_),
t2 AS (SELECT *, lower(db_title) AS key, lower(coalesce(b, db_title)) AS base_key, b IS NOT NULL AS numbered FROM t1),
t3 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY title_path) > 1 AS in_batch FROM t2),
t4 AS (SELECT t3.*, id, lib_size, dimensions, duration, coalesce(has_unnumbered, false) AS hu, coalesce(n_numbered, 0) AS nn FROM t3 LEFT JOIN first_ ON key = lib_key LEFT JOIN presence USING (base_key)),
matched AS (SELECT title, db_title, title_size, id AS library_id, lib_size AS library_size,
  CASE WHEN lib_size > 0 AND lib_size < title_size THEN 'isLarger' WHEN lib_size = 0 AND title_size > 0 THEN 'isLargerZeroDBSize' ELSE '' END AS size_class,
  coalesce(id IS NOT NULL AND title_size > 0 AND lib_size < title_size, false) AS needs_update_size, hu AS has_unnumbered, nn > 0 AS has_numbered,
  (NOT numbered AND nn > 0) OR (numbered AND hu) OR (numbered AND nn - CASE WHEN id IS NOT NULL AND nn > 0 THEN 1 ELSE 0 END > 0) AS external_search,
  CASE WHEN id IS NOT NULL AND NOT in_batch AND (lower(trim(coalesce(dimensions, ''))) IN ('', '0 x 0') OR coalesce(duration, 0) = 0 OR coalesce(lib_size, 0) = 0) THEN 'fill_missing'
    WHEN id IS NOT NULL OR in_batch THEN 'duplicate' ELSE 'insert' END AS action FROM t4)"""
LIB = f"{ctes('media_files', 'library')}, {SCANNED}, {ROLLUP}, {PRESENCE}, {MATCHED}"

PROBED = rf"""{ctes('media_files', 'probe_raw', 'library')}, {SCANNED}, pr AS (SELECT path, CASE WHEN w > 0 AND h > 0 THEN concat(w, ' x ', h) ELSE '' END AS dimensions, d AS duration FROM (SELECT path, CAST(raw->>'$.streams[1].width' AS BIGINT) AS w, CAST(raw->>'$.streams[1].height' AS BIGINT) AS h, CAST(floor(CAST(raw->>'$.format.duration' AS DOUBLE)) AS BIGINT) AS d FROM probe_raw WHERE raw <> 'not json{{') z),
rp AS (SELECT lower(t) AS title_key, arg_min(t, path) AS title, CAST(sum(size) AS BIGINT) AS title_size, count(*) AS n_files, min(path) AS title_path, arg_min(coalesce(dimensions, ''), path) AS dimensions, CAST(sum(coalesce(duration, 0)) AS BIGINT) AS duration FROM (SELECT s.*, dimensions, duration, {STEM_TITLE} AS t FROM scanned s JOIN pr USING (path)) x GROUP BY 1)"""

SUFFIXED = "(SELECT *, CASE WHEN regexp_matches({0}, ' - Scene', 'i') THEN regexp_extract({0}, '^(.*?)( - Scene.*)$', 1, 'i') WHEN regexp_matches({0}, ' - CD', 'i') THEN regexp_extract({0}, '^(.*?)( - CD.*)$', 1, 'i') ELSE {0} END AS base_part FROM {1})"
NUMBER_PLAN = rf"""lib2 AS (SELECT * REPLACE (regexp_replace(title, 'brand#', 'brand ', 'gi') AS title) FROM library), roll2 AS (SELECT * REPLACE (regexp_replace(title, 'brand#', 'brand ', 'gi') AS title) FROM rollup_),
scan2 AS (SELECT * REPLACE (regexp_replace(stem, 'brand#', 'brand ', 'gi') AS stem) FROM scanned), bases AS (SELECT DISTINCT lower(split_part(title, ' # ', 1)) AS base_key FROM (SELECT title FROM lib2 UNION ALL SELECT title FROM roll2) u WHERE regexp_matches(title, ' # \d')),
nplan AS (SELECT id, title, concat(base_part, ' # 01', substr(title, length(base_part) + 1)) AS new_title FROM {SUFFIXED.format('title', 'lib2')} z
  WHERE NOT regexp_matches(title, '#\s*\d') AND lower(base_part) IN (SELECT base_key FROM bases))"""

SNAPSHOT = f"""kept_files AS (SELECT {STEM_TITLE} AS base, concat(stem, '.', ext) AS file, dir, size, mtime, drive FROM media_files WHERE lower(ext) <> 'txt' AND dir NOT LIKE '%/duplicates/%'),
snap AS (SELECT base, file, dir, size, mtime, false AS carried FROM kept_files WHERE drive <> '/vol2'
  UNION ALL SELECT base, file, dir, size, mtime, true FROM kept_files WHERE drive = '/vol2' AND mtime < TIMESTAMP '2000-01-01')"""
QUERIES_SQL = "asked AS (SELECT unnest(['brand#1', 'BOLT', 'scene_2', 'no such title']) AS query)"
FOUND = "found AS (SELECT * FROM snap JOIN asked ON contains(lower(base), lower(query)) OR contains(lower(file), lower(query)))"

PARSED = r"""parsed AS (SELECT *,
  CASE WHEN e THEN regexp_extract(stem, '^(.*?)\s+#\s+(\d+)((?:\s.*)?)$', 1) WHEN regexp_matches(stem, '\s*-\s*cd\s*\d+', 'i') THEN regexp_extract(stem, '^(.*?)\s*-\s*(cd\s*\d+)', 1, 'i')
    WHEN regexp_matches(stem, '\s*-\s*scene[_\s]*\d+', 'i') THEN regexp_extract(stem, '^(.*?)\s*-\s*(scene[_\s]*\d+)', 1, 'i') ELSE stem END AS base,
  CASE WHEN e THEN CAST(regexp_extract(stem, '^(.*?)\s+#\s+(\d+)((?:\s.*)?)$', 2) AS INT) END AS ep,
  CASE WHEN e THEN trim(regexp_extract(stem, '^(.*?)\s+#\s+(\d+)((?:\s.*)?)$', 3)) WHEN regexp_matches(stem, '\s-\s(CD|Scene)') THEN concat('- ', regexp_extract(stem, ' - ((CD|Scene).*)$', 1)) ELSE '' END AS variant
  FROM (SELECT *, regexp_matches(stem, '^(.*?)\s+#\s+(\d+)((?:\s.*)?)$') AS e FROM media_files) m)"""
BEST = (
    PARSED
    + r""",
eps AS (SELECT *, lower(base) AS base_key, trim(regexp_replace(lower(variant), '^[\s\-]+', ''), '_') AS vk FROM parsed WHERE lower(ext) <> 'txt' AND dir NOT LIKE '%/duplicates/%'),
flags AS (SELECT base_key, bool_or(ep IS NOT NULL) AS numbered, coalesce(bool_or(ep = 1 AND vk = ''), false) AS bare, coalesce(bool_or(ep = 1 AND vk <> ''), false) AS suffixed FROM eps GROUP BY 1),
marked AS (SELECT *, ep IS NULL AND vk = '' AND numbered AND NOT (suffixed AND NOT bare) AS rename_01, ep IS NULL AND vk = '' AND numbered AND suffixed AND NOT bare AS flagged FROM eps JOIN flags USING (base_key)),
keyed AS (SELECT *, CASE WHEN rename_01 THEN 'EP00001' WHEN ep IS NOT NULL THEN concat('EP', lpad(CAST(ep AS VARCHAR), 5, '0'), CASE WHEN vk <> '' THEN concat('__', vk) ELSE '' END) WHEN vk <> '' THEN concat('VAR__', vk) ELSE 'BASEONLY' END AS item_key FROM marked),
best AS (SELECT *, row_number() OVER (PARTITION BY base_key, item_key ORDER BY size DESC, mtime DESC, path) = 1 AS keep FROM keyed)"""
)
CONS = f"{ctes('media_files', 'drives')}, {BEST}"
SUMS = "sums AS (SELECT base_key, drive, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM best WHERE keep GROUP BY 1, 2)"
RANKS = f"""{SUMS}, totals AS (SELECT base_key, CAST(sum(bytes) AS BIGINT) AS group_bytes FROM sums GROUP BY 1),
ranks AS (SELECT t.base_key, d.drive, d.free_bytes, group_bytes, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes, row_number() OVER (PARTITION BY t.base_key ORDER BY coalesce(n, 0) DESC, coalesce(bytes, 0) DESC, d.free_bytes DESC, d.drive) AS rank
  FROM totals t CROSS JOIN drives d LEFT JOIN sums s ON s.base_key = t.base_key AND s.drive = d.drive)"""


SERIAL = f"""{RANKS}, sized AS (SELECT base_key, arg_min(base, path) AS display, sum(size) AS all_bytes FROM best GROUP BY 1),
lists AS (SELECT base_key, list(CAST(n AS BIGINT) ORDER BY drive) AS cs, list(CAST(bytes AS BIGINT) ORDER BY drive) AS zs, CAST(max(group_bytes) AS BIGINT) AS total FROM ranks GROUP BY 1),
g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {NATURAL.format('display')}, all_bytes DESC, base_key) AS i, base_key, cs, zs, total FROM lists JOIN sized USING (base_key)),
dn AS MATERIALIZED (SELECT list(drive ORDER BY drive) AS names, list(CAST(free_bytes AS BIGINT) ORDER BY drive) AS free, CAST(list_position(list(is_sink ORDER BY drive), true) AS BIGINT) AS sink FROM drives)"""


def _serial(drives: int, reserve: int) -> str:
    """One group after the other by recursion: free space and the homes of placed groups as lists. A group without a drive tries each, best first, after making room on it."""
    at = f"range(1, {drives + 1})"
    stage = f"""(SELECT i, base_key, zs, total, sink, rk, free, homes, list_filter(list_transform(range(1, {drives + 1}), lambda k: CASE WHEN free[rk[k].d] >= total - zs[rk[k].d] + {reserve} THEN k END), lambda k: k IS NOT NULL)[1] AS won
   FROM (SELECT g.*, sink, r.free, r.homes, list_sort(list_transform({at}, lambda d: {{'a': -cs[d], 'b': -zs[d], 'c': -r.free[d], 'd': d}})) AS rk FROM run r JOIN g ON g.i = r.i + 1, dn) a)"""
    stage = f"(SELECT i, base_key, zs, total, sink, rk, free, homes, won AS rank, rk[won].d AS d FROM {stage} b)"
    for k in range(1, drives + 1):
        todo = f"(SELECT *, rk[{k}].d AS t, total - zs[rk[{k}].d] + {reserve} AS required FROM {stage} c{k})"
        left = f"""(SELECT *, list_reduce([{{'m': CAST(0 AS BIGINT), 'p': CAST(0 AS BIGINT), 'need': CASE WHEN d IS NULL AND t <> sink THEN required - free[t] ELSE 0 END, 'room': free[sink] - {reserve}, 'gone': CAST([] AS BIGINT[])}}]
     || list_transform(list_sort(list_filter(homes, lambda h: d IS NULL AND h.d = t)), lambda h: {{'m': h.m, 'p': h.p, 'need': CAST(0 AS BIGINT), 'room': CAST(0 AS BIGINT), 'gone': CAST([] AS BIGINT[])}}),
     lambda s, x: CASE WHEN s.need > 0 AND -x.m <= s.room THEN {{'m': s.m + x.m, 'p': s.p, 'need': s.need + x.m, 'room': s.room + x.m, 'gone': list_append(s.gone, x.p)}} ELSE s END) AS z FROM {todo} e{k})"""
        moved = f"""(SELECT i, base_key, zs, total, sink, rk, d, rank, t, required, list_transform({at}, lambda e: free[e] + CASE WHEN e = t THEN -z.m WHEN e = sink THEN z.m ELSE 0 END) AS free,
     list_transform(homes, lambda h: CASE WHEN list_contains(z.gone, h.p) THEN {{'m': h.m, 'p': h.p, 'd': sink}} ELSE h END) AS homes FROM {left} f{k})"""
        stage = f"(SELECT i, base_key, zs, total, sink, rk, free, homes, CASE WHEN rank IS NULL AND free[t] >= required THEN {k + drives} ELSE rank END AS rank, CASE WHEN d IS NULL AND free[t] >= required THEN t ELSE d END AS d FROM {moved} h{k})"
    return f"""run AS (SELECT CAST(0 AS BIGINT) AS i, '' AS base_key, CAST(NULL AS BIGINT) AS d, CAST(NULL AS BIGINT) AS incoming, CAST(NULL AS BIGINT) AS rank, free, list_filter([{{'m': CAST(0 AS BIGINT), 'p': CAST(0 AS BIGINT), 'd': CAST(0 AS BIGINT)}}], lambda h: false) AS homes FROM dn
  UNION ALL SELECT i, base_key, d, total - zs[d], rank, CASE WHEN d IS NULL THEN free ELSE list_transform({at}, lambda e: free[e] + CASE WHEN e = d THEN zs[d] - total ELSE zs[e] END) END,
    CASE WHEN d IS NULL THEN homes ELSE list_append(homes, {{'m': -total, 'p': i, 'd': d}}) END FROM {stage} y),
ends AS (SELECT h.p AS i, h.d AS home FROM (SELECT unnest(homes) AS h FROM (SELECT homes FROM run ORDER BY i DESC LIMIT 1) q) u),
placed AS (SELECT base_key, (SELECT names FROM dn)[home] AS drive, incoming, CAST(rank AS INT) AS round, home <> d AS evacuated FROM run LEFT JOIN ends USING (i) WHERE i > 0)"""


PLACED = f"{SERIAL}, {_serial(4, 1_000_000)}"
RECURSIVE_CONS = CONS.replace("WITH ", "WITH RECURSIVE ", 1)
LEAVING = """leaving AS MATERIALIZED (SELECT row_number() OVER (ORDER BY drive, bytes DESC, base_key) AS i, base_key, drive, bytes, need FROM wanted),
walk AS (SELECT CAST(0 AS BIGINT) AS i, '' AS base_key, '' AS drive, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS freed, (SELECT room FROM sink_room) AS room, false AS seen, false AS fits
  UNION ALL SELECT i, base_key, drive, bytes, f + CASE WHEN f < need AND bytes <= room THEN bytes ELSE 0 END, room - CASE WHEN f < need AND bytes <= room THEN bytes ELSE 0 END, f < need, f < need AND bytes <= room
  FROM (SELECT l.*, w.room, CASE WHEN l.drive = w.drive THEN freed ELSE 0 END AS f FROM walk w JOIN leaving l ON l.i = w.i + 1) z)
SELECT base_key, drive, bytes, fits FROM walk WHERE seen"""
NOT_ACTIONS = "('GROUP_DONE', 'EVAC_MKDIR', 'MKDIR_DUP', 'MKDIR_DEST')"
SECONDS = "greatest(CAST(round(coalesce(duration, 0)) AS BIGINT), 0)"
def _scaled(unit: int, name: str) -> str:
    return f"concat(printf('%d.%02d', (filesize * 200 + {unit}) // {2 * unit} // 100, (filesize * 200 + {unit}) // {2 * unit} % 100), chr(160), '{name}')"


SIZE = f"CASE WHEN filesize = 0 THEN '0 Bytes' WHEN filesize < 1000 THEN {_scaled(1, 'Bytes')} WHEN filesize < 1000000 THEN {_scaled(1000, 'KB')} WHEN filesize < 1000000000 THEN {_scaled(1000000, 'MB')} ELSE {_scaled(1000000000, 'GB')} END"
TITLE_CASE = "concat(upper(substr({0}, 1, 1)), substr({0}, 2))"
BASE_NAME = "replace(regexp_extract(file_name, '^([a-z0-9.#]+)\\.scene\\.', 1), '.', ' ')"
NORMAL = "concat(" + TITLE_CASE.format(f"split_part({BASE_NAME}, ' ', 1)") + r", ' Brand# ', lpad(regexp_extract(file_name, 'brand#(\d+)', 1), CAST(greatest(2, length(regexp_extract(file_name, 'brand#(\d+)', 1))) AS INT), '0'), ' - Scene_', regexp_extract(file_name, '\.scene\.(\d+)\.', 1), ' - ', regexp_extract(file_name, '\.scene\.\d+\.([A-Za-z]+)', 1))"
ACCENTED = "CASE id % 3 WHEN 0 THEN translate(title, 'aeo', 'áèö') WHEN 1 THEN upper(translate(title, 'eu', 'éü')) ELSE title END"
FMT = "'%Y-%m-%d %H:%M:%S'"

ORACLES = {
    "title_rollup": f"{ctes('media_files')}, {SCANNED}, {ROLLUP} SELECT * FROM rollup_",
    "ingest_match": f"{LIB} SELECT * FROM matched",
    "numbering_plan": f"{LIB}, {NUMBER_PLAN} SELECT * FROM nplan",
    "number_files": f"{LIB}, {NUMBER_PLAN} SELECT path, stem, CASE WHEN regexp_matches(base_part, '#\\s*\\d') THEN stem ELSE concat(base_part, ' # 01', substr(stem, length(base_part) + 1)) END AS new_stem FROM {SUFFIXED.format('stem', 'scan2')} z WHERE lower(base_part) IN (SELECT lower(title) FROM nplan)",
    "duplicate_move_plan": f"{LIB}, dups AS (SELECT lower(db_title) AS t, bool_or(size_class = 'isLarger') AS larger FROM matched WHERE action <> 'insert' GROUP BY 1), bases AS (SELECT path, lower(split_part(base_part, ' # ', 1)) AS b FROM {SUFFIXED.format('stem', 'scanned')} z) SELECT path, CASE WHEN bool_or(larger) THEN 'duplicates/larger' ELSE 'duplicates' END AS target FROM bases JOIN dups ON starts_with(t, b) WHERE b <> '' GROUP BY path",
    "fill_missing": f"{LIB}, known AS (SELECT lower(db_title) AS key, sum(title_size) AS scanned FROM t1 GROUP BY 1) SELECT id, title, CAST(CASE WHEN coalesce(filesize, 0) = 0 THEN coalesce(scanned, 0) ELSE filesize END AS BIGINT) AS filesize, coalesce(filesize, 0) = 0 AND coalesce(scanned > 0, false) AS filled FROM library LEFT JOIN known ON lower(title) = key WHERE lower(trim(coalesce(dimensions, ''))) IN ('', '0 x 0') OR coalesce(duration, 0) = 0 OR coalesce(filesize, 0) = 0",
    "title_rollup_probed": f"{PROBED} SELECT * FROM rp",
    "fill_metadata": f"{PROBED}, k AS (SELECT lower({LIBRARY_TITLE.format('title')}) AS key, arg_min(dimensions, title_path) FILTER (WHERE dimensions <> '') AS nd, arg_min(duration, title_path) FILTER (WHERE duration > 0) AS nu, arg_min(title_size, title_path) FILTER (WHERE title_size > 0) AS ns FROM rp GROUP BY 1), l AS (SELECT *, lower(trim(coalesce(dimensions, ''))) IN ('', '0 x 0') AS a, coalesce(duration, 0) = 0 AS b, coalesce(filesize, 0) = 0 AS c FROM library) SELECT id, title, CASE WHEN a AND nd IS NOT NULL THEN nd ELSE dimensions END AS dimensions, CASE WHEN b AND nu IS NOT NULL THEN CAST(nu AS DOUBLE) ELSE duration END AS duration, CASE WHEN c AND ns IS NOT NULL THEN ns ELSE filesize END AS filesize, concat_ws(',', CASE WHEN a THEN 'dimensions' END, CASE WHEN b THEN 'duration' END, CASE WHEN c THEN 'filesize' END) AS needed, concat_ws(',', CASE WHEN a AND nd IS NOT NULL THEN 'dimensions' END, CASE WHEN b AND nu IS NOT NULL THEN 'duration' END, CASE WHEN c AND ns IS NOT NULL THEN 'filesize' END) AS filled FROM l LEFT JOIN k ON lower(l.title) = key WHERE a OR b OR c",
    "refresh_sizes": f"{LIB}, l AS (SELECT lower(title) AS k, min(id) AS id, arg_min(filesize, id) AS fs FROM library GROUP BY 1) SELECT t1.title, title_size AS disk_size, coalesce(a.id, b.id) AS id, CASE WHEN coalesce(a.id, b.id) IS NULL THEN 'not_found' WHEN coalesce(a.fs, b.fs) = title_size THEN 'unchanged' ELSE 'updated' END AS outcome FROM t1 LEFT JOIN l a ON lower(t1.title) = a.k LEFT JOIN l b ON lower(t1.db_title) = b.k",
    "insert_new": f"{LIB} SELECT min(db_title) AS title, CAST(sum(title_size) AS BIGINT) AS filesize FROM t1 WHERE lower(db_title) NOT IN (SELECT lower(title) FROM library) GROUP BY lower(db_title)",
    "probe_parse": f"{ctes('media_files', 'probe_raw')} SELECT path, CASE WHEN w > 0 AND h > 0 THEN concat(w, ' x ', h) ELSE '' END AS dimensions, d AS duration FROM (SELECT path, CAST(raw->>'$.streams[1].width' AS BIGINT) AS w, CAST(raw->>'$.streams[1].height' AS BIGINT) AS h, CAST(floor(CAST(raw->>'$.format.duration' AS DOUBLE)) AS BIGINT) AS d FROM probe_raw WHERE raw <> 'not json{{') z",
    "refresh_counts": f"{LIB}, l AS (SELECT lower(title) AS k, min(id) AS id, arg_min(filesize, id) AS fs FROM library GROUP BY 1), o AS (SELECT t1.title, title_size AS disk_size, coalesce(a.id, b.id) AS id, CASE WHEN coalesce(a.id, b.id) IS NULL THEN 'not_found' WHEN coalesce(a.fs, b.fs) = title_size THEN 'unchanged' ELSE 'updated' END AS outcome FROM t1 LEFT JOIN l a ON lower(t1.title) = a.k LEFT JOIN l b ON lower(t1.db_title) = b.k) SELECT count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE outcome = 'not_found') AS not_found FROM o",
    "listing_newest": f"{ctes('library')} SELECT id, title, row_number() OVER (ORDER BY date_created DESC NULLS LAST, id) AS place FROM library",
    "settle_renames": f"{ctes('raw_files')}, w AS (SELECT concat(dir, '/', file_name) AS p, dir FROM raw_files) SELECT CASE WHEN length(p) % 4 = 0 THEN concat(p, '.new') ELSE p END AS path, dir, CASE length(p) % 4 WHEN 0 THEN 'renamed' WHEN 2 THEN 'failed' ELSE 'pending' END AS outcome FROM w WHERE length(p) % 4 <> 1",
    "listing_filtered": f"{ctes('library')} SELECT id, title, dimensions, s AS seconds, CASE WHEN s = 0 THEN '00:00:00' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS shown_duration, {SIZE} AS shown_size, strftime(date_created, {FMT}) AS date_created FROM (SELECT *, {SECONDS} AS s FROM library) z WHERE contains(lower(title), 'large') AND ends_with(title, '1')",
    "listing_counts": f"{ctes('library')} SELECT count(*) AS total, count(*) FILTER (WHERE contains(lower(title), 'large') AND ends_with(title, '1')) AS shown FROM library",
    "apply_edits": f"{ctes('library')} SELECT id, CASE WHEN id % 9 = 0 THEN concat(title, ' edited') ELSE title END AS title, dimensions, duration, CASE WHEN id % 9 = 0 THEN 0 ELSE filesize END AS filesize, strftime(date_created, {FMT}) AS date_created FROM library",
    "apply_changes": f"{ctes('library')} SELECT id, CASE WHEN id % 97 = 0 THEN concat(title, ' edited') ELSE title END AS title, dimensions, duration, filesize, strftime(date_created, {FMT}) AS date_created FROM library WHERE id % 89 <> 0",
    "titles_in_order": f"{ctes('library')}, a AS (SELECT id, {ACCENTED} AS title FROM library) SELECT id, title, row_number() OVER (ORDER BY {NATURAL.format('strip_accents(title)')} COLLATE NOCASE.NOACCENT, id) AS place FROM a",
    "find_titles": f"{ctes('library')}, a AS (SELECT DISTINCT {ACCENTED} AS title FROM library), l AS (SELECT title, id FROM library) SELECT a.title, min(l.id) AS id FROM a LEFT JOIN l ON trim(a.title) COLLATE NOCASE.NOACCENT = trim(l.title) COLLATE NOCASE.NOACCENT GROUP BY 1",
    "last_run_lines": f"{ctes('action_log')}, r AS (SELECT grp, count(*) FILTER (WHERE status = 'OK' AND action = 'MOVE') AS m, coalesce(sum(bytes) FILTER (WHERE status = 'OK' AND action = 'MOVE'), 0) AS filesize, count(*) FILTER (WHERE status = 'OK' AND action = 'MOVE_DUP') AS d, count(*) FILTER (WHERE status = 'FAIL') AS f, count(*) FILTER (WHERE status = 'OK' AND action = 'RENAME_01') AS n, count(*) FILTER (WHERE status = 'SKIP') AS s, max(line_no) AS z, max(ts) AS t FROM action_log GROUP BY 1) SELECT grp, concat(CASE WHEN z % 2 = 0 THEN 'Dry run' ELSE 'Run' END, ' finished ', CASE WHEN z % 5 > 0 THEN strftime(t, {FMT}) ELSE 'unknown' END, CASE WHEN z % 3 = 0 THEN '' WHEN z >= 3600 THEN printf(' (took %dh %dm %ds)', z // 3600, z // 60 % 60, z % 60) WHEN z >= 60 THEN printf(' (took %dm %ds)', z // 60, z % 60) ELSE printf(' (took %ds)', z) END, ' — ', m, ' moved (', {SIZE.replace('filesize', 'CAST(filesize AS BIGINT)')}, '), ', d, ' duplicates, ', f, ' failed', CASE WHEN n > 0 THEN concat(', ', n, ' renamed to # 01') ELSE '' END, CASE WHEN s > 0 THEN concat(', ', s, ' groups skipped (space)') ELSE '' END, CASE z % 4 WHEN 0 THEN '' WHEN 1 THEN '. 1 file needs review (see RENAME_01_SKIP in the log)' ELSE concat('. ', z % 4, ' files need review (see RENAME_01_SKIP in the log)') END, CASE WHEN z % 7 < 2 THEN '. Drive index rebuilt.' WHEN z % 7 < 4 THEN '. Drive index rebuild FAILED — rebuild it manually.' ELSE '' END) AS line FROM r",
    "apply_deletes": f"{ctes('library')} SELECT id, 'kept' AS state FROM library WHERE id % 10 <> 0 UNION ALL SELECT CAST(-1 AS BIGINT), 'not_found'",
    "index_snapshot": f"{ctes('media_files')}, {SNAPSHOT} SELECT base, file, dir, size, strftime(mtime, {FMT}) AS mtime, carried FROM snap",
    "index_meta": f"{ctes('media_files')}, {SNAPSHOT} SELECT count(*) AS file_count, '/vol0,/vol1,/vol2,/vol3' AS roots, '/vol2' AS missing_roots FROM snap",
    "index_without": f"{ctes('media_files')}, {SNAPSHOT}, gone AS (SELECT DISTINCT dir, file FROM snap WHERE size % 3 = 0) SELECT s.dir, s.file, size FROM snap s ANTI JOIN gone ON gone.dir = s.dir AND gone.file = s.file",
    "index_allowed": f"{ctes('media_files')}, {SNAPSHOT}, f AS (SELECT dir, concat(stem, '.', ext) AS file FROM media_files) SELECT f.dir, f.file FROM f SEMI JOIN snap ON snap.dir = f.dir AND snap.file = f.file",
    "index_search": f"{ctes('media_files')}, {SNAPSHOT}, {QUERIES_SQL}, {FOUND} SELECT query, count(DISTINCT lower(base)) AS total_groups, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS bytes FROM found GROUP BY 1",
    "index_search_page": f"{ctes('media_files')}, {SNAPSHOT}, {QUERIES_SQL}, {FOUND}, g AS (SELECT query, lower(base) AS base_key, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, string_agg(concat(dir, '/', file), '|' ORDER BY {NATURAL.format('file')}, file, dir, size, mtime) AS files FROM found GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {NATURAL.format('base_key')}, base_key) AS rank, count(*) OVER (PARTITION BY query) AS total_groups, CAST(sum(n_files) OVER (PARTITION BY query) AS BIGINT) AS total_files FROM g) SELECT query, rank, base_key, n_files, bytes, files, total_groups, total_files FROM r WHERE rank > 50 AND rank <= 100",
    "index_lookup": f"{ctes('media_files')}, {SNAPSHOT}, asked AS (SELECT unnest(['brand#1', 'BOLT', 'scene_2', 'no such title', '#4', 'X', '  Copper ', '.mkv', 'a b', '']) AS query), q AS (SELECT query, lower(trim(query)) AS q FROM asked WHERE length(trim(query)) BETWEEN 1 AND 120) SELECT query, dir, file, size FROM snap JOIN q ON contains(lower(base), q) OR contains(lower(file), q)",
    "index_next_page": f"{ctes('media_files')}, {SNAPSHOT}, {QUERIES_SQL}, {FOUND}, g AS (SELECT query, lower(base) AS base_key, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM found GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {NATURAL.format('base_key')}, base_key) - 100 AS place FROM g) SELECT query, CAST(place AS INT) AS place, base_key, n_files, bytes FROM r WHERE place BETWEEN 1 AND 50",
    "episode_parse": f"{ctes('media_files')}, {PARSED} SELECT path, base, ep, variant FROM parsed",
    "episode_order_rank": f"{CONS} SELECT path, base_key, row_number() OVER (PARTITION BY base_key ORDER BY coalesce(ep, 0), CASE WHEN variant = '' THEN 0 WHEN variant LIKE '%Scene%' THEN 1 ELSE 2 END, CASE WHEN variant = '' THEN 0 ELSE CAST(regexp_extract(variant, '(\\d+)$', 1) AS BIGINT) END, lower(variant), lower(concat(stem, '.', ext)), path) AS place FROM eps",
    "best_copy": f"{CONS} SELECT path, item_key, keep, rename_01, flagged FROM best",
    "rename01_flags": f"{CONS} SELECT path, item_key, rename_01, flagged, CASE WHEN rename_01 THEN concat(stem, ' # 01.', ext) END AS new_name FROM best WHERE rename_01 OR flagged",
    "drive_rank": f"{CONS}, {RANKS} SELECT base_key, drive, n, bytes, rank FROM ranks",
    "placement_round1": f"{CONS}, {RANKS}, offers AS (SELECT base_key, drive, free_bytes, group_bytes - bytes AS incoming FROM ranks WHERE rank = 1) SELECT base_key, drive, incoming, free_bytes - sum(incoming) OVER (PARTITION BY drive ORDER BY base_key) >= 1000000 AS accepted FROM offers",
    "placement": f"{RECURSIVE_CONS}, {PLACED} SELECT * FROM placed",
    "consolidation_plan": f"{RECURSIVE_CONS}, {PLACED}, rows_ AS (SELECT b.*, p.drive AS target, coalesce(evacuated, false) AS evacuated, CASE WHEN rename_01 THEN concat(stem, ' # 01.', ext) ELSE concat(stem, '.', ext) END AS file FROM best b LEFT JOIN placed p USING (base_key)), acts AS (SELECT *, CASE WHEN NOT keep THEN 'shelve' WHEN target IS NULL THEN 'skip' WHEN drive <> target THEN 'move' WHEN rename_01 THEN 'rename' ELSE 'stay' END AS action FROM rows_), there AS (SELECT drive AS d, lower(concat(stem, '.', ext)) AS k, size AS s, epoch(mtime) AS m FROM best WHERE keep), hit AS (SELECT path, bool_or(size = s AND abs(epoch(mtime) - m) <= 2) AS same FROM acts JOIN there ON target = d AND lower(file) = k WHERE action = 'move' GROUP BY 1) SELECT path, item_key, keep, flagged, action, target, evacuated, file, CASE WHEN action = 'move' THEN size ELSE 0 END AS move_bytes, CASE WHEN hit.path IS NULL THEN NULL WHEN same THEN 'duplicate' ELSE 'suspect' END AS collision FROM acts LEFT JOIN hit USING (path)",
    "group_order": f"{CONS} SELECT base_key, lower(arg_min(base, path)) AS display, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM eps GROUP BY 1",
    "running_free": f"{ctes('media_files', 'drives', 'action_log')}, s AS (SELECT line_no AS step, concat('/vol', line_no % 4) AS drive, CASE WHEN action = 'MOVE' THEN -bytes ELSE bytes END AS delta FROM action_log) SELECT step, drive, CAST(free_bytes + sum(delta) OVER (PARTITION BY drive ORDER BY step) AS BIGINT) AS free_after FROM s JOIN drives USING (drive)",
    "free_names": f"{ctes('media_files')}, f AS (SELECT path, drive AS d, concat(stem, '.', ext) AS file, lower(concat(stem, '.', ext)) AS k FROM media_files WHERE lower(ext) <> 'txt'), held AS (SELECT DISTINCT d, k FROM f WHERE path LIKE '%/d7/%'), turns AS (SELECT f.*, row_number() OVER (PARTITION BY f.d, f.k ORDER BY path) + CASE WHEN h.k IS NULL THEN 0 ELSE 1 END AS turn FROM f LEFT JOIN held h ON h.d = f.d AND h.k = f.k) SELECT path, CASE WHEN turn = 1 THEN file WHEN turn = 2 THEN regexp_replace(file, '(\\.[^.]*)$', '__S\\1') WHEN turn <= 51 THEN regexp_replace(file, '(\\.[^.]*)$', concat('__S_', turn - 1, '\\1')) END AS free_name, CASE WHEN turn > 51 THEN 'no_free_name' END AS problem FROM turns",
    "evacuation": f"{RECURSIVE_CONS}, {SUMS}, sink_room AS MATERIALIZED (SELECT CAST(free_bytes AS BIGINT) AS room FROM drives WHERE is_sink), wanted AS (SELECT sums.*, CAST(floor(free_bytes / 4) AS BIGINT) AS need FROM sums JOIN drives USING (drive) WHERE NOT is_sink), {LEAVING}",
    "balance_plan": f"{RECURSIVE_CONS}, {SUMS}, d AS (SELECT drive, is_sink, CAST(floor(free_bytes / CASE WHEN is_sink THEN 3 ELSE 2 END) AS BIGINT) AS fb FROM drives), sink_room AS MATERIALIZED (SELECT fb - 1000 AS room FROM d WHERE is_sink), wanted AS (SELECT sums.*, greatest((SELECT max(fb) FROM d) - fb, 0) AS need FROM sums JOIN d USING (drive) WHERE NOT is_sink), {LEAVING}",
    "collision_classes": f"{ctes('media_files')}, f AS (SELECT *, lower(concat(stem, '.', ext)) AS k FROM media_files), there AS (SELECT '/vol1' AS target, k, CASE WHEN size % 3 = 0 THEN size + 1 ELSE size END AS s, mtime AS m FROM f WHERE drive = '/vol1' UNION ALL SELECT '/vol0', k, size, mtime FROM f WHERE drive = '/vol0'), moves AS (SELECT f.*, target FROM f, (SELECT unnest(['/vol0', '/vol1']) AS target) t WHERE drive = '/vol0') SELECT path, target, CASE WHEN bool_or(size = s AND abs(epoch(mtime) - epoch(m)) <= 2) THEN 'duplicate' ELSE 'suspect' END AS class FROM moves JOIN there USING (target, k) GROUP BY 1, 2",
    "normalize_plain": f"{ctes('raw_files')} SELECT dir, file_name, concat('Tales Of THE ', {NORMAL}) AS title FROM raw_files",
    "normalize_all": f"{ctes('raw_files')} SELECT dir, file_name, {NORMAL} AS title FROM raw_files",
    "normalize_plan": f"{ctes('raw_files', 'names')}, sq AS (SELECT lower(replace(name, ' ', '')) AS k, min(name) AS n FROM names GROUP BY 1 HAVING count(*) = 1), words AS (SELECT lower(unnest(string_split(name, ' '))) AS w FROM names UNION SELECT lower(name) FROM names), t AS (SELECT *, regexp_extract(file_name, '\\.scene\\.\\d+\\.([A-Za-z]+)', 1) AS piece, {NORMAL} AS title FROM raw_files), r AS (SELECT dir, file_name, concat(substr(title, 1, length(title) - length(piece)), coalesce(CASE WHEN length(piece) >= 6 AND k NOT IN (SELECT w FROM words) THEN n END, piece), '.mp4') AS new_name FROM t LEFT JOIN sq ON lower(piece) = k), c AS (SELECT *, count(*) OVER (PARTITION BY dir, lower(new_name)) AS m FROM r) SELECT concat(dir, '/', file_name) AS path, file_name AS old_name, new_name, new_name <> file_name AS needs_rename, CASE WHEN new_name = file_name THEN NULL WHEN m > 1 THEN 'two_sources' WHEN lower(new_name) = lower(file_name) THEN 'case_only' END AS conflict FROM c",
    "restore_names": f"{ctes('names', 'cast_titles')}, sq AS (SELECT lower(replace(name, ' ', '')) AS k FROM names GROUP BY 1 HAVING count(*) = 1), words AS (SELECT lower(unnest(string_split(name, ' '))) AS w FROM names), ok AS (SELECT k FROM sq ANTI JOIN words ON w = k), f AS (SELECT *, regexp_extract(title, '^(.* - Scene_[0-9]+ - )', 1) AS head, lower(replace(n1, ' ', '')) IN (SELECT k FROM ok) AS s1, lower(replace(n2, ' ', '')) IN (SELECT k FROM ok) AS s2 FROM cast_titles) SELECT title AS was, CASE form WHEN 0 THEN concat(head, n1, ', ', n2) WHEN 3 THEN CASE WHEN s1 AND s2 THEN concat(head, n1, ', ', n2) ELSE concat(head, CASE WHEN s1 THEN n1 ELSE replace(n1, ' ', '') END, ' ', CASE WHEN s2 THEN n2 ELSE lower(replace(n2, ' ', '')) END) END WHEN 5 THEN concat(head, n1, ', ', n2, ', ', n1) WHEN 6 THEN concat(head, n1, ', ', n2, ', ', n2, ' at Night') ELSE title END AS title FROM f",
    "vocab_merge": f"{ctes('names')}, u AS (SELECT name, 0 AS r FROM names UNION ALL SELECT upper(name), 1 FROM names UNION ALL SELECT concat(p_brand, ' ', p_type), 2 FROM part) SELECT arg_min(name, (r, name)) AS name, lower(name) AS key FROM u GROUP BY lower(name)",
    "squash_ambiguity": f"{ctes('names')}, u AS (SELECT name FROM names UNION ALL SELECT upper(name) FROM names WHERE name LIKE 'B%') SELECT lower(replace(name, ' ', '')) AS squash, count(*) AS entries, CASE WHEN count(*) = 1 THEN min(name) END AS name FROM u WHERE contains(name, ' ') GROUP BY 1",
    "vocab_edit": f"{ctes('names')}, u AS (SELECT name, lower(name) AS key FROM names WHERE length(name) % 5 <> 0 UNION ALL SELECT 'New Entry', 'new entry') SELECT name, key FROM u WHERE contains(key, 'e')",
    "name_length": f"{ctes('names')} SELECT coalesce(max(len(string_split(name, ' '))), 0) AS words FROM names",
    "typed_segment": f"{ctes('cast_titles')}, t AS (SELECT DISTINCT n1, lower(substr(n2, 1, 4)) AS p FROM cast_titles) SELECT concat(n1, ' ', p) AS partial, p AS typed, CAST(length(n1) + 1 AS INT) AS start, true AS glued FROM t UNION ALL SELECT concat(n1, ', ', p), p, CAST(length(n1) + 2 AS INT), false FROM t",
    "harvest_names": f"{ctes('raw_files', 'names')}, sq AS (SELECT lower(replace(name, ' ', '')) AS k, min(name) AS n FROM names GROUP BY 1 HAVING count(*) = 1), words AS (SELECT lower(unnest(string_split(name, ' '))) AS w FROM names), t AS (SELECT lower(regexp_extract(file_name, '\\.scene\\.\\d+\\.([A-Za-z]+)', 1)) AS piece FROM raw_files), c AS (SELECT n, count(*) AS c FROM t JOIN sq ON piece = k ANTI JOIN words ON w = k WHERE length(piece) >= 6 GROUP BY 1) SELECT name, lower(name) AS key, CASE WHEN c IS NULL THEN 'performer_folders' ELSE 'scene_tails' END AS source, coalesce(c, 0) + 1 AS sightings FROM names LEFT JOIN c ON n = name",
    "tidy_lists": f"{ctes('names', 'cast_titles').replace('WITH ', 'WITH RECURSIVE ', 1)}, known AS MATERIALIZED (SELECT lower(name) AS k FROM names UNION SELECT lower(concat(name, ' Elder')) FROM names WHERE length(name) % 3 = 0), t AS (SELECT DISTINCT CASE form WHEN 1 THEN concat(n1, ' Elder ', n2) WHEN 2 THEN concat('Lone ', n1, ' Elder ', n2, ' Elder') WHEN 3 THEN concat(lower(n1), ' elder and ', n2, ' ', n1) WHEN 4 THEN concat(n1, '; ', n2, ' & -') WHEN 5 THEN concat(n1, ' Elder ', n2, ' ', n1) ELSE concat(n1, ' ', n2) END AS text FROM cast_titles), p AS MATERIALIZED (SELECT row_number() OVER () AS id, text, no, string_split(part, ' ') AS w FROM (SELECT text, generate_subscripts(ps, 1) AS no, unnest(ps) AS part FROM (SELECT text, list_filter(list_transform(regexp_split_to_array(text, '[;&]| and '), lambda x: trim(x, ' -')), lambda x: x <> '') AS ps FROM t) a) b), s AS (SELECT id, CAST(1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS o FROM p WHERE len(w) >= 4 UNION ALL SELECT id, i + n, CASE WHEN n = 1 AND len(o) > 0 THEN list_append(o[1:len(o) - 1], concat(o[len(o)], ' ', w[i])) ELSE list_append(o, array_to_string(w[i:i + n - 1], ' ')) END FROM (SELECT s.id, i, o, w, CASE WHEN k4.k IS NOT NULL THEN 4 WHEN k3.k IS NOT NULL THEN 3 WHEN i < len(w) THEN 2 ELSE 1 END AS n FROM s JOIN p ON p.id = s.id LEFT JOIN known k4 ON i + 3 <= len(w) AND k4.k = lower(array_to_string(w[i:i + 3], ' ')) LEFT JOIN known k3 ON i + 2 <= len(w) AND k3.k = lower(array_to_string(w[i:i + 2], ' ')) WHERE i <= len(w)) z), e AS (SELECT p.text, p.no, coalesce(array_to_string(o, '|'), array_to_string(w, ' ')) AS own FROM p LEFT JOIN s ON s.id = p.id AND s.i > len(w)) SELECT t.text, coalesce(string_agg(own, '|' ORDER BY no), '') AS people FROM t LEFT JOIN e ON e.text = t.text GROUP BY 1",
    "shown_actions": f"{ctes('action_log')} SELECT line_no, CASE WHEN starts_with(action, 'BALANCE') THEN '' ELSE concat('f', line_no, '.mp4') END AS shown_file, concat('vol', line_no % 4) AS from_drive, 'sink' AS to_drive, CASE WHEN filesize > 0 THEN {SIZE} ELSE '' END AS shown_bytes FROM (SELECT *, bytes AS filesize FROM action_log) z",
    "run_summary": f"{ctes('action_log')}, c AS (SELECT count(*) FILTER (WHERE status = 'OK' AND action = 'MOVE') AS moved, count(*) FILTER (WHERE status = 'OK' AND action = 'MOVE_DUP') AS duped, count(*) FILTER (WHERE status = 'OK' AND action = 'RENAME_01') AS renamed, count(*) FILTER (WHERE status = 'SKIP') AS skipped, CAST(0 AS BIGINT) AS flagged, count(*) FILTER (WHERE status = 'FAIL') AS failed, CAST(coalesce(sum(bytes) FILTER (WHERE status = 'OK' AND action = 'MOVE'), 0) AS BIGINT) AS moved_bytes FROM action_log) SELECT c.*, concat(moved, ' files moved (', (SELECT {SIZE} FROM (SELECT moved_bytes AS filesize) z), '), ', duped, ' duplicates shelved, ', renamed, ' files renamed, ', skipped, ' skipped, ', failed, ' failures') AS line FROM c",
    "suggest_names": f"{ctes('names')}, p AS (SELECT DISTINCT substr(p_name, 1, 3) AS partial FROM part), h AS (SELECT partial, name, CASE WHEN starts_with(lower(name), lower(partial)) THEN 1 ELSE 2 END AS kind FROM p JOIN names ON contains(lower(name), lower(partial)) WHERE length(partial) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY partial ORDER BY kind, lower(name), name) AS rank FROM h) SELECT partial, rank, name, kind FROM r WHERE rank <= 12",
    "name_worklist": f"{ctes('media_files')}, w AS (SELECT regexp_replace(regexp_replace(stem, '\\s*-?\\s*Scene_\\d+\\s*$', '', 'i'), '\\s*#\\s*\\d+\\s*$', '') AS title FROM media_files WHERE regexp_matches(stem, 'Scene_\\d{{1,3}}\\s*$', 'i')) SELECT lower(title) AS key, min(title) AS title, count(*) AS n_files FROM w GROUP BY 1",
    "batch_totals": f"{LIB} SELECT count(*) AS n_total, CAST(sum(title_size) AS BIGINT) AS size_total, count(*) FILTER (WHERE action = 'insert') AS n_new, CAST(coalesce(sum(title_size) FILTER (WHERE action = 'insert'), 0) AS BIGINT) AS size_new, count(*) FILTER (WHERE action <> 'insert') AS n_duplicate, CAST(coalesce(sum(title_size) FILTER (WHERE action <> 'insert'), 0) AS BIGINT) AS size_duplicate, CAST(coalesce(sum(title_size - library_size) FILTER (WHERE size_class <> ''), 0) AS BIGINT) AS gain FROM matched",
    "action_summary": f"{ctes('action_log')} SELECT action, status, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM action_log GROUP BY 1, 2",
    "action_tail": f"{ctes('action_log')} SELECT line_no, strftime(ts, {FMT}) AS ts, grp, action, bytes, status FROM (SELECT * FROM action_log WHERE action NOT IN {NOT_ACTIONS} ORDER BY line_no DESC LIMIT 400) z",
    "log_round_trip": f"{ctes('action_log')} SELECT strftime(ts, {FMT}) AS ts, 'dry-run' AS mode, concat(grp, '\\t\\n#') AS grp, action, 'a\\rb' AS src, '' AS dest, CAST(bytes AS VARCHAR) AS bytes, status, CAST(line_no AS VARCHAR) AS message FROM action_log",
    "recent_terms": f"WITH e AS (SELECT user_id % 20 AS owner, lower(concat(event_type, ' ', event_id % 40)) AS key, ts FROM events), m AS (SELECT owner, key, max(ts) AS ts FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, key) AS rank FROM m) SELECT owner, key, strftime(ts, {FMT}) AS ts, rank FROM r WHERE rank <= 25",
    "debounce_sessions": f"WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, strftime(min(ts), {FMT}) AS started, strftime(max(ts), {FMT}) AS last, strftime(max(ts) + INTERVAL 30 MINUTE, {FMT}) AS due, count(*) AS n FROM g GROUP BY user_id, s",
    "debounce_all": f"WITH e AS (SELECT event_type, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT event_type, strftime(min(ts), {FMT}) AS started, strftime(max(ts), {FMT}) AS last, strftime(max(ts) + INTERVAL 10 MINUTE, {FMT}) AS due, count(*) AS n FROM g GROUP BY event_type, s",
    "stale_runs": f"SELECT concat_ws('/', event_type, user_id) AS run, strftime(max(ts), {FMT}) AS last, floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(max(ts))) > 120 AS stale FROM events GROUP BY 1",
    "stale_all": f"SELECT event_type AS run, strftime(max(ts), {FMT}) AS last, floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(max(ts))) > 300 AS stale FROM events GROUP BY 1",
    "titles_natural": f"{ctes('library')} SELECT id, {NATURAL.format('title')} AS sort_key FROM library",
}
