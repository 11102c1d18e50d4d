"""Independent DuckDB SQL for every registered query (the correctness gate).

The SQL is written directly against the driver tables (``documents``,
``events``) and re-derives the fixture manifest itself, so a mistake in the
Spark derivation cannot hide in both.
"""

from __future__ import annotations

# Fixed values, stated here again so that a wrong one in the engine cannot pass.
_DOCUMENTS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".rtf", ".csv", ".odt", ".ods",
              ".odp")
_MUSIC = (".mp3", ".flac", ".wav", ".aac", ".ogg", ".wma", ".m4a", ".aiff", ".alac")
_PICTURES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".raw", ".psd", ".ai", ".heic", ".heif", ".cr2",
             ".nef", ".orf", ".sr2", ".dng")
_VIDEOS = (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".3gp")
_DESIGN = (".psd", ".psb", ".ai", ".indd", ".svg")
_IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".raw", ".cr2",
           ".nef", ".orf", ".sr2", ".dng")
_PROFESSIONNEL = ("sofitel", "presentation rh", "sem", "thiercelin", "vivawere", "budget", "ceg", "fiscalite",
                  "fiscalité")
_PERSONNEL = ("desktop", "downloads", "mes documents", "omar", "nm", "divers", "a_trier", "documents")
_RESSOURCES = ("pdf", "zips", "a_renommer", "onedrive")
_FILMS = ("_from_movie", "_from_films", "_from_movies", "_from_film", "_from_ro", "_from_f03")
_FAMILLE = ("_from_pellicule", "_from_videos", "_from_vidéos", "_from_home videos", "_from_attachments",
            "_from_sent")
_RENAME_PROTECTED_NAMES = ("$RECYCLE.BIN", "System Volume Information", ".git", "Ops", "handoff-archive")
_CLEAN_PROTECTED_NAMES = ("$RECYCLE.BIN", "System Volume Information", ".git")
_PRESETS = {
    "documents": (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".rtf", ".odt", ".ods", ".odp", ".csv",
                  ".tsv"),
    "music": (".mp3", ".m4a", ".flac", ".wma", ".aac", ".ogg", ".wav"),
    "pictures": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".heic", ".webp", ".svg", ".raw", ".cr2", ".nef"),
    "videos": (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp"),
    "email": (".pst", ".ost", ".msg", ".eml"),
}

# Fixture manifest, as SQL (DuckDB dialect: strlen = byte length).
_MANIFEST = """
  WITH base AS (
    SELECT doc_id, lang, coalesce(text, '') AS text, doc_id % 8 AS d, CAST(floor(doc_id / 8) AS BIGINT) AS k
    FROM documents {where}
  ), grp AS (
    SELECT *, CAST(floor(k / 3) AS BIGINT) AS g, k % 3 AS v FROM base
  ), ex AS (
    SELECT *, 0 AS e FROM grp
    UNION ALL SELECT *, 1 FROM grp WHERE v = 0 AND g % 2 = 0
    UNION ALL SELECT *, 2 FROM grp WHERE v = 0 AND g % 2 = 0
    UNION ALL SELECT *, 3 FROM grp WHERE k % 29 = 0
  ), named AS (
    SELECT doc_id, d, g, v, e, k, text,
      CASE WHEN d = 0 THEN concat('/drive/Documents/', lang)
           WHEN g % 7 = 3 THEN CASE d WHEN 1 THEN '/drive' WHEN 2 THEN '/drive/OneDrive' WHEN 3 THEN '/drive/_from_2019'
             WHEN 4 THEN '/drive/Music' WHEN 5 THEN '/drive/src/.git/objects'
             WHEN 6 THEN '/drive/_from_whatsapp video' ELSE '/drive/_from_pellicule' END
           ELSE CASE d WHEN 1 THEN '/drive/Desktop'
             WHEN 2 THEN '/drive/SOFITEL/2024'  WHEN 3 THEN '/drive/_from_movies'
             WHEN 4 THEN '/drive/Library/Archive' WHEN 5 THEN '/drive/node_modules/pkg'
             WHEN 6 THEN '/drive/Library/_STAGING/old' ELSE '/drive/Inbox/data' END END AS parent,
      concat(CASE WHEN e = 0 AND v = 0 AND g % 5 = 0 THEN 'only_' ELSE '' END,
        CASE WHEN g % 23 = 3 THEN concat('Été déjà ', g)
             WHEN g % 23 = 5 THEN regexp_replace(md5(CAST(g AS VARCHAR)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
             WHEN g % 23 = 7 THEN concat('.hidden', g) WHEN g % 23 = 13 THEN concat('~$f', g)
             WHEN g % 6 = 2 THEN concat('IMG_', CAST(1985 + g % 50 AS VARCHAR), '0115_', CAST(g AS VARCHAR))
             WHEN g % 6 = 4 THEN concat('N_20240115_', lpad(CAST(g AS VARCHAR), 6, '0'))
             ELSE concat('f', CAST(g AS VARCHAR)) END) AS stem,
      CASE WHEN e = 1 THEN ' (2)' WHEN e = 2 THEN ' - Copie' WHEN v = 0 THEN '' WHEN v = 1 THEN ' (1)' ELSE ' - Copy' END AS marker,
      CASE WHEN g % 23 = 9 THEN '.tar.gz' WHEN g % 23 = 11 THEN '.psd' WHEN g % 23 = 15 THEN '.eml'
           ELSE CASE g % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpg'
                WHEN 3 THEN '.mp3' WHEN 4 THEN '.mp4' ELSE '.tmp' END END AS ext0
    FROM ex
  ), nn AS (
    SELECT doc_id, e, parent, CASE WHEN e = 3 THEN concat('blank_', k, '.txt') ELSE concat(stem, marker, ext0) END AS name,
           CASE WHEN e = 3 THEN '' ELSE text END AS content FROM named
  ), mm AS (
    SELECT concat(parent, '/', name) AS path, * FROM nn
  )
  SELECT path, parent, name, CAST(strlen(content) AS BIGINT) AS size,
    lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) AS ext,
    CASE WHEN doc_id % 97 = 0 THEN NULL ELSE md5(content) END AS md5,
    CAST(1704067200 + (doc_id * 7919) % 2592000 + e AS BIGINT) AS mtime_s,
    doc_id % 53 = 0 AS is_symlink,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('Artist/', CAST(doc_id % 5 AS VARCHAR)) END AS artist,
    CASE WHEN doc_id % 4 = 0 THEN concat(CAST(2000 + doc_id % 25 AS VARCHAR), ':01:15 00:00:00') END AS exif_date,
    CAST(CASE doc_id % 4 WHEN 0 THEN 420 WHEN 1 THEN 384 WHEN 2 THEN 493 ELSE 448 END AS INTEGER) AS mode
  FROM mm
"""


def manifest_sql(where: str = "") -> str:
    return "(" + _MANIFEST.format(where=("WHERE " + where) if where else "") + ")"


# m: manifest with the path relative to /drive and its folder part.
M = f"""m AS (
  SELECT *, substr(path, 8) AS rel,
         regexp_replace(substr(path, 8), '/?[^/]*$', '') AS rel_parent
  FROM {manifest_sql()} x
)"""

# Dedup scan: min size 100, default skip list, no symlinks / hidden / empty.
_DEDUP_SKIP = r"(^|/)(\.git|__pycache__|node_modules|\.DS_Store|System Volume Information|\$RECYCLE\.BIN|\.Trash-[^/]*)(/|$)"
CAND = f"""cand AS (
  SELECT * FROM m
  WHERE size >= 100 AND size > 0 AND NOT is_symlink AND NOT starts_with(name, '.')
    AND NOT regexp_matches(rel_parent, '{_DEDUP_SKIP}')
)"""


def _dedup_plan_sql(order_by: str, cand: str = "cand") -> str:
    return f"""
ranked AS (
  SELECT path, size, md5, name,
         row_number() OVER (PARTITION BY md5, size ORDER BY {order_by}) AS rn,
         count(*) OVER (PARTITION BY md5, size) AS n
  FROM {cand} WHERE md5 IS NOT NULL
)
SELECT r.path, r.size, r.md5, k.path AS keeper_path,
       CASE WHEN r.rn = 1 THEN 'keep' ELSE 'delete' END AS action
FROM ranked r JOIN ranked k ON r.md5 = k.md5 AND r.size = k.size AND k.rn = 1
WHERE r.n >= 2"""


_DEEPEST = """len(string_split(path, '/')),
  CASE WHEN lower(name) LIKE '%copy of %' OR lower(name) LIKE '% - copy%' OR lower(name) LIKE '% - copie%'
        OR name LIKE '%(1)%' OR name LIKE '%(2)%' OR name LIKE '%(3)%' THEN 0 ELSE 1 END,
  CASE WHEN regexp_matches(lower(path), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 0 ELSE 1 END,
  CASE WHEN regexp_matches(name, '\\([0-9]+\\)') THEN 0 ELSE 1 END,
  length(path), path"""

ORACLE: dict[str, str] = {}

ORACLE["dedup_summary"] = f"""
WITH {M}, {CAND},
g AS (SELECT md5, size, count(*) AS n FROM cand WHERE md5 IS NOT NULL GROUP BY md5, size HAVING count(*) >= 2)
SELECT (SELECT count(*) FROM cand) AS total_files,
       count(*) AS duplicate_groups,
       CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS files_to_delete,
       CAST(coalesce(sum(size * (n - 1)), 0) AS BIGINT) AS space_to_free,
       (SELECT count(*) FROM cand WHERE md5 IS NULL AND size IN (SELECT size FROM cand GROUP BY size HAVING count(*) >= 2))
         AS failed_hash_files
FROM g"""

ORACLE["dedup_plan_deepest"] = f"WITH {M}, {CAND}, " + _dedup_plan_sql(_DEEPEST)
ORACLE["dedup_plan_newest"] = f"WITH {M}, {CAND}, " + _dedup_plan_sql("mtime_s DESC, path")
ORACLE["dedup_plan_largest"] = f"WITH {M}, {CAND}, " + _dedup_plan_sql("size DESC, path")


# --- snapshot -------------------------------------------------------------------

_SNAP_SKIP = r"(^|/)(\.git|\.svn|\.hg|node_modules|__pycache__|\.venv|venv|\.pytest_cache|\.tox)(/|$)"
_EXTRA_DIRS = "('empty'), ('e1'), ('e1/e2'), ('e1/e2/e3'), ('e4'), ('e4/.git')"


def _snap_ctes(where: str = "", p: str = "", gone: str = "") -> str:
    """files (sf), folders below root (dirs) for one manifest; names prefixed by p."""
    return f"""{p}m AS (
  SELECT *, substr(path, 8) AS rel, regexp_replace(substr(path, 8), '/?[^/]*$', '') AS rel_parent
  FROM {manifest_sql(where)} x {f"WHERE ext <> '{gone}'" if gone else ''}
), {p}sf AS (
  SELECT path, size, lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) AS ext,
         CASE WHEN rel_parent = '' THEN NULL ELSE split_part(rel_parent, '/', 1) END AS top
  FROM {p}m WHERE NOT regexp_matches(rel_parent, '{_SNAP_SKIP}')
), {p}dirs AS (
  SELECT DISTINCT array_to_string(list_slice(string_split(rel_parent, '/'), 1, i), '/') AS rel
  FROM (SELECT rel_parent, unnest(generate_series(1, len(string_split(rel_parent, '/')))) AS i
        FROM {p}m WHERE rel_parent <> '') t
  UNION SELECT * FROM (VALUES {_EXTRA_DIRS}) v(rel)
), {p}summary AS (
  SELECT count(*) AS total_files, (SELECT count(*) FROM {p}dirs) AS total_dirs,
         CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size_bytes FROM {p}sf
), {p}byext AS (
  SELECT ext, count(*) AS count, CAST(sum(size) AS BIGINT) AS size_bytes FROM {p}sf GROUP BY ext
)"""


ORACLE["snapshot_by_extension"] = f"WITH {_snap_ctes()} SELECT * FROM byext"
ORACLE["snapshot_samples"] = f"""WITH {_snap_ctes()}
SELECT ext, sample_rank, path FROM (
  SELECT ext, path, row_number() OVER (PARTITION BY ext ORDER BY path) AS sample_rank FROM sf) t
WHERE sample_rank <= 3"""
ORACLE["snapshot_top_dirs"] = f"""WITH {_snap_ctes()}
SELECT top, CAST(sum(size) AS BIGINT) AS size_bytes, CAST(sum(n) AS BIGINT) AS file_count FROM (
  SELECT top, size, 1 AS n FROM sf WHERE top IS NOT NULL
  UNION ALL
  SELECT rel, 0, 0 FROM dirs WHERE NOT contains(rel, '/')
     AND rel NOT IN ('.git', '.svn', '.hg', 'node_modules', '__pycache__', '.venv', 'venv', '.pytest_cache', '.tox')
) u GROUP BY top"""
ORACLE["snapshot_largest"] = f"""WITH {_snap_ctes()}
SELECT row_number() OVER (ORDER BY size DESC, path) AS rank, path, size AS size_bytes
FROM sf ORDER BY size DESC, path LIMIT 50"""
ORACLE["snapshot_summary"] = f"WITH {_snap_ctes()} SELECT * FROM summary"

_PAIR = _snap_ctes("doc_id % 13 <> 0", "c_", ".gz") + ", " + _snap_ctes("doc_id % 10 <> 0", "p_", ".psd")
_EXT_CHANGES = """ch AS (
  SELECT coalesce(c.ext, p.ext) AS ext,
         CASE WHEN p.ext IS NULL THEN 'new' ELSE 'removed' END AS change,
         coalesce(c.count, p.count) AS count
  FROM c_byext c FULL OUTER JOIN p_byext p ON c.ext = p.ext
  WHERE c.ext IS NULL OR p.ext IS NULL
)"""


def _fmt(x: str, decimals: int, use_abs: bool, units, last: str) -> str:
    test = f"abs({x})" if use_abs else x
    whens = " ".join(
        f"WHEN {test} < {1024 ** (k + 1)} THEN printf('%.{decimals}f', {x} / {float(1024 ** k)}) || ' {u}'"
        for k, u in enumerate(units))
    return (f"(CASE {whens} ELSE printf('%.{decimals}f', {x} / {float(1024 ** len(units))}) "
            f"|| ' {last}' END)")


def _fmt1_abs(x: str) -> str:
    """Size text, 1 decimal, unit by absolute value (printf rounds like Python)."""
    steps = ["B", "KB", "MB", "GB", "TB"]
    whens = " ".join(
        f"WHEN abs({x}) < {1024 ** (k + 1)} THEN printf('%.1f', {x} / {float(1024 ** k)}) || ' {u}'"
        for k, u in enumerate(steps))
    return f"(CASE {whens} ELSE printf('%.1f', {x} / {float(1024 ** 5)}) || ' PB' END)"


ORACLE["snapshot_ext_changes"] = f"WITH {_PAIR}, {_EXT_CHANGES} SELECT * FROM ch"
ORACLE["snapshot_diff"] = f"""WITH {_PAIR}, {_EXT_CHANGES},
d AS (
  SELECT CAST(greatest(c.total_files - p.total_files, 0) AS BIGINT) AS files_added,
         CAST(greatest(p.total_files - c.total_files, 0) AS BIGINT) AS files_removed,
         CAST(c.total_size_bytes - p.total_size_bytes AS BIGINT) AS size_change_bytes,
         (SELECT count(*) FROM ch WHERE change = 'new') AS new_extensions,
         (SELECT count(*) FROM ch WHERE change = 'removed') AS removed_extensions
  FROM c_summary c, p_summary p
)
SELECT *, coalesce(nullif(concat_ws(', ',
    CASE WHEN files_added > 0 THEN '+' || files_added || ' files' END,
    CASE WHEN files_removed > 0 THEN '-' || files_removed || ' files' END,
    CASE WHEN new_extensions > 0 THEN new_extensions || ' new extensions' END,
    CASE WHEN removed_extensions > 0 THEN removed_extensions || ' removed extensions' END,
    CASE WHEN size_change_bytes <> 0 THEN {_fmt1_abs('size_change_bytes')} || ' change' END), ''),
  'No changes') AS summary
FROM d"""
ORACLE["snapshot_diff_stored"] = ORACLE["snapshot_diff"].rsplit("FROM d", 1)[0] + (""", (SELECT '{' || coalesce(string_agg('"' || ext || '":' || count, ',' ORDER BY ext), '') || '}'
  FROM ch WHERE change = 'new') AS new_extension_counts
FROM d""")


# --- sort ------------------------------------------------------------------------------



def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _any_contains(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, '{n}')" for n in needles) + ")"


SFILES = """sfiles AS (
  SELECT path, name, parent, size, ext, artist, exif_date,
         CASE WHEN rel_parent = '' THEN '' ELSE split_part(rel_parent, '/', 1) END AS top,
         regexp_extract(parent, '[^/]*$', 0) AS parent_name
  FROM m
)"""

_FAMILY = f"""CASE WHEN ext IN {_in(_DOCUMENTS)} THEN 'documents'
  WHEN ext IN {_in(_MUSIC)} THEN 'music' WHEN ext IN {_in(_PICTURES)} THEN 'pictures'
  WHEN ext IN {_in(_VIDEOS)} THEN 'videos' END"""

_CAT = {
    "mixed": f"""CASE WHEN ext IN {_in(_DOCUMENTS)} THEN 'Documents'
  WHEN ext IN {_in(_MUSIC)} THEN 'Music' WHEN ext IN {_in(_PICTURES)} THEN 'Pictures'
  WHEN ext IN {_in(_VIDEOS)} THEN 'Videos' ELSE '_Misc' END""",
    "documents": f"""CASE WHEN ext IN {_in(_DOCUMENTS)} OR ext = '' THEN
  CASE WHEN {_any_contains('lower(top)', _PROFESSIONNEL)} THEN '05_Professionnel'
       WHEN {_any_contains('lower(top)', _PERSONNEL)} THEN '07_Personnel'
       WHEN {_any_contains('lower(top)', _RESSOURCES)} THEN '06_Ressources_et_Documentation'
       WHEN regexp_matches(top, '^_from_[0-9]+$') THEN '07_Personnel'
       ELSE '_Unclassified' END END""",
    "music": f"""CASE WHEN ext IN {_in(_MUSIC)} THEN coalesce(
  CASE WHEN artist <> '' THEN translate(artist, '/\\', '__') END,
  CASE WHEN starts_with(parent_name, '_from_')
       THEN '_Various/' || array_to_string(list_transform(string_split(substr(parent_name, 7), ' '),
         lambda w: upper(w[1]) || lower(w[2:])), ' ') END,
  '_Unknown') END""",
    "pictures": f"""CASE WHEN ext IN {_in(_DESIGN)} THEN '_Design'
  WHEN ext IN {_in(_IMAGES)} THEN coalesce(CAST(coalesce(
    nullif(TRY_CAST(regexp_extract(exif_date, '^([0-9]{{4}}):([0-9]{{2}}):([0-9]{{2}})', 1) AS INTEGER), 0),
    (SELECT y FROM (SELECT TRY_CAST(regexp_extract(name, '^([0-9]{{4}})[0-9]{{4}}', 1) AS INTEGER) AS y) WHERE y BETWEEN 1990 AND 2030),
    (SELECT y FROM (SELECT TRY_CAST(regexp_extract(name, '(?i)^(?:IMG|VID|PHOTO)_([0-9]{{4}})[0-9]{{4}}', 1) AS INTEGER) AS y) WHERE y BETWEEN 1990 AND 2030),
    (SELECT y FROM (SELECT TRY_CAST(regexp_extract(name, '([0-9]{{4}})[-_][0-9]{{2}}[-_][0-9]{{2}}', 1) AS INTEGER) AS y) WHERE y BETWEEN 1990 AND 2030)
  ) AS VARCHAR), '_Undated') END""",
    "videos": f"""CASE WHEN ext IN {_in(_VIDEOS)} THEN
  CASE WHEN regexp_matches(name, '(?i)^N_[0-9]{{8}}_[0-9]{{6}}\\.mp4$') THEN 'Dashcam'
       WHEN lower(top) IN {_in(_FILMS)} THEN 'Films'
       WHEN lower(top) = '_from_whatsapp video' THEN 'WhatsApp Video'
       WHEN lower(top) IN {_in(_FAMILLE)} THEN 'Famille'
       ELSE '_Misc' END END""",
}

ORACLE["detect_type"] = f"""WITH {M}, {SFILES},
c AS (SELECT count_if(fam = 'documents') AS documents, count_if(fam = 'music') AS music,
             count_if(fam = 'pictures') AS pictures, count_if(fam = 'videos') AS videos
      FROM (SELECT {_FAMILY} AS fam FROM sfiles) f),
t AS (SELECT *, documents + music + pictures + videos AS total FROM c)
SELECT *, CASE WHEN total > 0 AND documents / total > 0.8 THEN 'documents'
               WHEN total > 0 AND music / total > 0.8 THEN 'music'
               WHEN total > 0 AND pictures / total > 0.8 THEN 'pictures'
               WHEN total > 0 AND videos / total > 0.8 THEN 'videos' ELSE 'mixed' END AS detected_type
FROM t"""

for _t, _expr in _CAT.items():
    ORACLE[f"sort_{_t}"] = f"""WITH {M}, {SFILES}
SELECT path, category FROM (SELECT path, {_expr} AS category FROM sfiles) x WHERE category IS NOT NULL"""

# The fixture is 'mixed'; contenders for one (category, name) are numbered in
# path order, after the file of that name that lies in the folder already.
def _sort_plan(root: str) -> str:
    return f"""sp AS (
  SELECT path, size, category, name, stay, regexp_extract(name, '^.+([.][^.]+)$', 1) AS sfx,
         row_number() OVER (PARTITION BY category, name, stay ORDER BY path) - 1
           + max(CAST(stay AS INTEGER)) OVER (PARTITION BY category, name) AS k
  FROM (SELECT *, parent = '{root}/' || category AS stay
        FROM (SELECT path, size, name, parent, {_CAT['mixed']} AS category FROM sfiles) y) x
), spl AS (
  SELECT path, size, category, CASE WHEN stay THEN 'skip' ELSE 'move' END AS action,
         CASE WHEN stay THEN path ELSE '{root}/' || category || '/' || CASE WHEN k = 0 THEN name
           ELSE left(name, length(name) - length(sfx)) || '_' || CAST(k AS VARCHAR) || sfx END END AS dest
  FROM sp
)"""


_SORT_PLAN = _sort_plan("/drive")
ORACLE["sort_plan_collisions"] = f"WITH {M}, {SFILES}, {_SORT_PLAN} SELECT path, action, dest FROM spl"
ORACLE["sort_summary"] = f"""WITH {M}, {SFILES}, {_SORT_PLAN}
SELECT count(*) AS total_files, count_if(action = 'move') AS moved_count, count_if(action = 'skip') AS skipped_count,
       CAST(sum(CASE WHEN action = 'move' THEN size END) AS BIGINT) AS space_organized,
       count(DISTINCT CASE WHEN action = 'move' THEN category END) AS categories
FROM spl"""
ORACLE["sort_by_category"] = f"""WITH {M}, {SFILES}, {_SORT_PLAN}
SELECT category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM spl GROUP BY category"""


# --- rename -----------------------------------------------------------------------------

_RENAME_PROTECTED = "(" + " OR ".join(f"contains(rel_parent, '{p}')" for p in _RENAME_PROTECTED_NAMES) + ")"
_RENAME = f"""c0 AS (
  SELECT path, parent, name, size, md5,
         regexp_extract(name, '^.+([.][^.]+)$', 1) AS sfx,
         CASE WHEN regexp_matches(name, ' \\(([0-9]+)\\)\\.') THEN '(N)'
              WHEN regexp_matches(name, ' - Cop(?:y|ie)(?: \\([0-9]+\\))?\\.')
                THEN CASE WHEN contains(name, 'Copie') THEN '- Copie' ELSE '- Copy' END END AS pattern,
         regexp_extract(name, ' \\(([0-9]+)\\)\\.', 1) AS num
  FROM m WHERE NOT {_RENAME_PROTECTED}
), c1 AS (
  SELECT *, left(name, length(name) - length(sfx)) AS stem FROM c0 WHERE pattern IS NOT NULL
), c AS (
  SELECT *, parent || '/' || clean_name AS clean_path FROM (
    SELECT *, CASE WHEN pattern = '(N)' THEN
                (CASE WHEN suffix(stem, ' (' || num || ')')
                      THEN left(stem, length(stem) - length(' (' || num || ')')) ELSE stem END) || sfx
              ELSE regexp_replace(name, ' - Cop(?:y|ie)(?: \\([0-9]+\\))?\\.', '.', 'g') END AS clean_name
    FROM c1) t
), r AS (
  SELECT c.*, o.path IS NOT NULL AS has_orig, o.md5 AS orig_md5,
         row_number() OVER (PARTITION BY clean_path ORDER BY stem DESC, c.path DESC) AS rn
  FROM c LEFT JOIN m o ON o.path = c.clean_path
  WHERE c.clean_path <> c.path
), f AS (SELECT clean_path, md5 AS first_md5 FROM r WHERE rn = 1
), a AS (
  SELECT r.*, CASE
      WHEN NOT has_orig AND rn = 1 THEN 'rename'
      WHEN md5 IS NULL OR (CASE WHEN has_orig THEN orig_md5 ELSE first_md5 END) IS NULL THEN 'skip'
      WHEN md5 = (CASE WHEN has_orig THEN orig_md5 ELSE first_md5 END) THEN 'delete_duplicate'
      ELSE 'collision_rename' END AS action
  FROM r JOIN f USING (clean_path)
), plan AS (
  SELECT path, size, pattern, clean_path, action,
         CASE WHEN action = 'rename' THEN clean_path
              WHEN action = 'collision_rename' THEN
                parent || '/' || left(clean_name, length(clean_name) - length(regexp_extract(clean_name, '^.+([.][^.]+)$', 1)))
                || '_' || CAST(row_number() OVER (PARTITION BY clean_path, action ORDER BY stem DESC, path DESC) AS VARCHAR)
                || regexp_extract(clean_name, '^.+([.][^.]+)$', 1) END AS dest
  FROM a
  UNION ALL
  SELECT path, size, pattern, clean_path, 'skip', NULL FROM c WHERE clean_path = path
)"""

ORACLE["rename_patterns"] = f"WITH {M}, {_RENAME} SELECT path, pattern, clean_path FROM c"
ORACLE["rename_actions"] = f"WITH {M}, {_RENAME} SELECT path, clean_path, action, dest FROM plan"
ORACLE["rename_summary"] = f"""WITH {M}, {_RENAME}
SELECT count(*) AS total_scanned, count(*) AS pattern_files_found,
       count_if(action = 'rename') AS renamed, count_if(action = 'delete_duplicate') AS duplicates_deleted,
       count_if(action = 'collision_rename') AS collision_renamed, count_if(action = 'skip') AS skipped,
       CAST(coalesce(sum(CASE WHEN action = 'delete_duplicate' THEN size END), 0) AS BIGINT) AS space_freed,
       {_fmt("coalesce(sum(CASE WHEN action = 'delete_duplicate' THEN size END), 0)", 2, False, ["B", "KB", "MB", "GB"], "TB")}
         AS space_freed_human
FROM plan"""


# --- consolidate ------------------------------------------------------------------------

_ALL_PRESET = sorted({e for v in _PRESETS.values() for e in v})
_CONS_SKIP = r"(^|/)(\$RECYCLE\.BIN|System Volume Information|\.Trash-[^/]*|__pycache__|\.git|node_modules|\.vscode|\.idea)(/|$)"
_CONSOLIDATE = f"""cs AS (
  SELECT path, size, md5, name,
         starts_with(lower(path), '/drive/library/')
           AND NOT list_contains(string_split(lower(path), '/'), '_staging') AS in_target,
         string_split(rel, '/') AS parts
  FROM m
  WHERE NOT regexp_matches(rel_parent, '{_CONS_SKIP}') AND ext IN {_in(_ALL_PRESET)} AND size >= 100
), keys AS (SELECT DISTINCT md5, size FROM cs WHERE in_target AND md5 IS NOT NULL
), cp AS (
  SELECT o.path, o.size,
         CASE WHEN k.md5 IS NOT NULL THEN 'delete' ELSE 'move' END AS action,
         CASE WHEN k.md5 IS NULL THEN '/drive/Library/_STAGING/' ||
           CASE WHEN len(parts) < 2 THEN '_from_root'
                WHEN parts[-2] IN ('source', 'files', 'data') AND len(parts) >= 3
                  THEN '_from_' || parts[-3] || '_' || parts[-2]
                ELSE '_from_' || parts[-2] END || '/' || name END AS dest
  FROM cs o LEFT JOIN keys k ON o.md5 = k.md5 AND o.size = k.size
  WHERE NOT o.in_target AND o.md5 IS NOT NULL
)"""
ORACLE["consolidate_plan"] = f"WITH {M}, {_CONSOLIDATE} SELECT * FROM cp"
ORACLE["consolidate_summary"] = f"""WITH {M}, {_CONSOLIDATE}
SELECT count_if(action = 'move') AS files_moved, count_if(action = 'delete') AS files_deleted,
       CAST(coalesce(sum(CASE WHEN action = 'move' THEN size END), 0) AS BIGINT) AS space_organized,
       CAST(coalesce(sum(CASE WHEN action = 'delete' THEN size END), 0) AS BIGINT) AS space_freed,
       (SELECT count(*) FROM cs WHERE in_target AND md5 IS NOT NULL) AS already_in_target,
       (SELECT count(*) FROM cs WHERE md5 IS NULL) AS failed_hash_files,
       {_fmt("coalesce(sum(CASE WHEN action = 'move' THEN size END), 0)", 1, False, ["B", "KB", "MB", "GB", "TB"], "PB")}
         AS space_organized_human,
       {_fmt("coalesce(sum(CASE WHEN action = 'delete' THEN size END), 0)", 1, False, ["B", "KB", "MB", "GB", "TB"], "PB")}
         AS space_freed_human
FROM cp"""


# --- clean --------------------------------------------------------------------------------

_CLEAN_PROT = "(" + " OR ".join(f"contains(rel_parent, '{p}')" for p in _CLEAN_PROTECTED_NAMES) + ")"
_JUNK = r"^(desktop\.ini|Desktop\.ini|Thumbs\.db|thumbs\.db|\.DS_Store|ntuser\.ini|ntuser\.dat.*|NTUSER\.DAT.*|~\$.*|~WRL.*\.tmp|~WRF.*\.tmp|.*\.tmp|\.~lock\..*)$"
ORACLE["junk_files"] = f"""WITH {M}
SELECT path, size FROM m WHERE NOT {_CLEAN_PROT} AND regexp_matches(name, '{_JUNK}')"""

# folders: ancestors of every file (root included) and the fixed empty chains
_DIRS = f"""alld AS (
  SELECT DISTINCT CASE WHEN i = 0 THEN '/drive'
           ELSE '/drive/' || array_to_string(list_slice(string_split(rel_parent, '/'), 1, i), '/') END AS path
  FROM (SELECT rel_parent, unnest(generate_series(0, CASE WHEN rel_parent = '' THEN 0
                 ELSE len(string_split(rel_parent, '/')) END)) AS i FROM m) t
  UNION SELECT '/drive/' || rel FROM (VALUES {_EXTRA_DIRS}) v(rel)
), dd AS (
  SELECT path, len(string_split(path, '/')) AS depth,
         {" OR ".join(f"contains(substr(path, 8), '{p}')" for p in _CLEAN_PROTECTED_NAMES)} AS prot
  FROM alld
)"""
ORACLE["empty_dirs"] = f"""WITH {M}, {_DIRS},
stays AS (SELECT path FROM m UNION ALL SELECT path FROM dd WHERE prot),
blocked AS (SELECT DISTINCT d.path FROM dd d JOIN stays s ON starts_with(s.path, d.path || '/')),
h AS (SELECT a.path, max(b.depth - a.depth) AS height FROM dd a JOIN dd b
        ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY a.path)
SELECT d.path, h.height FROM dd d JOIN h USING (path)
WHERE NOT d.prot AND d.path NOT IN (SELECT path FROM blocked) AND h.height < 10"""

ORACLE["permission_plan"] = f"""WITH {M}
SELECT path, CAST(mode AS BIGINT) AS mode,
       CAST(mode | 420 | CASE WHEN (mode & 73) <> 0 THEN 73 ELSE 0 END AS BIGINT) AS new_mode
FROM m WHERE mode <> (mode | 420 | CASE WHEN (mode & 73) <> 0 THEN 73 ELSE 0 END)"""

_CLEAN = f"""junk AS (SELECT path, size FROM m WHERE NOT {_CLEAN_PROT} AND regexp_matches(name, '{_JUNK}')),
surv AS (SELECT * FROM m WHERE path NOT IN (SELECT path FROM junk)),
stays AS (SELECT path FROM surv UNION ALL SELECT path FROM dd WHERE prot),
blocked AS (SELECT DISTINCT d.path FROM dd d JOIN stays s ON starts_with(s.path, d.path || '/')),
h AS (SELECT a.path, max(b.depth - a.depth) AS height FROM dd a JOIN dd b
        ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY a.path),
ed AS (SELECT d.path FROM dd d JOIN h USING (path)
       WHERE NOT d.prot AND d.path NOT IN (SELECT path FROM blocked) AND h.height < 10)"""
ORACLE["clean_summary"] = f"""WITH {M}, {_DIRS}, {_CLEAN}
SELECT (SELECT count(*) FROM junk) AS junk_deleted,
       (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM junk) AS junk_size,
       (SELECT count(*) FROM ed) AS dirs_removed,
       (SELECT count(*) FROM surv WHERE mode <> (mode | 420 | CASE WHEN (mode & 73) <> 0 THEN 73 ELSE 0 END))
         AS permissions_to_fix"""


# --- dedup facets ---------------------------------------------------------------------------

ORACLE["duplicate_size_groups"] = f"""WITH {M}, {CAND}
SELECT size, count(*) AS n_files FROM cand GROUP BY size HAVING count(*) >= 2"""

ORACLE["duplicate_hash_groups"] = f"""WITH {M}, {CAND}, {_dedup_plan_sql(_DEEPEST).split('SELECT r.path')[0].strip()}
SELECT md5, size, n AS n_files, path AS keeper_path FROM ranked WHERE rn = 1 AND n >= 2"""

ORACLE["keeper_score"] = f"""WITH {M}, {CAND}
SELECT path, len(string_split(path, '/')) AS depth,
  CASE WHEN lower(name) LIKE '%copy of %' OR lower(name) LIKE '% - copy%' OR lower(name) LIKE '% - copie%'
        OR name LIKE '%(1)%' OR name LIKE '%(2)%' OR name LIKE '%(3)%' THEN 0 ELSE 1 END AS copy_rank,
  CASE WHEN regexp_matches(lower(path), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 0 ELSE 1 END AS uuid_rank,
  CASE WHEN regexp_matches(name, '\\([0-9]+\\)') THEN 0 ELSE 1 END AS parens_rank
FROM cand"""

_INCL = r"^(.*\.txt|.*\.PDF|.*\.jp.g|.*\.jpg)$"
_EXCL = r"^(.* - Copy\..*|[^f].*\(1\)\.txt)$"
ORACLE["dedup_include_exclude"] = f"""WITH {M}, {CAND},
cand2 AS (SELECT * FROM cand WHERE regexp_matches(name, '{_INCL}') AND NOT regexp_matches(name, '{_EXCL}')),
{_dedup_plan_sql(_DEEPEST, 'cand2').replace('r.size, r.md5, k.path AS keeper_path', 'k.path AS keeper_path')}"""

_CUSTOM_SKIP = r"(^|/)(Library|_from_\*|_from_[^/]*)(/|$)"
ORACLE["dedup_skip_dirs"] = f"""WITH {M},
cand3 AS (SELECT * FROM m WHERE size >= 100 AND NOT is_symlink AND NOT starts_with(name, '.')
          AND NOT regexp_matches(rel_parent, '{_CUSTOM_SKIP}')),
{_dedup_plan_sql(_DEEPEST, 'cand3').replace('r.size, r.md5, k.path AS keeper_path', 'k.path AS keeper_path')}"""


# --- plans ------------------------------------------------------------------------------------

_PLAN_DEEPEST = "plan AS (" + _dedup_plan_sql(_DEEPEST).replace("\nranked AS", "WITH ranked AS", 1) + ")"
ORACLE["apply_plan_dedup"] = f"""WITH {M}, {CAND}, {_PLAN_DEEPEST}
SELECT path, size, md5 FROM m WHERE path NOT IN (SELECT path FROM plan WHERE action = 'delete')"""

ORACLE["apply_plan_sort"] = f"""WITH {M}, {SFILES}, {_SORT_PLAN}
SELECT dest AS path, m.size, m.md5 FROM spl JOIN m USING (path)"""

_PREV = f"""m AS (SELECT *, substr(path, 8) AS rel, regexp_replace(substr(path, 8), '/?[^/]*$', '') AS rel_parent
          FROM {manifest_sql('doc_id % 10 <> 0')} x)"""
_CUR = f"cur AS (SELECT path, CASE WHEN mtime_s % 11 = 0 THEN size + 1 ELSE size END AS size FROM {manifest_sql('doc_id % 13 <> 0')} y)"
ORACLE["verify_plan"] = f"""WITH {_PREV}, {_CUR}, {CAND}, {_PLAN_DEEPEST}
SELECT p.path, p.action,
       CASE WHEN k.path IS NULL THEN 'keeper_missing' WHEN k.size <> p.size THEN 'keeper_changed'
            WHEN c.path IS NULL THEN 'already_gone' WHEN c.size <> p.size THEN 'size_changed'
            ELSE 'ok' END AS status
FROM plan p LEFT JOIN cur c ON c.path = p.path LEFT JOIN cur k ON k.path = p.keeper_path"""

ORACLE["oplog_recover"] = """
SELECT op_id, status FROM (
  SELECT user_id AS op_id,
         arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END,
                 event_id) AS status
  FROM events GROUP BY user_id) t
WHERE status <> 'done'"""

ORACLE["delete_batches"] = f"""WITH {M}, {CAND}, {_PLAN_DEEPEST},
d AS (SELECT path, size, (row_number() OVER (ORDER BY path) - 1) // 50 AS batch_id
      FROM plan WHERE action = 'delete')
SELECT batch_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes,
       min(path) AS first_path, max(path) AS last_path
FROM d GROUP BY batch_id"""


_U5 = ["B", "KB", "MB", "GB", "TB"]
ORACLE["format_sizes"] = f"""WITH {M}
SELECT path,
  {_fmt('size', 1, True, _U5, 'PB')} AS f1,
  {_fmt('(-size * 1536)', 1, True, _U5, 'PB')} AS f1_neg,
  {_fmt('(size * 1024 * 7)', 1, False, _U5, 'PB')} AS f2,
  {_fmt('(size * 1048576)', 2, False, _U5[:4], 'TB')} AS f3,
  {_fmt('(CAST(size AS HUGEINT) * 1099511627776)', 2, False, _U5[:4], 'TB')} AS f3_big,
  {_fmt('(CAST(size AS HUGEINT) * 17592186044416)', 1, False, _U5, 'PB')} AS f2_big
FROM m"""

# Chained reorganisation: junk removed, duplicates removed (deepest keeper),
# the rest sorted ('mixed'), snapshots before / after.
ORACLE["reorganize_summary"] = f"""WITH {M}, {_DIRS}, {_CLEAN},
m1 AS (SELECT * FROM m WHERE path NOT IN (SELECT path FROM junk)),
cand AS (SELECT * FROM m1 WHERE size >= 100 AND NOT is_symlink AND NOT starts_with(name, '.')
         AND NOT regexp_matches(rel_parent, '{_DEDUP_SKIP}')),
{_PLAN_DEEPEST},
m2 AS (SELECT * FROM m1 WHERE path NOT IN (SELECT path FROM plan WHERE action = 'delete')),
fam AS (SELECT {_FAMILY} AS f FROM m2),
det AS (SELECT CASE WHEN count(f) > 0 AND (count_if(f = 'documents') / count(f) > 0.8 OR count_if(f = 'music') / count(f) > 0.8
                 OR count_if(f = 'pictures') / count(f) > 0.8 OR count_if(f = 'videos') / count(f) > 0.8)
               THEN 'not mixed' ELSE 'mixed' END AS t FROM fam),
b AS (SELECT path, size, ext FROM m WHERE NOT regexp_matches(rel_parent, '{_SNAP_SKIP}')),
be AS (SELECT DISTINCT ext FROM b), ae AS (SELECT DISTINCT ext FROM m2),
d AS (
  SELECT (SELECT count(*) FROM junk) AS junk_deleted, (SELECT count(*) FROM ed) AS dirs_removed,
         (SELECT count(*) FROM surv WHERE mode <> (mode | 420 | CASE WHEN (mode & 73) <> 0 THEN 73 ELSE 0 END))
           AS permissions_fixed,
         (SELECT count(*) FROM plan WHERE action = 'delete') AS duplicates_deleted,
         (SELECT CASE WHEN t = 'mixed' THEN (SELECT count_if(parent <> '/drive/' || {_CAT['mixed']}) FROM m2) END FROM det) AS files_sorted,
         (SELECT count(*) FROM b) AS files_before, (SELECT count(*) FROM m2) AS files_after,
         CAST((SELECT sum(size) FROM m2) - (SELECT sum(size) FROM b) AS BIGINT) AS size_change_bytes,
         (SELECT count(*) FROM ae WHERE ext NOT IN (SELECT ext FROM be)) AS n_new,
         (SELECT count(*) FROM be WHERE ext NOT IN (SELECT ext FROM ae)) AS n_removed
)
SELECT junk_deleted, dirs_removed, permissions_fixed, duplicates_deleted, files_sorted, files_before, files_after, size_change_bytes,
  coalesce(nullif(concat_ws(', ',
    CASE WHEN files_after > files_before THEN '+' || (files_after - files_before) || ' files' END,
    CASE WHEN files_before > files_after THEN '-' || (files_before - files_after) || ' files' END,
    CASE WHEN n_new > 0 THEN n_new || ' new extensions' END,
    CASE WHEN n_removed > 0 THEN n_removed || ' removed extensions' END,
    CASE WHEN size_change_bytes <> 0 THEN {_fmt1_abs('size_change_bytes')} || ' change' END), ''),
  'No changes') AS summary
FROM d"""


# --- per-file projections ----------------------------------------------------------------------

ORACLE["picture_years"] = f"""WITH {M}
SELECT path,
  CAST(nullif(TRY_CAST(regexp_extract(exif_date, '^([0-9]{{4}}):([0-9]{{2}}):([0-9]{{2}})', 1) AS INTEGER), 0) AS BIGINT) AS exif_year,
  CAST(coalesce(
    (SELECT y FROM (SELECT TRY_CAST(regexp_extract(name, '^([0-9]{{4}})[0-9]{{4}}', 1) AS INTEGER) AS y) WHERE y BETWEEN 1990 AND 2030),
    (SELECT y FROM (SELECT TRY_CAST(regexp_extract(name, '(?i)^(?:IMG|VID|PHOTO)_([0-9]{{4}})[0-9]{{4}}', 1) AS INTEGER) AS y) WHERE y BETWEEN 1990 AND 2030),
    (SELECT y FROM (SELECT TRY_CAST(regexp_extract(name, '([0-9]{{4}})[-_][0-9]{{2}}[-_][0-9]{{2}}', 1) AS INTEGER) AS y) WHERE y BETWEEN 1990 AND 2030)
  ) AS BIGINT) AS name_year
FROM m WHERE ext IN {_in(_IMAGES)}"""

ORACLE["staging_subdirs"] = f"""WITH {M}, {_CONSOLIDATE.replace('AS in_target,', 'AS in_target, rel,')}
SELECT path, in_target,
  CASE WHEN len(parts) < 2 THEN '_from_root'
       WHEN parts[-2] IN ('source', 'files', 'data') AND len(parts) >= 3 THEN '_from_' || parts[-3] || '_' || parts[-2]
       ELSE '_from_' || parts[-2] END AS subdir
FROM cs"""

ORACLE["normalized_names"] = f"""WITH {M}
SELECT DISTINCT name, lower(strip_accents(trim(name))) AS normalized FROM m"""

ORACLE["oplog_from_plan"] = f"""WITH {M}, {CAND}, {_PLAN_DEEPEST}
SELECT sha256(action || ':' || path) AS op_id, action AS op_type, path AS source, md5 AS hash,
       size AS expected_size, 'pending' AS status
FROM plan WHERE action = 'delete'"""

ORACLE["apply_plan_rename"] = f"""WITH {M}, {_RENAME}
SELECT coalesce(p.dest, m.path) AS path, m.size, m.md5
FROM m LEFT JOIN plan p ON p.path = m.path
WHERE p.action IS NULL OR p.action <> 'delete_duplicate'"""

ORACLE["snapshot_record_shape"] = f"""WITH {_snap_ctes()},
samp AS (SELECT count(*) AS n FROM (
  SELECT row_number() OVER (PARTITION BY ext ORDER BY path) AS r FROM sf) t WHERE r <= 3),
tops AS (SELECT count(*) AS n FROM (
  SELECT top FROM sf WHERE top IS NOT NULL
  UNION SELECT rel FROM dirs WHERE NOT contains(rel, '/')
     AND rel NOT IN ('.git', '.svn', '.hg', 'node_modules', '__pycache__', '.venv', 'venv', '.pytest_cache', '.tox')) u)
SELECT '/drive' AS path, s.total_files, s.total_size_bytes,
       (SELECT count(*) FROM byext) AS n_extensions, (SELECT n FROM tops) AS n_top_dirs,
       (SELECT CAST(least(count(*), 50) AS BIGINT) FROM sf) AS n_largest,
       (SELECT path FROM sf ORDER BY size DESC, path LIMIT 1) AS largest_path,
       (SELECT n FROM samp) AS n_samples
FROM summary s"""

ORACLE["clean_plan_rows"] = f"""WITH {M}, {_DIRS},
junk AS (SELECT path FROM m WHERE NOT {_CLEAN_PROT} AND regexp_matches(name, '{_JUNK}')),
surv AS (SELECT * FROM m WHERE path NOT IN (SELECT path FROM junk)),
stays AS (SELECT path FROM surv UNION ALL SELECT path FROM dd WHERE prot),
blocked AS (SELECT DISTINCT d.path FROM dd d JOIN stays s ON starts_with(s.path, d.path || '/')),
h AS (SELECT a.path, max(b.depth - a.depth) AS height FROM dd a JOIN dd b
        ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY a.path)
SELECT path, 'delete' AS action FROM junk
UNION ALL
SELECT d.path, 'rmdir' FROM dd d JOIN h USING (path)
  WHERE NOT d.prot AND d.path NOT IN (SELECT path FROM blocked) AND h.height < 10
UNION ALL
SELECT path, 'chmod' FROM surv WHERE mode <> (mode | 420 | CASE WHEN (mode & 73) <> 0 THEN 73 ELSE 0 END)"""

# no owner columns in the fixture: every row gets the owner change
ORACLE["permission_plan_ntfs"] = f"""WITH {M}
SELECT path, CAST(mode AS BIGINT) AS mode,
       CAST(mode | 420 | CASE WHEN (mode & 73) <> 0 THEN 73 ELSE 0 END AS BIGINT) AS new_mode,
       CAST(1000 AS BIGINT) AS new_uid, CAST(1000 AS BIGINT) AS new_gid
FROM m"""

ORACLE["sort_plan_target"] = f"""WITH {M}, {SFILES}, {_sort_plan('/sorted')}
SELECT path, action, dest FROM spl"""


_DOCS = """dx AS (
  SELECT '/docs/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS t, doc_id FROM documents
), m AS (SELECT path, CAST(strlen(t) AS BIGINT) AS size, md5(t) AS md5, doc_id AS mtime_s, path AS name FROM dx WHERE strlen(t) > 0)"""
ORACLE["dedup_from_content"] = f"WITH {_DOCS}, " + _dedup_plan_sql("mtime_s DESC, path", "m")
ORACLE["consolidate_from_content"] = f"""WITH {_DOCS},
keys AS (SELECT DISTINCT md5, size FROM m WHERE mtime_s % 3 = 0),
cp AS (SELECT m.size, CASE WHEN k.md5 IS NULL THEN 'move' ELSE 'delete' END AS action
       FROM m LEFT JOIN keys k ON m.md5 = k.md5 AND m.size = k.size WHERE mtime_s % 3 <> 0)
SELECT count_if(action = 'move') AS files_moved, count_if(action = 'delete') AS files_deleted,
       CAST(coalesce(sum(CASE WHEN action = 'move' THEN size END), 0) AS BIGINT) AS space_organized,
       CAST(coalesce(sum(CASE WHEN action = 'delete' THEN size END), 0) AS BIGINT) AS space_freed,
       (SELECT count(*) FROM m WHERE mtime_s % 3 = 0) AS already_in_target, CAST(0 AS BIGINT) AS failed_hash_files,
       {_fmt("coalesce(sum(CASE WHEN action = 'move' THEN size END), 0)", 1, False, ["B", "KB", "MB", "GB", "TB"], "PB")}
         AS space_organized_human,
       {_fmt("coalesce(sum(CASE WHEN action = 'delete' THEN size END), 0)", 1, False, ["B", "KB", "MB", "GB", "TB"], "PB")}
         AS space_freed_human
FROM cp"""

ORACLE["consolidate_presets"] = " UNION ALL ".join(
    f"SELECT * FROM (WITH {M}, {_CONSOLIDATE.replace(_in(_ALL_PRESET), _in(v))} SELECT '{k}' AS preset, * FROM cp)"
    for k, v in _PRESETS.items())

# the target is its own tree: the files of an older inventory, below /archive
ORACLE["consolidate_target_tree"] = f"""WITH {M},
w AS (SELECT path, size, md5, name, rel, false AS archived FROM m
      UNION ALL SELECT '/archive' || path, size, md5, name, NULL, true FROM {manifest_sql('doc_id % 10 <> 0')} o),
cs AS (
  SELECT path, size, md5, name, archived AND NOT list_contains(string_split(lower(path), '/'), '_staging') AS in_target,
         string_split(rel, '/') AS parts
  FROM w WHERE NOT regexp_matches(regexp_replace(substr(path, CASE WHEN archived THEN 10 ELSE 8 END), '/?[^/]*$', ''), '{_CONS_SKIP}')
    AND lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) IN {_in(_ALL_PRESET)} AND size >= 100
), keys AS (SELECT DISTINCT md5, size FROM cs WHERE in_target AND md5 IS NOT NULL)
SELECT o.path, o.size, CASE WHEN k.md5 IS NOT NULL THEN 'delete' ELSE 'move' END AS action,
       CASE WHEN k.md5 IS NULL THEN '/archive/_STAGING/' ||
         CASE WHEN parts IS NULL OR len(parts) < 2 THEN '_from_root'
              WHEN parts[-2] IN ('source', 'files', 'data') AND len(parts) >= 3 THEN '_from_' || parts[-3] || '_' || parts[-2]
              ELSE '_from_' || parts[-2] END || '/' || name END AS dest
FROM cs o LEFT JOIN keys k ON o.md5 = k.md5 AND o.size = k.size
WHERE NOT o.in_target AND o.md5 IS NOT NULL"""

ORACLE["snapshot_quick"] = f"""WITH {_snap_ctes()}
SELECT s.total_files, s.total_size_bytes, (SELECT count(*) FROM byext) AS n_extensions, CAST(0 AS BIGINT) AS n_largest
FROM summary s"""

# a sort planned on the older inventory, checked when some files lie in the music folder already
ORACLE["verify_plan_sort"] = f"""WITH {_PREV}, {SFILES}, {_SORT_PLAN},
c0 AS (SELECT path, name, ext, size FROM {manifest_sql('doc_id % 13 <> 0')} y),
cur AS (SELECT path, max(size) AS size FROM (
  SELECT path, size FROM c0 UNION ALL SELECT '/drive/Music/' || name, size FROM c0 WHERE ext = '.mp3') u GROUP BY path)
SELECT p.path, p.action,
       CASE WHEN c.path IS NULL THEN 'already_gone' WHEN c.size <> p.size THEN 'size_changed'
            WHEN p.action = 'move' AND d.path IS NOT NULL THEN 'dest_exists' ELSE 'ok' END AS status
FROM spl p LEFT JOIN cur c ON c.path = p.path LEFT JOIN cur d ON d.path = p.dest"""

# one lake per extension family: the type is detected, then its rules sort
ORACLE["sort_auto_families"] = f"WITH {M}, {SFILES}\n" + " UNION ALL ".join(
    f"SELECT '{t}' AS family, path, category FROM (SELECT path, {_CAT[t]} AS category FROM sfiles WHERE ext IN {_in(v)}) x "
    "WHERE category IS NOT NULL" for t, v in
    {"documents": _DOCUMENTS, "music": _MUSIC, "pictures": _PICTURES, "videos": _VIDEOS}.items())

# a rename planned on the older inventory, checked against the newer one
ORACLE["verify_plan_rename"] = f"""WITH {_PREV}, {_RENAME},
cur AS (SELECT path, size FROM {manifest_sql('doc_id % 13 <> 0')} y)
SELECT p.path, p.action,
       CASE WHEN c.path IS NULL THEN 'already_gone' WHEN c.size <> p.size THEN 'size_changed'
            WHEN d.path IS NOT NULL THEN 'dest_exists' ELSE 'ok' END AS status
FROM plan p LEFT JOIN cur c ON c.path = p.path LEFT JOIN cur d ON d.path = p.dest"""

_FIXED_MODE = "(mode | 420 | CASE WHEN (mode & 73) <> 0 THEN 73 ELSE 0 END)"
ORACLE["apply_plan_clean"] = f"""WITH {M}
SELECT path, CAST({_FIXED_MODE} AS BIGINT) AS mode, CAST(1 AS BIGINT) AS uid, CAST(8 AS BIGINT) AS gid
FROM m WHERE {_CLEAN_PROT} OR NOT regexp_matches(name, '{_JUNK}')"""

# the sort of what clean leaves: junk is gone, modes are fixed
_SORT_LEFT = f"""sfiles AS (
  SELECT path, name, parent, size, ext, artist, exif_date,
         CASE WHEN rel_parent = '' THEN '' ELSE split_part(rel_parent, '/', 1) END AS top,
         regexp_extract(parent, '[^/]*$', 0) AS parent_name
  FROM {{left}}
)"""
ORACLE["stored_versions"] = f"""WITH {M}, m1 AS (SELECT * FROM m WHERE {_CLEAN_PROT} OR NOT regexp_matches(name, '{_JUNK}')),
{_SORT_LEFT.format(left='m1')}, {_SORT_PLAN}
SELECT dest AS path, m1.size, m1.md5, CAST({_FIXED_MODE} AS BIGINT) AS mode FROM spl JOIN m1 USING (path)"""
ORACLE["stored_verify"] = ORACLE["verify_plan"]

ORACLE["composed_plan"] = f"""WITH {M}, {_DIRS}, {_CLEAN},
m1 AS (SELECT * FROM m WHERE path NOT IN (SELECT path FROM junk)),
cand AS (SELECT * FROM m1 WHERE size >= 100 AND NOT is_symlink AND NOT starts_with(name, '.')
         AND NOT regexp_matches(rel_parent, '{_DEDUP_SKIP}')),
{_PLAN_DEEPEST},
m2 AS (SELECT * FROM m1 WHERE path NOT IN (SELECT path FROM plan WHERE action = 'delete')),
{_SORT_LEFT.format(left='m2')}, {_SORT_PLAN},
f AS (SELECT path, CASE WHEN mode <> {_FIXED_MODE} THEN {_FIXED_MODE} END AS fixed FROM m)
SELECT path, 'delete' AS action, CAST(NULL AS VARCHAR) AS dest, CAST(NULL AS BIGINT) AS new_mode, 'junk' AS reason FROM junk
UNION ALL SELECT path, 'rmdir', NULL, NULL, NULL FROM ed
UNION ALL SELECT path, 'delete', NULL, NULL, 'duplicate' FROM plan WHERE action = 'delete'
UNION ALL SELECT path, 'move', dest, fixed, 'sorted' FROM spl JOIN f USING (path) WHERE dest <> path
UNION ALL SELECT path, 'chmod', NULL, fixed, NULL FROM spl JOIN f USING (path) WHERE dest = path AND fixed IS NOT NULL"""

ORACLE["oplog_replan_recover"] = f"""WITH {M}, {_DIRS}, {_CLEAN}, {CAND}, {_PLAN_DEEPEST},
c AS (
  SELECT 'delete' AS op_type, path AS source, CAST(NULL AS BIGINT) AS new_mode FROM junk
  UNION ALL SELECT 'rmdir', path, NULL FROM ed
  UNION ALL SELECT 'chmod', path, CAST({_FIXED_MODE} AS BIGINT) FROM surv WHERE mode <> {_FIXED_MODE}
)
SELECT sha256('clean/' || op_type || ':' || source) AS op_id, op_type, source, CAST(NULL AS VARCHAR) AS hash, new_mode,
       CASE length(source) % 3 WHEN 1 THEN 'failed' ELSE 'pending' END AS status
FROM c WHERE length(source) % 3 <> 0 AND NOT (length(source) % 3 = 1 AND op_type = 'delete')
UNION ALL
SELECT sha256('dedup/' || action || ':' || path), action, path, md5, NULL, 'pending' FROM plan WHERE action = 'delete'"""

ORACLE["snapshot_diff_sharded"] = ORACLE["snapshot_diff"].replace("SELECT *, coalesce(nullif(concat_ws", "SELECT ch.*, coalesce(nullif(concat_ws").rsplit(
    "FROM d", 1)[0] + "FROM d, ch"
ORACLE["snapshot_diff_document"] = ORACLE["snapshot_diff"].replace(
    "SELECT *, coalesce(nullif(concat_ws", "SELECT '/drive' AS path, true AS is_diff, files_added, files_removed, size_change_bytes, new_extensions, coalesce(nullif(concat_ws")
ORACLE["oplog_recover_stored"] = f"""WITH {M}, {CAND}, {_PLAN_DEEPEST}
SELECT sha256(action || ':' || path) AS op_id, 'pending' AS status, path AS source, md5 AS hash, size AS expected_size
FROM plan WHERE action = 'delete' AND size % 2 <> 0"""
