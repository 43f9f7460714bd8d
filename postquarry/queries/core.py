"""Queries of the core operators for training data (general problems)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, snapshots, timestamps
from ..session import table


def p3_found(spark, d):
    return drift.schema_changes(table(spark, d, "job_files")).select("file_name", "field", "change", "new_field")


def p3_versions(spark, d):
    return drift.schema_versions(table(spark, d, "job_files")).withColumn("exported_on", F.col("exported_on").cast("string"))


def p3_table(spark, d):
    return drift.unified_table(table(spark, d, "job_files"))


def p3_kept(spark, d):
    """How many values of each record the unified table has in its long form: all that the record has."""
    return drift.unified_rows(table(spark, d, "job_files")).select("record_id", F.size("fields").cast("bigint").alias("n_values"))


def p4_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "amazon_api_jobs"), defaults={"active": True})


def p5_found(spark, d):
    return timestamps.odd_timestamps(table(spark, d, "combined_jobs"), table(spark, d, "feed_sources"))


QUERIES = {f.__name__: f for f in (p3_found, p3_versions, p3_table, p3_kept, p4_found, p5_found)}

_P4_COLUMNS = (
    "api_id title role company city country_code normalized_location location job_category job_schedule_type is_manager is_intern "
    "posted_date posting_date description description_short basic_qual pref_qual team job_path job_url apply_url source"
).split()


def _p4_sql() -> str:
    same = ", ".join(f"trim(regexp_replace(coalesce({c}::varchar, ''), '\\s+', ' ', 'g')) AS {c}" for c in _P4_COLUMNS)
    differ = " OR ".join(f"a.{c} <> b.{c}" for c in [*_P4_COLUMNS, "active"])
    return f"""
    WITH k AS (SELECT *, lower(regexp_replace(id, '[\\s{{}}]', '', 'g')) AS t FROM amazon_api_jobs),
    i AS (SELECT * EXCLUDE (id), CASE WHEN regexp_full_match(t, '\\d+(\\.0*)?') THEN ltrim(regexp_extract(t, '^\\d+'), '0') ELSE t END AS id FROM k),
    l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY snapshot_date, id ORDER BY load_seq DESC) = 1),
    r AS (SELECT snapshot_date::date AS d, id, coalesce(active, true) AS active, {same} FROM l),
    s AS (SELECT d, lead(d) OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM r)),
    a AS (SELECT s.n, r.* FROM r JOIN s USING (d) WHERE s.n IS NOT NULL),
    b AS (SELECT s.n, r.* FROM r JOIN s ON r.d = s.n)
    SELECT strftime(coalesce(a.n, b.n), '%Y-%m-%d') AS snapshot_date, coalesce(a.id, b.id) AS id,
      CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.n = b.n AND a.id = b.id
    WHERE a.id IS NULL OR b.id IS NULL OR {differ}"""



def _p5_sql() -> str:
    """The same rules in other words: group names instead of positions, and the engine's own zone arithmetic.

    A local time that occurs twice is read there as the second; the earlier of it and of one hour after the time an hour before is the first.
    """
    time = r"(?:(?:[T ]|, ?| at )(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([AaPp])[.]?[Mm][.]?\b)?(?: ?(Z|z|[A-Z]{2,5}|[+\-]\d{2}(?::?\d{2})?|\[?[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+\]?))?)?$"
    word = r"([A-Za-zÀ-ÿ]+)[.]?"
    tail = "'h', 'mi', 's', 'half', 'zone'"
    forms = (
        (r"^(\d{4})-(\d{2})-(\d{2})" + time, f"'y', 'mo', 'd', {tail}"),
        (r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(?:[.,]\d+)?()(?: ?(Z|z|[A-Z]{2,5}|[+\-]\d{2}(?::?\d{2})?))?)?$", f"'y', 'mo', 'd', {tail}"),
        (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})" + time, f"'y', 'mo', 'd', {tail}"),
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + time, f"'a', 'b', 'y', {tail}"),
        (r"^(\d{1,2})[.](\d{1,2})[.](\d{4})" + time, f"'d', 'mo', 'y', {tail}"),
        ("^" + word + r" (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + time, f"'month', 'd', 'y', {tail}"),
        (r"^(?:" + word + r",? )?(\d{1,2})[.]?[ \-](?:de |of )?" + word + r"[ \-](?:de )?(\d{4})" + time, f"'weekday', 'd', 'month', 'y', {tail}"),
    )
    month = "CASE " + " ".join(f"WHEN lower(f.month) IN ({', '.join(repr(n) for n in names.split())}) THEN {k}" for k, names in enumerate(timestamps.MONTHS, 1)) + " END"
    offset = "CASE upper(zone) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in timestamps.ABBREVIATIONS.items()) + " END"
    reads = []
    for k, (pattern, names) in enumerate(forms):
        have = {n.strip().strip("'") for n in names.split(",")}
        mo = "try_cast(f.mo AS int)" if "mo" in have else month if "month" in have else "try_cast(CASE WHEN mdy THEN f.a ELSE f.b END AS int)"
        d = "try_cast(f.d AS int)" if "d" in have else "try_cast(CASE WHEN mdy THEN f.b ELSE f.a END AS int)"
        pattern = pattern.replace("'", "''")
        reads.append(f"SELECT row_id, home, {k} AS step, try_cast(f.y AS int) AS y, {mo} AS mo, {d} AS d, coalesce(try_cast(nullif(f.h, '') AS int), 0) AS h, coalesce(try_cast(nullif(f.mi, '') AS int), 0) AS mi, coalesce(try_cast(nullif(f.s, '') AS int), 0) AS s, lower(f.half) AS half, regexp_replace(f.zone, '[\\[\\]]', '', 'g') AS zone FROM (SELECT row_id, home, mdy, regexp_extract(t, '{pattern}', [{names}]) AS f FROM t WHERE regexp_matches(t, '{pattern}'))")
    return f"""WITH c AS (SELECT row_id, source, trim(regexp_replace(posting_date, '[\\s\\p{{Z}}]+', ' ', 'g')) AS t FROM combined_jobs WHERE posting_date IS NOT NULL AND NOT regexp_full_match(posting_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z')),
t AS (SELECT row_id, regexp_replace(t, '^posted(?: on)?:? ', '', 'i') AS t, coalesce(home_zone, 'UTC') AS home, coalesce(numeric_order = 'MDY', false) AS mdy FROM c LEFT JOIN feed_sources USING (source) WHERE t <> ''),
r AS (SELECT * FROM ({' UNION ALL '.join(reads)}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY step) = 1),
q AS (SELECT *, CASE WHEN half = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END AS h24,
  CASE WHEN regexp_matches(zone, '^[+-]') THEN (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (zone[2:3]::int * 60 + coalesce(try_cast(nullif(regexp_replace(zone[4:], ':', ''), '') AS int), 0)) ELSE {offset} END AS minutes,
  CASE WHEN zone = '' THEN home WHEN contains(zone, '/') AND zone IN (SELECT name FROM pg_timezone_names()) THEN zone END AS region FROM r),
l AS (SELECT *, CASE WHEN h24 < 24 AND mi < 60 AND s < 60 AND mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND y > 0 THEN try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h24, mi, s) AS timestamp) END AS local FROM q),
m AS (SELECT row_id, coalesce(local - to_minutes(minutes), least(timezone('UTC', timezone(region, local)), timezone('UTC', timezone(region, local - INTERVAL 1 HOUR)) + INTERVAL 1 HOUR)) AS at FROM l),
e AS (SELECT row_id, epoch_ms(CASE WHEN regexp_full_match(t, '\\d{{10}}') THEN t::bigint * 1000 WHEN regexp_full_match(t, '\\d{{13}}') THEN t::bigint END) AS at FROM t)
SELECT t.row_id, coalesce(strftime(coalesce(m.at, e.at), '%Y-%m-%dT%H:%M:%SZ'), 'invalid') AS posted_utc FROM t LEFT JOIN m USING (row_id) LEFT JOIN e USING (row_id)"""


_P3_VERSIONS = """WITH v AS (SELECT * FROM job_files WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
k AS (SELECT feed, file_name, exported_on, key AS field, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM v, json_each(v.record)),
n AS (SELECT feed, file_name, field, kind, CASE WHEN kind IS NULL THEN -1 ELSE count(*) END AS c, min(exported_on) AS exported_on FROM k GROUP BY feed, file_name, field, kind),
s AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY feed, file_name, field ORDER BY c DESC, kind) = 1),
p AS (SELECT feed, file_name, min(exported_on)::date AS exported_on, md5(string_agg(field || ':' || coalesce(kind, 'null'), ',' ORDER BY field || ':' || coalesce(kind, 'null'))) AS fingerprint, count(*) AS n_fields FROM s GROUP BY feed, file_name),
w AS (SELECT *, (fingerprint IS DISTINCT FROM lag(fingerprint) OVER (PARTITION BY feed ORDER BY exported_on, file_name))::int AS fresh FROM p)
SELECT feed, file_name, exported_on::varchar AS exported_on, (sum(fresh) OVER (PARTITION BY feed ORDER BY exported_on, file_name))::bigint AS version, fingerprint, n_fields FROM w"""


def _p3_sql() -> str:
    """The same steps in other words: every value as a row, no hashes, no fingerprints; used for small tables."""
    amount = r"'^\d[\d, ]*( [A-Z]{3})?$'"
    bare = r"""CASE kind WHEN 'object' THEN regexp_replace(regexp_replace(text, '"[^"]*":', '', 'g'), '[{}\[\]"]', '', 'g') WHEN 'array' THEN regexp_replace(regexp_replace(text, '^\["?|"?\]$', '', 'g'), '"?,"?', '; ', 'g') ELSE text END"""
    t = f"lower(trim(regexp_replace(regexp_replace({bare}, '[;,] ?', '; ', 'g'), '\\s+', ' ', 'g')))"
    plain = f"""CASE WHEN kind = 'number' AND regexp_full_match(text, '1\\d{{12}}') THEN strftime(epoch_ms(try_cast(text AS bigint)), '%Y-%m-%d')
      WHEN regexp_matches(text, {amount}) THEN regexp_replace(regexp_replace(text, ' [A-Z]{{3}}$', ''), '[, ]', '', 'g') ELSE array_to_string(list_sort(string_split({t}, '; ')), '; ') END"""
    return f"""
    WITH r AS (SELECT record_id, feed, file_name, exported_on, record FROM job_files WHERE feed IS NOT NULL AND file_name IS NOT NULL AND json_valid(record) AND json_type(record) = 'OBJECT'),
    k AS (SELECT record_id AS r, feed, file_name, exported_on, key AS field, value ->> '$' AS text, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object'
      WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM r, json_each(r.record)),
    n AS (SELECT feed, file_name, field, kind, CASE WHEN kind IS NULL THEN -1 ELSE count(*) END AS c FROM k GROUP BY feed, file_name, field, kind),
    s AS (SELECT feed, file_name, field, kind AS type FROM n QUALIFY row_number() OVER (PARTITION BY feed, file_name, field ORDER BY c DESC, kind) = 1),
    f AS (SELECT feed, file_name, min(exported_on) AS day FROM k GROUP BY 1, 2),
    o AS (SELECT * FROM (SELECT feed, file_name, lag(file_name) OVER (PARTITION BY feed ORDER BY day, file_name) AS previous FROM f) WHERE previous IS NOT NULL),
    d AS (SELECT coalesce(a.feed, b.feed) AS feed, coalesce(a.file_name, b.file_name) AS file_name, coalesce(a.field, b.field) AS field, a.field IS NOT NULL AS is_now, b.field IS NOT NULL AS was, a.type AS new, b.type AS old
      FROM (SELECT o.feed, o.file_name, field, type FROM o JOIN s ON s.feed = o.feed AND s.file_name = o.file_name) a
      FULL JOIN (SELECT o.feed, o.file_name, field, type FROM o JOIN s ON s.feed = o.feed AND s.file_name = o.previous) b ON a.feed = b.feed AND a.file_name = b.file_name AND a.field = b.field),
    p AS (SELECT feed, file_name FROM d GROUP BY 1, 2 HAVING bool_or(was AND NOT is_now) AND bool_or(is_now AND NOT was)),
    q AS (SELECT o.* FROM o JOIN p USING (feed, file_name)),
    w AS (SELECT q.feed, q.file_name, k.file_name = q.file_name AS fresh, k.r, k.field, k.kind, k.text FROM q JOIN k ON k.feed = q.feed AND k.file_name IN (q.file_name, q.previous) WHERE k.kind IS NOT NULL),
    x AS (SELECT w.*, d.was, d.is_now, d.was <> d.is_now OR coalesce(d.old <> d.new, d.old IS DISTINCT FROM d.new) AS dressed FROM w JOIN d USING (feed, file_name, field)),
    y AS (SELECT * REPLACE (CASE WHEN h IN ('true', 'yes', 'y', '1') AND dressed THEN 'true' WHEN h IN ('false', 'no', 'n', '0') AND dressed THEN 'false' ELSE h END AS h) FROM (SELECT *, CASE WHEN dressed THEN {plain} ELSE text END AS h FROM x)),
    m AS (SELECT feed, file_name, h, min(r) FILTER (fresh) AS new_r, max(r) FILTER (fresh) AS new_z, min(r) FILTER (NOT fresh) AS old_r, max(r) FILTER (NOT fresh) AS old_z FROM y WHERE kind <> 'boolean' GROUP BY 1, 2, 3 HAVING new_r = new_z AND old_r = old_z),
    v AS (SELECT feed, file_name, new_r, old_r, count(*) AS c FROM m GROUP BY 1, 2, 3, 4),
    v1 AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY feed, file_name, new_r ORDER BY c DESC, old_r) = 1),
    v2 AS (SELECT * FROM v1 QUALIFY row_number() OVER (PARTITION BY feed, file_name, old_r ORDER BY c DESC, new_r) = 1),
    v3 AS (SELECT * FROM (SELECT *, max(c) OVER (PARTITION BY feed, file_name) AS most FROM v2) WHERE c * 3 >= most),
    g AS (SELECT v3.feed, v3.file_name, a.field AS gone, b.field AS came, count(*) AS n, avg((a.h = b.h)::int) AS share, count(DISTINCT a.h) AS kinds, avg((a.h = 'true')::int) AS pt, avg((b.h = 'true')::int) AS qt
      FROM v3 JOIN y a ON a.feed = v3.feed AND a.file_name = v3.file_name AND a.r = v3.old_r AND NOT a.fresh AND a.was AND NOT a.is_now
      JOIN y b ON b.feed = v3.feed AND b.file_name = v3.file_name AND b.r = v3.new_r AND b.fresh AND b.is_now AND NOT b.was GROUP BY 1, 2, 3, 4),
    h AS (SELECT *, pt * qt + (1 - pt) * (1 - qt) AS chance, 1 - levenshtein(lower(gone), lower(came)) / greatest(length(gone), length(came)) AS alike FROM g),
    i AS (SELECT * FROM h WHERE (kinds > 2 AND share >= {drift.AGREE}) OR (kinds <= 2 AND share >= {drift.AGREE_FLAGS} AND (alike >= {drift.ALIKE} OR (kinds = 2 AND chance < 1 AND (share - chance) / (1 - chance) >= {drift.ABOVE_CHANCE})))),
    z AS (SELECT feed, file_name, gone, came FROM i QUALIFY row_number() OVER (PARTITION BY feed, file_name, gone ORDER BY share DESC, n DESC, alike DESC, came) = 1 AND row_number() OVER (PARTITION BY feed, file_name, came ORDER BY share DESC, n DESC, alike DESC, gone) = 1)
    SELECT file_name, gone AS field, 'renamed' AS change, came AS new_field FROM z
    UNION ALL SELECT d.file_name, d.field, CASE WHEN d.was THEN 'removed' ELSE 'added' END, '' FROM d WHERE was <> is_now AND NOT EXISTS (SELECT 1 FROM z WHERE z.feed = d.feed AND z.file_name = d.file_name AND d.field = CASE WHEN d.was THEN gone ELSE came END)
    UNION ALL SELECT file_name, field, 'type_changed', '' FROM d WHERE was AND is_now AND old <> new
    UNION ALL SELECT z.file_name, z.came, 'type_changed', '' FROM z JOIN d a ON a.feed = z.feed AND a.file_name = z.file_name AND a.field = z.gone JOIN d b ON b.feed = z.feed AND b.file_name = z.file_name AND b.field = z.came WHERE a.old <> b.new"""


_P3_KEPT = "SELECT record_id, (SELECT count(*) FROM json_each(record) WHERE type <> 'NULL') AS n_values FROM job_files WHERE feed IS NOT NULL AND file_name IS NOT NULL AND json_valid(record) AND json_type(record) = 'OBJECT'"

SQL = {"p3_kept": _P3_KEPT, "p3_found": _p3_sql(), "p4_found": _p4_sql(), "p5_found": _p5_sql(), "p3_versions": _P3_VERSIONS}
