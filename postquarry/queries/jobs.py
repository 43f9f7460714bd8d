"""Queries of the operators on job tables, run over whole test tables, with the same results as SQL."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import markup, sections
from ..operators import analytics, quality, rules, tables
from ..plans import dashboard
from ..session import shared_folder, table
from ..sources import readers, sinks
from ..streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def jobs(spark, d):
    """combined_jobs with both names of the link and category columns merged."""
    return tables.rename_aliases(table(spark, d, "combined_jobs"))


# the same merge as SQL, and the item splitter
_JOBS = "(SELECT * REPLACE (coalesce(nullif(url, ''), nullif(job_url, '')) AS url, coalesce(nullif(job_category, ''), nullif(category, '')) AS job_category) FROM combined_jobs)"


def _split_sql(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '\\b\\w+ is an equal opportunities employer.*$', '', 's')"
    for pattern, by, flags in (("<br\\s*/?>", "\\n", "gi"), ("</li\\s*>", "\\n", "gi"), ("<li\\s*>", "", "gi"), ("<ul[^>]*>|</ul\\s*>", "", "gis"), ("<[^>]+>", " ", "gis")):
        t = f"regexp_replace({t}, '{pattern}', {'chr(10)' if by == chr(92) + 'n' else repr(by)}, '{flags}')"
    lines = f"list_transform(regexp_split_to_array({t}, '[\\r\\n]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"
    lines = f"list_transform({lines}, lambda s: regexp_replace(regexp_replace(regexp_replace(s, '^[\\-–—•*·]+\\s*', ''), '[\\s.;:,]+$', ''), '^\\s+|\\s+$', '', 'g'))"
    return f"list_distinct(list_filter({lines}, lambda s: s <> ''))"


_SKILLS = f"""s AS (
  SELECT job_category, unnest({_split_sql('basic_qual')}) AS skill, 1 AS b FROM {_JOBS}
  UNION ALL SELECT job_category, unnest({_split_sql('pref_qual')}), 0 FROM {_JOBS})"""


def _skills(df, **kw):
    return analytics.skill_counts(df, markup.qualifications(F.col("basic_qual")), markup.qualifications(F.col("pref_qual")), **kw)


@query(f"WITH {_SKILLS} SELECT skill, sum(b)::bigint AS basic_count, sum(1 - b)::bigint AS preferred_count, count(*) AS total_count FROM s GROUP BY skill ORDER BY total_count DESC, skill LIMIT 10")
def skills_top(spark, d):
    return analytics.page(_skills(jobs(spark, d)), 1, 10, F.desc("total_count"), F.col("skill"))


@query(f"""WITH {_SKILLS} SELECT coalesce(job_category, 'ALL') AS category, skill, basic_count, preferred_count, total_count FROM (
  SELECT job_category, skill, sum(b)::bigint AS basic_count, sum(1 - b)::bigint AS preferred_count, count(*) AS total_count, grouping(job_category) AS g
  FROM s GROUP BY GROUPING SETS ((skill), (job_category, skill))) WHERE g = 1 OR job_category IS NOT NULL""")
def skills_by_category(spark, d):
    return _skills(jobs(spark, d), category="job_category")


@query(f"""WITH {_SKILLS}, t AS (SELECT skill, count(*) AS total_count FROM s GROUP BY skill)
SELECT skill, total_count, 100.0::double * total_count / (SELECT count(*) FROM combined_jobs) AS pct FROM t ORDER BY total_count DESC, skill LIMIT 10 OFFSET 10""")
def skills_page2_pct(spark, d):
    df = jobs(spark, d)
    paged = analytics.page(_skills(df).select("skill", "total_count"), 2, 10, F.desc("total_count"), F.col("skill"))
    return paged.select("skill", "total_count", X.percent(F.col("total_count"), F.lit(df.count())).alias("pct"))


def _unescape_sql(c: str) -> str:
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;"), ("''", "&#x27;"), (" ", "&nbsp;"), ("&", "&amp;")):
        c = f"replace({c}, '{safe}', '{raw}')"
    return c


def _steps_sql(c: str, steps) -> str:
    for pattern, by, flags in steps:
        c = f"regexp_replace({c}, '{pattern}', {by}, '{flags}')"
    return c


def _visible_sql(c: str) -> str:
    breaks = (("<br\\s*/?", "chr(10)", "gi"), ("</(?:li|p)\\s*>", "chr(10)", "gi"), ("<(?:li|p)\\s*>", "''", "gi"), ("<ul[^>]*>|</ul\\s*>", "''", "gis"), ("<[^>]+>", "' '", "g"), ("\\s{2,}", "' '", "g"))
    t = _steps_sql(_unescape_sql(_unescape_sql(f"coalesce({c}, '')")), breaks)
    ends = ("^\\s+|\\s+$", "''", "g")
    one = _steps_sql("s", (ends, ("^[>\\-–—•*·\\s\\x{A0}]+", "''", ""), ("[\\s.;:,]+$", "''", ""), ends))
    kept = "regexp_matches(s, '[a-zA-Z]') AND NOT regexp_full_match(s, '(?i)n\\s*/?\\s*a|n[.]?a[.]?|nan') AND length(s) <= 180 AND NOT regexp_matches(s, '(?i)https?://') AND NOT regexp_matches(s, '(?i)(is\\s+an\\s+equal|privacy\\s+notice|inclusive\\s+culture|accommodations|recruiting\\s+decisions|workforce|protecting\\s+your\\s+privacy)')"
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array({t}, '[\\r\\n]+'), lambda s: {one}), lambda s: {kept}))"


@query(f"""WITH s AS (SELECT unnest({_visible_sql('basic_qual')}) AS skill, 1 AS b FROM combined_jobs WHERE coalesce(active, true) UNION ALL SELECT unnest({_visible_sql('pref_qual')}), 0 FROM combined_jobs WHERE coalesce(active, true))
SELECT skill, sum(b)::bigint AS basic_count, sum(1 - b)::bigint AS preferred_count, count(*) AS total_count FROM s GROUP BY skill""")
def skills_visible(spark, d):
    df = analytics.search(jobs(spark, d), status="active")
    return analytics.skill_counts(df, markup.visible_items(F.col("basic_qual")), markup.visible_items(F.col("pref_qual")))


@query("SELECT count(*) AS total, count(*) FILTER (coalesce(active, true)) AS active, count(*) FILTER (NOT coalesce(active, true)) AS inactive FROM combined_jobs")
def kpi_counts(spark, d):
    return analytics.kpis(table(spark, d, "combined_jobs"))


@query(f"""SELECT DISTINCT 'job_category' AS field, job_category AS value FROM {_JOBS} WHERE job_category IS NOT NULL
UNION SELECT 'role', role FROM combined_jobs WHERE role IS NOT NULL UNION SELECT 'team', team FROM combined_jobs WHERE team IS NOT NULL""")
def distinct_filters(spark, d):
    return analytics.distinct_values(jobs(spark, d), ("job_category", "role", "team"))


@query(f"""SELECT job_category AS category, count(*) AS n FROM {_JOBS} WHERE job_category IS NOT NULL GROUP BY 1 UNION ALL SELECT 'All Categories', count(*) FROM combined_jobs""")
def category_counts_all(spark, d):
    return analytics.category_counts(jobs(spark, d))


@query("""SELECT user_id::varchar AS user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts >= TIMESTAMP '2024-01-15' DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_keep_last(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    old, new = e.where("ts < '2024-01-15'"), e.where("ts >= '2024-01-15'")
    return tables.upsert(old, new, "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedupe_keep_first(spark, d):
    return tables.keep_first(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.col("ts"), F.col("event_id")).drop("ts")


@query("SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders) AS active FROM customer")
def reconcile_active(spark, d):
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.reconcile_active(table(spark, d, "customer").select("c_custkey", "c_name"), seen, "c_custkey")


@query("SELECT id, title FROM (SELECT id, title, row_number() OVER (PARTITION BY id ORDER BY row_id) AS n FROM combined_jobs WHERE id NOT IN (SELECT id FROM amazon_api_jobs WHERE id IS NOT NULL)) WHERE n = 1")
def new_only(spark, d):
    new = tables.keep_first(table(spark, d, "combined_jobs").where("id is not null").select("id", "title", "row_id"), "id", F.col("row_id"))
    return tables.new_only(new, table(spark, d, "amazon_api_jobs"), "id").select("id", "title")


@query("""SELECT o_orderkey, lower(trim(f)) NOT IN ('false', 'f', '0', 'no', 'n') AS active FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_orderstatus || ' ' WHEN 1 THEN 'No' WHEN 2 THEN '0.0' ELSE coalesce(o_orderstatus, '') END AS f FROM orders)""")
def coerce_active(spark, d):
    k, status = F.col("o_orderkey") % 4, F.col("o_orderstatus")
    text = F.when(k == 0, F.concat(F.lit(" "), status, F.lit(" "))).when(k == 1, "No").when(k == 2, "0.0").otherwise(F.coalesce(status, F.lit("")))
    return table(spark, d, "orders").select("o_orderkey", X.as_active(text).alias("active"))


_COMBINED_SQL = ", ".join(f"nullif({c}::varchar, '') AS {c}" for c in tables.COMBINED if c not in ("active", "url", "skills", "job_category"))


@query(f"""SELECT {_COMBINED_SQL}, coalesce(nullif(url, ''), nullif(job_url, '')) AS url, nullif(skills, '') AS skills, coalesce(nullif(job_category, ''), nullif(category, '')) AS job_category, coalesce(active, true) AS active FROM combined_jobs
UNION ALL BY NAME SELECT {_COMBINED_SQL}, nullif(job_url, '') AS url, NULL AS skills, nullif(job_category, '') AS job_category, coalesce(active, true) AS active FROM amazon_api_jobs""")
def combine_sources(spark, d):
    return dashboard.combined([table(spark, d, "combined_jobs"), table(spark, d, "amazon_api_jobs").drop("skills")])


@query("""SELECT row_id, CASE WHEN regexp_matches(n, '^amazon_api') THEN 'A' WHEN regexp_matches(n, '^amazon') THEN 'A, pages' WHEN regexp_matches(n, '^the') THEN 'B' ELSE 'unknown' END AS label
FROM (SELECT row_id, lower(regexp_extract(coalesce(source_file, ''), '([^/]*)$', 1)) AS n FROM combined_jobs)""")
def source_by_file(spark, d):
    return table(spark, d, "combined_jobs").select("row_id", tables.source_of(F.coalesce("source_file", F.lit("")), {"amazon_api": "A", "amazon": "A, pages", "the": "B"}).alias("label"))


_FULL = f"(SELECT * FROM {_JOBS} WHERE job_category <> '' AND company <> '' AND role <> '')"
_LEVELS = ("job_category", "company", "role")


@query(f"SELECT job_category AS source, company AS target, count(*) AS value FROM {_FULL} GROUP BY 1, 2 UNION ALL SELECT company, role, count(*) FROM {_FULL} GROUP BY 1, 2")
def flow_links(spark, d):
    return analytics.flow_links(jobs(spark, d), _LEVELS)


@query(f"SELECT name, count(*) AS n FROM (SELECT job_category AS name FROM {_FULL} UNION ALL SELECT company FROM {_FULL} UNION ALL SELECT role FROM {_FULL}) GROUP BY 1")
def flow_nodes(spark, d):
    return analytics.flow_nodes(jobs(spark, d), _LEVELS)


@query(f"SELECT name, name || ' - ' || count(*) AS label FROM (SELECT job_category AS name FROM {_FULL} UNION ALL SELECT company FROM {_FULL} UNION ALL SELECT role FROM {_FULL}) GROUP BY 1")
def flow_labels(spark, d):
    return analytics.flow_labels(flow_nodes(spark, d))


_GEO = "(SELECT c.c_custkey, r.r_name, n.n_name, c.c_mktsegment FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey)"
_GEO_LINKS = f"l AS (SELECT r_name AS source, n_name AS target, count(*) AS value FROM {_GEO} GROUP BY 1, 2 UNION ALL SELECT n_name, c_mktsegment, count(*) FROM {_GEO} GROUP BY 1, 2)"


def _geo(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer")
    return c.join(places, c["c_nationkey"] == places["n_nationkey"]).select("c_custkey", "r_name", "n_name", "c_mktsegment")


@query(f"""WITH {_GEO_LINKS}, p AS (SELECT r_name AS name, c_custkey, 0 AS k FROM {_GEO} UNION ALL SELECT n_name, c_custkey, 1 FROM {_GEO} UNION ALL SELECT c_mktsegment, c_custkey, 2 FROM {_GEO}),
n AS (SELECT name, row_number() OVER (ORDER BY min((c_custkey, k))) - 1 AS node_id FROM p GROUP BY 1)
SELECT a.node_id AS source_id, b.node_id AS target_id, value FROM l LEFT JOIN n a ON a.name = source LEFT JOIN n b ON b.name = target""")
def flow_numbered(spark, d):
    levels = ("r_name", "n_name", "c_mktsegment")
    geo = _geo(spark, d)
    return analytics.numbered_links(analytics.flow_links(geo, levels), analytics.number_nodes(geo, levels, "c_custkey"))


@query(f"WITH {_GEO_LINKS} SELECT DISTINCT * FROM l WHERE source = 'ASIA' OR target = 'ASIA' OR source IN (SELECT target FROM l WHERE source = 'ASIA')")
def flow_path(spark, d):
    return analytics.flow_path(analytics.flow_links(_geo(spark, d), ("r_name", "n_name", "c_mktsegment")), "ASIA")


_COLORS = ", ".join(f"'{c}'" for c in analytics.PALETTE)


@query(f"""WITH f AS (SELECT * FROM {_JOBS} WHERE job_category <> '' AND company <> ''), c AS (SELECT job_category, (dense_rank() OVER (ORDER BY min(row_id)) - 1) % 7 AS i FROM f GROUP BY 1),
n AS (SELECT company AS name, max_by(job_category, row_id) AS job_category FROM f GROUP BY 1)
SELECT name, [{_COLORS}][i + 1] AS color, replace([{_COLORS}][i + 1], ',0.8)', ',0.4)') AS link_color FROM n JOIN c USING (job_category)""")
def flow_colors(spark, d):
    return analytics.flow_colors(jobs(spark, d), "job_category", "company", "row_id")


_SEARCH = "(lower(title) LIKE '%planner%' OR lower(company) LIKE '%planner%') AND coalesce(active, true)"


@query(f"SELECT row_id, title, company FROM {_JOBS} WHERE {_SEARCH} AND job_category = 'Data & Insight' AND company IN (SELECT c FROM (VALUES ('Orvanta'), ('ORVANTA'), ('Orvanta AG')) t(c)) UNION ALL SELECT row_id, title, company FROM {_JOBS} WHERE (lower(title) LIKE '%planner%' OR lower(company) LIKE '%planner%') AND NOT coalesce(active, true)")
def search_filter(spark, d):
    df = jobs(spark, d).select("row_id", "title", "company", "active", "job_category")
    chosen = analytics.search(df, "Planner", "active", "Data & Insight", ("Orvanta", "ORVANTA", "Orvanta AG"))
    return chosen.unionByName(analytics.search(df, "planner", "Inactive")).select("row_id", "title", "company")


@query(f"SELECT company, count(*) AS n FROM {_JOBS} WHERE {_SEARCH} AND company <> '' GROUP BY 1")
def facet_counts(spark, d):
    return analytics.facet_counts(jobs(spark, d), term="planner", status="Active", companies=("Orvanta",))


@query("SELECT row_id, id FROM combined_jobs ORDER BY loaded_at DESC NULLS LAST, row_id LIMIT 50 OFFSET 50")
def newest_jobs_page(spark, d):
    return analytics.page(table(spark, d, "combined_jobs").select("row_id", "id", "loaded_at"), 2, 50, F.desc_nulls_last("loaded_at"), F.col("row_id")).select("row_id", "id")


_DATE_A = "try_strptime(regexp_replace(posting_date, '^Posted ', ''), ['%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y'])::date"
_DATE_B = "try_strptime(regexp_replace({c}, '^Posted ', ''), ['%B %d, %Y', '%b %d, %Y', '%Y-%m-%d', '%m/%d/%Y'])::date"


@query(f"SELECT row_id, CASE WHEN NOT regexp_matches(posting_date, '^\\s|\\s$') THEN {_DATE_A}::varchar END AS day FROM combined_jobs")
def date_parse_a(spark, d):
    return table(spark, d, "combined_jobs").select("row_id", X.parse_date(F.col("posting_date"), X.DATES_A).cast("string").alias("day"))


@query("SELECT load_seq, " + _DATE_B.format(c="posted_date") + "::varchar AS day, coalesce(strftime(" + _DATE_B.format(c="posted_date") + ", '%d %b, %Y'), nullif(posted_date, ''), 'N/A') AS shown FROM amazon_api_jobs")
def date_display(spark, d):
    c = F.col("posted_date")
    return table(spark, d, "amazon_api_jobs").select("load_seq", X.parse_date(c, X.DATES_B).cast("string").alias("day"), X.show_date(c).alias("shown"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY")
def recent_window(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    last = o.agg(F.max("o_orderdate").alias("last")).first()["last"]  # a literal, so that the filter reaches the files
    return o.where(F.col("o_orderdate") >= F.lit(last - timedelta(days=30)).cast(o.schema["o_orderdate"].dataType)).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT source, min(posting_date) AS first_posted, max(posting_date) AS last_posted FROM combined_jobs GROUP BY 1")
def date_range(spark, d):
    return table(spark, d, "combined_jobs").groupBy("source").agg(F.min("posting_date").alias("first_posted"), F.max("posting_date").alias("last_posted"))


_URL = "coalesce(nullif(url, ''), nullif(job_url, ''), '')"


@query(f"""SELECT row_id, nullif(regexp_extract({_URL}, '/jobs/(\\d+)', 1), '') AS path_id, regexp_replace({_URL}, '[^a-zA-Z0-9_-]', '_', 'g') AS safe_id,
CASE WHEN {_URL} ~* '^https?://.*' THEN replace(replace(replace(replace(replace({_URL}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') ELSE '#' END AS link,
CASE WHEN {_URL} ~ '.*[?&]ref=.*' THEN regexp_replace({_URL}, '([?&])ref=[^&]*', '\\1ref=x', 'g') ELSE {_URL} || CASE WHEN contains({_URL}, '?') THEN '&' ELSE '?' END || 'ref=x' END AS with_ref
FROM combined_jobs""")
def url_functions(spark, d):
    u = F.coalesce(F.col("url"), F.lit(""))
    return jobs(spark, d).select("row_id", X.path_id(u).alias("path_id"), X.safe_id(u).alias("safe_id"), X.safe_url(u).alias("link"), X.set_param(u, "ref", F.lit("x")).alias("with_ref"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS attribute,
replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS body FROM documents""")
def html_escape(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.escape(t).alias("attribute"), X.escape(t, breaks=True).alias("body"))


@query("""SELECT row_id, replace(replace(replace(replace(replace(replace(replace(description, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS text FROM combined_jobs""")
def entity_decode(spark, d):
    return table(spark, d, "combined_jobs").select("row_id", X.unescape(F.col("description")).alias("text"))


_STRIP = (
    ("\\r\\n?", "chr(10)", "g"), ("```.*?```", "' '", "gs"), ("`[^`]+`", "' '", "g"), ("https?://\\S+", "' '", "g"), ("[ \\t]+", "' '", "g"), ("\\n[ \\t]+", "chr(10)", "g"), ("[ \\t]+\\n", "chr(10)", "g"),
    ("\\n{3,}", "chr(10) || chr(10)", "g"), (" • ", "chr(10) || ''• ''".replace("''", "'"), "g"), (" - ", "chr(10) || ''- ''".replace("''", "'"), "g"), ("^\\s+|\\s+$", "''", "g"),
)
_BARE = _unescape_sql(_steps_sql("description", (("<(/?(?:br|p|li|ul|ol|h[1-6])\\b)", "chr(10) || ''<\\1''".replace("''", "'"), "gi"), ("<!--.*?-->|</?[a-z][^>]*>", "''", "gis"))))


@query(f"SELECT row_id, {_steps_sql(_BARE, _STRIP)} AS text FROM combined_jobs")
def strip_markup(spark, d):
    return table(spark, d, "combined_jobs").select("row_id", markup.plain_text(F.col("description")).alias("text"))


@query("SELECT doc_id, coalesce(regexp_matches(lower(text), 'access denied|blocked|captcha|robot|bot detection|rate limit|too many requests|suspicious activity'), false) AS blocked FROM documents")
def blocked_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", X.blocked(F.col("text")).alias("blocked"))


@query("""WITH t AS (SELECT row_id, coalesce(title, '') AS t FROM combined_jobs), p AS (SELECT *, CASE WHEN regexp_full_match(t, '[^,]+,\\s*[^,]+', 's') THEN 1 WHEN regexp_full_match(t, '[^-]+-\\s*[^-]+', 's') THEN 2
WHEN regexp_full_match(t, '.+?\\s+position\\s+.+') THEN 3 WHEN contains(t, ',') THEN 1 WHEN contains(t, ' - ') THEN 4 ELSE 0 END AS k FROM t)
SELECT row_id, regexp_replace(CASE k WHEN 1 THEN regexp_extract(t, '^([^,]*),', 1, 's') WHEN 2 THEN regexp_extract(t, '^([^-]+)-', 1, 's') WHEN 3 THEN regexp_extract(t, '^(.+?)\\s+position\\s+', 1) WHEN 4 THEN split_part(t, ' - ', 1) ELSE t END,
  CASE WHEN k = 0 THEN '$^' ELSE '^\\s+|\\s+$' END, '', 'g') AS role,
regexp_replace(CASE k WHEN 1 THEN regexp_extract(t, '^[^,]*,(.*)$', 1, 's') WHEN 2 THEN regexp_extract(t, '^[^-]+-(.*)$', 1, 's') WHEN 3 THEN regexp_extract(t, '^.+?\\s+position\\s+(.+)$', 1) WHEN 4 THEN substr(t, strpos(t, ' - ') + 3) ELSE '' END, '^\\s+|\\s+$', '', 'g') AS team FROM p""")
def role_team_split(spark, d):
    role, team = X.role_and_team(F.col("title"))
    return table(spark, d, "combined_jobs").select("row_id", role.alias("role"), team.alias("team"))


@query("""WITH t AS (SELECT row_id, coalesce(title, '') AS t FROM combined_jobs),
p AS (SELECT *, CASE WHEN contains(t, ',') THEN ',' WHEN contains(t, ' - ') THEN ' - ' WHEN contains(t, ' – ') THEN ' – ' WHEN contains(t, ' — ') THEN ' — ' WHEN regexp_matches(t, '[,–—-]\\s+') THEN regexp_extract(t, '\\s*[,–—-]\\s+') END AS sep FROM t)
SELECT row_id, regexp_replace(CASE WHEN sep IS NULL THEN t ELSE t[:strpos(t, sep) - 1] END, '^\\s+|\\s+$', '', 'g') AS role,
regexp_replace(CASE WHEN sep IS NULL THEN '' ELSE t[strpos(t, sep) + length(sep):] END, '^\\s+|\\s+$', '', 'g') AS team FROM p""")
def role_team_by_separator(spark, d):
    role, team = X.role_and_team_by_separator(F.col("title"))
    return table(spark, d, "combined_jobs").select("row_id", role.alias("role"), team.alias("team"))


#: Rules on words that occur in the test tables; a user loads their own with ``rules.load_rules``.
TEST_RULES = rules.Rules(
    titles={"Data": ["data platform", "customer insight", " analyst"], "Security": ["identity access", "fraud prevention"], "Infrastructure": ["network", "cloud storage", "architect "], "Planning": ["planner", "supply"]},
    slugs={"Data": ["sql", "python"], "Infrastructure": ["shell scripts", "load tests"], "Security": ["access reviews"]},
    order=("Data", "Security", "Infrastructure", "Planning"),
    overrides=((r"\blead\b", "Leadership"),),
    bonuses=(("Security", "Infrastructure", 0.5),),
)


def _hits_sql(c: str, words: list[str]) -> str:
    def one(w: str) -> str:
        inside, word = f"contains({c}, '{w}')", w.strip()
        return inside if word == w else f"({inside} OR regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}_]){word}($|[^\\p{{L}}\\p{{N}}_])'))"

    return "(" + " + ".join(f"{one(w)}::int" for w in words) + ")"


def _rules_sql(r: rules.Rules) -> str:
    names = list(r.order)
    raw = {}
    for n in names:
        s = f"1.0::double * {_hits_sql('t', r.titles[n])} + 1.0::double * {_hits_sql('t', r.titles[n])}"
        if r.slugs.get(n):
            s += f" + 0.8::double * len(list_intersect(k, [{', '.join(repr(x) for x in r.slugs[n])}]))"
        raw[n] = s + f" + 0.4::double * {_hits_sql('b', r.titles[n])}"
    cols = ", ".join(f"{s} AS s{i}" for i, s in enumerate(raw.values()))
    bonus = {n: f"s{i}" for i, n in enumerate(names)}
    for a, b, x in r.bonuses:
        bonus[a] += f" + CASE WHEN s{names.index(a)} > 0 AND s{names.index(b)} > 0 THEN {x}::double ELSE 0 END"
    best = "greatest(" + ", ".join(bonus.values()) + ")"
    pick = " ".join(f"WHEN {bonus[n]} = {best} THEN '{n}'" for n in names)
    over = " ".join(f"WHEN regexp_matches(t || ' ' || t, '{p}') THEN '{n}'" for p, n in r.overrides)
    return f"""WITH x AS (SELECT row_id, lower(coalesce(title, '')) AS t, lower(coalesce(description, '')) AS b, list_transform(string_split(coalesce(skills, ''), ', '), lambda v: lower(v)) AS k FROM combined_jobs),
y AS (SELECT row_id, t, {cols} FROM x) SELECT row_id, CASE {over} WHEN {best} < {r.least} THEN 'Other' {pick} END AS category FROM y"""


@query(_rules_sql(TEST_RULES))
def classify_rules(spark, d):
    slugs = F.split(F.coalesce("skills", F.lit("")), ", ")
    df = table(spark, d, "combined_jobs").select("row_id", "title", "skills", "description")
    return rules.classified(df, TEST_RULES, F.col("title"), slugs=slugs, description=F.col("description")).select("row_id", "category")


@query("SELECT doc_id, " + _hits_sql("lower(coalesce(text, ''))", ["team", " you ", "der ", "los"]) + " AS hits FROM documents")
def keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.hits(F.col("text"), ["team", " you ", "der ", "los"]).alias("hits"))


@query()
def parse_sections(spark, d):
    return sections.parsed(table(spark, d, "combined_jobs").select("row_id", "description")).drop("description")


def _label_sql(words: dict[str, tuple[str, ...]]) -> str:
    edge = "[^\\p{L}\\p{N}_]"

    def one(k: str, w: str) -> str:
        before = "^" if k == "responsibilities" else f"(?:^|{edge})"
        return f"WHEN regexp_matches(line, '{before}(?:{w})(?:$|{edge})', 'i') THEN '{k}'"

    return "CASE " + " ".join(one(k, "|".join(w).replace("'", "''")) for k, w in words.items()) + " END"


@query(f"""SELECT label, count(*) AS n FROM (SELECT {_label_sql(sections.LINE_WORDS)} AS label FROM (SELECT unnest(regexp_split_to_array(text, '\r?\n|[.] ')) AS line FROM documents)) GROUP BY 1""")
def fallback_lines(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", r"\r?\n|[.] ")).alias("line"))
    return lines.groupBy(sections.line_label(F.col("line")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, (json_extract_string(props, '$.k'))::bigint AS k, to_json({'event_id': event_id, 'note': replace(event_type, '</', '<\\/')})::varchar AS j FROM events")
def json_flatten(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"), X.guarded_json(F.struct("event_id", F.col("event_type").alias("note"))).alias("j"))


_RUNS = "(SELECT ts AS \"timestamp\", event_id % 50 AS total_jobs, value AS execution_time_seconds, event_type <> 'error' AS success FROM events)"


def _runs(spark, d):
    return table(spark, d, "events").select(F.col("ts").alias("timestamp"), (F.col("event_id") % 50).alias("total_jobs"), F.col("value").alias("execution_time_seconds"), (F.col("event_type") != "error").alias("success"))


@query(f"""SELECT count(*) AS n_runs, avg(execution_time_seconds) AS avg_time, min(execution_time_seconds) AS min_time, max(execution_time_seconds) AS max_time, avg(total_jobs) AS avg_jobs, avg(success::int) AS success_rate,
strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS last_run FROM {_RUNS} WHERE "timestamp" > TIMESTAMP '2024-01-20 00:00:00'""")
def run_metrics(spark, d):
    return quality.run_summary(_runs(spark, d), F.lit("2024-01-27").cast("timestamp")).withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


@query(f"""SELECT * EXCLUDE ("timestamp"), strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN execution_time_seconds > 0 THEN total_jobs / execution_time_seconds ELSE 0 END AS jobs_per_second FROM {_RUNS} WHERE "timestamp" > TIMESTAMP '2024-01-10 00:00:00'""")
def metrics_retention(spark, d):
    r = _runs(spark, d)
    old, new = r.where("timestamp < '2024-01-15'"), r.where("timestamp >= '2024-01-15'")
    return quality.with_rate(quality.retain(old, new, F.lit("2024-02-09").cast("timestamp"))).withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop("timestamp")


@query("""WITH f AS (SELECT user_id, min(ts::date::varchar) AS first FROM events GROUP BY 1), p AS (SELECT DISTINCT ts::date::varchar AS day, user_id FROM events),
c AS (SELECT day, count(*) AS n, count(*) FILTER (first < day) AS n_repeated FROM p JOIN f USING (user_id) GROUP BY 1)
SELECT *, (sum(n - n_repeated) OVER (ORDER BY day))::bigint AS n_new_total FROM c""")
def page_repeats(spark, d):
    return quality.page_repeats(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id"), "day", "user_id")


@query("""WITH e AS (SELECT ts::date::varchar AS day, CASE WHEN value < 10 THEN 'new' WHEN value < 40 THEN 'refresh' WHEN value < 70 THEN 'skip' ELSE 'error' END AS o FROM events),
c AS (SELECT day, count(*) FILTER (o = 'new') AS "new", count(*) FILTER (o = 'refresh') AS refresh, count(*) FILTER (o = 'skip') AS skip, count(*) FILTER (o = 'error') AS error, count(*) AS t FROM e GROUP BY 1)
SELECT * EXCLUDE (t), (sum(t) OVER (ORDER BY day))::bigint AS seen_total FROM c""")
def crawl_counts(spark, d):
    v = F.col("value")
    kind = F.when(v < 10, "new").when(v < 40, "refresh").when(v < 70, "skip").otherwise("error")
    return quality.crawl_counts(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), kind.alias("outcome")), "day", "outcome")


@query("""SELECT *, n_rows > 0 AND age_hours <= 8 AS healthy FROM (SELECT count(*) AS n_rows, count(*) FILTER (coalesce(active, true)) AS n_active, count(*) FILTER (NOT coalesce(active, true)) AS n_inactive,
count(*) FILTER (loaded_at::date >= DATE '2025-11-01') AS n_recent, '' AS missing_columns, epoch(TIMESTAMP '2025-12-01' - (SELECT max(loaded_at) FROM combined_jobs)) / 3600.0::double AS age_hours FROM combined_jobs)""")
def health_report(spark, d):
    df = table(spark, d, "combined_jobs")
    last = df.agg(F.max("loaded_at").cast("timestamp").alias("__last")).first()["__last"]
    return quality.health(df, F.to_date("loaded_at"), F.lit("2025-12-01").cast("timestamp"), F.lit(last).cast("timestamp"))


def _words_sql(k: str) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in sections.TELLING[k].split())})))"


@query(f"""WITH t AS (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents), c AS (SELECT doc_id, text, {_words_sql('en')} AS e, {_words_sql('other')} AS o FROM t)
SELECT doc_id FROM c WHERE text IS NULL OR regexp_full_match(text, '[\\s\\p{{Z}}]*') OR e + o = 0 OR e / (e + o) >= CASE WHEN length(text) < 25 THEN 0.6 ELSE 0.9 END""")
def english_filter(spark, d):
    return table(spark, d, "documents").where(sections.english(F.col("text"))).select("doc_id")


@query("""SELECT c_custkey, 'b,' || c_mktsegment || ',B' AS once, 'b,' || c_mktsegment AS folded, c_mktsegment || ',B' AS rest, CASE WHEN c_nationkey < 3 THEN c_mktsegment || ', B' ELSE '4 selected' END AS label FROM customer""")
def array_helpers(spark, d):
    few, many = F.array("c_mktsegment", F.lit("B")), F.array(F.lit("b"), F.col("c_mktsegment"), F.lit("B"), F.lit("b"))
    return table(spark, d, "customer").select(
        "c_custkey", F.array_join(X.first_of_each(many), ",").alias("once"), F.array_join(X.first_of_each(many, True), ",").alias("folded"),
        F.array_join(X.without(many, F.array(F.lit("b"))), ",").alias("rest"), X.chosen(F.when(F.col("c_nationkey") < 3, few).otherwise(many)).alias("label"),
    )


def _shown_sql(c: str) -> str:
    return f"replace(replace(replace(replace(coalesce(nullif({c}, ''), 'N/A'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS {c}"


@query(f"""SELECT id, {', '.join(_shown_sql(c) for c in ('title', 'company', 'role', 'team', 'job_category'))}, CASE WHEN coalesce(active, true) THEN 'Active' ELSE 'Inactive' END AS status,
coalesce(CASE WHEN NOT regexp_matches(posting_date, '^\\s|\\s$') THEN strftime({_DATE_B.format(c='posting_date')}, '%d %b, %Y') END, nullif(posting_date, ''), 'N/A') AS posted,
CASE WHEN {_URL} ~* '^https?://.*' THEN replace(replace(replace(replace(replace({_URL}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') ELSE '#' END AS link FROM (SELECT *, NULL AS job_url FROM (SELECT * EXCLUDE (job_url) FROM {_JOBS}))""")
def display_rows(spark, d):
    return dashboard.display_rows(jobs(spark, d))


@query(f"SELECT coalesce(job_category, '') AS job_category, coalesce(team, '') AS team, coalesce(role, '') AS role, coalesce(company, '') AS company, coalesce(title, '') AS title, coalesce(active, true) AS active FROM {_JOBS}")
def job_rows(spark, d):
    return dashboard.job_rows(jobs(spark, d))


@query("SELECT user_id, 1::bigint AS n FROM (SELECT DISTINCT user_id FROM events)")
def stream_new_rows(spark, d):
    """The events table as a stream of files, each user once; the result is how often the stream has written each user."""
    out = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    fresh = ingest.new_rows(stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "60 days")
    ingest.run_available(fresh, lambda batch, n: batch.select("user_id").write.mode("append").parquet(f"{out}/rows"), f"{out}/state")
    return spark.read.parquet(f"{out}/rows").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return ingest.windowed_counts(e, "ts", "6 hours", "1 day", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""SELECT load_seq, id, country_code, title FROM amazon_api_jobs WHERE country_code IN ('LUX', 'DEU') AND (lower(title) LIKE '%planner%' OR lower(title) LIKE '%analyst%') AND team IS NOT NULL
AND loaded_at::date >= DATE '2025-06-16' AND id NOT IN (SELECT id FROM combined_jobs WHERE id IS NOT NULL)""")
def source_predicates(spark, d):
    df = table(spark, d, "amazon_api_jobs").select("load_seq", "id", "country_code", "title", "team", "loaded_at")
    got = tables.wanted(df, "loaded_at", since=F.lit("2025-06-16").cast("date"), countries=("LUX", "DEU"), titles=("Planner", "analyst"), present=("team",), known=table(spark, d, "combined_jobs").where("id is not null"))
    return got.select("load_seq", "id", "country_code", "title")


@query("SELECT id FROM (SELECT id, loaded_at, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS n FROM combined_jobs WHERE id IS NOT NULL) WHERE n = 1 ORDER BY loaded_at DESC NULLS LAST, id LIMIT 50")
def newest_capped(spark, d):
    return tables.newest(table(spark, d, "combined_jobs").where("id is not null").select("id", "loaded_at"), "loaded_at", "id", 50).select("id")


@query(f"""WITH u AS (SELECT row_id, {_URL} || CASE WHEN contains({_URL}, '?') THEN '&' ELSE '?' END || 'city=&page=' || (row_id % 7) || '&country=LU&code=X' AS u FROM combined_jobs),
p AS (SELECT *, list_filter(string_split(regexp_extract(u, '[?]([^#]*)', 1), '&'), lambda x: contains(x, '=') AND NOT ends_with(x, '=') AND split_part(x, '=', 1) NOT IN ('', 'country')) AS k FROM u)
SELECT row_id, regexp_extract(u, '^([^?#]*)', 1) || '?' || array_to_string(k, '&') AS cleaned, coalesce(try_cast(regexp_extract(u, '[?&]page=([^&#]+)', 1) AS int), 1) AS page, contains(u, 'country=LU') AS in_lu FROM p""")
def url_queries(spark, d):
    u = F.coalesce(F.col("url"), F.lit(""))
    u = F.concat(u, F.when(u.contains("?"), "&").otherwise("?"), F.lit("city=&page="), (F.col("row_id") % 7).cast("string"), F.lit("&country=LU&code=X"))
    return jobs(spark, d).select("row_id", X.clean_query(u, "code", ("country",)).alias("cleaned"), X.int_param(u, "page", 1).alias("page"), X.has_param(u, "country", "LU").alias("in_lu"))


@query("""SELECT CASE WHEN coalesce(api_id, '') <> '' AND load_seq % 3 = 0 THEN id ELSE coalesce(nullif(regexp_extract(job_path, '/jobs/(\\d+)', 1), ''), api_id) END AS id, api_id, title, title AS role, company, city, country_code, job_category, is_manager, posted_date,
posted_date AS posting_date, description, basic_qual, pref_qual, team, job_path, 'https://h' || job_path AS job_url, apply_url, 'A' AS source FROM amazon_api_jobs""")
def flatten_pages(spark, d):
    """The snapshots put into pages of JSON as source A sends them, and read back from these."""
    t = table(spark, d, "amazon_api_jobs")
    job = F.struct(
        F.col("api_id").alias("id"), F.when(F.coalesce(F.col("api_id") != "", F.lit(False)) & (F.col("load_seq") % 3 == 0), F.col("id")).alias("id_icims"), "job_path", "title", F.col("company").alias("company_name"),
        "city", "country_code", "job_category", "is_manager", "posted_date", "description", F.col("basic_qual").alias("basic_qualifications"), F.col("pref_qual").alias("preferred_qualifications"),
        F.struct(F.col("team").alias("label")).alias("team"), F.col("apply_url").alias("url_next_step"),
    )
    pages = t.groupBy(F.floor(F.col("load_seq") / 10).alias("page")).agg(F.to_json(F.struct(F.count("*").alias("hits"), F.collect_list(job).alias("jobs"))).alias("json"))
    pages = pages.select("page", F.from_json("json", readers.PAGE_A).alias("p")).select("page", "p.*")
    return readers.flatten_a(pages, "https://h").drop("normalized_location", "location", "job_schedule_type", "is_intern", "description_short")


@query("""SELECT row_id::varchar AS id, title, CASE WHEN row_id % 2 = 0 THEN coalesce(company, '') ELSE '' END AS company, coalesce(location, '') AS location, posting_date,
CASE WHEN row_id % 3 = 0 THEN coalesce(nullif(url, ''), nullif(job_url, ''), '') ELSE coalesce(nullif(job_url, ''), nullif(url, ''), '') END AS url, coalesce(skills, '') AS skills, true AS active, '' AS job_category,
CASE WHEN row_id % 2 = 1 OR coalesce(company, '') = '' THEN 'External' ELSE company END AS team, title AS role, 'B' AS source FROM combined_jobs""")
def map_pages(spark, d):
    """The combined table put into pages as source B sends them, and mapped back from these."""
    t, odd = table(spark, d, "combined_jobs"), F.col("row_id") % 2 == 1
    first = F.col("row_id") % 3 == 0
    job = F.struct(
        F.col("row_id").cast("string").alias("id"), F.col("title").alias("job_title"), F.when(first, F.col("url")).otherwise(F.col("job_url")).alias("final_url"), F.lit("").alias("url"), F.when(first, F.col("job_url")).otherwise(F.col("url")).alias("source_url"),
        F.when(odd, F.lit("")).when(F.col("row_id") % 4 == 0, F.col("company")).alias("company"), F.struct(F.when(~odd, F.col("company")).alias("name")).alias("company_object"), "location", F.col("posting_date").alias("date_posted"),
        F.split("skills", ", ").alias("technology_slugs"),
    )
    pages = t.groupBy(F.floor(F.col("row_id") / 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(job).alias("data"))).alias("json"))
    pages = pages.select(F.from_json("json", readers.PAGE_B).alias("p")).select("p.*")
    return readers.map_b(pages).withColumn("skills", F.coalesce("skills", F.lit(""))).drop("description", "normalized_title", "technology_slugs")


@query("""(SELECT 'narrow' AS way, o_orderkey FROM orders WHERE o_orderdate::date >= (SELECT max(o_orderdate)::date FROM orders) - 2 AND o_orderpriority IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)
UNION ALL (SELECT 'wide', o_orderkey FROM orders WHERE o_orderdate::date >= (SELECT max(o_orderdate)::date FROM orders) - 20 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)""")
def poll_windows(spark, d):
    """The newest rows since the last run and, where there are none, of the whole window."""
    o = table(spark, d, "orders")
    last = o.agg(F.max(F.to_date("o_orderdate")).alias("d")).first()["d"]
    day = lambda n: date.fromordinal(last.toordinal() + n)
    narrow = readers.poll_landed(o, "o_orderdate", day(0), day(-2).isoformat(), 30, key="o_orderkey", present=("o_orderpriority",))
    wide = readers.poll_landed(o, "o_orderdate", day(10), day(5).isoformat(), 30, key="o_orderkey")
    return narrow.select(F.lit("narrow").alias("way"), "o_orderkey").unionByName(wide.select(F.lit("wide").alias("way"), "o_orderkey"))


def _own_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def table_upsert(spark, d):
    """A table written and upserted by bucket, read from its last version."""
    path, c = _own_folder(spark, "table"), table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    sinks.upsert_table(c.where("c_custkey % 2 = 0").withColumn("version", F.lit(1)), path, "c_custkey", F.col("version"), buckets=8)
    twice = c.where("c_custkey % 3 = 0").withColumn("segment", F.lit("new"))
    sinks.upsert_table(twice.withColumn("version", F.lit(0)).unionByName(twice.withColumn("version", F.lit(2))), path, "c_custkey", F.col("version"))
    return sinks.read_table(spark, path, "c_custkey bigint, segment string, version int").select(F.col("c_custkey").cast("bigint"), "segment", "version")


@query("SELECT c_custkey::varchar AS id, c_mktsegment AS title, c_custkey % 5 <> 0 AS active FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 <> 0")
def snapshot_table(spark, d):
    """Two full snapshots, one after the other: what the second lacks is inactive; an empty one changes nothing."""
    path, c = _own_folder(spark, "snapshots"), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("title"))
    each = ingest.reconciling(path, "id", F.col("title"))
    for n, snapshot in enumerate((c.where("k % 3 <> 0"), c.where("k % 5 <> 0"), c.where("false"))):
        each(snapshot.drop("k"), n)
    return sinks.read_table(spark, path, "id string, title string, active boolean").select("id", "title", "active")


@query("SELECT DISTINCT user_id::varchar AS id FROM events")
def known_ids(spark, d):
    path, e = _own_folder(spark, "seen"), table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id")
    for k in (0, 1, 1):
        sinks.remember(e.where(F.col("event_id") % 2 == k), path)
    return sinks.read_table(spark, path, "id string").select("id")


@query("""SELECT event_id AS total_jobs, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'""")
def runs_table(spark, d):
    path, e = _own_folder(spark, "runs"), table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("total_jobs"))
    now = F.lit("2024-02-09").cast("timestamp")
    sinks.record_run(e.where("total_jobs % 2 = 0"), path, now)
    sinks.record_run(e.where("total_jobs % 2 = 1"), path, now)
    return sinks.read_table(spark, path, "timestamp timestamp, total_jobs bigint").select("total_jobs", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT row_id::varchar AS row_id, nullif(title, '') AS title, nullif(description, '') AS description, nullif(company, '') AS company FROM combined_jobs""")
def csv_table(spark, d):
    """Titles and whole descriptions, quotes and line ends in them, through a CSV file."""
    path = _own_folder(spark, "csv")
    cols = [F.col("row_id").cast("string"), *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("title", "description", "company")]]
    table(spark, d, "combined_jobs").select(*cols).write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path)


@query("""SELECT p_partkey::varchar AS id, p_name || ' & ' || p_brand AS title, '/jobs/' || p_partkey AS link FROM part""")
def page_tiles(spark, d):
    """Parts as tiles of result pages, fifty a page, parsed back."""
    tile = F.concat(F.lit('<div class="tile" data-job-id="'), F.col("p_partkey"), F.lit('"><h3><a href="/jobs/'), F.col("p_partkey"), F.lit('">'), F.col("p_name"), F.lit(" &amp; "), F.col("p_brand"), F.lit("</a></h3><p>x</p></div>"))
    pages = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("page")).agg(F.concat_ws("\n", F.lit("<main>"), F.collect_list(tile)).alias("html"))
    return pages.select(F.explode(markup.tiles(F.col("html"))).alias("t")).select("t.id", "t.title", "t.link")


@query("""SELECT row_id, coalesce(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS said, 'Data' AS category FROM combined_jobs WHERE title IS NOT NULL AND NOT regexp_matches(title, '[<>&`]|https?://| - | • ') AND NOT regexp_matches(title, '^\\s|\\s$|\\s\\s')""")
def page_details(spark, d):
    """Titles as the paragraph under a heading of a detail page, found again."""
    t = table(spark, d, "combined_jobs").where(F.col("title").isNotNull() & ~F.col("title").rlike(r"[<>&`]|https?://| - | • ") & ~F.col("title").rlike(r"^\s|\s$|\s\s"))
    page = F.concat(F.lit('<a href="/x?category=data"><b>Data</b></a><h2>Basic</h2><p>no</p><h2 class="q">The DESCRIPTION</h2> <p>'), F.col("title"), F.lit("</p><h2>Basic</h2><p>z</p>"))
    return t.select("row_id", markup.after_heading(page, "description").alias("said"), markup.category_link(page).alias("category"))


def _heading_sql() -> str:
    label = "CASE " + " ".join("WHEN regexp_matches(line, '" + "|".join(f"(?:{p})" for p in v).replace("'", "''").replace("\\&", "&") + f"', 'i') THEN '{k}'" for k, v in sections.HEADINGS.items()) + " END"
    whole = "|".join(f"(?:{p})" for v in sections.HEADINGS.values() for p in v).replace("'", "''").replace("\\&", "&")
    return f"""SELECT label, heading, count(*) AS n FROM (SELECT {label} AS label, bare <> '' AND len(regexp_split_to_array(bare, '\\s+')) <= 6 AND regexp_matches(bare, '^(?:{whole})\\s*:?$', 'i') AS heading
FROM (SELECT line, regexp_replace(line, '^[\\s*#:]+|[\\s*#:]+$', '', 'g') AS bare FROM (SELECT unnest(regexp_split_to_array(text, '\\r?\\n|[.] ')) AS line FROM documents))) GROUP BY 1, 2"""


@query(_heading_sql())
def heading_lines(spark, d):
    """Lines of documents by the section that a heading of that wording has, and whether they are nothing but a heading."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", r"\r?\n|[.] ")).alias("line"))
    return lines.groupBy(sections.heading_label(F.col("line")).alias("label"), sections.is_heading(F.col("line")).alias("heading")).agg(F.count("*").alias("n"))


@query("""SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, o_orderkey FROM orders""")
def row_ordinals(spark, d):
    return analytics.ranked(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate"), F.col("o_orderkey")).select(F.col("rank").alias("ordinal"), "o_orderkey")


@query("SELECT DISTINCT company AS value FROM combined_jobs WHERE company <> ''")
def sorted_companies(spark, d):
    return analytics.sorted_distinct(table(spark, d, "combined_jobs"), "company")


@query("""SELECT row_id, trim(regexp_replace(lower(company), '\\s+', ' ', 'g')) AS collapsed, regexp_replace(u, '^(.*?)/search\\?', '\\1/search.json?') AS endpoint, ceil(row_id / 50)::bigint AS pages,
upper(source[1]) || lower(source[2:]) || '_Feed' AS titled FROM (SELECT *, CASE WHEN row_id % 2 = 0 THEN 'https://h/search?a=' || row_id ELSE 'https://h/x' END AS u FROM combined_jobs)""")
def text_functions(spark, d):
    u = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("https://h/search?a="), F.col("row_id"))).otherwise("https://h/x")
    return table(spark, d, "combined_jobs").select(
        "row_id", X.collapse(F.col("company")).alias("collapsed"), X.json_endpoint(u).alias("endpoint"), X.pages(F.col("row_id"), 50).alias("pages"), X.titled(F.concat("source", F.lit("_feed"))).alias("titled")
    )
