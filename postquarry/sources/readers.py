"""Readers: tables, paged JSON, request specs, rules and state."""

from __future__ import annotations

import functools
import json
import os
import re
import time
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import columns as X
from ..functions.sections import parsed
from ..operators.rules import Rules, classify
from ..operators.tables import fill_missing, wanted

#: A page of source A.
PAGE_A = (
    "hits bigint, jobs array<struct<id:string,id_icims:string,job_path:string,title:string,company_name:string,city:string,country_code:string,normalized_location:string,"
    "location:string,job_category:string,job_schedule_type:string,is_manager:boolean,is_intern:boolean,posted_date:string,description:string,description_short:string,"
    "basic_qualifications:string,preferred_qualifications:string,team:struct<label:string>,url_next_step:string>>"
)
_META = "struct<total_results:bigint,total:bigint,truncated_results:bigint,truncated_companies:bigint>"
#: A page of source B.
PAGE_B = (
    f"metadata {_META}, meta {_META}, data array<struct<id:string,job_title:string,normalized_title:string,final_url:string,url:string,source_url:string,company:string,"
    "company_object:struct<name:string>,location:string,date_posted:string,description:string,technology_slugs:array<string>>>"
)
# Request headers that are kept from a dump.
KEPT_HEADERS = "accept accept-language cookie referer sec-ch-ua sec-ch-ua-mobile sec-ch-ua-platform sec-fetch-dest sec-fetch-mode sec-fetch-site user-agent".split()


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV table with a header and quoted text over several lines; without a schema every column is text."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "")
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", False).csv(path)


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed page files with their number (digits of the file name); unreadable pages are rows of nulls."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("page", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1).try_cast("int"))


def flatten_a(pages: DataFrame, base: str) -> DataFrame:
    """One row per job of source A's pages, in the 24 columns of its table."""
    j = lambda n: F.col(f"j.{n}")
    return pages.select(F.explode("jobs").alias("j")).select(
        F.coalesce(X.filled(j("id_icims")), X.path_id(j("job_path")), j("id")).alias("id"), j("id").alias("api_id"), j("title").alias("title"), j("title").alias("role"),
        j("company_name").alias("company"), *[j(n).alias(n) for n in ("city", "country_code", "normalized_location", "location", "job_category", "job_schedule_type", "is_manager", "is_intern")],
        j("posted_date").alias("posted_date"), j("posted_date").alias("posting_date"), j("description").alias("description"), j("description_short").alias("description_short"),
        j("basic_qualifications").alias("basic_qual"), j("preferred_qualifications").alias("pref_qual"), F.col("j.team.label").alias("team"), j("job_path").alias("job_path"),
        F.concat(F.lit(base), j("job_path")).alias("job_url"), j("url_next_step").alias("apply_url"), F.lit("A").alias("source"),
    )


def map_b(pages: DataFrame, label: str = "B", rules: Rules | None = None) -> DataFrame:
    """One row per job of source B's pages, in the columns of its table and what it has besides; the category is the one its ``rules`` tell ('' without rules)."""
    j = lambda n: F.col(f"j.{n}")
    company = F.coalesce(X.filled(j("company"), F.col("j.company_object.name")), F.lit(""))
    return pages.select(F.explode("data").alias("j")).select(
        j("id").alias("id"), j("job_title").alias("title"), company.alias("company"), F.coalesce(j("location"), F.lit("")).alias("location"), j("date_posted").alias("posting_date"),
        F.coalesce(X.filled(j("final_url"), j("url"), j("source_url")), F.lit("")).alias("url"), j("description").alias("description"), F.array_join(j("technology_slugs"), ", ").alias("skills"),
        F.lit(True).alias("active"), F.when(company == "", "External").otherwise(company).alias("team"), j("job_title").alias("role"), F.lit(label).alias("source"),
        j("normalized_title").alias("normalized_title"), j("technology_slugs").alias("technology_slugs"),
    ).withColumn("job_category", classify(rules, F.col("title"), F.col("normalized_title"), F.col("technology_slugs"), F.col("description")) if rules else F.lit(""))


#: The columns of source B's table.
TABLE_B = (
    "id title company location posting_date url description skills active job_category team role source about responsibilities basic_qualifications preferred_qualifications benefits"
).split()


def process_b(pages: DataFrame, path: str | None = None, label: str = "B", rules: Rules | None = None) -> DataFrame:
    """Pages of source B to its table: mapped, descriptions parsed into sections, absent columns filled, in order, ids as text; upserted by id to ``path``, if given."""
    rows = fill_missing(parsed(map_b(pages, label, rules)), TABLE_B).select(*TABLE_B).withColumn("id", F.col("id").cast("string"))
    if path:
        from .sinks import upsert_table

        upsert_table(rows, path, "id")
    return rows


class PagedJob(InputPartition):
    """One page."""

    def __init__(self, offset: int, size: int):
        super().__init__(offset)
        self.offset, self.size = offset, size


class PagedReader(DataSourceReader):
    """Pages of a paged JSON service, one partition each: the first page tells how many there are."""

    def __init__(self, fetch: Callable[[int, int], dict], options: dict):
        self.fetch, self.size = fetch, int(options.get("pageSize", "10"))
        self.most = int(options.get("maxPages", "0"))

    def partitions(self) -> list[InputPartition]:
        n = -(-int(self.fetch(0, 1).get("hits", 0)) // self.size)
        return [PagedJob(k * self.size, self.size) for k in range(min(n, self.most) if self.most else n)]

    def read(self, partition: PagedJob):
        got = self.fetch(partition.offset, partition.size)
        for job in got.get("jobs") or []:  # a page may have become empty since they were counted
            yield (partition.offset // partition.size, json.dumps(job))


class Refused(Exception):
    """An answer with a status other than success, and how long the service asks to wait (seconds)."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def retrying(fetch: Callable, tries: int = 3, backoff: float = 0.5, statuses: tuple[int, ...] = (429, 500, 502, 503, 504), wait: Callable[[float], None] = time.sleep) -> Callable:
    """``fetch``, called again up to ``tries`` times where it is refused with one of ``statuses`` or the connection fails.

    Waits ``backoff`` times 1, 2, 4 ... seconds between, or as long as the service asks for. Any other refusal is raised at once.
    """

    @functools.wraps(fetch)
    def run(*args, **kwargs):
        for n in range(tries + 1):
            try:
                return fetch(*args, **kwargs)
            except Refused as x:
                if x.status not in statuses or n == tries:
                    raise
                wait(x.retry_after if x.retry_after is not None else backoff * 2**n)
            except OSError:
                if n == tries:
                    raise
                wait(backoff * 2**n)

    return run


def paged_source(name: str, fetch: Callable[[int, int], dict]) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; ``fetch(offset, limit)`` gives ``{hits, jobs}``.

    ``fetch`` may be made by ``retrying``; beyond its tries a failed page is a failed task, which Spark runs again. Options: pageSize, maxPages (0: all).
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, job string"

        def reader(self, schema):
            return PagedReader(fetch, self.options)

    return Paged


def read_request(spark: SparkSession, path: str) -> tuple[str, dict[str, str]]:
    """Url and kept headers of a dump of ``Key: value`` lines; comments, blanks and other lines are skipped. Without a url an error is raised."""
    lines = spark.read.text(path).where("value like '%:%' and not value rlike '^\\\\s*#'")
    parts = lines.select(F.lower(F.trim(F.substring_index("value", ":", 1))).alias("k"), F.trim(F.expr("substr(value, locate(':', value) + 1)")).alias("v"))
    found = {r["k"]: r["v"] for r in parts.where(F.col("k").isin("url", "request url", *KEPT_HEADERS)).collect()}
    url = found.pop("url", None) or found.pop("request url", None)
    if not url:
        raise ValueError(f"{path} names no url")
    return url, found


def discover(spark: SparkSession, folder: str, sources: dict[str, dict] | None = None, legacy: dict[str, str] | None = None, suffix: str = "_jobs.csv") -> list[str]:
    """The files to read, on any file system: those of the enabled sources by name, else of the legacy map, that exist; without any, all files of the folder with the suffix."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = {n: c.get("raw_filename") or f"{n}{suffix}" for n, c in (sources or {}).items() if c.get("enabled", True)} or dict(legacy or {})
    there = {f.getPath().getName() for f in fs.listStatus(root)} if fs.exists(root) else set()
    return [f"{folder}/{f}" for _, f in sorted(named.items()) if f in there] or [f"{folder}/{f}" for f in sorted(there) if f.endswith(suffix)]


def poll(count: Callable[[dict], int], page: Callable[[dict], list[dict]], today: date, last_run: str | None, max_age_days: int, page_size: int = 50, most: int = 50, wide_most: int = 10, **asked) -> tuple[list[dict], str]:
    """New rows of an incremental source and how they were got: ``narrow``, ``wide``, ``unchecked`` or ``none``.

    A count is asked for first. Nothing new since the last run: the whole window of ``max_age_days`` is counted, and up to ``wide_most`` of its rows
    are fetched. A count that times out: one page is fetched all the same. Pages are fetched until ``most`` rows, a short page or an empty one.
    """
    since = last_run or (today - timedelta(days=1)).isoformat()
    wide = (today - timedelta(days=max_age_days)).isoformat()

    def fetch(gte: str, n: int) -> list[dict]:
        got: list[dict] = []
        number = 0
        while len(got) < n:
            limit = min(page_size, n - len(got))
            rows = page({**asked, "posted_at_gte": gte, "posted_at_max_age_days": max_age_days, "limit": limit, "page": number})
            got += rows[:limit]
            if len(rows) < limit:
                break
            number += 1
        return got

    try:
        n = count({**asked, "posted_at_gte": since, "posted_at_max_age_days": max_age_days})
    except TimeoutError:
        return fetch(since, min(page_size, most)), "unchecked"
    if n > 0:
        return fetch(since, min(n, most)), "narrow"
    n = count({**asked, "posted_at_gte": wide, "posted_at_max_age_days": max_age_days}) if wide_most > 0 else 0
    return (fetch(wide, min(n, wide_most)), "wide") if n > 0 else ([], "none")


def poll_landed(df: DataFrame, posted: str, today: date, last_run: str | None, max_age_days: int, most: int = 50, wide_most: int = 10, **asked) -> DataFrame:
    """The same over rows that are landed already: the newest ``most`` since the last run or, where there are none, the newest ``wide_most`` of the whole window."""
    since = last_run or (today - timedelta(days=1)).isoformat()
    now = F.lit(today.isoformat()).cast("date")
    narrow = wanted(df, posted, since=F.lit(since).cast("date"), now=now, max_age_days=max_age_days, **asked)
    rows, n = (wanted(df, posted, now=now, max_age_days=max_age_days, **asked), wide_most) if narrow.isEmpty() else (narrow, most)
    return rows.orderBy(F.desc_nulls_last(posted), asked.get("key", "id")).limit(n)


def title_list(spark: SparkSession, path: str) -> DataFrame:
    """``title``: the titles of a JSON file, an object of lists or a plain list."""
    text = spark.read.option("wholetext", True).text(path).select(F.explode_outer(F.coalesce(F.flatten(F.map_values(F.from_json("value", "map<string,array<string>>"))), F.from_json("value", "array<string>"))).alias("title"))
    return text.where("title is not null")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one where there is none yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else spark.createDataFrame([], schema)


def deep_merge(defaults: dict, over: dict) -> dict:
    """Settings over defaults, level by level."""
    return {**defaults, **{k: deep_merge(defaults[k], v) if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in over.items()}}


def from_environment(config: dict, names: dict[str, str], env: dict[str, str] | None = None) -> dict:
    """Settings with those that the environment names (variable -> dotted path); a text becomes the type of the setting it replaces, a flag is 1, true, yes or on."""
    env = os.environ if env is None else env
    for variable, path in names.items():
        if variable in env:
            value: object = env[variable]
            old = setting(config, path)
            if isinstance(old, bool):
                value = str(value).lower() in ("1", "true", "yes", "on")
            elif isinstance(old, int | float):
                value = type(old)(value)
            over: dict = {}
            at, *parents = path.split(".")[::-1]
            over[at] = value
            for p in parents:
                over = {p: over}
            config = deep_merge(config, over)
    return config


def setting(config: dict, path: str, default=None, aliases: dict[str, str] | None = None):
    """A setting by its dotted path, or by the path that an older one is an alias of."""
    for way in (path, (aliases or {}).get(path)):
        at = config
        for part in way.split(".") if way else ():
            if not isinstance(at, dict) or part not in at:
                break
            at = at[part]
        else:
            if way:
                return at
    return default


def resolved(path: str, config_file: str | None = None) -> str:
    """An absolute path or one with a scheme as it is; a relative one from the project of the configuration file (the parent of a folder named config, else the file's folder)."""
    if os.path.isabs(path) or re.match(r"^[a-z][a-z0-9+.-]*://", path):
        return path
    folder = os.path.dirname(config_file) if config_file else "."
    return os.path.join(os.path.dirname(folder) if os.path.basename(folder) == "config" else folder, path)


def configured_path(config: dict, legacy: str, path: str, default: str, config_file: str | None = None) -> str:
    """A path of the configuration: the legacy key wins where it is present, else the new one, else the default; resolved against the project."""
    return resolved(setting(config, legacy) or setting(config, path) or default, config_file)


def fetch_details(links: DataFrame, fetch: Callable[[str], dict | None], schema: str, link: str = "link", parallel: int = 8) -> DataFrame:
    """The detail record of each link, ``parallel`` links at a time, with ``error``: null, or why there is none (``empty`` if the fetch gave nothing).

    Failed links are rows, so that they can be tried again or dropped: ``where("error is null")``.
    """
    fields = T.StructType.fromDDL(schema)
    names = fields.names
    out = T.StructType([T.StructField("link", T.StringType()), *fields.fields, T.StructField("error", T.StringType())])

    def run(batches):
        import pandas as pd

        for b in batches:
            got = []
            for x in b["l"]:
                try:
                    d = fetch(x)
                    error = None if d else "empty"
                except Exception as e:  # one bad page is one failed row
                    d, error = None, f"{type(e).__name__}: {e}"
                got.append([x, *[(d or {}).get(n) for n in names], error])
            yield pd.DataFrame(got, columns=["link", *names, "error"])

    return links.select(F.col(link).alias("l")).where("l is not null").distinct().repartition(parallel).mapInPandas(run, out)


#: How each kind of source is read into the columns of its table.
READERS: dict[str, Callable[..., DataFrame]] = {
    "pages_a": lambda spark, path, base="": flatten_a(read_pages(spark, path, PAGE_A), base),
    "pages_b": lambda spark, path: map_b(read_pages(spark, path, PAGE_B)),
    "csv": read_csv,
}


def read_source(kind: str, spark: SparkSession, path: str, **options) -> DataFrame:
    """A source by its kind; an unknown kind is an error."""
    if kind not in READERS:
        raise ValueError(f"no source kind {kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)
