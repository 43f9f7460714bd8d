"""Run metrics, retention and checks of data quality."""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from .analytics import running

#: Columns that a healthy table has.
REQUIRED = ("id", "title", "active")


def with_rate(runs: DataFrame) -> DataFrame:
    """Runs with ``jobs_per_second``; 0 where no time passed."""
    t = F.col("execution_time_seconds")
    return runs.withColumn("jobs_per_second", F.when(t > 0, F.col("total_jobs") / t).otherwise(F.lit(0.0)))


def run_summary(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Count, times, mean jobs and success rate of the runs later than ``days`` before ``now``."""
    recent = runs.where(F.col("timestamp") > now - F.make_dt_interval(F.lit(days)))
    t = F.col("execution_time_seconds")
    return recent.agg(
        F.count("*").alias("n_runs"), F.avg(t).alias("avg_time"), F.min(t).alias("min_time"), F.max(t).alias("max_time"),
        F.avg("total_jobs").alias("avg_jobs"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.max("timestamp").alias("last_run"),
    )


def retain(runs: DataFrame, new: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """``runs`` and ``new`` without what is older than ``days`` before ``now``."""
    return runs.unionByName(new, allowMissingColumns=True).where(F.col("timestamp") > now - F.make_dt_interval(F.lit(days)))


def health(df: DataFrame, posted: Column, now: Column, modified: Column, max_age_hours: float = 8.0, days: int = 30) -> DataFrame:
    """One row: rows, active, inactive, recently posted, columns missing, age of the data, and whether all is well."""
    on = F.coalesce("active", F.lit(True))
    missing = [c for c in REQUIRED if c not in df.columns]
    age = X.age_hours(modified, now)
    out = df.agg(
        F.count("*").alias("n_rows"), F.count_if(on).alias("n_active"), F.count_if(~on).alias("n_inactive"),
        F.count_if(posted >= (now - F.make_dt_interval(F.lit(days))).cast("date")).alias("n_recent"),
    )
    out = out.withColumn("missing_columns", F.lit(",".join(missing))).withColumn("age_hours", age)
    return out.withColumn("healthy", (F.col("n_rows") > 0) & (F.col("age_hours") <= max_age_hours) & (F.col("missing_columns") == ""))


def freshness(spark: SparkSession, path: str, now: Column, fmt: str = "parquet") -> DataFrame:
    """``modified, age_hours`` of the newest file of a table, from the files' own times."""
    last = spark.read.format(fmt).load(path).select(F.col("_metadata.file_modification_time").alias("t")).agg(F.max("t").alias("modified"))
    return last.withColumn("age_hours", X.age_hours(F.col("modified"), now))


def missing_modules(names: tuple[str, ...]) -> list[str]:
    """Python modules that can't be found here, in order."""
    return [n for n in names if importlib.util.find_spec(n) is None]


def missing_folders(spark: SparkSession, paths: tuple[str, ...]) -> list[str]:
    """Folders that don't exist yet, on any file system, in order."""
    there = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return [x for x in paths if not there(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x))]


#: Why a crawl ends after a page, the first reason that holds.
STOPS = ("no tiles", "no new ids", "short page", "most jobs", "most pages", "same address", "filter lost", "offset stuck")


def crawl_stops(pages: DataFrame, size: int, most_jobs: int = 0, most_pages: int = 0, needed: tuple[str, str] | None = None) -> DataFrame:
    """``page, reason`` for landed pages (``page, url, offset, ids``): why a crawl should have ended there (null: it goes on).

    ``needed``: a parameter and value that every address must have. A most of 0 is no bound. Rows are pages, one window over them.
    """
    rows = pages.withColumn("__id", F.explode_outer("ids"))
    first = rows.where("__id is not null").groupBy("__id").agg(F.min("page").alias("__first"))
    new = rows.join(first, "__id", "left").groupBy("page").agg(F.first("url").alias("url"), F.first("offset").alias("offset"), F.count("__id").alias("n"), F.count_if(F.col("__first") == F.col("page")).alias("n_new"))
    w = Window.orderBy("page")
    new = new.withColumn("jobs", F.sum("n_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__url", F.lag("url").over(w)).withColumn("__offset", F.lag("offset").over(w)).withColumn("__k", F.row_number().over(w))
    holds = (
        F.col("n") == 0, F.col("n_new") == 0, F.col("n") < size, F.lit(most_jobs > 0) & (F.col("jobs") >= most_jobs), F.lit(most_pages > 0) & (F.col("__k") >= most_pages), F.col("url") == F.col("__url"),
        ~X.has_param(F.col("url"), *needed) if needed else F.lit(False), F.col("offset") <= F.col("__offset"),
    )
    return new.select("page", F.coalesce(*[F.when(h, name) for h, name in zip(holds, STOPS)]).alias("reason"))


def page_repeats(df: DataFrame, page: str, key: str) -> DataFrame:
    """``page, n, n_repeated, n_new_total``: ids of a page that an earlier page had, and ids so far."""
    first = df.groupBy(key).agg(F.min(page).alias("__first"))
    per = df.select(page, key).distinct().join(first, key).groupBy(page).agg(F.count("*").alias("n"), F.count_if(F.col("__first") < F.col(page)).alias("n_repeated"))
    return running(per.withColumn("__new", F.col("n") - F.col("n_repeated")), page, {"n_new_total": "__new"}).drop("__new")


def crawl_counts(df: DataFrame, page: str, outcome: str) -> DataFrame:
    """``page, new, refresh, skip, error`` and the running totals of all outcomes."""
    kinds = ("new", "refresh", "skip", "error")
    per = df.groupBy(page).agg(*[F.count_if(F.col(outcome) == k).alias(k) for k in kinds], F.count("*").alias("__n"))
    return running(per, page, {"seen_total": "__n"}).drop("__n")
