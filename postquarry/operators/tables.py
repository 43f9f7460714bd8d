"""DataFrame -> DataFrame: keep-last, reconciliation with a snapshot, union of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X

#: The columns of the table of all sources, in order.
COMBINED = "id title company location posting_date url description basic_qual pref_qual skills active job_category team role source".split()
#: Older or other names of combined columns.
ALIASES = {"job_url": "url", "category": "job_category", "basic_qualifications": "basic_qual", "preferred_qualifications": "pref_qual"}


def keep_last(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key by ``order`` (ascending); null is a key like any other."""
    w = Window.partitionBy(key).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(key).orderBy(*[c.asc_nulls_last() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(existing: DataFrame, batch: DataFrame, key: str, *order: Column) -> DataFrame:
    """``existing`` with the rows of ``batch``, which win over older rows of their key; columns of both."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both.withColumn(key, F.col(key).cast("string")), key, F.col("__new"), *order).drop("__new")


def reconcile_active(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``df`` with ``active``: whether its key is among those of ``seen`` (nulls are never seen)."""
    marks = seen.select(F.col(key).cast("string").alias("__k")).where("__k is not null").distinct().withColumn("__seen", F.lit(True))
    out = df.join(marks, df[key].cast("string") == F.col("__k"), "left")
    return out.withColumn("active", F.coalesce("__seen", F.lit(False))).drop("__k", "__seen")


def new_only(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key isn't known yet, each key once."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def rename_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Other names of columns replaced, or filled in from where both names exist."""
    for old, new in aliases.items():
        if old in df.columns and new in df.columns:
            df = df.withColumn(new, X.filled(F.col(new).cast("string"), F.col(old).cast("string"))).drop(old)
        elif old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def fill_missing(df: DataFrame, wanted: list[str], **defaults) -> DataFrame:
    """``df`` with every wanted column: an absent one is its default, else empty text."""
    return df.withColumns({c: F.lit(defaults.get(c, "")) for c in wanted if c not in df.columns})


def source_of(file_name: Column, labels: dict[str, str]) -> Column:
    """The label of the first prefix that a file name has; 'unknown' if none."""
    name = F.lower(F.regexp_extract(file_name, r"([^/]*)$", 1))
    out = F.lit("unknown")
    for prefix, label in reversed(labels.items()):
        out = F.when(name.startswith(prefix), label).otherwise(out)
    return out


def combine(sources: list[DataFrame], columns: list[str] = COMBINED) -> DataFrame:
    """All rows of all sources in the combined columns; flags are coerced, empty text is null, nothing is dropped.

    A column that no source has is empty text (a missing flag is true); one that only some have is null in the rest.
    """
    out = None
    for df in sources:
        df = rename_aliases(df)
        df = df.select(*[F.col(c).cast("string") for c in columns if c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out = out.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in out.columns])
    out = fill_missing(out, columns)
    return out.withColumn("active", X.as_active(F.col("active"))).select(*columns)


def wanted(
    df: DataFrame, posted: str, since: Column | None = None, now: Column | None = None, max_age_days: int = 0, countries: tuple[str, ...] = (), titles: tuple[str, ...] = (),
    present: tuple[str, ...] = (), known: DataFrame | None = None, key: str = "id", country: str = "country_code", title: str = "title",
) -> DataFrame:
    """Rows as a source would be asked for them: posted since a day, not older than so many days, of the countries, with one of the titles in
    theirs (any case), with the named columns filled, and not known yet. What isn't given asks for nothing; a null never fits what is asked."""
    day = F.col(posted).cast("date")
    if since is not None:
        df = df.where(day >= since)
    if max_age_days and now is not None:
        df = df.where(F.datediff(now.cast("date"), day) <= max_age_days)
    if countries:
        df = df.where(F.col(country).isin(*countries))
    if titles:
        held = F.lit(False)
        for t in titles:
            held = held | F.lower(F.col(title)).contains(t.lower())
        df = df.where(held)
    for c in present:
        df = df.where(F.col(c).isNotNull())
    return new_only(df, known, key) if known is not None else df


def newest(df: DataFrame, when: str, key: str, cap: int) -> DataFrame:
    """The ``cap`` newest keys, each once: a key's last row counts, ties go to the lesser key."""
    return keep_last(df, key, F.col(when)).orderBy(F.desc_nulls_last(when), key).limit(cap)
