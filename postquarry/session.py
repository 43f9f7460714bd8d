"""Session helpers: configuration, table access, lineage cutting and joins with hot keys."""

from __future__ import annotations

import functools
import logging
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table, as Catalyst estimates or its rows are counted, up to which it may be broadcast.
BROADCAST_BYTES = 32 << 20
#: A key of a join with more rows than this is hot; parts that it is split into; hot keys at most.
HOT_ROWS, SALTS, MOST_HOT = 1_000_000, 16, 100_000


def build_session(app: str = "postquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for (AQE, UTC, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map={**base, **conf}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors see: ``spark.checkpoint.dir``.

    Only a session that is one local process may go without; it gets a temporary folder. On a cluster an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return tempfile.mkdtemp(prefix="shared_")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and return it with its lineage cut; the copy survives lost executors.

    Copies go when their table is no longer referenced, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a (cut or cheap) table is proven to fit ``most`` bytes: its rows are counted, texts by their length."""
    width = F.lit(16)
    for c, kind in df.dtypes:
        c = F.col(f"`{c}`")
        width = width + (F.lit(8) if kind in ("bigint", "int", "double", "boolean", "date", "timestamp", "smallint", "tinyint", "float") else F.coalesce(F.length(c if kind == "string" else F.to_json(F.struct(c))), F.lit(0)) * 2 + 16)
    return (df.agg(F.sum(width.cast("bigint")).alias("n")).first()["n"] or 0) <= most


def look_up(rows: DataFrame, entries: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``entries`` where one key may hold a third of all rows; ``how`` is inner or left. ``entries`` should be cut.

    Entries that are proven small are broadcast. Otherwise the keys of more than ``hot_rows`` rows are found by counting; there are few of them by
    construction (``MOST_HOT`` at most, the bound is raised with the number of rows). Their rows are split into ``SALTS`` parts, for which only their entries
    are repeated; all other rows are joined by key.
    """
    if is_small(entries):
        return rows.join(F.broadcast(entries), keys, how)
    rows = cut(rows)
    hot_rows = max(hot_rows, rows.count() // MOST_HOT)
    hot = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select(*keys, F.lit(True).alias("__hot")))
    if hot.isEmpty():
        return rows.join(entries, keys, how)
    marked = rows.join(F.broadcast(hot), keys, "left")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int")
    repeated = entries.join(F.broadcast(hot.drop("__hot")), keys, "left_semi").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    split = marked.where("__hot").drop("__hot").withColumn("__part", part).join(repeated, [*keys, "__part"], how).drop("__part")
    return split.unionByName(marked.where("__hot is null").drop("__hot").join(entries, keys, how))


def timed(f: Callable) -> Callable:
    """``f``, whose duration and outcome are logged."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        began = time.time()
        try:
            out = f(*args, **kwargs)
        except Exception:
            logging.getLogger(__name__).exception("%s failed after %.2f s", f.__name__, time.time() - began)
            raise
        logging.getLogger(__name__).info("%s took %.2f s", f.__name__, time.time() - began)
        return out

    return run
