"""Writers: versioned tables, upserts by bucket, archives, state and metrics.

A table is a folder of data folders and of manifests. A manifest (``_manifest-000000012.json``) names the data folder of each bucket
of one version; it is written last, as one new file, and the one with the highest number counts. So a reader sees the old version or the new
one, whatever is lost in between, and nothing is ever renamed, which object stores can't do at once.  An upsert writes only the
buckets that its rows fall into; the others are named again as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, tables

#: Buckets of a new table of this writer, by hash of the key.
BUCKETS = 64
#: Versions that are kept for readers that began before the last ones were written.
KEPT = 2
_MANIFEST = "_manifest-"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith(_MANIFEST)) if fs.exists(p) else []


def _text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest that counts: the newest that can be read; null where there is no table yet. A table whose manifests are all damaged is an error, not an empty table."""
    names = _manifests(spark, path)
    for name in reversed(names):
        try:
            return json.loads(_text(spark, f"{path}/{name}"))
        except ValueError:
            continue
    if names:
        raise ValueError(f"{path} has no readable manifest")
    return None


def _folders(spark: SparkSession, path: str, names: list[str]) -> set[str]:
    """The data folders that readable manifests name."""
    out: set[str] = set()
    for n in names:
        try:
            out |= set(json.loads(_text(spark, f"{path}/{n}"))["folders"].values())
        except ValueError:
            pass
    return out


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """The version becomes the one that counts; of older ones than the last ``KEPT`` the manifests go, and the folders that only they name."""
    names = _manifests(spark, path)
    number = max([int(n[len(_MANIFEST) :].split(".")[0]) for n in names], default=0) + 1
    p, fs = _fs(spark, f"{path}/{_MANIFEST}{number:09d}.json")
    out = fs.create(p, False)  # never over an existing one: of two writers the second fails
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    names = _manifests(spark, path)
    old, kept = names[:-KEPT], names[-KEPT:]
    for name in [*(_folders(spark, path, old) - _folders(spark, path, kept)), *old]:
        fs.delete(_fs(spark, f"{path}/{name}")[0], True)


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


def read_table(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The table as of its last version (of some ``buckets`` only, if given), or an empty one where there is none yet."""
    m = _manifest(spark, path)
    folders = sorted({f"{path}/{f}/__bucket={b}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets}) if m else []
    return spark.read.parquet(*folders) if folders else spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, key: str | None, buckets: int) -> tuple[str, list[int]]:
    """Rows written by bucket into a new folder; its name and the buckets that it has."""
    folder = f"data-{uuid.uuid4().hex}"
    part = _bucket(key, buckets) if key else F.lit(0)
    df.withColumn("__bucket", part).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{folder}")
    p, fs = _fs(df.sparkSession, f"{path}/{folder}")
    return folder, [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if "=" in f.getPath().getName()]


def overwrite(df: DataFrame, path: str, key: str | None = None, buckets: int = BUCKETS) -> None:
    """A table replaced by rows that may be read from it: a new version beside the old one, which counts from its manifest on."""
    spark = df.sparkSession
    folder, had = _write(df, path, key, buckets if key else 1)
    _commit(spark, path, {"key": key, "buckets": buckets if key else 1, "folders": {str(b): folder for b in had}})


def upsert_table(batch: DataFrame, path: str, key: str = "id", *order: Column, buckets: int = BUCKETS) -> bool:
    """A batch written over a table by key; an empty batch changes nothing and returns False. Only the buckets of the batch are read and written."""
    if batch.isEmpty():
        return False
    spark = batch.sparkSession
    m = _manifest(spark, path)
    n = m["buckets"] if m and m["key"] == key else buckets
    touched = sorted(r["b"] for r in batch.select(_bucket(key, n).alias("b")).distinct().collect())  # ``buckets`` numbers at most
    whole = m is not None and m["key"] != key
    old = read_table(spark, path, batch.schema.simpleString()[7:-1], None if whole else touched)
    folder, had = _write(tables.upsert(old, batch, key, *order), path, key, n)
    folders = {} if whole or not m else {b: f for b, f in m["folders"].items() if int(b) not in touched}
    _commit(spark, path, {"key": key, "buckets": n, "folders": {**folders, **{str(b): folder for b in had}}})
    return True


def archive(df: DataFrame, path: str, kind: str, at: Column, page: Column | None = None) -> None:
    """Raw rows appended with when, what and which page they were."""
    df.withColumns({"_ingest_ts": at, "_kind": F.lit(kind), "_page": page if page is not None else F.lit(None).cast("int")}).write.mode("append").partitionBy("_kind").parquet(path)


def back_up_response(spark: SparkSession, path: str, kind: str, at: str, request: dict, response: dict, page: int | None = None) -> bool:
    """One request and its response appended as JSON text; a failure is reported by False, it stops nothing."""
    try:
        row = (at, page, json.dumps(request, default=str), json.dumps(response, default=str))
        df = spark.createDataFrame([row], "timestamp_utc string, page int, request_payload string, response string")
        df.withColumn("_kind", F.lit(kind)).write.mode("append").partitionBy("_kind").parquet(path)
        return True
    except Exception:
        return False


def backup(df: DataFrame, path: str, stamp: str) -> str:
    """A dated copy; its path."""
    df.write.mode("errorifexists").parquet(f"{path}/{stamp}")
    return f"{path}/{stamp}"


def remember(ids: DataFrame, path: str, key: str = "id") -> None:
    """Ids added to those seen before, each once."""
    new = ids.select(F.col(key).cast("string").alias("id")).where("id is not null").distinct()
    upsert_table(new, path, "id")


def record_run(run: DataFrame, path: str, now: Column, days: int = 30) -> None:
    """A run added to the metrics; what is older than ``days`` goes."""
    old = read_table(run.sparkSession, path, run.schema.simpleString()[7:-1])
    overwrite(quality.retain(old, run, now, days), path)

