"""What changed between consecutive full snapshots.

Every snapshot is laid out by key in shards and sorted by key within a shard; the sorted run is
cut into content-defined chunks: a chunk starts at each key whose hash says so, so inserting or
removing a row moves no other boundary.  A chunk's digest is a sum over the digests of its rows.
Chunks with equal digests in two consecutive snapshots are discarded; only rows of the remaining
chunks are joined by key and classified.  All of it is JVM-side: one shuffle brings the rows of a
(snapshot, shard) together (latest row per key, chunk and digest share it), a second one joins
the chunk digests, a third the few rows of unmatched chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a chunk, on average.
CHUNK_ROWS = 64
#: Rows of a shard of one snapshot, on average; it is sorted in one task.
SHARD_ROWS = 100_000
#: Shards at least, so that small tables are sorted on several cores.
LEAST_SHARDS = 32


def plain_id(c: Column) -> Column:
    """An id as the bare number without padding, or the lower-case uuid; null if it is neither empty nor kept.

    Spaces, braces, a ``.0`` left over from a float column, and zeros in front are dropped.  Any other
    text is kept in lower case.  Null and blank give null.
    """
    t = F.lower(F.regexp_replace(c, r"[\s\p{Z}{}]+", ""))
    t = F.regexp_replace(t, r"^(?:urn:uuid:)", "")
    t = F.when(t.rlike(r"^\d+\.0*$"), F.regexp_extract(t, r"^(\d+)", 1)).otherwise(t)
    t = F.when(t.rlike(r"^0+\d+$"), F.regexp_replace(t, r"^0+", "")).otherwise(t)
    return F.when(t != "", t)


def content(df: DataFrame, skip: set[str], defaults: dict[str, object] | None = None) -> Column:
    """A 128-bit digest of all columns but ``skip``; null equals empty text, outer and repeated space is ignored."""
    parts = []
    for c, kind in sorted(df.dtypes):
        if c in skip:
            continue
        text = F.to_json(F.struct(df[c])) if kind.startswith(("array", "map", "struct")) else df[c].cast("string")
        if defaults and c in defaults:
            text = F.coalesce(text, F.lit(str(defaults[c]).lower()))
        if kind == "string":
            text = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
        parts.append(F.coalesce(text, F.lit("")))
    return F.md5(F.concat_ws("\u0001", F.lit(""), *parts))


def snapshot_changes(
    df: DataFrame,
    when: str = "snapshot_date",
    key: str = "id",
    order: str = "load_seq",
    ignore: tuple[str, ...] = ("loaded_at",),
    defaults: dict[str, object] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    shards: int = 0,
) -> DataFrame:
    """``when`` (later snapshot, text), ``key``, ``change`` (added, removed, changed) between consecutive snapshots.

    Within a snapshot the row of a key with the highest ``order`` counts (a null order is lowest; full
    ties are broken by content, so repeated rows are one).  Rows without a key or a snapshot date belong
    to no record and are left out.  The first snapshot has no changes.  An empty table, or one snapshot,
    gives no rows.  Extra columns are compared too, whatever their names.  There are as many ``shards`` as keep one at
    ``SHARD_ROWS`` rows if all rows were one snapshot's; all snapshots share the number, a power of two.
    """
    if not shards:  # counted from the files' footers
        shards, n = LEAST_SHARDS, df.count()
        while shards * SHARD_ROWS < n:
            shards *= 2
    skip = {when, key, order, *ignore}
    rows = df.select(
        df[when].cast("date").alias("__at"), plain_id(df[key].cast("string")).alias("__key"), df[order].alias("__order"),
        content(df, skip, defaults).alias("__content"),
    ).where("__at is not null and __key is not null")
    rows = rows.withColumn("__hash", F.xxhash64("__key")).withColumn("__shard", F.pmod("__hash", F.lit(shards)))
    here = Window.partitionBy("__at", "__shard")
    by_key = here.orderBy("__key", F.desc_nulls_last("__order"), "__content")
    # sorted by key: the first row of a key is its latest; a chunk starts at keys chosen by hash
    edge = F.when(F.pmod(F.shiftright("__hash", 16), F.lit(chunk_rows)) == 0, F.col("__key"))
    rows = (
        rows.withColumn("__before", F.lag("__key").over(by_key))
        .withColumn("__chunk", F.coalesce(F.last(edge, ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
        .where(~F.col("__key").eqNullSafe(F.col("__before")))
        .drop("__before")
    )
    rows = cut(rows)  # keys and digests only: the wide input is read once
    row_digest = F.xxhash64("__key", "__content")
    chunks = rows.groupBy("__at", "__shard", "__chunk").agg(
        F.count("*").alias("__n"),
        F.sum(F.shiftright(row_digest, 24)).alias("__d1"),
        F.bit_xor(F.xxhash64("__content", "__key")).alias("__d2"),
    )
    dates = rows.select("__at").distinct()
    # one row per snapshot: as few as there are deliveries, so one task and a broadcast are enough
    steps = dates.withColumn("__next", F.lead("__at").over(Window.orderBy("__at"))).where("__next is not null")
    # each chunk takes part as the old side of one step and the new side of another
    side = lambda x, at, is_new: x.join(F.broadcast(steps.select(F.col(at).alias("__at"), F.col("__next").alias("__step"))), "__at").withColumn("__new", F.lit(is_new))
    sided = side(chunks, "__at", False).unionByName(side(chunks, "__next", True))
    unmatched = (
        sided.groupBy("__step", "__shard", "__chunk", "__n", "__d1", "__d2")
        .agg(F.count("*").alias("__sides"), F.max("__new").alias("__new"))
        .where("__sides = 1")
        .select("__step", "__shard", "__chunk", "__new")
    )
    old_new = side(rows, "__at", False).unionByName(side(rows, "__next", True))
    left = old_new.join(unmatched, ["__step", "__shard", "__chunk", "__new"], "left_semi")
    change = (
        left.groupBy("__step", "__key")
        .agg(
            F.max(F.when(~F.col("__new"), F.col("__content"))).alias("__was"),
            F.max(F.when(F.col("__new"), F.col("__content"))).alias("__is"),
        )
        .withColumn("change", F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(F.col("__was") != F.col("__is"), "changed"))
    )
    return change.where("change is not null").select(
        F.date_format("__step", "yyyy-MM-dd").alias(when), F.col("__key").alias(key), "change"
    )
