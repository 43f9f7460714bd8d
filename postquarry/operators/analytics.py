"""Counts behind a dashboard: KPIs, facets, skills, the flow graph. One scan each, no driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..session import cut

# Colours of categories in order of appearance, and of anything without one.
PALETTE = tuple(f"rgba({c},0.8)" for c in ("31,119,180", "255,127,14", "44,160,44", "214,39,40", "148,103,189", "140,86,75", "227,119,194"))
NO_COLOR = "#CCCCCC"


def kpis(df: DataFrame) -> DataFrame:
    """``total, active, inactive``; a null flag is active."""
    on = F.coalesce("active", F.lit(True))
    return df.agg(F.count("*").alias("total"), F.count_if(on).alias("active"), F.count_if(~on).alias("inactive"))


def distinct_values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``field, value``: the distinct non-null values of the columns, in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    """The distinct filled values of a column, in order."""
    return df.select(F.col(column).cast("string").alias("value")).where("value is not null and value <> ''").distinct().orderBy("value")


def category_counts(df: DataFrame, category: str = "job_category") -> DataFrame:
    """``category, n`` of each category and of all; rows without a category count only in 'All Categories'."""
    t = df.groupBy(category).agg(F.count("*").alias("n"))
    return (
        t.rollup(category).agg(F.sum("n").alias("n"), F.grouping(category).alias("g"))
        .where(F.col(category).isNotNull() | (F.col("g") == 1))
        .select(F.when(F.col("g") == 1, "All Categories").otherwise(F.col(category)).alias("category"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def skill_counts(df: DataFrame, basic: Column, preferred: Column, category: str | None = None) -> DataFrame:
    """``[category,] skill, basic_count, preferred_count, total_count`` from arrays of items, each once a row and field.

    With ``category`` also the totals over all rows, as category 'ALL', from the same scan.
    """
    tagged = F.concat(F.transform(basic, lambda s: F.struct(s.alias("skill"), F.lit(1).alias("b"))), F.transform(preferred, lambda s: F.struct(s.alias("skill"), F.lit(0).alias("b"))))
    rows = df.select(*([category] if category else []), F.explode(tagged).alias("s")).select(*([category] if category else []), "s.skill", "s.b")
    sums = [F.sum("b").alias("basic_count"), F.sum(1 - F.col("b")).alias("preferred_count"), F.count("*").alias("total_count")]
    if not category:
        return rows.groupBy("skill").agg(*sums)
    fine = rows.groupBy(category, "skill").agg(*sums)  # first by the finest key, so that the roll-up moves little
    again = [F.sum(c).alias(c) for c in ("basic_count", "preferred_count", "total_count")]
    out = fine.groupingSets([["skill"], [category, "skill"]], category, "skill").agg(*again, F.grouping(category).alias("g"))
    return out.where(F.col(category).isNotNull() | (F.col("g") == 1)).select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col(category)).alias("category"), "skill", "basic_count", "preferred_count", "total_count"
    )


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of a sorted table; pages begin at 1."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def search(df: DataFrame, term: str = "", status: str = "", category: str = "ALL", companies: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose title or company holds the term (any case, literally), with the status, category and companies chosen.

    An empty term, status, list of companies, and the category 'ALL' choose everything.
    """
    if term.strip():
        needle = term.strip().lower()
        holds = lambda c: F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
        df = df.where(holds("title") | holds("company"))
    if status.lower() in ("active", "inactive"):
        on = F.coalesce("active", F.lit(True))
        df = df.where(on if status.lower() == "active" else ~on)
    if category and category.upper() != "ALL":
        df = df.where(F.col("job_category") == category)
    return df.where(F.col("company").isin(*companies)) if companies else df


def facet_counts(df: DataFrame, facet: str = "company", **filters) -> DataFrame:
    """``facet, n`` under all filters but the facet's own."""
    filters.pop("companies", None)
    return search(df, **filters).where(F.col(facet).isNotNull() & (F.col(facet) != "")).groupBy(facet).agg(F.count("*").alias("n"))


def flow_links(df: DataFrame, levels: tuple[str, str, str]) -> DataFrame:
    """``source, target, value``: counts between neighbouring levels, rows with all levels filled."""
    a, b, c = levels
    full = df.where(" and ".join(f"{x} is not null and {x} <> ''" for x in levels))
    fine = full.groupBy(a, b, c).agg(F.count("*").alias("n"))
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.col(x).cast("string").alias("source"), F.col(y).cast("string").alias("target")) for k, (x, y) in enumerate(((a, b), (b, c)))])
    return fine.select(F.explode(steps).alias("s"), "n").groupBy("s.step", "s.source", "s.target").agg(F.sum("n").alias("value")).select("source", "target", "value")


def flow_nodes(df: DataFrame, levels: tuple[str, str, str]) -> DataFrame:
    """``name, n``: rows at each node; a name found at several levels is one node whose counts add up."""
    full = df.where(" and ".join(f"{x} is not null and {x} <> ''" for x in levels))
    fine = full.groupBy(*levels).agg(F.count("*").alias("n"))
    return fine.select(F.explode(F.array(*[F.col(x).cast("string") for x in levels])).alias("name"), "n").groupBy("name").agg(F.sum("n").alias("n"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank``, the place (from 0) in the order, without bringing all rows into one task: rows are laid out in ranges of the order, and each range's place begins where those before it end."""
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row per partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sorted_.withColumn("__part", part).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")


def running(df: DataFrame, order: str, values: dict[str, str]) -> DataFrame:
    """``df`` with running totals (new column -> column summed) in the order of ``order`` (each value once), again in ranges of the order, with what the ranges before add up to."""
    laid = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sums = laid.groupBy("__part").agg(*[F.sum(c).alias(f"__s_{new}") for new, c in values.items()])  # one row per partition
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", *[F.coalesce(F.sum(f"__s_{new}").over(w), F.lit(0)).alias(f"__s_{new}") for new in values])
    here = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = laid.withColumns({new: F.sum(c).over(here) for new, c in values.items()}).join(F.broadcast(sums), "__part")
    return out.withColumns({new: F.col(new) + F.col(f"__s_{new}") for new in values}).drop("__part", *[f"__s_{new}" for new in values])


def number_nodes(df: DataFrame, levels: tuple[str, str, str], order: str) -> DataFrame:
    """``node_id, name`` in order of first appearance: rows by ``order``, within a row the levels from left to right; ids begin at 0.

    A name found at several levels is one node. Only rows with all levels filled count.
    """
    full = df.where(" and ".join(f"{x} is not null and {x} <> ''" for x in levels))
    names = F.array(*[F.struct(F.col(x).cast("string").alias("name"), F.lit(k).alias("level")) for k, x in enumerate(levels)])
    first = full.select(F.explode(names).alias("x"), F.col(order).alias("__o")).groupBy("x.name").agg(F.min(F.struct("__o", "x.level")).alias("__f"))
    return ranked(first, F.col("__f")).select(F.col("rank").alias("node_id"), "name")


def numbered_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source_id, target_id, value`` by two look-ups."""
    ids = lambda end: nodes.select(F.col("name").alias(end), F.col("node_id").alias(f"{end}_id"))
    return links.join(ids("source"), "source", "left").join(ids("target"), "target", "left").select("source_id", "target_id", "value")


def flow_labels(nodes: DataFrame) -> DataFrame:
    """``name, label``: name and count."""
    return nodes.select("name", F.concat_ws(" - ", "name", F.col("n").cast("string")).alias("label"))


def flow_colors(df: DataFrame, category: str, node: str, order: str) -> DataFrame:
    """``name, color, link_color``: a node has the colour of the category of its last row by ``order``; categories take
    colours in order of their first row, again from the start after the last colour."""
    rows = df.where(f"{category} is not null and {node} is not null and {category} <> '' and {node} <> ''")
    first = rows.groupBy(category).agg(F.min(order).alias("__first"))
    first = ranked(first, F.col("__first"), F.col(category)).withColumn("__i", F.col("rank") % len(PALETTE))
    color = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), F.col("__i").cast("int") + 1)
    last = rows.groupBy(node).agg(F.max_by(category, order).alias(category))
    out = last.join(first.select(category, color.alias("color")), category, "left").withColumn("color", F.coalesce("color", F.lit(NO_COLOR)))
    return out.select(F.col(node).alias("name"), "color", X.faded(F.col("color"), "0.4").alias("link_color"))


def flow_path(links: DataFrame, focus: str) -> DataFrame:
    """The links that lead into ``focus`` directly and those reachable from it (the graph has three levels)."""
    into = links.where(F.col("target") == focus)
    out1 = links.where(F.col("source") == focus)
    out2 = links.join(out1.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target", "value")
    return into.unionByName(out1).unionByName(out2).distinct()
