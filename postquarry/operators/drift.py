"""Schemas that drift between the files of a feed: versioned fingerprints and migration steps.

Every file has a schema: its fields, each with the type that most of its non-null values have, and a
fingerprint over it.  Within a feed, files in order of export (however late they were delivered) make
versions: the number goes up where the fingerprint differs from the file before (``schema_versions``).
Only there, migration steps are derived: drop, add with a default, rename, cast (``migration_steps``).
A field that went and one that came are one renamed field if records present in both files carry
the same content under the two names; only files of such versions are read again for that, and of their
values only those of fields that went or came are compared.

``routes`` folds the steps of a feed into one route per file: which field fills which column.  Every
record is then moved through its file's route (rename, default, cast) in one projection, without a shuffle of
records: the routes are small and are joined on (feed, file).

Records are aligned without knowing the key (the key itself gets renamed): two records of
consecutive files belong together if they share the most values that stand in one record of each file only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, is_small

#: Share of aligned, non-null value pairs that must agree for a rename.
AGREE = 0.6
#: The same for fields with two values or fewer, where agreement comes easily: it must also be far above chance, or the names alike.
AGREE_FLAGS = 0.85
ABOVE_CHANCE, ALIKE = 0.6, 0.4
#: A field is of days if most of its values are days or instants in milliseconds since 1970, and at least this share of these are days.
DAY, DAYS = r"^\d{4}-\d{2}-\d{2}$", 0.05
EPOCH = r"^1\d{12}$"
#: A number as people write it.
AMOUNT = r"^-?\d[\d, ]*(\.\d+)?( [A-Z]{3})?$"
#: Columns of the wide table at most; ``unified_rows`` has no such bound.
MAX_NAMES = 5000
KINDS = ("array", "boolean", "number", "object", "string")

#: Pairs of names known to mean the same in the feeds at hand: a parameter of ``routes`` and what builds on it.
ALIASES = (("job_url", "url"), ("category", "job_category"), ("job_location", "location"), ("is_active", "active"), ("minSalary", "salary_min"))


_AS_MAP = "try_cast(try_parse_json(record) as map<string,variant>)"


def _kind(schema: Column) -> Column:
    """The JSON type for a variant's schema; null for JSON null."""
    return (
        F.when(schema == "VOID", F.lit(None))
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema == "STRING", "string")
        .otherwise("number")
    )


def plain_value(text: Column, kind: Column) -> Column:
    """A value in one dress whatever its type: lists joined, objects without their keys, amounts bare, flags as true/false, instants as days."""
    day = F.date_format(F.timestamp_millis(text.try_cast("bigint")), "yyyy-MM-dd")
    amount = F.regexp_replace(F.regexp_replace(text, r" [A-Z]{3}$", ""), r"[, ]", "")
    t = F.when(kind == "object", F.regexp_replace(F.regexp_replace(text, r'"[^"]*":', ""), r'[{}\[\]"]', ""))
    t = F.coalesce(t, F.when(kind == "array", F.regexp_replace(F.regexp_replace(text, r'^\["?|"?\]$', ""), r'"?,"?', "; ")), text)
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"[;,] ?", "; "), r"\s+", " ")))
    t = F.when(t.contains("; "), F.array_join(F.array_sort(F.split(t, "; ")), "; ")).otherwise(t)
    t = F.when((kind == "number") & text.rlike(EPOCH), day).when(text.rlike(r"^\d[\d, ]*( [A-Z]{3})?$"), amount).otherwise(t)
    return F.when(t.isin("true", "yes", "y", "1"), "true").when(t.isin("false", "no", "n", "0"), "false").otherwise(t)


def read_records(files: DataFrame) -> DataFrame:
    """``record_id, feed, file_name, exported_on, m`` (key -> variant) of the readable records: JSON objects.

    Damaged lines, null records, JSON that is no object, and rows without feed or file are left out; ``unreadable`` counts them.
    """
    rows = files.where("feed is not null and file_name is not null").select("record_id", "feed", "file_name", "exported_on", F.expr(_AS_MAP).alias("m"))
    return rows.where("m is not null")


def unreadable(files: DataFrame) -> DataFrame:
    """``feed, file_name, n_unreadable`` for files that have records which are no JSON object."""
    bad = F.expr(f"{_AS_MAP} is null")
    return files.groupBy("feed", "file_name").agg(F.count_if(bad).alias("n_unreadable")).where("n_unreadable > 0")


def file_schemas(files: DataFrame) -> DataFrame:
    """``feed, file_name, exported_on, field, type, n_values, n_days, n_instants``, one row per file and field.

    ``type`` is null if all values are null; ties between types go to the first by name. One pass: records are counted before anything moves.
    """
    values = read_records(files).select("feed", "file_name", "exported_on", F.explode("m").alias("field", "v"))
    values = values.select("feed", "file_name", "exported_on", "field", "v", _kind(F.schema_of_variant("v")).alias("kind"))
    text = F.expr("cast(v as string)")
    counts = values.groupBy("feed", "file_name", "field").agg(
        F.min("exported_on").alias("exported_on"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.count_if((F.col("kind") == "string") & (F.length(text) == 10) & text.rlike(DAY)).alias("n_days"), F.count_if((F.col("kind") == "number") & text.rlike(EPOCH)).alias("n_instants"),
    )
    most = F.array_max(F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(KINDS)]))
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))
    return counts.select("feed", "file_name", "exported_on", "field", F.when(most["n"] > 0, most["k"]).alias("type"), total.alias("n_values"), "n_days", "n_instants")


def versions_of(schemas: DataFrame) -> DataFrame:
    """One row per file: ``feed, file_name, exported_on, version, fingerprint, types, previous, was``; ``types`` and ``was`` are field -> type of it and of the file before.

    The rows of a feed meet in one task: one per file, whatever the number of its records.
    """
    prints = schemas.groupBy("feed", "file_name").agg(
        F.min("exported_on").alias("exported_on"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.coalesce("type", F.lit("null")).alias("type"))))).alias("types"),
    )
    print_of = F.md5(F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))
    w = Window.partitionBy("feed").orderBy("exported_on", "file_name")
    rows = prints.withColumn("fingerprint", print_of)
    rows = rows.withColumn("previous", F.lag("file_name").over(w)).withColumn("was", F.lag("types").over(w)).withColumn("__new", (~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w))).cast("int"))
    return rows.withColumn("version", F.sum("__new").over(w)).select("feed", "file_name", "exported_on", "version", "fingerprint", "types", "previous", "was")


def schema_versions(files: DataFrame) -> DataFrame:
    """``feed, file_name, exported_on, version, fingerprint, n_fields``: a feed's version goes up when its fingerprint differs from the file before."""
    v = versions_of(file_schemas(files))
    return v.select("feed", "file_name", "exported_on", "version", "fingerprint", F.size("types").cast("bigint").alias("n_fields"))


def _gone(was: str = "was", now: str = "types") -> Column:
    return F.array_except(F.map_keys(was), F.map_keys(now))


def _renames(files: DataFrame, versions: DataFrame) -> DataFrame:
    """``feed, file_name, field, new_field``: fields that carry on under another name."""
    steps = versions.where("previous is not null").select("feed", "file_name", "previous", _gone().alias("gone"), _gone("types", "was").alias("came"), "types", "was")
    steps = steps.where("size(gone) > 0 and size(came) > 0").withColumn("step", F.xxhash64("feed", "file_name"))
    retyped = F.filter(F.map_keys("types"), lambda k: F.try_element_at(F.col("was"), k) != F.try_element_at(F.col("types"), k))
    steps = steps.withColumn("dressed", F.array_union(F.array_union("gone", "came"), retyped))
    parts = steps.select("feed", "file_name", "step", F.lit(True).alias("new"), F.col("came").alias("wanted"), "dressed").unionByName(
        steps.select("feed", F.col("previous").alias("file_name"), "step", F.lit(False).alias("new"), F.col("gone").alias("wanted"), "dressed")
    )
    parts = cut(parts)
    # only records of these files are parsed again
    records = files.select("record_id", "feed", "file_name", "record").join(F.broadcast(parts) if is_small(parts) else parts, ["feed", "file_name"])
    records = records.withColumn("m", F.expr(_AS_MAP)).where("m is not null")
    # what may be written in another type is compared in one dress, all else as it stands
    value = records.select("step", "new", F.col("record_id").alias("r"), "wanted", "dressed", F.explode("m").alias("field", "v"))
    kind, text = _kind(F.schema_of_variant("v")), F.expr("cast(v as string)")
    value = value.select("step", "new", "r", "wanted", "dressed", "field", kind.alias("kind"), text.alias("text")).where("kind is not null")
    value = value.withColumn("h", F.xxhash64(F.when(F.array_contains("dressed", F.col("field")), plain_value(F.col("text"), F.col("kind"))).otherwise(F.col("text"))))
    side = lambda f, new: f(F.when(F.col("new") == new, F.col("r")))
    marks = value.where("kind <> 'boolean'").groupBy(F.xxhash64("step", "h").alias("k")).agg(
        F.first("step").alias("step"), side(F.min, True).alias("new_r"), side(F.max, True).alias("new_r2"), side(F.min, False).alias("old_r"), side(F.max, False).alias("old_r2")
    ).where("new_r = new_r2 and old_r = old_r2")
    votes = marks.groupBy("step", "new_r", "old_r").agg(F.count("*").alias("n"))
    best = votes.groupBy("step", "new_r").agg(F.max(F.struct("n", (-F.col("old_r")).alias("o"))).alias("b")).select("step", "new_r", (-F.col("b.o")).alias("old_r"), "b.n")
    best = best.groupBy("step", "old_r").agg(F.max(F.struct("n", (-F.col("new_r")).alias("o"))).alias("b")).select("step", "old_r", (-F.col("b.o")).alias("new_r"), "b.n")
    best = cut(best)
    # records that share little beside the best of their file are strangers with a word in common
    pairs = best.join(best.groupBy("step").agg(F.max("n").alias("most")), "step").where("n * 3 >= most").select("step", "old_r", "new_r")
    wanted = cut(value.where(F.array_contains("wanted", F.col("field"))).select("step", "new", "r", "field", "h"))
    held = lambda new, name: wanted.where(F.col("new") == new).select("step", F.col("r").alias(f"{name}_r"), F.col("field").alias(name), F.col("h").alias(f"h_{name}"))
    yes = F.xxhash64(F.lit("true"))
    seen = pairs.join(held(False, "old"), ["step", "old_r"]).join(held(True, "new"), ["step", "new_r"])
    found = seen.groupBy("step", "old", "new").agg(
        F.count("*").alias("n"), F.avg((F.col("h_old") == F.col("h_new")).cast("double")).alias("share"), F.count_distinct("h_old").alias("kinds"),
        F.avg((F.col("h_old") == yes).cast("double")).alias("p"), F.avg((F.col("h_new") == yes).cast("double")).alias("q"),
    )
    by_chance = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    above = F.when(by_chance < 1, (F.col("share") - by_chance) / (1 - by_chance)).otherwise(0.0)
    alike = 1 - F.levenshtein(F.lower("old"), F.lower("new")) / F.greatest(F.length("old"), F.length("new"))
    found = found.withColumn("alike", alike).where(
        ((F.col("kinds") > 2) & (F.col("share") >= AGREE))
        | ((F.col("kinds") == 2) & (F.col("share") >= AGREE_FLAGS) & ((above >= ABOVE_CHANCE) | (F.col("alike") >= ALIKE)))
        | ((F.col("kinds") == 1) & (F.col("share") >= AGREE_FLAGS) & (F.col("alike") >= ALIKE))
    )
    rank = [F.desc("share"), F.desc("n"), F.desc("alike")]
    found = found.repartition("step")  # both windows below live on this one exchange
    found = found.withColumn("__a", F.row_number().over(Window.partitionBy("step", "old").orderBy(*rank, "new"))).withColumn("__b", F.row_number().over(Window.partitionBy("step", "new").orderBy(*rank, "old")))
    return found.where("__a = 1 and __b = 1").join(steps.select("step", "feed", "file_name"), "step").select("feed", "file_name", F.col("old").alias("field"), F.col("new").alias("new_field"))


def migration_steps(files: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """``feed, file_name, version, field, change, new_field, old_type, new_type``: what takes the version before to this one, one step a row.

    ``change`` is ``removed``, ``added``, ``renamed`` or ``type_changed``; a renamed field whose type changes has two steps. A feed's
    first file has no steps; a file without any readable record is no file of its feed; a field whose values are all null has no type and
    so doesn't change it. Repeated lines change no field. An empty table gives no rows.
    """
    versions = cut(versions_of(file_schemas(files))) if versions is None else versions
    before = versions.select("feed", F.col("file_name").alias("previous"), F.col("version").alias("__before"))
    changed = versions.join(before, ["feed", "previous"]).where("version > __before")
    renamed = _renames(files, versions).groupBy("feed", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "new_field"))).alias("to"))
    rows = changed.join(renamed, ["feed", "file_name"], "left")
    to = F.coalesce("to", F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("to", to).withColumn("gone", _gone()).withColumn("came", _gone("types", "was"))
    kind = lambda m, k: F.nullif(F.try_element_at(F.col(m), k), F.lit("null"))
    nothing = F.lit(None).cast("string")

    def step(change: str, field: Column, new_field: Column, old: Column, new: Column) -> Column:
        return F.struct(field.alias("field"), F.lit(change).alias("change"), new_field.alias("new_field"), old.alias("old_type"), new.alias("new_type"))

    stays = F.filter(F.map_keys("types"), lambda k: F.array_contains(F.map_keys("was"), k))
    every = F.concat(
        F.transform(F.filter("gone", lambda k: ~F.array_contains(F.map_keys("to"), k)), lambda k: step("removed", k, F.lit(""), kind("was", k), nothing)),
        F.transform(F.filter("came", lambda k: ~F.array_contains(F.map_values("to"), k)), lambda k: step("added", k, F.lit(""), nothing, kind("types", k))),
        F.transform(F.map_entries("to"), lambda e: step("renamed", e["key"], e["value"], kind("was", e["key"]), kind("types", e["value"]))),
        F.transform(
            F.filter(F.map_entries("to"), lambda e: F.coalesce(kind("was", e["key"]) != kind("types", e["value"]), F.lit(False))),
            lambda e: step("type_changed", e["value"], F.lit(""), kind("was", e["key"]), kind("types", e["value"])),
        ),
        F.transform(F.filter(stays, lambda k: F.coalesce(kind("was", k) != kind("types", k), F.lit(False))), lambda k: step("type_changed", k, F.lit(""), kind("was", k), kind("types", k))),
    )
    return rows.select("feed", "file_name", "version", F.explode(every).alias("s")).select("feed", "file_name", "version", "s.*")


def schema_changes(files: DataFrame) -> DataFrame:
    """The recorded ``migration_steps`` as a report: every difference between a file and the one of its feed exported before it."""
    return migration_steps(files)


def common_names(versions: DataFrame, steps: DataFrame, aliases: tuple[tuple[str, str], ...] = ALIASES, most: int = MAX_NAMES) -> dict[str, str]:
    """Each name -> the one it shares a column with across feeds (the one in most files, ties by name).

    Two names are one if ``aliases`` says so, or if a feed renamed one into the other and no file of any feed has both. Works on
    distinct names; beyond ``most`` of them an error is raised (``routes(merge_feeds=False)`` doesn't need them).
    """
    names = versions.select(F.explode(F.map_keys("types")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    used = {r["name"]: r["n"] for r in names.limit(most + 1).collect()}
    edges = steps.where("change = 'renamed'").select(F.col("field").alias("a"), F.col("new_field").alias("b")).distinct()
    # a feed that renames place into location keeps both names apart for all if some file has the two side by side
    both = edges.join(versions.select("types"), F.expr("array_contains(map_keys(types), a) and array_contains(map_keys(types), b)"), "left_anti") if is_small(edges) else edges
    edges = [(r["a"], r["b"]) for r in both.limit(most + 1).collect()]
    if len(used) > most or len(edges) > most:
        raise ValueError(f"more than {most} field names or renames; use merge_feeds=False and unified_rows")
    root = {n: n for n in used}

    def find(n: str) -> str:
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in [*edges, *((a, b) for a, b in aliases if a in used and b in used)]:
        root[find(a)] = find(b)
    groups: dict[str, list[str]] = {}
    for n in root:
        groups.setdefault(find(n), []).append(n)
    return {n: min(g, key=lambda x: (-used.get(x, 0), x)) for g in groups.values() for n in g}


_ROUTE = "feed string, file_name string, version bigint, route map<string,string>"


def fold_feed(rows: pd.DataFrame, common: dict[str, str]) -> pd.DataFrame:
    """The route (column -> field) of each file of one feed: its versions and steps folded in order.

    A field lives until it is removed, through all its renames; a name that comes to stand for another thing later is another
    field. Fields whose last names share a common one share a column, but not if a file of the feed has both: then the
    one that lasts longest keeps the common name and the other its own last name, numbered if that is taken.
    """
    rows = rows.sort_values(["exported_on", "file_name"], kind="stable")
    lives: list[dict] = []  # last name, place of the last file, files in which the field is
    open_: dict[str, int] = {}
    held: list[dict[str, int]] = []
    for at, (types, to) in enumerate(zip(rows["types"], rows["to"])):
        fields = set(dict(types))
        moved = {new: open_[old] for old, new in dict(to or {}).items() if old in open_}
        now = {}
        for f in sorted(fields):
            life = moved.get(f, open_.get(f) if f in open_ and f not in moved else None)
            if life is None:
                life = len(lives)
                lives.append({"files": set()})
            now[f] = life
            lives[life].update(name=f, last=at)
            lives[life]["files"].add(at)
        open_ = now
        held.append(now)
    taken: dict[str, list[int]] = {}
    column: dict[int, str] = {}
    wanted = lambda k: common.get(lives[k]["name"], lives[k]["name"])
    order = sorted(range(len(lives)), key=lambda k: (-lives[k]["last"], lives[k]["name"] != wanted(k), -len(lives[k]["files"]), lives[k]["name"]))
    for k in order:
        own, n = lives[k]["name"], 1
        name = wanted(k)
        while any(lives[k]["files"] & lives[o]["files"] for o in taken.get(name, [])):
            name = own if n == 1 and own != name else f"{own}_{n + 1}"
            n += 1
        taken.setdefault(name, []).append(k)
        column[k] = name
    return pd.DataFrame({"feed": rows["feed"], "file_name": rows["file_name"], "version": rows["version"], "route": [{column[k]: f for f, k in now.items()} for now in held]})


def routes(versions: DataFrame, steps: DataFrame, aliases: tuple[tuple[str, str], ...] = ALIASES, merge_feeds: bool = True) -> DataFrame:
    """``feed, file_name, version, route`` (column -> field of the file): the migration steps of each feed folded along its versions.

    ``merge_feeds``: last names that are one across feeds (``common_names``) share a column; else only ``aliases`` are joined.
    """
    renamed = steps.where("change = 'renamed'").groupBy("feed", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "new_field"))).alias("to"))
    common = common_names(versions, steps, aliases) if merge_feeds else {a: b for a, b in aliases}
    rows = versions.join(renamed, ["feed", "file_name"], "left").select("feed", "file_name", "exported_on", "version", "types", "to")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        return fold_feed(group, common)

    return rows.groupBy("feed").applyInPandas(fold, _ROUTE)


def text_form(value: Column, kind: Column) -> Column:
    """A value as it reads where it is plain text: an object's values joined by ``, `` in the order of its keys, a list's by ``; ``.

    Empty members are left out; what is nested deeper stays JSON.
    """
    return (
        F.when(kind == "object", F.array_join(F.map_values(F.from_json(value, "map<string,string>")), ", "))
        .when(kind == "array", F.array_join(F.from_json(value, "array<string>"), "; "))
        .otherwise(value)
    )


def column_types(schemas: DataFrame, ways: DataFrame) -> DataFrame:
    """``name, type`` of every column: ``day``, or the type of most of its values over all files (null without any value)."""
    routed = ways.select("feed", "file_name", F.explode("route").alias("name", "field")).join(schemas, ["feed", "file_name", "field"])
    by = routed.groupBy("name", "type").agg(F.sum("n_values").alias("n"), F.sum("n_days").alias("d"), F.sum("n_instants").alias("i"))
    whole = by.groupBy("name").agg(F.max(F.when(F.col("type").isNotNull(), F.struct("n", "type"))).alias("m"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("i").alias("i"))
    day = (F.col("d") > 0) & (2 * (F.col("d") + F.col("i")) > F.col("n")) & (F.col("d") >= DAYS * (F.col("d") + F.col("i")))
    return whole.select("name", F.when(day, "day").otherwise(F.col("m.type")).alias("type"))


def cast_step(text: Column, to: str | None) -> Column:
    """The text of a field of type ``to`` cast: a double, a flag, else text, in which instants of a field of days are the day in UTC.

    Numbers may have thousands set apart and a currency behind them; only flags take 0 and 1 for false and true.
    """
    if to == "number":
        bare = F.regexp_replace(F.regexp_replace(text, r" [A-Z]{3}$", ""), "[, ]", "")
        return F.coalesce(text.try_cast("double"), F.when(text.rlike(AMOUNT), bare).try_cast("double"))
    if to == "boolean":
        flag = F.lower(F.trim(text))
        return F.when(flag.isin("true", "yes", "y", "1"), True).when(flag.isin("false", "no", "n", "0"), False)
    if to == "day":
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(text.try_cast("bigint") / 86_400_000).cast("int"))
        return F.when(text.rlike(EPOCH), day.cast("string")).otherwise(text)
    return text


def _routed(files: DataFrame, ways: DataFrame) -> DataFrame:
    ways = ways.select("feed", "file_name", "version", "route")
    return read_records(files).join(F.broadcast(ways) if is_small(ways) else ways, ["feed", "file_name"])


def _text(m: Column, field: Column) -> Column:
    return F.transform(F.array(F.try_element_at(m, field)), lambda v: text_form(v.cast("string"), _kind(F.schema_of_variant(v))))[0]


def unified_rows(files: DataFrame, aliases: tuple[tuple[str, str], ...] = ALIASES) -> DataFrame:
    """``record_id, feed, file_name, exported_on, version, fields`` (column -> text): the unified table in long form, for any number of names."""
    versions = cut(versions_of(file_schemas(files)))
    ways = cut(routes(versions, cut(migration_steps(files, versions)), aliases, merge_feeds=False))
    fields = F.map_filter(F.transform_values("route", lambda c, f: _text(F.col("m"), f)), lambda c, t: t.isNotNull())
    return _routed(files, ways).select("record_id", "feed", "file_name", "exported_on", "version", fields.alias("fields"))


def unified_table(files: DataFrame, aliases: tuple[tuple[str, str], ...] = ALIASES, defaults: dict[str, object] | None = None) -> DataFrame:
    """One row per readable record: ``record_id, feed, file_name, exported_on`` and one column per field of all feeds.

    Each record takes its file's route: rename, then default (``defaults``, by column, where the file's version lacks the field), then cast. A column is
    double or boolean if that is the type of most of its values, else text (``text_form``; days and instants in milliseconds
    beside them as days). A value that can't be cast, and a field the version lacks and that has no default, is null.
    """
    schemas = cut(file_schemas(files))
    versions = cut(versions_of(schemas))
    ways = cut(routes(versions, cut(migration_steps(files, versions)), aliases))
    types = {r["name"]: r["type"] for r in column_types(schemas, ways).limit(MAX_NAMES + 1).collect()}
    if len(types) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} columns; use unified_rows")
    taken, defaults = {"record_id", "feed", "file_name", "exported_on"}, defaults or {}

    def column(name: str) -> Column:
        field = F.try_element_at(F.col("route"), F.lit(name))
        out = cast_step(_text(F.col("m"), field), types[name])
        if name in defaults:
            out = F.when(field.isNull(), F.lit(defaults[name])).otherwise(out)
        return out.alias(name if name not in taken else f"field_{name}")

    return _routed(files, ways).select("record_id", "feed", "file_name", "exported_on", *[column(n) for n in sorted(types)])
