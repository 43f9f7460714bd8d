"""Probabilistic linkage of rows that describe the same opening in sources without common keys.

Rows are reduced to comparable attributes (employer name and its second part, job, level, city, team
named in the title); rows that are alike in all of them and come from one source are one profile, so an employer that
holds a third of all rows costs as much as its profiles.  Several blocking passes bring profiles together, each
leaving out another attribute: the level, the city (missing, or spelt otherwise), the employer's name, the job.
A candidate pair gets an agreement level for every attribute its pass leaves free, and the few distinct patterns of a
pass are counted.  Expectation-maximisation over these counts estimates the shares of matches and of non-matches and how
likely each level is among them.  That matches differ in an attribute is an error by definition (``ERROR``); nothing else
is ruled out by hand: a pair's confidence is its posterior, and pairs from ``CONFIDENT`` on are links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, is_small, look_up
from . import canonical
from .words import PLACEHOLDERS

#: Posterior from which a pair is a match.
CONFIDENT = 0.5
#: Edits between two spellings of a second name or a team, of a city and of a job.
NAME_EDITS, PLACE_EDITS, JOB_EDITS = 2, 2, 2
#: How often a match differs in an attribute: only by an error in it.
ERROR = 0.001
#: Members of a profile that meet in one task when links are spelt out row by row.
TOGETHER = 50_000
#: Share of matches among candidates that the estimation begins with; it stays where no attribute is left to compare.
SHARE = 0.9
#: Rows from which a place that is in no list is one that rarer spellings may be slips of (those in a tenth as many rows or fewer).
LEAST_PLACES = 20
#: Edits between a city's name and a slip of it, by length.
CITY_EDITS = ((4, 2), (10, 3))

# Legal forms of firms, in plain spelling.
LEGAL = "gmbh co kg|s a r l|sarl|s r l|srl|b v|bv|n v|nv|s a|sa|gmbh|inc|ltd|limited|llc|plc|ag|kg|corp|corporation|co|lda|oy|ab|spa|s p a"
# Cities under the names used in several languages; a default of the parameter ``cities``.
CITIES = {
    "amsterdam": "", "antwerp": "antwerpen anvers amberes", "athens": "athina athen", "austin": "", "bangalore": "bengaluru", "barcelona": "barcelone", "basel": "basle bale basilea",
    "berlin": "berlino", "boston": "", "brussels": "bruxelles brussel brussel_stad bruselas", "cologne": "koln koeln colonia keulen", "copenhagen": "kobenhavn kopenhagen", "denver": "",
    "dublin": "baile_atha_cliath dublino", "dusseldorf": "duesseldorf", "florence": "firenze florenz", "frankfurt": "francoforte", "geneva": "geneve genf ginevra ginebra", "ghent": "gent gand",
    "hamburg": "amburgo", "leeds": "", "leipzig": "lipsia", "lisbon": "lisboa lissabon lisbonne lisbona", "london": "londres londra londen", "luxembourg": "luxemburg letzebuerg lussemburgo luxemburgo",
    "lyon": "lyons lione", "madrid": "", "marseille": "marseilles marsiglia", "milan": "milano mailand milao", "mumbai": "bombay", "munich": "munchen muenchen monaco_di_baviera", "nantes": "",
    "naples": "napoli neapel", "new york": "nueva_york new_york_city", "nuremberg": "nurnberg nuernberg", "paris": "parigi", "porto": "oporto", "prague": "praha prag praga", "pune": "poona",
    "rome": "roma rom", "rotterdam": "", "seattle": "", "seville": "sevilla siviglia sevilha", "the hague": "den_haag s_gravenhage la_haye la_haya", "toronto": "", "turin": "torino turim",
    "utrecht": "", "venice": "venezia venedig", "vienna": "wien vienne viena", "warsaw": "warszawa warschau varsovie", "zurich": "zuerich zurigo",
}

_PLACE_NOISE = (
    r"\((?:[^)]*)\)|\b(?:greater|area|and surroundings|surroundings|remote|hybrid|onsite|metropolitan|region|raum|umgebung)\b"
    r"|[-\s](?:centro|stad|mitte|city|metropole|métropole|zentrum|centre|center)\b"
)


def employer(company: Column) -> tuple[Column, Column]:
    """The plain first word of an employer's name without its legal form, and the plain second word ('' if none)."""
    t = F.regexp_replace(company, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    t = canonical.plain(t)
    for _ in range(2):
        t = F.trim(F.regexp_replace(t, rf" (?:{LEGAL})$", ""))
    return F.substring_index(t, " ", 1), F.regexp_extract(t, r"^\S+ (\S+)", 1)


def place(location: Column) -> Column:
    """The plain city of a free-entered location, without countries, states and remarks; '' if there is none."""
    t = F.lower(location)
    t = F.regexp_replace(t, _PLACE_NOISE, " ")
    t = F.regexp_replace(t, r"^\s*[a-z]{2,3}\s*,|,\s*[a-z]{2,3}\s*$", " ")
    t = F.regexp_replace(t, r"\s[a-z]{2}\s*$", " ")
    return F.coalesce(canonical.plain(t), F.lit(""))


def resolved_places(jobs: DataFrame, cities: dict[str, str] = CITIES) -> DataFrame:
    """``location, city``: distinct locations and their city; slips and other languages' names are resolved by the pigeonhole join.

    First against ``cities``, then rare spellings against the frequent places of the table itself, so that places in no list bear slips too.
    """
    spark = jobs.sparkSession
    rows = [(k, name, [x.replace("_", " ") for x in other.split()]) for k, (name, other) in enumerate(sorted(cities.items()))]
    known = spark.createDataFrame(rows, "ref_id bigint, label string, alt_labels array<string>").withColumn("field", F.lit("city"))
    # written, so that a filter on the city isn't applied to every row instead of every distinct location
    places = cut(jobs.where("location is not null").groupBy("location").agg(F.count("*").alias("n")).withColumn("text", place(F.col("location"))))
    texts = places.where("text <> ''").groupBy(F.lit("city").alias("field"), "text").agg(F.sum("n").alias("n"))
    found = canonical.closest_entries(texts.select("field", "text"), known, CITY_EDITS).join(F.broadcast(known.select("ref_id", "label")), "ref_id").select("text", "label")
    texts = cut(texts.join(found, "text", "left"))
    frequent = texts.where(F.col("label").isNull() & (F.col("n") >= LEAST_PLACES))
    if not frequent.isEmpty():
        named = frequent.select("field", F.xxhash64("text").alias("ref_id"), F.col("text").alias("label"), F.lit(None).cast("array<string>").alias("alt_labels"))
        rare = texts.where(F.col("label").isNull() & (F.col("n") * 10 <= LEAST_PLACES)).select("field", "text")
        near = canonical.closest_entries(rare, named, CITY_EDITS).join(named.select("ref_id", F.col("label").alias("as")), "ref_id").select("text", "as")
        texts = texts.join(near, "text", "left").withColumn("label", F.coalesce("label", "as"))
    return places.join(texts.select("text", F.coalesce("label", "text").alias("city")), "text", "left").select("location", F.coalesce("city", F.lit("")).alias("city"))


def _titles(jobs: DataFrame, reference: DataFrame) -> DataFrame:
    """``title, job, entry, level, team`` of distinct titles; job is the plain label of the title's entry in the reference list (``entry``), else the plain title."""
    titles = jobs.select("title").where("title is not null").distinct()
    mapped = canonical.map_values(titles.select(F.lit("title").alias("field"), F.col("title").alias("value")), reference)
    # what stands behind a separator at the end is a team, unless it is a word of the reference list
    words = reference.where("field = 'title'").select(F.explode(F.concat(F.array("label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("n"))
    words = words.select(F.explode(F.split(canonical.plain(F.col("n")), " ")).alias("label")).where("length(label) > 3").distinct()
    words = words.select(F.lit("word").alias("field"), F.crc32("label").alias("ref_id"), "label", F.lit(None).cast("array<string>").alias("alt_labels"))
    behind = r"(?:\s?[,@]\s?|\s[-–—|]\s)\s*(\p{L}{4,})\s*$"
    parts = lambda t: F.struct(canonical.plain(F.regexp_extract(t, behind, 1)).alias("team"), canonical.plain(F.regexp_replace(t, behind, "")).alias("core"))
    split = cut(mapped.select("*", canonical.level(F.col("value")).alias("level"), canonical.let(canonical.without_remarks(F.col("value")), parts).alias("p")))
    split = split.select("value", "ref_id", "level", "p.team", "p.core")
    known = canonical.closest_entries(split.select(F.lit("word").alias("field"), F.col("team").alias("text")).where("text <> ''").distinct(), words, ((4, 2),)).select(F.col("text").alias("team"), F.lit(True).alias("known"))
    labels = reference.where("field = 'title' and ref_id is not null").groupBy("ref_id").agg(canonical.plain(F.min("label")).alias("entry"))
    split = split.join(F.broadcast(labels) if is_small(labels) else labels, "ref_id", "left")
    return split.join(known, "team", "left").select(F.col("value").alias("title"), F.coalesce("entry", "core").alias("job"), F.col("entry").isNotNull().alias("entry"), "level", F.when(F.col("known"), "").otherwise(F.col("team")).alias("team"))


ATTRIBUTES = ("name", "second", "job", "level", "city", "team")


def comparable(jobs: DataFrame, reference: DataFrame, cities: dict[str, str] = CITIES) -> DataFrame:
    """``row_id, source, name, second, job, entry, level, city, team, pid`` (a digest of source and attributes) of the rows that have an employer, a source, and a title with a word that is no placeholder."""
    name, second = employer(F.col("company"))
    rows = jobs.select("row_id", "source", "title", "company", "location").where("source is not null and title is not null and company is not null")
    rows = cut(rows.select("row_id", "source", "title", "location", name.alias("name"), second.alias("second"))).where("name <> ''")
    rows = look_up(rows, cut(_titles(rows, reference)), ["title"])
    rows = look_up(rows, cut(resolved_places(rows, cities)), ["location"], "left")
    rows = rows.select("row_id", "source", "name", "second", "job", "entry", "level", F.coalesce("city", F.lit("")).alias("city"), "team")
    return rows.where(F.col("job").rlike(r"\p{L}{2}") & ~F.col("job").isin(*PLACEHOLDERS)).withColumn("pid", F.xxhash64("source", *ATTRIBUTES))


def profiles(rows: DataFrame) -> DataFrame:
    """``pid, src, n, row_id`` (the least), the attributes and ``entry``, one row per set of rows of a source that are alike in all attributes."""
    return rows.groupBy("pid").agg(F.count("*").cast("int").alias("n"), F.min("row_id").alias("row_id"), F.first(F.crc32("source")).alias("src"), *[F.first(c).alias(c) for c in (*ATTRIBUTES, "entry")])


def _near(a: Column, b: Column, k: int) -> Column:
    return F.levenshtein(a, b, k) >= 0


def _slip(a: Column, b: Column) -> Column:
    """Whether two names differ by one slip of the pen: one edit, or two neighbouring letters changed over.

    Invented names lie close together once there are very many of them; a second edit would bring in strangers.
    """
    letters = lambda c: F.array_sort(F.split(c, ""))
    return _near(a, b, 1) | (_near(a, b, 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def _level(attribute: str, x: Column, y: Column) -> Column:
    """Agreement of two values: 0 differ, 1 one is missing, 2 nearly, 3 equal."""
    near = {
        "name": lambda: _slip(x, y), "job": lambda: (F.least(F.length(x), F.length(y)) >= 8) & _near(x, y, JOB_EDITS), "level": lambda: F.lit(False),
        "city": lambda: (F.least(F.length(x), F.length(y)) >= 5) & _near(x, y, PLACE_EDITS),
    }.get(attribute, lambda: _near(x, y, NAME_EDITS))()
    return F.when((x == "") | (y == ""), 1).when(x == y, 3).when(near, 2).otherwise(0)


#: Blocking passes, none of which finds a pair of another, and the attributes that each leaves free and compares; the others must be equal.
PASSES = {
    "opening": ("level", "second", "team"),
    "place missing": ("second", "team"),
    "place spelt": ("city", "second", "team"),
    "employer": ("name", "second", "team"),
    "employer, place missing": ("name", "second", "team"),
    "job": ("job", "second", "team"),
}
_FREE = ("name", "job", "level", "city", "second", "team")


def _ends(c: str, n: int) -> Column:
    return F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, n)), F.concat(F.lit(">"), F.expr(f"right({c}, {n})"))))


def _light(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its size is proven."""
    return F.broadcast(df) if is_small(df) else df


def candidate_pairs(found: DataFrame) -> DataFrame:
    """``pass, pattern, a_pid, b_pid, a_n, b_n``: pairs of profiles of different sources of all passes, each pair once.

    ``pattern`` holds the agreement levels of the pass's free attributes, two bits each in the order of ``_FREE``. Only hashes of the
    block, ids, and attributes that are compared travel. Sides that are small (no place, a name with a near one in its block, titles in no list) are broadcast
    behind a check of their bytes, so that the other side stays where it is.
    """
    out = None

    def side(df: DataFrame, key: list, name: str) -> DataFrame:
        return df.select(F.xxhash64(*key).alias("k"), "pid", "src", "n", *PASSES[name], *(["entry"] if name == "job" else []))

    def add(name: str, left: DataFrame, right: DataFrame, extra: str = "true") -> None:
        nonlocal out
        got = left.alias("a").join(right.alias("b"), F.col("a.k") == F.col("b.k")).where("a.src <> b.src").where(extra)
        pattern = F.lit(0)
        for i, c in enumerate(_FREE):
            if c in PASSES[name]:
                pattern = pattern + _level(c, F.col(f"a.{c}"), F.col(f"b.{c}")) * 4**i
        number = list(PASSES).index(name)
        got = got.select(F.lit(number).alias("pass"), pattern.cast("int").alias("pattern"), F.col("a.pid").alias("a_pid"), F.col("b.pid").alias("b_pid"), F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"))
        out = got if out is None else out.unionByName(got)

    once = "a.pid < b.pid"
    placed, unplaced = found.where("city <> ''"), found.where("city = ''")
    opening = side(placed, ["name", "job", "city"], "opening")
    add("opening", opening, opening, once)
    same = ["name", "job", "level"]
    nowhere = side(unplaced, same, "place missing")
    add("place missing", _light(nowhere), side(placed, same, "place missing"))
    add("place missing", nowhere, nowhere, once)
    # cities spelt alike: few distinct ones
    city = placed.select("city").distinct().withColumn("end", _ends("city", 3))
    near = cut(city.alias("x").join(city.alias("y"), "end").where("x.city < y.city").where(_near(F.col("x.city"), F.col("y.city"), 3)).select(F.col("x.city").alias("city"), F.col("y.city").alias("other")).distinct())
    if not near.isEmpty():
        left = placed.join(_light(near), "city").select(F.xxhash64("name", "job", "level", "other").alias("k"), "pid", "src", "n", *PASSES["place spelt"])
        add("place spelt", _light(left), side(placed, [*same, "city"], "place spelt"))
    # employers spelt alike: distinct names within a block that begin or end alike
    for name, base, other, block in (("employer", found, found, ["job", "level", "city"]), ("employer, place missing", unplaced, placed, ["job", "level"])):
        names = lambda df: df.select(F.xxhash64(*block).alias("block"), "name").distinct().withColumn("end", _ends("name", 3)).select("block", "name", F.xxhash64("block", "end").alias("k"))  # noqa: E731, B023
        x, y = names(base).alias("x"), names(other).alias("y")
        order = "x.name < y.name" if name == "employer" else "x.name <> y.name"
        x = x if name == "employer" else _light(x)
        alike = x.join(y, F.col("x.k") == F.col("y.k")).where(order).where(_near(F.col("x.name"), F.col("y.name"), 4))
        alike = cut(alike.select(F.xxhash64("x.block", "x.name").alias("k"), F.xxhash64("x.block", "y.name").alias("to")).distinct())
        spelt = lambda df: side(df, [F.xxhash64(*block), F.col("name")], name)  # noqa: E731, B023
        left = spelt(base).join(_light(alike), "k").drop("k").withColumnRenamed("to", "k")
        add(name, _light(left), spelt(other))
    # two entries of the list are two jobs: only titles in no list can be near another
    here = ["name", "city", "level"]
    add("job", _light(side(found.where("not entry"), here, "job")), side(found, here, "job"), "a.job <> b.job and (b.entry or a.pid < b.pid) and levenshtein(a.job, b.job, 4) >= 0")
    return out


def chance(n: float, squares: float) -> float:
    """How likely two rows that have a value have the same one by chance, from the sums of the values' counts and of their squares."""
    return min(max(squares / n**2, 1e-6), 0.9) if n else 0.5


def estimate(patterns: list[tuple[str, tuple[int | None, ...], float]], by_chance: dict[int, float], rounds: int = 300, error: float = ERROR) -> dict[tuple[str, tuple[int | None, ...]], float]:
    """Posterior match probability of each (pass, pattern), by expectation-maximisation over (pass, pattern, count).

    A pattern has one agreement level per attribute, None where the pass doesn't compare it; a missing value (1) says nothing for or
    against. Candidates that a pass brings together are matches, or differ in one of its free attributes: each of these is a kind of
    non-match of its own, since one that differs in the level tells nothing about the employers of those that differ in the employer.
    Estimated are the shares of the kinds, apart for each pass and set of attributes with a value (big employers name teams), which begin with
    ``SHARE`` of matches; the levels of matches; the levels of the attribute in which a kind differs; and, per pass and kind, the levels of the other
    attributes, which begin at what agrees ``by_chance``. That a match differs, or a non-match of a kind is equal in its attribute, is an ``error``.
    """
    if not patterns:
        return {}
    levels = np.array([[1 if x is None else x for x in q] for _, q, _ in patterns])
    n = np.array([c for _, _, c in patterns], float)
    n_cols, said = levels.shape[1], levels != 1
    cols = np.arange(n_cols)
    passes = sorted({p for p, _, _ in patterns})
    of_pass = np.array([passes.index(p) for p, _, _ in patterns])
    strata = [(p, *x) for (p, _, _), x in zip(patterns, said)]
    names = sorted(set(strata))
    of_stratum = np.array([names.index(x) for x in strata])
    share = np.zeros((len(names), 1 + n_cols))
    for k, (_, *has) in enumerate(names):
        share[k, 0] = SHARE if any(has) else 1.0
        share[k, 1:] = np.array(has) * (1 - SHARE) / max(sum(has), 1)
    matched = np.tile([error, 1.0, 0.1, 0.9 - error], (n_cols, 1))
    differs = np.tile([0.95 - error, 1.0, 0.05, error], (n_cols, 1))
    others = np.zeros((len(passes), n_cols, n_cols, 4))
    for c in cols:
        p = by_chance.get(int(c), 0.3)
        others[:, :, c] = [(1 - p) * 0.95, 1.0, (1 - p) * 0.05, p]
    prior, post = others.copy(), None
    for _ in range(rounds):
        like = np.empty((len(n), 1 + n_cols))
        like[:, 0] = np.prod(matched[cols, levels], axis=1)
        for c in cols:
            rest = others[of_pass[:, None], c, cols, levels]
            rest[:, c] = differs[c, levels[:, c]]
            like[:, 1 + c] = np.prod(rest, axis=1)
        like *= share[of_stratum]
        post = like / np.maximum(like.sum(axis=1, keepdims=True), 1e-300)
        w = post * n[:, None]
        for k in range(len(names)):
            got = w[of_stratum == k].sum(axis=0)
            share[k] = got / max(got.sum(), 1e-300)
        count = lambda weight, c, x: weight[levels[:, c] == x].sum()
        for c in cols:
            near, same = count(w[:, 0], c, 2) + 0.1, count(w[:, 0], c, 3) + 0.9
            matched[c, 2:] = (1 - error) * near / (near + same), (1 - error) * same / (near + same)
            far, near = count(w[:, 1 + c], c, 0) + 0.95, count(w[:, 1 + c], c, 2) + 0.05
            differs[c, 0], differs[c, 2] = (1 - error) * far / (far + near), (1 - error) * near / (far + near)
            for k in range(len(passes)):
                for j in cols[cols != c]:
                    got = np.array([count(w[:, 1 + c] * (of_pass == k), j, x) + prior[k, c, j, x] * (x != 1) for x in range(4)])
                    got[1] = 0
                    others[k, c, j] = got / got.sum()
                    others[k, c, j, 1] = 1.0
    return {(p, q): float(x) for (p, q, _), x in zip(patterns, post[:, 0])}


def linked_profiles(rows: DataFrame, confident: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """Links between profiles (``a_pid, b_pid, a_n, b_n, confidence``) of ``comparable`` rows, and the profiles."""
    found = cut(profiles(rows))
    # squares of value counts, all attributes from one small table
    values = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.xxhash64(c).alias("v"), (F.col(c) != "").alias("said")) for k, c in enumerate(_FREE)])).alias("x"), "n").where("x.said")
    sums = values.groupBy("x.c", "x.v").agg(F.sum("n").cast("double").alias("n")).groupBy("c").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s")).collect()
    by_chance = {r["c"]: chance(r["n"], r["s"]) for r in sums}
    pairs = cut(candidate_pairs(found))
    seen = pairs.groupBy("pass", "pattern").agg(F.sum(F.col("a_n").cast("double") * F.col("b_n")).alias("n")).collect()  # a few hundred patterns at most
    names = list(PASSES)

    def levels(number: int, pattern: int) -> tuple[int | None, ...]:
        return tuple(pattern >> 2 * i & 3 if c in PASSES[names[number]] else None for i, c in enumerate(_FREE))

    posterior = estimate([(names[r["pass"]], levels(r["pass"], r["pattern"]), r["n"]) for r in seen], by_chance)
    scored = [(r["pass"], r["pattern"], posterior[names[r["pass"]], levels(r["pass"], r["pattern"])]) for r in seen]
    table = rows.sparkSession.createDataFrame([x for x in scored if x[2] >= confident], "pass int, pattern int, confidence double")
    return pairs.join(F.broadcast(table), ["pass", "pattern"]).select("a_pid", "b_pid", "a_n", "b_n", "confidence"), found


def linked_pairs(jobs: DataFrame, reference: DataFrame, confident: float = CONFIDENT, cities: dict[str, str] = CITIES) -> DataFrame:
    """``row_id_1, row_id_2, confidence``: pairs of rows of different sources that advertise the same opening.

    Rows without employer, source or a title with words take part in no pair; a missing city or team says nothing for or
    against; repeated rows make their own pairs.  An empty table gives no pairs.
    """
    rows = comparable(jobs, reference, cities)
    links, found = linked_profiles(rows, confident)
    # the members of a profile of very many rows are split into parts, as many as its size asks for
    members, parts = rows.select("pid", "row_id"), lambda n: F.ceil(n / TOGETHER).cast("int")
    many = found.where(F.col("n") > TOGETHER).select("pid", "n")
    members = members.withColumn("n", F.lit(1)) if many.isEmpty() else members.join(_light(many), "pid", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    for s in "ab":
        one = members.select(F.col("pid").alias(f"{s}_pid"), F.col("row_id").alias(f"{s}_id"), F.pmod(F.xxhash64("row_id"), parts(F.col("n"))).alias("part"))
        links = links.withColumn("part", F.explode(F.sequence(F.lit(0), parts(F.col(f"{s}_n")) - 1)))
        links = links.withColumn("part", F.col("part").cast("bigint")).join(one, [f"{s}_pid", "part"]).drop("part")
    return links.select(F.least("a_id", "b_id").alias("row_id_1"), F.greatest("a_id", "b_id").alias("row_id_2"), "confidence")


def linked_representatives(jobs: DataFrame, reference: DataFrame, confident: float = CONFIDENT, cities: dict[str, str] = CITIES) -> DataFrame:
    """``row_id_1, row_id_2, n_1, n_2, confidence``: the links between profiles only, each by its least row id; ``represented`` says which rows they stand for."""
    links, found = linked_profiles(comparable(jobs, reference, cities), confident)
    for s in "ab":
        links = links.join(found.select(F.col("pid").alias(f"{s}_pid"), F.col("row_id").alias(f"{s}_row_id")), f"{s}_pid")
    first = F.col("a_row_id") < F.col("b_row_id")
    pick = lambda c, one, two: F.when(first, F.col(f"{one}_{c}")).otherwise(F.col(f"{two}_{c}"))
    return links.select(pick("row_id", "a", "b").alias("row_id_1"), pick("row_id", "b", "a").alias("row_id_2"), pick("n", "a", "b").alias("n_1"), pick("n", "b", "a").alias("n_2"), "confidence")


def represented(jobs: DataFrame, reference: DataFrame, cities: dict[str, str] = CITIES) -> DataFrame:
    """``row_id, representative``: the least row id of the rows that are alike in source and all attributes; rows that take part in no pair are left out."""
    rows = comparable(jobs, reference, cities)
    return look_up(rows.select("pid", "row_id"), cut(profiles(rows).select("pid", F.col("row_id").alias("representative"))), ["pid"]).select("row_id", "representative")
