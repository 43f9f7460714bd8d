"""Mixed timestamp notations and zones -> one UTC moment.

An ordered cascade of anchored patterns is tried on the trimmed text; the first pattern that
matches names the calendar fields and the zone token.  Fields are then parsed strictly (an
impossible date is invalid, it never rolls over).  The zone is, in this order: the offset in the
text, a zone abbreviation (its fixed offset, whatever the season), a region name, else the home
zone of the row's source.  What a local time that occurs twice means, and one that is skipped, is a policy of the caller
(``AMBIGUOUS``, ``NONEXISTENT``): by default the first of the two, and ahead by the length of the gap.  Everything is built from column
expressions, so there is no Python worker and no shuffle: only the small lookup of home zones is
joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID = "invalid"
#: Policies for a local time that occurs twice and for one that is skipped; the first is the default.
AMBIGUOUS = ("first", "second", "invalid")
NONEXISTENT = ("forward", "backward", "invalid")
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
BLANK = r"^[\s\p{Z}]*$"

# Month names of the seven languages of the feeds, January to December.
MONTHS = [
    "january january jan januar janvier enero januari gennaio janeiro jan ene gen janv",
    "february feb februar février fevrier febrero februari febbraio fevereiro fev févr",
    "march mar märz maerz mars marzo maart março marco mrz mrt",
    "april apr avril abril aprile abr avr",
    "may mai mayo mei maggio maio mag",
    "june jun juni juin junio giugno junho giu",
    "july jul juli juillet julio luglio julho lug juil",
    "august aug août aout agosto augustus ago",
    "september sep sept septembre septiembre settembre setembro set",
    "october oct oktober octobre octubre ottobre outubro okt out ott",
    "november nov novembre noviembre novembro",
    "december dec dezember décembre decembre diciembre dicembre dezembro dez dic déc",
]

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "JST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r" ?(Z|z|[A-Z]{2,5}|[+\-]\d{2}(?::?\d{2})?|\[?[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+\]?)"
_TAIL = rf"(?:(?:[T ]|, ?| at ){_TIME}(?:{_ZONE})?)?"
_WORD = r"([A-Za-zÀ-ÿ]+)\.?"


@dataclass(frozen=True)
class Pattern:
    """One step of the cascade; the groups are named by position (0: absent)."""

    name: str
    regex: str
    year: int
    month: int
    day: int
    hour: int = 4
    named_month: bool = False
    by_source: bool = False


#: Tried in this order; all are anchored at both ends.
CASCADE = (
    Pattern("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}}){_TAIL}$", 1, 2, 3),
    Pattern("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,]\d+)?()(?:{_ZONE})?)?$", 1, 2, 3),
    Pattern("year first", rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_TAIL}$", 1, 2, 3),
    Pattern("slashes", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_TAIL}$", 3, 1, 2, by_source=True),
    Pattern("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_TAIL}$", 3, 2, 1),
    Pattern("month first", rf"^{_WORD} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_TAIL}$", 3, 1, 2, named_month=True),
    Pattern("day first", rf"^(?:{_WORD},? )?(\d{{1,2}})\.?[ \-](?:de |of )?{_WORD}[ \-](?:de )?(\d{{4}}){_TAIL}$", 4, 3, 2, 5, named_month=True),
)


def _month_map() -> Column:
    pairs = {name: k + 1 for k, names in enumerate(MONTHS) for name in names.split()}
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _number(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c).cast("int")


def _fields(text: Column, p: Pattern, mdy: Column) -> Column:
    """The matched text rewritten as year|month|day|hour|minute|second|half of day|zone."""
    tail = "".join(f"|${p.hour + k}" for k in range(5))
    usual = F.regexp_replace(text, p.regex, f"${p.year}|${p.month}|${p.day}{tail}")
    if not p.by_source:
        return usual
    return F.when(mdy, usual).otherwise(F.regexp_replace(text, p.regex, f"${p.year}|${p.day}|${p.month}{tail}"))


def tidy(text: Column) -> Column:
    """Trim all kinds of space, collapse inner runs, and drop a leading remark such as 'Posted'."""
    t = F.regexp_replace(text, r"[\s\p{Z}\x{200B}\x{FEFF}]+", " ")
    return F.regexp_replace(F.trim(t), r"(?i)^posted(?: on)?:? ", "")


def _known_zones(df: DataFrame) -> list[str]:
    try:
        return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:  # a session without a JVM gateway
        return sorted(available_timezones())


def local_to_utc(local: Column, zone: Column, ambiguous: str = AMBIGUOUS[0], nonexistent: str = NONEXISTENT[0]) -> Column:
    """The moment (without zone, in UTC) of a local time in a region, by an explicit policy; null where the policy says invalid.

    ``first``/``second`` of two moments with the same local time; a skipped local time goes ``forward`` by the length of the gap (read
    with the offset before it) or ``backward`` (with the offset after it).
    """
    if ambiguous not in AMBIGUOUS or nonexistent not in NONEXISTENT:
        raise ValueError(f"ambiguous is one of {AMBIGUOUS}, nonexistent one of {NONEXISTENT}")
    utc = F.lit("UTC")
    offset = lambda at: F.timestamp_diff("SECOND", at, F.convert_timezone(utc, zone, at))
    # the offsets half a day before and after hold on the two sides of any change nearby
    half = F.make_dt_interval(F.lit(0), F.lit(12))
    sides = [offset(F.convert_timezone(zone, utc, local) + sign * half) for sign in (F.lit(-1), F.lit(1))]
    before, after = (local - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s) for s in sides)
    fits = lambda at: F.convert_timezone(utc, zone, at) == local
    twice = {"first": F.least(before, after), "second": F.greatest(before, after), "invalid": F.lit(None)}[ambiguous]
    skipped = {"forward": before, "backward": after, "invalid": F.lit(None)}[nonexistent]
    return F.when(before == after, before).when(fits(before) & fits(after), twice).when(fits(before), before).when(fits(after), after).otherwise(skipped)


def normalise_timestamps(df: DataFrame, text: str, sources: DataFrame, source: str = "source", ambiguous: str = AMBIGUOUS[0], nonexistent: str = NONEXISTENT[0]) -> DataFrame:
    """``df`` with ``posted_utc`` (``YYYY-MM-DDTHH:MM:SSZ``, ``invalid``, or null for a blank text) and ``pattern``.

    ``sources`` has one row per source: ``source, home_zone, numeric_order``; a source that is not
    listed, null, or has no zone counts as UTC with days first.  Should a source be listed twice,
    the least zone and order are taken, so rows are never multiplied.  Columns of ``df`` are kept;
    ``posted_utc`` and ``pattern`` are replaced if they exist.  An empty table gives an empty table.
    """
    look = (
        sources.where(F.col("source").isNotNull())
        .groupBy(F.col("source").alias("__source"))
        .agg(F.min("home_zone").alias("__home"), F.min("numeric_order").alias("__order"))
    )
    # the row travels as one struct, so that no name in it can clash with one in here
    keep = [c for c in df.columns if c not in ("posted_utc", "pattern")]
    base = df.select(F.struct(*[df[c] for c in keep]).alias("__row"), df[text].cast("string").alias("__raw"), tidy(df[text].cast("string")).alias("__text"), df[source].cast("string").alias("__from"))
    out = base.join(look, F.col("__from") == F.col("__source"), "left")
    t = F.col("__text")
    mdy = F.coalesce(F.col("__order") == "MDY", F.lit(False))
    epoch = t.rlike(r"^\d{10}(?:\d{3})?$")
    step = F.when(epoch, 0)
    for k, q in enumerate(CASCADE, 1):
        step = step.when(t.rlike(q.regex), k)
    out = out.withColumn("__step", step)
    text_of = F.lit(None).cast("string")
    for k, q in enumerate(CASCADE, 1):
        text_of = F.when(F.col("__step") == k, _fields(t, q, mdy)).otherwise(text_of)
    out = out.withColumn("__f", F.split(text_of, r"\|", -1))
    f = lambda k: F.col("__f")[k]
    named = F.col("__step").isin(*[k for k, q in enumerate(CASCADE, 1) if q.named_month])
    month = F.when(named, F.try_element_at(_month_map(), F.lower(f(1)))).otherwise(F.expr("try_cast(__f[1] as int)"))
    hour = F.coalesce(_number(f(3)), F.lit(0))
    hour = F.when(f(6) == "", hour).when(hour.between(1, 12), hour % 12 + F.when(F.lower(f(6)) == "p", 12).otherwise(0))
    second = F.coalesce(_number(f(5)), F.lit(0))
    out = out.withColumn("__p", F.struct(
        _number(f(0)).alias("y"), month.alias("mo"), _number(f(2)).alias("d"), hour.alias("h"),
        F.coalesce(_number(f(4)), F.lit(0)).alias("mi"), F.when(second <= 59, second).alias("s"), f(7).alias("zone"),
    ))
    p = lambda name: F.col(f"__p.{name}")
    local = F.expr("try_make_timestamp_ntz(__p.y, __p.mo, __p.d, __p.h, __p.mi, cast(__p.s as decimal(16,6)))")
    name = F.when(F.col("__step") == 0, F.lit("epoch"))
    for k, q in enumerate(CASCADE, 1):
        name = name.when(F.col("__step") == k, F.lit(q.name))
    zone = F.regexp_replace(p("zone"), r"[\[\]]", "")
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    offset = F.when(
        zone.rlike(r"^[+\-]"),
        (F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(_number(F.substring(digits, 3, 2)), F.lit(0))) * F.when(zone.startswith("-"), -1).otherwise(1),
    ).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), F.upper(zone)))
    zones = _known_zones(df)
    known = zone.isin(*zones)
    home = F.when(F.col("__home").isin(*zones), F.col("__home")).otherwise("UTC")
    region = F.when(zone == "", home).when(known, zone)
    out = out.withColumn("__local", local).withColumn("__offset", offset).withColumn("__region", region)
    moment = F.coalesce(
        F.expr("__local - make_dt_interval(0, 0, __offset, 0)"),
        F.when(F.col("__region") == "UTC", F.col("__local")).otherwise(local_to_utc(F.col("__local"), F.col("__region"), ambiguous, nonexistent)),
        F.when(t.rlike(r"^\d{10}$"), F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, try_cast(__text as decimal(18,6)))")),
        F.when(t.rlike(r"^\d{13}$"), F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast(substring(__text, 1, 10) as decimal(18,6)))")),
    )
    shown = F.concat(F.translate(F.substring(moment.cast("string"), 1, 19), " ", "T"), F.lit("Z"))
    shown = F.when(F.col("__raw").isNull() | F.col("__raw").rlike(BLANK), F.lit(None)).otherwise(F.coalesce(shown, F.lit(INVALID)))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in keep], shown.alias("posted_utc"), name.alias("pattern"))


def odd_timestamps(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """``row_id, posted_utc`` of every non-blank ``posting_date`` that isn't in the one form yet."""
    c = F.col("posting_date")
    rows = jobs.where(c.isNotNull() & ~c.rlike(BLANK) & ~c.rlike(CANONICAL)).select("row_id", "posting_date", "source")
    return normalise_timestamps(rows, "posting_date", sources).select(F.col("row_id").cast("bigint"), "posted_utc")
