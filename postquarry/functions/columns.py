"""Column -> Column functions: coercion, dates, urls, escapes, labels. All JVM-side, none raises on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that mean false; all other texts, and null, mean true.
FALSE_WORDS = ("false", "f", "0", "no", "n")
# Signs of a page that refuses to be read.
BLOCKED_SIGNS = ("access denied", "blocked", "captcha", "robot", "bot detection", "rate limit", "too many requests", "suspicious activity")
# Date notations tried in order by the two parsers.
DATES_A = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")
DATES_B = ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "M/d/yyyy")
# The five characters that are escaped in mark-up, the ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))

_TRIM = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, _TRIM, "")


def filled(*cs: Column) -> Column:
    """The first that is neither null nor empty; null if none is."""
    return F.coalesce(*[F.when(c != "", c) for c in cs])


def as_active(c: Column) -> Column:
    """A flag out of text; anything but a word for false is true."""
    return ~F.coalesce(F.lower(strip(c.cast("string"))).isin(*FALSE_WORDS), F.lit(False))


def collapse(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def parse_date(c: Column, formats: tuple[str, ...] = DATES_A) -> Column:
    """The date that the first fitting notation gives; a leading 'Posted ' is dropped; null if none fits."""
    t = F.regexp_replace(c, "^Posted ", "")
    return F.coalesce(*[F.try_to_date(t, f) for f in formats])


def show_date(c: Column, formats: tuple[str, ...] = DATES_B) -> Column:
    """``04 Jul, 2025``; a text that is no date as it is; N/A for null and empty."""
    return F.coalesce(F.date_format(parse_date(c, formats), "dd MMM, yyyy"), filled(c), F.lit("N/A"))


def age_hours(then: Column, now: Column) -> Column:
    """Hours between two moments."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(3.6e9)


def escape(c: Column, breaks: bool = False) -> Column:
    """Text safe inside mark-up; ``breaks``: new lines become <br> and quotes stay."""
    for raw, safe in ESCAPES[: 3 if breaks else 5]:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.replace(c, F.lit("\n"), F.lit("<br>")) if breaks else c


def unescape(c: Column) -> Column:
    """The common entities decoded, the ampersand last."""
    for raw, safe in (*ESCAPES[1:], ("'", "&#x27;"), (" ", "&nbsp;"), ESCAPES[0]):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def safe_url(c: Column) -> Column:
    """The url, escaped, if it is http or https; else #."""
    return F.when(F.lower(strip(c)).rlike("^https?://"), escape(strip(c))).otherwise("#")


def json_endpoint(url: Column) -> Column:
    """The first '/search?' of a url as '/search.json?'."""
    return F.regexp_replace(url, r"^(.*?)/search\?", r"$1/search.json?")


def titled(c: Column) -> Column:
    """Every run of letters with a capital in front: ``api_feed`` becomes ``Api_Feed``."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def set_param(url: Column, key: str, value: Column) -> Column:
    """A query parameter replaced, or appended if the url has none of that name."""
    pattern = rf"([?&])\Q{key}\E=[^&]*"
    # signs that a replacement would read as groups or escapes stand for themselves
    literal = F.regexp_replace(F.concat(F.lit(f"{key}="), value), r"([\\$])", r"\\$1")
    appended = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(f"{key}="), value)
    return F.when(url.rlike(pattern), F.regexp_replace(url, F.lit(pattern), F.concat(F.lit("$1"), literal))).otherwise(appended)


def int_param(url: Column, key: str, default: int) -> Column:
    """A query parameter as a whole number; the default if it is absent or none."""
    return F.coalesce(F.regexp_extract(url, rf"[?&]\Q{key}\E=([^&#]+)", 1).try_cast("int"), F.lit(default))


def has_param(url: Column, key: str, value: str) -> Column:
    """Whether a url's query has this value for this parameter; false for null."""
    return F.coalesce(url.rlike(rf"[?&]\Q{key}\E=[^&#]*\Q{value}\E"), F.lit(False))


def clean_query(url: Column, winner: str = "", losers: tuple[str, ...] = ()) -> Column:
    """The url without blank parameters; where ``winner`` is present, ``losers`` go. Order is kept."""
    parts = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(parts, lambda p: p.contains("=") & ~p.endswith("=") & (name(p) != ""))
    if winner:
        has = F.exists(kept, lambda p: name(p) == winner)
        kept = F.filter(kept, lambda p: ~(has & name(p).isin(*losers)))
    base, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), tail)


def path_id(path: Column) -> Column:
    """The digits after /jobs/; null if there are none."""
    return filled(F.regexp_extract(path, r"/jobs/(\d+)", 1))


def safe_id(c: Column) -> Column:
    """Anything but letters, digits, _ and - as _."""
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")


def blocked(page: Column) -> Column:
    """Whether a page's text has a sign that it refuses to be read; false for null."""
    return F.coalesce(F.lower(page).rlike("|".join(BLOCKED_SIGNS)), F.lit(False))


def role_and_team(title: Column) -> tuple[Column, Column]:
    """Role and team of a title: one comma, one hyphen, the word 'position', else the first comma or ' - '; else all is the role."""
    steps = (r"(?s)^([^,]+),\s*([^,]+)$", r"(?s)^([^-]+)\s*-\s*([^-]+)$", r"^(.+?)\s+position\s+(.+)$", r"(?s)^([^,]*),(.*)$", r"(?s)^(.*?) - (.*)$")
    t = F.coalesce(title, F.lit(""))
    role, team = t, F.lit("")
    for p in reversed(steps):
        hit = t.rlike(p)
        role = F.when(hit, strip(F.regexp_extract(t, p, 1))).otherwise(role)
        team = F.when(hit, strip(F.regexp_extract(t, p, 2))).otherwise(team)
    return role, team


def role_and_team_by_separator(title: Column) -> tuple[Column, Column]:
    """Role and team of a title at the first of the separators ',', ' - ', ' – ', ' — ' that it has; else all is the role."""
    t = F.coalesce(title, F.lit(""))
    role, team = strip(t), F.lit("")
    for p in (r"(?s)^(.*?)\s*[,–—-]\s+(.*)$", r"(?s)^(.*?) — (.*)$", r"(?s)^(.*?) – (.*)$", r"(?s)^(.*?) - (.*)$", r"(?s)^(.*?),(.*)$"):
        hit = t.rlike(p)
        role = F.when(hit, strip(F.regexp_extract(t, p, 1))).otherwise(role)
        team = F.when(hit, strip(F.regexp_extract(t, p, 2))).otherwise(team)
    return role, team


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, not rounded; 0 where the whole is 0 or null."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def pages(n: Column, size: int) -> Column:
    """Pages of ``size`` that ``n`` rows fill."""
    return F.ceil(n / F.lit(size)).cast("bigint")


def faded(color: Column, alpha: str) -> Column:
    """An rgba colour with another alpha."""
    return F.regexp_replace(color, r",\s*[0-9.]+\)$", f",{alpha})")


def chosen(names: Column, most: int = 3) -> Column:
    """A label for a selection: the names, or how many there are."""
    return F.when(F.size(names) <= most, F.array_join(names, ", ")).otherwise(F.concat(F.size(names).cast("string"), F.lit(" selected")))


def guarded_json(c: Column) -> Column:
    """JSON of a struct, safe inside a script element."""
    return F.replace(F.to_json(c), F.lit("</"), F.lit("<\\/"))


def first_of_each(xs: Column, fold_case: bool = False) -> Column:
    """An array without later repeats; ``fold_case``: case doesn't matter, the first spelling stays."""
    if not fold_case:
        return F.array_distinct(xs)
    low = F.transform(xs, F.lower)
    return F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def without(xs: Column, ys: Column) -> Column:
    """The elements of ``xs`` that aren't in ``ys``, repeats kept."""
    return F.filter(xs, lambda x: ~F.array_contains(ys, x))
