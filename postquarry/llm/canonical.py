"""Free-entered values -> the entry of a reference list they stand for.

A partition-based pigeonhole join, SQL only.  Each reference string of length l that may differ by
k edits is cut into k + 1 segments; a value within k edits holds at least one of them, at a position
that is shifted by a bounded amount.  So values and references are equality-joined on (length,
segment number, substring), with the substrings of a value taken only at the positions that can
matter; candidates are verified with the built-in ``levenshtein``, and values without any are
reported through an anti-join.  The join works on distinct values, so a value that a third of all
rows hold costs as much as any other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, cut, is_small, look_up

#: (least length of the reference string, edits allowed from there on)
EDITS = ((0, 0), (5, 1), (8, 2), (12, 3), (15, 4))


# Words for a level, by language (en, de, fr, es, nl, it, pt), without accents.
LEVELS = {
    "senior": "senior sr snr erfahrener confirme ervaren esperto experiente",
    "junior": "junior jr jnr entry_level trainee angehender debutant beginnend giovane principiante iniciante",
    "lead": "lead ld leitender leidinggevend capo lider principal",
}
# Usual short forms of words in titles and categories, by word.
SHORT_FORMS = {
    "account": "acct acc", "accountant": "acct", "administration": "admin adm", "administrator": "adm admin", "analyst": "anl anlst analys", "application": "app appl", "architect": "arch archt",
    "assistant": "asst assist", "associate": "assoc", "consultant": "cons cnslt consult", "coordinator": "coord", "customer": "cust", "department": "dept", "design": "dsgn", "developer": "dev",
    "development": "dev", "director": "dir", "engineer": "eng engr engnr", "engineering": "eng", "executive": "exec", "finance": "fin", "general": "gen", "hardware": "hw", "human resources": "hr",
    "information": "info", "information technology": "it", "international": "intl", "management": "mgmt", "manager": "mgr mngr", "manufacturing": "mfg", "marketing": "mktg", "network": "nw netw",
    "officer": "ofcr", "operations": "ops", "operator": "opr", "planner": "plan plnr", "president": "pres", "product": "prod", "product manager": "pm prod_mgr", "production": "prod",
    "professional": "prof", "program manager": "pgm", "project": "proj", "quality": "qual", "quality assurance": "qa", "representative": "rep", "research": "rsrch", "researcher": "research rsrchr res",
    "scientist": "sci scntst scient", "secretary": "sec secy", "security": "sec", "service": "svc", "software": "sw", "specialist": "spec", "supervisor": "supv", "support": "supp", "system": "sys",
    "systems": "sys", "technical": "tech", "technician": "tech techn tchn", "technology": "tech", "user experience": "ux", "vice president": "vp",
}
# What tells a bracketed note that is no part of a title, and notes that stand behind a separator.
NOTES = "/|gender|hybrid|remote|urgent|onsite|on-site|contract|temps|zeit|time"
NOTES_BEHIND = r"remote|hybrid|urgent|onsite|(?:\d+[ -]months? )?contract|full[ -]time|part[ -]time"


@dataclass(frozen=True)
class Wording:
    """How people write beside the entries: reference data that a caller may replace by their own."""

    levels: dict[str, str] = field(default_factory=lambda: LEVELS)
    short_forms: dict[str, str] = field(default_factory=lambda: SHORT_FORMS)
    notes: str = NOTES
    notes_behind: str = NOTES_BEHIND

    def level_words(self) -> list[str]:
        return [w.replace("_", " ") for words in self.levels.values() for w in words.split()]


USUAL = Wording()
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKES = ("аеорсухіјѕкмтнвбԁοανρτυι", "aeopcyxijskmthbbdoavptui")


def plain(text: Column) -> Column:
    """Lower case without accents and look-alike letters; anything but letters and digits is one space; 'and' words are dropped."""
    t = F.lower(F.regexp_replace(text, r"[\p{Mn}\x{200B}-\x{200D}\x{FEFF}\x{AD}]", ""))
    t = F.translate(t, _LOOKALIKES[0] + _ACCENTS[0], _LOOKALIKES[1] + _ACCENTS[1])
    for c, by in (("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
        t = F.replace(t, F.lit(c), F.lit(by))
    t = F.regexp_replace(t, r"(?<=\b\p{L})\.(?=\p{L}\b)", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    t = F.regexp_replace(t, r"(?<= |^)(?:and|und)(?= )", " ")
    return F.trim(F.regexp_replace(t, r" +", " "))


def without_remarks(text: Column, wording: Wording = USUAL) -> Column:
    """``text`` without gender notes, contract remarks, reference numbers and marks in front."""
    remark = (
        rf"(?i)[(\[{{][^)\]}}]*(?:{wording.notes})[^)\]}}]*[)\]}}]"
        r"|\*+[^*]*\*+|#\s*\d+|^[^\p{L}\p{N}(\[]+"
        rf"|\s[-–—|/,]\s*(?:{wording.notes_behind})\s*$"
    )
    t = F.regexp_replace(text, r"[_\s\p{Z}]+", " ")
    for _ in range(2):
        t = F.trim(F.regexp_replace(t, remark, " "))
    return t


def edits(length: Column, allowed: tuple[tuple[int, int], ...] = EDITS) -> Column:
    """Edits allowed for a reference string of ``length``."""
    k = F.lit(0)
    for least, n in allowed:
        k = F.when(length >= least, n).otherwise(k)
    return k


def _edits(length: int, allowed: tuple[tuple[int, int], ...]) -> int:
    return [0, *[n for least, n in allowed if length >= least]][-1]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def level(text: Column, wording: Wording = USUAL) -> Column:
    """senior, junior, lead or none: by the first or last words of a plain title, slips of the pen allowed."""

    def of(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(wording.levels.items()):
            out = F.when(F.arrays_overlap(t, F.array(*[F.lit(w) for w in words.split()])), name).otherwise(out)
        return F.coalesce(out, let(F.element_at(t, 1), near), let(F.element_at(t, -1), near), F.lit("none"))

    def near(word: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(wording.levels.items()):
            for w in words.split():
                if len(w) >= 4:
                    out = F.when(_near(word, w), name).otherwise(out)
        return out

    return F.coalesce(let(F.split(plain(without_remarks(text, wording)), " "), of), F.lit("none"))


def _near(word: Column, target: str) -> Column:
    return F.levenshtein(word, F.lit(target), 2 if len(target) < 6 else 3) >= 0


def candidates(text: Column, wording: Wording = USUAL) -> Column:
    """The plain strings that may be the entry itself: the whole, without remarks, and its parts around separators."""
    sep = r"\s[-–—|/]\s|\s?[@>|]\s?|\s?,\s|\s?[;:]\s"
    level_words = r"(?:" + "|".join(sorted(wording.level_words(), key=len, reverse=True)) + r")"

    def readings(t: Column) -> Column:
        no_brackets = F.regexp_replace(t, r"[(\[][^)\]]*[)\]]", " ")
        return F.array_distinct(F.array(t, no_brackets, F.regexp_extract(t, rf"^(.*)(?:{sep})", 1), F.regexp_extract(t, rf"(?:{sep})(.*?)$", 1)))

    def like_level(w: Column) -> Column:
        hit = F.lit(False)
        for target in wording.level_words():
            if len(target) >= 4:
                hit = hit | _near(w, target)
        return hit

    # a level word at either end is dropped, also a misspelt one
    ended = lambda x: F.regexp_replace(F.regexp_replace(x, rf"^{level_words} ", ""), rf" {level_words}$", "")
    first = lambda x: F.when(like_level(F.substring_index(x, " ", 1)), F.regexp_replace(x, r"^\S+ ", ""))
    last = lambda x: F.when(like_level(F.substring_index(x, " ", -1)), F.regexp_replace(x, r" \S+$", ""))
    texts = F.array_distinct(F.transform(F.transform(let(without_remarks(text, wording), readings), plain), ended))
    every = F.flatten(F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.when(x.contains(" "), F.array(x, first(x), last(x))).otherwise(F.array(x))))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def reference_strings(reference: DataFrame, wording: Wording = USUAL) -> DataFrame:
    """``field, text, ref_id``: labels and other names, in every rotation of their words and with usual short forms.

    A string that stands for several entries of a field is left to the one whose label it is, else to the least ``ref_id``.
    """
    names = reference.select(
        "field", "ref_id", F.explode(F.concat(F.array("label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("name"), F.col("label").alias("__label")
    ).where("name is not null and ref_id is not null and field is not null")
    base = names.select("field", "ref_id", plain(F.col("name")).alias("t"), (F.col("name") != F.col("__label")).cast("int").alias("__alt"))
    shorts = F.array(F.col("t"), *[F.when(F.col("t").rlike(rf"\b{w}\b"), F.regexp_replace("t", rf"\b{w}\b", s.replace("_", " "))) for w, forms in wording.short_forms.items() for s in forms.split()])
    base = base.withColumn("t", F.explode(F.filter(shorts, lambda x: x.isNotNull()))).withColumn("__w", F.split("t", " "))
    turned = base.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.greatest(F.size("__w") - 1, F.lit(0))))).select(
        "field", "ref_id", "__alt", "__turn",
        F.array_join(F.concat(F.expr("slice(__w, __turn + 1, size(__w))"), F.expr("slice(__w, 1, __turn)")), " ").alias("text"),
    )
    best = F.min(F.struct((F.col("__turn") > 0).cast("int"), "__alt", "ref_id"))
    return turned.where("text <> ''").groupBy("field", "text").agg(best.alias("b")).select("field", "text", F.col("b.ref_id").alias("ref_id"))


def _layout(spark, lengths: list[int], allowed: tuple[tuple[int, int], ...]) -> DataFrame:
    """``m, l, i, at, n``: of a value of length m, the substrings (1-based at, n long) that may be segment i of a reference of length l."""
    rows = []
    for ref_len in lengths:
        k = _edits(ref_len, allowed)
        cuts = [ref_len * i // (k + 1) for i in range(k + 2)]
        for m in range(max(1, ref_len - k), ref_len + k + 1):
            d = m - ref_len
            for i in range(k + 1):
                n = cuts[i + 1] - cuts[i]
                for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
                    at = cuts[i] + shift
                    if 0 <= at and at + n <= m:
                        rows.append((m, ref_len, i, at + 1, n))
    return spark.createDataFrame(rows, "m int, l int, i int, at int, n int")


def closest_entries(strings: DataFrame, reference: DataFrame, allowed: tuple[tuple[int, int], ...] = EDITS, wording: Wording = USUAL) -> DataFrame:
    """``field, text, ref_id, edits`` for the distinct plain ``strings`` (``field, text``) that have an entry within reach.

    ``allowed``: the edits from each length of the reference string on.
    """
    return closest_strings(strings, cut(reference_strings(reference, wording)), allowed)


def closest_strings(strings: DataFrame, refs: DataFrame, allowed: tuple[tuple[int, int], ...] = EDITS) -> DataFrame:
    """The pigeonhole join itself: ``closest_entries`` for reference strings (``field, text, ref_id``) as they stand.

    Ties go to the entry with the same letters in another order, then to the least ``ref_id``.
    """
    spark = strings.sparkSession
    lengths = sorted(r["l"] for r in refs.select(F.length("text").alias("l")).distinct().collect())
    if not lengths:
        return strings.select("field", "text", F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("int").alias("edits")).where("false")
    hint = F.broadcast if is_small(refs, BROADCAST_BYTES // 8) else (lambda x: x)  # a string has up to five segments
    segs = refs.withColumn("l", F.length("text")).withColumn("__k", edits(F.col("l"), allowed)).select(
        "field", F.col("text").alias("ref"), "ref_id", "l", F.col("__k").alias("k"), F.explode(F.sequence(F.lit(0), F.col("__k"))).alias("i")
    )
    segs = segs.withColumn("seg", F.expr("substring(ref, int(floor(l * i / (k + 1))) + 1, int(floor(l * (i + 1) / (k + 1))) - int(floor(l * i / (k + 1))))"))
    # the layout is as long as the reference strings are, whatever their number
    probes = strings.withColumn("m", F.length("text")).join(F.broadcast(_layout(spark, lengths, allowed)), "m")
    probes = probes.select("field", "text", "l", "i", F.expr("substring(text, at, n)").alias("seg"))
    near = probes.join(hint(segs), ["field", "l", "i", "seg"]).withColumn("edits", F.levenshtein("text", "ref", max(n for _, n in allowed))).where("edits >= 0 and edits <= k")
    # of equally near entries the one with the same letters in another order is meant: letters change places easily
    letters = lambda c: F.array_sort(F.split(c, ""))
    moved = F.when(F.col("edits") > 1, (letters("text") != letters("ref")).cast("int")).otherwise(0)
    best = near.groupBy("field", "text").agg(F.min(F.struct("edits", moved.alias("moved"), "ref_id")).alias("b"))
    return best.select("field", "text", F.col("b.ref_id").alias("ref_id"), F.col("b.edits").alias("edits"))


def map_values(values: DataFrame, reference: DataFrame, wording: Wording = USUAL) -> DataFrame:
    """``values`` (``field, value``, distinct) with ``ref_id`` and ``edits``; ref_id -1 stands for no entry.

    Of several readings of a value the one with the fewest edits counts, then the longest, then the least ``ref_id``.  Null and blank
    values are no values and left out.  With an empty reference list every value is reported with -1.
    """
    spread = values.where("value is not null").select("field", "value", F.explode_outer(candidates(F.col("value"), wording)).alias("text"))
    spread = cut(spread)  # the readings of a value are made once
    found = closest_entries(spread.select("field", "text").where("text is not null").distinct(), reference, wording=wording)
    scored = spread.join(found, ["field", "text"])
    best = scored.groupBy("field", "value").agg(F.min(F.struct("edits", (-F.length("text")).alias("l"), "ref_id")).alias("b"))
    matched = cut(best.select("field", "value", F.col("b.ref_id").alias("ref_id"), F.col("b.edits").alias("edits")))
    rest = spread.select("field", "value").distinct().join(matched, ["field", "value"], "left_anti")
    return matched.unionByName(rest.select("field", "value", F.lit(-1).cast("bigint").alias("ref_id"), F.lit(None).cast("int").alias("edits")))


def entered_values(jobs: DataFrame, fields: tuple[str, ...] = ("title", "job_category")) -> DataFrame:
    """``row_id, field, value`` of the non-blank values of ``fields``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), jobs[f].alias("value")) for f in fields])
    rows = jobs.select("row_id", F.explode(pairs).alias("x")).select("row_id", "x.field", "x.value")
    return rows.where(r"value is not null and not value rlike '^[\\s\\p{Z}]*$'")


def canonical_matches(jobs: DataFrame, reference: DataFrame, fields: tuple[str, ...] = ("title", "job_category"), wording: Wording = USUAL) -> DataFrame:
    """``row_id, field, ref_id`` of every non-blank value that isn't identical to a label of its field; -1: stands for none."""
    labels = reference.select("field", F.col("label").alias("value")).distinct()
    rows = entered_values(jobs, fields).join(F.broadcast(labels) if is_small(labels) else labels, ["field", "value"], "left_anti")
    mapped = cut(map_values(rows.select("field", "value").distinct(), reference, wording))
    # a third of all rows may have one value: the few distinct ones travel to the rows, or each is split
    return look_up(rows, mapped, ["field", "value"]).select(F.col("row_id").cast("bigint"), "field", F.col("ref_id").cast("bigint"))


def nearest_labels(values: DataFrame, reference: DataFrame, allowed: tuple[tuple[int, int], ...] = EDITS) -> DataFrame:
    """``field, value, ref_id, edits``: distinct lower-case values (``field, value``) and the label fewest edits away, nothing else being understood; the join alone."""
    names = reference.where("label is not null and ref_id is not null").select("field", "ref_id", F.lower(F.trim("label")).alias("text")).where("text <> ''")
    refs = names.groupBy("field", "text").agg(F.min("ref_id").alias("ref_id"))
    strings = values.select("field", F.lower(F.trim("value")).alias("text")).where("text <> ''").distinct()
    return closest_strings(strings, cut(refs), allowed).select("field", F.col("text").alias("value"), "ref_id", "edits")
