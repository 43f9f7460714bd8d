"""Reading level of documents: classic readability formulas, combined by medians.

A text is split into sentences (bullets and lines are sentences of their own if they are built like
one); headings, term lists and figures are no sentences.  Words get their syllables from hyphenation
patterns of their language: numbers between letters, of which the highest at a place counts, and an odd one
parts the word there.  Each sentence gets the grades of several formulas; their median is the
sentence's grade, and the median over sentences that of the text, so that a few sentences of another
level, or a foreign passage, don't move it.  The cuts between the levels are fitted per language on all
rated documents.

The language is an input column.  What the words of a language are that hold sentences together is learned from all
the documents themselves, and so is the language of a document that names none.
Tokens of a whole Arrow batch are found at once, the work per word is done once per distinct word, the rest is
arithmetic on arrays; word counts and grades are shuffled, texts never.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.analytics import running
from ..session import cut, look_up
from .words import slices

#: Ratings that a language needs for cuts of its own.
LEAST_RATED = 40
#: A sentence has so many words at least.
LEAST_WORDS = 4
#: A word is common in a language if this share of its documents with any word has it.
COMMON = 0.25
#: A language that fewer documents declare has no words of its own.
LEAST_DECLARED = 20
#: Distinct words that a worker remembers between batches, or counts before it hands them on.
REMEMBERED = 300_000

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset(
    "z b d h u a o ä bzw ca abt nr usw evtl ggf inkl vgl str dr prof hr fr mr mrs ms st no nos dept approx e g i eg ie etc vs min max std art "
    "p ex env n° av dpto núm ud uds sr sra aprox pág tel réf ref min km vol fig cf".split()
)
# Conjunctions after which a common word with a capital begins a sentence of its own.
CONJUNCTIONS = frozenset("and e en et und y".split())


# Per language the groups of vowels that are one nucleus; pairs of vowels not named here are parted.
NUCLEI = {
    "de": "ai au ei eu äu ie ee aa oo ui ay ey oy",
    "en": "ai au aw ay ea ee ei eu ew ey ie oa oe oi oo ou ow oy ue ui uy eau ya ye yo you yu tio sio gio cio cia tia sia",
    "es": "ai au ei eu oi ou ia ie io ua ue uo iu ui ié ió iá ué uá uó éi ái óis ay ey oy uy",
    "fr": "ai au eau ei eu oi ou œu ie io ia iè ui ué ua oui ée ie aî oî eû ay ey oy ieu iai éa ue ion",
    "": "ai au ei eu oi ou ie ia io ua ue uo ea ee oa oo ay ey oy",
}
# Endings (of letters, or C for any consonant) without a nucleus of their own, and those that keep theirs in spite of them.
MUTE = {
    "de": ("", ""),
    "en": ("Ce Ces Ced ue ues", "le les se.s ces ses zes xes ches shes ges ted ded"),
    "es": ("", ""),
    "fr": ("Ce Ces Cent", "Cement ment"),
    "": ("", ""),
}
_VOWELS = "aeiouyàâäáãåæèéêëìíîïòóôöõøœùúûüýÿ"
_CONSONANTS = "bcdfghjklmnpqrstvwxzßçñ"


@dataclass(frozen=True)
class Patterns:
    """Hyphenation patterns: letters ('.' is a word's edge) -> numbers before, between and behind them."""

    numbers: dict[str, tuple[int, ...]]
    longest: int

    @staticmethod
    def of(lang: str) -> Patterns:
        """The patterns of a language, built from its nuclei and endings."""
        rules: dict[str, tuple[int, ...]] = {}

        def rule(letters: str, at: int, n: int) -> None:
            old = rules.get(letters, (0,) * (len(letters) + 1))
            rules[letters] = tuple(max(x, n) if k == at else x for k, x in enumerate(old))

        lang = lang if lang in NUCLEI else ""
        # 1: a consonant and the vowel after it begin a syllable, as does a vowel after another
        for v in _VOWELS:
            for c in _CONSONANTS:
                rule(c + v, 0, 1)
            for w in _VOWELS:
                rule(v + w, 1, 1)
        # 2: a nucleus isn't parted; the consonants before the first vowel aren't either (see count)
        for nucleus in NUCLEI[lang].split():
            for k in range(1, len(nucleus)):
                rule(nucleus, k, 2)
        mute, kept = MUTE[lang]
        for level, endings in ((4, mute), (5, kept)):
            for e in endings.replace(".", "").split():
                for form in [e.replace("C", c) for c in _CONSONANTS] if "C" in e else [e]:
                    first = next(k for k, x in enumerate(form) if x in _VOWELS)
                    if form[:1] in _VOWELS:  # a mute vowel at the end of a nucleus
                        rule(form + ".", 1, level)
                    else:
                        rule(form + ".", max(first - 1, 0), level)
        return Patterns(rules, max(map(len, rules)))

    def count(self, word: str) -> int:
        """Syllables of a lower-case word: the parts it may be parted into that have a vowel."""
        w = f".{word}."
        points = [0] * (len(w) + 1)
        for i in range(len(w)):
            for j in range(i + 2, min(i + self.longest, len(w)) + 1):
                numbers = self.numbers.get(w[i:j])
                if numbers:
                    for k, n in enumerate(numbers, i):
                        if n > points[k]:
                            points[k] = n
        n, vowel = 0, False
        for k in range(1, len(w) - 1):
            if points[k] & 1 and vowel:
                n, vowel = n + 1, False
            vowel = vowel or w[k] in _VOWELS
        return max(n + vowel, 1)


# a tag or remark that is never closed ends with its text
_TAG = re.compile(r"<(?:br|/?(?:p|li|ul|ol|div|h\d|tr|td))\b[^<>\x01]*>|<!--[^\x01]*?-->", re.I)
_INLINE = re.compile(r"</?[a-zA-Z][^<>\x01]*>")
_SEP = "\x01"
# a bullet at a line's start; a word with the mark that ends its sentence; such a mark alone; commas; line and text ends
_TOKEN = re.compile(
    r"(?<=\n)[^\S\n]*(?:[-*•·▪►–—+»>]|\d{1,3}[.)]|[a-z]\))[^\S\n]+"
    r"|[^\W\d_]+(?:['’\-][^\W\d_]+)*(?:[.!?…。]+[\"'»”’)\]]*(?=[\s\x01]))?"
    r"|[.!?…。]+[\"'»”’)\]]*(?=[\s\x01])|[,;]|[\r\n\u2028\u2029\u0085]|\x01"
)
_BASE = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
WORD, END, COMMA, LINE, BULLET, TEXT = 1, 2, 4, 8, 16, 32
CAPITAL, JOINS = 64, 128


def tokens(texts: list[str | None]) -> list[str]:
    """The tokens of all texts in a row; every text begins with a separator and a line end."""
    joined = "".join(f"{_SEP}\n{t.replace(_SEP, ' ') if t else ''}" for t in texts) + _SEP
    if "<" in joined:
        joined = _INLINE.sub("", _TAG.sub("\n", joined))
    if "&" in joined:
        joined = html.unescape(joined)
    return _TOKEN.findall(joined)


def token_kind(token: str) -> int:
    """What a token is, as bits."""
    if token == _SEP:
        return TEXT
    base = _BASE.match(token)
    if base and not token[-1].isspace():
        word, marks = base[0], token[base.end() :]
        low = word.lower()
        ends = bool(marks) and not (marks[0] == "." and len(marks.rstrip("\"'»”’)]")) == 1 and (low in ABBREVIATIONS or len(low) == 1))
        return WORD | (END if ends else 0) | (CAPITAL if word[0].isupper() and (len(word) == 1 or not word.isupper()) else 0) | (JOINS if low in CONJUNCTIONS else 0)
    if token in "\r\n\u2028\u2029\u0085":
        return LINE
    if token[0] in ",;":
        return COMMA
    return BULLET if token[-1].isspace() else END


class Words:
    """Common words of each language, as learned; what is known of a word is computed once."""

    def __init__(self, common: dict[str, frozenset[str]]):
        self.common = common
        self.any = frozenset().union(*common.values()) if common else frozenset()
        self.langs = [*sorted(common), ""]
        self.seen: dict[str, int] = {}
        self.kind, self.size, self.grammar = (np.empty(0, np.int16) for _ in range(3))
        self.base: list[str] = []
        self.patterns = {lang: Patterns.of(lang) for lang in self.langs}
        self.syllables = np.empty((0, len(self.langs)), np.int16)

    def codes(self, names: list[str]) -> np.ndarray:
        """Places of tokens in the tables."""
        if len(self.seen) > REMEMBERED:
            self.__init__(self.common)
        new = [x for x in names if x not in self.seen]
        if new:
            kind = np.array([token_kind(x) for x in new], np.int16)
            base = [_BASE.match(x)[0].lower() if k & WORD else "" for x, k in zip(new, kind)]
            self.seen.update({x: len(self.base) + k for k, x in enumerate(new)})
            self.base += base
            self.kind = np.concatenate([self.kind, kind])
            self.size = np.concatenate([self.size, np.array([len(x) for x in base], np.int16)])
            self.grammar = np.concatenate([self.grammar, np.array([x in self.any for x in base], np.int16)])
            self.syllables = np.concatenate([self.syllables, np.full((len(new), len(self.langs)), -1, np.int16)])
        return np.fromiter((self.seen[x] for x in names), np.int64, len(names))

    def count(self, codes: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Syllables of words in their languages (places in ``langs``)."""
        got = self.syllables[codes, lang]
        for c, k in set(zip(codes[got < 0].tolist(), lang[got < 0].tolist())):
            self.syllables[c, k] = self.patterns[self.langs[k]].count(self.base[c])
        return self.syllables[codes, lang]


def word_counts(texts: list[str | None], langs: list[str]) -> pd.DataFrame:
    """``lang, word, n``: the texts of each language that have a word; the word '' counts those that have any."""
    code, names = pd.factorize(np.array(tokens(texts), object))
    text = np.cumsum(code == 0) - 1  # the first token is a separator
    word, bases = pd.factorize(np.array([_BASE.match(x)[0].lower() if token_kind(x) & WORD else "" for x in names], object))
    word, size = word[code], len(bases)
    pairs = pd.unique((text * size + word)[word > 0])
    pairs = np.concatenate([pairs, pd.unique(pairs // size) * size])
    lang, said = pd.factorize(np.array(langs, object))
    at, n = np.unique(lang[pairs // size] * size + pairs % size, return_counts=True)
    return pd.DataFrame({"lang": said[at // size], "word": bases[at % size], "n": n})


def least_counts(texts: dict[str, int], total: int) -> dict[str, float]:
    """Language -> the texts that have a common word of it, at least; '' for all of the ``total`` together, where no language has ``LEAST_DECLARED`` texts.

    The share is half of ``COMMON`` there, as languages may be mixed, but for many texts of which none declares any.
    """
    named = {lang: COMMON * n for lang, n in texts.items() if lang and n >= LEAST_DECLARED}
    mixed = texts.get("", 0) < max(total, LEAST_DECLARED)
    return named or ({"": COMMON * total / (1 + mixed)} if total else {})


def common_words(texts: list[str], langs: list[str]) -> dict[str, frozenset[str]]:
    """What ``learn`` finds, for texts in memory."""
    n = word_counts(texts, langs)
    any_word = n["word"] == ""
    least = least_counts(dict(zip(n["lang"][any_word], n["n"][any_word].tolist())), int(n["n"][any_word].sum()))
    n = n[~any_word].assign(**{"lang": ""} if "" in least else {}).groupby(["lang", "word"], as_index=False)["n"].sum()
    return {lang: frozenset(n["word"][(n["lang"] == lang) & (n["n"] >= k)]) for lang, k in least.items()}


def learn(docs: DataFrame, text: str, lang: str) -> dict[str, frozenset[str]]:
    """Common words of each declared language, counted in all documents; only those come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            langs, names = zip(*seen) if seen else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

        seen: Counter[tuple[str, str]] = Counter()
        for whole in batches:
            for b in slices(whole):
                n = word_counts(b.column(0).to_pylist(), b.column(1).to_pylist())
                seen.update(dict(zip(zip(n["lang"], n["word"]), n["n"].tolist())))
                if len(seen) > REMEMBERED:
                    yield handed()
                    seen.clear()
        yield handed()

    rows = docs.select(F.col(text).cast("string"), F.coalesce(F.lower(F.col(lang).cast("string")), F.lit("")))
    counts = cut(rows.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    texts = counts.where("word = ''")
    enough = texts.where(F.col("n") >= LEAST_DECLARED)
    least = least_counts({r["lang"]: r["n"] for r in enough.collect()}, texts.agg(F.sum("n")).first()[0] or 0)
    if "" in least:
        found = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least[""]).select(F.lit("").alias("lang"), "word")
    else:
        found = look_up(counts, enough.where("lang <> ''").select("lang", (F.col("n") * COMMON).alias("least")), ["lang"]).where("n >= least")
    out: dict[str, set[str]] = {x: set() for x in least}
    for r in found.where("word <> ''").select("lang", "word").collect() if least else ():
        out[r["lang"]].add(r["word"])
    return {x: frozenset(w) for x, w in out.items()}


def sentence_grades(n_words, n_syll, n_long, n_chars, n_poly, lang: np.ndarray) -> np.ndarray:
    """The median grade of each sentence (arrays by sentence): Flesch-Kincaid, Gunning fog, SMOG, automated index, Coleman-Liau, LIX, and the formula of the language."""
    w = np.maximum(n_words, 1).astype(float)
    syl, ch, poly, lix6 = n_syll / w, n_chars / w, n_poly / w, n_long / w
    fk = 0.39 * w + 11.8 * syl - 15.59
    fog = 0.4 * (w + 100 * poly)
    smog = 1.043 * np.sqrt(30 * n_poly) + 3.1291
    ari = 4.71 * ch + 0.5 * w - 21.43
    cl = 5.88 * ch - 29.6 / w - 15.8
    lix = (w + 100 * lix6) / 4 - 1.5
    own = np.select(
        [lang == "de", lang == "fr", lang == "es"],
        [19.35 * poly + 0.1672 * w + 12.97 * lix6 - 0.875, (207 - 1.015 * w - 73.6 * syl) / -10 + 12, (206.84 - 1.02 * w - 60 * syl) / -10 + 12],
        (206.835 - 1.015 * w - 84.6 * syl) / -10 + 12,
    )
    return np.median(np.stack([fk, fog, smog, ari, cl, lix, own]), axis=0)


def _units(texts: list[str | None], words: Words):
    """The tokens of all texts by unit (what stands between marks, lines and texts): code, kind, text, unit; and per unit whether it is a sentence, its words, its text."""
    found = tokens(texts)
    code, names = pd.factorize(np.array(found, object))
    code = words.codes(list(names))[code]
    kind = words.kind[code]
    text = np.cumsum(kind == TEXT) - 1
    is_word, is_end = (kind & WORD) > 0, (kind & END) > 0
    # a common word with a capital after a conjunction begins a sentence that was run on
    run_on = np.zeros(len(code), bool)
    run_on[1:] = ((kind[:-1] & (JOINS | END)) == JOINS) & ((kind[1:] & CAPITAL) > 0) & (words.grammar[code[1:]] > 0)
    breaks = is_end | ((kind & (LINE | TEXT)) > 0)
    unit = np.cumsum(np.concatenate([[False], breaks[:-1]]) | run_on | ((kind & TEXT) > 0))
    n_units = int(unit[-1]) + 1
    total = lambda x: np.bincount(unit, x, minlength=n_units)
    n_words, grammar = total(is_word), total(words.grammar[code])
    commas, bullet, ended = total((kind & COMMA) > 0), total((kind & BULLET) > 0) > 0, total(is_end) > 0
    good = (n_words >= LEAST_WORDS) & (grammar >= 1) & (ended | (((grammar >= 2) | bullet) & (commas * 3 < n_words)))
    text_of = np.zeros(n_units, np.int64)
    text_of[unit] = text
    return code, kind, text, unit, good, n_words, text_of


def sentences(text: str, words: Words) -> list[list[str]]:
    """The words of each sentence of a text; headings, labels and lists of terms are none."""
    code, kind, _, unit, good, _, _ = _units([text], words)
    return [[words.base[c] for c in code[(unit == u) & ((kind & WORD) > 0)]] for u in np.flatnonzero(good)]


def _profile(texts: list[str | None], langs: list[str | None], words: Words) -> pd.DataFrame:
    """``lang_used, grade, n_sentences`` of each text."""
    out = pd.DataFrame({"lang_used": np.full(len(texts), None, object), "grade": np.full(len(texts), np.nan), "n_sentences": np.zeros(len(texts), np.int64)})
    code, kind, text, unit, good, n_words, text_of = _units(texts, words)
    n_units, is_word = len(good), (kind & WORD) > 0
    if not good.any():
        return out
    # the declared language, or the one most of whose common words the text has
    said = np.array([words.langs.index(x.lower()) if x and x.lower() in words.common else -1 for x in langs], np.int64)
    if (said < 0).any() and words.common:
        asked = is_word & (said[np.clip(text, 0, len(langs) - 1)] < 0)
        at, where = np.unique(code[asked], return_inverse=True)
        for k, lang in enumerate(words.langs[:-1]):
            has = np.array([words.base[c] in words.common[lang] for c in at], float)
            n = np.bincount(text[asked], has[where], minlength=len(texts))[: len(texts)]
            best, pick = (n, np.zeros(len(texts), np.int64)) if k == 0 else (np.maximum(best, n), np.where(n > best, k, pick))
        said = np.where(said < 0, np.where(best > 0, pick, len(words.langs) - 1), said)
    said = np.where(said < 0, len(words.langs) - 1, said)
    w = np.flatnonzero(is_word & good[unit])
    syllables, size, u = words.count(code[w], said[text[w]]), words.size[code[w]], unit[w]
    total = lambda x: np.bincount(u, x, minlength=n_units)[good]
    lang_s = np.array(words.langs, object)[said[text_of[good]]]
    grades = sentence_grades(n_words[good], total(syllables), total(size > 6), total(size), total(syllables >= 3), lang_s)
    by = pd.Series(grades).groupby(text_of[good])
    middle = by.median()
    out.loc[middle.index, "grade"] = middle.to_numpy()
    out.loc[middle.index, "n_sentences"] = by.size().to_numpy()
    out.loc[middle.index, "lang_used"] = np.array(words.langs, object)[said[middle.index]]
    return out


def reading_grades(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, lang_used, grade, n_sentences`` of every document; the grade is null where there is no running text (null, blank, term lists)."""
    common = learn(docs, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(common)
        for whole in batches:
            for b in slices(whole):
                p = _profile(b.column(1).to_pylist(), b.column(2).to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(p["lang_used"].tolist(), pa.string()), pa.array(p["grade"], pa.float64(), from_pandas=True), pa.array(p["n_sentences"], pa.int32())],
                    ["key", "lang_used", "grade", "n_sentences"],
                )

    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string"), F.col(lang).cast("string").alias("said"))
    return rows.mapInArrow(run, f"key {kind}, lang_used string, grade double, n_sentences int").withColumnRenamed("key", key)


def _between(below: float, above: float | None) -> float:
    """A cut between two neighbouring grades, or outside of the first or the last one."""
    if above is None or np.isinf(below):
        return below + 1 if above is None else above - 1
    middle = (below + above) / 2
    return middle if middle < above else below  # neighbouring floats


def fit_cuts(rated: pd.DataFrame) -> dict[str, tuple[float, float]]:
    """What ``fitted_cuts`` finds, for a table in memory."""

    def best(grade: np.ndarray, level: np.ndarray, upper: int) -> float:
        g, place = np.unique(grade, return_inverse=True)
        wrong = np.concatenate([[0], np.cumsum(np.bincount(place, np.where(level >= upper, 1, -1)))])
        at = np.flatnonzero(wrong == wrong.min())
        at = at[len(at) // 2]
        return _between(float(g[at - 1]) if at else -np.inf, float(g[at]) if at < len(g) else None)

    cuts = {}
    for lang, x in [("", rated), *rated[rated["lang_used"] != ""].groupby("lang_used")]:
        if len(x) and (lang == "" or len(x) >= LEAST_RATED):
            g, lv = x["grade"].to_numpy(float), x["level"].to_numpy(float)
            cuts[lang] = (best(g, lv, 2), best(g, lv, 3))
    return cuts


def fitted_cuts(rated: DataFrame) -> dict[str, tuple[float, float]]:
    """Language -> the two cuts between levels 1, 2 and 3 with the fewest wrong levels among all rows of ``lang_used, grade, level``; '' for all languages together.

    A cut never parts equal grades; of several that are as good the middle one counts.  Wrong levels are running totals in ranges of the
    grades; to the driver come two rows per language.
    """
    key = ["lang", "upper"]
    rows = rated.select(F.explode(F.array_distinct(F.array(F.lit(""), F.col("lang_used")))).alias("lang"), "grade", "level").withColumn("upper", F.explode(F.array(F.lit(2), F.lit(3))))
    # the place before all grades is a cut too
    places = F.array(F.struct(F.col("grade"), F.lit(1).alias("n")), F.struct(F.lit(float("-inf")).alias("grade"), F.lit(0).alias("n")))
    rows = rows.select(*key, "level", F.explode(places).alias("p")).groupBy(*key, F.col("p.grade").alias("grade"))
    steps = rows.agg(F.sum("p.n").alias("n"), F.sum(F.when(F.col("level") >= F.col("upper"), F.col("p.n")).otherwise(-F.col("p.n"))).alias("step"))
    steps = cut(running(steps.withColumn("place", F.struct(*key, "grade")), "place", {"wrong": "step"}).drop("place"))
    fewest = steps.groupBy(*key).agg(F.min("wrong").alias("wrong"), F.sum("n").alias("n")).where((F.col("lang") == "") | (F.col("n") >= LEAST_RATED)).drop("n")
    tied = look_up(steps, fewest, [*key, "wrong"]).groupBy(*key).agg(F.expr("percentile_disc(0.5) within group (order by grade desc)").alias("below"))
    tied = cut(tied)
    above = look_up(steps, tied, key).groupBy(*key, "below").agg(F.min(F.when(F.col("grade") > F.col("below"), F.col("grade"))).alias("above"))
    found = {(r["lang"], r["upper"]): _between(r["below"], r["above"]) for r in above.collect()}
    return {lang: (found[lang, 2], found[lang, 3]) for lang in sorted({x for x, _ in found})}


def level_column(cuts: dict[str, tuple[float, float]], grade: Column, lang: Column) -> Column:
    """The level of a grade; without any ratings the usual school grades 6 and 12 part the levels."""
    low, high = cuts.get("", (6.0, 12.0))
    at = lambda k, usual: F.coalesce(*[F.when(lang == name, c[k]) for name, c in cuts.items() if name], F.lit(usual))
    return F.when(grade <= at(0, low), 1).when(grade <= F.greatest(at(0, low), at(1, high)), 2).otherwise(3).cast("bigint")


def reading_levels(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, reading_level, grade, lang_used`` of every document with running text.

    A document's rating is the median of its non-null ratings (a tie goes down); ratings of unknown documents and null ratings
    don't count.  The cuts are fitted on all rated documents.
    Repeated documents are graded each.  An empty table gives an empty table.
    """
    grades = cut(reading_grades(docs, key, text, lang))
    rated = ratings.where("reading_level between 1 and 3").groupBy(F.col(key)).agg(F.expr("percentile_disc(0.5) within group (order by reading_level)").cast("double").alias("level"))
    cuts = fitted_cuts(grades.where("grade is not null").join(rated, key).select("lang_used", "grade", "level"))
    return grades.where("grade is not null").select(key, level_column(cuts, F.col("grade"), F.col("lang_used")).alias("reading_level"), "grade", "lang_used")
