"""The language of each text and of each stretch of it: family first, then one against one.

Sentences are described by their words and the words' character n-grams, hashed.  Linear support
vector machines tell the families (Germanic, Romance, ...) apart; within a family one machine per pair of languages
votes.  The languages are those that enough rows declare.  The machines are trained here, on a bounded sample of rows whose
declared language is known, the same number per language; since declared languages are wrong at times, sentences that the first
machines contradict are left out of a second training.  A part of the sample is held out and turns margins into
confidences.  A text whose letter sequences are mostly unknown to the sample is in none of the languages (``und``).

A machine's score is a sum over words, so each distinct word of an Arrow batch is scored once; sentences
are sums over their words.  Markup removal, sentence and word splitting run over a whole batch at
once.  There is no shuffle.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import PLACEHOLDERS, slices

# Families of languages by code; a language that isn't here is a family of its own.
FAMILIES = {
    "baltic": "lt lv", "celtic": "br cy ga gd", "germanic": "af da de en fy is lb nb nl nn no sv", "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk", "turkic": "az kk ky tr uz", "uralic": "et fi hu",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: What a text in none of the languages is labelled.
NONE = "und"

#: Rows of each declared language used for training, at most, and characters of each of their texts, at most.
MAX_ROWS, MAX_CHARS = 600, 20_000
#: A declared language has so many rows at least.
LEAST_DECLARED = 10
#: One in so many texts of the sample is held out to turn margins into confidences.
HELD_OUT = 5
#: A text of at least ``LEAST_NOVEL`` words is in no known language if it has fewer of the known letter sequences than held-out texts have, by this much.
LEAST_NOVEL, NOVEL = 8, 0.1
#: Width of the hashed features, passes over the sample, strength of the margin.
WIDTH, PASSES, RATE = 1 << 16, 6, 0.5
#: A sentence that is less firm than this takes the language of its neighbours.
LEAST_SURE = 0.6
#: A title that is less firm than this takes the language that the row's text begins with.
TITLE_SURE = 0.97
LEAST_WORDS = 3
#: Slope of the curve from margin to confidence where too little is held out to fit one.
USUAL_STEEP = 4.0
#: Distinct words that a worker remembers between batches.
REMEMBERED = 300_000

# Names and codes by which a declared language may be known (the code before '-' or '_' counts too).
DECLARED = {
    "en": "en eng english englisch anglais inglés ingles inglese engels inglês",
    "de": "de deu ger german deutsch allemand alemán aleman tedesco duits alemão",
    "fr": "fr fra fre french französisch franzosisch français francais francés frances francese frans",
    "es": "es spa spanish spanisch espagnol español espanol castellano spagnolo spaans espanhol",
    "nl": "nl nld dut dutch niederländisch niederlandisch néerlandais neerlandais neerlandés olandese nederlands holandês",
    "it": "it ita italian italienisch italien italiano italiaans",
    "pt": "pt por portuguese portugiesisch portugais portugués portugues portoghese portugees português",
}

# Cyrillic letters that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухіјѕкмтв", "aeopcyxijskmtb")

_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_SEP = ""
_TOKEN = re.compile(r"[^\W\d_]+|[.!?…]+(?=[\s\"')\]»”<]|$|)|[\n\r]|")


def declared(lang: Column) -> Column:
    """The two-letter code that a label means; the label itself (lower case) if it means another language; null if it means none."""
    t = F.lower(F.trim(lang))
    known = F.create_map(*[F.lit(x) for code, names in DECLARED.items() for n in names.split() for x in (n, code)])
    short = F.regexp_extract(t, r"^([a-z]{2,3})[-_]", 1)
    none = t.isNull() | t.isin("", "und", "unknown", "n/a", "na", "null", "none", "mul", "zxx", "mis", "xx", "?", "-")
    return F.when(none, None).otherwise(F.coalesce(F.try_element_at(known, t), F.try_element_at(known, short), t))


@dataclass
class Sentences:
    """The sentences of a batch: the text each belongs to, and its words as codes of ``names``."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    codes: np.ndarray
    names: list[str] = field(default_factory=list)
    #: The same of what has words but is no sentence (headings, bullets, lists).
    rest: Sentences | None = None


def split_sentences(texts: list[str | None], whole: bool = False) -> Sentences:
    """Sentences of all texts at once; ``whole``: each text is one sentence.  Lists and headings, which end without a stop, are no
    sentences (``rest``) unless a text has nothing else of at least ``LEAST_WORDS`` words."""
    joined = _SEP.join("" if t is None else t.replace(_SEP, " ") for t in texts)
    if "<" in joined:
        joined = _TAG.sub("\n", joined)
    if "&" in joined:
        joined = html.unescape(joined)
    joined = unicodedata.normalize("NFC", joined).lower().replace("­", "").replace("​", "")
    tokens = _TOKEN.findall(joined)
    if not tokens:
        e = np.empty(0, np.int64)
        return Sentences(e, e, e, e)
    codes, names = pd.factorize(np.array(tokens, object))
    names = list(names)
    kind = np.array([3 if n == _SEP else 2 if n in "\n\r" else 1 if not n[0].isalpha() else 0 for n in names], np.int8)[codes]
    text_at = np.cumsum(kind == 3)
    cut = (kind == 3) if whole else (kind > 0)
    unit = np.cumsum(cut) - cut  # the mark that ends a unit belongs to it
    is_word = kind == 0
    n_units = int(unit[-1]) + 1
    size = np.bincount(unit[is_word], minlength=n_units)
    ended = np.zeros(n_units, bool)
    ended[unit[kind == 1]] = True
    text_of = np.zeros(n_units, np.int64)
    text_of[unit[::-1]] = (text_at - (kind == 3))[::-1]
    if whole:
        ok = size > 0
    else:
        good = ended & (size >= LEAST_WORDS)
        has = np.zeros(len(texts), bool)
        has[text_of[good]] = True
        ok = good | (~has[text_of] & (size >= LEAST_WORDS))
    word_codes = codes[is_word]
    start = np.cumsum(size) - size
    other = ~ok & (size > 0)
    place = np.cumsum(ok)  # sentences before a unit
    rest = Sentences(text_of[other], start[other], size[other], word_codes, names)
    rest.before = place[other]
    return Sentences(text_of[ok], start[ok], size[ok], word_codes, names, rest)


def _hashed(lists: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All strings' hashes in a row, and how many each list has: one call for all."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = [x for xs in lists for x in xs]
    if not flat:
        return np.empty(0, np.int64), size
    return (pd.util.hash_array(np.array(flat, object), categorize=False) % np.uint64(width)).astype(np.int64), size


def grams(word: str) -> list[str]:
    """Features of a word: itself as written and without accents, and the n-grams (2 to 4) of the latter."""
    bare = word
    if not word.isascii():
        word = word.translate(_LOOKALIKES)
        bare = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    w = f"^{bare}$"
    return sorted({f"={word}", f"~{bare}", *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))})


class WordFeatures:
    """The features of distinct words, laid end to end."""

    def __init__(self, names: list[str]):
        self.flat, self.size = _hashed([grams(n) for n in names], WIDTH)


def word_scores(weights: np.ndarray, names: list[str]) -> np.ndarray:
    """One row per word, one column per machine."""
    wf = WordFeatures(names)
    out = np.zeros((len(names), weights.shape[1]), np.float32)
    starts = np.cumsum(wf.size) - wf.size
    out[:] = np.add.reduceat(weights[wf.flat], starts, axis=0) / np.sqrt(wf.size)[:, None]
    return out


#: Places for letter sequences.
SEQUENCES = 1 << 20


def sequences(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter sequences (three in a row) of words, laid end to end, and how many each has; for telling whether a language was met before."""
    edged = [f"^{n if n.isascii() else n.translate(_LOOKALIKES)}$" for n in names]
    return _hashed([[w[i : i + 3] for i in range(len(w) - 2)] for w in edged], SEQUENCES)


def known_sequences(known: np.ndarray, names: list[str]) -> np.ndarray:
    """Per word: letter sequences that are known, and all."""
    flat, size = sequences(names)
    hits = np.bincount(np.repeat(np.arange(len(names)), size), known[flat], minlength=len(names)) if len(flat) else np.zeros(len(names))
    return np.stack([hits, size], 1).astype(float)


@dataclass
class Machines:
    """Languages and the weights of the machines between families, then between languages of a family."""

    langs: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    steep: np.ndarray
    known: np.ndarray | None = None
    least_known: float = 0.0

    @staticmethod
    def plan(langs: tuple[str, ...]) -> tuple[tuple[str, ...], list[tuple[int, int]], list[tuple[int, int]]]:
        """Families; pairs of families; pairs of languages (places in ``langs``) within a family."""
        of = [_FAMILY.get(x, x) for x in langs]
        families = tuple(sorted(set(of)))
        pairs = [p for f in families for p in itertools.combinations([k for k, x in enumerate(of) if x == f], 2)]
        return families, list(itertools.combinations(range(len(families)), 2)), pairs

    def margins(self, s: Sentences, scores: np.ndarray) -> np.ndarray:
        """One row per sentence, from the scores of its words."""
        if not len(s.size):
            return np.empty((0, self.weights.shape[1]), np.float32)
        ends = s.start + s.size
        total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores[s.codes], axis=0, dtype=np.float64)])
        return (total[ends] - total[s.start]) / s.size[:, None] + self.bias

    def decide(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index into ``langs``, confidence, and firmness of each row of margins: the confidence that the margins would have if nothing was known of this sample."""
        families, between, within = self.plan(self.langs)
        of = np.array([families.index(_FAMILY.get(x, x)) for x in self.langs])

        def vote(pairs: list[tuple[int, int]], first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
            votes, least = np.zeros((len(m), n)), np.full((2, len(m), n), 40.0)
            for k, (a, b) in enumerate(pairs, first):
                x = m[:, k]
                votes[:, a] += (x > 0) + 0.2 * np.tanh(x)
                votes[:, b] += (x <= 0) - 0.2 * np.tanh(x)
                for j, steep in enumerate((self.steep[k], USUAL_STEEP)):
                    least[j, :, a], least[j, :, b] = np.minimum(least[j, :, a], steep * x), np.minimum(least[j, :, b], -steep * x)
            return votes, least

        rows = np.arange(len(m))
        votes, of_family = vote(between, 0, len(families))
        family = votes.argmax(axis=1)
        votes, of_lang = vote(within, len(between), len(self.langs))
        votes[of[None, :] != family[:, None]] = -9
        best = votes.argmax(axis=1)
        sure, firm = (1 / (1 + np.exp(-of_family[j][rows, family])) / (1 + np.exp(-of_lang[j][rows, best])) for j in (0, 1))
        return best, sure, firm


def _targets(lang: np.ndarray, langs: tuple[str, ...]) -> np.ndarray:
    families, between, within = Machines.plan(langs)
    of = np.array([families.index(_FAMILY.get(x, x)) for x in langs])[lang]
    target = np.zeros((len(lang), len(between) + len(within)))
    for k, (a, b) in enumerate(between):
        target[of == a, k], target[of == b, k] = 1, -1
    for k, (a, b) in enumerate(within, len(between)):
        target[lang == a, k], target[lang == b, k] = 1, -1
    return target


def _train_once(s: Sentences, wf: WordFeatures, lang: np.ndarray, langs: tuple[str, ...], seed: int = 3) -> Machines:
    """Hinge-loss machines by mini-batch gradient steps over sentences, averaged over the later passes."""
    rng = np.random.default_rng(seed)
    first = np.cumsum(wf.size) - wf.size
    target = _targets(lang, langs)
    machines = target.shape[1]
    weights, bias = np.zeros((WIDTH, machines)), np.zeros(machines)
    mean_w, mean_b, n_mean = np.zeros_like(weights), np.zeros_like(bias), 0
    for step in range(PASSES):
        order = rng.permutation(len(lang))
        for part in np.array_split(order, max(1, len(order) // 256)):
            size = s.size[part]
            owner = np.repeat(np.arange(len(part)), size)
            at = np.repeat(s.start[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            # sentences share words: features are gathered once per distinct word of the batch
            used, inverse = np.unique(s.codes[at], return_inverse=True)
            n = wf.size[used]
            starts = np.cumsum(n) - n
            feat = wf.flat[np.repeat(first[used] - starts, n) + np.arange(n.sum())]
            scale = 1 / np.sqrt(n)
            word = np.add.reduceat(weights[feat], starts, axis=0) * scale[:, None]
            m = np.add.reduceat(word[inverse], np.cumsum(size) - size, axis=0) / size[:, None] + bias
            y = target[part]
            g = np.where(y * m < 1, y, 0)
            eta = RATE / (1 + step)
            pull = g[owner] / size[owner][:, None]
            touched, where = np.unique(feat, return_inverse=True)
            for k in range(machines):
                per_word = np.bincount(inverse, pull[:, k], minlength=len(used)) * scale
                weights[touched, k] += eta * np.bincount(where, np.repeat(per_word, n), minlength=len(touched))
            bias += eta * 0.1 * g.mean(axis=0)
        weights *= 1 - 0.01
        if step >= PASSES // 2:
            mean_w, mean_b, n_mean = mean_w + weights, mean_b + bias, n_mean + 1
    return Machines(langs, (mean_w / max(n_mean, 1)).astype(np.float32), mean_b / max(n_mean, 1), np.full(machines, USUAL_STEEP))


def _steepness(margin: np.ndarray, target: np.ndarray) -> float:
    """The slope of the logistic curve under which held-out margins are likeliest."""
    if len(margin) < 20:
        return USUAL_STEEP
    slopes = np.geomspace(0.5, 30, 60)
    return float(slopes[np.argmin([np.logaddexp(0, -a * margin * target).mean() for a in slopes])])


def train(texts: list[str], declared_as: list[str], whole: bool = False) -> Machines:
    """Machines from texts with their (partly wrong) languages."""
    langs = tuple(sorted(set(declared_as)))
    s = split_sentences(texts, whole)
    said = np.array([langs.index(x) for x in declared_as], np.int64)
    if not len(s.text) or not langs:
        n = len(Machines.plan(langs)[1]) + len(Machines.plan(langs)[2])
        return Machines(langs or (NONE,), np.zeros((WIDTH, n), np.float32), np.zeros(n), np.ones(n))
    lang, wf = said[s.text], WordFeatures(s.names)
    held = s.text % HELD_OUT == 0
    part = lambda ok: Sentences(s.text[ok], s.start[ok], s.size[ok], s.codes, s.names)
    first = _train_once(part(~held), wf, lang[~held], langs) if (~held).any() else _train_once(s, wf, lang, langs)
    m = first.margins(s, word_scores(first.weights, s.names))
    ok = first.decide(m)[0] == lang
    # a held-out text whose sentences mostly agree with its label is taken to be labelled rightly; single sentences of it may then be decided wrongly
    sound = np.bincount(s.text, ok, minlength=len(texts)) * 2 > np.bincount(s.text, minlength=len(texts))
    sure = held & sound[s.text]
    target = _targets(lang, langs)
    out = _train_once(part(ok), wf, lang[ok], langs) if ok.any() else first
    out.steep = np.array([_steepness(m[sure & (target[:, k] != 0), k], target[sure & (target[:, k] != 0), k]) for k in range(m.shape[1])])
    # letter sequences of the texts trained on, and how many of those of held-out texts they have
    out.known = np.zeros(SEQUENCES, bool)
    used = np.unique(np.concatenate([s.codes[a : a + n] for a, n in zip(s.start[~held], s.size[~held])])) if (~held).any() else np.arange(len(s.names))
    out.known[sequences([s.names[c] for c in used])[0]] = True
    if held.any():
        hits, total = shares(part(held), known_sequences(out.known, s.names), len(texts))
        out.least_known = float(np.quantile((hits / np.maximum(total, 1))[total > 0], 0.01)) - NOVEL
    return out


def shares(s: Sentences, per_word: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The two columns of ``per_word`` summed over the sentences of each text."""
    ends, c = s.start + s.size, np.concatenate([[[0.0, 0.0]], np.cumsum(per_word[s.codes], axis=0)])
    by = c[ends] - c[s.start]
    return tuple(np.bincount(s.text, by[:, k], minlength=n_texts) for k in (0, 1))


def training_sample(df: DataFrame, key: str, texts: tuple[str, ...], lang: str) -> pd.DataFrame:
    """``texts, lang`` of ``MAX_ROWS`` rows of each declared language at most, chosen by a hash of their key; texts are of ``MAX_CHARS`` characters at most."""
    rows = df.select(F.xxhash64(key).alias("h"), declared(F.col(lang)).alias("said"), F.array(*texts).alias("texts")).where(r"said rlike '^[a-z]{2}$'")
    rows = rows.where(F.forall("texts", lambda t: F.coalesce((F.length(F.trim(t)) > 3) & (F.length(t) <= MAX_CHARS), F.lit(False))))
    # a cheap threshold on the hash first: only a bounded number of rows is sorted; two letters make 676 languages at most
    n = rows.groupBy("said").count().where(F.col("count") >= LEAST_DECLARED)
    rows = rows.join(F.broadcast(n), "said").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("count") < 2 * MAX_ROWS)
    w = Window.partitionBy("said").orderBy("h", "texts")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= MAX_ROWS).select("texts", F.col("said").alias("lang")).orderBy("lang", "r").toPandas()


_STRETCH = ["text", "kind", "segment", "lang", "confidence", "firm", "n_sentences", "n_segments"]


class Labeller:
    """Sentence languages of batches; words met before are remembered."""

    def __init__(self, machines: Machines):
        self.machines, self.seen = machines, {}
        self.table = np.zeros((0, machines.weights.shape[1]), np.float32)
        self.novel = np.zeros((0, 2))

    def _codes(self, names: list[str]) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.__init__(self.machines)
        new = [n for n in names if n not in self.seen]
        if new:
            base = len(self.seen)
            self.seen.update({n: base + k for k, n in enumerate(new)})
            self.table = np.concatenate([self.table, word_scores(self.machines.weights, new)])
            known = self.machines.known if self.machines.known is not None else np.ones(SEQUENCES, bool)
            self.novel = np.concatenate([self.novel, known_sequences(known, new)])
        return np.fromiter((self.seen[n] for n in names), np.int64, len(names))

    def _foreign(self, s: Sentences, at: np.ndarray, n_texts: int) -> np.ndarray:
        """Texts (by place) whose letter sequences are mostly unknown."""
        hits, total = shares(s, self.novel[at], n_texts)
        return (np.bincount(s.text, s.size, minlength=n_texts) >= LEAST_NOVEL) & (hits < self.machines.least_known * total)

    def __call__(self, texts: list[str | None], whole: bool) -> pd.DataFrame:
        """``text`` (place in the batch), ``kind, segment, lang, confidence, n_sentences, n_segments`` of the stretches.

        A sentence that is uncertain belongs to the stretch it stands in, if its text has a certain one, and lowers its confidence. What is no sentence
        (headings, bullets, lists) makes no segment; where its language is another than that of the segment it stands in, it is a row of
        ``kind`` fragment with that segment's number and its own, usually low, confidence.
        """
        s = split_sentences(texts, whole)
        langs = np.array([*self.machines.langs, NONE], object)
        if not len(s.names):
            return pd.DataFrame({c: np.empty(0, object if c in ("kind", "lang") else float if c in ("confidence", "firm") else np.int64) for c in _STRETCH})
        at = self._codes(s.names)
        scores = self.table[at]
        best, sure, firm = self.machines.decide(self.machines.margins(s, scores))
        d = pd.DataFrame({"text": s.text, "best": best, "sure": sure, "firm": firm, "place": np.arange(len(best))})
        if whole:
            # a title needs at least one real word
            real = np.array([len(n) > 3 and n not in PLACEHOLDERS for n in s.names])
            n_real = np.add.reduceat(real[s.codes].astype(int), s.start) if len(s.start) else np.empty(0)
            d = d[n_real > 0]
        elif len(d):
            certain = d["firm"] >= LEAST_SURE
            has = certain.groupby(d["text"]).transform("any")
            by = d["best"].where(certain | ~has).groupby(d["text"])
            d["best"] = by.ffill().where(lambda x: x.notna(), by.bfill()).astype(np.int64)
        foreign = self._foreign(s, at, len(texts))
        if foreign.any():
            d.loc[foreign[d["text"].to_numpy()], ["best", "sure", "firm"]] = [len(langs) - 1, 0.5, 1.0]
            d["best"] = d["best"].astype(np.int64)
        new = (d["text"] != d["text"].shift()) | (d["best"] != d["best"].shift())
        d = d.assign(run=new.cumsum())
        out = d.groupby("run").agg(text=("text", "first"), best=("best", "first"), confidence=("sure", "mean"), firm=("firm", "mean"), n_sentences=("sure", "size")).reset_index(drop=True)
        out["segment"] = out.groupby("text").cumcount() + 1
        out["n_segments"] = out.groupby("text")["segment"].transform("max")
        out["kind"] = "segment"
        if not whole and s.rest is not None and len(s.rest.size):
            out = pd.concat([out, self._fragments(s, scores, d, out)], ignore_index=True)
        out["lang"] = langs[out["best"].to_numpy(np.int64)]
        return out[_STRETCH]

    def _fragments(self, s: Sentences, scores: np.ndarray, d: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        best, sure, _ = self.machines.decide(self.machines.margins(s.rest, scores))
        # the segment of the sentence before, else that of the one behind, else none (0)
        segment = out["segment"].to_numpy()[d["run"].to_numpy() - 1] if len(d) else np.empty(0, np.int64)
        lang, text = d["best"].to_numpy(), d["text"].to_numpy()
        near = np.clip(s.rest.before - 1, 0, max(len(d) - 1, 0)), np.clip(s.rest.before, 0, max(len(d) - 1, 0))
        home, where = np.full(len(best), -1), np.zeros(len(best), np.int64)
        for k in near if len(d) else ():
            fits = (home < 0) & (text[k] == s.rest.text)
            home, where = np.where(fits, lang[k], home), np.where(fits, segment[k], where)
        f = pd.DataFrame({"text": s.rest.text, "best": best, "sure": sure * np.minimum(s.rest.size / LEAST_WORDS, 1), "segment": where, "place": s.rest.before})[home != best]
        f["run"] = ((f["text"] != f["text"].shift()) | (f["best"] != f["best"].shift()) | (f["place"] != f["place"].shift())).cumsum()
        f = f.groupby("run").agg(text=("text", "first"), best=("best", "first"), confidence=("sure", "mean"), segment=("segment", "first")).reset_index(drop=True)
        n = out.groupby("text")["segment"].max()
        return f.assign(n_sentences=0, n_segments=f["text"].map(n).fillna(0).astype(np.int64), kind="fragment", firm=0.0)


_COLUMNS = "field string, kind string, segment bigint, lang string, confidence double, n_sentences bigint, n_segments bigint, said string"


def label_segments(df: DataFrame, key: str = "row_id", texts: tuple[str, ...] = ("description",), wholes: tuple[str, ...] = ("title",), lang: str = "lang") -> DataFrame:
    """``key, field, kind, segment, lang, confidence, n_sentences, n_segments, said``: the stretches of one language of every text, in reading order.

    ``texts`` are split into sentences, each of ``wholes`` (titles) is one; a title too short to be sure of takes the language
    its row's text begins with.  ``said`` is what the declared language means (null: none).  ``kind`` is segment, or fragment for headings, bullets and
    lists in another language than the segment they stand in (0: the text has none).
    Null, empty and blank texts, and texts without a word, have no stretch.  Repeated rows are labelled each.  Without
    any declared language to learn from, all texts are ``und``.
    """
    spark = df.sparkSession
    fields = [*texts, *wholes]
    sample = training_sample(df, key, tuple(fields), lang)
    langs = sample["lang"].tolist()
    column = lambda k: [t[k] for t in sample["texts"]]
    # running texts and titles are worded differently: machines of their own
    machines = {}
    for names, whole in ((texts, False), (wholes, True)):
        if names:
            machines[whole] = train([t for n in names for t in column(fields.index(n))], langs * len(names), whole)
    shared = spark.sparkContext.broadcast({whole: vars(m) for whole, m in machines.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = {whole: Labeller(Machines(**m)) for whole, m in shared.value.items()}
        for big in batches:
            for b in slices(big, 5000):
                keys, said, opening = b.column(0), b.column(1), {}
                for c, name in enumerate(fields, 2):
                    d = label[name in wholes](b.column(c).to_pylist(), whole=name in wholes)
                    if name not in wholes:
                        opening.update({t: x for t, x, n, p, k in zip(d["text"], d["lang"], d["segment"], d["firm"], d["kind"]) if n == 1 and k == "segment" and p >= TITLE_SURE and t not in opening})
                    elif len(d):
                        d["lang"] = [opening.get(t, x) if p < TITLE_SURE else x for t, x, p in zip(d["text"], d["lang"], d["firm"])]
                    at = pa.array(d["text"].to_numpy(np.int64))
                    whole_numbers = lambda x: pa.array(d[x].to_numpy(np.int64))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(at), pa.array([name] * len(d), pa.string()), pa.array(d["kind"].tolist(), pa.string()), whole_numbers("segment"), pa.array(d["lang"].tolist(), pa.string()),
                         pa.array(d["confidence"].to_numpy(float)), whole_numbers("n_sentences"), whole_numbers("n_segments"), said.take(at)],
                        ["key", "field", "kind", "segment", "lang", "confidence", "n_sentences", "n_segments", "said"],
                    )

    kind = df.select(key).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), declared(F.col(lang)).alias("said"), *[F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(fields)])
    return rows.mapInArrow(run, f"key {kind}, {_COLUMNS}").withColumnRenamed("key", key)


def mislabelled_segments(df: DataFrame, key: str = "row_id", texts: tuple[str, ...] = ("description",), wholes: tuple[str, ...] = ("title",), lang: str = "lang") -> DataFrame:
    """``key, field, segment, lang, confidence`` of the texts whose declared language names none or another one, or that mix languages."""
    rows = label_segments(df, key, texts, wholes, lang).where("kind = 'segment'")
    return rows.where("n_segments > 1 or said is null or said <> lang").select(key, "field", "segment", "lang", "confidence")
