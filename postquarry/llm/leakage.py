"""Evaluation passages inside training text: spaced-seed hashing.

A seed is a hash over some positions of a window of words; the fixed masks ignore the others, so a
seed survives a changed word there.  The masks are chosen so that any 16 consecutive words with two
changed ones, and any 15 with one, keep at least one seed whole; passages too short for the masks have
seeds of their own over their whole word sequence.  Seeds of all documents are joined
with the seeds of the test passages; around every hit the two word sequences are laid side by side
along the hit's diagonal, and a document is reported if at least ``LEAST`` consecutive words (or the
whole passage) agree but for one word in eight.

There is one way for any number of passages.  Their seeds make a bit filter of fixed size (``FILTER_BITS``), with which
the workers drop seeds that no passage can have, so that of a document only possible hits move: a hash, a key and
a place.  These are joined with the passages' seeds, a frequent seed split into parts.  Whole texts are read a second time for the documents with
hits only; a second filter of the same size keeps all others from being shuffled.  A larger set of passages makes the
filters let more through, which costs time but changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, is_small, look_up
from .words import flat_words, slices

#: Word positions that a seed looks at.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 5, 7), (0, 1, 3, 4, 5, 7))
#: Further positions for passages of so many words, which the masks are too long for or miss with their one changed word.
SHORT = {**{n: tuple(range(n)) for n in range(1, MASKS[0][-1] + 1)}, 8: (0, 2, 3, 4, 5, 6, 7)}
#: Consecutive words that make a leak, and one word in how many may differ.
LEAST, ONE_IN = 15, 8
#: Bits of a filter, a power of two: 16 MB in memory, whatever the number of passages or documents.
FILTER_BITS = 1 << 27

_ODD = (np.random.default_rng(7).integers(1, 2**62, 16).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def seeds(hashes: np.ndarray, mask_no: int, mask: tuple[int, ...] | None = None) -> np.ndarray:
    """The seed of each window of ``hashes`` under a mask, as signed 64-bit numbers."""
    mask = mask or MASKS[mask_no]
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.full(n, mask_no + 1, np.uint64)
    for k, at in enumerate(mask):
        x = (hashes[at : at + n] ^ (hashes[at : at + n] >> np.uint64(29))) * _ODD[k]
        out = (out ^ (out >> np.uint64(31))) * _ODD[15] + x
    return out.view(np.int64)


class BitFilter:
    """A set of 64-bit numbers as two bits each: what was put in is always found, other numbers seldom."""

    @staticmethod
    def slots(h: Column, bits: int) -> Column:
        return F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))

    @staticmethod
    def of(numbers: DataFrame, bits: int) -> DataFrame:
        """``w, b``: the 64-bit words of the filter that aren't zero, ``bits`` / 64 rows at most."""
        slot = numbers.select(F.explode(BitFilter.slots(F.col(numbers.columns[0]).cast("bigint"), bits)).alias("s"))
        return slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("b"))

    @staticmethod
    def array(rows: DataFrame, bits: int) -> np.ndarray:
        got = rows.toPandas()
        out = np.zeros(max(bits // 64, 1), np.uint64)
        out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
        return out

    @staticmethod
    def has(words: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether each number may be in the filter."""
        x, last = h.view(np.uint64), np.uint64(len(words) * 64 - 1)
        ok = np.ones(len(x), bool)
        for slot in (x & last, (x >> np.uint64(32)) & last):
            ok &= (words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok

    @staticmethod
    def keep(df: DataFrame, number: Column, rows: DataFrame, bits: int) -> DataFrame:
        """``df`` without rows whose number isn't in the filter; the filter's size is fixed, so it is broadcast."""
        for k in (0, 1):
            part = rows.select(F.col("w").alias("__w"), F.col("b").alias("__b"))
            df = df.withColumn("__s", BitFilter.slots(number, bits)[k]).withColumn("__w", F.shiftright("__s", 6))
            df = df.join(F.broadcast(part), "__w").where("shiftright(__b, int(__s & 63)) & 1 = 1").drop("__w", "__b", "__s")
        return df


def text_seeds(texts: list[str | None], known: np.ndarray | None, short: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The seeds of texts that may be ``known``: text, place in it, seed; and all words' hashes with the texts' ends in them.

    Masks of ``SHORT`` count for the lengths in ``short``; without it, the texts are passages, each with the one of its own length.
    """
    parts, flat, ends = flat_words(texts)
    none = np.empty(0, np.int64)
    if not len(flat):
        return none, none, none, flat, ends
    n_words = np.diff(ends, prepend=0)
    text_of, starts = np.repeat(np.arange(len(parts)), n_words), ends - n_words
    found = []
    for m, mask, length in [*((m, mask, 0) for m, mask in enumerate(MASKS)), *((len(MASKS) + n, SHORT[n], n) for n in (SHORT if short is None else short))]:
        h = seeds(flat, m, mask)
        if not len(h):
            continue
        ok = text_of[: len(h)] == text_of[mask[-1] : mask[-1] + len(h)]
        if length and short is None:
            ok &= n_words[text_of[: len(h)]] == length
        if known is not None:
            ok &= BitFilter.has(known, h)
        p = np.flatnonzero(ok)
        found.append((text_of[p], p - starts[text_of[p]], h[p]))
    if not found:
        return none, none, none, flat, ends
    t, p, h = (np.concatenate(x) for x in zip(*found))
    return t, p, h, flat, ends


def overlap(doc: np.ndarray, item: np.ndarray, diagonals: list[int], least: int = LEAST, one_in: int = ONE_IN) -> int:
    """The most consecutive words (hashes) of ``item`` that ``doc`` has along a diagonal (place in doc - place in item), one in
    ``one_in`` differing at most; 0 if fewer than ``least`` (or than the whole item)."""
    need, best = min(least, len(item)), 0
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        if hi - lo < need:
            continue
        same = doc[lo + d : hi + d] == item[lo:hi]
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - one_in))])
        # the earliest start whose score isn't above that of the end
        low = np.minimum.accumulate(score)
        first = np.searchsorted(-low, -score, side="left")
        best = max(best, int((np.arange(len(score)) - first).max()))
    return best if best >= need else 0


def passage_seeds(items: DataFrame, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``item, n_words, words, h, at``: the passages' seeds (null where a passage has no word), each with its passage's word hashes in its first row only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                t, p, h, flat, ends = text_seeds(b.column(1).to_pylist(), None)
                n = np.diff(ends, prepend=0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), lists, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], _SEED_NAMES)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(n[t], pa.int64()), pa.nulls(len(t), pa.list_(pa.int64())), pa.array(h), pa.array(p)], _SEED_NAMES)

    named = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("bigint").alias("item"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(run, "item bigint, n_words bigint, words array<bigint>, h bigint, at bigint")


_SEED_NAMES = ["item", "n_words", "words", "h", "at"]


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """``key, item_key, n_words``: every document that carries a passage, with the longest stretch it carries.

    Case, punctuation, spacing, markup, accents and up to one word in eight may differ.  Null, empty and
    blank texts carry nothing and are carried nowhere; passages shorter than the masks are
    found by their whole word sequence, at every place.  Repeated documents are reported each under their key;
    a null key can't be reported and is left out.  ``filter_bits``, a power of two, sets how many bits the filters have, not what is found.
    """
    spark = docs.sparkSession
    made = cut(passage_seeds(items, item_key, text))
    passages = made.where("words is not null").select("item", "words")
    item_seeds = made.where("h is not null").select("item", "h", "at")
    short = sorted(r["n_words"] for r in made.select("n_words").where(F.col("n_words").isin(*SHORT)).distinct().collect())
    known = spark.sparkContext.broadcast(BitFilter.array(BitFilter.of(item_seeds.select("h"), filter_bits), filter_bits))
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                t, p, h, _, _ = text_seeds(b.column(1).to_pylist(), known.value, short)
                if len(t):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(p), pa.array(h)], ["doc", "p", "h"])

    hits = look_up(named.mapInArrow(scan, "doc bigint, p bigint, h bigint"), item_seeds, ["h"])
    pairs = cut(hits.groupBy("doc", "item").agg(F.collect_set(F.col("p") - F.col("at")).alias("diagonals")))
    carriers = BitFilter.of(pairs.select(F.xxhash64("doc")).distinct(), filter_bits)
    if is_small(pairs):
        sides = named.join(F.broadcast(pairs), "doc")
    else:
        sides = BitFilter.keep(named, F.xxhash64("doc"), carriers, filter_bits).join(pairs, "doc")
    sides = look_up(sides, passages, ["item"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 500):
                texts, at = np.unique(np.array(b.column(2).to_pylist(), object), return_inverse=True)
                _, flat, ends = flat_words(list(texts))
                starts = np.concatenate([[0], ends])
                words, diagonals = b.column(3), b.column(4).to_pylist()
                n_words = [overlap(flat[starts[k] : ends[k]], words[i].values.to_numpy().view(np.uint64), diagonals[i]) for i, k in enumerate(at)]
                keep = pa.array([x > 0 for x in n_words])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int32())], ["doc", "item", "n"]).filter(keep)

    found = sides.select("doc", "item", "text", "words", "diagonals").mapInArrow(verify, "doc bigint, item bigint, n int")
    return found.groupBy(F.col("doc").alias(key), F.col("item").alias(item_key)).agg(F.max("n").alias("n_words"))
