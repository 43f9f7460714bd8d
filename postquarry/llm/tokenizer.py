"""Encoding a corpus with a public byte-level BPE vocabulary, in numpy.

Texts are split by the vocabulary's pattern; the distinct pieces of an Arrow batch are encoded at
once.  Pieces are bucketed by length into padded matrices of token ids with a parallel matrix of
pair ranks; in every round each row merges its leftmost pair of minimum rank, the row is compacted
by one column, and only the two ranks around the merge are looked up again (a vectorised
open-addressing hash table from id pairs to ranks).  Rows without a pair left leave the matrix.
A row longer than ``WIDEST`` bytes merges all places of its minimum-rank pair in one round, from the left: the pairs that a
merge makes hold a later token and so have a higher rank, so that the order is the same, and there are as many rounds as
different merges instead of as many as bytes.

Whole texts are encoded, one row in, one row out; there is no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of the longest piece of which a round merges one pair only.
WIDEST = 512
#: Pieces that a worker remembers between batches.
REMEMBERED = 400_000

_NONE = np.int32(2**30)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 and id on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the merged token, which is also its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, vals = np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int32)
        self.mask = np.int64(2 ** int(np.ceil(np.log2(len(pairs) * 6 + 8))) - 1)
        self.keys, self.vals = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, _NONE, np.int32)
        self.probes, slot = 0, self._slot(keys)
        while len(keys):
            self.probes += 1
            order = np.unique(slot, return_index=True)[1]
            free = order[self.keys[slot[order]] == -1]
            self.keys[slot[free]], self.vals[slot[free]] = keys[free], vals[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, vals, slot = keys[rest], vals[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(24)).astype(np.int64) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of any shape; ``_NONE`` where there is no merge or an id is negative (padding)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.vals[slot], _NONE)
        todo = np.nonzero((at != keys) & (at != -1))
        for _ in range(self.probes):
            if not len(todo[0]):
                break
            s = (slot[todo] + 1) & self.mask
            slot[todo] = s
            at, want = self.keys[s], keys[todo]
            hit = at == want
            out[tuple(x[hit] for x in todo)] = self.vals[s[hit]]
            go = ~hit & (at != -1)
            todo = tuple(x[go] for x in todo)
        return out


def _encode_matrix(pieces: list[bytes], table: PairTable) -> list[np.ndarray]:
    """Ids of pieces of similar length."""
    sizes = np.array([len(p) for p in pieces])
    width = int(sizes.max())
    raw = np.zeros((len(pieces), width), np.uint8)
    filled = np.arange(width) < sizes[:, None]
    raw[filled] = np.frombuffer(b"".join(pieces), np.uint8)
    ids = np.where(filled, table.byte_ids[raw], np.int32(-1))
    ranks = table(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((len(pieces), 0), np.int32)
    rows, out = np.arange(len(pieces)), [None] * len(pieces)
    while len(rows):
        if ranks.shape[1]:
            at = ranks.argmin(axis=1)
            best = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            live = best < _NONE
        else:
            live = np.zeros(len(rows), bool)
        for r, x, n in zip(rows[~live], ids[~live], sizes[~live]):
            out[r] = x[:n]
        if not live.any():
            break
        rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
        sizes = sizes[live] - 1
        width = int(sizes.max())
        every = np.arange(len(rows))
        ids[every, at] = best
        cols = np.arange(width)
        ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
        if width < 2:
            ranks = ranks[:, :0]
            continue
        cols = np.arange(width - 1)
        ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
        for side in (at - 1, at):
            ok = (side >= 0) & (side < width - 1)
            ranks[every[ok], side[ok]] = table(ids[every[ok], side[ok]], ids[every[ok], side[ok] + 1])
    return out


def _encode_wide(piece: bytes, table: PairTable) -> np.ndarray:
    """Ids of one long piece: a one-row matrix whose rounds merge every place of the minimum-rank pair."""
    ids = table.byte_ids[np.frombuffer(piece, np.uint8)]
    ranks = table(ids[:-1], ids[1:])
    while len(ranks):
        best = ranks.min()
        if best == _NONE:
            break
        at = np.flatnonzero(ranks == best)
        # neighbouring places overlap (a a a): from the left, every other one of a run counts
        run = np.cumsum(np.diff(at, prepend=-9) > 1)
        first = np.flatnonzero(np.diff(run, prepend=0))
        at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
        ids[at] = best
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids[keep]
        place = at - np.arange(len(at))  # where the merged tokens are now
        ranks = ranks[keep[1:]]
        for side in (place - 1, place):
            side = side[(side >= 0) & (side < len(ids) - 1)]
            ranks[side] = table(ids[side], ids[side + 1])
    return ids


def encode_pieces(pieces: list[bytes], table: PairTable, block: int = 8192) -> list[np.ndarray]:
    """Ids of each piece, in order."""
    out: list[np.ndarray] = [None] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] <= WIDEST]
    # buckets: equal lengths up to 16 bytes, then lengths within a sixteenth of a power of two
    step = np.maximum(1, 2 ** np.maximum(0, np.floor(np.log2(np.maximum(sizes[order], 1))).astype(int) - 4))
    bucket = -(-sizes[order] // step) * step
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for group in np.split(order, edges):
        for k in range(0, len(group), block):
            part = group[k : k + block]
            for i, ids in zip(part, _encode_matrix([pieces[i] for i in part], table)):
                out[i] = ids
    for i in np.flatnonzero(sizes > WIDEST):
        out[i] = _encode_wide(pieces[i], table)
    return out


class Encoder:
    """Encodes batches of texts; pieces met before are remembered."""

    def __init__(self, table: PairTable, pattern: str = PATTERN):
        import regex

        self.table, self.pattern, self.split = table, pattern, regex.compile(pattern).findall
        self.seen: dict[str, int] = {}
        self.start, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def __call__(self, texts: list[str | None]) -> pa.ListArray:
        parts = [self.split(t) if t else [] for t in texts]
        flat = [p for x in parts for p in x]
        counts = np.fromiter((len(x) for x in parts), np.int64, len(parts))
        codes, names = pd.factorize(np.array(flat, object)) if flat else (np.empty(0, np.int64), [])
        if len(self.seen) > REMEMBERED:
            self.__init__(self.table, self.pattern)
        new = [p for p in names if p not in self.seen]
        if new:
            ids = encode_pieces([p.encode("utf-8", "surrogatepass") for p in new], self.table)
            size = np.fromiter((len(x) for x in ids), np.int64, len(ids))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, *ids]).astype(np.int32)
            base = len(self.seen)
            self.seen.update({p: base + k for k, p in enumerate(new)})
        at = np.fromiter((self.seen[p] for p in names), np.int64, len(names))[codes]
        size, start = self.size[at], self.start[at]
        ends = np.cumsum(size)
        values = self.ids[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(values, pa.int32()))


def encode_corpus(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``key, ids``: the token ids of every row's whole text, without special tokens.

    An empty or null text has an empty list; a blank text is encoded like any other.  Rows with a null or
    repeated key keep their own row each.  An empty table gives an empty table.  The vocabulary is read once by the
    driver and sent to the executors (its size is that of the file).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(PairTable(load_ranks(vocabulary))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PairTable.__new__(PairTable)
        vars(table).update(shared.value)
        encode = Encoder(table)
        for b in batches:
            for part in slices(b, 1000):
                yield pa.RecordBatch.from_arrays([part.column(0), encode(part.column(1).to_pylist())], ["key", "ids"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
