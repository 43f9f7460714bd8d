"""Words of a text, in one dress: shared by the operators on word sequences."""

from __future__ import annotations

import html
import unicodedata

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex

_MARKUP = regex.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]{0,300}>|https?://\S+", regex.S)
# Words people put where a value is asked for and they have none.
PLACEHOLDERS = tuple(
    "asdf blank dummy empty foo missing n.a. n/a na nan nil none null placeholder qwerty tba tbc tbd temp test todo undefined unknown untitled xx xxx xxxx".split()
) + ("n a", "not available")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def slices(batch: pa.RecordBatch, rows: int = 2000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with so many rows and bytes of text at most (a longer text is a part of its own)."""
    used = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            used += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(used), 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        n = min(max(fits - at, 1), rows)
        yield batch.slice(at, n)
        at += n


def words(text: str | None) -> list[str]:
    """Lower-case words without markup, entities, accents, invisible marks and punctuation; [] for null."""
    if not text:
        return []
    if "<" in text or "http" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def word_hashes(names: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine."""
    if not len(names):
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.asarray(names, dtype=object), categorize=False)


def flat_words(texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The words of each text, the hashes of all of them in a row, and the texts' ends in that row."""
    parts = [words(t) for t in texts]
    ends = np.cumsum([len(p) for p in parts]) if parts else np.empty(0, np.int64)
    flat = [w for p in parts for w in p]
    if not flat:
        return parts, np.empty(0, np.uint64), ends
    codes, names = pd.factorize(np.array(flat, dtype=object))
    return parts, word_hashes(list(names))[codes], ends
