import os
import random

import pytest

from postquarry.llm import tokenizer as T

PATH = f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the vocabularies are not here")


@pytest.fixture(scope="module")
def known():
    import tiktoken

    ranks = T.load_ranks(PATH)
    return T.PairTable(ranks), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_and_round_trip(known):
    table, enc = known
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(a) for _ in range(n)) for a in ("ab", "etaoin shrdlu", " \n\t", "éü中🚀", "0123", "-=_*'", "it's we'll I'VE") for n in (1, 2, 3, 16, 17, 511, 512, 513, 4000)]
    texts += ["<|endoftext|>", " ", "a\u0000b", "퟿�"]
    got = T.Encoder(table)(texts).to_pylist()
    assert got == [enc.encode_ordinary(t) for t in texts] and [enc.decode(g) for g in got] == texts


def test_blocks_and_forgetting(known, monkeypatch):
    table, enc = known
    monkeypatch.setattr(T, "REMEMBERED", 5)
    e = T.Encoder(table)
    for k in range(5):
        t = [f"word{k} other{k} more{k} things{k} here{k} now{k}", None, "", "again"]
        assert e(t).to_pylist() == [enc.encode_ordinary(t[0]), [], [], enc.encode_ordinary("again")]
    pieces = [b"x" * (k % 40 + 1) for k in range(100)]
    assert [list(i) for i in T.encode_pieces(pieces, table, block=7)] == [enc.encode_ordinary(p.decode()) for p in pieces]


def test_dataframe(spark, known):
    _, enc = known
    rows = [(1, "Hello  world", 1), (2, "", 1), (3, None, 1), (None, " \n", 1), (1, "Hello  world", 1), (4, "lang" * 30000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = T.encode_corpus(df)
    assert got.columns == ["doc_id", "ids"]
    key = lambda r: (r[0] or 0, len(r[1]))
    assert sorted([(r.doc_id, r.ids) for r in got.collect()], key=key) == sorted([(i, enc.encode_ordinary(t) if t else []) for i, t, _ in rows], key=key)
    assert T.encode_corpus(df.limit(0)).count() == 0


def test_long_pieces_and_kept_pattern(known, monkeypatch):
    table, enc = known
    rnd = random.Random(4)
    for n in (513, 1001, 3000):
        for text in ("a" * n, "ab" * n, "".join(rnd.choice("abcdefgh") for _ in range(n)), "é" * n):
            ids = T._encode_wide(text.encode(), table)
            assert list(ids) == enc.encode_ordinary(text) == list(T._encode_matrix([text.encode()], table)[0])
    monkeypatch.setattr(T, "REMEMBERED", 1)
    e = T.Encoder(table, r"[a-z]+|[^a-z]+")
    assert [e([t]).to_pylist() for t in ("one two", "three four", "one two")][::2] == [e(["one two"]).to_pylist()] * 2
    assert e.pattern == r"[a-z]+|[^a-z]+"
