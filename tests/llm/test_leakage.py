import random

import pyarrow as pa
import pytest

from postquarry.llm import leakage as L
from postquarry.llm.words import slices, words

RND = random.Random(11)
VOCABULARY = ["".join(RND.choice("bdfklmnprst") + RND.choice("aeiou") for _ in range(3)) for _ in range(900)]
ITEMS = {5000 + i: [RND.choice(VOCABULARY) for _ in range(RND.randint(30, 90))] for i in range(12)}


def noise(n):
    return [RND.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(k, " ".join(v), "q") for k, v in ITEMS.items()], "item_id bigint, text string, doc_id string")


def brute(text):
    ws, out = words(text), set()
    for k, item in ITEMS.items():
        for d in range(-len(item), len(ws)):
            same = [0 <= j + d < len(ws) and ws[j + d] == w for j, w in enumerate(item)]
            inside = [0 <= j + d < len(ws) for j in range(len(item))]
            for a in range(len(item)):
                bad = 0
                for b in range(a, len(item)):
                    if not inside[b]:
                        break
                    bad += not same[b]
                    if b - a + 1 >= 15 and bad * 8 <= b - a + 1:
                        out.add(k)
    return out


def test_planted_passages_against_brute_force(spark, items):
    docs = []
    for i in range(60):
        k = RND.choice(list(ITEMS))
        n = RND.choice([8, 13, 14, 15, 16, 20, 30])
        a = RND.randrange(len(ITEMS[k]) - min(n, 29))
        part = ITEMS[k][a : a + n]
        for j in RND.sample(range(len(part)), len(part) // RND.choice([8, 8, 6, 5])):
            part[j] = RND.choice(VOCABULARY)
        docs.append((i, " ".join([*noise(RND.randint(0, 60)), *part, *noise(RND.randint(0, 40))])))
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert got == {(i, k) for i, t in docs for k in brute(t)} and 10 < len(got) < 60


def test_dress_does_not_matter(spark, items):
    w = ITEMS[5003][5:25]
    docs = [(1, "<p>" + "</p>\n<b>".join(x.upper() for x in w) + "</b>"), (2, ", ".join(w)), (2, ", ".join(w)), (3, None), (4, ""), (5, " \n"), (None, " ".join(w)), (6, " ".join(noise(100000) + w + noise(1000))), (7, " ".join(w[:10] + w[:10]))]
    got = sorted((r.doc_id, r.item_id, r.n_words) for r in L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect())
    assert [g[:2] for g in got] == [(1, 5003), (2, 5003), (6, 5003)] and all(20 <= g[2] <= 24 for g in got)


def test_by_shuffle_and_empty(spark, items, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(ITEMS[5001][:20])), (2, "nothing here")], "doc_id bigint, text string")
    assert L.leaked_items(docs.limit(0), items).count() == 0 and L.leaked_items(docs, items.limit(0)).count() == 0
    monkeypatch.setattr(L, "is_small", lambda df: False)
    monkeypatch.setattr("postquarry.session.is_small", lambda df: False)
    for bits in (64, L.FILTER_BITS):  # a filter that is full lets everything through, which changes nothing
        assert [(r.doc_id, r.item_id) for r in L.leaked_items(docs, items, filter_bits=bits).collect()] == [(1, 5001)]


def test_slices():
    b = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["x" * 10, None, "", "y" * 25, "z", "z", "z"]})
    assert [s.num_rows for s in slices(b, rows=2, size=20)] == [2, 1, 1, 2, 1] and sum(s.num_rows for s in slices(b)) == 7
    assert list(slices(b.slice(0, 0))) == []


def test_words():
    assert words("A<br/>B&amp;C d’É­x http://u.v w1") == ["a", "b", "c", "d", "ex", "w1"] and words(None) == []


def test_passages_of_any_length_against_brute_force(spark):
    items = [(n, [f"w{n}x{k}" for k in range(n)]) for n in range(1, 21)]
    docs, want = [], set()
    for n, ws in items:
        for at in (0, 1, 9):
            docs.append((len(docs), [*(["before"] * at), *ws, *(["after"] * (at // 9))]))
            want.add((docs[-1][0], n))
        for k in range(n):
            docs.append((len(docs), [*ws[:k], "other", *ws[k + 1 :]]))
            if n >= 8:
                want.add((docs[-1][0], n))
            docs.append((len(docs), [*ws[:k], *ws[k + 1 :]]))  # a word left out breaks the stretch
            if max(k, n - 1 - k) >= min(15, n):
                want.add((docs[-1][0], n))
    d, i = (spark.createDataFrame([(k, " ".join(ws)) for k, ws in x], f"{name} bigint, text string") for x, name in ((docs, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()}
    assert want <= got and all(n >= 15 for _, n in got - want)
    for doc, n in got - want:  # the far side of a gap may lie on the same diagonal but for one word in eight
        assert L.overlap(L.flat_words([" ".join(docs[doc][1])])[1], L.flat_words([" ".join(items[n - 1][1])])[1], list(range(-n, n))) >= 15
