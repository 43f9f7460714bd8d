import random

import pytest
from pyspark.sql import functions as F

from postquarry.llm import linkage as K

SCHEMA = "row_id bigint, source string, title string, company string, location string, name string, job string"
ROWS = [
    (1, "A", "Senior Payments Planner", "Bapufo Labs GmbH", "Munich, DE"), (2, "B", "Sr. Planner (Payments)", "BAPUFO  Labs", "MÜNCHEN"), (3, "C", "Senior Payments Planner", "Bapfuo Labs", None),
    (4, "B", "Payments Planner", "Bapufo Labs", "Munich"), (5, "B", "Senior Payments Planner", "Bapufo Digital", "Munich"), (6, "B", "Senior Payments Planner", "Bapufo Labs", "Lisbon, PT"),
    (7, "B", "Senior Payments Planner, Xubaon", "Bapufo", "Greater Munich Area"), (8, "C", "Senior Payments Planner - Zokaion", "Bapufo Labs", "Muncih, DE"), (9, "A", "Senior Payments Planner", "Bapufo Labs", "Munich"),
    (10, "B", None, "Bapufo Labs", "Munich"), (11, "B", "Senior Payments Planner", None, "Munich"), (12, None, "Senior Payments Planner", "Bapufo Labs", "Munich"), (13, "B", "???", "Bapufo Labs", "Munich"), (14, "B", "long " * 20000, "Bapufo Labs", "Munich"), (15, "A", "", "", ""), (2, "B", "Sr. Planner (Payments)", "BAPUFO  Labs", "MÜNCHEN"),
]


@pytest.fixture
def refs(spark):
    return spark.createDataFrame([(1, "title", "Payments Planner", None), (2, "title", "Payments Engineer", ["Ingenieur für Zahlungsverkehr"])], "ref_id bigint, field string, label string, alt_labels array<string>")


def test_pairs(spark, refs):
    many, rnd = [], random.Random(9)
    for k in range(60):  # enough of everything to estimate from
        name = "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(5))
        for s in "AB":
            many.append((1000 + 2 * k + (s == "B"), s, "Payments Engineer", f"{name} Works", "Porto, PT"))
        if k < 8:
            many.append((3000 + k, "C", "Payments Engineer", f"{name} Systems", "Porto"))
    df = spark.createDataFrame([(*r, "c", "c") for r in ROWS + many], SCHEMA)
    got = K.linked_pairs(df, refs)
    pairs = {(r.row_id_1, r.row_id_2) for r in got.collect()}
    assert all(0.5 <= r.confidence <= 1 for r in got.collect())
    mine = {p for p in pairs if p[1] < 100}
    assert {(1, 2), (2, 9), (1, 3), (2, 3), (3, 9), (1, 7), (7, 9), (3, 7), (1, 8), (2, 8), (8, 9), (3, 6)} == mine, mine
    assert {p for p in pairs if p[0] >= 1000} == {(1000 + 2 * k, 1001 + 2 * k) for k in range(60)}
    assert K.linked_pairs(df.limit(0), refs).count() == 0


def test_names_and_places(spark):
    df = spark.createDataFrame([("BrobipimaWorks S.à r.l.", "Greater München Area"), ("Orvanta Inc.", "LU, Luxembourg"), ("ORVANTA", "Toronto ON, CA"), (None, None), ("", "Remote / The Hague")], "c string, l string")
    name, second = K.employer(F.col("c"))
    assert [tuple(r) for r in df.select(name, second, K.place(F.col("l"))).collect()] == [("brobipima", "works", "munchen"), ("orvanta", "", "luxembourg"), ("orvanta", "", "toronto"), (None, None, ""), ("", "", "the hague")]


def test_estimate():
    by = {0: 0.02, 2: 0.3, 4: 0.12, 5: 0.01}
    at = lambda **k: tuple(k.get(c) for c in K._FREE)
    counts = {
        ("opening", at(level=3, second=3, team=1)): 6000.0, ("opening", at(level=0, second=3, team=1)): 1400.0, ("opening", at(level=3, second=0, team=1)): 900.0, ("opening", at(level=3, second=2, team=1)): 200.0,
        ("opening", at(level=0, second=0, team=1)): 10.0, ("opening", at(level=3, second=1, team=0)): 6000.0, ("opening", at(level=3, second=1, team=3)): 900.0, ("opening", at(level=0, second=1, team=0)): 9000.0,
        ("place missing", at(second=1, team=1)): 40.0, ("place missing", at(second=3, team=1)): 400.0, ("place missing", at(second=0, team=1)): 60.0,
    }
    post = K.estimate([(*k, n) for k, n in counts.items()], by)
    linked = {k for k, p in post.items() if p >= 0.5}
    assert linked == {k for k in counts if 0 not in k[1]}  # those that differ in nothing, though nothing is ruled out by hand
    assert all(0 <= p <= 1 for p in post.values()) and max(p for k, p in post.items() if k not in linked) > 0
    assert K.estimate([], by) == {}


def test_the_posterior_decides(spark, refs, monkeypatch):
    df = spark.createDataFrame([(*r, "c", "c") for r in ROWS], SCHEMA)
    monkeypatch.setattr(K, "estimate", lambda patterns, by: {(p, q): 0.9 for p, q, _ in patterns})
    blind = {(r.row_id_1, r.row_id_2) for r in K.linked_pairs(df, refs).collect()}
    assert {(1, 4), (1, 5), (7, 8)} <= blind  # another level, another firm, another team


def test_profiles_are_split(spark, refs, monkeypatch):
    rows = [(k, "AB"[k % 2], "Payments Planner", "Bapufo", "Munich", "c", "c") for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 != b % 2)
    for most in (K.TOGETHER, 3):
        monkeypatch.setattr(K, "TOGETHER", most)
        assert sorted((r.row_id_1, r.row_id_2) for r in K.linked_pairs(df, refs).collect()) == want


def test_places_of_the_table_bear_slips(spark):
    rows = [("Ulaanbaatar, MN",)] * 30 + [("Ulaanbataar",), ("Viena",), ("Wien",), (None,), ("",)]
    got = {r.location: r.city for r in K.resolved_places(spark.createDataFrame(rows, "location string")).collect()}
    assert got == {"Ulaanbaatar, MN": "ulaanbaatar", "Ulaanbataar": "ulaanbaatar", "Viena": "vienna", "Wien": "vienna", "": ""}
