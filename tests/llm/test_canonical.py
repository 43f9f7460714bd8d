import random

import pytest
from pyspark.sql import functions as F

from postquarry.llm import canonical as C

REFS = [
    (1, "title", "Data Platform Engineer", ["Ingenieur für Datenplattform"]), (2, "title", "Payments Product Manager", None), (3, "title", "Payments Planner", []),
    (10, "job_category", "People & Talent", ["Human Resources", "HR"]), (11, "job_category", "Information Security", ["Infosec"]),
]
CASES = [
    ("title", "senior DATA platform engineer (m/f/d)", 1), ("title", "Enginere - Data Platfrom", 1), ("title", "Erfahrener Ingenieur fur Datenplattform, Xubaon", 1), ("title", "#12 Dаta Platform Engr @ Blue *urgent*", 1),
    ("title", "Payments PM", 2), ("title", "Product Manager | Payments - Remote", 2), ("title", "Juninr Paymnets Planner", 3), ("title", "Wedding Planner", -1), ("title", "???", -1), ("title", "x" * 5000, -1),
    ("job_category", "H.R.", 10), ("job_category", "Poeple / Talent", 10), ("job_category", "Security, Information", 11), ("job_category", "General", -1),
]


@pytest.fixture
def refs(spark):
    return spark.createDataFrame(REFS, "ref_id bigint, field string, label string, alt_labels array<string>")


def jobs(spark, rows):
    return spark.createDataFrame([(i, v if f == "title" else None, v if f == "job_category" else None, "clash", 1) for i, (f, v) in enumerate(rows)], "row_id bigint, title string, job_category string, field string, ref_id int")


def test_cases(spark, refs):
    got = {(r.row_id, r.field): r.ref_id for r in C.canonical_matches(jobs(spark, [(f, v) for f, v, _ in CASES]), refs).collect()}
    assert got == {(i, f): want for i, (f, _, want) in enumerate(CASES)}


def test_labels_blanks_and_nulls_are_no_cases(spark, refs):
    df = jobs(spark, [("title", "Payments Planner"), ("title", " "), ("title", None), ("title", "payments planner"), ("title", "payments planner")])
    assert sorted(tuple(r) for r in C.canonical_matches(df, refs).collect()) == [(3, "title", 3), (4, "title", 3)]
    assert C.canonical_matches(df.limit(0), refs).count() == 0
    assert {r.ref_id for r in C.canonical_matches(df, refs.limit(0)).collect()} == {-1}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_join_finds_what_brute_force_finds(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 26))) for _ in range(60)]
    strings = set(words[:5])
    for w in words:
        for _ in range(4):
            s = list(w)
            for _ in range(rnd.randint(0, 5)):
                k = rnd.randrange(len(s) + 1)
                s[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "x"])
            strings.add("".join(s))
    strings.discard("")
    refs = spark.createDataFrame([(i, "f", w, None) for i, w in enumerate(words)], "ref_id bigint, field string, label string, alt_labels array<string>")
    got = {r.text: r.edits for r in C.closest_entries(spark.createDataFrame([("f", s) for s in strings], "field string, text string"), refs).collect()}
    known = {(r.text, r.ref_id) for r in C.reference_strings(refs).collect()}
    want = {}
    for s in strings:
        d = [edit_distance(s, w) for w, _ in known if edit_distance(s, w) <= C._edits(len(w), C.EDITS)]
        if d:
            want[s] = min(d)
    assert got == want


def test_levels(spark):
    df = spark.createDataFrame([(t,) for t in ("Sr. Planner", "Erfahrener Planer", "Planificador sénior", "Planner", "Seinor Planner", "Lead X", None, "")], "t string")
    assert [r[0] for r in df.select(C.level(F.col("t"))).collect()] == ["senior", "senior", "senior", "none", "senior", "lead", "none", "none"]


def test_wording_is_reference_data(spark):
    refs = spark.createDataFrame([(1, "title", "Signal Keeper", None)], "ref_id bigint, field string, label string, alt_labels array<string>")
    rows = spark.createDataFrame([(1, "Elder Sgn Kpr", ""), (2, "Signal Keeper (night)", None), (3, "Senior Signal Keeper", None)], "row_id bigint, title string, job_category string")
    of = lambda w: {r.row_id: r.ref_id for r in C.canonical_matches(rows, refs, wording=w).collect()}
    own = C.Wording(levels={"senior": "elder"}, short_forms={"signal keeper": "sgn_kpr"}, notes="night")
    assert of(own)[1] == 1 and of(own)[2] == 1 and of(C.USUAL)[1] == -1 and of(C.USUAL)[3] == 1
    assert {r.value: r.edits for r in C.nearest_labels(C.entered_values(rows), refs).collect()} == {}
