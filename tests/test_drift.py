import json
from datetime import date

from postquarry.operators import drift

SCHEMA = "record_id bigint, feed string, file_name string, exported_on date, record string, field string"


def feed(n=12):
    rows, rid = [], 0
    for day, old in ((1, True), (8, False)):
        for k in range(n):
            rid += 1
            d = {"id" if old else "jobId": str(4000 + k) if old else 4000 + k, "title": f"Title {k}", "active": k % 3 == 0, "salary": f"{50 + k},000 EUR" if old else (50 + k) * 1000}
            if old:
                d["location"] = f"City {k % 4}"
                d["perks"] = "gym; bus"
            else:
                d["place"] = {"label": f"City {k % 4}"}
                d["team"] = f"T{k}"
            if k == 3:
                d["title"] = None
            keys = list(d)[:: 1 if k % 2 else -1]
            rows.append((rid, "f", f"f_{day}.json", date(2024, 1, day), json.dumps({x: d[x] for x in keys}), "clash"))
    rows.append((98, "f", "f_8.json", date(2024, 1, 8), '{"title": "bro', None))
    rows.append((99, "f", "f_8.json", date(2024, 1, 8), None, None))
    rows.append((100, "f", "f_8.json", date(2024, 1, 8), "[1]", None))
    rows.append(rows[0])
    return rows


def test_changes(spark):
    got = {(r.file_name, r.field, r.change, r.new_field) for r in drift.schema_changes(spark.createDataFrame(feed(), SCHEMA)).collect()}
    f = "f_8.json"
    assert got == {
        (f, "id", "renamed", "jobId"), (f, "jobId", "type_changed", ""), (f, "location", "renamed", "place"), (f, "place", "type_changed", ""), (f, "salary", "type_changed", ""),
        (f, "perks", "removed", ""), (f, "team", "added", ""),
    }


def test_late_files_are_compared_by_export_date(spark):
    rows = [(k, "f", n, date(2024, 1, d), json.dumps({"a": k, **x}), None) for k, (n, d, x) in enumerate([("c", 9, {"b": 1}), ("a", 1, {}), ("b", 5, {"b": 1}), ("z", 1, {"q": 1})])]
    got = {(r.file_name, r.field, r.change) for r in drift.schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("z", "q", "added"), ("b", "q", "removed"), ("b", "b", "added")} or got == {("z", "q", "added"), ("b", "b", "added"), ("b", "q", "removed")}


def test_unified_table_and_versions(spark):
    df = spark.createDataFrame(feed(), SCHEMA)
    t = drift.unified_table(df)
    r = {x.record_id: x for x in t.collect()}
    assert len(r) == 24 and r[13]["salary"] == "50000" and r[1]["salary"] == "50,000 EUR"  # text by one line
    name = next(c for c in t.columns if c in ("location", "place"))
    assert r[1][name] == r[13][name] == "City 0"
    assert [x.version for x in drift.schema_versions(df).orderBy("exported_on").collect()] == [1, 2]
    assert {x.n_unreadable for x in drift.unreadable(df).collect()} == {3}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(df).count() == 0 and drift.unified_table(df).count() == 0 and drift.schema_versions(df).count() == 0


def test_ties_long_values_and_nulls(spark):
    rec = [{"a": 1, "b": "x" * 50000}, {"a": "1", "b": None}, {"a": None}]
    rows = [(k, "f", "one", date(2024, 1, 1), json.dumps(r), None) for k, r in enumerate(rec)] + [(9, None, "one", None, "{}", None), (10, "f", "none yet", date(2024, 1, 2), '{"only": null}', None)]
    got = {(r.file_name, r.field): r.type for r in drift.file_schemas(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("one", "a"): "number", ("one", "b"): "string", ("none yet", "only"): None}
    changes = {(r.field, r.change) for r in drift.schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert changes == {("a", "removed"), ("b", "removed"), ("only", "added")}


def test_objects_and_epochs_read_like_their_text_form(spark):
    rows, rid = [], 0
    for day, old in ((1, True), (8, False)):
        for k in range(12):
            rid += 1
            place = f"City {k}, C{k % 3}" if old else {"country": f"C{k % 3}", "city": f"City {k}"}
            posted = f"2024-01-{k + 10}" if old else 1704067200000 + (k + 9) * 86_400_000 + 3_600_000 * (k == 2)
            d = {"id": str(k), "location": place, "posted": posted, "tags": f'a "{k}"; b' if old else [f'a "{k}"', "b"], "team": f"R&D \\ {k}" if old else {"label": f"R&D \\ {k}"}}
            rows.append((rid, "f", f"f_{day}.json", date(2024, 1, day), json.dumps(d), None))
    t = {x.record_id: x for x in drift.unified_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c in ("location", "posted", "tags", "team"):
        assert [t[k][c] for k in range(1, 13)] == [t[k + 12][c] for k in range(1, 13)], c
    assert t[13]["location"] == "City 0, C0" and t[13]["posted"] == "2024-01-10" and t[13]["tags"] == 'a "0"; b'


def test_epochs_in_the_majority_leave_the_days(spark):
    rows = [(k, "f", "one", date(2024, 1, 1), json.dumps({"posted": "2024-01-01" if k < 3 else 1704067200000, "stamp": 1704067200000 + k}), None) for k in range(9)]
    got = drift.unified_table(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.posted for r in got} == {"2024-01-01"}


def test_numbers_keep_zero_one_and_epochs(spark):
    values = [(0, 0, 1704067200000, True), (1, 1, 1704067200001, 0), (7, "-2,500.5 EUR", 1704067200002, "yes"), (8, "1 000 EUR", 1704067200003, "No"), (9, 5, 1704067200004, False), (9, 5, 1704067200005, False)]
    rows = [(k, "f", "one", date(2024, 1, 1), json.dumps(dict(zip(("openings", "salary", "stamp", "active"), v))), None) for k, v in enumerate(values)]
    got = drift.unified_table(spark.createDataFrame(rows, SCHEMA)).orderBy("record_id").collect()
    assert [r.openings for r in got] == [0, 1, 7, 8, 9, 9] and [r.salary for r in got] == [0, 1, -2500.5, 1000, 5, 5]
    assert [r.stamp for r in got] == [v[2] for v in values] and [r.active for r in got] == [True, False, True, False, False, False]


def test_names_follow_the_steps_of_their_own_feed(spark):
    rows, rid = [], 0

    def add(feed, day, make):
        nonlocal rid
        for k in range(12):
            rid += 1
            rows.append((rid, feed, f"{feed}_{day}", date(2024, 1, day), json.dumps({"id": f"{feed}{k}", **make(k)}), None))

    # a: place becomes location; b: both at once, two things; c: team becomes unit, later another thing is called team
    add("a", 1, lambda k: {"place": f"A {k}"})
    add("a", 2, lambda k: {"location": f"A {k}"})
    add("b", 1, lambda k: {"place": f"Desk {k}", "location": f"B {k}"})
    add("b", 2, lambda k: {"place": f"Desk {k}"})
    add("c", 1, lambda k: {"team": f"Unit {k}"})
    add("c", 2, lambda k: {"unit": f"Unit {k}"})
    add("c", 3, lambda k: {"unit": f"Unit {k}", "team": f"Z{k * 7}"})
    t = [r.asDict() for r in drift.unified_table(spark.createDataFrame(rows, SCHEMA)).collect()]
    said = lambda feed, day: [{v for c, v in r.items() if c not in ("record_id", "feed", "file_name", "exported_on", "id") and v is not None} for r in sorted(t, key=lambda r: r["record_id"]) if r["file_name"] == f"{feed}_{day}"]
    where = lambda feed, day, prefix: {c for r in t if r["file_name"] == f"{feed}_{day}" for c, v in r.items() if c not in ("feed", "file_name", "id") and str(v).startswith(prefix)}
    assert said("b", 1) == [{f"Desk {k}", f"B {k}"} for k in range(12)] and said("c", 3) == [{f"Unit {k}", f"Z{k * 7}"} for k in range(12)]
    assert where("a", 1, "A") == where("a", 2, "A") and len(where("a", 1, "A")) == 1
    assert where("b", 1, "Desk") == where("b", 2, "Desk") and len(where("b", 1, "Desk")) == 1
    assert where("c", 1, "Unit") == where("c", 2, "Unit") == where("c", 3, "Unit") != where("c", 3, "Z")


def test_defaults_long_form_and_filled_aliases(spark):
    rows = [(k, "f", f"f_{k // 6}", date(2024, 1, 1 + k // 6), json.dumps({"id": f"x{k}", "job_url": f"https://a/{k}", "url": f"https://z/{k}", **({"remote": True} if k >= 6 else {})}), None) for k in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    t = drift.unified_table(df, defaults={"remote": False}).orderBy("record_id").collect()
    assert [r.remote for r in t] == [False] * 6 + [True] * 6
    said = [{v for c, v in r.asDict().items() if str(v).startswith("https")} for r in t]
    assert said == [{f"https://a/{k}", f"https://z/{k}"} for k in range(12)]  # both names filled: none is lost
    long = {r.record_id: r for r in drift.unified_rows(df).collect()}
    assert long[7].version == 2 and long[7].fields["remote"] == "true" and {"https://a/7", "https://z/7"} <= set(long[7].fields.values())
    steps = drift.migration_steps(df).collect()
    assert [(s.version, s.field, s.change, s.new_type) for s in steps] == [(2, "remote", "added", "boolean")]
