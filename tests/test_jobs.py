from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postquarry.functions import columns as X
from postquarry.functions import markup, sections
from postquarry.operators import analytics, quality, rules, tables
from postquarry.plans import dashboard
from postquarry.sources import readers, sinks
from postquarry.streaming import ingest


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("t, want", [(" No ", False), ("f", False), ("0", False), ("maybe", True), ("", True), (None, True), ("0.0", True)])
def test_as_active(spark, t, want):
    assert one(spark, X.as_active(F.col("a")), a=t) is want


@pytest.mark.parametrize("t, want", [("Data Engineer, AFT", ("Data Engineer", "AFT")), ("Full-Stack Engineer", ("Full", "Stack Engineer")), ("A, B, C", ("A", "B, C")), ("Engineer", ("Engineer", "")), (None, ("", ""))])
def test_role_and_team(spark, t, want):
    role, team = X.role_and_team(F.col("a"))
    assert (one(spark, role, a=t), one(spark, team, a=t)) == want


def test_role_by_separator(spark):
    role, team = X.role_and_team_by_separator(F.col("a"))
    for t, want in (("Full-Stack Engineer", ("Full-Stack Engineer", "")), ("A - B, C", ("A - B", "C")), ("A – B", ("A", "B"))):
        assert (one(spark, role, a=t), one(spark, team, a=t)) == want


def test_dates(spark):
    for t, want in (("Posted July 24, 2025", "2025-07-24"), ("24 Jul 2025", "2025-07-24"), ("2025-07-24", None), (None, None)):
        assert one(spark, X.parse_date(F.col("a"), X.DATES_A).cast("string"), a=t) == want
    for t, want in (("2025-07-24", "2025-07-24"), ("07/24/2025", "2025-07-24"), ("Jul 24, 2025", "2025-07-24")):
        assert one(spark, X.parse_date(F.col("a"), X.DATES_B).cast("string"), a=t) == want
    assert [one(spark, X.show_date(F.col("a")), a=t) for t in ("2025-07-04", None, "", "soon")] == ["04 Jul, 2025", "N/A", "N/A", "soon"]
    assert one(spark, X.age_hours(F.lit("2025-01-01 00:00:00"), F.lit("2025-01-01 08:30:00"))) == 8.5


def test_urls(spark):
    u = F.col("a")
    assert [one(spark, X.safe_url(u), a=t) for t in ("javascript:x", "", "https://a.b/?x=1&y=2")] == ["#", "#", "https://a.b/?x=1&amp;y=2"]
    assert one(spark, X.json_endpoint(u), a="https://h/search?x=/search?") == "https://h/search.json?x=/search?"
    assert [one(spark, X.set_param(u, "offset", F.lit("10")), a=t) for t in ("u?offset=0&l=5", "u", "u?l=1")] == ["u?offset=10&l=5", "u?offset=10", "u?l=1&offset=10"]
    assert [one(spark, X.int_param(u, "result_limit", 10), a=t) for t in ("u?a=1", "u?result_limit=25", "u?result_limit=x")] == [10, 25, 10]
    assert one(spark, X.clean_query(u, "code[]", ("country", "country[]")), a="h?b=&country=LU&code[]=X&country[]=Y&z=1&z=2#f") == "h?code[]=X&z=1&z=2#f"
    assert one(spark, X.path_id(u), a="/en/jobs/123/x") == "123" and one(spark, X.path_id(u), a="/x") is None


def test_text_helpers(spark):
    a = F.col("a")
    assert one(spark, X.escape(a, breaks=True), a='a<b\n"c"') == 'a&lt;b<br>"c"'
    assert one(spark, X.unescape(X.escape(a)), a="<a href='x'>&amp;\"") == "<a href='x'>&amp;\""
    assert one(spark, X.blocked(a), a="Please solve the CAPTCHA") and not one(spark, X.blocked(a), a=None)
    assert one(spark, X.guarded_json(F.struct(a)), a="</script>") == '{"a":"<\\/script>"}'
    assert one(spark, X.pages(F.lit(23), 10)) == 3 and one(spark, X.percent(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, X.faded(F.lit("rgba(1,2,3,0.8)"), "0.4")) == "rgba(1,2,3,0.4)"
    assert one(spark, X.collapse(a), a="  A\t b\n") == "a b" and one(spark, X.safe_id(a), a="a b/c") == "a_b_c"


def test_qualifications(spark):
    q = markup.qualifications(F.col("a"))
    assert one(spark, q, a="• Python.<br/>- SQL;<br>Python") == ["Python", "SQL"]
    assert one(spark, q, a="<ul><li>A</li><li>B</li></ul>Acme is an equal opportunities employer and\nmore") == ["A", "B"]
    assert one(spark, q, a=None) == [] and one(spark, q, a=" <br> ") == []
    assert one(spark, markup.visible_items(F.col("a")), a="&lt;li&gt;Go&lt;/li&gt;&lt;li&gt;n/a&lt;/li&gt;&lt;li&gt;https://x.y&lt;/li&gt;<p>- Rust.</p>") == ["Go", "Rust"]


def test_pages(spark):
    page = '<div data-job-id="7"><h3>A &amp; <b>B</b></h3><a href="/x">l</a></div><li class="t" data-job-id="8">just  text</li>'
    assert [tuple(t) for t in one(spark, markup.tiles(F.col("a")), a=page)] == [("7", "A & B", "/x"), ("8", "just text", None)]
    assert one(spark, markup.after_heading(F.col("a"), "BASIC QUALIFICATIONS"), a="<h2>Description</h2><p>x</p><h2 class='q'>Basic qualifications</h2>\n<p>A<br>B</p>") == "A\nB"
    assert one(spark, markup.tiles(F.col("a")), a="none") == []


def test_skills(spark):
    df = spark.createDataFrame([("c1", "A<br>B", "A"), ("c1", "A", None), (None, "B", "")], "job_category string, b string, p string")
    got = {tuple(r) for r in analytics.skill_counts(df, markup.qualifications(F.col("b")), markup.qualifications(F.col("p")), "job_category").collect()}
    assert got == {("ALL", "A", 2, 1, 3), ("ALL", "B", 2, 0, 2), ("c1", "A", 2, 1, 3), ("c1", "B", 1, 0, 1)}
    assert analytics.skill_counts(df.limit(0), markup.qualifications(F.col("b")), markup.qualifications(F.col("p"))).count() == 0


def test_upsert_and_reconcile(spark):
    old = spark.createDataFrame([("1", "old", 1), ("2", "x", 1)], "id string, v string, seq int")
    new = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("3", "y", 1)], "id string, v string, seq int")
    once = tables.upsert(old, new, "id", F.col("seq"))
    assert {(r.id, r.v) for r in once.collect()} == {("1", "b"), ("2", "x"), ("3", "y")}
    assert {(r.id, r.v) for r in tables.upsert(once, new, "id", F.col("seq")).collect()} == {("1", "b"), ("2", "x"), ("3", "y")}
    seen = spark.createDataFrame([("2",), ("3",), ("3",), (None,)], "id string")
    assert {(r.id, r.active) for r in tables.reconcile_active(once, seen, "id").collect()} == {("1", False), ("2", True), ("3", True)}
    assert tables.new_only(once, seen, "id").select("id").collect() == [("1",)]


def test_combine(spark):
    a = spark.createDataFrame([("1", "t", "", "no", "u")], "id string, title string, team string, active string, job_url string")
    b = spark.createDataFrame([("1", "s", "K", "q")], "id string, title string, category string, basic_qualifications string")
    rows = tables.combine([a, b]).orderBy("title").collect()
    assert tables.combine([a, b]).columns == tables.COMBINED
    assert (rows[1].active, rows[1].url, rows[1].team, rows[1].company) == (False, "u", None, "")
    assert (rows[0].active, rows[0].job_category, rows[0].basic_qual) == (True, "K", "q")


def test_flow_and_facets(spark):
    df = spark.createDataFrame([("k", "x", "r1", True), ("k", "x", "r2", None), ("d", "y", "x", False), ("", "z", "r", True)], "job_category string, company string, role string, active boolean").withColumn("title", F.lit("T")).withColumn("seq", F.monotonically_increasing_id())
    links = analytics.flow_links(df, ("job_category", "company", "role"))
    assert {tuple(r) for r in links.collect()} == {("k", "x", 2), ("d", "y", 1), ("x", "r1", 1), ("x", "r2", 1), ("y", "x", 1)}
    assert {(r.name, r.n) for r in analytics.flow_nodes(df, ("job_category", "company", "role")).collect()} >= {("x", 3), ("k", 2)}
    assert {(r.source, r.target) for r in analytics.flow_path(links, "x").collect()} == {("k", "x"), ("y", "x"), ("x", "r1"), ("x", "r2")}
    assert {(r.company, r.n) for r in analytics.facet_counts(df, status="active", companies=("x",)).collect()} == {("x", 2), ("z", 1)}
    assert analytics.search(df, term="%").count() == 0 and analytics.search(df, term="t", companies=("y",)).count() == 1
    assert {(r.category, r.n) for r in analytics.category_counts(df.withColumn("job_category", F.expr("nullif(job_category, '')"))).collect()} == {("k", 2), ("d", 1), ("All Categories", 4)}
    out = dashboard.as_json({k: v for k, v in dashboard.dashboard(df.withColumns({c: F.lit("") for c in ("id", "team", "basic_qual", "pref_qual", "posting_date", "url")})).items()})
    assert out["kpis"] == '[{"total":4,"active":3,"inactive":1}]'
    with pytest.raises(ValueError):
        dashboard.as_json({"x": df}, most=1)


def test_rules(spark):
    r = rules.Rules(
        titles={"ML": ["ml", "deep learning"], "DS": ["data scien"], "SW": ["engineer", "ai "]}, slugs={"SW": ["spark"], "DS": ["tableau"]}, order=("ML", "DS", "SW"),
        overrides=((r"\bsolutions? architect\b", "Solutions"), (r"\bsecurity\b", "Security")), bonuses=(("ML", "DS", 0.5),),
    )
    c = rules.classify(r, F.col("t"), slugs=F.split("s", ","), description=F.col("b"))
    cases = {("Senior Solution Architect", "", ""): "Solutions", ("Security Manager", "", ""): "Security", ("Gardener", "", ""): "Other", ("Data Engineer", "spark", ""): "SW", ("HTML Tester", "", ""): "ML", ("x", "tableau", ""): "Other", (None, None, None): "Other", ("the ai", "", ""): "SW"}
    for (t, s, b), want in cases.items():
        assert one(spark, c, t=t, s=s, b=b) == want, t


def test_rules_on_a_table(spark):
    r = rules.Rules(titles={"A": ["x"], "B": ["y", " z"]}, order=("A", "B"), bonuses=(("B", "A", 5.0),))
    df = spark.createDataFrame([("x",), ("x y",), ("y z",), (None,), ("q",)], "title string")
    assert [x.c for x in rules.classified(df, r, F.col("title"), name="c").collect()] == [x[0] for x in df.select(rules.classify(r, F.col("title"))).collect()] == ["A", "B", "B", "Other", "Other"]
    assert rules.classified(df, rules.Rules({}), F.col("title")).where("category = 'Other'").count() == 5


def parse(spark, *texts):
    rows = sections.parsed(spark.createDataFrame(list(enumerate(texts)), "i int, description string")).orderBy("i").collect()
    return [{k: r[k] for k in sections.FIELDS.values()} for r in rows]


def test_sections(spark):
    nothing = {"about": "", "responsibilities": [], "basic_qualifications": [], "preferred_qualifications": [], "benefits": []}
    headed = "<p>We are Acme.</p><h2>What you will do</h2><ul><li>- Build X</li><li>- You love Y</li></ul><p><b>Requirements:</b></p>\n- SQL\n- We offer tea\n**Perks**\n* Gym"
    carried = "Benefits:\n- a\nand more\n- b\nfoo bar:\n- c\nWe have stock\nDuties\n- Lead talks, Responding to alerts\n- Devel\nopment of code\n:\nand its\ntests"
    a, b, c, p, q, r, long = parse(spark, None, "", "Responsibilities:\n- Build X\n- Run Y", headed, "- Build pipelines\n- Strong SQL\n- Familiarity with Go\n- Health insurance\nHello there", carried, "x " * 50000)
    assert a == b == nothing and c == {**nothing, "responsibilities": ["Build X", "Run Y"]}
    assert p["about"].startswith("We are Acme.") and p["basic_qualifications"] == ["SQL", "You love Y"] and p["benefits"] == ["Gym", "We offer tea"] and p["responsibilities"] == ["Build X"]
    assert q == {"about": "Hello there", "responsibilities": ["Build pipelines"], "basic_qualifications": ["Strong SQL"], "preferred_qualifications": ["Familiarity with Go"], "benefits": ["Health insurance"]}
    assert r["benefits"] == ["a and more", "b foo bar:", "c We have stock"] or r["benefits"][0] == "a and more"
    assert "Lead talks" in r["responsibilities"] and "Responding to alerts" in r["responsibilities"] and "Development of code" in " ".join(r["responsibilities"])
    assert len(long["about"]) > 1000
    assert one(spark, sections.heading_label(F.col("t")), t="Preferred qualifications") == "basic"


def test_english(spark):
    texts = {"The team of the firm is here for you and that is all": True, "Der Hund und die Katze sind nicht das Problem": False, "": True, "12345 kubernetes": True, "the der": False, None: True}
    for t, want in texts.items():
        assert one(spark, sections.english(F.col("t")), t=t) == want, t
    assert one(spark, sections.english(F.col("t"), F.lit(0.7)), t="short") and not one(spark, sections.english(F.col("t"), F.lit(0.7)), t="long enough to be sure of it")


def test_metrics(spark):
    t = datetime(2025, 1, 10)
    runs = spark.createDataFrame([(t, 4, 10.0, True), (t, 6, 20.0, False), (t - timedelta(days=40), 1, 0.0, True)], "timestamp timestamp, total_jobs int, execution_time_seconds double, success boolean")
    s = quality.run_summary(runs, F.lit(t + timedelta(days=1))).first()
    assert (s.n_runs, s.avg_time, s.min_time, s.max_time, s.avg_jobs, s.success_rate) == (2, 15.0, 10.0, 20.0, 5.0, 0.5)
    assert quality.retain(runs, runs, F.lit(t)).count() == 4
    assert quality.with_rate(runs).where("jobs_per_second = 0").count() == 1
    h = quality.health(runs.select("success").withColumnRenamed("success", "active"), F.lit(t).cast("date"), F.lit(t), F.lit(t - timedelta(hours=9))).first()
    assert not h.healthy and h.age_hours == 9.0 and h.missing_columns == "id,title" and h.n_recent == 3


def test_sources_and_sinks(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "page_0.json").write_text('{"hits": 2, "jobs": [{"id": "u-1", "id_icims": null, "job_path": "/en/jobs/123/x", "title": "T", "team": {"label": "L"}}, {"id": "u-2", "id_icims": "9"}]}')
    got = readers.flatten_a(readers.read_pages(spark, str(pages), readers.PAGE_A), "https://h").orderBy("id").collect()
    assert [(r.id, r.team, r.job_url) for r in got] == [("123", "L", "https://h/en/jobs/123/x"), ("9", None, None)]
    b = tmp_path / "b"
    b.mkdir()
    (b / "p_1.json").write_text('{"meta": {"total": 1}, "data": [{"id": 5, "job_title": "T", "final_url": "", "source_url": "s", "technology_slugs": ["a", "b"]}]}')
    r = readers.map_b(readers.read_pages(spark, str(b), readers.PAGE_B)).first()
    assert (r.id, r.url, r.company, r.team, r.skills) == ("5", "s", "", "External", "a, b")
    csv = tmp_path / "x_jobs.csv"
    csv.write_text('id,title\n007,"two\nlines ""q"""\n,\n')
    assert [tuple(x) for x in readers.read_csv(spark, str(csv)).collect()] == [("007", 'two\nlines "q"'), (None, None)]
    assert readers.discover(spark, str(tmp_path)) == [str(csv)] == readers.discover(spark, str(tmp_path), {"x": {}, "y": {"enabled": False}, "z": {}}) == readers.discover(spark, str(tmp_path), legacy={"x": "x_jobs.csv"})
    dump = tmp_path / "headers.txt"
    dump.write_text("# c: d\nURL: https://h/x?y=1\nUser-Agent: me\nX-Other: no\n\nnothing\n")
    assert readers.read_request(spark, str(dump)) == ("https://h/x?y=1", {"user-agent": "me"})
    titles = tmp_path / "t.json"
    titles.write_text('{"a": ["x", "y"], "b": ["z"]}')
    assert sorted(x.title for x in readers.title_list(spark, str(titles)).collect()) == ["x", "y", "z"]
    path = str(tmp_path / "table")
    batch = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    assert sinks.upsert_table(batch, path) and not sinks.upsert_table(batch.limit(0), path)
    sinks.upsert_table(spark.createDataFrame([("2", "c")], "id string, v string"), path)
    assert sorted(tuple(x) for x in sinks.read_table(spark, path, "id string, v string").select("id", "v").collect()) == [("1", "a"), ("2", "c")]
    sinks.remember(batch, str(tmp_path / "seen"))
    sinks.remember(batch, str(tmp_path / "seen"))
    assert sinks.read_table(spark, str(tmp_path / "seen"), "id string").count() == 2
    assert readers.setting(readers.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}), "a.c") == 2


def test_source_side_filters(spark):
    df = spark.createDataFrame([("1", "2025-01-05", "LU", "Data Planner"), ("2", "2025-01-01", "LU", "planner"), ("3", "2025-01-05", "DE", "planner"), ("4", None, "LU", "planner"), ("5", "2025-01-06", "LU", None)], "id string, day string, country_code string, title string")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(tables.wanted(df, "day")) == list("12345")
    assert ids(tables.wanted(df, "day", since=F.lit("2025-01-02").cast("date"), countries=("LU",), titles=("Planner",))) == ["1"]
    assert ids(tables.wanted(df, "day", now=F.lit("2025-01-07"), max_age_days=2, present=("title",), known=df.where("id = '3'"))) == ["1"]
    assert [r.id for r in tables.newest(df.union(df), "day", "id", 2).collect()] == ["5", "1"]
    assert [one(spark, X.has_param(F.col("a"), "country[]", "LUX"), a=t) for t in ("u?country[]=LUX", "u?x=LUX", None)] == [True, False, False]


def test_details_and_kinds(spark, tmp_path):
    def fetch(link):
        if link == "bad":
            raise OSError
        return {"link": link, "n": len(link)} if link != "none" else None

    links = spark.createDataFrame([("ab",), ("bad",), ("none",), ("abc",), ("ab",), (None,)], "link string")
    got = sorted((r.link, r.n, r.error) for r in readers.fetch_details(links, fetch, "n int", parallel=2).collect())
    assert got == [("ab", 2, None), ("abc", 3, None), ("bad", None, "OSError: "), ("none", None, "empty")]
    with pytest.raises(ValueError):
        readers.read_source("ftp", spark, "x")
    dashboard.write_html({"a": spark.range(2)}, str(tmp_path / "a.html"))
    assert '"a": [{"id":0},{"id":1}]' in (tmp_path / "a.html").read_text()
    dashboard.write_html({"a": spark.range(2)}, str(tmp_path / "a.html"), most=1)
    assert "more than 1 rows" in (tmp_path / "a.html").read_text()


def test_tables_survive_a_writer_that_dies(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "id string, v string"
    read = lambda: sorted(tuple(r) for r in sinks.read_table(spark, path, schema).select("id", "v").collect())
    sinks.upsert_table(spark.createDataFrame([(str(k), "a") for k in range(20)], schema), path, buckets=4)
    before = read()
    commit = sinks._commit

    def dies(*args):
        raise OSError("gone")

    monkeypatch.setattr(sinks, "_commit", dies)
    for write in (lambda b: sinks.upsert_table(b, path), lambda b: sinks.overwrite(b, path)):
        with pytest.raises(OSError):
            write(spark.createDataFrame([("1", "b")], schema))
        assert read() == before
    monkeypatch.setattr(sinks, "_commit", commit)
    m = sinks._manifest(spark, path)
    sinks.upsert_table(spark.createDataFrame([("1", "b"), ("1", "c"), ("99", "n")], schema).withColumn("s", F.monotonically_increasing_id()), path, "id", F.col("s"))
    after = sinks._manifest(spark, path)
    assert read() == sorted([x for x in before if x[0] != "1"] + [("1", "c"), ("99", "n")])
    assert 1 <= sum(after["folders"][b] != f for b, f in m["folders"].items()) <= 2  # other buckets are named again, not written
    for k in range(4):
        sinks.overwrite(sinks.read_table(spark, path, schema), path, "id")
    assert len(sinks._manifests(spark, path)) == sinks.KEPT and len(read()) == 21
    (tmp_path / "t" / "_manifest-000000099.json").write_text('{"ver')  # half a manifest doesn't count
    assert len(read()) == 21
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "_manifest-000000001.json").write_text("")
    with pytest.raises(ValueError):
        sinks.read_table(spark, str(tmp_path / "u"), schema)
    assert not sinks.back_up_response(spark, "nosuch://x/y", "k", "t", {}, {}) and sinks.back_up_response(spark, str(tmp_path / "r"), "k", "t", {"a": 1}, {"b": 2}, 3)
    assert spark.read.parquet(str(tmp_path / "r")).first().request_payload == '{"a": 1}'


def test_retries_and_polls():
    waits, n = [], iter([readers.Refused(503), readers.Refused(429, 7.0), OSError("x"), None])

    def fetch():
        x = next(n)
        if x:
            raise x
        return "ok"

    assert readers.retrying(fetch, wait=waits.append)() == "ok" and waits == [0.5, 7.0, 2.0]
    with pytest.raises(readers.Refused):
        readers.retrying(lambda: (_ for _ in ()).throw(readers.Refused(404)), wait=waits.append)()
    day, rows = datetime(2025, 1, 10).date(), [{"id": k} for k in range(120)]
    page = lambda a: rows[a["page"] * a["limit"] :][: a["limit"]]
    counts = lambda narrow, wide: lambda a: narrow if a["posted_at_gte"] == "2025-01-09" else wide
    assert [len(readers.poll(counts(n, w), page, day, None, 30, page_size=20)[0]) for n, w in ((0, 0), (7, 0), (90, 0), (0, 40))] == [0, 7, 50, 10]
    assert [readers.poll(counts(n, w), page, day, None, 30)[1] for n, w in ((0, 0), (7, 0), (0, 4))] == ["none", "narrow", "wide"]

    def slow(a):
        raise TimeoutError

    assert readers.poll(slow, page, day, "2025-01-01", 30, page_size=20)[1] == "unchecked" and len(readers.poll(slow, page, day, None, 30, page_size=20)[0]) == 20
    assert ingest.look_back(None, day, 30).isoformat() == "2025-01-09" and ingest.look_back("2024-01-01", day, 30).isoformat() == "2024-12-11" and ingest.due("2025-01-09", day) and not ingest.due("2025-01-10", day)


def test_settings_and_paths():
    config = {"a": {"n": 1, "on": False, "name": "x"}, "output": {"dir": "old"}}
    got = readers.from_environment(config, {"N": "a.n", "ON": "a.on", "NAME": "a.name", "ABSENT": "a.b"}, {"N": "5", "ON": "Yes", "NAME": "y"})
    assert got["a"] == {"n": 5, "on": True, "name": "y"} and config["a"]["n"] == 1
    assert readers.setting(got, "old.n", aliases={"old.n": "a.n"}) == 5 and readers.setting(got, "old.m", 7, {"old.m": "a.m"}) == 7
    assert readers.resolved("data", "/p/config/c.yaml") == "/p/data" and readers.resolved("data", "/p/c.yaml") == "/p/data" and readers.resolved("s3a://b/x", "/p/c.yaml") == "s3a://b/x"
    assert readers.configured_path(config, "output.dir", "paths.raw", "raw", "/p/config/c") == "/p/old" and readers.configured_path({}, "output.dir", "paths.raw", "raw", "/p/config/c") == "/p/raw"


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"categories": ["Data Science", "Business Intelligence", "Project/Program/Product Management--Technical"], "tie_breakers": {"bi_over_data_science": true, "security_override": true, "ml_over_data_science": false}, "rules": {"Data Science": {"title": ["data"]}, "Business Intelligence": {"title": ["bi "]}, "Project/Program/Product Management--Technical": {"title": ["tpm"]}}}')
    r = rules.load_rules(str(path))
    assert r.bonuses == (("Business Intelligence", "Data Science", 0.5),) and len(r.overrides) == 1 and len(r.lone_bonuses) == 1
    of = lambda t: one(spark, rules.classify(r, F.col("t")), t=t)
    assert [of(t) for t in ("bi data", "data", "data tpm", "Head of Security", "securityx")] == ["Business Intelligence", "Data Science", "Project/Program/Product Management--Technical", "Security", "Other"]
    path.write_text("{")
    assert rules.load_rules(str(path), r) is r
    with pytest.raises(ValueError):
        rules.load_rules(str(path))


def test_crawl_stops_and_freshness(spark, tmp_path):
    rows = [(1, "u?c=LU&o=0", 0, ["a", "b"]), (2, "u?c=LU&o=2", 2, ["a", "c"]), (3, "u?c=LU&o=4", 4, ["a", "b"]), (4, "u?c=LU&o=6", 6, ["d"]), (5, "u?c=LU&o=8", 8, []), (6, "u?o=10", 10, ["e", "f"]), (7, "u?o=10&c=LU", 10, ["g", "h"]), (8, "u?o=10&c=LU", 12, ["i", "j"])]
    got = {r.page: r.reason for r in quality.crawl_stops(spark.createDataFrame(rows, "page int, url string, offset int, ids array<string>"), 2, needed=("c", "LU")).collect()}
    assert got == {1: None, 2: None, 3: "no new ids", 4: "short page", 5: "no tiles", 6: "filter lost", 7: "offset stuck", 8: "same address"}
    most = {r.page: r.reason for r in quality.crawl_stops(spark.createDataFrame(rows[:2], "page int, url string, offset int, ids array<string>"), 2, most_jobs=3, most_pages=1).collect()}
    assert most == {1: "most pages", 2: "most jobs"}
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert abs(quality.freshness(spark, str(tmp_path / "t"), F.current_timestamp()).first().age_hours) < 1
    assert quality.missing_modules(("json", "nosuchmodule")) == ["nosuchmodule"] and quality.missing_folders(spark, (str(tmp_path), str(tmp_path / "no"))) == [str(tmp_path / "no")]


def test_small_column_functions(spark):
    assert one(spark, X.titled(F.col("t")), t="api_feed x") == "Api_Feed X" and one(spark, X.collapse(F.col("t")), t=" A \n b ") == "a b" and one(spark, X.json_endpoint(F.col("t")), t="h/search?x=1") == "h/search.json?x=1"
    for value in ("$1", "a\\b", "10"):
        assert one(spark, X.set_param(F.col("u"), "o", F.col("v")), u="u?o=0&l=5", v=value) == f"u?o={value}&l=5"
    assert one(spark, markup.visible_items(F.col("t")), t="<li>Python</li><li>Our workforce is diverse</li>&lt;br/&gt;N/A<br>&amp;lt;br&amp;gt;Go") == ["Python", "Go"]
    assert one(spark, markup.category_link(F.col("t")), t='<a href="/x">no</a><a href="/c?category=x"><b>Data</b></a>') == "Data"
    df = spark.createDataFrame([(5, "k", "x", "r"), (3, "d", "y", "x"), (9, "", "z", "q")], "seq int, a string, b string, c string")
    assert [r.name for r in analytics.number_nodes(df, ("a", "b", "c"), "seq").orderBy("node_id").collect()] == ["d", "y", "x", "k", "r"]
    assert [r.value for r in analytics.sorted_distinct(df, "a").collect()] == ["d", "k"]


def test_process_b(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "p_1.json").write_text('{"data": [{"id": 5, "job_title": "Data T", "source_url": "s", "company_object": {"name": "C"}, "description": "Duties:\\n- Run X"}, {"id": 5, "job_title": "Data T"}]}')
    r = rules.Rules(titles={"Data": ["data"]})
    rows = readers.process_b(readers.read_pages(spark, str(tmp_path / "b"), readers.PAGE_B), str(tmp_path / "t"), rules=r)
    assert rows.columns == readers.TABLE_B and rows.count() == 2
    got = sinks.read_table(spark, str(tmp_path / "t"), "id string").collect()
    assert len(got) == 1 and got[0].job_category == "Data"
    assert rows.where("url = 's'").first().responsibilities == ["Run X"]


def test_timed(caplog):
    from postquarry.session import timed

    assert timed(lambda: 3)() == 3
    with pytest.raises(KeyError):
        timed(lambda: {}["x"])()


def test_paged_source(spark):
    def fetch(offset, limit):
        return {"hits": 23, "jobs": [{"id": k} for k in range(offset, min(23, offset + limit))]}

    spark.dataSource.register(readers.paged_source("paged_test", fetch))
    df = spark.read.format("paged_test").option("pageSize", 10).load()
    assert df.count() == 23 and df.select("page").distinct().count() == 3
    assert spark.read.format("paged_test").option("pageSize", 10).option("maxPages", 1).load().count() == 10


def test_streams(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "id string, v string, seq int"
    spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], schema).write.parquet(src)
    ingest.run_available(ingest.file_stream(spark, src, schema), ingest.reconciling(out, "id", F.col("seq")), state)
    spark.createDataFrame([("2", "c", 2), ("3", "d", 2)], schema).write.mode("append").parquet(src)
    ingest.run_available(ingest.file_stream(spark, src, schema), ingest.reconciling(out, "id", F.col("seq")), state)
    assert sorted(tuple(r) for r in sinks.read_table(spark, out, schema).select("id", "v", "active").collect()) == [("1", "a", False), ("2", "c", True), ("3", "d", True)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["a", "b", None])), max_size=12))
def test_one_row_per_id(spark, rows):
    df = spark.createDataFrame([(str(i), v, k) for k, (i, v) in enumerate(rows)], "id string, v string, seq int")
    got = {r.id: r.v for r in tables.keep_last(df, "id", F.col("seq")).collect()}
    assert got == {str(i): v for i, v in rows}
