import pandas as pd
from pyspark.sql import functions as F

from postquarry.llm import reading as R

EASY = ["You pick up a box and scan it.", "We pay you each week.", "Ask us if you do not know.", "The job is fun."]
HARD = ["Because the institutional mandate encompasses both exploratory investigation and the industrialisation of experimental prototypes, applicants should anticipate considerable ambiguity, intermittent reprioritisation and sustained interdisciplinary negotiation."]
MIDDLE = ["You should be able to explain a technical topic to customers without using difficult words in the first meeting.", "Your manager will agree on goals with you and review them twice a year together with the team."]


def test_sentences():
    words = R.Words({"en": frozenset("the we you is if do to a an and us it in".split()), "de": frozenset("die vom du wir".split())})
    got = R.sentences("How to apply\n\n• We pay you each week\n• Ask us if you do <b>not</b> know (see no. 7).\n\nSQL, Python, load tests, dashboards\nSee Abt. Nr. 7, ca. 3 km vom Tor. The job is fun!", words)
    assert [" ".join(s) for s in got] == ["we pay you each week", "ask us if you do not know see no", "see abt nr ca km vom tor", "the job is fun"]
    assert len(R.sentences("We pay you each week and You pick up a box and The job is fun.", words)) == 3
    assert len(R.sentences("Wir bauen an der Maschine und Du hilfst uns dabei und Anna hilft dir.", words)) == 2
    assert R.sentences("SQL | Python | Go | dashboards", words) == [] and R.sentences("", words) == []


def test_syllables():
    word_lists = {
        "en": "make 1 table 2 worked 1 wanted 2 organisation 5 you 1 boxes 2 science 1 reading 2 manager 3 x 1 people 3", "de": "arbeit 2 theater 3 bauen 2 familie 3 möglichkeit 3",
        "fr": "table 1 équipe 2 travaillent 2 commence 2 jour 1 responsabilité 6", "es": "trabajo 3 día 2 país 2 organización 5 ciudad 2", "xx": "palabra 3",
    }
    for lang, known in word_lists.items():
        p, xs = R.Patterns.of(lang), known.split()
        assert {w: p.count(w) for w in xs[::2]} == {w: int(n) for w, n in zip(xs[::2], xs[1::2])}, lang


def test_languages_are_learned():
    en, de = [" ".join(EASY)] * 30, ["Du nimmst die Kiste vom Regal. Wir zahlen jede Woche."] * 30
    common = R.common_words(en + de, ["en"] * 30 + ["de"] * 30)
    assert "you" in common["en"] and "die" in common["de"] and R.common_words([], []) == {}
    p = R._profile([en[0], de[0], de[0], "", None], [None, None, "EN", "en", "fr"], R.Words(common))
    assert p["lang_used"].tolist()[:2] == ["en", "de"] and p["lang_used"][2] == "en" and p["grade"].isna().tolist() == [False, False, False, True, True]
    assert set(R.common_words(en, ["en"] * 10 + [""] * 20).keys()) == {""}


def test_levels_hold_against_a_few_odd_sentences(spark):
    docs, rated = [], []
    for i in range(120):
        kind = i % 3
        body = [EASY, MIDDLE, HARD][kind] * 4
        odd = [HARD, HARD, EASY][kind][:1]
        docs.append((i, " ".join(body[:8] + odd), "en", 3))
        if i < 90:
            rated.append((i, "a", kind + 1))
            rated.append((i, "b", None if i % 7 == 0 else kind + 1 if i % 11 else 2))
    docs += [(1000, None, "en", 3), (1001, "  ", None, 3), (1002, "SQL, Python, dashboards", "en", 3), (1003, " ".join(EASY) * 3000, None, 3), (0, docs[0][1], "en", 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, reading_level int")
    labels = spark.createDataFrame(rated, "doc_id bigint, rater string, reading_level int")
    rows = R.reading_levels(df, labels).collect()
    got = {r.doc_id: r.reading_level for r in rows}
    assert len(rows) == 122 and all(got[i] == i % 3 + 1 for i in range(120)) and got[1003] == 1 and not {1000, 1001, 1002} & got.keys()
    assert R.reading_levels(df.limit(0), labels).count() == 0
    usual = {r.doc_id: r.reading_level for r in R.reading_levels(df, labels.limit(0)).collect()}
    assert usual[0] == 1 and usual[2] == 3


def test_cuts():
    x = pd.DataFrame({"lang_used": ["en"] * 60, "grade": list(range(60)), "level": [1] * 20 + [2] * 20 + [3] * 20})
    assert R.fit_cuts(x) == {"": (19.5, 39.5), "en": (19.5, 39.5)} and R.fit_cuts(x.iloc[:0]) == {}


def test_level_column(spark):
    df = spark.createDataFrame([(1.0, "en"), (5.0, "en"), (9.0, "xx")], "g double, l string")
    assert [r[0] for r in df.select(R.level_column({"en": (2.0, 4.0), "": (5.0, 7.0)}, F.col("g"), F.col("l"))).collect()] == [1, 3, 3]


def test_common_words_are_counted_in_all_documents(spark):
    # 400 documents of one language: each of four words is in 99 to 102 of them, so that only whole counts tell which are common
    has = {"alpha": range(99), "beta": range(300, 400), "gamma": range(100, 201), "delta": range(150, 252)}
    long = "filler " * 4000  # more than 20,000 characters
    docs = [(i, " ".join(["you", *(w for w, at in has.items() if i in at), long if i >= 390 else "box"]), "EN" if i % 2 else "en") for i in range(400)]
    docs += [(400 + i, "die", "de") for i in range(20)] + [(500, None, "en"), (501, " 7 ", "en"), (502, "die", None), (503, "you", "fr")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3)
    want = {"en": {"you", "box", "beta", "gamma", "delta"}, "de": {"die"}}
    assert R.learn(df, "text", "lang") == want
    assert R.common_words([t for _, t, _ in docs], [(x or "").lower() for _, _, x in docs]) == want
    unnamed = df.withColumn("lang", F.lit(None).cast("string"))
    assert R.learn(unnamed, "text", "lang") == {"": {"you", "box"}} and R.learn(df.limit(0), "text", "lang") == {}
    few = df.where("doc_id >= 410")  # no language has 20 documents: half the share of all
    assert R.learn(few, "text", "lang") == {"": {"die"}}


def test_counts_are_handed_on(spark, monkeypatch):
    docs = [(i, f"you see box {i % 7} word{chr(97 + i % 26)}", "en") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    whole = R.learn(df, "text", "lang")
    monkeypatch.setattr(R, "REMEMBERED", 2)
    assert R.learn(df, "text", "lang") == whole == {"en": {"you", "see", "box"}}


def test_an_open_tag_ends_with_its_text():
    words = R.Words({"en": frozenset("we you a".split())})
    texts = ["We pay you each week. <b unclosed <!-- open", "You see a --> and > in a text.", "The job is fun for you."]
    assert R._profile(texts, ["en"] * 3, words)["n_sentences"].tolist() == [1, 1, 1]
    assert R._profile(texts[1:2], ["en"], words)["grade"][0] == R._profile(texts, ["en"] * 3, words)["grade"][1]


def test_cuts_are_fitted_on_all_ratings(spark):
    # 30,000 ratings whose middle is rated otherwise in a few: any part of them gives other cuts
    i = pd.Series(range(30_000))
    x = pd.DataFrame({"lang_used": (i % 3).map({0: "en", 1: "de", 2: ""}), "grade": (i * 7919 % 30_011) / 64.0, "level": 0.0})
    x["level"] = (x["grade"] > 150).astype(float) + (x["grade"] > 300.015625) + 1
    x.loc[i % 10 == 0, "level"] = (i * 31 % 3 + 1).astype(float)
    x = pd.concat([x, pd.DataFrame({"lang_used": ["es"] * 39 + ["fr"] * 40, "grade": [1.0] * 39 + [2.0] * 20 + [4.0] * 20, "level": [3.0] * 39 + [1.0] * 20 + [3.0] * 20})])
    got = R.fitted_cuts(spark.createDataFrame(x).repartition(5))
    assert got == R.fit_cuts(x) and set(got) == {"", "de", "en", "fr"} and got["fr"] == (3.0, 3.0)
    assert R.fitted_cuts(spark.createDataFrame(x).limit(0)) == {}
    # the best place of all is the one that whole counts give
    for k, upper in enumerate((2, 3)):
        order = x.sort_values("grade").groupby("grade")["level"].agg(up=lambda v: (v >= upper).sum(), n="size")
        wrong = (2 * order["up"] - order["n"]).cumsum()
        assert wrong[wrong.index <= got[""][k]].iloc[-1] == min(0, wrong.min())


def test_equal_grades_are_not_parted(spark):
    # one above among equals at 2.0: a cut within them would count as right what it can't part
    x = pd.DataFrame({"lang_used": ["en"] * 9, "grade": [1.0] * 3 + [2.0] * 3 + [3.0] * 3, "level": [1.0] * 3 + [1.0, 3.0, 3.0] + [3.0] * 3})
    assert R.fit_cuts(x) == R.fit_cuts(x.iloc[::-1]) == R.fitted_cuts(spark.createDataFrame(x)) == {"": (1.5, 1.5)}
    y = pd.DataFrame({"lang_used": ["en"], "grade": [3.0], "level": [2.0]})
    assert R.fit_cuts(y)[""] == R.fitted_cuts(spark.createDataFrame(y))[""] == (2.0, 4.0)
