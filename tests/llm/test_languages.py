import random

import pytest
from pyspark.sql import functions as F

from postquarry.llm import languages as G

SENTENCES = {
    "en": ["We are looking for a person who will help the team.", "You write short reports for the other groups.", "Our office has space for many people.", "Please send us your letter this week."],
    "de": ["Wir suchen eine Person, die dem Team hilft.", "Sie schreiben kurze Berichte für die anderen Gruppen.", "Unser Büro bietet Platz für viele Leute.", "Bitte senden Sie uns diese Woche Ihren Brief."],
    "nl": ["Wij zoeken een persoon die het team helpt.", "Je schrijft korte verslagen voor de andere groepen.", "Ons kantoor biedt plaats aan veel mensen.", "Stuur ons deze week je brief."],
    "fr": ["Nous cherchons une personne qui aide l'équipe.", "Vous rédigez de courts rapports pour les autres groupes.", "Notre bureau accueille beaucoup de gens.", "Envoyez-nous votre lettre cette semaine."],
    "es": ["Buscamos una persona que ayude al equipo.", "Escribirás informes breves para los otros grupos.", "Nuestra oficina tiene sitio para mucha gente.", "Envíanos tu carta esta semana."],
    "it": ["Cerchiamo una persona che aiuti la squadra.", "Scriverai brevi relazioni per gli altri gruppi.", "Il nostro ufficio ha posto per molte persone.", "Inviaci la tua lettera questa settimana."],
    "pt": ["Procuramos uma pessoa que ajude a equipe.", "Você escreve relatórios curtos para os outros grupos.", "O nosso escritório tem lugar para muitas pessoas.", "Envie-nos a sua carta esta semana."],
}
TITLES = {"en": "Payments Engineer", "de": "Ingenieur für Zahlungsverkehr", "nl": "Ingenieur voor betalingen", "fr": "Ingénieur en paiements", "es": "Ingeniero de pagos", "it": "Ingegnere per pagamenti", "pt": "Engenheiro em pagamentos"}
LABELS = {"en": "en-US", "de": "German", "nl": "nld", "fr": "fr", "es": "es_ES", "it": "Italian", "pt": "pt-BR"}
SCHEMA = "row_id bigint, title string, description string, lang string, segment string, said string"


def rows(n=25, seed=1):
    rnd, out = random.Random(seed), []
    for lang, ss in SENTENCES.items():
        for k in range(n):
            out.append((len(out), TITLES[lang], " ".join(rnd.sample(ss, 3)), LABELS[lang], "c", "c"))
    return out


@pytest.fixture(scope="module")
def base():
    return rows()


def test_declared(spark):
    ls = [None, "", "und", "EN", "en-US", "English", "deu", "pt_BR", "polski", " fr "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ls], "l string").select(G.declared(F.col("l"))).collect()]
    assert got == [None, None, None, "en", "en", "en", "de", "pt", "polski", "fr"]


def test_segments_and_odd_labels(spark, base):
    mixed = " ".join(SENTENCES["de"][:2]) + "\n\n" + "<p>" + " ".join(SENTENCES["es"][:2]) + "</p> " + SENTENCES["de"][2] + "\nSQL, load tests, dashboards"
    extra = [
        (900, TITLES["fr"], " ".join(SENTENCES["fr"]), "de", "c", "c"), (901, TITLES["it"], None, None, "c", "c"), (902, "TBD", mixed, "de", "c", "c"), (903, None, "", "en", "c", "c"),
        (904, "???", " ", "en", "c", "c"), (905, None, " ".join(SENTENCES["nl"]).upper() * 200, "nl", "c", "c"), (900, TITLES["fr"], " ".join(SENTENCES["fr"]), "de", "c", "c"),
    ]
    got = sorted((r.row_id, r.field, r.segment, r.lang) for r in G.mislabelled_segments(spark.createDataFrame(base + extra, SCHEMA)).collect())
    assert got == sorted(
        [(900, "description", 1, "fr"), (900, "title", 1, "fr")] * 2 + [(901, "title", 1, "it"), (902, "description", 1, "de"), (902, "description", 2, "es"), (902, "description", 3, "de")]
    )


def test_held_out_accuracy_and_calibration_with_wrong_labels(base):
    rnd = random.Random(2)
    texts, langs = [r[2] for r in base], [next(k for k, v in LABELS.items() if v == r[3]) for r in base]
    noisy = [rnd.choice(list(LABELS)) if rnd.random() < 0.1 else x for x in langs]
    # the fourth sentence of a language is partly unseen; words and n-grams must carry over
    m = G.train(texts, noisy)
    held = [(s, lang) for lang, ss in SENTENCES.items() for s in ss]
    s = G.split_sentences([x for x, _ in held])
    best, sure, _ = m.decide(m.margins(s, G.word_scores(m.weights, s.names)))
    right = sum(m.langs[b] == held[t][1] for b, t in zip(best, s.text))
    assert right >= 0.95 * len(held) and 0 <= sure.min() and sure.max() <= 1 and set(m.langs) == set(LABELS)
    rng = random.Random(5)
    margins = [rng.gauss(0.6, 0.5) for _ in range(2000)]
    assert 2 < G._steepness(G.np.array(margins), G.np.ones(2000)) < 30 and G._steepness(G.np.array([1.0]), G.np.array([1.0])) == 4.0


def test_other_languages_families_and_none(spark, base):
    finnish = ["Etsimme henkilöä, joka auttaa tiimiä.", "Kirjoitat lyhyitä raportteja muille ryhmille.", "Toimistossamme on tilaa monelle ihmiselle.", "Lähetä meille kirjeesi tällä viikolla."]
    polish = "Szukamy osoby, która pomoże zespołowi. Piszesz krótkie sprawozdania dla innych grup. Nasze biuro ma miejsce dla wielu osób. Wyślij nam swój list w tym tygodniu."
    rnd = random.Random(3)
    more = [(500 + k, "Maksuinsinööri", " ".join(rnd.sample(finnish, 3)), "fi", "c", "c") for k in range(25)]
    extra = [(900, None, " ".join(finnish), "en", "c", "c"), (901, None, polish, None, "c", "c")]
    got = {r.row_id: r.lang for r in G.mislabelled_segments(spark.createDataFrame(base + more + extra, SCHEMA)).where("field = 'description'").collect()}
    assert got[900] == "fi" and got[901] == G.NONE and len(got) == 2
    assert G.Machines.plan(("de", "en", "fi", "fr"))[0] == ("germanic", "romance", "uralic") and G.Machines.plan(("de", "en", "fi", "fr"))[2] == [(0, 1)]


def test_fragments_are_reported(spark, base):
    text = SENTENCES["de"][0] + " " + SENTENCES["de"][1] + "\n\nWe are looking for many people\n\n" + SENTENCES["de"][2]
    df = spark.createDataFrame([*base, (900, None, text, "de", "c", "c"), (901, None, "Team\n\nBüro", "de", "c", "c")], SCHEMA)
    got = [(r.kind, r.segment, r.lang, r.n_sentences) for r in G.label_segments(df).where("row_id = 900").collect()]
    assert sorted(got) == [("fragment", 1, "en", 0), ("segment", 1, "de", 3)]
    assert {r.kind for r in G.label_segments(df).where("row_id = 901").collect()} == {"fragment"}
    assert G.mislabelled_segments(df).where("row_id >= 900").count() == 0


def test_split_sentences():
    s = G.split_sentences(["A b c. D e f!", None, "", "one two\nthree four five", "x"])
    assert list(s.text) == [0, 0, 3] and list(s.size) == [3, 3, 3]
    assert list(G.split_sentences(["Ab cd", None, "-", "Ef"], whole=True).text) == [0, 3]


def test_empty(spark, base):
    df = spark.createDataFrame(base[:30], SCHEMA)
    assert G.label_segments(df.limit(0)).count() == 0
    none = G.label_segments(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == 60 and {r.lang for r in none} == {G.NONE}
