import pandas as pd

from sheafwork.llm import language as L

SAID = {
    "en": "We walked to the river because the weather was fine. Nobody knew where the old boat had been kept during the winter. They thought that it would never be found again.",
    "de": "Wir gingen zum Fluss, weil das Wetter schön war. Niemand wusste, wo das alte Boot im Winter gelegen hatte. Sie glaubten nicht, dass man es jemals wieder finden würde.",
    "fr": "Nous sommes allés à la rivière parce que le temps était beau. Personne ne savait où le vieux bateau avait passé l’hiver. Ils pensaient qu’on ne le retrouverait jamais.",
    "es": "Fuimos al río porque hacía buen tiempo. Nadie sabía dónde habían guardado el viejo barco durante el invierno. Pensaban que nunca lo volverían a encontrar por ningún lado.",
    "pt": "Fomos ao rio porque o tempo estava bom. Ninguém sabia onde tinham guardado o velho barco durante o inverno. Eles pensavam que nunca mais o iriam encontrar em lado nenhum.",
    "ru": "Мы пошли к реке, потому что погода была хорошая. Никто не знал, где зимой хранили старую лодку. Они думали, что её уже никогда и нигде не найдут.",
}
FOUND = L.train(pd.DataFrame({"text": [t for t in SAID.values()] * 3, "label": ["English", "de-AT", "FRA", "es", "pt-BR", "rus"] * 3}))


def test_labels():
    assert [L.label_code(x) for x in ("EN", "en-GB", "deu", "French", "und", "", None, "pt_BR")] == ["en", "en", "de", "fr", None, None, None, "pt"]


def test_bloom_filter_holds_what_was_put_in():
    hits, total = FOUND.counts([t.lower() for t in SAID.values()])
    assert all(hits[k].argmax() == k for k in range(6))
    assert all(hits[k, k] >= 0.99 * total[k] for k in range(6))


def test_text_paragraph_and_disguise(spark):
    disguised = SAID["es"].replace("o", "о").replace("a", "а​")
    mixed = f"Name\n\n{SAID['en']} {SAID['en']}\n\n- one\n- two\n\n{SAID['de']}"
    rows = [(1, SAID["fr"], "fr"), (2, SAID["fr"], "es"), (3, disguised, None), (4, mixed, "en"), (5, "", "en"), (6, None, "en"), (7, "12345", "en"), (8, SAID["ru"] * 400, "und")]
    df = spark.createDataFrame(rows, "id bigint, text string, label string").selectExpr("*", "'q' as lang", "0 as para_no")
    got = {(r.id, r.para_no): (r.lang, r.agrees) for r in L.languages(df, "id", "text", "label", FOUND).collect()}
    assert got[1, 0] == ("fr", True) and got[2, 0] == ("fr", False) and got[3, 0] == ("es", False) and got[8, 0] == ("ru", False)
    assert got[4, 0] == ("en", True) and got[4, 4] == ("de", False) and got[4, 2] == ("en", True)
    assert not {k for k in got if k[0] in (5, 6, 7)}


def test_no_labels_and_no_rows(spark):
    nothing = L.train(pd.DataFrame({"text": [], "label": []}))
    assert L.languages(spark.createDataFrame([], "id bigint, text string, label string"), "id", "text", "label", nothing).collect() == []


def test_sample_takes_whole_texts(spark):
    text = "We planned the work together. " * 200
    df = spark.createDataFrame([(1, text, "en")], "id bigint, t string, lang string")
    assert L.sample_rows(df, "id", "t", "lang")["text"].tolist() == [text]
