import numpy as np

from sheafwork.llm import boosting as B
from sheafwork.llm import quality as Q


def test_labelling_functions_on_checked_texts():
    right = [Q.weak_label(t) is not None and Q.CLASSES[Q.weak_label(t)] == k for k, t in Q.HOLDOUT]
    assert sum(right) >= 0.9 * len(right)


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1).astype(int)
    model = B.Boosted(40).fit(x[:1000], y[:1000], 3)
    p = model.probabilities(x[1000:])
    assert (p.argmax(1) == y[1000:]).mean() > 0.85 and np.allclose(p.sum(1), 1)


def test_classes_and_nulls(spark):
    model = Q.train_on(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(Q.HOLDOUT * 8)], "doc_id bigint, text string"), "doc_id", "text")
    rows = [(i, t) for i, (_, t) in enumerate(Q.HOLDOUT)] + [(100, None), (101, ""), (102, " \n "), (103, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'q' as text_class", "1.0 as n_words")
    got = {r.doc_id: r for r in Q.classify(df, "doc_id", "text", model).collect()}
    assert sum(got[i].text_class == k for i, (k, _) in enumerate(Q.HOLDOUT)) >= 0.9 * len(Q.HOLDOUT)
    assert all(got[i].text_class is None and got[i].n_words == 0 for i in (100, 101, 102))
    assert got[103].text_class == "junk" and got[103].n_words == 40_000
    assert Q.classify(df.limit(0), "doc_id", "text", model).collect() == []


def test_statistics_against_python(spark):
    texts = ["Two words. And\tthree more here!\n\n- item one\n", "a|b|c\nd|e|f", "один, два, три.\nодин, два, три."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r.asDict() for r in Q.statistics(df, "doc_id", "text").orderBy("doc_id").collect()]
    for text, r in zip(texts, got):
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        n = sum(map(len, lines))
        assert r["n_chars"] == len(text) and r["n_lines"] == len(lines) and r["n_words"] == len(Q._WORD.findall(text))
        assert abs(r["terminal_line_share"] - sum(bool(Q._END.search(x)) for x in lines) / len(lines)) < 1e-9
        assert abs(r["bullet_chars"] - sum(len(x) for x in lines if Q._BULLET.match(x)) / n) < 1e-9
        assert 0 <= r["common_word_share"] <= 1
    assert got[1]["even_cell_chars"] == 1.0 and got[2]["repeated_chars"] == 0.5


def test_the_trees_do_not_see_what_labels(spark):
    assert not {"sentence_share", "entry_share", "cell_share", "odd_share"} & set(Q.STATISTICS)
