from sheafwork.llm import personal as P

CV = """Clara Winterholt | Phone: +44 7700 900123 | c.winterholt (at) example.org | 12 Rosten Street, 40112 Velm | Passport no. AB1234567

Summary
I planned the work for 34 people. Write to c.winterholt@example.org; in urgent cases call 555-0134-220 after six.

Experience
- Invoice 0800-4471-2230
- DIN 4471-22-1, 447 000 000
Clerk, Holm Foods Ltd, 2011-03 - 2015-07
Reported to Dr. Peter Amselfeld.

References
Please contact Maria Lindqvist, 0049 (0)30 / 23125-540"""
FINDER = P.train([(CV, False), (CV.replace("Clara Winterholt", "Jonas Berg"), False)] * 20 + [("Anna Maier", True), ("CV 2023", True), ("scan0002", True), ("Maier, Anna", True)] * 20)


def spans(text, whole=False):
    return [(k, text[a:b]) for k, a, b, _ in FINDER.spans([text], whole)[0]]


def test_all_types_and_no_others():
    got = spans(CV)
    assert ("name", "Clara Winterholt") in got and ("phone", "+44 7700 900123") in got and ("email", "c.winterholt (at) example.org") in got
    assert ("id_number", "AB1234567") in got and ("email", "c.winterholt@example.org") in got and ("phone", "555-0134-220") in got
    assert ("name", "Peter Amselfeld") in got and ("name", "Maria Lindqvist") in got and ("phone", "0049 (0)30 / 23125-540") in got
    assert [v for k, v in got if k == "address"][0].startswith("12 Rosten Street")
    assert len(got) == 10


def test_disguised_places_count_in_the_original():
    text = "​Cl​ara Wіnterholt\nPhone: +４４ 7700 900⁠123"
    got = {k: a for k, a, _, _ in FINDER.spans([text], False)[0]}
    assert got["name"] == 1 and got["phone"] == text.index("+")


def test_fields_and_nothing():
    assert spans("Dr. Anna Maier", True) == [("name", "Anna Maier")]
    assert spans("CV 2023", True) == [] and spans("", True) == [] and FINDER.spans([None, "  "], True) == [[], []]
    assert spans("x" * 50_000) == []


def test_redaction_and_find(spark):
    df = spark.createDataFrame([(1, CV), (2, None), (3, ""), (1, CV)], "id bigint, text string").selectExpr("*", "'p' as pii_type", "5 as start_at")
    out = {r.id: r.r for r in P.redact_column(df, "text", "r", FINDER).collect()}
    assert out[2] is None and out[3] == "" and "Winterholt" not in out[1] and "[PHONE]" in out[1] and "34 people" in out[1]
    found = P.find(df, "id", "text", FINDER).collect()
    assert len(found) == 20 and all(CV[r.start_at : r.end_at].strip() for r in found)
    assert P.find(df.limit(0), "id", "text", FINDER).collect() == []


def test_names_without_a_known_caption():
    names = [(f"{g} {s}", True) for g in ("Clara", "Jonas", "Rosa") for s in ("Winterholt", "Berg", "Maier", "Amsel")] * 5
    texts = [(CV + f"\n- Coached by {g} Amsel.\nClerk, Holm Foods Ltd", False) for g in ("Clara", "Jonas", "Rosa")] * 15
    finder = P.train(texts + names)
    got = lambda text: [(k, text[a:b]) for k, a, b, _ in finder.spans([text], False)[0]]
    text = CV.split("\n")[0] + "\n\nI planned the work for 34 people in Velm.\n- Checked the lists together with Rosa Lindenau.\n- Coached by Xaver Zolt.\nThen Mrs. Ida Falk of Holm Foods Ltd came."
    assert [x for x in got(text) if x[0] == "name"] == [("name", "Clara Winterholt"), ("name", "Rosa Lindenau"), ("name", "Xaver Zolt"), ("name", "Ida Falk")]
    assert ("name", "Xaver Zolt") in got(CV + "\n- Treinamento dado por Xaver Zolt.") and ("name", "Ida Falk") in got(CV + "\n- Referência: Dra. Ida Falk.")


def test_sample_takes_whole_texts(spark, tmp_path, monkeypatch):
    from sheafwork.llm import queries as Q

    text = "I planned the work. " * 300 + "Please contact Maria Lindqvist."
    spark.createDataFrame([(1, 1, text)], "extraction_id bigint, candidate_id bigint, plain_text string").write.parquet(str(tmp_path / "extractions.parquet"))
    spark.createDataFrame([(1, "Anna Maier", "a@example.org")], "candidate_id bigint, candidate_name string, email string").write.parquet(str(tmp_path / "candidates.parquet"))
    seen = []
    monkeypatch.setattr(P, "train", lambda sample: seen.extend(sample))
    Q._p5(spark, str(tmp_path))
    assert seen == [(text, False, "Anna Maier", "a@example.org"), ("Anna Maier", True, None, None), ("a@example.org", True, None, None)]


def test_a_street_after_the_name():
    got = [p for p in P.proposals("Николай Барлакеткин, Кренменская проспект, 52, 59492 Brennick") if p[0] in ("name", "address")]
    assert ("name", 0, 19, "head") in got and any(k == "address" and a == 21 for k, a, _, _ in got)


def test_names_are_proposed_anywhere():
    for text, names in (("I worked with John Smith and Maria Lopez.", {"John Smith", "Maria Lopez"}), ("Their boss was Peter Novak.", {"Peter Novak"})):
        assert names <= {text[a:b] for k, a, b, _ in P.proposals(text) if k == "name"}


def test_no_length_cuts_an_address_or_a_head():
    local = "a" * 300
    text = f"Write to {local}@{'b' * 200}.example.org now"
    assert [(k, text[a:b]) for k, a, b, _ in FINDER.spans([text], False)[0]] == [("email", f"{local}@{'b' * 200}.example.org")]
    long = "Maximilian" + "a" * 40 + " Winterholt" + "b" * 40
    assert ("name", 0, len(long), "head") in P.proposals(long + "\nPhone: +44 7700 900123")


def test_labels_come_from_the_candidates_row():
    text = "Zora Quill | +44 7700 900123\n\nSummary"
    assert P.name_label(text, 0, 10, "head", frozenset(), "Quill, Z.") == 1 and P.name_label(text, 0, 10, "head", frozenset(), "Anna Maier") == 0
    assert P.name_label(text, 0, 10, "head", frozenset(), None) is None and P.name_label(text, 0, 10, "run", frozenset({"Zora"}), None) == 1


def test_training_counts_all_rows(spark, tmp_path):
    from sheafwork.llm import queries as Q

    letters = lambda k: "".join(chr(97 + int(d)) for d in f"{k:04}")
    people = [(k, f"Q{letters(k // 3)} Berg{letters(k)}", f"x{k}@example.org") for k in range(4500)]
    texts = [(k, k, f"{n}\n\nExperience\n- Coached by {n}.\n- Saw to it that {letters(k)} held.") for k, n, _ in people[:1800]]
    spark.createDataFrame(people, "candidate_id bigint, candidate_name string, email string").write.parquet(str(tmp_path / "candidates.parquet"))
    spark.createDataFrame(texts, "extraction_id bigint, candidate_id bigint, plain_text string").write.parquet(str(tmp_path / "extractions.parquet"))
    finder, _ = Q._p5(spark, str(tmp_path))
    # Three surnames for each of 1,500 given names: any row left out loses one.
    assert len(finder.known.given) == 2 * 1500
    assert "coached by" in finder.known.captions and {"Experience", "Coached", "Saw"} <= finder.known.common


def test_spans_of_all_rows_are_counted(spark):
    columns = "v string, whole boolean, n string, e string, k int"
    rows = P.Rows(spark.createDataFrame([(CV, False, "Clara Winterholt", None, k % 30) for k in range(3000)], columns), spark.createDataFrame([("Anna Maier", True, None, None, k % 30) for k in range(3000)], columns))
    _, placed, n = P._learned_everywhere(rows, frozenset(), P.NOTHING)
    blind, shown = (sum(1 for _ in P._spans_to_learn(CV, False, "Clara Winterholt", None, k, frozenset(), P.NOTHING)) for k in (0, 1))
    assert n.sum() == 1000 * blind + 2000 * shown + 3000 and n[placed[:, -1] == 1].sum() == 0.3 * n.sum()


def test_counted_rows_train_as_repeated_ones():
    import numpy as np
    from sheafwork.llm.boosting import Boosted, weighted_edges

    x = np.array([[k % 7, (k * k) % 11 / 3] for k in range(60)], float)
    n = np.arange(60) % 5 + 1
    y = (x[:, 0] + x[:, 1] > 4).astype(int)
    many = Boosted(5).fit(np.repeat(x, n, axis=0), np.repeat(y, n), 2)
    values = [np.unique(x[:, f], return_inverse=True) for f in range(2)]
    edges = [weighted_edges(v, np.bincount(at, n).astype(int)) for v, at in values]
    assert all(np.allclose(a, b) for a, b in zip(edges, many.edges))
    few = Boosted(5).grow(many._bins(x), y, 2, many.edges, n)
    assert np.allclose(few.probabilities(x), many.probabilities(x))


def test_an_identity_card_after_the_name():
    text = "Jörg G. Ostbodossler, Reisepass Nr. C04X261R0, Telefon: (030) 23125-296"
    got = [p[:3] for p in P.proposals(text) if p[0] in ("name", "id_number")]
    assert ("name", 0, 20) in got and ("id_number", 36, 45) in got and ("name", 0, 45) not in got


def test_texts_are_searched_once_and_found_as_before(spark, tmp_path):
    from sheafwork.llm import queries as Q

    people = [(k, f"{g} {s}", None if k == 3 else f"{g}.{s}@example.org".lower()) for k, (g, s) in enumerate((g, s) for g in ("Clara", "Jonas", "Rosa", "Ted", "Olga") for s in ("Winterholt", "Berg", "Maier", "Amsel"))]
    texts = [(k, k % 25, None if k == 7 else " " if k == 8 else CV.replace("Clara Winterholt", f"Сl­ara {'é' * (k % 3)}Berg" if k % 4 == 0 else people[k % 20][1]) + f"\n- Coached by {people[k * 7 % 20][1]}.") for k in range(60)]
    spark.createDataFrame(people, "candidate_id bigint, candidate_name string, email string").write.parquet(str(tmp_path / "candidates.parquet"))
    spark.createDataFrame(texts, "extraction_id bigint, candidate_id bigint, plain_text string").write.parquet(str(tmp_path / "extractions.parquet"))
    finder, fields = Q._p5(spark, str(tmp_path))
    got = sorted(map(tuple, P.find_proposed(finder).collect()))
    assert got == sorted((field, *r) for field, key, whole, df in fields for r in P.find(df, key, field, finder, whole).collect()) and len(got) > 500
    found = Q.p5_found(spark, str(tmp_path))
    assert found.inputFiles() == [] and sorted(map(tuple, found.collect())) == [r[:4] for r in got]


def test_learning_and_finding_share_one_search(monkeypatch):
    calls = []
    search = P._announced
    monkeypatch.setattr(P, "_announced", lambda *a: calls.append(a) or search(*a))
    text = CV + "\n- Coached by Rosa Amsel.\n- Trained by Ted Berg."
    given, seen = frozenset({"Clara", "Rosa", "Ted"}), P.Known(frozenset({"Ted"}), frozenset({"coached by"}), frozenset({"Summary"}))
    known = P.Known(given, seen.captions, seen.common)
    for k in (0, 1):
        calls.clear()
        spans = [*P._judged(text, False, "Clara Winterholt", None, k, given, seen)]
        assert len(calls) == 1
        wanted = lambda use: sorted((kind, a, b, row) for row, kind, a, b, what, _ in spans if what & use)
        told = lambda words, captions: sorted((kind, a, b, P.features(text, kind, a, b, g, P._contact_block(text), words)) for kind, a, b, g in P.proposals(text, False, words, captions))
        assert wanted(P.FIND) == told(known, True) and wanted(P.LEARN) == told(seen, k == 1) and wanted(P.FIND) != wanted(P.LEARN)


def test_a_street_that_ends_like_a_given_name():
    assert [p for p in P.proposals("Wohnt Ahornring 5", known=P.Known(frozenset({"Ring"}))) if p[0] == "address"]


def test_marks_and_scripts_keep_their_places():
    assert P.plain_with_places("éa") == ("éa", [0, 2]) and P.plain_with_places("́a") == ("́a", [0, 1]) and P.plain_with_places("Ａ́b") == ("Áb", [0, 2])
    assert P.plain_with_places("x Wіnter, Зима") == ("x Winter, Зима", None)
