import itertools
import unicodedata

from sheafwork.llm import lookalike as L

SAME = ["Straße café fix 12", "Straße café ﬁx 12", "Ｓtraße café fix 12", "Str​aße cаfé fix 1２", "Ѕtraße café fix 12"]
OTHER = ["Strasse café fix 12", "Straße cafe fix 12", "straße café fix 12", "Straße café fix 13"]


def test_classes_are_transitive():
    found = L.classes((("a", "b"), ("b", "c"), ("x", "y"), ("c", "d")))
    assert sorted(map(tuple, found)) == [("a", "b", "c", "d"), ("x", "y")]


def test_forms_compare_equal_whatever_the_frequencies():
    for counts in ({}, {"а": 10**6, "ﬁ": 10**6}, {chr(c): 5 for c in range(32, 127)}):
        rewrite = L.Rewriter(L.representatives(counts))
        assert len({rewrite(t) for t in SAME}) == 1
        assert not {rewrite(t) for t in OTHER} & {rewrite(SAME[0])}
        assert rewrite("") == ""
        assert all(rewrite(rewrite(t)) == rewrite(t) for t in SAME + OTHER)


def test_pairs_against_brute_force(spark):
    texts = [*SAME, *OTHER, SAME[0], SAME[1], "", None, "x" * 50_000, "х" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").selectExpr("*", "'c' as raw", "1 as look")
    got = {tuple(r) for r in L.same_look_pairs(df.unionByName(df.limit(3)), "id", "text").collect()}
    counts = L.code_point_counts(df, "text")
    assert counts["х"] == 50_000
    rewrite = L.Rewriter(L.representatives(counts))
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a is not None and b is not None and a != b and rewrite(a) == rewrite(b)}
    assert got == want and len(want) > 10


def test_entries(spark):
    df = spark.createDataFrame([(1, ["Tіlbase", "Tilbase", None, "Tilbas"]), (2, None), (3, [])], "id bigint, g array<string>")
    ref = spark.createDataFrame([(7, "Tilbase")], "skill_id int, canonical string")
    assert [tuple(r) for r in L.same_look_entries(df, "id", "g", ref, "skill_id", "canonical").collect()] == [(1, 7, 1)]


def test_composition_stays_canonical():
    rewrite = L.Rewriter(L.representatives({}))
    assert all(unicodedata.is_normalized("NFC", rewrite(t)) for t in SAME)


def test_classes_count_the_pairs(spark):
    rows = [(1, "ＡＢ text"), (2, "AB text"), (3, "AB text"), (4, "other"), (5, "other"), (6, None), (7, ""), (2, "AB text")]
    df = spark.createDataFrame(rows, "extraction_id bigint, plain_text string")
    got = {r.id: (r.class_id, r.n_links) for r in L.same_look_classes(df, "extraction_id", "plain_text").collect()}
    assert {k: n for k, (_, n) in got.items()} == {1: 2, 2: 1, 3: 1} and len({c for c, _ in got.values()}) == 1
    pairs = L.same_look_pairs(df, "extraction_id", "plain_text").collect()
    assert sum(n for _, n in got.values()) == 2 * len(pairs)
