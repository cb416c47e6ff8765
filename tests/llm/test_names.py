import itertools
import random

from sheafwork.llm import names as N


def linked(spark, kind, values, batch=1):
    rows = [(batch, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame([*rows, *rows, (None, 90, values[0]), (2, 91, values[0])], "batch_id bigint, id bigint, value string")
    return {(r.left_id, r.right_id) for r in N.variant_links(df, kind).collect()}


def test_people(spark):
    same = ["Katherine N. Bellingrath", "Bellingrath, Katherine", "K. Bellingrath", "BELLINGRATH Katherine", "Dr. Kate Belingrath", "Bellingrath K. N."]
    others = ["Katherine Bollenheim", "Peter Bellingrath", "scan0001", "CV 2024", None, ""]
    assert linked(spark, "person", same + others) == set(itertools.combinations(range(6), 2))
    assert linked(spark, "person", ["Евгений Радванов", "Evgeniy Radvanov", "Женя Радванов", "Анна Радванова"]) == {(0, 1), (0, 2), (1, 2)}


def test_firms(spark):
    same = ["Upper Marvex Brewing Ltd", "UPPER MARVEX BREWING", "Brewing, Upper Marvex Ltd.", "Upper Marvx Brew. GmbH", "UMB Ltd"]
    others = ["Upper Marvex Dairy Ltd", "Lower Tarmex Brewing Ltd", "Freelance", None]
    assert linked(spark, "company", same + others) == set(itertools.combinations(range(5), 2))


def test_misspelt_trade(spark):
    values = ["Halvorn Staffing Group", "Halvorn Stafing Group", "Halvorn Stfafnig", "Halvorn Dairy", "Corvane Stafing", "Halvorn"]
    assert linked(spark, "company", values) >= {(0, 1), (0, 2)}
    assert not {p for p in linked(spark, "company", values) if p[1] > 2}


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_radius_join_loses_no_pair(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(300)})
    rows = [(1, k, rng.choice([0, 1, 1, 2])) for k in keys]
    df = spark.createDataFrame([*rows, (2, "abc", 1)], "batch_id bigint, key string, edits int")
    edits = {k: e for _, k, e in rows}
    for dense in (20, 10_000):  # by shared shorter strings, and cells joined whole
        got = {(r.left_key, r.right_key) for r in N.radius_pairs(df, ["batch_id"], per_pivot=16, dense=dense).where("batch_id = 1").collect()}
        pairs = list(itertools.combinations_with_replacement(keys, 2))
        assert {(a, b) for a, b in pairs if osa(a, b) <= min(edits[a], edits[b])} <= got <= set(pairs)


def test_one_hot_batch(spark):
    """Every string of a batch of 20,000 short ones meets those an edit apart, by pivots and shorter strings, not by all pairs."""
    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    keys = set()
    while len(keys) < 20_000:
        keys.add("".join(rng.choice(syllables) for _ in range(rng.randint(3, 4))))
    keys = sorted(keys)
    df = spark.createDataFrame([(7, k, 1) for k in keys], "batch_id bigint, key string, edits int")
    got = {(r.left_key, r.right_key) for r in N.radius_pairs(df, ["batch_id"]).collect()}
    letters = "abcdefghijklmnoprstuvwxyz"
    known = set(keys)
    for k in rng.sample(keys, 150):
        near = {k[:i] + c + k[i + 1 :] for i in range(len(k)) for c in letters} | {k[:i] + k[i + 1 :] for i in range(len(k))} | {k[:i] + c + k[i:] for i in range(len(k) + 1) for c in letters}
        near |= {k[:i] + k[i + 1] + k[i] + k[i + 2 :] for i in range(len(k) - 1)}
        assert {(min(k, o), max(k, o)) for o in near & known} <= got


def test_empty(spark):
    assert N.variant_links(spark.createDataFrame([], "batch_id bigint, id bigint, value string"), "person").collect() == []
