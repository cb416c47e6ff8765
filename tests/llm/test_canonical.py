import random

from sheafwork.llm import canonical as C

REF = [(1, "Payroll accounting", ["wage accounting"]), (2, "Quorvex", ["QVX"]), (3, "Dairy herd care", ["cow keeping"]), (4, "First aid", None), (5, "Calibration of scales", []), (9, "Tax filing", ["fiscal returns"])]


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_cases(spark):
    cases = {
        "payroll  ACCOUNTING!": 1, "acounting, payroll": 1, "good knowledge of wage accounting": 1, "qvx (3+ years)": 2, "Qourvex": 2, "beekeeping": 0, "Payroll acc.": 1, "aid first": 4, "": 0, "-": 0,
        "tax-filing": 9, "TaxFiling": 9, "Calibr. of scales": 5, "x" * 20_000: 0, "solid First aid skills": 4, "cow keepnig": 3,
    }
    ref = spark.createDataFrame(REF, "id int, name string, aliases array<string>")
    df = spark.createDataFrame([(v,) for v in [*cases, *cases, None]], "value string").selectExpr("*", "1 as id", "'k' as key")
    got = [tuple(r)[:2] for r in C.map_values(df.select("value"), ref).collect()]
    assert len(got) == len(cases) and dict(got) == cases


def test_join_loses_nothing(spark):
    rng = random.Random(4)
    words = ["calibrationofscales", "payrollaccounting", "dairyherdcare"]
    typed = set()
    while len(typed) < 300:
        w = list(rng.choice(words))
        for _ in range(2):
            i = rng.randrange(len(w) - 1)
            rng.choice([lambda: w.__setitem__(i, rng.choice("abcxyz")), lambda: w.insert(i, "e"), lambda: w.pop(i), lambda: w.__setitem__(slice(i, i + 2), w[i : i + 2][::-1])])()
        typed.add("".join(w))
    ref = spark.createDataFrame(REF, "id int, name string, aliases array<string>")
    got = {r.value: r.skill_id for r in C.map_values(spark.createDataFrame([(t,) for t in typed], "value string"), ref).collect()}
    names = {"calibrationofscales": 5, "payrollaccounting": 1, "dairyherdcare": 3}
    missed = [t for t in typed if got[t] == 0 and any(osa(t, w) <= 2 for w in names)]
    assert len(missed) <= 0.02 * len(typed)  # two swaps of one letter read as more edits


def test_cells_and_empty(spark):
    ref = spark.createDataFrame(REF, "id int, name string, aliases array<string>")
    cells = spark.createDataFrame([("f", 1, 1, "First aid"), ("f", 1, 2, "first aid"), ("f", 1, 2, "first aid"), ("f", 2, 1, None), ("f", 3, 1, "zzz")], "field string, record_id bigint, pos int, value string")
    assert sorted(map(tuple, C.map_field_values(cells, ref).collect())) == [("f", 1, 2, 4), ("f", 3, 1, 0)]
    assert C.map_field_values(cells.limit(0), ref).collect() == []


def test_word_orders_of_any_length(spark):
    ref = spark.createDataFrame([(1, "one two three four five", None), (2, "red green blue", ["seven eight nine ten eleven twelve"]), (3, "big big dog", None), (4, "red green blue", None)], "id int, name string, aliases array<string>")
    cases = {
        "two one three four five": (1, 1), "five four three two one": (1, 1), "two ome three fuor five": (1, 1), "blue red green": (2, 2), "green red blue": (2, 2), "gren red blue": (2, 2), "nine seven twelve eight eleven ten": (2, 1),
        "dog big big": (3, 1), "dog dog big": (3, 1), "cat dog big": (0, 0), "two one three four six": (0, 0), "bleu red gren": (2, 2), "": (0, 0),
    }
    got = {r.value: (r.skill_id, r.n_entries) for r in C.map_values(spark.createDataFrame([(v,) for v in cases], "value string"), ref).collect()}
    assert got == cases
