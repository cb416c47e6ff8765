import random

import pytest

from sheafwork.operators.intervals import merge_intervals


def brute(rows):
    out = set()
    by = {}
    for e, a, b in rows:
        if e is not None and a is not None and b is not None and a <= b:
            by.setdefault(e, []).append((a, b))
    for e, spans in by.items():
        spans.sort()
        runs = []
        for a, b in spans:
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out |= {(e, "period", a, b) for a, b in runs}
        out |= {(e, "gap", p[1] + 1, q[0] - 1) for p, q in zip(runs, runs[1:])}
    return out


@pytest.mark.parametrize("cell_bits,reach,most", [(12, 300, 40), (5, 150, 90), (8, 1 << 36, 1 << 30)])
def test_against_brute_force(spark, cell_bits, reach, most):
    rng = random.Random(cell_bits * reach)
    rows = []
    for e in range(25):
        for _ in range(rng.randint(1, 18)):
            a = rng.randint(-reach, reach)
            rows.append((e, a, a + rng.randint(-2, most)))
    rows += [(0, 5, 9)] * 30 + [(None, 1, 2), (1, None, 2), (1, 3, None)]
    df = spark.createDataFrame(rows, "who int, s bigint, t bigint").selectExpr("*", "'x' as kind", "1 as a", "2 as runs")
    got = merge_intervals(df, "who", "s", "t", cell_bits).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "who int, s int, t int")
    assert merge_intervals(df, "who", "s", "t").collect() == []
    assert merge_intervals(df, "who", "s", "t").columns == ["who", "kind", "from_at", "to_at"]
