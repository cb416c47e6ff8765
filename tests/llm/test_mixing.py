import numpy as np

from sheafwork.llm import mixing as M


def test_tree_keeps_counts():
    rng = np.random.default_rng(1)
    counts = np.array([70, 0, 13, 900])
    parts = M.split_counts(counts, 7, rng)
    assert parts.shape == (7, 4) and (parts.sum(0) == counts).all() and parts.min() >= 0
    assert parts.sum(1).max() - parts.sum(1).min() <= 3


def test_shares_repeats_and_rest(spark):
    rng = np.random.default_rng(2)
    docs = [(i, "big", int(n)) for i, n in enumerate(rng.integers(5, 50, 3000))] + [(5000 + i, "small", int(n)) for i, n in enumerate(rng.integers(5, 50, 200))]
    docs += [(9000, "unlisted", 5), (9001, None, 5), (9002, "small", None), (9003, "small", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n bigint").selectExpr("*", "'z' as s", "0 as b")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.28, 3), ("absent", 0.02, 2)], "source_name string, target_share double, max_repeats int")
    mixed = M.mix(df, targets, "doc_id", "source", "n", blocks=64, shards=4).cache()
    rows = mixed.collect()
    assert len({(r.doc_id, r.pass_no) for r in rows}) == len(rows)
    assert {r.source for r in rows} == {"big", "small"} and max(r.pass_no for r in rows if r.source == "big") == 0 and max(r.pass_no for r in rows) <= 2
    report = {r.source_name: r for r in M.shares(mixed, targets, "source", "n").collect()}
    assert abs(report["big"].share - 0.7 / 0.98) < 0.002 and abs(report["small"].share - 0.28 / 0.98) < 0.002 and report["absent"].tokens == 0
    sizes = {"big": sum(d[2] for d in docs[:3000]), "small": sum(d[2] for d in docs[3000:3200])}
    assert sum(r.n for r in rows) >= 0.995 * min(sizes["big"] / (0.7 / 0.98), 3 * sizes["small"] / (0.28 / 0.98))
    again = M.mix(df.repartition(7), targets, "doc_id", "source", "n", blocks=64, shards=4)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, n bigint")
    targets = spark.createDataFrame([("big", 0.7, 1)], "source_name string, target_share double, max_repeats int")
    assert M.mix(df, targets, "doc_id", "source", "n").collect() == []
    assert M.mix(df, targets.limit(0), "doc_id", "source", "n").collect() == []


def test_the_edge_block_is_divided_until_it_is_small(spark, monkeypatch):
    docs = [(i, "a" if i % 3 else "b", 1 + i % 7) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source_name string, target_share double, max_repeats int")
    monkeypatch.setattr(M, "EDGE_DOCS", 1)
    rows = M.mix(df, targets, "doc_id", "source", "n", blocks=4, shards=2).collect()
    least = min(sum(n for _, s, n in docs if s == x) for x in "ab")
    for x in "ab":
        got = sum(r.n for r in rows if r.source == x)
        assert least - 7 * 4 <= got <= least
    assert len({r.doc_id for r in rows}) == len(rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.place)
    assert all(p == sorted(p) for p in by_shard.values()) and len(by_shard) == 2
