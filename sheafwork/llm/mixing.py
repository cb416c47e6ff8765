"""A mixture of sources with target shares of the total size in tokens.

The total is the largest for which no source needs its documents more often than it may repeat them. Each source's quota of
whole passes and of blocks of its last, partial pass is exact; which blocks go to which output shard is drawn by a
splitting tree: at each node the blocks of every source are divided between the two halves of the shards by a
multivariate hypergeometric draw, so that the shards' counts always sum to the quotas. Shards then take disjoint ranges of the
source's permuted blocks and order their documents by a keyed hash.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Blocks of a source's pass (a bound on what the driver holds of a source), and output shards.
BLOCKS, SHARDS, SEED = 2048, 16, 17
#: Documents of the last part of a source that are cut one by one in one task, and levels of parts (the last holds a source's share of one in BLOCKS to their number).
EDGE_DOCS, MOST_LEVELS = 20_000, 4


def split_counts(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """counts (by source) divided among the shards: rows are shards, and columns sum to counts.

    A node gives its left half a share of all its blocks in proportion to the half's shards, drawn without replacement.
    """
    if shards == 1:
        return counts.reshape(1, -1)
    left = shards // 2
    total = int(counts.sum())
    take = total * left // shards
    drawn = rng.multivariate_hypergeometric(counts, take) if total else counts * 0
    return np.vstack([split_counts(drawn, left, rng), split_counts(counts - drawn, shards - left, rng)])


def quotas(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int]) -> dict[str, int]:
    """Tokens of each source: shares of the largest total within the repeats; sources without tokens get 0, the others share theirs in proportion."""
    there = {s: t for s, t in targets.items() if t > 0 and sizes.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    whole = sum(there.values())
    if not there:
        return dict.fromkeys(targets, 0)
    total = min(repeats[s] * sizes[s] * whole / t for s, t in there.items())
    return {s: math.floor(total * there[s] / whole) if s in there else 0 for s in targets}


def mix(docs: DataFrame, targets: DataFrame, key: str, source: str, size: str, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(key, source, size, pass_no, shard, place): the mixed set; a row for each use of a document.

    targets: source_name, target_share, max_repeats. Rows of null or unlisted source, and of null or no size, are left out; repeated
    rows count as documents of their own. A pass over a source holds its documents in blocks drawn by a hash; the last
    pass takes whole blocks, in permuted order, while they fit, and of the next block documents while they fit.
    Empty documents or targets give an empty mixture.
    """
    goals = {r.source_name: (r.target_share, r.max_repeats) for r in targets.select("source_name", "target_share", "max_repeats").collect()}
    own = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(size).cast("bigint").alias("n")).where(F.col("s").isin(list(goals)) & (F.col("n") > 0))
    own = cut(own.withColumn("b", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(blocks)).cast("int")))
    # At most `blocks` rows of a source, however many its documents.
    stats = own.groupBy("s", "b").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()
    by: dict[str, dict[int, int]] = {}
    for r in stats:
        by.setdefault(r.s, {})[r.b] = r.n
    quota = quotas({s: sum(b.values()) for s, b in by.items()}, {s: g[0] or 0.0 for s, g in goals.items()}, {s: int(g[1] or 0) for s, g in goals.items()})
    rng = np.random.default_rng(seed)
    plan: list[tuple[str, int, int]] = []  # source, block, pass
    partial: list[tuple[str, int, int, int]] = []  # source, block, pass, tokens still free
    names = sorted(by)
    for s in names:
        left, every = quota[s], sum(by[s].values())
        order = [sorted(by[s])[i] for i in rng.permutation(len(by[s]))]
        full = left // every
        plan += [(s, b, p) for p in range(full) for b in order]
        left -= full * every
        for b in order:
            if by[s][b] <= left:
                plan.append((s, b, full))
                left -= by[s][b]
            elif left > 0:
                partial.append((s, b, full, left))
                break
    plan += [(s, b, p) for s, b, p, _ in partial]
    at = {s: [x for x in plan if x[0] == s] for s in names}
    counts = split_counts(np.array([len(at[s]) for s in names], np.int64), shards, rng) if names else np.zeros((shards, 0), np.int64)
    chosen, begin = [], dict.fromkeys(names, 0)
    for s in names:
        at[s] = [at[s][i] for i in rng.permutation(len(at[s]))]
    for shard in range(shards):
        for j, s in enumerate(names):
            chosen += [(*x, shard) for x in at[s][begin[s] : begin[s] + int(counts[shard, j])]]
            begin[s] += int(counts[shard, j])
    spark = docs.sparkSession
    uses = spark.createDataFrame(chosen, "s string, b int, pass_no int, shard int")
    shard_of = {(s, b, p): shard for s, b, p, shard in chosen}
    whole = own.join(uses, ["s", "b"])
    if partial:
        whole = whole.join(spark.createDataFrame([x[:3] for x in partial], "s string, b int, pass_no int"), ["s", "b", "pass_no"], "left_anti")
    mixed = whole.select("k", "s", "n", "pass_no", "shard")
    # Only the one block of each source at the end of its quota is cut. It is divided again by a further hash, whole parts are taken while they fit,
    # and the next part goes on, until a part is small enough to be cut by documents in one task.
    open_ends, level = [(s, b, p, room, shard_of[s, b, p]) for s, b, p, room in partial], 0
    rest = own.withColumn("path", F.col("b").cast("string"))
    open_ends = [(s, str(b), p, room, shard) for s, b, p, room, shard in open_ends]
    while open_ends:
        level += 1
        ends = spark.createDataFrame(open_ends, "s string, path string, pass_no int, room bigint, shard int")
        rest = rest.join(ends, ["s", "path"]).withColumn("part", F.pmod(F.xxhash64("k", F.lit(seed + 10 * level)), F.lit(blocks)).cast("int"))
        parts = rest.groupBy("s", "path", "pass_no", "part").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()
        taken, following = [], []
        for s, path, p, room, shard in open_ends:
            mine = {r.part: (r.n, r.docs) for r in parts if r.s == s and r.path == path and r.pass_no == p}
            for part in [sorted(mine)[i] for i in rng.permutation(len(mine))]:
                size_, docs_ = mine[part]
                if size_ <= room:
                    taken.append((s, path, p, part, None))
                    room -= size_
                    continue
                if docs_ <= EDGE_DOCS or level == MOST_LEVELS:
                    taken.append((s, path, p, part, room))
                else:
                    following.append((s, f"{path}/{part}", p, room, shard))
                break
        if taken:
            picked = rest.drop("room").join(spark.createDataFrame(taken, "s string, path string, pass_no int, part int, room bigint"), ["s", "path", "pass_no", "part"])
            fits = F.sum("n").over(Window.partitionBy("s", "path", "pass_no", "part").orderBy(F.xxhash64("k", F.lit(seed + 1)), "k").rowsBetween(Window.unboundedPreceding, 0))
            mixed = mixed.unionByName(picked.where("room is null").select("k", "s", "n", "pass_no", "shard"))
            mixed = mixed.unionByName(picked.where("room is not null").withColumn("sum", fits).where("sum <= room").select("k", "s", "n", "pass_no", "shard"))
        rest = rest.select("k", "s", "n", F.concat_ws("/", "path", "part").alias("path"))
        open_ends = following
    mixed = mixed.withColumn("place", F.xxhash64("k", "pass_no", F.lit(seed + 2)))
    # The shuffle inside each shard: its rows lie in the order of place, spread over as many tasks as they need.
    mixed = cut(mixed).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    return mixed.select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias(size), "pass_no", "shard", "place")


def shares(mixed: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """(source_name, target_share, tokens, share, uses, max_uses): what each target source reached in the mixture, also where it is nothing."""
    got = mixed.groupBy(F.col(source).alias("source_name")).agg(F.sum(size).alias("tokens"), F.count("*").alias("uses"), (F.max("pass_no") + 1).alias("max_uses"))
    listed = targets.select("source_name", "target_share").join(got, "source_name", "left")
    total = F.sum("tokens").over(Window.partitionBy())  # over the few listed sources
    joined = listed.withColumn("total", total)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("source_name", "target_share", zero("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"), zero("uses"), zero("max_uses"))
