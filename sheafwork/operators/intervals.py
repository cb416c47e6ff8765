"""Union and gaps of integer intervals per entity by canonical dyadic blocks.

An interval of whole numbers is cut into its canonical dyadic blocks (block i of level l covers
[i * 2**l, (i + 1) * 2**l)). Equal blocks of an entity fall together in a map-side combined distinct, so a
hot entity costs one task no more than the blocks that one cell can hold. Within a cell of 2**cell_bits numbers, blocks
under an ancestor are dropped, sibling pairs merge upward level by level, and adjacent blocks coalesce into
runs. Cells are then stitched level by level: only the runs at a node's two ends travel up, so a
stitching group never holds more than two runs for each of its 2**cell_bits children.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "struct<lvl:int,idx:bigint>"
RUNS = "array<struct<a:bigint,b:bigint>>"


def dyadic_blocks(start: Column, stop: Column) -> Column:
    """Canonical blocks of [start, stop) as array<struct<lvl, idx>>.

    Level by level, with lo = ceil(start / 2**l) and hi = floor(stop / 2**l), the left end gives a block when
    lo is odd and the right end one when hi is odd; both shifts round towards the inside, also below zero.
    """

    def at(lvl: Column) -> Column:
        lo = -F.call_function("shiftright", -start, lvl)
        hi = F.call_function("shiftright", stop, lvl)
        lo_in = lo + lo.bitwiseAND(F.lit(1).cast("bigint"))
        odd_lo, odd_hi = lo_in != lo, hi.bitwiseAND(F.lit(1).cast("bigint")) == 1
        block = lambda i: F.struct(lvl.cast("int").alias("lvl"), i.alias("idx"))
        return F.array_compact(F.array(F.when(odd_lo & (lo < hi), block(lo)), F.when(odd_hi & (hi - 1 >= lo_in), block(hi - 1))))

    width = F.length(F.bin(stop - start))
    return F.flatten(F.transform(F.sequence(F.lit(0), width), at))


def _start(b: Column) -> Column:
    return b.getField("idx") * F.call_function("shiftleft", F.lit(1).cast("bigint"), b.getField("lvl"))


def _stop(b: Column) -> Column:
    return (b.getField("idx") + 1) * F.call_function("shiftleft", F.lit(1).cast("bigint"), b.getField("lvl"))


def _drop_covered(blocks: Column) -> Column:
    """Blocks without those under an ancestor in the same array; the result is disjoint and ascending."""
    keyed = F.array_sort(F.transform(blocks, lambda b: F.struct(_start(b).alias("s"), (-b.getField("lvl")).alias("n"), b.getField("idx").alias("idx"))))
    zero = F.struct(F.lit(None).cast("bigint").alias("top"), F.array().cast(f"array<{BLOCK}>").alias("kept"))

    def step(acc: Column, k: Column) -> Column:
        lvl = -k.getField("n")
        block = F.struct(lvl.alias("lvl"), k.getField("idx").alias("idx"))
        free = acc.getField("top").isNull() | (k.getField("s") >= acc.getField("top"))
        return F.when(free, F.struct(_stop(block).alias("top"), F.array_append(acc.getField("kept"), block).alias("kept"))).otherwise(acc)

    return F.aggregate(keyed, zero, step, lambda acc: acc.getField("kept"))


def _merge_siblings(blocks: Column, levels: int) -> Column:
    """Replace sibling pairs by their parent, from level 0 up; blocks must be disjoint and ascending."""

    def one(acc: Column, lvl: Column) -> Column:
        def pick(b: Column, i: Column) -> Column:
            after, before = F.get(acc, i + 1), F.get(acc, i - 1)
            even = b.getField("idx").bitwiseAND(F.lit(1).cast("bigint")) == 0
            twin = lambda o, d: (o.getField("lvl") == lvl) & (o.getField("idx") == b.getField("idx") + d)
            here = b.getField("lvl") == lvl
            parent = F.struct((lvl + 1).cast("int").alias("lvl"), F.call_function("shiftright", b.getField("idx"), F.lit(1)).alias("idx"))
            return (
                F.when(here & even & F.coalesce(twin(after, 1), F.lit(False)), parent)
                .when(here & ~even & F.coalesce(twin(before, -1), F.lit(False)), F.lit(None))
                .otherwise(b)
            )

        return F.array_compact(F.transform(acc, pick))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), blocks, one)


def _coalesce_adjacent(blocks: Column) -> Column:
    """Runs (a, b), both ends included, of disjoint ascending blocks."""

    def step(acc: Column, b: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        run = F.struct(_start(b).alias("a"), (_stop(b) - 1).alias("b"))
        joined = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last.getField("a").alias("a"), (_stop(b) - 1).alias("b")))
        return F.when((F.size(acc) > 0) & (last.getField("b") + 1 == _start(b)), joined).otherwise(F.array_append(acc, run))

    return F.aggregate(blocks, F.array().cast(RUNS), step)


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, cell_bits: int = 12) -> DataFrame:
    """Continuous periods and the gaps between them: (entity, kind 'period' | 'gap', from_at, to_at), ends included.

    Intervals that share a number or follow each other directly form one period. Rows with a null entity, a null
    end or end < start are left out; an empty input gives an empty result; repeated rows change nothing;
    other columns are ignored. Numbers may lie anywhere in 62 bits. cell_bits bounds what one task
    holds of one entity (at most 2**(cell_bits + 1) blocks).
    """
    spans = df.select(F.col(entity).alias("e"), F.col(start).cast("bigint").alias("a"), (F.col(end).cast("bigint") + 1).alias("z")).where("e is not null and a < z")
    size = 1 << cell_bits
    seen = spans.agg(F.min("a").alias("lo"), F.max("z").alias("hi"), F.max(F.expr("z - a")).alias("most")).first()
    name = lambda d: d.select(F.col("e").alias(entity), "kind", F.col("a").alias("from_at"), F.col("b").alias("to_at"))
    if seen.lo is None:
        return name(spans.select("e", F.lit("period").alias("kind"), "a", F.col("z").alias("b")))

    blocks = spans.select("e", F.explode(dyadic_blocks(F.col("a"), F.col("z"))).alias("k"))
    cell = F.call_function("shiftright", F.col("k.idx"), F.lit(cell_bits) - F.col("k.lvl"))
    cells = blocks.where(F.col("k.lvl") <= cell_bits).groupBy("e", cell.alias("c")).agg(F.collect_set("k").alias("ks"))
    merged = _coalesce_adjacent(_merge_siblings(_drop_covered(F.col("ks")), cell_bits))
    cells = cells.select("e", "c", F.explode(F.array(merged)).alias("runs"))  # explode: computed once, no filter is pushed below
    high = None
    if seen.most >= 2 * size:  # only then can a block be larger than a cell
        high = blocks.where(F.col("k.lvl") > cell_bits).select("e", "k.lvl", "k.idx").distinct()
        top = max(seen.most.bit_length(), cell_bits + 1)
        above = lambda lvl, idx: F.explode(
            F.transform(F.sequence(lvl + 1, F.lit(top)), lambda u: F.struct(u.alias("lvl"), F.call_function("shiftright", idx, u - lvl).alias("idx")))
        )
        key = ["e", "lvl", "idx"]

        def uncovered(d: DataFrame, ids: list[str], lvl: Column, idx: Column) -> DataFrame:
            up = d.where(lvl < top).select(*[F.col(i).alias(f"d_{i}") for i in ids], above(lvl, idx).alias("u"))
            up = up.select(*[f"d_{i}" for i in ids], F.col("u.lvl").alias("ul"), F.col("u.idx").alias("ui"))
            h = high.select(F.col("e").alias("he"), F.col("lvl").alias("hl"), F.col("idx").alias("hi"))
            bad = up.join(h, (up.d_e == h.he) & (up.ul == h.hl) & (up.ui == h.hi), "left_semi").select(*[F.col(f"d_{i}").alias(i) for i in ids]).distinct()
            return d.join(bad, ids, "left_anti")

        cells = uncovered(cells, ["e", "c"], F.lit(cell_bits), F.col("c"))
        whole = uncovered(high, key, F.col("lvl"), F.col("idx"))
        size_of = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("lvl"))
        whole = whole.select("e", F.expr("cast(null as bigint)").alias("c"), F.array(F.struct((F.col("idx") * size_of).alias("a"), ((F.col("idx") + 1) * size_of - 1).alias("b"))).alias("runs"))
        cells = cells.unionByName(whole)

    # A run that ends inside a cell is final: only the first and the last run of a cell go on.
    n = F.size("runs")
    gaps = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.lit("gap").alias("kind"), (F.get("runs", i).getField("b") + 1).alias("a"), (F.get("runs", i + 1).getField("a") - 1).alias("b")))
    inner = F.transform(F.slice("runs", F.lit(2), F.greatest(n - 2, F.lit(0))), lambda r: F.struct(F.lit("period").alias("kind"), r.getField("a").alias("a"), r.getField("b").alias("b")))
    edge = lambda i, linked: F.struct(F.get("runs", i).getField("a").alias("a"), F.get("runs", i).getField("b").alias("b"), F.lit(linked).alias("linked"))
    out = [cells.where(n >= 2).select("e", F.explode(F.concat(gaps, inner)).alias("x")).select("e", "x.kind", "x.a", "x.b")]
    runs = cells.select("e", F.explode(F.when(n == 1, F.array(edge(F.lit(0), False))).otherwise(F.array(edge(F.lit(0), False), edge(n - 1, True)))).alias("x")).select("e", "x.a", "x.b", "x.linked")

    # linked: what lies between this run and the one before it has been given out already.
    bits = cell_bits
    while True:
        bits += cell_bits
        last_phase = bits >= 62 or (seen.lo >> bits) == (seen.hi >> bits)
        node = F.lit(0).cast("bigint") if last_phase else F.call_function("shiftright", F.col("a"), F.lit(bits))
        w = Window.partitionBy("e", "node").orderBy("a")
        runs = runs.withColumn("node", node).withColumn("prev", F.lag("b").over(w))
        runs = runs.withColumn("new", F.when(F.col("prev").isNull() | (F.col("prev") + 1 < F.col("a")), 1).otherwise(0)).withColumn("isle", F.sum("new").over(w))
        isles = runs.groupBy("e", "node", "isle").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("linked", "a").alias("linked"))
        wi = Window.partitionBy("e", "node").orderBy("isle")
        isles = isles.withColumn("prev", F.lag("b").over(wi)).withColumn("next", F.lead("a").over(wi))
        if last_phase:
            final = F.lit(True)
        else:
            final = F.col("prev").isNotNull() & F.col("next").isNotNull()
        period = F.when(final, F.struct(F.lit("period").alias("kind"), F.col("a").alias("a"), F.col("b").alias("b")))
        gap = F.when(F.col("prev").isNotNull() & ~F.col("linked"), F.struct(F.lit("gap").alias("kind"), (F.col("prev") + 1).alias("a"), (F.col("a") - 1).alias("b")))
        out.append(isles.select("e", F.explode(F.array_compact(F.array(period, gap))).alias("x")).select("e", "x.kind", "x.a", "x.b"))
        if last_phase:
            break
        runs = isles.where(~final).select("e", "a", "b", F.col("prev").isNotNull().alias("linked"))
    result = out[0]
    for d in out[1:]:
        result = result.unionByName(d)
    return name(result)
