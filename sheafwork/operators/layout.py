"""Layout analytics over positioned lines: columns, repeated margins, fonts, glyphs, and lines rebuilt from runs.

Lines are rows (doc_id, page, line_no, text, x, y, width) with x, y, width as shares of the page. Everything is keyed by document and page,
so a hot document spreads over its pages.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Margins, bins of the width, least width of an empty stripe in bins, least share of spans on either side, least lines of a page, and where the middle lies.
HEADER, FOOTER, BINS, GUTTER, SIDE, LEAST_LINES, MIDDLE = 0.075, 0.925, 100, 5, 0.2, 8, (0.22, 0.78)
# Fonts that every system reads, letters only.
SAFE_FONTS = "arial helvetica calibri times georgia garamond cambria verdana tahoma trebuchet roboto opensans lato inter segoe liberation dejavu nimbus notosans ptsans".split()
# Characters that garble when copied.
GLYPHS = ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ", "\u0000", "�")


def columns_by_page(lines: DataFrame) -> DataFrame:
    """(doc_id, page, columns): 2 where an empty stripe of 5 % of the width and more, which reaches the middle, has a fifth of the spans fully on either side, else 1.

    Spans are the structs (x, width) of a line's column spans, or the line itself where there is no such column or it is null or empty. Lines in the margins don't count; a page of under eight lines has one column.
    """
    body = lines.where((F.col("y") >= HEADER) & (F.col("y") <= FOOTER))
    own = F.array(F.struct(F.col("x").cast("double").alias("x"), F.col("width").cast("double").alias("width")))
    spans = F.when(F.size("spans") > 0, F.transform("spans", lambda r: F.struct(r.getField("x").cast("double").alias("x"), r.getField("width").cast("double").alias("width")))).otherwise(own) if "spans" in lines.columns else own
    counted = body.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))
    rows = body.select("doc_id", "page", F.explode(spans).alias("r")).select("doc_id", "page", F.col("r.x").alias("a"), (F.col("r.x") + F.col("r.width")).alias("z"))
    first, last = F.greatest(F.floor(F.col("a") * BINS), F.lit(0)), F.least(F.ceil(F.col("z") * BINS), F.lit(BINS - 1))
    covered = rows.select("doc_id", "page", F.explode(F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))).alias("bin")).groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("bin")).alias("bins"))
    # Empty stripes lie between neighbouring covered bins, and at both edges.
    edges = F.concat(F.array(F.lit(-1)), F.col("bins"), F.array(F.lit(BINS)))
    stripes = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda e, i: F.struct((e + 1).alias("from"), F.get(edges, i + 1).alias("to")))
    low, high = MIDDLE
    wide = F.filter(stripes, lambda s: (s.getField("to") - s.getField("from") >= GUTTER) & (s.getField("to") / BINS >= low) & (s.getField("from") / BINS <= high))
    stripe = covered.select("doc_id", "page", F.explode(wide).alias("s")).select("doc_id", "page", (F.col("s.from") / BINS).alias("lo"), (F.col("s.to") / BINS).alias("hi"))
    # At most a page's bins of stripes meet its spans.
    sides = rows.join(stripe, ["doc_id", "page"]).groupBy("doc_id", "page", "lo").agg(F.count("*").alias("n"), F.count_if(F.col("z") <= F.col("lo")).alias("left"), F.count_if(F.col("a") >= F.col("hi")).alias("right"))
    two = sides.where((F.col("left") >= SIDE * F.col("n")) & (F.col("right") >= SIDE * F.col("n"))).select("doc_id", "page").distinct().withColumn("two", F.lit(True))
    joined = counted.join(two, ["doc_id", "page"], "left")
    return joined.select("doc_id", "page", F.when(F.coalesce("two", F.lit(False)) & (F.col("n_lines") >= LEAST_LINES), 2).otherwise(1).alias("columns"))


_PAGE_NUMBER = r"(?i)^\s*(?:page\s*)?\d+\s*(?:/\s*\d+)?\s*$"


def _margin_key(c: Column) -> Column:
    return T.normalize(T.squish(c))


def repeated_margins(lines: DataFrame, samples: int | None = None) -> DataFrame:
    """(doc_id, sample, pages): texts in the margins of two and more pages, told apart in normalized form and given as first written; bare page numbers and texts under three characters are none.

    samples: at most so many of a document, in their order there (a report shows five); None gives all.
    """
    margin = lines.where(((F.col("y") < HEADER) | (F.col("y") > FOOTER)) & (F.length(_margin_key(F.col("text"))) >= 3))
    found = margin.groupBy("doc_id", _margin_key(F.col("text")).alias("k")).agg(F.countDistinct("page").alias("pages"), F.min_by("text", F.struct("page", "line_no")).alias("first"), F.min(F.struct("page", "line_no")).alias("at"))
    found = found.where((F.col("pages") >= 2) & ~F.col("first").rlike(_PAGE_NUMBER)).select("doc_id", F.col("first").alias("sample"), "pages", "at")
    if samples is not None:
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).where(F.col("place") <= samples)
    return found.select("doc_id", "sample", "pages")


def without_margins(lines: DataFrame) -> DataFrame:
    """Lines of the body: those that repeat in the margins of two and more pages taken out, and page numbers there too, even on the only page of a document."""
    keyed = lines.withColumn("__k", _margin_key(F.col("text"))).withColumn("__m", (F.col("y") < HEADER) | (F.col("y") > FOOTER))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("__n"))
    seen = keyed.where(F.col("__m") & (F.length("__k") >= 3)).groupBy("doc_id", "__k").agg(F.countDistinct("page").alias("__p")).join(pages, "doc_id")
    number = F.col("__k").rlike(_PAGE_NUMBER)
    gone = seen.where((F.col("__p") >= 2) | (number & (F.col("__n") == 1))).select("doc_id", "__k").withColumn("__m", F.lit(True))
    return keyed.join(gone, ["doc_id", "__k", "__m"], "left_anti").select(*lines.columns)


def nonstandard_fonts(fonts: Column) -> Column:
    """Distinct font families, ascending, that hold no name of SAFE_FONTS."""
    letters = lambda f: F.regexp_replace(F.lower(f), "[^a-z]", "")
    generic = ("serif", "sansserif", "monospace", "cursive", "fantasy", "systemui", "")
    return F.array_sort(F.array_distinct(F.filter(fonts, lambda f: f.isNotNull() & ~letters(f).isin(*generic) & ~F.exists(F.array(*[F.lit(s) for s in SAFE_FONTS]), lambda s: F.contains(letters(f), s)))))


def font_family(name: Column) -> Column:
    """Family of a font's name: subset tag off, cut at - or comma, words apart."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^[A-Z]{6}\+", ""), r"[-,].*$", ""), r"(?<=[a-z])(?=[A-Z])", " ")


def problem_glyphs(text: Column) -> Column:
    """Joined letters, NUL, replacement and private-use characters that a text holds."""
    found = F.filter(F.array(*[F.lit(g) for g in GLYPHS]), lambda g: F.contains(text, g))
    return F.when(text.isNotNull(), F.concat(found, F.when(text.rlike(r"[\x{E000}-\x{F8FF}]"), F.array(F.lit("private-use-area"))).otherwise(F.array().cast("array<string>"))))


def lines_from_runs(runs: DataFrame) -> DataFrame:
    """Runs (doc_id, page, x, y, width, text; y from the top) grouped to lines: one line within .6 % of the height; gaps over 3.5 % of the width become tabs."""
    order = Window.partitionBy("doc_id", "page").orderBy("y", "x")
    r = runs.withColumn("new", F.when(F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) <= 0.006, F.lit(False)), 0).otherwise(1)).withColumn("line_no", F.sum("new").over(order))
    inside = Window.partitionBy("doc_id", "page", "line_no").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(inside)
    r = r.withColumn("gap", gap).withColumn("piece", F.concat(F.when(F.col("gap") > 0.035, "\t").when(F.col("gap").isNotNull(), " ").otherwise(""), F.col("text")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("x", "piece"))), lambda p: p.getField("piece"))
    return r.groupBy("doc_id", "page", "line_no").agg(
        F.array_join(pieces, "").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), F.count_if(F.col("gap") > 0.035).alias("inner_gaps")
    )


def plain_text(lines: DataFrame) -> DataFrame:
    """(doc_id, plain_text): lines in reading order, an empty line where the distance exceeds 1.6 times the median or the page changes."""
    order = Window.partitionBy("doc_id").orderBy("page", "y", "x")
    l = lines.withColumn("step", F.when(F.lag("page").over(order) == F.col("page"), F.col("y") - F.lag("y").over(order))).withColumn("turned", F.lag("page").over(order) != F.col("page"))
    middle = l.where("step > 0").groupBy("doc_id").agg(F.sort_array(F.collect_list("step")).alias("s")).select("doc_id", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("median"))
    l = l.join(middle, "doc_id", "left")
    piece = F.concat(F.when(F.coalesce(F.col("turned"), F.lit(False)) | (F.col("step") > 1.6 * F.col("median")), "\n").otherwise(""), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("page", "y", "x", piece.alias("piece"))))
    return l.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r.getField("piece")), "\n").alias("plain_text"))
