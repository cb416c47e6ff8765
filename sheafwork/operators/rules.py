"""A registry of text rules as columns: each is a status, a severity and a factor over one row of facts.

All rules of a document are evaluated in one projection; findings, dimension scores and the weighted overall score follow
without a shuffle, as the outcomes stay in one array per document.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import documents as O

# Weights of the dimensions in hundredths, severities in order.
DIMENSIONS = {"parseability": 26, "structure": 18, "content": 24, "keywords": 14, "narrative": 8, "language": 5, "international": 5}
SEVERITIES = ("critical", "major", "minor", "info")
# Openings that tell duties instead of results, and praise that nobody can verify.
WEAK_OPENINGS = "responsible for|responsibilities included|duties included|worked on|worked with|worked as|helped with|helped to|assisted with|assisted in|participated in|involved in|took part in|tasked with|in charge of|was part of|my role was|my responsibilities|занимался|занималась|отвечал за|отвечала за|участвовал в|участвовала в|помогал|помогала|принимал участие|принимала участие|выполнял обязанности|в мои обязанности входило|обязанности:|работал над|работала над|работал с|работала с".split("|")
CLICHES = "hard worker|hard-working|team player|self-starter|go-getter|think outside the box|detail-oriented|detail oriented|results-oriented|results-driven|goal-oriented|proven track record|dynamic professional|synergy|best of breed|value add|passionate about|guru|ninja|rockstar|wizard|excellent communication skills|strong work ethic|fast learner|quick learner|ответственный|коммуникабельный|стрессоустойчивый|стрессоустойчивость|целеустремлённый|целеустремленный|обучаемость|быстро обучаюсь|легко обучаем|пунктуальный|исполнительный|умение работать в команде|без вредных привычек|активная жизненная позиция|желание развиваться|нацеленность на результат".split("|")


@dataclass(frozen=True)
class Rule:
    """evaluate: column of struct(status pass | skip | fail, severity, factor) from the facts."""

    id: str
    dimension: str
    severity: str
    penalty: int
    evaluate: Callable[[], Column]


def outcome(fails: Column, factor: Column | float = 1.0, severity: Column | str | None = None, skip: Column | None = None) -> Column:
    status = F.when(F.coalesce(fails, F.lit(False)), "fail").otherwise("pass")
    if skip is not None:
        status = F.when(F.coalesce(skip, F.lit(False)), "skip").otherwise(status)
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(status.alias("status"), as_column(severity).cast("string").alias("severity"), F.least(as_column(factor).cast("double"), F.lit(1.0)).alias("factor"))


def _share(part: str, whole: str = "n_bullets") -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


RULES: tuple[Rule, ...] = (
    Rule("no-text-layer", "parseability", "critical", 100, lambda: outcome(~F.col("has_text_layer"))),
    Rule("content-in-tables", "parseability", "major", 30, lambda: outcome(F.col("tabular") > 0, F.when(F.col("tabular") >= 8, 1.0).otherwise(0.5), F.when(F.col("tabular") >= 8, "major").otherwise("minor"))),
    Rule("problematic-glyphs", "parseability", "major", 25, lambda: outcome(F.col("glyphs"))),
    Rule("missing-experience-section", "structure", "critical", 60, lambda: outcome(~F.array_contains("kinds", "experience"))),
    Rule("missing-contact-email", "structure", "critical", 50, lambda: outcome(F.col("email").isNull())),
    Rule("missing-phone", "structure", "minor", 12, lambda: outcome(F.col("phone").isNull())),
    Rule("missing-skills-section", "structure", "major", 28, lambda: outcome(~F.array_contains("kinds", "skills"))),
    Rule("missing-education-section", "structure", "minor", 12, lambda: outcome(~F.array_contains("kinds", "education"))),
    Rule("missing-summary", "structure", "minor", 10, lambda: outcome(~F.array_contains("kinds", "summary"))),
    Rule("no-achievements-found", "content", "critical", 100, lambda: outcome(F.col("n_bullets") == 0)),
    Rule(
        "bullets-not-quantified", "content", "critical", 40,
        lambda: outcome(_share("quantified") < 0.5, (0.5 - _share("quantified")) / 0.5, F.when(_share("quantified") < 0.2, "critical").otherwise("major"), F.col("n_bullets") == 0),
    ),
    Rule("weak-bullet-openings", "content", "major", 30, lambda: outcome(F.col("weak") > 0, _share("weak") / 0.4, None, F.col("n_bullets") == 0)),
    Rule("overlong-bullets", "content", "minor", 16, lambda: outcome(F.col("overlong") > 0, _share("overlong") / 0.3, None, F.col("n_bullets") == 0)),
    Rule("stub-bullets", "content", "minor", 12, lambda: outcome(F.col("stubs") > 0, _share("stubs") / 0.25, None, F.col("n_bullets") == 0)),
    Rule("cliches", "content", "major", 20, lambda: outcome(F.col("cliches") > 0, F.col("cliches") / 5)),
    Rule("inconsistent-bullet-markers", "language", "minor", 10, lambda: outcome(F.col("marks") > 1)),
    Rule("long-sentences", "language", "minor", 12, lambda: outcome((F.col("average") > 24) | (F.col("long_sentences") > 2), F.col("long_sentences") / 6, None, F.col("n_sentences") == 0)),
    Rule("mixed-languages", "language", "major", 20, lambda: outcome((F.col("script") == "mixed") & ~F.col("latin_share").between(0.15, 0.45), 0.8)),
)
if len({r.id for r in RULES}) != len(RULES):
    raise ValueError("two rules share an id")


def facts(df: DataFrame, key: str, text: str, weak: list[str], cliches: list[str]) -> DataFrame:
    """One row of facts a document; df also has has_text_layer and has_problematic_glyphs. A null text counts as empty. Openings and phrases are compared in normalized form."""
    d = df.select(key, F.coalesce("has_text_layer", F.lit(False)).alias("has_text_layer"), F.coalesce("has_problematic_glyphs", F.lit(False)).alias("glyphs"), F.coalesce(text, F.lit("")).alias("t"))
    t = F.col("t")
    lines = T.lines(t)
    bullets = F.transform(F.filter(lines, lambda x: x.rlike(O.BULLET)), lambda x: F.regexp_replace(x, O.BULLET, ""))
    marks = F.array_distinct(F.transform(F.filter(lines, lambda x: x.rlike(O.BULLET)), lambda x: F.left(F.ltrim(x), F.lit(1))))
    lengths = F.filter(F.transform(T.sentences(t), lambda s: T.word_count(s)), lambda n: n >= 3)
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    email = F.regexp_extract(t, O.EMAIL, 0)
    latin, cyrillic = F.regexp_count(t, F.lit(r"\p{IsLatin}")), F.regexp_count(t, F.lit(r"\p{IsCyrillic}"))
    d = d.withColumns({"b": bullets, "n": lengths, "m": marks, "folded": T.normalize(t)})
    many = lambda test: F.size(F.filter("b", test))
    phrase = lambda p: T.normalize(F.lit(p))
    opens = F.filter(F.transform("b", T.normalize), lambda x: reduce(Column.__or__, [F.startswith(x, phrase(w)) for w in weak], F.lit(False)))
    return d.select(
        key,
        "has_text_layer",
        "glyphs",
        F.size(F.filter(lines, lambda x: F.regexp_count(F.trim(x), F.lit(r" {3,}|\t+")) >= 2)).alias("tabular"),
        F.array_distinct(F.array_compact(F.transform(lines, lambda x: O.heading_kind(x)))).alias("kinds"),
        F.when(email != "", email).alias("email"),
        F.get(F.filter(F.regexp_extract_all(t, F.lit(O.PHONE), F.lit(0)), lambda x: digits(x).between(10, 15)), 0).alias("phone"),
        F.size("b").alias("n_bullets"),
        many(lambda x: x.rlike(r"\d")).alias("quantified"),
        F.size(opens).alias("weak"),
        many(lambda x: T.word_count(x) > 34).alias("overlong"),
        many(lambda x: T.word_count(x) < 4).alias("stubs"),
        F.size(F.filter("m", lambda x: x.isin(list(O.MARKS)))).alias("marks"),
        sum((F.contains(F.col("folded"), phrase(c)).cast("int") for c in cliches), F.lit(0)).alias("cliches"),
        F.size("n").alias("n_sentences"),
        F.coalesce(F.try_divide(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x), F.size("n")), F.lit(0.0)).alias("average"),
        F.size(F.filter("n", lambda x: x > 28)).alias("long_sentences"),
        T.detect_script(t).alias("script"),
        F.coalesce(F.try_divide(latin, latin + cyrillic), F.lit(0.0)).alias("latin_share"),
    )


def evaluate(rows: DataFrame, key: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, outcomes): rule_id, dimension, status, severity and penalty of each rule."""

    def one(rule: Rule) -> Column:
        o = rule.evaluate()
        severity = F.coalesce(o.getField("severity"), F.lit(rule.severity))
        penalty = F.when(o.getField("status") == "fail", F.floor(F.lit(rule.penalty) * o.getField("factor") + 0.5)).otherwise(0)
        return F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.dimension).alias("dimension"), o.getField("status").alias("status"), severity.alias("severity"), penalty.cast("int").alias("penalty"))

    return rows.select(key, F.array(*map(one, rules)).alias("outcomes"))


def findings(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, place, rule_id, dimension, severity, penalty) of failed rules, by severity, penalty and id."""
    level = lambda s: F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), s)
    failed = F.filter("outcomes", lambda o: o.getField("status") == "fail")
    keyed = F.array_sort(F.transform(failed, lambda o: F.struct(level(o.getField("severity")).alias("a"), (-o.getField("penalty")).alias("b"), o.getField("rule_id").alias("c"), o.alias("o"))))
    return outcomes.select(key, F.posexplode(keyed).alias("p", "k")).select(key, (F.col("p") + 1).alias("place"), "k.o.rule_id", "k.o.dimension", "k.o.severity", "k.o.penalty")


def scores(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, one column a dimension, overall, band inputs): 100 less the penalties, at least 0; null where no rule ran; the overall score weighs the others anew."""
    own = lambda d: F.filter("outcomes", lambda o: (o.getField("dimension") == d) & (o.getField("status") != "skip"))
    total = lambda d: F.aggregate(own(d), F.lit(0), lambda a, o: a + o.getField("penalty"))
    named = {d: F.when(F.size(own(d)) > 0, F.greatest(100 - total(d), F.lit(0))) for d in DIMENSIONS}
    d = outcomes.select(key, *[c.alias(n) for n, c in named.items()])
    weight = sum((F.when(F.col(n).isNotNull(), w).otherwise(0) for n, w in DIMENSIONS.items()), F.lit(0))
    summed = sum((F.coalesce(F.col(n), F.lit(0)) * w for n, w in DIMENSIONS.items()), F.lit(0))
    return d.withColumn("overall", F.coalesce(F.floor(F.try_divide(summed, weight) + 0.5), F.lit(0)).cast("int"))
