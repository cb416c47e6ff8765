"""Text statistics per document, and the class of its text: prose, list, table or junk.

The statistics are built-in functions over the text and its lines, computed in the JVM. Labelling functions judge the lines of a bounded
sample of documents (sentence, list entry, row of cells, junk) and so label it weakly; what they find is no statistic, so the trees don't see it. Boosted trees
learn the class from the statistics of four fifths of the sample; their probabilities are calibrated on the rest, which they
didn't see, and on the texts in `HOLDOUT`, which were checked by hand and count more.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .sampling import hash_sample

CLASSES = ("prose", "list", "table", "junk")
#: Rows of the weakly labelled training sample (the smallest by a hash of the id).
SAMPLE_ROWS = 4000

# Common words of the six languages.
COMMON = frozenset(
    """
the of and to in a is that for it was on with as be at by this are from or have an not we you which my your our would had but they one all
der die das und ist nicht ein eine zu den mit von für auf im sich des dem dass ich wir sie habe haben war bei nach oder aber wie
le la les de des et un une est dans pour que qui sur pas avec au ce il je nous vous a j’ai plus par en du mais cela
el los las y que en del se por con una para es no lo al como más pero yo nos fue
o os as e da do em uma não com na no dos das mais foi eu nós ao aos um isso
и в не на что я с по это как за из от так мы у для же или был была было до чтобы к о
""".split()
)

_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_BULLET = re.compile(r"(?:[-*•–—▪·‣◦☐☑✓+]|\d{1,3}[.)]|\(?[a-zA-Zа-я]\)|\(\d{1,3}\))\s+\S")
_END = re.compile(r"[.!?…][»”\"')]*$")
_SPLIT = re.compile(r"(?<=[.!?…])[»”\"')]*\s+")
_CELLS = (re.compile(r"\t"), re.compile(r"\|"), re.compile(r";(?! |$)"), re.compile(r",(?!\s)"), re.compile(r"\S {2,}(?=\S)"))
_NAV = re.compile(r"[»›]|\s>\s")
_NOISE = re.compile(r"[^\w\s.,;:!?'’\"«»“”„()\-–—%&/@+|·•#*°º]")


def line_kinds(text: str) -> dict[str, float]:
    """Shares of the non-blank characters by what their lines are told to be."""
    shares = Counter()
    lines = [x.strip() for x in text.split("\n")]
    filled = [x for x in lines if x]
    total = sum(map(len, filled)) or 1
    times = Counter(filled)
    repeated = len(filled) >= 4 and len(times) <= max(2, len(filled) // 12)
    cells = [Counter(len(p.findall(x)) for x in filled) for p in _CELLS]
    rows = [(p, {n for n, k in c.items() if n and k >= 2 and (n >= 2 or k >= 3) and k * 3 >= len(filled)}) for p, c in zip(_CELLS, cells)]
    block: list[str] = []

    def told(lines_: list[str]) -> None:
        """Lines without bullets or cells: sentences across line ends, else entries, else junk."""
        if not lines_:
            return
        parts = _SPLIT.split(" ".join(lines_))
        inside = 0
        for part in parts:
            words = _WORD.findall(part.lower())
            common = sum(w in COMMON for w in words)
            if _END.search(part.strip()) and len(words) >= 4 and common * 12 >= len(words) and len(words) <= 90:
                shares["prose"] += len(part)
                inside += len(part)
        size = sum(map(len, lines_))
        rest = size - inside
        if rest <= 0 or inside * 5 >= size * 4:
            shares["prose"] += max(rest, 0)
            return
        words = _WORD.findall(" ".join(lines_).lower())
        common = sum(w in COMMON for w in words) / max(1, len(words))
        upper = sum(x[:1].isupper() or x[:1].isdigit() for x in lines_)
        items = max(len(re.split(r"\s·\s|\s•\s|;\s", x)) for x in lines_)
        commas = max(len(x.split(", ")) for x in lines_)
        if len(lines_) >= 2 and upper * 3 >= len(lines_) * 2 and not inside:
            shares["list"] += rest
        elif items >= 4 or (commas >= 4 and common < 0.15):
            shares["list"] += rest
        elif common >= 0.17:
            shares["prose"] += rest
        elif len(lines_) == 1 and len(words) <= 4:
            shares["head"] += rest
        else:
            shares["junk"] += rest

    for x in lines:
        if not x:
            told(block)
            block = []
            continue
        words = _WORD.findall(x)
        solid = len(x) - x.count(" ")
        noise = len(_NOISE.findall(x))
        bare = sum(c.isalnum() for c in x)
        if repeated and times[x] >= 3 and not _BULLET.match(x):
            kind = "junk"
        elif any(p.pattern != r",(?!\s)" and len(p.findall(x)) in ok or p.pattern == r",(?!\s)" and len(p.findall(x)) in ok and not _END.search(x) for p, ok in rows) and not (_END.search(x) and len(words) > 12):
            kind = "table"
        elif _NAV.search(x) and len(words) <= 40 and not _END.search(x):
            kind = "junk"
        elif noise * 14 > solid or (bare * 2 < solid and solid > 3) or any(len(w) > 40 for w in x.split()):
            kind = "junk"
        elif _BULLET.match(x):
            kind = "prose" if _END.search(x) and len(words) >= 5 else "list"
        else:
            block.append(x)
            continue
        told(block)
        block = []
        shares[kind] += len(x)
    told(block)
    return {k: v / total for k, v in shares.items()}


# Marks as patterns of the JVM; J_SMALL are words of at most three small letters, as most function words are.
J_WORD = r"\p{L}+"
J_SMALL = r"(?:^| )\p{Ll}{1,3}(?= )"
J_CELL = r"[\t|]|[;,](?! |$)"
J_BULLET = r"^(?:[-*•–—▪·‣◦☐☑✓+]|\d{1,3}[.)]|\(?[a-zA-Zа-я]\)|\(\d{1,3}\))\s+\S"
J_END = r"[.!?…][»”\"')]*$"
J_NOISE = r"[^_.,;:!?'’\"«»“”„()\-–—%&/@+|·•#*°º]"

#: Statistics of each text; those from mean_word_length on are ratios, those that end in _chars shares of the characters by their lines.
STATISTICS = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "noise_ratio", "terminal_line_share", "common_word_share", "small_word_share", "bullet_line_share", "mean_words_per_line",
    "repeated_line_share", "distinct_word_share", "stops_per_word", "nav_per_line", "items_per_line", "long_tokens",
    "bullet_chars", "told_bullet_chars", "ended_chars", "spoken_chars", "cell_chars", "even_cell_chars", "short_chars", "noise_chars", "nav_chars", "repeated_chars", "comma_chars", "capital_chars",
)


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, STATISTICS...) of each row by built-in functions; null, empty and blank texts have zeros. Repeated rows stay repeated."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\r\u00a0"))), lambda x: x != "")

    def line(x: Column) -> Column:
        count = lambda p: F.regexp_count(x, F.lit(p))
        signs = F.regexp_replace(x, r"[\p{L}\p{N}\s]+", "")
        # Runs of spaces part cells as well; most lines have none, which contains tells sooner than a pattern.
        cells = count(J_CELL) + F.when(F.contains(x, F.lit("  ")), count(r" {2,}")).otherwise(0)
        return F.struct(
            F.length(x).alias("n"), count(J_WORD).alias("words"), count(J_SMALL).alias("small"), cells.alias("cells"), F.length(signs).alias("signs"), F.regexp_count(signs, F.lit(J_NOISE)).alias("noise"),
            F.when(F.contains(signs, F.lit("»")) | F.contains(signs, F.lit("›")) | F.contains(signs, F.lit(">")), count(r"[»›]| > ")).otherwise(0).alias("nav"), count(r" [·•] |; ").alias("items"), count(r"[.!?] ").alias("stops"),
            F.when(F.contains(signs, F.lit(",")), count(", ")).otherwise(0).alias("commas"), x.rlike(J_BULLET).alias("bullet"), F.right(x, F.lit(4)).rlike(J_END).alias("ended"), F.left(x, F.lit(1)).rlike(r"[\p{Lu}\d]").alias("capital"), count(r"\d").alias("digits"),
        )

    d = df.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"), lines.alias("x")).select("k", "t", "x", F.transform("x", line).alias("l"))
    g = lambda r, name: r.getField(name)
    total = lambda f: F.aggregate("l", F.lit(0).cast("bigint"), lambda a, r: a + f(r))
    whole = lambda name: total(lambda r: g(r, name))
    chars = lambda test: total(lambda r: F.when(test(r), g(r, "n")).otherwise(0))
    many = lambda test: total(lambda r: F.when(test(r), 1).otherwise(0))
    # The middle number of cells among lines with cells.
    celled = F.array_sort(F.transform(F.filter("l", lambda r: g(r, "cells") > 0), lambda r: g(r, "cells")))
    summed = d.select(
        "k", F.length("t").alias("n_chars"), F.size("l").alias("m"), "l", celled.alias("celled"), F.size(F.array_distinct("x")).alias("lines_left"), F.aggregate(F.array_distinct("x"), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("chars_left"),
        F.array_distinct(F.split(F.lower("t"), " ")).alias("distinct"), F.regexp_count("t", F.lit(r"(?<!\S)\S{41}")).alias("long"), F.col("t").rlike(r"[^\s\p{Z}]").alias("filled"),
        *[whole(n).alias(n) for n in ("n", "words", "small", "signs", "noise", "nav", "items", "stops", "digits")],
        many(lambda r: g(r, "ended")).alias("ended"), many(lambda r: g(r, "bullet")).alias("bullet"),
        chars(lambda r: g(r, "bullet")).alias("c_bullet"), chars(lambda r: g(r, "bullet") & g(r, "ended") & (g(r, "words") >= 5)).alias("c_told"), chars(lambda r: g(r, "ended") & (g(r, "words") >= 4)).alias("c_ended"),
        chars(lambda r: g(r, "small") * 5 >= g(r, "words")).alias("c_spoken"), chars(lambda r: g(r, "cells") >= 2).alias("c_cells"), chars(lambda r: (g(r, "words") <= 4) & ~g(r, "ended")).alias("c_short"),
        chars(lambda r: g(r, "noise") * 14 > g(r, "n")).alias("c_noise"), chars(lambda r: g(r, "nav") > 0).alias("c_nav"), chars(lambda r: g(r, "commas") * 5 >= g(r, "words")).alias("c_comma"), chars(lambda r: g(r, "capital") & ~g(r, "ended")).alias("c_capital"),
    )
    n, words, m = F.greatest(F.col("n"), F.lit(1)), F.greatest(F.col("words"), F.lit(1)), F.greatest(F.col("m"), F.lit(1))
    common = F.size(F.array_intersect("distinct", F.array(*[F.lit(w) for w in sorted(COMMON)])))
    usual = F.get("celled", F.floor(F.size("celled") / 2).cast("int"))
    summed = summed.withColumns({"usual": usual, "common": common, "n_distinct": F.size("distinct")})
    even = F.aggregate("l", F.lit(0).cast("bigint"), lambda a, r: a + F.when((g(r, "cells") > 0) & (g(r, "cells") == F.col("usual")), g(r, "n")).otherwise(0))
    of = {
        "n_chars": F.when(F.col("filled"), F.col("n_chars")).otherwise(0), "n_words": F.col("words"), "n_lines": F.col("m"), "mean_word_length": (F.col("n") - F.col("signs") - F.col("digits")) / words, "symbol_ratio": F.col("signs") / n, "digit_ratio": F.col("digits") / n,
        "noise_ratio": F.col("noise") / n, "terminal_line_share": F.col("ended") / m, "common_word_share": F.col("common") / F.greatest(F.col("n_distinct"), F.lit(1)), "small_word_share": F.col("small") / words, "bullet_line_share": F.col("bullet") / m, "mean_words_per_line": F.col("words") / m,
        "repeated_line_share": F.when(F.col("m") > 0, 1 - F.col("lines_left") / m).otherwise(0), "distinct_word_share": F.when(F.col("m") > 0, F.col("n_distinct") / words).otherwise(0),
        "stops_per_word": F.col("stops") / words, "nav_per_line": F.col("nav") / m, "items_per_line": F.col("items") / m, "long_tokens": F.col("long") / words, "bullet_chars": F.col("c_bullet") / n, "told_bullet_chars": F.col("c_told") / n,
        "ended_chars": F.col("c_ended") / n, "spoken_chars": F.col("c_spoken") / n, "cell_chars": F.col("c_cells") / n, "even_cell_chars": even / n, "short_chars": F.col("c_short") / n, "noise_chars": F.col("c_noise") / n, "nav_chars": F.col("c_nav") / n,
        "repeated_chars": F.when(F.col("m") > 0, 1 - F.col("chars_left") / n).otherwise(0), "comma_chars": F.col("c_comma") / n, "capital_chars": F.col("c_capital") / n,
    }
    return summed.select(F.col("k").alias(key), *[of[name].cast("double").alias(name) for name in STATISTICS])


def weak_label(text: str) -> int | None:
    """Class of more than half of the characters by the labelling functions; None where they don't agree on one."""
    kinds = line_kinds(text)
    name = max(CLASSES, key=lambda k: kinds.get(k, 0.0))
    return CLASSES.index(name) if kinds.get(name, 0.0) > 0.5 else None


# Checked by hand: class, text.
HOLDOUT = (
    ("prose", "Last spring we moved the archive to the second floor. Nobody had expected that it would take three weeks, but the lift was broken."),
    ("prose", "Ich habe drei Jahre in einer kleinen Werkstatt gearbeitet. Dort lernte ich,\nwie man mit alten Maschinen umgeht und\nwarum Geduld wichtig ist."),
    ("prose", "Je vous écris au sujet du poste de bibliothécaire. J’ai travaillé dans deux écoles, et les enfants aimaient venir lire le mercredi."),
    ("prose", "En la entrevista habló con calma de sus errores. Nos gustó que preguntara por el equipo antes que por el sueldo."),
    ("prose", "A candidata chegou cedo e respondeu a todas as perguntas. Não sabia usar o sistema antigo, mas aprendeu depressa."),
    ("prose", "Мы работали вместе четыре года. Он всегда приходил вовремя и помогал новым коллегам, когда им было трудно."),
    ("prose", "- The visit began with a short talk about safety.\n- After that we walked through the hall and saw how the parts are painted.\n- It was loud, but everyone was friendly."),
    ("list", "- hammer\n- saw\n- two boxes of nails\n- sandpaper\n- glue"),
    ("list", "Kenntnisse:\nSchweißen\nLöten\nFräsen\nStapler fahren\nTechnisches Zeichnen"),
    ("list", "1. Visited four suppliers\n2. Counted the stock of both halls\n3. Wrote the handbook for new staff\n4. Trained six drivers"),
    ("list", "Gardener · Cook · Night porter · Van driver · Receptionist · Gardener"),
    ("list", "(a) Пекарь\n(b) Сварщик\n(c) Водитель погрузчика\n(d) Кладовщик"),
    ("table", "Name;Town;Age\nBrix;Orlen;41\nFost;Tamm;29\nHule;Orlen;35"),
    ("table", "| Week | Shift | Hours |\n| --- | --- | --- |\n| 12 | early | 38 |\n| 13 | late | 40 |"),
    ("table", "No      Part          Price     \n14      Valve         12.50     \n15      Pump          99.00     \n16      Seal          1.20      "),
    ("table", "771\tdriver\t2019\tyes\n772\tcook\t2020\tno\n780\tclerk\t2021\tyes"),
    ("junk", "Home » Jobs » Login\nTerms » Privacy » Contact\nBack to top » Print"),
    ("junk", "qzv trlkw pooie zzrhg wqel kjhgf ptrwq eiouq zzxcv llkjw rtpqw mnbvz qqwer"),
    ("junk", "Copy\nCopy\nCopy\nCopy\nCopy\nCopy\nCopy\nCopy\nCopy\nCopy\nCopy\nCopy"),
    ("junk", "~~~~====----____....\n\n***+++===---\n\n____====....###\n"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBub3RoaW5n/KzQ5Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3A=="),
    ("junk", "w~ m^ved th¬ arch|ve t{ the ]econd fl§or, n¬body h}d exp^cted th|t ]t wo{ld t§ke thr¬e w]eks b|t"),
    ("junk", "harbour under lamp ticket forgiven stone seven corridor paint winter bolt apron signal"),
)


#: Weight of a text checked by hand against one of the held-back part, and the part held back, in fifths.
HAND_WEIGHT, HELD_FIFTHS = 20, 1


def train(x: np.ndarray, y: np.ndarray, hand_x: np.ndarray, hand_y: np.ndarray) -> Boosted:
    """Trees from the statistics and weak labels of a sample, in the order of a hash, and of the texts checked by hand."""
    if not len(x):
        return Boosted().fit(hand_x, hand_y, len(CLASSES))
    held = np.arange(len(x)) % 5 < HELD_FIFTHS
    model = Boosted(rounds=40, depth=4).fit(x[~held], y[~held], len(CLASSES))
    return model.calibrate(np.vstack([x[held], np.repeat(hand_x, HAND_WEIGHT, axis=0)]), np.concatenate([y[held], np.repeat(hand_y, HAND_WEIGHT)]))


def train_on(df: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS) -> Boosted:
    """Trees from at most `rows` whole texts, the first by a hash of the key. Statistics and labels are made on the executors; the driver gets numbers only."""

    @F.pandas_udf("int")
    def weak_labels(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: weak_label(t) if t and t.strip() else None).astype("Int32")

    fit = df.where(F.col(text).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.xxhash64(key).alias("__h"), F.col(text).alias("__t"))
    few = hash_sample(fit, df.count(), "__h", rows)
    labelled = few.select("__h", "__t", F.struct("__h", weak_labels("__t").alias("y")).alias("__k"))
    got = statistics(labelled, "__k", "__t").select("__k.*", F.array(*STATISTICS).alias("x")).where("y is not null").orderBy("__h").collect()
    hand = df.sparkSession.createDataFrame([(k, CLASSES.index(c), t) for k, (c, t) in enumerate(HOLDOUT)], "k int, y int, t string")
    checked = statistics(hand.select(F.struct("k", "y").alias("k"), "t"), "k", "t").select("k.*", F.array(*STATISTICS).alias("x")).orderBy("k").collect()
    arrays = lambda rs: (np.array([r.x for r in rs]).reshape(-1, len(STATISTICS)), np.array([r.y for r in rs], np.int64))
    return train(*arrays(got), *arrays(checked))


def classify(df: DataFrame, key: str, text: str, model: Boosted) -> DataFrame:
    """(key, statistics..., text_class, probability) of each row; null, empty and blank texts have zeros and no class. Only the statistics go to Python."""

    @F.pandas_udf("struct<text_class:string,probability:double>")
    def judge(x: pd.Series) -> pd.DataFrame:
        stats = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(STATISTICS)))
        p = model.probabilities(stats)
        blank = stats[:, 0] == 0
        return pd.DataFrame({"text_class": np.where(blank, None, np.array(CLASSES, object)[p.argmax(1)]), "probability": np.where(blank, np.nan, p.max(1))})

    # A filter on the class must stay above: pushed down, it would carry the statistics along as an expression, again for each of their uses.
    d = statistics(df, key, text).withColumn("__j", judge.asNondeterministic()(F.array(*STATISTICS)))
    return d.select(key, *STATISTICS, "__j.text_class", "__j.probability")
