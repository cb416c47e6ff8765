"""Roles of an experience section and blocks of a vacancy, read from lines in one pass per text (no shuffle)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import documents as O

#: A line that anchors a role: a date and the beginning of a range, not a list line, at most 18 words.
RANGE = r"(?:19|20)\d\d(?:[-./]\d\d)?\s*(?:[–—-]|to|bis|à|a|até|до|по)\s+\S"
MOST_HEADER_WORDS = 18
_DATES = r"[,\s]*(?:\p{L}+\.?\s+(?:de\s+)?|\d{1,2}[./])?(?:19|20)\d\d(?:[-./]\d\d)?\s*(?:[–—-]|to|bis|à|a|até|до|по)\s+.*$"


def is_anchor(line: Column) -> Column:
    return line.rlike(RANGE) & ~line.rlike(O.BULLET) & (T.word_count(line) <= MOST_HEADER_WORDS)


def experience_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, job_no, header, dates, bullets): each anchor line and the lines down to the next anchor, empty line or heading.

    header is the line without its dates; bullets are the lines below, marks off. Null texts and texts without anchors have none. Anchors are
    marked and what follows each is sliced once.
    """
    ends = lambda line: (F.trim(line) == "") | O.heading_kind(line).isNotNull()

    def until_end(lines: Column) -> Column:
        stop = F.array_position(F.transform(lines, ends), True).cast("int")
        return F.transform(F.when(stop > 0, F.slice(lines, F.lit(1), stop - 1)).otherwise(lines), lambda x: F.regexp_replace(x, O.BULLET, ""))

    def pieces(lines: Column) -> Column:
        return O.once(F.transform(lines, lambda x: F.when(is_anchor(x), x)), lambda kinds: F.filter(O.cut_at(lines, kinds), lambda e: e.getField("kind").isNotNull()))

    found = df.where(F.col(text).isNotNull()).select(key, F.posexplode(O.once(T.lines(F.col(text)), pieces)).alias("p", "e"))
    header = F.trim(F.regexp_replace("e.kind", _DATES, ""))
    dates = F.regexp_extract("e.kind", RANGE[:-2] + r".*$", 0)
    return found.select(key, (F.col("p") + 1).alias("job_no"), header.alias("header"), dates.alias("dates"), until_end(F.col("e.lines")).alias("bullets"))


def vacancy_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, item_no, item): list lines under the headings of duties, required and optional skills; the last heading above decides."""

    def items(lines: Column) -> Column:
        blocks = O.once(F.transform(lines, O.heading_kind), lambda kinds: O.cut_at(lines, kinds))
        own = F.filter(blocks, lambda b: b.getField("kind").isin("duties", "requirements", "optional"))
        listed = lambda b: F.transform(F.filter(b.getField("lines"), lambda x: x.rlike(O.BULLET)), lambda x: F.struct(b.getField("kind").alias("block"), F.trim(F.regexp_replace(x, O.BULLET, "")).alias("item")))
        return F.flatten(F.transform(own, listed))

    found = O.once(T.lines(F.col(text)), items)
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(found).alias("p", "i")).select(key, "i.block", (F.col("p") + 1).alias("item_no"), "i.item")
