"""Matching, scoring, ranking and output of candidates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round

#: Shares of coverage, job match and overall score in the rank.
WEIGHTS = (0.55, 0.25, 0.20)
# Bands and their least scores.
BANDS = (("excellent", 85), ("good", 70), ("needs-work", 50), ("poor", 0))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the one with the earliest `order`; rows of a key are equal but for that column, so any task order gives the same."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def coverage(matched: Column, missing: Column) -> Column:
    """Share of the required skills that are there; 1 without requirements, null arrays as empty."""
    have, lack = F.coalesce(F.array_size(matched), F.lit(0)), F.coalesce(F.array_size(missing), F.lit(0))
    return F.when(have + lack == 0, 1.0).otherwise(F.try_divide(have, have + lack))


def rank_total(covered: Column, match: Column, overall: Column, with_job: Column) -> Column:
    """Rank of a candidate: the weighted sum with a vacancy, else the overall score. Integer arithmetic in thousandths, so that both engines round alike."""
    parts = F.round(covered * 100000).cast("bigint") * 55 + F.coalesce(match, F.lit(0)) * 25000 + overall * 20000
    return F.when(with_job, F.floor(parts / 100000 + 0.5)).otherwise(overall)


def band(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, least in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def shortlist(df: DataFrame, group: str, score: str, name: str, key: str, top: int) -> DataFrame:
    """The first `top` rows of each group by score (null last), then name, then key; Spark prunes each task's rows to `top` before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), F.asc_nulls_last(name), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def csv_cell(c: Column) -> Column:
    """A cell by RFC 4180 that no spreadsheet runs as a formula; null as empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def merge_spans(spans: Column) -> Column:
    """Overlapping or touching spans (structs start, end) of an array merged, ascending; null and empty ones dropped."""
    clean = F.array_sort(F.filter(spans, lambda s: s.isNotNull() & (s.getField("end") > s.getField("start"))))
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        wider = F.struct(last.getField("start").alias("start"), F.greatest(last.getField("end"), s.getField("end")).alias("end"))
        return F.when((F.size(acc) > 0) & (s.getField("start") <= last.getField("end")), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), wider)).otherwise(F.array_append(acc, s))

    return F.aggregate(clean.cast(kind), F.array().cast(kind), step)


def fixed_windows(events: DataFrame, key: str, time: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """(key, tie, allowed): decision of a fixed-window limiter for each event; a key's window opens at its first request after the last window closed.

    Rows of a key are sorted inside their partition and streamed in batches with the state of one key at a time, so no key is ever held in memory; a null key is a key of its own. The order decides, so a key's
    events pass through one task; give a salted or daily key where that is too slow.
    """
    import pandas as pd

    shape = events.select(key, F.col(tie).cast("bigint").alias(tie)).schema
    rows = events.select(key, F.col(tie).cast("bigint").alias(tie), F.unix_micros(F.col(time).cast("timestamp")).alias("__t")).repartition(key).sortWithinPartitions(key, "__t", tie)

    def decide(batches):
        current, opened, n = object(), 0, 0
        for batch in batches:
            allowed = []
            for k, t in zip(batch[key].tolist(), batch["__t"].tolist()):
                same = k == current or (k != k and current != current)
                if not same or t - opened >= seconds * 1_000_000:
                    current, opened, n = k, t, 0
                n += 1
                allowed.append(n <= limit)
            yield pd.DataFrame({key: batch[key], tie: batch[tie], "allowed": allowed})

    return rows.mapInPandas(decide, shape.add("allowed", "boolean"))


def client_key(headers: Column) -> Column:
    """Key of a client from a map of headers in lower case: the first forwarded address, else the real one, else `unknown`; a null map is unknown."""
    first = F.trim(F.get(F.split(F.try_element_at(headers, F.lit("x-forwarded-for")), ","), 0))
    return F.coalesce(F.when(first != "", first), F.try_element_at(headers, F.lit("x-real-ip")), F.lit("unknown"))


def toggle_sort(state: tuple[str, str], key: str) -> tuple[str, str]:
    """Next (key, direction) after a click on a column: the same key turns round, a new one begins descending, names ascending."""
    if state[0] == key:
        return key, "asc" if state[1] == "desc" else "desc"
    return key, "asc" if key == "name" else "desc"


def excerpts(text: Column, spans: Column, most: int = 6, least: int = 10) -> Column:
    """The first `most` distinct pieces of a text at spans (structs start, end, half-open), trimmed, of `least` characters and more; null spans are passed over, and null texts give null."""
    pieces = F.transform(F.filter(spans, lambda s: s.isNotNull() & (s.getField("end") > s.getField("start"))), lambda s: F.trim(F.substring(text, s.getField("start") + 1, s.getField("end") - s.getField("start"))))
    return F.when(text.isNotNull(), F.slice(F.array_distinct(F.filter(F.coalesce(pieces, F.array().cast("array<string>")), lambda x: F.length(x) >= least)), F.lit(1), F.lit(most)))


__all__ = ["band", "client_key", "coverage", "csv_cell", "csv_line", "excerpts", "fixed_windows", "js_round", "latest", "merge_spans", "rank_total", "shortlist", "toggle_sort"]
