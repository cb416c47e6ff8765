"""Results as files: the shortlist as CSV, a report as Markdown, and names of files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import format_months
from ..operators.screening import csv_line


def safe_file_name(c: Column) -> Column:
    """A name without signs that file systems forbid, at most 120 characters."""
    clean = F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', "-"), r"\s+", " ")
    return F.substring(F.trim(clean), 1, 120)


def dated_file_name(stem: Column, day: Column, extension: str) -> Column:
    return F.concat(safe_file_name(stem), F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.lit("." + extension))


def csv_text(rows: DataFrame, group: str, order: str, columns: list[str], preamble: list[str]) -> DataFrame:
    """(group, csv): one CSV text a group with BOM, # lines, header and CRLF, in the given order. A group is one shortlist, so it is bounded by its cut."""
    head = "﻿" + "".join(f"# {x}\r\n" for x in preamble) + ",".join(columns) + "\r\n"
    line = csv_line(*[F.col(c) for c in columns])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x.getField("l"))
    return rows.groupBy(group).agg(F.concat(F.lit(head), F.array_join(lines, "\r\n"), F.lit("\r\n")).alias("csv"))


# Columns of a shortlist; the four from the sixth on stand only where there is a vacancy.
SHORTLIST_COLUMNS = ("Позиция", "Кандидат", "Должность в резюме", "Почта", "Город", "Покрытие требований", "Есть из требований", "Не найдено", "Совпадение с вакансией", "Оценка резюме", "Итоговый балл", "Опыт", "Уровень", "Критичных замечаний", "Важных замечаний", "На что обратить внимание")


def shortlist_rows(ranked: DataFrame, with_job: bool) -> DataFrame:
    """The cells of a shortlist under SHORTLIST_COLUMNS (16 with a vacancy, else 12), with batch_id and place kept in front for csv_text.

    ranked: batch_id, place and the columns of a candidate, with `total` as its rank. Missing values are empty cells, a file name stands for a missing name.
    """
    have, lack = F.coalesce(F.array_size("matched_required"), F.lit(0)), F.coalesce(F.array_size("missing_required"), F.lit(0))
    share = F.concat(have, F.lit("/"), have + lack, F.lit(" ("), F.floor(have * 100 / (have + lack) + 0.5), F.lit("%)"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    job = (F.when(have + lack > 0, share).otherwise(""), listed("matched_required"), listed("missing_required"), text("job_match_score"))
    cells = [
        F.col("place").cast("string"), F.coalesce("candidate_name", "file_name", F.lit("")), text("headline"), text("email"), text("city"), *(job if with_job else ()), text("overall_score"), text("total"),
        F.when(F.col("experience_months") > 0, format_months(F.col("experience_months"))).otherwise(""), F.when(F.col("seniority") != "unknown", F.col("seniority")).otherwise(""), text("critical_count"), text("major_count"), listed("flags"),
    ]
    names = [n for k, n in enumerate(SHORTLIST_COLUMNS) if with_job or not 5 <= k <= 8]
    return ranked.select("batch_id", "place", *[c.alias(n) for c, n in zip(cells, names)])


def markdown_reports(scores: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """(key, report): overall score and findings by place as Markdown; documents without findings have a report too."""
    item = F.concat(F.lit("- **"), "severity", F.lit("** `"), "rule_id", F.lit("` -"), F.col("penalty").cast("string"))
    lists = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))).alias("f"))
    body = F.array_join(F.transform(F.coalesce("f", F.array().cast("array<struct<place:int,item:string>>")), lambda x: x.getField("item")), "\n")
    title = F.concat(F.lit("# Document "), F.col(key).cast("string"), F.lit("\n\nOverall: "), F.col("overall").cast("string"), F.lit("\n\n"))
    return scores.join(lists, key, "left").select(key, F.concat(title, body).alias("report"))
