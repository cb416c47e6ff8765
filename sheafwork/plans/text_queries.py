"""String and date functions over whole tables, each with the same computation in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..session import table
from .dialect import OTHER

SPACE_SQL = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WORD_SQL = r"[\p{L}\p{N}][\p{L}\p{N}+#./''-]*"
_FROM, _TO = T._accent_table()
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"""SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g')) AS s FROM documents)""")
def text_squish(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("s", T.squish(F.col("text"))).select("doc_id", F.length("s").cast("bigint").alias("n"), F.md5("s").alias("digest"))


@query(f"SELECT doc_id, md5({OTHER.norm('text')}) AS digest FROM documents")
def text_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORD_SQL}')) AS INTEGER) AS n FROM documents")
def text_word_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n"))


@query(
    r"""SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS digest FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([\p{Lu}\p{N}])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x != '') AS s FROM documents)"""
)
def text_sentences(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("s", T.sentences(F.col("text"))).select("doc_id", F.when(F.col("s").isNotNull(), F.size("s")).alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(
    r"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN l + c = 0 THEN 'unknown' WHEN l / (l + c) > 0.9 THEN 'latin' WHEN l / (l + c) < 0.1 THEN 'cyrillic' ELSE 'mixed' END AS script
    FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\p{Latin}')) AS l, len(regexp_extract_all(text, '\p{Cyrillic}')) AS c FROM documents)"""
)
def text_script(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.detect_script(F.col("text")).alias("script"))


@query("SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 60) || '…' || right(text, 59) END AS excerpt FROM documents")
def text_excerpt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.excerpt(F.col("text"), 120).alias("excerpt"))


@query(r"SELECT doc_id, CASE WHEN l = 0 THEN 0.0 ELSE u / l END AS ratio FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\p{Lu}')) AS u, len(regexp_extract_all(text, '\p{L}')) AS l FROM documents)")
def text_uppercase_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.uppercase_ratio(F.col("text")).alias("ratio"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}])(?:budget|équipe|предприятие|отчёты)(?:$|[^\p{L}\p{N}])')")
def text_contains_word(spark, sf_dir):
    return docs(spark, sf_dir).where(T.contains_word(F.col("text"), ["budget", "équipe", "предприятие", "отчёты"])).select("doc_id")


@query("SELECT doc_id, CAST(p - 1 AS INTEGER) AS span_start, CAST(p + 2 AS INTEGER) AS span_end FROM (SELECT doc_id, position('the' IN text) AS p FROM documents) WHERE p > 0")
def text_find_span(spark, sf_dir):
    found = docs(spark, sf_dir).withColumn("s", T.find_span(F.col("text"), F.lit("the"))).where("s is not null")
    return found.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query(
    f"""SELECT DISTINCT candidate_id, headline, seniority, levenshtein(h, s) <= least(2, floor(greatest(length(h), length(s)) / 4)) AS close
    FROM (SELECT candidate_id, headline, seniority, {OTHER.norm("coalesce(headline, '')")} AS h, {OTHER.norm("coalesce(seniority, '')")} AS s FROM candidates)"""
)
def text_loose_equals(spark, sf_dir):
    c = table(spark, sf_dir, "candidates").select("candidate_id", "headline", "seniority").distinct()
    low = lambda x: F.lower(F.coalesce(F.col(x), F.lit("")))
    return c.select("*", T.loose_equals(low("headline"), low("seniority")).alias("close"))


_MIX = "CAST(xor({}, {}) * 16777619 & 4294967295 AS BIGINT)"
_DIGITS = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(h // {36**k} % 36 + 1 AS INTEGER), 1)" for k in range(6, -1, -1))


@query(
    f"""WITH units AS (SELECT doc_id, list_transform(list_filter(string_split(CAST(doc_id AS VARCHAR) || chr(0) || coalesce(text, ''), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT)) AS u FROM documents),
    hashed AS (SELECT doc_id, list_reduce(u, lambda h, c: CASE WHEN c < 65536 THEN {_MIX.format('h', 'c')} ELSE {_MIX.format(_MIX.format('h', '55296 + (c - 65536) // 1024'), '56320 + (c - 65536) % 1024')} END, CAST(2166136261 AS BIGINT)) AS h FROM units)
    SELECT doc_id, 'doc_' || ltrim({_DIGITS}, '0') AS stable_id FROM hashed"""
)
def text_stable_id(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.stable_id("doc", F.col("doc_id"), F.col("text")).alias("stable_id"))


@query(
    """SELECT DISTINCT candidate_id, experience_months AS months,
    CASE WHEN experience_months = 0 THEN '0 mo' ELSE concat_ws(' ', CASE WHEN experience_months >= 12 THEN (experience_months // 12) || ' y' END, CASE WHEN experience_months % 12 > 0 THEN (experience_months % 12) || ' mo' END) END AS label,
    CASE WHEN experience_months IS NULL THEN 'месяцев' WHEN experience_months % 100 BETWEEN 11 AND 14 THEN 'месяцев' WHEN experience_months % 10 = 1 THEN 'месяц' WHEN experience_months % 10 BETWEEN 2 AND 4 THEN 'месяца' ELSE 'месяцев' END AS unit FROM candidates"""
)
def text_month_labels(spark, sf_dir):
    c = table(spark, sf_dir, "candidates").select("candidate_id", F.col("experience_months").alias("months")).distinct()
    return c.select("*", D.format_months(F.col("months")).alias("label"), T.plural_ru(F.col("months"), "месяц", "месяца", "месяцев").alias("unit"))


@query(
    r"""SELECT extraction_id, link, rtrim(regexp_replace(link, '(?i)^https?://(?:www\.)?', ''), '/') AS bare FROM (SELECT extraction_id, unnest(regexp_extract_all(plain_text, 'https?://[A-Za-z0-9./_-]+')) AS link FROM extractions)"""
)
def text_links(spark, sf_dir):
    x = table(spark, sf_dir, "extractions").select("extraction_id", F.explode(F.regexp_extract_all("plain_text", F.lit(r"https?://[A-Za-z0-9./_-]+"), F.lit(0))).alias("link"))
    return x.select("*", T.bare_url(F.col("link")).alias("bare"))


@query("SELECT exp_id, start_year, CASE WHEN date_format = 'year-only' THEN NULL ELSE start_month END AS start_month, CASE WHEN is_current THEN NULL ELSE end_year END AS end_year, CASE WHEN is_current OR date_format = 'year-only' THEN NULL ELSE end_month END AS end_month, is_current FROM (SELECT DISTINCT exp_id, start_year, start_month, end_year, end_month, is_current, raw_text, date_format FROM experience) WHERE raw_text IS NOT NULL AND start_year IS NOT NULL AND (end_year IS NOT NULL OR is_current)")
def date_ranges(spark, sf_dir):
    """raw_text parsed again; the table's own year and month columns are what it must give."""
    e = table(spark, sf_dir, "experience").where("raw_text is not null and start_year is not null and (end_year is not null or is_current)").select("exp_id", "raw_text").distinct()
    r = e.withColumn("r", D.parse_date_range(F.col("raw_text")))
    return r.select("exp_id", "r.start.year", "r.start.month", F.col("r.end.year").alias("ey"), F.col("r.end.month").alias("em"), "r.is_current").toDF("exp_id", "start_year", "start_month", "end_year", "end_month", "is_current")


@query()
def parsed_date_ranges(spark, sf_dir):
    """Every raw_text parsed, partial and unreadable ones too; date_ranges compares those whose columns are complete with the table."""
    e = table(spark, sf_dir, "experience").where("raw_text is not null").select("exp_id", "raw_text").distinct()
    r = e.withColumn("r", D.parse_date_range(F.col("raw_text")))
    return r.select("exp_id", "r.start.year", "r.start.month", F.col("r.end.year").alias("ey"), F.col("r.end.month").alias("em"), "r.is_current").toDF("exp_id", "start_year", "start_month", "end_year", "end_month", "is_current")
