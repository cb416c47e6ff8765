"""Document, screening and ordered operators over whole tables, with the same computation in SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import documents as O
from ..operators import layout as L
from ..operators import parsing as P
from ..operators import rules as R
from ..operators import screening as S
from ..operators.intervals import merge_intervals
from ..session import table
from .problems import P1_SQL, role_months

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORD = r"[\p{L}\p{N}][\p{L}\p{N}+#./''-]*"
BULLET = r"^\s*(?:[-*•–—▪·‣◦]|\d{1,2}[.)])\s+"
WEAK, PHRASES = list(R.WEAK_OPENINGS), list(R.CLICHES)
KEYWORDS = ["report", "contract", "stock", "plan", "budget"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _extractions(spark, sf_dir):
    return table(spark, sf_dir, "extractions").select("extraction_id", "plain_text")


_LINES = r"SELECT extraction_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT extraction_id, regexp_split_to_array(plain_text, '\r?\n') AS l FROM extractions WHERE plain_text IS NOT NULL)"


@query(
    rf"""SELECT extraction_id, CAST(line_no AS INTEGER) AS line_no, least((length(line) - length(ltrim(line, ' '))) / 80, 0.4) AS x, least(length(trim(line, ' ')) / 90, 1.0) AS width,
    CAST(len(regexp_extract_all(trim(line, ' '), ' {{3,}}|\t+')) AS INTEGER) AS inner_gaps FROM ({_LINES})"""
)
def line_geometry(spark, sf_dir):
    return O.line_geometry(O.text_lines(_extractions(spark, sf_dir), "extraction_id", "plain_text")).select("extraction_id", "line_no", "x", "width", "inner_gaps")


@query(rf"SELECT extraction_id, CAST(count(*) FILTER (WHERE len(regexp_extract_all(trim(line, ' '), ' {{3,}}|\t+')) >= 2) AS BIGINT) AS n FROM ({_LINES}) GROUP BY extraction_id")
def tabular_rows(spark, sf_dir):
    tabular = lambda x: F.regexp_count(F.trim(x), F.lit(r" {3,}|\t+")) >= 2
    x = _extractions(spark, sf_dir).where("plain_text is not null")
    return x.select("extraction_id", F.size(F.filter(T.lines(F.col("plain_text")), tabular)).cast("bigint").alias("n"))


_KIND_SQL = "CASE " + " ".join(f"WHEN h IN ({', '.join(chr(39) + f.replace(chr(39), chr(39) * 2) + chr(39) for f in forms.split('|'))}) THEN '{kind}'" for kind, forms in O.HEADINGS.items()) + " END"


@query(
    rf"""WITH l AS ({_LINES}), k AS (SELECT *, {_KIND_SQL} AS kind FROM (SELECT *, lower(trim(regexp_replace(line, '[:\s]+$', ''), ' ')) AS h FROM l)),
    s AS (SELECT *, 1 + sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY extraction_id ORDER BY line_no) AS section_no FROM k)
    SELECT extraction_id, CAST(section_no AS INTEGER) AS section_no, coalesce(max(kind), 'contacts') AS kind, CAST(count(*) FILTER (WHERE kind IS NULL) AS INTEGER) AS n_lines,
    CAST(coalesce(sum(len(regexp_extract_all(line, '{WORD}'))) FILTER (WHERE kind IS NULL), 0) AS INTEGER) AS n_words FROM s GROUP BY extraction_id, section_no
    UNION ALL SELECT extraction_id, 1, 'contacts', 0, 0 FROM k WHERE line_no = 1 AND kind IS NOT NULL"""
)
def sections(spark, sf_dir):
    return O.sections(_extractions(spark, sf_dir), "extraction_id", "plain_text").drop("body")


@query(
    rf"""WITH l AS ({_LINES}), b AS (SELECT extraction_id, line, regexp_replace(line, '{BULLET}', '') AS p FROM l WHERE regexp_matches(line, '{BULLET}')),
    m AS (SELECT *, len(regexp_extract_all(p, '{WORD}')) AS w, left(ltrim(line, ' '), 1) AS mark FROM b)
    SELECT e.extraction_id, CAST(count(p) AS INTEGER) AS n_bullets, CAST(count(*) FILTER (WHERE regexp_matches(p, '\d')) AS INTEGER) AS quantified,
    CAST(count(*) FILTER (WHERE {' OR '.join(f"starts_with(lower(p), '{w}')" for w in WEAK)}) AS INTEGER) AS weak, CAST(count(*) FILTER (WHERE w > 34) AS INTEGER) AS overlong, CAST(count(*) FILTER (WHERE w < 4) AS INTEGER) AS stubs,
    floor(coalesce(sum(w) / nullif(count(p), 0), 0) * 10 + 0.5) / 10 AS average_words, CAST(count(DISTINCT mark) FILTER (WHERE mark IN ({', '.join(f"'{m}'" for m in O.MARKS)})) AS INTEGER) AS marks
    FROM extractions e LEFT JOIN m ON e.extraction_id = m.extraction_id WHERE plain_text IS NOT NULL GROUP BY e.extraction_id"""
)
def bullet_metrics(spark, sf_dir):
    return O.bullet_metrics(_extractions(spark, sf_dir), "extraction_id", "plain_text", WEAK)


@query(
    rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([\p{{Lu}}\p{{N}}])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1)),
      lambda x: len(regexp_extract_all(trim(x, ' '), '{WORD}'))), lambda n: n >= 3) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(len(n) AS INTEGER) AS n_sentences, floor(coalesce(list_sum(n) / nullif(len(n), 0), 0) * 10 + 0.5) / 10 AS average, CAST(len(list_filter(n, lambda x: x > 28)) AS INTEGER) AS overlong FROM s"""
)
def sentence_metrics(spark, sf_dir):
    return O.sentence_metrics(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"SELECT doc_id, phrase, CAST(position(phrase IN lower(text)) - 1 AS INTEGER) AS at FROM documents, (SELECT unnest([{', '.join(repr(p) for p in PHRASES)}]) AS phrase) WHERE position(phrase IN lower(text)) > 0")
def phrase_hits(spark, sf_dir):
    return O.phrase_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", PHRASES)


@query(
    f"SELECT * FROM (SELECT doc_id, word, CAST((length(text) - length(replace(lower(text), word, ''))) // length(word) AS INTEGER) AS n FROM documents, (SELECT unnest([{', '.join(repr(p) for p in KEYWORDS)}]) AS word)) WHERE n > 3"
)
def keyword_counts(spark, sf_dir):
    return O.keyword_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", KEYWORDS, 3)


@query(
    r"""SELECT extraction_id, nullif(regexp_extract(plain_text, '[\w.+-]+@[\w-]+\.[\w.-]*\w'), '') AS email,
    list_filter(regexp_extract_all(plain_text, '(?:\+?\d{1,3}[\s().-]{0,3})?(?:\d[\s().-]{0,3}){8,14}\d'), lambda x: length(regexp_replace(x, '\D', '', 'g')) BETWEEN 10 AND 15)[1] AS phone,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(plain_text, 'https?://[A-Za-z0-9./_-]+'), lambda u: rtrim(regexp_replace(u, '(?i)^https?://(?:www\.)?', ''), '/')))), ' ') AS links FROM extractions"""
)
def contacts(spark, sf_dir):
    return O.contacts(_extractions(spark, sf_dir), "extraction_id", "plain_text")


_REDACT_SQL = r"regexp_replace(regexp_replace(regexp_replace(plain_text, '[\w.+-]+@[\w-]+\.[\w.-]*\w', '[[EMAIL]]', 'g'), 'https?://[A-Za-z0-9./_-]+', '[[URL]]', 'g'), '(?:\+\d{1,3}[\s(-]?)?(?:\d[\s()-]?){9,14}\d', '[[PHONE]]', 'g')"


@query(f"SELECT extraction_id, md5({_REDACT_SQL}) AS digest, regexp_matches({_REDACT_SQL}, '@') AS sign_left FROM extractions")
def redacted_texts(spark, sf_dir):
    return _extractions(spark, sf_dir).withColumn("r", O.redact(F.col("plain_text"))).select("extraction_id", F.md5("r").alias("digest"), F.contains("r", F.lit("@")).alias("sign_left"))


@query()
def scanned_terms(spark, sf_dir):
    """Skills of the reference table, told by name or alias; the table is a vocabulary of some 80 entries and goes to the driver."""
    entries = table(spark, sf_dir, "skill_reference").select("canonical", "aliases").where("canonical is not null").orderBy("canonical").collect()
    # A name of its own goes before another entry's alias.
    names = {alias: r.canonical for r in entries for alias in r.aliases or () if alias} | {r.canonical: r.canonical for r in entries}
    return _extractions(spark, sf_dir).where("plain_text is not null").select("extraction_id", F.array_join(O.scan_names(F.col("plain_text"), names), "|").alias("terms"))


@query("SELECT DISTINCT candidate_id, CASE WHEN regexp_matches(lower(file_name), '\\.(pdf|docx|txt|md)$') THEN regexp_extract(lower(file_name), '\\.(pdf|docx|txt|md)$', 1) END AS format FROM candidates")
def file_formats(spark, sf_dir):
    from ..sources.files import detect_format

    return table(spark, sf_dir, "candidates").select("candidate_id", detect_format(F.col("file_name")).alias("format")).distinct()


_ROLES = P1_SQL[: P1_SQL.index("far AS")]


@query(_ROLES + """far AS (SELECT *, max(z) OVER (PARTITION BY candidate_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ok)
SELECT candidate_id, CAST(sum(greatest(z - greatest(a, coalesce(top + 1, a)) + 1, 0)) AS BIGINT) AS months FROM far GROUP BY candidate_id""")
def tenure_months(spark, sf_dir):
    """Months of the union of a file's roles."""
    periods = merge_intervals(role_months(spark, sf_dir), "candidate_id", "a", "b").where("kind = 'period'")
    return periods.groupBy("candidate_id").agg(F.sum(D.range_months(F.col("from_at"), F.col("to_at"))).alias("months"))


@query(f"SELECT candidate_id, from_month, to_month FROM ({P1_SQL}) WHERE kind = 'gap' AND to_month - from_month + 1 >= 4")
def employment_gaps(spark, sf_dir):
    gaps = merge_intervals(role_months(spark, sf_dir), "candidate_id", "a", "b").where("kind = 'gap' and to_at - from_at + 1 >= 4")
    return gaps.select("candidate_id", F.col("from_at").cast("int").alias("from_month"), F.col("to_at").cast("int").alias("to_month"))


_JOBS = "SELECT exp_id, any_value(candidate_id) AS candidate_id, any_value(start_year) * 12 + coalesce(any_value(start_month), 1) - 1 AS a FROM experience GROUP BY exp_id"


def _jobs(spark, sf_dir):
    e = table(spark, sf_dir, "experience").where("start_year is not null")
    one = e.groupBy("exp_id").agg(F.min_by(F.struct("candidate_id", "start_year", "start_month"), "loaded_at").alias("r"))
    return one.select("exp_id", "r.candidate_id", D.month_index(F.col("r.start_year"), F.col("r.start_month")).alias("a"))


@query(f"SELECT candidate_id, CAST(count(*) AS BIGINT) AS jobs, CAST(count(*) FILTER (WHERE a > p) AS BIGINT) AS inversions FROM (SELECT *, lag(a) OVER (PARTITION BY candidate_id ORDER BY exp_id) AS p FROM ({_JOBS}) WHERE a IS NOT NULL) GROUP BY candidate_id")
def chronology_inversions(spark, sf_dir):
    """Roles that start after the one listed before them."""
    w = Window.partitionBy("candidate_id").orderBy("exp_id")
    jobs = _jobs(spark, sf_dir).withColumn("p", F.lag("a").over(w))
    return jobs.groupBy("candidate_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("a") > F.col("p")).alias("inversions"))


@query(
    """WITH one AS (SELECT exp_id, any_value(candidate_id) AS candidate_id, any_value(date_format) AS f FROM experience GROUP BY exp_id)
    SELECT candidate_id, array_to_string(list_sort(list_distinct(list(f) FILTER (WHERE f IS NOT NULL))), '|') AS formats FROM one GROUP BY candidate_id"""
)
def date_formats(spark, sf_dir):
    return table(spark, sf_dir, "experience").groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("date_format")), "|").alias("formats"))


@query(
    """SELECT job_title, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT company) AS BIGINT) AS firms, avg(confidence) AS confidence FROM (SELECT DISTINCT exp_id, job_title, company, confidence FROM experience) GROUP BY job_title"""
)
def roles_by_title(spark, sf_dir):
    e = table(spark, sf_dir, "experience").select("exp_id", "job_title", "company", "confidence").distinct()
    return e.groupBy("job_title").agg(F.count("*").alias("n"), F.countDistinct("company").alias("firms"), F.avg("confidence").alias("confidence"))


_ONE = "(SELECT candidate_id, any_value(batch_id) AS batch_id, any_value(candidate_name) AS candidate_name, any_value(overall_score) AS overall, any_value(job_match_score) AS m, any_value(parseability_score) AS parse, any_value(seniority) AS seniority, any_value(critical_count) AS crit, any_value(major_count) AS major, any_value(len(matched_required)) AS have, any_value(len(missing_required)) AS lack, any_value(flags) AS flags FROM candidates GROUP BY candidate_id)"
_RANKED = f"(SELECT c.*, CASE WHEN coalesce(have, 0) + coalesce(lack, 0) = 0 THEN 1.0 ELSE coalesce(have, 0) / (coalesce(have, 0) + coalesce(lack, 0)) END AS coverage, b.job_id IS NOT NULL AS with_job FROM {_ONE} c LEFT JOIN batches b ON c.batch_id = b.batch_id)"
_TOTAL = "CASE WHEN with_job THEN CAST(floor((CAST(round(coverage * 100000) AS BIGINT) * 55 + coalesce(m, 0) * 25000 + overall * 20000) / 100000 + 0.5) AS BIGINT) ELSE CAST(overall AS BIGINT) END"


def _ranked(spark, sf_dir):
    c = S.latest(table(spark, sf_dir, "candidates"), "candidate_id", "loaded_at")
    b = table(spark, sf_dir, "batches").select("batch_id", "job_id")
    c = c.join(b, "batch_id", "left").withColumn("coverage", S.coverage(F.col("matched_required"), F.col("missing_required")))
    return c.withColumn("total", S.rank_total(F.col("coverage"), F.col("job_match_score"), F.col("overall_score"), F.col("job_id").isNotNull()))


@query(f"SELECT candidate_id, coverage, {_TOTAL} AS total, CASE WHEN {_TOTAL} >= 85 THEN 'excellent' WHEN {_TOTAL} >= 70 THEN 'good' WHEN {_TOTAL} >= 50 THEN 'needs-work' WHEN {_TOTAL} >= 0 THEN 'poor' END AS band FROM {_RANKED}")
def rank_scores(spark, sf_dir):
    return _ranked(spark, sf_dir).select("candidate_id", "coverage", F.col("total").cast("bigint").alias("total"), S.band(F.col("total")).alias("band"))


@query(f"SELECT batch_id, candidate_id, place FROM (SELECT batch_id, candidate_id, row_number() OVER (PARTITION BY batch_id ORDER BY {_TOTAL} DESC NULLS LAST, candidate_name NULLS LAST, candidate_id) AS place FROM {_RANKED}) WHERE place <= 5")
def shortlist(spark, sf_dir):
    return S.shortlist(_ranked(spark, sf_dir), "batch_id", "total", "candidate_name", "candidate_id", 5).select("batch_id", "candidate_id", F.col("place").cast("bigint").alias("place"))


@query(
    rf"""WITH g AS (SELECT candidate_id, CASE WHEN regexp_matches(v, '^[=+\-@\t\r]') THEN '''' || v ELSE v END AS v FROM (SELECT candidate_id, coalesce(candidate_name, '') AS v FROM {_ONE}))
    SELECT candidate_id, candidate_id || ',' || CASE WHEN regexp_matches(v, '[",\r\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS line FROM g"""
)
def csv_lines(spark, sf_dir):
    c = S.latest(table(spark, sf_dir, "candidates").select("candidate_id", "candidate_name", "loaded_at"), "candidate_id", "loaded_at")
    return c.select("candidate_id", S.csv_line(F.col("candidate_id"), F.col("candidate_name")).alias("line"))


@query(f"SELECT flag, CAST(count(*) AS BIGINT) AS n, CAST(sum(crit) AS BIGINT) AS critical, CAST(sum(major) AS BIGINT) AS major FROM (SELECT unnest(flags) AS flag, crit, major FROM {_ONE}) GROUP BY flag")
def findings_by_flag(spark, sf_dir):
    c = S.latest(table(spark, sf_dir, "candidates").select("candidate_id", "flags", "critical_count", "major_count", "loaded_at"), "candidate_id", "loaded_at")
    return c.select(F.explode("flags").alias("flag"), "critical_count", "major_count").groupBy("flag").agg(F.count("*").alias("n"), F.sum("critical_count").alias("critical"), F.sum("major_count").alias("major"))


@query(f"SELECT batch_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE seniority = 'junior') AS BIGINT) AS junior, CAST(count(*) FILTER (WHERE seniority = 'middle') AS BIGINT) AS middle, CAST(count(*) FILTER (WHERE seniority = 'senior') AS BIGINT) AS senior, CAST(count(*) FILTER (WHERE seniority = 'lead') AS BIGINT) AS lead FROM {_ONE} GROUP BY batch_id")
def seniority_by_batch(spark, sf_dir):
    c = S.latest(table(spark, sf_dir, "candidates").select("candidate_id", "batch_id", "seniority", "loaded_at"), "candidate_id", "loaded_at")
    return c.groupBy("batch_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("seniority") == s).alias(s) for s in ("junior", "middle", "senior", "lead")])


@query(
    """SELECT DISTINCT c.candidate_id, array_to_string(list_sort(list_intersect(c.have, j.need)), '|') AS matched, array_to_string(list_sort(list_filter(j.need, lambda x: NOT list_contains(c.have, x))), '|') AS missing
    FROM (SELECT candidate_id, any_value(batch_id) AS batch_id, any_value(coalesce(matched_required, [])) AS have FROM candidates GROUP BY candidate_id) c JOIN batches b ON c.batch_id = b.batch_id
    JOIN (SELECT job_id, list_distinct(list(canonical)) AS need FROM job_skills WHERE is_required AND canonical IS NOT NULL GROUP BY job_id) j ON b.job_id = j.job_id"""
)
def skill_matches(spark, sf_dir):
    """Required skills of a vacancy that a candidate has and lacks."""
    c = S.latest(table(spark, sf_dir, "candidates").select("candidate_id", "batch_id", "matched_required", "loaded_at"), "candidate_id", "loaded_at")
    need = table(spark, sf_dir, "job_skills").where("is_required and canonical is not null").groupBy("job_id").agg(F.collect_set("canonical").alias("need"))
    both = c.join(table(spark, sf_dir, "batches").select("batch_id", "job_id"), "batch_id").join(need, "job_id")
    have = F.coalesce("matched_required", F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.array_sort(a), "|")
    return both.select("candidate_id", joined(F.array_intersect(have, "need")).alias("matched"), joined(F.array_except("need", have)).alias("missing"))


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_id, k, t AS opened, 1 AS n FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.t - w.opened >= 86400000000 THEN o.t ELSE w.opened END, CASE WHEN o.t - w.opened >= 86400000000 THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
    SELECT user_id, event_id, n <= 2 AS allowed FROM w"""
)
def rate_limits(spark, sf_dir):
    return S.fixed_windows(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, 86_400)


_ENDS = "trim(line, ' ') = '' OR (" + _KIND_SQL.replace(" h IN", r" lower(trim(regexp_replace(line, '[:\s]+$', ''), ' ')) IN") + ") IS NOT NULL"
_CASES = f"CASE WHEN regexp_matches(line, '{P.RANGE}') AND NOT regexp_matches(line, '{BULLET}') AND len(regexp_extract_all(line, '{WORD}')) <= 18 THEN 1 ELSE 0 END"


@query(
    rf"""WITH l AS ({_LINES}), k AS (SELECT *, {_CASES} AS anchor, {_ENDS} AS ends FROM l),
    j AS (SELECT *, sum(anchor) OVER w AS job_no, sum(CASE WHEN ends AND anchor = 0 THEN 1 ELSE 0 END) OVER w AS closed FROM k WINDOW w AS (PARTITION BY extraction_id ORDER BY line_no)),
    a AS (SELECT extraction_id, job_no, closed AS upto FROM j WHERE anchor = 1)
    SELECT j.extraction_id, CAST(j.job_no AS INTEGER) AS job_no, CAST(count(*) FILTER (WHERE anchor = 0 AND closed = upto) AS INTEGER) AS n_bullets FROM j JOIN a ON j.extraction_id = a.extraction_id AND j.job_no = a.job_no GROUP BY j.extraction_id, j.job_no"""
)
def experience_entries(spark, sf_dir):
    entries = P.experience_entries(_extractions(spark, sf_dir), "extraction_id", "plain_text")
    return entries.select("extraction_id", "job_no", F.size("bullets").alias("n_bullets"))


@query(
    rf"""WITH u AS (SELECT DISTINCT job_id, plain_text FROM job_descriptions WHERE plain_text IS NOT NULL), l AS (SELECT job_id, unnest(t) AS line, generate_subscripts(t, 1) AS line_no FROM (SELECT job_id, regexp_split_to_array(plain_text, '\r?\n') AS t FROM u)),
    k AS (SELECT *, {_KIND_SQL} AS kind FROM (SELECT *, lower(trim(regexp_replace(line, '[:\s]+$', ''), ' ')) AS h FROM l)),
    b AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM k)
    SELECT job_id, block, CAST(row_number() OVER (PARTITION BY job_id ORDER BY line_no) AS INTEGER) AS item_no, trim(regexp_replace(line, '{BULLET}', ''), ' ') AS item FROM b
    WHERE kind IS NULL AND block IN ('duties', 'requirements', 'optional') AND regexp_matches(line, '{BULLET}')"""
)
def vacancy_items(spark, sf_dir):
    return P.vacancy_items(table(spark, sf_dir, "job_descriptions").select("job_id", "plain_text").distinct(), "job_id", "plain_text")


@query(
    r"""SELECT extraction_id, array_to_string(list_filter(['ﬀ', 'ﬁ', 'ﬂ', 'ﬃ', 'ﬄ', 'ﬅ', 'ﬆ', chr(65533)], lambda g: contains(plain_text, g)) || CASE WHEN regexp_matches(plain_text, '[\x{E000}-\x{F8FF}]') THEN ['private-use-area'] ELSE [] END, '|') AS glyphs
    FROM extractions WHERE plain_text IS NOT NULL"""
)
def problem_glyphs(spark, sf_dir):
    return _extractions(spark, sf_dir).where("plain_text is not null").select("extraction_id", F.array_join(L.problem_glyphs(F.col("plain_text")), "|").alias("glyphs"))
