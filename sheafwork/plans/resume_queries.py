"""The document pipeline over whole tables, with the same plans for the engine they are compared with."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rulebook, rules, screening
from ..session import table
from . import resume_parsers as parsers
from . import resume_plan as plan
from .dialect import OTHER, SPARK

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_TABLE = re.compile(r"@(\w+)@")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A plan over the tables of a folder, which stand in it as @name@."""
    for name in set(_TABLE.findall(sql)):
        table(spark, sf_dir, name).createOrReplaceTempView(f"sheafwork_{name}")
    return spark.sql(_TABLE.sub(r"sheafwork_\1", sql))


def planned(name: str, build) -> None:
    """Register a query whose plan is the same text in both dialects."""

    def call(spark, sf_dir):
        return run(spark, sf_dir, build(SPARK))

    call.__name__, call.__doc__ = name, build.__doc__
    QUERIES[name] = call
    ORACLES[name] = _TABLE.sub(r"\1", build(OTHER))


planned("section_map", plan.sections)
planned("contact_blocks", plan.contact_rows)
planned("contact_links", plan.link_rows)
planned("career_metrics", plan.career_rows)
planned("document_facts", plan.fact_rows)
planned("candidate_summaries", plan.summaries)
planned("role_headers", parsers.entries)
planned("undated_roles", parsers.undated_entries)
planned("education_entries", parsers.education)
planned("certificates", parsers.certificates)
planned("spoken_languages", parsers.languages)
planned("projects", parsers.projects)
planned("listed_skills", parsers.skills)
planned("vacancy_lines", parsers.vacancy_lines)
planned("vacancy_profiles", parsers.vacancy_profiles)
planned("vacancy_skills", parsers.vacancy_skills)
planned("opening_words", parsers.openings)
planned("section_coverage", parsers.coverage)
planned("found_date_ranges", parsers.found_ranges)
planned("parse_accuracy", parsers.accuracy)
planned("sorted_candidates", parsers.windows_by_key)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(run(spark, sf_dir, plan.fact_rows(SPARK)), "extraction_id", rulebook.RULES)


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all 61 rules, by severity, penalty and id."""
    return rules.findings(_outcomes(spark, sf_dir), "extraction_id")


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the seven dimensions, the overall score and its band."""
    return rules.scores(_outcomes(spark, sf_dir), "extraction_id").withColumn("band", screening.band(F.col("overall")))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules run and skipped, and findings by severity, of each dimension."""
    o = _outcomes(spark, sf_dir).select(F.explode("outcomes").alias("o")).select("o.*")
    failed = lambda s: F.count_if((F.col("status") == "fail") & (F.col("severity") == s)).alias(s)
    return o.groupBy("dimension").agg(F.count_if(F.col("status") != "skip").alias("run"), F.count_if(F.col("status") == "skip").alias("skipped"), *[failed(s) for s in rules.SEVERITIES])


_FACTS = _TABLE.sub(r"\1", plan.facts(OTHER))
for _query, _sql in ((rule_findings, rulebook.findings_sql), (document_scores, rulebook.scores_sql), (rule_counts, rulebook.severity_counts_sql)):
    QUERIES[_query.__name__] = _query
    ORACLES[_query.__name__] = _sql(_FACTS)
