"""All queries outside the text subpackage, with the SQL they are compared with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_queries, problems, resume_queries, text_queries

MODULES = (problems, text_queries, document_queries, resume_queries)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        for name, value in getattr(module, attribute).items():
            if name in merged:
                raise ValueError(f"query registered twice: {name}")
            merged[name] = value
    return merged


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extraction scored by the rules, worst first."""
    return resume_queries.document_scores(spark, sf_dir).orderBy("overall", "extraction_id")
