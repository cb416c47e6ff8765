"""Queries of the text problems and, where SQL can express them over whole tables, their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import bpe, canonical, language, lookalike, mixing, names, personal, quality


def _p4(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    skills = table(spark, sf_dir, "job_skills")
    missing = table(spark, sf_dir, "candidates").select("candidate_id", F.posexplode("missing_required").alias("p", "value"))
    cells = missing.select(F.lit("missing_required").alias("field"), F.col("candidate_id").alias("record_id"), (F.col("p") + 1).cast("int").alias("pos"), "value")
    for field in ("raw_phrase", "canonical"):
        cells = cells.unionByName(skills.select(F.lit(field).alias("field"), F.col("job_id").alias("record_id"), F.col("skill_no").cast("int").alias("pos"), F.col(field).alias("value")))
    reference = table(spark, sf_dir, "skill_reference").select(F.col("skill_id").alias("id"), F.col("canonical").alias("name"), "aliases")
    return cells, reference


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_field_values(*_p4(spark, sf_dir))


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct value with the entry it means and the number of entries that are equally near."""
    cells, reference = _p4(spark, sf_dir)
    return canonical.map_values(cells.select("value"), reference)


P5_FIELDS = (("plain_text", "extractions", "extraction_id", False), ("candidate_name", "candidates", "candidate_id", True), ("email", "candidates", "candidate_id", True))


def _p5(spark: SparkSession, sf_dir: str) -> tuple[personal.Finder, list[tuple[str, str, bool, DataFrame]]]:
    fields, texts, wholes = [], None, []
    for field, name, key, whole in P5_FIELDS:
        df = table(spark, sf_dir, name)
        if whole:  # re-delivered rows are equal
            df = df.dropDuplicates([key])
            wholes.append(_p5_rows(df, key, field, True).withColumns({"n": F.lit(None).cast("string"), "e": F.lit(None).cast("string")}))
        else:
            own = table(spark, sf_dir, "candidates").groupBy("candidate_id").agg(F.max("candidate_name").alias("n"), F.max("email").alias("e"))
            texts = _p5_rows(df, key, field, False, "candidate_id").join(own, "candidate_id", "left")
        fields.append((field, key, whole, df.select(key, field)))
    return personal.train(personal.Rows(texts, wholes[0].unionByName(wholes[1]))), fields


def _p5_rows(df: DataFrame, key: str, field: str, whole: bool, *more: str) -> DataFrame:
    """Rows to learn from and to find in; the number k spreads them over those held back and those without captions, however the table is partitioned."""
    return df.select(*more, F.col(field).alias("v"), F.lit(whole).alias("whole"), F.pmod(F.xxhash64(key), F.lit(30)).cast("int").alias("k"), F.lit(field).alias("field"), F.col(key).alias("id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    finder, _ = _p5(spark, sf_dir)
    return personal.find_proposed(finder).select("field", F.col("id").alias("record_id"), "pii_type", "start_at")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with a typed placeholder for each occurrence."""
    finder, fields = _p5(spark, sf_dir)
    parts = [personal.redact_column(df, field, "redacted", finder, whole).select(F.lit(field).alias("field"), F.col(key).alias("record_id"), "redacted") for field, key, whole, df in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "candidates").select(F.lit("person").alias("kind"), "batch_id", F.col("candidate_id").alias("id"), F.col("candidate_name").alias("value"))
    firms = table(spark, sf_dir, "experience").select(F.lit("company").alias("kind"), "batch_id", F.col("exp_id").alias("id"), F.col("company").alias("value"))
    return people.unionByName(firms)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_links(_p6(spark, sf_dir)).withColumnRenamed("kind", "entity_kind")


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links between distinct values of a batch, not expanded to rows."""
    return names.value_links(_p6(spark, sf_dir)).withColumnRenamed("kind", "entity_kind")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_column(docs, "text").select("doc_id", "ids")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document's text as read back from its ids: encoding and decoding lose nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.decode_column(bpe.encode_column(docs, "text"), "ids", "back").select("doc_id", F.md5("back").alias("digest"))


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every text (para_no 0) and every prose paragraph of extractions and vacancies."""
    texts = table(spark, sf_dir, "extractions").select("extraction_id", "plain_text", "declared_lang")
    jobs = table(spark, sf_dir, "job_descriptions").select("job_id", "plain_text", "declared_lang").dropDuplicates(["job_id"])
    found = language.train(language.sample_rows(texts, "extraction_id", "plain_text", "declared_lang"))
    parts = [
        language.languages(df, key, "plain_text", "declared_lang", found).select(F.lit(kind).alias("record_kind"), F.col("id").alias("record_id"), "para_no", "lang", "confidence", "agrees")
        for kind, df, key in (("extraction", texts, "extraction_id"), ("job", jobs, "job_id"))
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_languages(spark, sf_dir).where(~F.col("agrees")).select("record_kind", "record_id", "para_no", "lang")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    extractions = table(spark, sf_dir, "extractions")
    pairs = lookalike.same_look_pairs(extractions.select("extraction_id", "plain_text"), "extraction_id", "plain_text")
    glyphs = lookalike.same_look_entries(
        extractions.select("extraction_id", "problematic_glyph_samples"), "extraction_id", "problematic_glyph_samples", table(spark, sf_dir, "skill_reference"), "skill_id", "canonical"
    )
    return pairs.select(F.lit("plain_text").alias("field"), "left_id", "right_id", F.lit(0).alias("pos")).unionByName(
        glyphs.select(F.lit("glyph_sample").alias("field"), "left_id", "right_id", "pos")
    )


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of p3_found as classes: one row an extraction with its class and its number of links."""
    texts = table(spark, sf_dir, "extractions").select("extraction_id", "plain_text")
    return lookalike.same_look_classes(texts, "extraction_id", "plain_text").withColumnRenamed("id", "extraction_id")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed set: a row for each use of a document, with its tokens by byte_bpe_50k, its shard and its place there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").where("source is not null")
    targets = table(spark, sf_dir, "mix_targets")
    listed = docs.join(targets.select(F.col("source_name").alias("source")), "source", "left_semi")
    sized = bpe.encode_column(listed, "text").select("doc_id", "source", F.size("ids").alias("n_tokens"))
    return mixing.mix(cut(sized), targets, "doc_id", "source", "n_tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "source", "n_tokens")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, class and calibrated probability of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, "doc_id", "text", quality.train_on(docs, "doc_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_statistics(spark, sf_dir).where("text_class != 'prose'").select("doc_id", "text_class")


QUERIES = {"p2_found": p2_found, "p2_languages": p2_languages, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_values": p4_values, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_values": p6_values, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_statistics": p9_statistics}
ORACLES: dict[str, str] = {"p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"}
