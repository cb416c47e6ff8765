import io
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import documents as O
from sheafwork.operators import layout as L
from sheafwork.operators import parsing as P
from sheafwork.operators import rules as R
from sheafwork.operators import screening as S
from sheafwork.plans import registry
from sheafwork.sources import files, sinks
from sheafwork.streaming import pipeline

TEXT = """Nora Feld
nora@example.org, +44 7700 900123

Summary
I keep calm. I like clear words and short meetings with people.

Experience
Clerk, Holm Foods, 2011-03 - 2015-07
- Sorted 40 letters a day
- Helped the team
Cook, Bay Inn, 2016 to 2018
* Cooked

Skills
Tilbase, Tilbase DB"""


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, TEXT, True, False), (2, None, None, None), (3, "", False, True)], "id int, t string, has_text_layer boolean, has_problematic_glyphs boolean").withColumn("line", F.lit("x"))


def test_sections_and_entries(docs):
    s = [(r.section_no, r.kind) for r in O.sections(docs, "id", "t").where("id = 1").orderBy("section_no").collect()]
    assert s == [(1, "contacts"), (2, "summary"), (3, "experience"), (4, "skills")]
    e = P.experience_entries(docs, "id", "t").orderBy("job_no").collect()
    assert [(r.header, r.bullets) for r in e] == [("Clerk, Holm Foods", ["Sorted 40 letters a day", "Helped the team"]), ("Cook, Bay Inn", ["Cooked"])]
    assert O.sections(docs.limit(0), "id", "t").collect() == []


def test_bullets_contacts_terms(docs):
    b = O.bullet_metrics(docs, "id", "t", ["helped"]).where("id = 1").first()
    assert (b.n_bullets, b.quantified, b.weak, b.stubs, b.marks) == (3, 1, 1, 2, 2)
    c = {r.id: r for r in O.contacts(docs, "id", "t").collect()}
    assert c[1].email == "nora@example.org" and c[1].phone == "+44 7700 900123" and c[3].email is None and c[2].phone is None
    hits = docs.select("id", O.scan_terms(F.col("t"), ["Tilbase", "Tilbase DB", "base"]).alias("h")).where("id = 1").first().h
    assert hits == ["tilbase", "tilbase db"]
    r = docs.where("id = 1").select(O.redact(F.col("t")).alias("r")).withColumn("l", O.leaks(F.col("r"), F.array(F.lit("nora@example.org"), F.lit("Nora Feld")))).first()
    assert r.l == ["Nora Feld"] and "[[EMAIL]]" in r.r and "[[PHONE]]" in r.r


def test_scanned_terms_cover_the_reference(spark, tmp_path):
    text = "Skills: wage accounting, Quorvex suite, route planning; payroll accounting. Gobi"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "extraction_id bigint, plain_text string").write.parquet(str(tmp_path / "extractions.parquet"))
    skills = [("Payroll accounting", ["wage accounting"]), ("Quorvex Suite", None), ("Quorvex", []), ("Route planning", ["tour scheduling"]), ("Go", ["golang"])]
    spark.createDataFrame(skills, "canonical string, aliases array<string>").write.parquet(str(tmp_path / "skill_reference.parquet"))
    got = {r.extraction_id: r.terms for r in registry.queries()["scanned_terms"](spark, str(tmp_path)).collect()}
    assert got == {1: "Payroll accounting|Quorvex Suite|Route planning", 3: ""}


def test_rules_and_scores(docs):
    out = R.evaluate(R.facts(docs, "id", "t", ["helped"], ["clear words"]), "id")
    found = {(r.id, r.rule_id): r for r in R.findings(out, "id").collect()}
    assert (1, "weak-bullet-openings") in found and (1, "missing-contact-email") not in found and (1, "cliches") in found
    assert found[1, "cliches"].penalty == 4 and found[3, "no-text-layer"].place == 2
    scores = {r.id: r for r in R.scores(out, "id").collect()}
    assert scores[1].overall > scores[3].overall and scores[3].parseability == 0 and scores[2].overall <= scores[1].overall
    with pytest.raises(TypeError):
        R.Rule("x")


TABLES = {
    "experience": "exp_id bigint, candidate_id bigint, batch_id bigint, company string, job_title string, confidence double, start_year int, start_month int, end_year int, end_month int, is_current boolean, date_format string",
    "batches": "batch_id bigint, job_id bigint, screened_at timestamp",
    "candidates": "candidate_id bigint, batch_id bigint",
    "job_descriptions": "job_id bigint, job_title string, seniority string, plain_text string",
    "job_skills": "job_id bigint, canonical string, is_required boolean",
}


def write_tables(spark, folder, texts, **rows):
    """The tables of the document pipeline: texts as extractions 0, 1, ..., the others as given or empty."""
    shape = "extraction_id bigint, candidate_id bigint, plain_text string, has_text_layer boolean, has_problematic_glyphs boolean, page_count int"
    spark.createDataFrame([(i, i, t, True, False, 1) for i, t in enumerate(texts)], shape).write.parquet(str(folder / "extractions.parquet"))
    for name, ddl in TABLES.items():
        spark.createDataFrame(rows.get(name, []), ddl).write.parquet(str(folder / f"{name}.parquet"))


def test_rules_use_the_whole_dictionaries(spark, tmp_path):
    assert (len(R.WEAK_OPENINGS), len(R.CLICHES)) == (35, 41)
    texts = ["- Responsible for 3 depots\n- Prepared 4 lists\nA team player", "- Участвовал в 2 проектах\nКоммуникабельный, hard–working", "- Подготовил 5 отчётов\nMy task was clear"]
    write_tables(spark, tmp_path, texts)
    found = {(r.extraction_id, r.rule_id): r.penalty for r in registry.queries()["rule_findings"](spark, str(tmp_path)).collect()}
    own = {k: v for k, v in found.items() if k[1] in ("weak-bullet-openings", "cliches")}
    assert own == {(0, "weak-bullet-openings"): 30, (0, "cliches"): 4, (1, "weak-bullet-openings"): 30, (1, "cliches"): 8}


def test_date_ranges_of_partial_rows(spark, tmp_path):
    texts = [(1, "2019"), (2, "03/2015 - 2017"), (3, "2018 – now"), (4, "now"), (5, None), (6, "05.2011 –")]
    spark.createDataFrame([(*t, None, None, None) for t in texts], "exp_id bigint, raw_text string, start_year int, end_year int, is_current boolean").write.parquet(str(tmp_path / "experience.parquet"))
    got = {r[0]: tuple(r)[1:] for r in registry.queries()["parsed_date_ranges"](spark, str(tmp_path)).collect()}
    assert got[1] == (2019, None, 2019, None, False) and got[2] == (2015, 3, 2017, None, False) and got[3] == (2018, None, None, None, True)
    assert got[4] == (None, None, None, None, True) and sorted(got) == [1, 2, 3, 4, 6]


def test_columns_by_spans_and_margins_of_one_page(spark):
    # One line holds a span in each column; the empty stripe begins left of the middle and reaches into it.
    rows = [(1, 1, i, f"t{i}", 0.05, 0.1 + i * 0.05, 0.9, [(0.02, 0.13), (0.4, 0.5)]) for i in range(9)] + [(1, 1, 50, "12", 0.5, 0.98, 0.02, None), (2, 1, 1, "ab", 0.1, 0.02, 0.1, []), (2, 2, 1, "ab", 0.1, 0.02, 0.1, [])]
    df = spark.createDataFrame(rows, "doc_id int, page int, line_no int, text string, x double, y double, width double, spans array<struct<x:double,width:double>>")
    assert {(r.doc_id, r.page): r.columns for r in L.columns_by_page(df).collect()} == {(1, 1): 2}
    assert L.repeated_margins(df).collect() == []  # a page number and a text of two characters
    number = df.withColumn("text", F.when(F.col("line_no") == 50, "page 3").otherwise(F.col("text")))
    assert L.without_margins(number).count() == len(rows) - 1
    assert L.columns_by_page(df.limit(0)).collect() == [] and L.without_margins(df.limit(0)).collect() == []
    assert spark.range(1).select(L.nonstandard_fonts(F.array(F.lit("DejaVu Sans"), F.lit("Comic Neue"), F.lit("serif"))).alias("f")).first().f == ["Comic Neue"]


def test_numbered_placeholders(spark):
    text = "Ann Lee, ann.lee@example.org, www.lee.example/cv, +44 7700 900123, Ann Lee, bo@example.org"
    df = spark.createDataFrame([(1, text, ["Ann Lee", "ann.lee@example.org", "x", None]), (2, None, ["a"]), (3, "", None)], "id int, t string, v array<string>")
    got = {r.id: r.r for r in df.select("id", O.redact_known(F.col("t"), F.col("v")).alias("r")).collect()}
    assert got[1].text == "[[PII_1]], [[PII_0]], [[URL_3]], [[PHONE_4]], [[PII_1]], [[EMAIL_2]]" and got[1].entries["[[PII_1]]"] == "Ann Lee" and got[1].entries["[[EMAIL_2]]"] == ""
    assert got[2] is None and got[3].text == ""
    back = df.where("id = 1").select(O.restore(F.lit(got[1].text), F.create_map(*[F.lit(x) for e in got[1].entries.items() for x in e])).alias("b")).first().b
    assert back == "Ann Lee, ann.lee@example.org, [[URL_3]], [[PHONE_4]], Ann Lee, [[EMAIL_2]]"


def test_limiter_streams_keys(spark):
    rows = [(k, i, f"2024-01-01 00:00:{s:02d}") for k in (1, 2, None) for i, s in enumerate((0, 3, 5, 9, 10, 11, 30))]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ts string").selectExpr("user_id", "event_id", "cast(ts as timestamp) as ts")
    got = {(r.user_id, r.event_id): r.allowed for r in S.fixed_windows(df, "user_id", "ts", "event_id", 2, 10).collect()}
    for k in (1, 2, None):
        assert [got[k, i] for i in range(7)] == [True, True, False, False, True, True, True]
    assert S.fixed_windows(df.limit(0), "user_id", "ts", "event_id", 2, 10).collect() == []


def test_vacancy(spark):
    df = spark.createDataFrame([(1, "Clerk\n\nRequirements\n- Tilbase\n- QVX\n\nNice to have\n* cooking\n\nAbout\nbye"), (2, None)], "job_id int, t string")
    assert [(r.block, r.item_no, r.item) for r in P.vacancy_items(df, "job_id", "t").collect()] == [("requirements", 1, "Tilbase"), ("requirements", 2, "QVX"), ("optional", 3, "cooking")]


def test_screening(spark):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, "=1+1"), (3, None), (4, "-x,")], "id int, t string")
    assert [r.l for r in df.select(S.csv_line(F.col("id"), F.col("t")).alias("l")).collect()] == ['1,"a,""b"""', "2,'=1+1", "3,", "4,\"'-x,\""]
    one = spark.range(1)
    total = one.select(S.rank_total(F.lit(0.5), F.lit(70), F.lit(60), F.lit(True)).alias("x"), S.rank_total(F.lit(0.5), F.lit(None).cast("int"), F.lit(60), F.lit(False)).alias("y")).first()
    assert (total.x, total.y) == (57, 60)
    spans = one.select(S.merge_spans(F.expr("array(struct(5 as start, 9 as end), struct(0 as start, 2 as end), struct(8 as start, 12 as end), cast(null as struct<start:int,end:int>))")).alias("s")).first().s
    assert [tuple(x) for x in spans] == [(0, 2), (5, 12)]


def test_layout(spark):
    lines = [(1, 1, i, f"l{i}", 0.05, 0.1 + i * 0.02, 0.35) for i in range(10)] + [(1, 1, 20 + i, f"r{i}", 0.55, 0.1 + i * 0.02, 0.35) for i in range(10)]
    lines += [(1, p, 99, "Nora Feld  CV", 0.1, 0.02, 0.2) for p in (1, 2)] + [(1, p, 98, f"Page {p} of 2", 0.1, 0.97, 0.2) for p in (1, 2)] + [(2, 1, i, "x", 0.1, 0.1 + i * 0.02, 0.8) for i in range(12)]
    df = spark.createDataFrame(lines, "doc_id int, page int, line_no int, text string, x double, y double, width double")
    assert {(r.doc_id, r.page): r.columns for r in L.columns_by_page(df).collect()}[1, 1] == 2
    assert {(r.doc_id, r.page): r.columns for r in L.columns_by_page(df).collect()}[2, 1] == 1
    assert [(r.sample, r.pages) for r in L.repeated_margins(df).collect()] == [("Nora Feld  CV", 2)]
    assert L.without_margins(df).count() == len(lines) - 2
    runs = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.1, "a"), (1, 1, 0.21, 0.101, 0.1, "b"), (1, 1, 0.6, 0.1, 0.1, "c"), (1, 1, 0.1, 0.2, 0.1, "d"), (1, 1, 0.1, 0.22, 0.1, "e")], "doc_id int, page int, x double, y double, width double, text string")
    made = L.lines_from_runs(runs)
    assert [r.text for r in made.orderBy("line_no").collect()] == ["a b\tc", "d", "e"]
    assert L.plain_text(made).first().plain_text == "a b\tc\nd\ne" or "\n\n" in L.plain_text(made).first().plain_text


def pdf(text_lines, compress, encrypted=False):
    content = ("BT /F1 12 Tf 72 700 Td " + " ".join(f"({t}) Tj 0 -14 Td" for t in text_lines) + " ET").encode()
    body = zlib.compress(content) if compress else content
    parts = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj"]
    parts += [b"3 0 obj << /Type /Page /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj"]
    parts += [b"4 0 obj << /Length %d %s>> stream\n" % (len(body), b"/Filter /FlateDecode " if compress else b"") + body + b"\nendstream endobj", b"5 0 obj << /Type /Font /BaseFont /Helvetica >> endobj"]
    return b"\n".join([*parts, b"trailer << /Root 1 0 R " + (b"/Encrypt 9 0 R " if encrypted else b"") + b">>"])


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, more="": f"<w:p><w:pPr>{more}</w:pPr><w:r><w:rPr><w:rFonts w:ascii='Arial'/></w:rPr><w:t>{t}</w:t></w:r></w:p>"
    body = p("Nora Feld " * 9) + p("Sorted letters", "<w:numPr/>") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_sources(spark, tmp_path):
    long = ["Nora Feld has worked here for years and years", "and nobody could say anything against it at all (really)".replace("(", "").replace(")", "")]
    for name, data in {
        "a.txt": ("Nora\r\n" * 40).encode(), "b.docx": docx(), "c.pdf": pdf(long, True), "d.pdf": pdf(long, False, True), "e.pdf": b"no", "f.docx": b"broken", "g.doc": b"old", "h.md": b"short", "i.pdf": pdf(long, False),
    }.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].error is None and got["b.docx"].error is None and "• Sorted letters" in got["b.docx"].plain_text and "a   b" in got["b.docx"].plain_text and got["b.docx"].fonts == ["Arial"]
    assert got["c.pdf"].plain_text.split("\n") == long == got["i.pdf"].plain_text.split("\n") and got["c.pdf"].fonts == ["Helvetica"]
    assert [got[n].error for n in ("d.pdf", "e.pdf", "f.docx", "g.doc", "h.md")] == ["encrypted-document", "extraction-failed", "extraction-failed", "unsupported-format", "empty-document"]


def test_sinks(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "=a")], "g int, o int, t string")
    assert sinks.csv_text(df, "g", "o", ["o", "t"], ["made by us"]).first().csv == "﻿# made by us\r\no,t\r\n1,'=a\r\n2,b\r\n"


def test_limiter(spark):
    events = [(1, 1, 0), (1, 2, 10), (1, 3, 20), (1, 4, 61), (2, 5, 5)]
    df = spark.createDataFrame(events, "user_id bigint, event_id bigint, s int").selectExpr("user_id", "event_id", "timestamp_seconds(1700000000 + s) as ts")
    want = {(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True), (2, 5, True)}
    assert {tuple(r) for r in S.fixed_windows(df, "user_id", "ts", "event_id", 2, 60).collect()} == want


def test_limiter_on_a_stream(spark, tmp_path):
    events = [(1, 1, 0), (1, 2, 10), (1, 3, 20), (1, 4, 61), (2, 5, 5)]
    df = spark.createDataFrame(events, "user_id bigint, event_id bigint, s int").selectExpr("user_id", "event_id", "timestamp_seconds(1700000000 + s) as ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = pipeline.limited_stream(pipeline.stream_table(spark, str(tmp_path / "in"), df), "user_id", "ts", "event_id", 2, 60)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    # With a timeout set the query never rests, so it is stopped when the rows are there.
    for _ in range(60):
        time.sleep(1)
        got = {tuple(r) for r in spark.table("limited").collect()}
        if len(got) == len(events):
            break
    q.stop()
    assert got == {(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True), (2, 5, True)}


def test_scores_of_a_stream_equal_the_batch(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pipeline.scored_stream(pipeline.stream_table(spark, str(tmp_path / "in"), docs), "id", "t", ["helped"], ["clear words"])
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    batch = R.scores(R.evaluate(R.facts(docs, "id", "t", ["helped"], ["clear words"]), "id"), "id")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))


def test_registry_without_text_subpackage():
    assert "p1_found" in registry.queries() and set(registry.oracles()) <= set(registry.queries())


STRONG = """Nora Feldway
Senior Software Engineer
nora.feldway@example.org | +44 7700 900123 | https://github.com/nfeldway | https://linkedin.com/in/nfeldway
Open to relocation

Summary
Engineer who cut the cost of payments by 30% for two banks and led a team of 12 people through a rebuild of the ledger.

Experience
Senior Engineer, Ledger Bank, 2020-01 - present
- Reduced settlement time by 45% for 3 markets
- Built 14 services in Kotlin
- Led 12 engineers across 2 offices
Engineer, Payport Group, 2016-02 - 2019-12
- Improved throughput from 200 to 900 orders
- Launched 5 products in 4 countries
- Automated 80% of the tests

Education
Rosten University, Bachelor of Science, 2012 - 2016

Skills
Kotlin, SQL, Kafka

Languages
English - C1"""
WEAK = """Виктор Петрович
тел 8 900 000 47 83, дата рождения 01.02.1980, женат
ответственный, коммуникабельный, hard worker
- занимался отчётами
- отвечал за склад
- помогал коллегам
* работал с клиентами"""


def test_a_strong_document_beats_a_weak_one(spark, tmp_path):
    roles = [(1, 0, 1, "Ledger Bank", "Senior Engineer", 0.95, 2020, 1, None, None, True, "iso"), (2, 0, 1, "Payport Group", "Engineer", 0.95, 2016, 2, 2019, 12, False, "iso")]
    import datetime

    more = {"experience": roles, "batches": [(1, 7, datetime.datetime(2024, 5, 1))], "candidates": [(0, 1), (1, 1)]}
    more |= {"job_descriptions": [(7, "Senior Software Engineer", "senior", "We look for a senior engineer who knows Kotlin and Kafka well.")], "job_skills": [(7, "Kotlin", True), (7, "Rust", True), (7, "Kafka", False)]}
    write_tables(spark, tmp_path, [STRONG, WEAK, None, ""], **more)
    q = registry.queries()
    scores = {r.extraction_id: r for r in q["document_scores"](spark, str(tmp_path)).collect()}
    assert scores[0].overall > scores[1].overall + 20 and scores[0].overall > 60 and scores[1].overall < 65 and len(scores) == 4
    found = {(r.extraction_id, r.rule_id) for r in q["rule_findings"](spark, str(tmp_path)).collect()}
    assert {(0, "missing-required-skills"), (1, "protected-personal-data"), (1, "cliches"), (1, "weak-bullet-openings"), (1, "missing-contact-email")} <= found
    assert not {(0, "missing-contact-email"), (0, "title-mismatch"), (0, "missing-candidate-name"), (0, "missing-professional-links"), (0, "missing-nice-to-have-skills"), (0, "seniority-below-vacancy")} & found
    contact = {r.extraction_id: r for r in q["contact_blocks"](spark, str(tmp_path)).collect()}[0]
    assert (contact.name, contact.email, contact.headline, contact.link_kinds) == ("Nora Feldway", "nora.feldway@example.org", "Senior Software Engineer", "github|linkedin") and contact.phone.startswith("+44") and contact.location == "Open to relocation"
    kinds = [r.kind for r in q["section_map"](spark, str(tmp_path)).where("extraction_id = 0").orderBy("section_no").collect()]
    assert kinds == ["contacts", "summary", "experience", "education", "skills", "languages"]
    career = q["career_metrics"](spark, str(tmp_path)).collect()[0]
    assert (career.jobs, career.total_months, career.gaps, career.inversions, career.seniority, career.progression) == (2, 47 + 53, 0, 0, "senior", "unclear")


def test_client_keys_sorts_and_excerpts(spark):
    rows = [(1, {"x-forwarded-for": " 10.0.0.1 , 10.0.0.2", "x-real-ip": "9.9.9.9"}), (2, {"x-forwarded-for": "", "x-real-ip": "9.9.9.9"}), (3, {}), (4, None)]
    df = spark.createDataFrame(rows, "id int, h map<string,string>")
    assert [r.k for r in df.orderBy("id").select(S.client_key(F.col("h")).alias("k")).collect()] == ["10.0.0.1", "9.9.9.9", "unknown", "unknown"]
    assert S.toggle_sort(("rank", "desc"), "rank") == ("rank", "asc") and S.toggle_sort(("rank", "asc"), "name") == ("name", "asc") and S.toggle_sort(("name", "asc"), "flags") == ("flags", "desc")
    spans = F.expr("array(struct(0 as start, 12 as end), cast(null as struct<start:int,end:int>), struct(0 as start, 12 as end), struct(3 as start, 5 as end), struct(10 as start, 99 as end))")
    got = spark.createDataFrame([("Reduced cost by 30 percent",), (None,)], "t string").select(S.excerpts(F.col("t"), spans).alias("e")).collect()
    assert got[0].e == ["Reduced cost", "st by 30 percent"] and got[1].e is None


def test_shortlist_cells(spark):
    from sheafwork.sources import sinks

    shape = "batch_id int, place int, candidate_name string, file_name string, headline string, email string, city string, matched_required array<string>, missing_required array<string>, job_match_score int, overall_score int, total int, experience_months int, seniority string, critical_count int, major_count int, flags array<string>"
    rows = [(1, 1, None, "c.pdf", None, "=a@b.example", None, ["x"], ["y", "z"], None, 50, 47, 14, "senior", 0, 2, ["employment-gap"]), (1, 2, "Ann, Lee", "d.pdf", "Cook", None, "Velm", None, None, 9, 40, 40, 0, "unknown", 1, 0, None)]
    df = spark.createDataFrame(rows, shape)
    with_job, without = sinks.shortlist_rows(df, True), sinks.shortlist_rows(df, False)
    assert len(with_job.columns) == 18 and len(without.columns) == 14
    first = with_job.where("place = 1").first()
    assert first["Покрытие требований"] == "1/3 (33%)" and first["Кандидат"] == "c.pdf" and first["Опыт"] == "1 y 2 mo" and first["Совпадение с вакансией"] == ""
    text = sinks.csv_text(without, "batch_id", "place", without.columns[2:], ["list"]).first().csv
    assert text.startswith("\ufeff# list\r\nПозиция,") and '2,"Ann, Lee",Cook,,Velm,40,40,,,1,0,\r\n' in text and "'=a@b.example" in text
