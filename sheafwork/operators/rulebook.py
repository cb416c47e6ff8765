"""The 61 rules as expressions over a row of facts, in SQL that Spark and other engines read alike.

Of each rule: when it is skipped, when it fails, the factor of its penalty (at most 1) and, where it depends on the facts, its severity. A fact that is null neither skips nor fails.
"""

import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from . import rules as R


@dataclass(frozen=True)
class Entry:
    id: str
    dimension: str
    severity: str
    penalty: int
    fails: str
    factor: str = "1.0"
    skip: str = "false"
    graded: str | None = None

    def __post_init__(self) -> None:
        # Numbers with a point as doubles, since Spark reads them as decimals, which it rounds.
        for name in ("fails", "factor", "skip", "graded"):
            if value := getattr(self, name):
                object.__setattr__(self, name, re.sub(r"\d+\.\d+", r"\g<0>e0", value))

    def rule(self) -> R.Rule:
        """The rule as columns."""
        return R.Rule(self.id, self.dimension, self.severity, self.penalty, lambda: R.outcome(F.expr(self.fails), F.expr(self.factor), F.expr(self.graded) if self.graded else None, F.expr(self.skip)))


_share = lambda part, whole="n_bullets": f"coalesce(1.0 * {part} / nullif({whole}, 0), 0)"
_latin = "coalesce(1.0 * latin / nullif(latin + cyrillic, 0), 0)"
_pages = "CASE own_rank WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END"
_hits, _unknown = _share("title_hits", "n_title_words"), _share("unknown_chars", "n_chars")
_older = "(1.0 * (entry_bullets - newest_bullets) / nullif(entries - 1, 0))"
_when = lambda test, yes, no: f"CASE WHEN {test} THEN {yes} ELSE {no} END"

# Severities, penalties and bounds of the rules.
RULEBOOK = (
    Entry("no-text-layer", "parseability", "critical", 100, "NOT has_text_layer"),
    Entry("multi-column-layout", "parseability", "critical", 45, "max_columns > 1"),
    Entry("content-in-tables", "parseability", "major", 30, "tabular > 0", _when("tabular >= 8", "1.0", "0.5"), graded=_when("tabular >= 8", "'major'", "'minor'")),
    Entry("content-in-header-footer", "parseability", "major", 35, "margin_texts > 0", _when("margin_contacts", "1.0", "0.4"), graded=_when("margin_contacts", "'critical'", "'minor'")),
    Entry("text-boxes", "parseability", "major", 30, "text_boxes > 0"),
    Entry("problematic-glyphs", "parseability", "major", 25, "glyphs"),
    Entry("non-standard-fonts", "parseability", "minor", 12, "odd_fonts > 0", "odd_fonts / 3.0", "odd_fonts IS NULL"),
    Entry("links-only-embedded", "parseability", "minor", 15, "hidden_links > 0", skip="hidden_links IS NULL"),
    Entry("heavy-graphics", "parseability", "minor", 10, "images > 2", "images / 8.0"),
    Entry("missing-experience-section", "structure", "critical", 60, "NOT has_experience AND jobs = 0"),
    Entry("missing-contact-email", "structure", "critical", 50, "NOT has_email"),
    Entry("missing-candidate-name", "structure", "major", 30, "NOT has_name"),
    Entry("missing-phone", "structure", "minor", 12, "NOT has_phone"),
    Entry("missing-professional-links", "structure", "major", 25, "NOT (has_linkedin AND has_code)", _when("has_linkedin OR has_code", "0.5", "1.0"), graded=_when("has_linkedin OR has_code", "'minor'", "'major'")),
    Entry("broken-links", "structure", "minor", 10, "dead_link", skip="n_links = 0"),
    Entry("missing-skills-section", "structure", "major", 28, "NOT has_skills"),
    Entry("missing-education-section", "structure", "minor", 12, "NOT has_education"),
    Entry("missing-summary", "structure", "minor", 10, "NOT has_summary"),
    Entry("resume-length", "structure", "minor", 15, f"pages > {_pages}", f"abs(pages - {_pages}) / 2.0", "pages = 0"),
    Entry("reverse-chronological-order", "structure", "major", 22, "inversions > 0", _share("inversions", "dated - 1"), "dated < 2"),
    Entry("experience-without-bullets", "structure", "major", 25, "bare_entries > 0 OR (has_text_layer AND marks = 0)", skip="jobs = 0"),
    Entry("unparsed-job-headers", "structure", "minor", 18, "unsure > 0", _share("unsure", "jobs"), "jobs = 0"),
    Entry("missing-dates-in-experience", "structure", "major", 30, "undated > 0", _share("undated", "jobs"), "jobs = 0"),
    Entry("no-achievements-found", "content", "critical", 100, "n_bullets = 0"),
    Entry("bullets-not-quantified", "content", "critical", 40, f"{_share('quantified')} < 0.5", f"(0.5 - {_share('quantified')}) / 0.5", "n_bullets = 0", _when(f"{_share('quantified')} < 0.2", "'critical'", "'major'")),
    Entry("weak-bullet-openings", "content", "major", 30, "weak > 0", f"{_share('weak')} / 0.4", "n_bullets = 0"),
    Entry("missing-action-verbs", "content", "major", 22, f"{_share('led_by_verb')} < 0.7", f"(0.7 - {_share('led_by_verb')}) / 0.7", "n_bullets < 3"),
    Entry("first-person-narration", "content", "minor", 14, "first_person > 0", f"{_share('first_person')} / 0.3", "n_bullets = 0"),
    Entry("passive-voice", "content", "minor", 14, f"{_share('passive')} >= 0.2", f"{_share('passive')} / 0.5", "n_bullets = 0"),
    Entry("overlong-bullets", "content", "minor", 16, "overlong > 0", f"{_share('overlong')} / 0.3", "n_bullets = 0"),
    Entry("stub-bullets", "content", "minor", 12, "stubs > 0", f"{_share('stubs')} / 0.25", "n_bullets = 0"),
    Entry("cliches", "content", "major", 20, "cliches > 0", "cliches / 5.0"),
    Entry("thin-experience-descriptions", "content", "major", 20, "thin_entries > 0", "1.0 * thin_entries / nullif(least(entries, 2), 0)", "entries = 0"),
    Entry("generic-summary", "content", "minor", 15, "summary_problems > 0", "summary_problems / 2.0", "summary_problems IS NULL"),
    Entry("skills-dumped", "content", "minor", 12, "skill_items > 30", "(skill_items - 30) / 30.0", "NOT has_skills"),
    Entry("keyword-stuffing", "content", "major", 25, "stuffed > 0", "stuffed / 3.0"),
    Entry("missing-required-skills", "keywords", "critical", 45, "missing_required > 0", _share("missing_required", "n_required"), "NOT has_job OR n_required = 0", _when(f"{_share('missing_required', 'n_required')} > 0.4", "'critical'", "'major'")),
    Entry("missing-nice-to-have-skills", "keywords", "info", 10, "missing_optional > 0", _share("missing_optional", "n_optional"), "NOT has_job OR n_optional = 0"),
    Entry("title-mismatch", "keywords", "major", 22, f"{_hits} < 0.5", f"1 - {_hits}", "NOT has_job OR n_title_words = 0", _when("title_hits = 0", "'major'", "'minor'")),
    Entry("acronyms-without-expansion", "keywords", "minor", 10, "unexpanded > 0", "unexpanded / 3.0", "NOT has_job"),
    Entry("seniority-below-vacancy", "keywords", "minor", 15, "own_rank < job_rank", "(job_rank - own_rank) / 2.0", "own_rank = 0 OR job_rank = 0"),
    Entry("unexplained-employment-gaps", "narrative", "major", 22, "longest_gap >= 6", "longest_gap / 24.0", "jobs < 2", _when("longest_gap >= 18", "'major'", "'minor'")),
    Entry("frequent-job-changes", "narrative", "minor", 18, "short_stints >= 2", f"{_share('short_stints', 'jobs')} / 0.5", "jobs < 3"),
    Entry("seniority-mismatch", "narrative", "minor", 16, "(own_rank >= 3 AND total_months < 48) OR (own_rank = 1 AND total_months > 60)", _when("own_rank = 1", "0.5", "1.0"), "total_months = 0 OR own_rank = 0", _when("own_rank = 1", "'info'", "'minor'")),
    Entry("no-career-progression", "narrative", "info", 10, "ranked >= 2 AND newest_rank <= oldest_rank", skip="jobs < 3", graded=_when("newest_rank < oldest_rank", "'minor'", "'info'")),
    Entry("stale-resume", "narrative", "minor", 15, "NOT still AND now_month - last_end >= 8", "(now_month - last_end) / 24.0", "dated = 0 OR (last_end IS NULL AND NOT still)"),
    Entry("no-recent-achievements", "narrative", "minor", 14, f"newest_bullets < {_older}", f"1 - newest_bullets / greatest(1.0, {_older})", "entries < 2 OR newest_bullets = 0"),
    Entry("inconsistent-date-formats", "language", "minor", 16, "formats > 1", "(formats - 1) / 2.0"),
    Entry("inconsistent-bullet-markers", "language", "minor", 10, "marks > 1"),
    Entry("inconsistent-bullet-punctuation", "language", "minor", 8, "n_bullets >= 4 AND stopped >= 2 AND n_bullets - stopped >= 2"),
    Entry("inconsistent-tense", "language", "minor", 12, "mixed_tense"),
    Entry("long-sentences", "language", "minor", 12, f"{_share('sentence_words', 'n_sentences')} > 24 OR long_sentences > 2", "long_sentences / 6.0", "n_sentences = 0"),
    Entry("mixed-languages", "language", "major", 20, f"{_latin} BETWEEN 0.1 AND 0.9 AND NOT ({_latin} > 0.15 AND {_latin} < 0.45)", "0.8"),
    Entry("repeated-phrases", "language", "minor", 12, "most_repeated >= 3", "most_repeated / 6.0", "n_bullets < 4"),
    Entry("unparsed-sections", "language", "minor", 14, f"{_unknown} >= 0.1", f"{_unknown} / 0.4"),
    Entry("protected-personal-data", "international", "major", 35, "n_sensitive > 0", "(2 * n_high + n_sensitive) / 6.0", graded=_when("n_high > 0", "'major'", "'minor'")),
    Entry("salary-expectations-stated", "international", "minor", 15, "salary"),
    Entry("english-level-not-stated", "international", "major", 25, "NOT english_levelled", _when(f"{_latin} > 0.9", "0.4", "1.0"), f"{_latin} > 0.9 AND english_lines = 0", _when(f"{_latin} > 0.9", "'minor'", "'major'")),
    Entry("no-work-authorization-note", "international", "minor", 12, "NOT abroad_note"),
    Entry("local-only-context", "international", "minor", 12, "local_jobs > 0 AND NOT told_industry", _share("local_jobs", "jobs"), "jobs = 0"),
    Entry("non-latin-name-only", "international", "info", 8, "cyrillic_name", skip="NOT has_name OR cyrillic > latin"),
)
RULES = tuple(e.rule() for e in RULEBOOK)
if len({r.id for r in RULES}) != len(RULES):
    raise ValueError("two rules share an id")


def outcome_sql() -> str:
    """Rows (rule_id, dimension, level, severity, status, penalty) of each fact row, for the engine the rules are compared with."""
    level = {s: k for k, s in enumerate(R.SEVERITIES, 1)}
    parts = []
    for e in RULEBOOK:
        status = f"CASE WHEN coalesce({e.skip}, false) THEN 'skip' WHEN coalesce({e.fails}, false) THEN 'fail' ELSE 'pass' END"
        severity = f"coalesce({e.graded}, '{e.severity}')" if e.graded else f"'{e.severity}'"
        parts.append(f"SELECT extraction_id, '{e.id}' AS rule_id, '{e.dimension}' AS dimension, {severity} AS severity, {status} AS status, floor({e.penalty} * least(CAST({e.factor} AS DOUBLE), 1.0) + 0.5) AS full_penalty FROM fact")
    cases = " ".join(f"WHEN '{s}' THEN {k}" for s, k in level.items())
    return f"SELECT *, CASE severity {cases} END AS level, CASE WHEN status = 'fail' THEN CAST(full_penalty AS INTEGER) ELSE 0 END AS penalty FROM (" + " UNION ALL ".join(parts) + ")"


def findings_sql(facts: str) -> str:
    return f"WITH {facts}, o AS ({outcome_sql()}) SELECT extraction_id, CAST(row_number() OVER (PARTITION BY extraction_id ORDER BY level, penalty DESC, rule_id) AS INTEGER) AS place, rule_id, dimension, severity, penalty FROM o WHERE status = 'fail'"


def scores_sql(facts: str) -> str:
    dims = ", ".join(f"CASE WHEN count(*) FILTER (WHERE dimension = '{d}' AND status <> 'skip') > 0 THEN CAST(greatest(100 - sum(penalty) FILTER (WHERE dimension = '{d}'), 0) AS INTEGER) END AS {d}" for d in R.DIMENSIONS)
    total = " + ".join(f"coalesce({d}, 0) * {w}" for d, w in R.DIMENSIONS.items())
    weight = " + ".join(f"CASE WHEN {d} IS NOT NULL THEN {w} ELSE 0 END" for d, w in R.DIMENSIONS.items())
    return f"""WITH {facts}, o AS ({outcome_sql()}), s AS (SELECT extraction_id, {dims} FROM o GROUP BY extraction_id), w AS (SELECT *, CAST(coalesce(floor(({total}) / nullif({weight}, 0) + 0.5), 0) AS INTEGER) AS overall FROM s)
    SELECT *, CASE WHEN overall >= 85 THEN 'excellent' WHEN overall >= 70 THEN 'good' WHEN overall >= 50 THEN 'needs-work' ELSE 'poor' END AS band FROM w"""


def severity_counts_sql(facts: str) -> str:
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE status = 'fail' AND severity = '{s}') AS BIGINT) AS {s}" for s in R.SEVERITIES)
    return f"WITH {facts}, o AS ({outcome_sql()}) SELECT dimension, CAST(count(*) FILTER (WHERE status <> 'skip') AS BIGINT) AS run, CAST(count(*) FILTER (WHERE status = 'skip') AS BIGINT) AS skipped, {counts} FROM o GROUP BY dimension"
