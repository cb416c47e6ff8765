"""Parsers of sections and vacancies as SQL for a dialect: roles with their headers, schools, certificates, languages, skills, projects, and the blocks of a vacancy."""

from ..functions import vocabulary as V
from .dialect import Dialect
from .resume_plan import BULLET, EMAIL, RANGE, documents

_DATED = "(?i)" + RANGE


def _first(d: Dialect, places: str) -> str:
    return f"coalesce({d.get(places, '1')}, 0)"


def _agg_lines(d: Dialect, text: str, order: str, keep: str) -> str:
    """Text of the kept rows of a group as an array in order; a group is the header of one role, which its word limits bound."""
    if d.spark:
        return f"transform(array_sort(collect_list(CASE WHEN {keep} THEN named_struct('o', {order}, 't', {text}) END)), v -> v.t)"
    return f"list({text} ORDER BY {order}) FILTER (WHERE {keep})"


def _line_rows(d: Dialect) -> str:
    return f"""{documents(d)},
    line AS (SELECT * FROM (SELECT extraction_id, {d.explode('x', 'txt', 'i')} FROM doc) WHERE i IS NOT NULL),
    flag AS (SELECT *, {d.trim('txt')} = '' AS blank, {d.like('txt', BULLET)} AS bullet, {d.like('lower(txt)', RANGE)} AS dated, {d.word_count('txt')} AS wc FROM line),
    anchored AS (SELECT *, dated AND NOT bullet AND wc <= 18 AS anchor, blank OR bullet OR dated OR wc > 12 AS stops FROM flag)"""


def _header_columns(d: Dialect) -> str:
    """From an array h of header lines: title, company, location and confidence."""
    return f"""
    pieces AS (SELECT *, {d.filter(d.map(d.split(d.join('h', ' | '), V.HEADER_SEPARATOR), 'y', d.squish('y')), 'y', 'length(y) BETWEEN 2 AND 90')} AS fs FROM stripped),
    located AS (SELECT *, {d.get(d.filter('fs', 'y', d.words('lower(y)', V.WORKPLACE)), '1')} AS location FROM pieces),
    remaining AS (SELECT *, {d.let(lambda m: d.filter('fs', 'y', f"{m} IS NULL OR y <> {m}"), m1='location')} AS r FROM located),
    folded AS (SELECT *, {d.map('r', 'y', d.norm('y'))} AS rn FROM remaining),
    judged AS (SELECT *, {d.let(lambda m: d.filter(d.upto(d.size('r')), 'j', d.like(d.get(m, 'j'), _any(V.TITLE_WORDS))), m1='rn')} AS titled, {d.let(lambda m: d.filter(d.upto(d.size('r')), 'j', d.like(d.get(m, 'j'), rf'(?:^|\s|")(?:{_any(V.COMPANY_MARKERS)})(?:$|\s|\.)')), m1='rn')} AS firmed FROM folded),
    picked AS (SELECT *, {_first(d, 'titled')} AS ti, {_first(d, 'firmed')} AS ci FROM judged),
    header AS (SELECT *, CASE WHEN ti > 0 THEN {d.get('r', 'ti')} WHEN ci > 0 THEN {d.get('r', 'CASE WHEN ci = 1 THEN 2 ELSE 1 END')} ELSE {d.get('r', '1')} END AS title,
      CASE WHEN ci > 0 AND ti <> ci THEN {d.get('r', 'ci')} WHEN ti > 0 THEN {d.get('r', 'CASE WHEN ti = 1 THEN 2 ELSE 1 END')} WHEN ci > 0 THEN {d.get('r', 'ci')} ELSE {d.get('r', '2')} END AS company,
      CASE WHEN {d.size('fs')} = 0 THEN 0.2e0 WHEN ti > 0 AND ci > 0 AND ti <> ci THEN 0.95e0 WHEN ti > 0 OR ci > 0 THEN 0.75e0 WHEN {d.size('r')} >= 2 THEN 0.45e0 ELSE 0.3e0 END AS confidence FROM picked)"""


def _any(words: str) -> str:
    return "|".join(w.replace(".", r"\.") for w in words.split("|"))


def entries(d: Dialect) -> str:
    """(extraction_id, job_no, title, company, location, dates, n_bullets, confidence): roles of each text, anchored at lines with a range of dates.

    The header of a role reaches up over the undated lines right above; what follows down to the next header is its body. Windows over the lines of a text; no role is collected but its header.
    """
    by = "PARTITION BY extraction_id ORDER BY i"
    return f"""WITH {_line_rows(d)},
    above AS (SELECT *, coalesce(max(CASE WHEN stops THEN i END) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS top FROM anchored),
    owned AS (SELECT *, min(CASE WHEN anchor THEN top END) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_top, count(CASE WHEN anchor THEN 1 END) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM above),
    numbered AS (SELECT *, seen + CASE WHEN NOT anchor AND i >= next_top THEN 1 ELSE 0 END AS job_no, (anchor OR i >= next_top) AND NOT blank AND NOT bullet AS in_header FROM owned),
    grouped AS (SELECT extraction_id, job_no, {_agg_lines(d, 'txt', 'i', 'in_header')} AS raw, count(CASE WHEN bullet THEN 1 END) AS marked, count(CASE WHEN NOT in_header AND NOT blank AND wc >= 4 THEN 1 END) AS told,
      max(CASE WHEN anchor THEN {d.extract('txt', _DATED)} END) AS dates FROM numbered WHERE job_no > 0 GROUP BY extraction_id, job_no),
    stripped AS (SELECT *, {d.map('raw', 'y', d.squish(d.replace(d.replace(d.replace('y', _DATED, ' '), r'\((?:\s*|\s*\d{4}\s*)\)', ' '), r'(?:19|20)\d{2}', ' ')))} AS h FROM grouped),
    {_header_columns(d)}
    SELECT extraction_id, {d.integer('job_no')} AS job_no, title, company, location, dates, {d.integer('CASE WHEN marked > 0 THEN marked ELSE told END')} AS n_bullets, confidence FROM header"""


def undated_entries(d: Dialect) -> str:
    """(extraction_id, job_no, title, company, n_bullets, confidence): roles of texts whose experience has no dates; each line without a bullet begins one."""
    return f"""WITH {_line_rows(d)},
    dateless AS (SELECT extraction_id FROM anchored GROUP BY extraction_id HAVING max(CASE WHEN anchor THEN 1 ELSE 0 END) = 0),
    kept AS (SELECT a.* FROM anchored a JOIN dateless n ON a.extraction_id = n.extraction_id WHERE NOT blank),
    numbered AS (SELECT *, count(CASE WHEN NOT bullet THEN 1 END) OVER (PARTITION BY extraction_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS job_no FROM kept),
    stripped AS (SELECT extraction_id, job_no, {_agg_lines(d, 'txt', 'i', 'NOT bullet')} AS h, count(CASE WHEN bullet THEN 1 END) AS n FROM numbered WHERE job_no > 0 GROUP BY extraction_id, job_no),
    {_header_columns(d)}
    SELECT extraction_id, {d.integer('job_no')} AS job_no, title, company, {d.integer('n')} AS n_bullets, least(confidence, 0.4e0) AS confidence FROM header"""


def _blocks(d: Dialect, kind: str) -> str:
    """CTE block: (extraction_id, i, blk) pieces between blank lines of a kind of sections."""
    body = d.join(d.map(d.filter("s", "z", f"z.kind = '{kind}'"), "z", "z.body"), "\n\n")
    return f"""{documents(d)},
    bodies AS (SELECT extraction_id, {body} AS body FROM doc),
    pieces_ AS (SELECT * FROM (SELECT extraction_id, {d.explode(d.filter(d.split('body', r'\n[ \t]*\n'), 'y', d.like('y', chr(92) + 'S')), 'blk', 'i')} FROM bodies) WHERE i IS NOT NULL)"""


def education(d: Dialect) -> str:
    """(extraction_id, entry_no, institution, degree, field, dates): blocks of the education sections that name a school or a degree."""
    degree = "CASE " + " ".join(f"WHEN {d.words('lower(blk)', words)} THEN {d.text(label)}" for label, words in V.DEGREES) + " END"
    school = d.get(d.filter(d.map(d.split("blk", r"\n"), "y", d.squish("y")), "y", d.like(d.norm("y"), _any(V.SCHOOLS))), "1")
    return f"""WITH {_blocks(d, 'education')},
    schooled AS (SELECT *, {school} AS institution, {degree} AS degree, {d.squish(d.extract('blk', V.STUDY_FIELD, 1))} AS field, {d.extract('blk', _DATED)} AS dates FROM pieces_ WHERE length(blk) >= 4)
    SELECT extraction_id, {d.integer('i + 1')} AS entry_no, institution, degree, left(field, 90) AS field, dates FROM schooled WHERE institution IS NOT NULL OR degree IS NOT NULL"""


def certificates(d: Dialect) -> str:
    """(extraction_id, line_no, certificate): lines of 7 to 159 characters in certificate and education sections that name a certificate, or in the former a year; at most 30 a text, as the parser does."""
    body = d.join(d.map(d.filter("s", "z", "z.kind IN ('certifications', 'education')"), "z", "z.body"), "\n")
    return f"""WITH {documents(d)}, bodies AS (SELECT extraction_id, {body} AS body FROM doc),
    rows_ AS (SELECT * FROM (SELECT extraction_id, {d.explode(d.split('body', chr(92) + 'n'), 'txt', 'i')} FROM bodies) WHERE i IS NOT NULL),
    named AS (SELECT extraction_id, i, {d.squish(d.replace('txt', r'^\s*[•·◦*\-–]\s*', ''))} AS certificate FROM rows_),
    kept AS (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY i) AS k FROM named WHERE length(certificate) > 6 AND length(certificate) < 160 AND ({d.words('lower(certificate)', V.CERTIFICATES)} OR {d.like('certificate', r'(?:^|[^0-9A-Za-z_])(?:19|20)\d{2}(?:$|[^0-9A-Za-z_])')}))
    SELECT extraction_id, {d.integer('i + 1')} AS line_no, certificate FROM kept WHERE k <= 30"""


def languages(d: Dialect) -> str:
    """(extraction_id, language, level): languages named anywhere in a text's lines with a level, or in its languages section; the first mention counts."""
    names = " UNION ALL ".join(f"SELECT {d.text(lang)} AS language, {d.text(alias)} AS alias" for lang, words in V.LANGUAGE_NAMES.items() for alias in words.split("|"))
    cefr = d.extract("txt", r"(?:^|[^A-Za-z0-9_])([ABC][12])(?:$|[^A-Za-z0-9_])", 1)
    level = d.extract("lower(txt)", rf"(?:^|[^\p{{L}}\p{{N}}])({_any(V.LEVELS)})(?:$|[^\p{{L}}\p{{N}}])", 1)
    return f"""WITH {documents(d)}, names AS ({names}),
    rows_ AS (SELECT * FROM (SELECT extraction_id, {d.explode(d.split('t', r'\n|;'), 'txt', 'i')} FROM doc) WHERE i IS NOT NULL),
    levelled AS (SELECT extraction_id, i, {d.norm('txt')} AS folded, coalesce({cefr}, {level}) AS level FROM rows_ WHERE {d.like('lower(txt)', _any('|'.join(V.LANGUAGE_NAMES.values())))}),
    met AS (SELECT extraction_id, language, level, i FROM levelled JOIN names ON contains(folded, alias))
    SELECT extraction_id, language, min_by(level, i) AS level FROM met GROUP BY extraction_id, language"""


def projects(d: Dialect) -> str:
    """(extraction_id, project_no, name, description, url): blocks of the projects sections."""
    return f"""WITH {_blocks(d, 'projects')}
    SELECT extraction_id, {d.integer('i + 1')} AS project_no, left({d.squish(d.replace(d.get(d.split('blk', chr(92) + 'n'), '1'), BULLET, ''))}, 120) AS name, left({d.squish('blk')}, 400) AS description, {d.extract('lower(blk)', V.LINK)} AS url FROM pieces_"""


def skills(d: Dialect) -> str:
    """(extraction_id, raw, canonical): items of the skills sections, with the entry of the reference that has this name or alias; others stay as typed."""
    body = d.join(d.map(d.filter("s", "z", "z.kind = 'skills'"), "z", "z.body"), "\n")
    bare = d.trim(d.replace("raw", r"\s*\([^)]*\)$", ""))
    return f"""WITH {documents(d)}, bodies AS (SELECT extraction_id, {body} AS body FROM doc),
    items AS (SELECT * FROM (SELECT extraction_id, {d.explode(d.filter(d.map(d.split('body', r'[,;|\n•·]'), 'y', d.squish(d.replace('y', BULLET, ''))), 'y', 'length(y) BETWEEN 2 AND 40'), 'raw', 'i')} FROM bodies) WHERE i IS NOT NULL),
    typed AS (SELECT DISTINCT extraction_id, raw, {d.norm(bare)} AS folded FROM items),
    spelt AS (SELECT canonical, canonical AS form FROM @skill_reference@ UNION ALL SELECT canonical, alias AS form FROM (SELECT canonical, {'explode(aliases)' if d.spark else 'unnest(aliases)'} AS alias FROM @skill_reference@)),
    known AS (SELECT {d.norm('form')} AS folded, min(canonical) AS canonical FROM spelt WHERE form <> '' GROUP BY {d.norm('form')})
    SELECT t.extraction_id, t.raw, k.canonical FROM typed t LEFT JOIN known k ON t.folded = k.folded"""


_JOB_BULLET = r"^\s*(?:[•·◦‣⁃▪*+]\s*|[-–—]\s|\d+[.)])\s*"


def vacancy_blocks(d: Dialect) -> str:
    """CTEs up to `blocked`: lines of each vacancy (job_id, i, txt, block); the last heading above decides, and what comes before any is unlabelled."""
    starts = lambda words: d.like("flat", "^(?:" + _any(words) + ")")
    heading = f"CASE WHEN flat = '' OR length(flat) > 60 THEN NULL WHEN {starts(V.VACANCY_HEADINGS['optional'])} THEN 'optional' WHEN {starts(V.VACANCY_HEADINGS['required'])} THEN 'required' WHEN {starts(V.VACANCY_HEADINGS['responsibilities'])} THEN 'responsibilities' END"
    return f"""
    ad AS (SELECT job_id, max(plain_text) AS t FROM @job_descriptions@ WHERE job_id IS NOT NULL AND plain_text IS NOT NULL GROUP BY job_id),
    rows_ AS (SELECT * FROM (SELECT job_id, {d.explode(d.split(d.trim(d.replace('t', r'\r\n?', chr(10))), chr(92) + 'n'), 'txt', 'i')} FROM ad) WHERE i IS NOT NULL),
    flat_rows AS (SELECT *, {d.replace(d.norm(d.squish('txt')), r'[:.]+$', '')} AS flat FROM rows_),
    headed AS (SELECT *, {heading} AS heading FROM flat_rows),
    spread AS (SELECT *, max(CASE WHEN heading IS NOT NULL THEN i END) OVER (PARTITION BY job_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM headed),
    blocked AS (SELECT s.job_id, s.i, s.txt, s.heading, coalesce(h.heading, 'unlabelled') AS block FROM spread s LEFT JOIN headed h ON s.job_id = h.job_id AND s.at = h.i)"""


def vacancy_lines(d: Dialect) -> str:
    """(job_id, block, line_no, item): what stands under each heading of a vacancy, marks off."""
    return f"""WITH {vacancy_blocks(d)} SELECT job_id, block, {d.integer('i + 1')} AS line_no, {d.squish(d.replace('txt', _JOB_BULLET, ''))} AS item FROM blocked WHERE heading IS NULL AND {d.like('txt', chr(92) + 'S')}"""


def vacancy_profiles(d: Dialect) -> str:
    """(job_id, title, seniority, duties): the title among the first eight lines, the level told by the first 400 characters, and the number of duties (at most 20)."""
    level = "CASE " + " ".join(f"WHEN {d.words('lower(left(t, 400))', words)} THEN '{k}'" for k, words in V.VACANCY_SENIORITY) + " ELSE 'unknown' END"
    title = d.get(d.filter(d.map(d.slice(d.split("t", r"\r?\n"), "1", "8"), "y", d.squish("y")), "y", f"length(y) BETWEEN 4 AND 90 AND NOT {d.like('y', r'[.!?]$')} AND {d.words('lower(y)', V.VACANCY_TITLES)}"), "1")
    return f"""WITH {vacancy_blocks(d)}, duty AS (SELECT job_id, least(count(*), 20) AS n FROM blocked WHERE block = 'responsibilities' AND heading IS NULL AND {d.like('txt', _JOB_BULLET)} AND length({d.squish(d.replace('txt', _JOB_BULLET, ''))}) > 8 GROUP BY job_id)
    SELECT a.job_id, {title} AS title, {level} AS seniority, {d.integer('coalesce(n, 0)')} AS duties FROM ad a LEFT JOIN duty u ON a.job_id = u.job_id"""


def vacancy_skills(d: Dialect) -> str:
    """(job_id, canonical, is_required): entries of the reference named in a vacancy's blocks; required wins, and without headings of skills all count as required."""
    return f"""WITH {vacancy_blocks(d)},
    entry AS (SELECT canonical, {d.norm('canonical')} AS form FROM @skill_reference@),
    texts AS (SELECT job_id, i, block, {d.norm('txt')} AS folded FROM blocked WHERE heading IS NULL AND {d.like('txt', chr(92) + 'S')}),
    named AS (SELECT job_id, canonical, block FROM texts JOIN entry ON contains(folded, form)),
    labelled AS (SELECT job_id, max(CASE WHEN block IN ('required', 'optional') THEN 1 ELSE 0 END) AS has FROM blocked GROUP BY job_id)
    SELECT n.job_id, canonical, bool_or(block IN ('required', 'unlabelled') OR has = 0) AS is_required FROM named n JOIN labelled b ON n.job_id = b.job_id WHERE block <> 'responsibilities' OR has = 0 GROUP BY n.job_id, canonical"""


def openings(d: Dialect) -> str:
    """(extraction_id, word, n, place): the first words of three and more list lines, the three commonest of each text."""
    word = f"lower({d.get(d.split(d.squish(d.replace('txt', BULLET, '')), ' '), '1')})"
    return f"""WITH rows_ AS (SELECT * FROM (SELECT extraction_id, {d.explode(d.split("coalesce(plain_text, '')", chr(92) + 'r?' + chr(92) + 'n'), 'txt', 'i')} FROM @extractions@) WHERE i IS NOT NULL),
    counted AS (SELECT extraction_id, word, count(*) AS n FROM (SELECT extraction_id, {word} AS word FROM rows_ WHERE {d.like('txt', BULLET)}) w WHERE length(word) >= 3 GROUP BY extraction_id, word)
    SELECT * FROM (SELECT extraction_id, word, {d.integer('n')} AS n, {d.integer('row_number() OVER (PARTITION BY extraction_id ORDER BY n DESC, word)')} AS place FROM counted WHERE n >= 3) r WHERE place <= 3"""


def coverage(d: Dialect) -> str:
    """(extraction_id, coverage): share of a text's characters in known sections."""
    total = f"aggregate({d.map(d.filter('s', 'z', chr(34) * 0 + 'z.kind <> ' + d.text('unknown')), 'z', 'CAST(length(z.body) AS BIGINT)')}, 0L, (m, y) -> m + y)" if d.spark else f"CAST(coalesce(list_sum({d.map(d.filter('s', 'z', 'z.kind <> ' + d.text('unknown')), 'z', 'length(z.body)')}), 0) AS BIGINT)"
    return f"WITH {documents(d)} SELECT extraction_id, floor(1000e0 * {total} / greatest(length(t), 1) + 0.5e0) / 1000 AS coverage FROM doc"


def found_ranges(d: Dialect) -> str:
    """(extraction_id, range_no, raw): every range of dates in a text, in order."""
    return f"""WITH rows_ AS (SELECT * FROM (SELECT extraction_id, {d.explode(d.extract_all("lower(coalesce(plain_text, ''))", RANGE), 'raw', 'i')} FROM @extractions@) WHERE i IS NOT NULL) SELECT extraction_id, {d.integer('i + 1')} AS range_no, raw FROM rows_"""


def accuracy(d: Dialect) -> str:
    """(field, hits, total): how often what is read from a text agrees with the candidate's own row, where that tells something."""
    return f"""WITH one AS (SELECT candidate_id, max(lower(email)) AS email FROM @candidates@ GROUP BY candidate_id),
    read AS (SELECT x.candidate_id, lower({d.extract('plain_text', EMAIL)}) AS email FROM @extractions@ x WHERE plain_text IS NOT NULL)
    SELECT 'email' AS field, count(CASE WHEN r.email = o.email THEN 1 END) AS hits, count(*) AS total FROM read r JOIN one o ON r.candidate_id = o.candidate_id WHERE {d.like('o.email', chr(94) + EMAIL + '$')}"""


def windows_by_key(d: Dialect) -> str:
    """(batch_id, sort_key, direction, candidate_id, place): candidates of each batch in the order of seven keys and both directions; ties by rank, then file name. Missing matches come last descending and first ascending."""
    keys = ("total", "overall_score", "coalesce(job_match_score, -1)", "experience_months", "coverage", "n_flags")
    names = ("rank", "overallScore", "jobMatchScore", "experienceMonths", "requiredCoverage", "flags")
    tie = "total DESC, file_name, candidate_id"
    size = (lambda a: f"coalesce(size({a}), 0)") if d.spark else (lambda a: f"coalesce(len({a}), 0)")
    parts = [f"SELECT batch_id, '{n}' AS sort_key, '{w.lower()}' AS direction, candidate_id, {d.integer(f'row_number() OVER (PARTITION BY batch_id ORDER BY {k} {w} NULLS LAST, {tie})')} AS place FROM ranked" for k, n in zip(keys, names) for w in ("DESC", "ASC")]
    parts += [f"SELECT batch_id, 'name' AS sort_key, '{w.lower()}' AS direction, candidate_id, {d.integer(f'row_number() OVER (PARTITION BY batch_id ORDER BY shown {w}, {tie})')} AS place FROM ranked" for w in ("DESC", "ASC")]
    return f"""WITH one AS (SELECT DISTINCT candidate_id, batch_id, file_name, candidate_name, overall_score, job_match_score, experience_months, {size('matched_required')} AS have, {size('missing_required')} AS lack, {size('flags')} AS n_flags FROM @candidates@),
    covered AS (SELECT o.*, b.job_id, CASE WHEN have + lack = 0 THEN 1e0 ELSE 1e0 * have / (have + lack) END AS coverage, lower(coalesce(candidate_name, file_name)) AS shown FROM one o LEFT JOIN @batches@ b ON o.batch_id = b.batch_id),
    ranked AS (SELECT *, CASE WHEN job_id IS NULL THEN CAST(overall_score AS BIGINT) ELSE CAST(floor((CAST(round(coverage * 100000) AS BIGINT) * 55 + coalesce(job_match_score, 0) * 25000 + overall_score * 20000) / 100000e0 + 0.5e0) AS BIGINT) END AS total FROM covered)
    {' UNION ALL '.join(parts)}"""
