"""The document pipeline as SQL: lines, headings and sections, contacts, bullets and entries of a text, roles of a candidate, the vacancy of a batch, and facts for the rules.

A document is one row; its lines are an array that is cut at headings and entries by place, so nothing is regrouped and no text is copied line by line.
Roles and vacancies are aggregated by their key and joined to the documents. Every plan is written once for a dialect (see dialect.py).
"""

from ..functions import vocabulary as V
from ..operators.rules import CLICHES, WEAK_OPENINGS
from .dialect import Dialect

BULLET = r"^\s*(?:[•·◦‣⁃▪▫*+]\s*|[-–—]\s|\d{1,2}[.)]\s)\s*"
MARKS = "-*•–—▪·‣"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]*\w"
PHONE = r"(?:\+?\d{1,3}[\s().-]{0,3})?(?:\d[\s().-]{0,3}){8,14}\d"
_END_POINT = r"(?:(?:\p{L}{3,10}\.?\s+)?\d{4}(?:[-./]\d{1,2})?|\d{1,2}[-./]\d{4})"
_NOW = r"present|current|now|today|ongoing|till now|to date|по настоящее время|настоящее время|по сей день|н\.в\.|нв|сейчас|aujourd.hui|en cours|heute|bis heute|actualidad|la actualidad|presente|o presente|oggi|attuale|hoje|atual"
#: A range of dates in lower case, with the separators of the tables' other languages.
RANGE = rf"{_END_POINT}\s*(?:[-‐-―−~]|--|to |до |по |bis |à |a |até )\s*(?:{_END_POINT}|{_NOW})"
IS_NOW = rf"(?:{_NOW})"


def struct(d: Dialect, **fields: str) -> str:
    if d.spark:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def with_next(d: Dialect, places: str, last: str) -> str:
    """Structs (p, q) of places and the places that follow them."""
    if d.spark:
        return d.let(lambda w0: f"transform({w0}, (v0, i0) -> named_struct('p', v0, 'q', coalesce(get({w0}, i0 + 1), {last})))", w0=places)
    return f"list_transform({places}, lambda v0, i0: {{'p': v0, 'q': coalesce(({places})[i0 + 1], {last})}})"


def heading_like(d: Dialect, x: str) -> str:
    """A line of at most seven words without the end of a sentence, address, link, date or bullet."""
    return f"({d.word_count(x)} BETWEEN 1 AND 7 AND NOT {d.like(x, r'[.!?;,]$')} AND NOT {d.like(x, r'@|https?://|www\.|\d{4}')} AND NOT {d.like(x, BULLET)})"


def heading_kind(d: Dialect, c: str) -> str:
    """Kind of a cleaned heading, empty for none: an exact phrase, else the longest phrase of four letters and more inside one not much longer."""
    exact = {kind: phrases.split("|") + V.OTHER_HEADINGS.get(kind, "").split("|") for kind, (_, phrases) in V.SECTION_HEADINGS.items()}
    whens = [f"WHEN {c} IN ({', '.join(d.text(w) for w in dict.fromkeys(words) if w)}) THEN '{kind}'" for kind, words in exact.items()]
    held = sorted(((w, kind) for kind, (_, phrases) in V.SECTION_HEADINGS.items() for w in phrases.split("|") if len(w) >= 4), key=lambda x: -len(x[0]))
    whens += [f"WHEN contains({c}, {d.text(w)}) AND length({c}) <= {3 * len(w) + 12} THEN '{kind}'" for w, kind in held]
    return f"CASE WHEN {c} = '' OR length({c}) > 64 THEN '' {' '.join(whens)} ELSE '' END"


def confidence(d: Dialect, kind: str, c: str) -> str:
    """Confidence of a heading: .15 less where the phrase only stands inside it."""
    base = "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN {conf}" for k, (conf, _) in V.SECTION_HEADINGS.items()) + " ELSE 0.3 END"
    every = [w for k, (_, phrases) in V.SECTION_HEADINGS.items() for w in phrases.split("|")] + [w for ws in V.OTHER_HEADINGS.values() for w in ws.split("|")]
    return f"CASE WHEN {kind} = 'unknown' OR {c} IN ({', '.join(map(d.text, dict.fromkeys(every)))}) THEN {base} ELSE {base} - 0.15 END"


def documents(d: Dialect, source: str = "@extractions@") -> str:
    """CTEs up to `doc`: one row a text with lines l, cleaned headings c, kinds k, places of headings p, sections s (kind, head, body), head block and experience lines x."""
    upper = lambda x: f"{d.count(x, r'\p{Lu}')} > 0.7 * greatest({d.count(x, r'\p{L}')}, 1)"
    at = lambda a, i: d.get(a, i)
    experience = d.get(d.filter("s", "z", "z.kind = 'experience'"), "1")
    kinds = lambda k0, c, l: d.map(d.upto(d.size(l)), "j", f"CASE WHEN j = 1 THEN '' WHEN {at(k0, 'j')} <> '' THEN {at(k0, 'j')} WHEN {at(c, 'j')} <> '' AND {d.trim(at(l, 'j - 1'))} = '' AND length({at(c, 'j')}) > 3 AND {upper(at(l, 'j'))} THEN 'unknown' ELSE '' END")
    pieces = lambda k, c, l: d.map("pq", "z", struct(d, kind=at(k, "z.p"), head=at(c, "z.p"), body=d.join(d.slice(l, "z.p + 1", "z.q - z.p - 1"), "\n")))
    return f"""
    base AS (SELECT extraction_id, candidate_id, coalesce(has_text_layer, false) AS has_text_layer, coalesce(has_problematic_glyphs, false) AS glyphs, coalesce(page_count, 0) AS pages, coalesce(plain_text, '') AS t FROM {source}),
    split_up AS (SELECT *, {d.split('t', chr(92) + 'r?' + chr(92) + 'n')} AS l, lower(t) AS low, {d.norm('t')} AS n FROM base),
    cleaned AS (SELECT *, {d.map('l', 'y', f"CASE WHEN {heading_like(d, 'y')} THEN {d.trim(d.replace(d.norm('y'), chr(94) + r'[\s\p{P}\p{S}]+|[\s:|/\\•·]+$', ''))} ELSE '' END")} AS c FROM split_up),
    told AS (SELECT *, {d.map('c', 'y', heading_kind(d, 'y'))} AS k0 FROM cleaned),
    marked AS (SELECT *, {d.let(kinds, m1='k0', m2='c', m3='l')} AS k FROM told),
    placed AS (SELECT *, {d.let(lambda m: d.filter(d.upto(d.size('l')), 'j', f"{at(m, 'j')} <> ''"), m1='k')} AS p FROM marked),
    paired AS (SELECT *, {with_next(d, 'p', d.size('l') + ' + 1')} AS pq FROM placed),
    cut_up AS (SELECT *, {d.let(pieces, m1='k', m2='c', m3='l')} AS s,
      CASE WHEN {d.size('p')} > 0 THEN {d.join(d.slice('l', '1', d.get('p', '1') + ' - 1'), chr(10))} ELSE left(t, 600) END AS head FROM paired),
    doc AS (SELECT *, {d.split(f"coalesce(({experience}).body, t)", chr(92) + 'r?' + chr(92) + 'n')} AS x,
      {d.filter(d.map(d.split('head', r'\n|\s+[|•·/]\s+'), 'y', d.squish('y')), 'y', "y <> ''")} AS f FROM cut_up)"""


def sections(d: Dialect) -> str:
    """(extraction_id, section_no, kind, n_words, n_chars, confidence): sections of each text, the block before the first heading as contacts."""
    return f"""WITH {documents(d)},
    rows_ AS (SELECT * FROM (SELECT extraction_id, {d.explode('s', 'z', 'i')} FROM doc) WHERE i IS NOT NULL)
    SELECT extraction_id, {d.integer('i + 2')} AS section_no, z.kind AS kind, {d.integer(d.word_count('z.body'))} AS n_words, {d.integer('length(z.body)')} AS n_chars, CAST({confidence(d, 'z.kind', 'z.head')} AS DOUBLE) AS confidence FROM rows_
    UNION ALL SELECT extraction_id, 1, 'contacts', {d.integer(d.word_count('head'))}, {d.integer('length(head)')}, CAST(0.8 AS DOUBLE) FROM doc WHERE t <> ''"""


def _contact_columns(d: Dialect) -> dict[str, str]:
    words = d.filter(d.split("y", " "), "w", "length(w) > 1")
    amounts = r"(?:[$€₽₸]|usd|eur|kzt|rub|tenge|тенге)\s*" + PHONE
    phones = d.filter(d.extract_all(d.replace("low", amounts, " "), PHONE), "y", f"length({d.replace('y', chr(92) + 'D', '')}) BETWEEN 10 AND 15")
    return {
        "email": d.extract("t", EMAIL),
        "phone": d.squish(d.get(phones, "1")),
        "name": d.get(
            d.filter(
                d.slice("f", "1", "8"), "y",
                f"NOT {d.like('y', r'\d|@|https?://|\+')} AND {d.size(words)} BETWEEN 2 AND 4 AND NOT ({d.any(words, 'w', 'NOT ' + d.like('w', chr(94) + r'\p{Lu}'))}) AND NOT {d.words('lower(y)', V.HEADER_TITLES)}",
            ), "1",
        ),
        "links": d.distinct(d.filter(d.map(d.extract_all("low", V.LINK), "y", d.replace("y", r"[.,;)]+$", "")), "y", "length(y) >= 6")),
    }


def contacts(d: Dialect) -> str:
    """CTEs up to `contact`: doc with e-mail, phone, name, links (lower case), link kinds, headline, location and sensitive kinds."""
    c = _contact_columns(d)
    kind = "CASE " + " ".join(f"WHEN {d.like('y', p)} THEN '{k}'" for k, p in V.LINK_DOMAINS) + f" WHEN {d.like('y', r'\.(?:dev|me|io|design|site|portfolio)(?:$|[^a-z0-9_])|portfolio|cv|resume')} THEN 'portfolio' ELSE 'other' END"
    position = f"coalesce({'array_position' if d.spark else 'list_position'}(f, name), 0)"
    headline = d.filter(
        d.slice("f", position + " + 1", "4"), "y",
        f"length(y) BETWEEN 4 AND 90 AND NOT {d.like('y', r'@|https?://|\+\d')} AND NOT ({d.count('y', r'\p{Lu}')} > 0.85 * greatest({d.count('y', r'\p{L}')}, 1) AND {d.word_count('y')} <= 2) AND {d.words('lower(y)', V.HEADLINE_TITLES)}",
    )
    hint = d.get(d.let(lambda m: d.filter(d.array(V.PLACES.split("|")), "y", f"contains({m}, y)"), m1="nh"), "1")
    line = d.get(d.let(lambda m: d.filter(d.split("head", r"\n"), "y", f"contains({d.norm('y')}, {m})"), m1="hint"), "1")
    part = d.get(d.let(lambda m: d.filter(d.map(d.split("place_line", r"[|•·]"), "y", d.squish("y")), "y", f"contains({d.norm('y')}, {m})"), m1="hint"), "1")
    found = [f"CASE WHEN {d.words('low', w)} THEN '{k}' ELSE '' END" for k, w in V.SENSITIVE_WORDS.items()] + [f"CASE WHEN {d.like('low', p)} THEN '{k}' ELSE '' END" for k, p in V.SENSITIVE_SHAPES.items()]
    listed = ("array(" if d.spark else "[") + ", ".join(found) + (")" if d.spark else "]")
    return f"""{documents(d)},
    reached AS (SELECT *, {c['email']} AS email, {c['phone']} AS phone, {c['name']} AS name, {c['links']} AS links, {d.norm('head')} AS nh, {d.sort(d.filter(listed, 'y', "y <> ''"))} AS sensitive FROM doc),
    known AS (SELECT *, {d.sort(d.distinct(d.map('links', 'y', kind)))} AS link_kinds, {d.get(headline, '1')} AS headline, {hint} AS hint FROM reached),
    lined AS (SELECT *, CASE WHEN hint IS NOT NULL THEN {line} END AS place_line FROM known),
    contact AS (SELECT *, CASE WHEN length({part}) <= 60 THEN {part} ELSE left({d.squish('place_line')}, 60) END AS location FROM lined)"""


def contact_rows(d: Dialect) -> str:
    return f"""WITH {contacts(d)} SELECT extraction_id, email, phone, name, headline, location, {d.join('link_kinds', '|')} AS link_kinds, {d.join('sensitive', '|')} AS sensitive FROM contact"""


def link_rows(d: Dialect) -> str:
    """(extraction_id, url, kind, is_resolvable) of the distinct links, told apart without scheme, www and case."""
    kind = "CASE " + " ".join(f"WHEN {d.like('url', p)} THEN '{k}'" for k, p in V.LINK_DOMAINS) + f" WHEN {d.like('url', r'\.(?:dev|me|io|design|site|portfolio)(?:$|[^a-z0-9_])|portfolio|cv|resume')} THEN 'portfolio' ELSE 'other' END"
    return f"""WITH found AS (SELECT * FROM (SELECT extraction_id, {d.explode(_contact_columns(d)['links'], 'url', 'i')} FROM (SELECT extraction_id, lower(coalesce(plain_text, '')) AS low FROM @extractions@)) WHERE i IS NOT NULL),
    one AS (SELECT extraction_id, min_by(url, i) AS url FROM found GROUP BY extraction_id, {d.replace(d.replace('url', chr(94) + 'https?://', ''), chr(94) + r'www\.', '')})
    SELECT extraction_id, url, {kind} AS kind, {d.like('url', chr(94) + r'https?://|^www\.|\.[a-z]{2,}/')} AS is_resolvable FROM one"""


def rank_of(d: Dialect, title: str) -> str:
    return "CASE " + " ".join(f"WHEN {d.like(title, '|'.join(w.replace('.', chr(92) + '.') for w in words.split('|')))} THEN {k}" for k, (_, words) in enumerate(V.SENIORITY_TITLES, 1)) + " END"


def roles(d: Dialect) -> str:
    """CTEs up to `career`: one row a candidate of what the roles in the experience table tell (order of roles: exp_id)."""
    order = "PARTITION BY candidate_id ORDER BY"
    return f"""
    role AS (SELECT DISTINCT exp_id, candidate_id, batch_id, company, job_title, confidence, start_year, start_month, end_year, end_month, coalesce(is_current, false) AS is_current, date_format FROM @experience@ WHERE candidate_id IS NOT NULL),
    timed AS (SELECT r.*, start_year * 12 + coalesce(start_month, 1) - 1 AS a, CASE WHEN is_current THEN year(screened_at) * 12 + month(screened_at) - 1 ELSE end_year * 12 + coalesce(end_month, 1) - 1 END AS z,
      year(screened_at) * 12 + month(screened_at) - 1 AS now_month, {rank_of(d, d.norm("coalesce(job_title, '')"))} AS title_rank FROM role r LEFT JOIN @batches@ b ON r.batch_id = b.batch_id),
    ordered AS (SELECT *, row_number() OVER ({order} exp_id) AS job_no, lag(CASE WHEN is_current THEN 999999 ELSE a END) OVER ({order} exp_id) AS before_it,
      max(CASE WHEN a IS NOT NULL THEN z END) OVER ({order} CASE WHEN a IS NULL OR z IS NULL THEN 1 ELSE 0 END, a, z, exp_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM timed),
    spans AS (SELECT *, CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN greatest(z - a + 1, 0) ELSE 0 END AS months, CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN greatest(z - greatest(a, coalesce(top + 1, a)) + 1, 0) ELSE 0 END AS fresh,
      CASE WHEN a IS NOT NULL AND z IS NOT NULL AND a - top - 1 >= 4 THEN a - top - 1 END AS gap FROM ordered),
    career AS (SELECT candidate_id, {d.integer('count(*)')} AS jobs, {d.integer('count(a)')} AS dated, {d.integer('sum(fresh)')} AS total_months, {d.integer('count(CASE WHEN months > 0 THEN 1 END)')} AS counted, {d.integer('min(CASE WHEN months > 0 THEN months END)')} AS shortest,
      {d.integer('count(CASE WHEN months > 0 AND months < 12 THEN 1 END)')} AS short_stints, {d.integer('max(gap)')} AS longest_gap, {d.integer('count(gap)')} AS gaps, {d.integer('count(CASE WHEN a IS NOT NULL AND (CASE WHEN is_current THEN 999999 ELSE a END) > before_it THEN 1 END)')} AS inversions,
      {d.integer('count(CASE WHEN confidence < 0.6 THEN 1 END)')} AS unsure, {d.integer('count(CASE WHEN a IS NULL AND z IS NULL AND NOT is_current THEN 1 END)')} AS undated, {d.integer("count(DISTINCT CASE WHEN date_format <> 'unknown' THEN date_format END)")} AS formats,
      {d.integer('max(title_rank)')} AS top_rank, {d.integer('min_by(title_rank, CASE WHEN title_rank IS NOT NULL THEN job_no END)')} AS newest_rank, {d.integer('max_by(title_rank, CASE WHEN title_rank IS NOT NULL THEN job_no END)')} AS oldest_rank,
      {d.integer('count(title_rank)')} AS ranked, bool_or(is_current) AS still, {d.integer('max(CASE WHEN NOT is_current THEN z END)')} AS last_end, {d.integer('max(now_month)')} AS now_month,
      {d.integer(f"count(CASE WHEN {d.words('lower(coalesce(company, ' + chr(39) * 2 + '))', V.LOCAL_FORMS)} THEN 1 END)")} AS local_jobs, max(CASE WHEN job_no = 1 THEN job_title END) AS title1, max(CASE WHEN job_no = 2 THEN job_title END) AS title2
      FROM spans GROUP BY candidate_id)"""


_IMPLIED = "CASE WHEN top_rank IS NOT NULL THEN top_rank WHEN coalesce(total_months, 0) = 0 THEN 0 WHEN total_months < 24 THEN 1 WHEN total_months < 60 THEN 2 ELSE 3 END"
_LEVEL = "CASE {} WHEN 1 THEN 'junior' WHEN 2 THEN 'middle' WHEN 3 THEN 'senior' WHEN 4 THEN 'lead' ELSE 'unknown' END"


def career_rows(d: Dialect) -> str:
    """Tenure, progression and implied seniority of each candidate."""
    return f"""WITH {roles(d)} SELECT candidate_id, jobs, dated, total_months, CASE WHEN counted > 0 THEN {d.integer('floor(total_months / counted + 0.5)')} ELSE 0 END AS average_months, shortest, short_stints, gaps, longest_gap, inversions, formats,
    {_LEVEL.format(_IMPLIED)} AS seniority, CASE WHEN ranked < 2 THEN 'unclear' WHEN newest_rank > oldest_rank THEN 'up' WHEN newest_rank < oldest_rank THEN 'down' ELSE 'flat' END AS progression FROM career"""


def vacancy(d: Dialect) -> str:
    """CTEs up to `job`: one row a vacancy with folded title, text, level and the folded names of required and optional skills."""
    collect = (lambda e: f"array_sort(collect_set({e}))") if d.spark else (lambda e: f"list_sort(list_distinct(list({e}) FILTER (WHERE {e} IS NOT NULL)))")
    return f"""
    advert AS (SELECT job_id, max(job_title) AS job_title, max(seniority) AS seniority, max(plain_text) AS job_text FROM @job_descriptions@ WHERE job_id IS NOT NULL GROUP BY job_id),
    wanted AS (SELECT job_id, canonical, bool_or(coalesce(is_required, false)) AS is_required FROM @job_skills@ WHERE canonical IS NOT NULL AND canonical <> '' GROUP BY job_id, canonical),
    skills AS (SELECT job_id, {collect(f"CASE WHEN is_required THEN {d.norm('canonical')} END")} AS required, {collect(f"CASE WHEN NOT is_required THEN {d.norm('canonical')} END")} AS optional FROM wanted GROUP BY job_id),
    job AS (SELECT a.job_id, a.job_title, {d.norm("coalesce(a.job_title, '')")} AS job_title_n, {d.norm("coalesce(a.job_text, '')")} AS job_text_n, CASE lower(a.seniority) WHEN 'junior' THEN 1 WHEN 'middle' THEN 2 WHEN 'senior' THEN 3 WHEN 'lead' THEN 4 ELSE 0 END AS job_rank,
      s.required, s.optional FROM advert a LEFT JOIN skills s ON a.job_id = s.job_id WHERE length(trim(coalesce(a.job_text, ''))) >= 40)"""


def facts(d: Dialect) -> str:
    """CTEs up to `fact`: one row of facts an extraction for the rules."""
    bullet = lambda y: d.like(y, BULLET)
    any_of = lambda y, patterns: "(" + " OR ".join(d.like(y, p) for p in patterns) + ")"
    first_token = d.get(d.split(d.norm("y"), r"[\s,]+"), "1")
    verbs = ", ".join(d.text(v) for v in V.ACTION_VERBS.split("|"))
    folded = lambda phrases: sorted({_fold(p) for p in phrases})
    weak = " OR ".join(f"starts_with(y, {d.text(w)})" if not d.spark else f"startswith(y, {d.text(w)})" for w in folded(WEAK_OPENINGS))
    opening = d.join(d.slice(d.split("y", r"\s+"), "1", "3"), " ")
    past, present = r"(?:^|[^A-Za-z0-9_])[A-Za-z0-9_]+ed(?:$|[^A-Za-z0-9_])", r"(?:^|[^A-Za-z0-9_])[A-Za-z0-9_]+(?:s|ing)(?:$|[^A-Za-z0-9_])"
    sentence_cut = d.split(d.replace("t", r"([.!?])\s+([\p{Lu}\p{N}])", ("$1" if d.spark else "\\1") + "\n" + ("$2" if d.spark else "\\2")), r"\n+")
    sizes = d.filter(d.map(sentence_cut, "y", d.word_count("y")), "y", "y >= 3")
    total = (lambda a: f"aggregate({a}, 0L, (m, y) -> m + y)") if d.spark else (lambda a: f"CAST(coalesce(list_sum({a}), 0) AS BIGINT)")
    summary = d.get(d.filter("s", "z", "z.kind = 'summary'"), "1")
    filled = lambda kind: d.any("s", "z", f"z.kind = '{kind}' AND {d.like('z.body', chr(92) + 'S')}")
    cliches = folded(CLICHES)
    entries = d.let(lambda x: d.map("apq", "z", struct(d, past=f"NOT {d.like('lower(' + d.get(x, 'z.p') + ')', IS_NOW)}", marked=d.filter(d.slice(x, "z.p + 1", "z.q - z.p - 1"), "y", bullet("y")))), m1="x")
    anchors = d.let(lambda x: d.filter(d.upto(d.size("x")), "j", f"{d.like('lower(' + d.get(x, 'j') + ')', RANGE)} AND NOT {bullet(d.get(x, 'j'))} AND {d.word_count(d.get(x, 'j'))} <= 18"), m1="x")
    tense = lambda y, p: d.how_many(y, "y", p)
    plain_opening = d.join(d.slice(d.split(d.squish(d.replace("y", BULLET, "")), r"\s+"), "1", "3"), " ")
    mixed = d.any("e", "z", f"z.past AND {d.size('z.marked')} >= 3 AND {tense('z.marked', d.like(plain_opening, past))} >= 2 AND {tense('z.marked', 'NOT ' + d.like(plain_opening, past) + ' AND ' + d.like(plain_opening, present))} >= 2")
    openers = d.filter(d.map("b", "y", f"lower({d.get(d.split('y', chr(92) + 's+'), '1')})"), "y", "length(y) >= 3")
    repeats = d.let(lambda m: d.map(d.distinct(m), "y", d.how_many(m, "w", "w = y")), m1="openers")
    most = f"coalesce({'array_max' if d.spark else 'list_max'}({repeats}), 0)"
    marks = d.distinct(d.map(d.filter("l", "y", d.like("y", r"^\s*[-*•–—▪·‣]\s")), "y", f"left({'ltrim(y)' if d.spark else 'ltrim(y, chr(32))'}, 1)"))
    skills_body = d.get(d.filter("s", "z", "z.kind = 'skills'"), "1")
    skill_items = d.filter(d.split(f"coalesce(({skills_body}).body, '')", r"[,;|\n•·]"), "y", f"{d.like('y', chr(92) + 'S')}")
    title_words = d.distinct(d.filter(d.split("job_title_n", r"\s+"), "w", "length(w) > 3 AND w NOT IN ('the', 'and', 'for', 'with', 'разработчик')"))
    expansions = " + ".join(f"CASE WHEN contains(job_text_n, {d.text(long)}) AND contains(n, {d.text(short)}) AND NOT contains(n, {d.text(long)}) THEN 1 ELSE 0 END" for short, long in V.EXPANSIONS)
    english = d.filter(d.split(f"coalesce(({d.get(d.filter('s', 'z', chr(39).join(['z.kind = ', 'languages', ''])), '1')}).body, '')", r"\n|[;,]"), "y", d.like("lower(y)", "english|английский"))
    levelled = d.any("english", "y", f"{d.like('y', r'(?:^|[^A-Za-z0-9_])[ABC][12](?:$|[^A-Za-z0-9_])')} OR {d.words('lower(y)', V.LEVELS)}")
    int_ = d.integer
    return f"""{contacts(d)}, {roles(d)}, {vacancy(d)},
    listed AS (SELECT *, {d.map(d.filter('l', 'y', bullet('y')), 'y', d.squish(d.replace('y', BULLET, '')))} AS b, {anchors} AS anchors, {sizes} AS sizes, {summary} AS summary, {english} AS english FROM contact),
    entered AS (SELECT *, {d.map('b', 'y', 'lower(y)')} AS bl, {d.map('b', 'y', f"left({d.norm('y')}, 40)")} AS bn, {with_next(d, 'anchors', d.size('x') + ' + 1')} AS apq, {openers} AS openers FROM listed),
    timed_entries AS (SELECT *, {entries} AS e, {d.norm("coalesce((summary).body, '')")} AS summary_n FROM entered),
    one AS (SELECT candidate_id, max(batch_id) AS batch_id FROM @candidates@ GROUP BY candidate_id),
    joined AS (SELECT t.*, c.jobs, c.dated, c.total_months, c.short_stints, c.counted, c.longest_gap, c.inversions, c.unsure, c.undated, c.formats, c.top_rank, c.newest_rank, c.oldest_rank, c.ranked, c.still, c.last_end, c.now_month, c.local_jobs, c.title1, c.title2,
      j.job_id, j.job_title_n, j.job_text_n, j.job_rank, coalesce(j.required, {d.slice(d.array(['']), '1', '0')}) AS required, coalesce(j.optional, {d.slice(d.array(['']), '1', '0')}) AS optional
      FROM timed_entries t LEFT JOIN career c ON t.candidate_id = c.candidate_id LEFT JOIN one o ON t.candidate_id = o.candidate_id LEFT JOIN @batches@ v ON o.batch_id = v.batch_id LEFT JOIN job j ON v.job_id = j.job_id),
    matched AS (SELECT *, {title_words} AS title_words, {d.norm("concat_ws(' ', coalesce(headline, ''), coalesce(title1, ''), coalesce(title2, ''))")} AS own_titles FROM joined),
    fact AS (SELECT extraction_id, candidate_id, has_text_layer, glyphs, pages, 1 AS max_columns, 0 AS margin_texts, false AS margin_contacts, 0 AS text_boxes, CAST(NULL AS INT) AS odd_fonts, CAST(NULL AS INT) AS hidden_links, 0 AS images, {int_(d.how_many('l', 'y', d.count(d.trim('y'), ' {3,}|' + chr(92) + 't+') + ' >= 2'))} AS tabular,
      {filled('experience')} AS has_experience, {filled('skills')} AS has_skills, {filled('education')} AS has_education, {filled('summary')} AS has_summary,
      email IS NOT NULL AS has_email, coalesce(phone, '') <> '' AS has_phone, name IS NOT NULL AS has_name, coalesce({d.like("coalesce(name, '')", r'\p{Cyrillic}' if not d.spark else r'\p{IsCyrillic}')}, false) AS cyrillic_name,
      {d.any('link_kinds', 'y', "y = 'linkedin'")} AS has_linkedin, {d.any('link_kinds', 'y', "y IN ('github', 'gitlab')")} AS has_code, {d.size('links')} AS n_links, {d.any('links', 'y', 'NOT ' + d.like('y', chr(94) + r'https?://|^www\.|\.[a-z]{2,}/'))} AS dead_link,
      {d.size('sensitive')} AS n_sensitive, {int_(d.how_many('sensitive', 'y', 'y IN (' + ', '.join(d.text(h) for h in V.HIGH_RISK) + ')'))} AS n_high, {d.any('sensitive', 'y', "y = 'salaryExpectation'")} AS salary,
      {d.size('b')} AS n_bullets, {int_(d.how_many('bl', 'y', any_of('y', V.AMOUNTS)))} AS quantified, {int_(d.how_many('b', 'y', f'{first_token} IN ({verbs})'))} AS led_by_verb, {int_(d.how_many('bn', 'y', weak))} AS weak,
      {int_(d.how_many('b', 'y', d.like('y', V.FIRST_I)))} + {int_(d.how_many('bl', 'y', any_of('y', V.FIRST_PERSON)))} AS first_person, {int_(d.how_many('bl', 'y', any_of('y', V.PASSIVE)))} AS passive,
      {int_(d.how_many('b', 'y', d.word_count('y') + ' > 34'))} AS overlong, {int_(d.how_many('b', 'y', d.word_count('y') + ' < 4'))} AS stubs, {int_(d.how_many('b', 'y', d.like('y', r'[.!?]$')))} AS stopped, {d.size(marks)} AS marks, {int_(most)} AS most_repeated,
      {int_(' + '.join(f"CASE WHEN contains(n, {d.text(p)}) THEN 1 ELSE 0 END" for p in cliches))} AS cliches, {d.size('e')} AS entries, {int_(d.how_many('e', 'z', d.size('z.marked') + ' = 0'))} AS bare_entries,
      {int_(d.how_many(d.slice('e', '1', '2'), 'z', d.size('z.marked') + ' BETWEEN 1 AND 2'))} AS thin_entries, coalesce({d.size(f"({d.get('e', '1')}).marked")}, 0) AS newest_bullets, {total(d.map('e', 'z', d.size('z.marked')))} AS entry_bullets, {mixed} AS mixed_tense,
      {d.size('sizes')} AS n_sentences, {total('sizes')} AS sentence_words, {int_(d.how_many('sizes', 'y', 'y > 28'))} AS long_sentences, {d.count('t', r'\p{IsLatin}' if d.spark else r'\p{Latin}')} AS latin, {d.count('t', r'\p{IsCyrillic}' if d.spark else r'\p{Cyrillic}')} AS cyrillic,
      CASE WHEN {d.like("coalesce((summary).body, '')", chr(92) + 'S')} THEN (CASE WHEN {d.like('(summary).body', chr(92) + 'd')} THEN 0 ELSE 1 END) + (CASE WHEN {' OR '.join(f'contains(summary_n, {d.text(p)})' for p in cliches)} THEN 1 ELSE 0 END)
        + (CASE WHEN {d.word_count('(summary).body')} > 90 OR {d.word_count('(summary).body')} < 12 THEN 1 ELSE 0 END) END AS summary_problems,
      {d.size(skill_items)} AS skill_items, {total(d.map(d.filter('s', 'z', "z.kind = 'unknown'"), 'z', 'length(z.body)'))} AS unknown_chars, length(t) AS n_chars,
      {d.size('english')} AS english_lines, {levelled} AS english_levelled, {d.words('low', V.WORK_ABROAD)} AS abroad_note, {d.any('bl', 'y', d.like('y', chr(92) + 'd') + ' OR ' + d.words('y', V.INDUSTRIES))} AS told_industry,
      coalesce(jobs, 0) AS jobs, coalesce(dated, 0) AS dated, coalesce(total_months, 0) AS total_months, coalesce(short_stints, 0) AS short_stints, longest_gap, coalesce(inversions, 0) AS inversions, coalesce(unsure, 0) AS unsure, coalesce(undated, 0) AS undated, coalesce(formats, 0) AS formats,
      {_IMPLIED} AS own_rank, coalesce(ranked, 0) AS ranked, newest_rank, oldest_rank, coalesce(still, false) AS still, last_end, now_month, coalesce(local_jobs, 0) AS local_jobs,
      job_id IS NOT NULL AS has_job, coalesce(job_rank, 0) AS job_rank, {d.size('required')} AS n_required, {int_(d.let(lambda m: d.how_many('required', 'y', f'NOT contains({m}, y)'), m1='n'))} AS missing_required, {d.size('optional')} AS n_optional, {int_(d.let(lambda m: d.how_many('optional', 'y', f'NOT contains({m}, y)'), m1='n'))} AS missing_optional,
      CASE WHEN job_id IS NULL THEN 0 ELSE {d.size('title_words')} END AS n_title_words, {int_(d.let(lambda m: d.how_many('title_words', 'y', f'contains({m}, y)'), m1='own_titles'))} AS title_hits, CASE WHEN job_id IS NULL THEN 0 ELSE {int_(expansions)} END AS unexpanded,
      {int_(d.let(lambda m: d.how_many(d.distinct(d.map(skill_items, 'y', d.norm('y'))), 'y', f"length(y) BETWEEN 3 AND 40 AND length({m}) - length(replace({m}, y, '')) > 6 * length(y)"), m1='n'))} AS stuffed
      FROM matched)"""


def _fold(phrase: str) -> str:
    """A vocabulary entry in the form of Dialect.norm."""
    import unicodedata

    from ..functions.text import _accent_table

    table = dict(zip(map(ord, _accent_table()[0]), _accent_table()[1]))
    return unicodedata.normalize("NFC", phrase).translate(table).replace("‑", "-").replace("’", "'").lower().strip()


def fact_rows(d: Dialect) -> str:
    return f"WITH {facts(d)} SELECT * FROM fact"


def summaries(d: Dialect) -> str:
    """(extraction_id, candidate_id, months, seniority, matched_required, missing_required, matched_optional, flags): the shortlist row of each text, but for its scores; skills joined by |."""
    level = _LEVEL.format("own_rank")
    listed = ("array(" if d.spark else "[") + ", ".join(
        f"CASE WHEN {test} THEN '{flag}' ELSE '' END" for flag, test in (("missing-contacts", "email IS NULL"), ("employment-gap", "coalesce(longest_gap, 0) >= 6"), ("short-tenures", "coalesce(short_stints, 0) >= 2"), ("undated-experience", "coalesce(jobs, 0) > 0 AND coalesce(dated, 0) = 0"))
    ) + (")" if d.spark else "]")
    has = lambda a, no: d.join(d.let(lambda m: d.filter(a, "y", f"{no}contains({m}, y)"), m1="n"), "|")
    return f"""WITH {facts(d)} SELECT extraction_id, candidate_id, coalesce(total_months, 0) AS months, {level} AS seniority, {has('required', '')} AS matched_required, {has('required', 'NOT ')} AS missing_required, {has('optional', '')} AS matched_optional,
    {d.join(d.filter(listed, 'y', "y <> ''"), '|')} AS flags FROM (SELECT *, {_IMPLIED} AS own_rank FROM matched) q"""
