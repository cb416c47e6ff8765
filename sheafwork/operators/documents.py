"""Per-document operators over lines: geometry, sections, bullets, sentences, contacts, skills. All are narrow: no shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BULLET = r"^\s*(?:[-*•–—▪·‣◦]|\d{1,2}[.)])\s+"
# Marks that open a list line, in the order in which they are counted.
MARKS = ("-", "*", "•", "–", "—", "▪", "·", "‣")
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]*\w"
PHONE = r"(?:\+?\d{1,3}[\s().-]{0,3})?(?:\d[\s().-]{0,3}){8,14}\d"
URL = r"https?://[A-Za-z0-9./_-]+"

# Headings of sections, by kind.
HEADINGS = {
    "summary": "summary|profile|about me|kurzprofil|profil|über mich|résumé|perfil|resumo|о себе|sobre mí",
    "experience": "experience|work experience|employment|berufserfahrung|expérience|experiencia|experiência|опыт работы",
    "education": "education|ausbildung|formation|estudios|educación|formação|образование",
    "skills": "skills|kenntnisse|compétences|conocimientos|competências|навыки",
    "references": "references|referenzen|références|referencias|referências|рекомендации",
    "requirements": "requirements|anforderungen|exigences|requisitos|требования",
    "optional": "nice to have|wünschenswert|souhaité|se valora|deseável|desejável|будет плюсом|valorable",
    "duties": "responsibilities|aufgaben|missions|funciones|atribuições|обязанности",
}


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line): every line of each text, empty ones too; null texts have none. The one expansion others share."""
    return df.select(key, F.posexplode(T.lines(F.col(text))).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def line_geometry(lines: DataFrame) -> DataFrame:
    """Position a plain line would have: x by its indent, width by its length, inner gaps, bold by Markdown."""
    line = F.col("line")
    indent = F.length(line) - F.length(F.ltrim(line))
    bold = line.rlike(r"^#{1,6}\s") | line.rlike(r"^\*\*.+\*\*$")
    gaps = F.regexp_count(F.trim(line), F.lit(r" {3,}|\t+"))
    return lines.select("*", F.least(indent / 80, F.lit(0.4)).alias("x"), F.least(F.length(F.trim(line)) / 90, F.lit(1.0)).alias("width"), gaps.alias("inner_gaps"), bold.alias("is_bold"))


def heading_kind(line: Column) -> Column:
    """Kind of the heading that a line is, colon or not; null for other lines."""
    plain = F.lower(F.trim(F.regexp_replace(line, r"[:\s]+$", "")))
    kind = F.lit(None).cast("string")
    for name, forms in reversed(HEADINGS.items()):
        kind = F.when(plain.isin(forms.split("|")), name).otherwise(kind)
    return kind


def once(value: Column, body) -> Column:
    """body(value) with the value computed once, however often a lambda function in it reads the value."""
    return F.get(F.transform(F.array(value), body), 0)


def cut_at(lines: Column, kinds: Column) -> Column:
    """Structs (kind, lines) of an array of lines cut at those with a kind; what comes before the first has the kind null. One slice a piece, so the work is linear."""
    places = F.filter(F.sequence(F.lit(1), F.size(kinds)), lambda i: F.get(kinds, i - 1).isNotNull())

    def pieces(at: Column) -> Column:
        ends = lambda i: F.coalesce(F.get(at, i + 1), F.size(lines) + 1)
        body = lambda p, i: F.struct(F.get(kinds, p - 1).alias("kind"), F.slice(lines, p + 1, ends(i) - p - 1).alias("lines"))
        head = F.struct(F.lit(None).cast("string").alias("kind"), F.slice(lines, F.lit(1), F.coalesce(F.get(at, 0), F.size(lines) + 1) - 1).alias("lines"))
        return F.concat(F.array(head), F.transform(at, body))

    return once(places, pieces)


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, kind, n_lines, n_words, body): a text cut at its headings; what comes before the first is `contacts`.

    Headings are marked and each section is sliced once, so documents are never regrouped. Null texts have none; an empty text has one empty section.
    """
    split = lambda x: once(F.transform(x, heading_kind), lambda k: cut_at(x, k))
    found = df.where(F.col(text).isNotNull()).select(key, F.posexplode(once(T.lines(F.col(text)), split)).alias("p", "s"))
    text_of = F.array_join("s.lines", "\n")
    return found.select(key, (F.col("p") + 1).alias("section_no"), F.coalesce("s.kind", F.lit("contacts")).alias("kind"), F.size("s.lines").alias("n_lines"), T.word_count(text_of).alias("n_words"), F.trim(text_of).alias("body"))


def bullet_metrics(df: DataFrame, key: str, text: str, weak: list[str]) -> DataFrame:
    """Counts over the list lines of each text: all, quantified, opened weakly, overlong (> 34 words), stubs (< 4), average words, marks used."""
    bullets = F.filter(T.lines(F.col(text)), lambda x: x.rlike(BULLET))
    plain = F.transform(bullets, lambda x: F.regexp_replace(x, BULLET, ""))
    many = lambda test: F.size(F.filter(F.col("b"), test))
    words = F.aggregate(F.col("b"), F.lit(0).cast("bigint"), lambda a, x: a + T.word_count(x))
    marks = F.array_distinct(F.transform(F.col("raw"), lambda x: F.left(F.ltrim(x), F.lit(1))))
    d = df.where(F.col(text).isNotNull()).select(key, plain.alias("b"), bullets.alias("raw"))
    low = lambda x: F.lower(x)
    weakly = lambda x: F.exists(F.array(*[F.lit(w) for w in weak]), lambda w: F.startswith(low(x), w))
    return d.select(
        key,
        F.size("b").alias("n_bullets"),
        many(lambda x: x.rlike(r"\d")).alias("quantified"),
        many(weakly).alias("weak"),
        many(lambda x: T.word_count(x) > 34).alias("overlong"),
        many(lambda x: T.word_count(x) < 4).alias("stubs"),
        T.round1(F.coalesce(F.try_divide(words, F.size("b")), F.lit(0.0))).alias("average_words"),
        F.size(F.filter(marks, lambda m: m.isin(list(MARKS)))).alias("marks"),
    )


def sentence_metrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences of three words and more, their average length (one decimal) and those over 28 words."""
    counts = F.filter(F.transform(T.sentences(F.col(text)), lambda s: T.word_count(s)), lambda n: n >= 3)
    d = df.where(F.col(text).isNotNull()).select(key, counts.alias("n"))
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select(key, F.size("n").alias("n_sentences"), T.round1(F.coalesce(F.try_divide(total, F.size("n")), F.lit(0.0))).alias("average"), F.size(F.filter("n", lambda x: x > 28)).alias("overlong"))


def phrase_hits(df: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """(key, phrase, at): the first place of each phrase in a text, by folded case."""
    low = F.lower(F.col(text))
    found = F.transform(F.array(*[F.lit(p) for p in phrases]), lambda p: F.struct(p.alias("phrase"), (F.call_function("locate", p, low) - 1).alias("at")))
    return df.select(key, F.explode(F.filter(found, lambda h: h.getField("at") >= 0)).alias("h")).select(key, "h.phrase", "h.at")


def keyword_counts(df: DataFrame, key: str, text: str, words: list[str], more_than: int) -> DataFrame:
    """(key, word, n) of words that a text holds more than so many times, also inside other words."""
    low = F.lower(F.col(text))
    n = lambda w: ((F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w)).cast("int")
    found = F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.struct(w.alias("word"), n(w).alias("n")))
    return df.select(key, F.explode(F.filter(found, lambda h: h.getField("n") > more_than)).alias("h")).select(key, "h.word", "h.n")


def contacts(df: DataFrame, key: str, text: str) -> DataFrame:
    """First e-mail address, first telephone number of 10 to 15 digits, and the distinct links of each text."""
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    phones = F.filter(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda x: digits(x).between(10, 15))
    links = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: T.bare_url(u))))
    email = F.regexp_extract(text, EMAIL, 0)
    return df.select(key, F.when(email != "", email).alias("email"), F.get(phones, 0).alias("phone"), F.array_join(links, " ").alias("links"))


def redact(c: Column) -> Column:
    """E-mail addresses, links and numbers of telephone length replaced by unnumbered placeholders."""
    c = F.regexp_replace(F.regexp_replace(c, EMAIL, "[[EMAIL]]"), URL, "[[URL]]")
    return F.regexp_replace(c, r"(?:\+\d{1,3}[\s(-]?)?(?:\d[\s()-]?){9,14}\d", "[[PHONE]]")


def redact_known(c: Column, values: Column) -> Column:
    """struct(text, entries): known values of three and more characters first, longest first, as [[PII_n]]; then e-mail addresses, links and telephone numbers as [[EMAIL_n]], [[URL_n]], [[PHONE_n]].

    n counts on over all placeholders; entries map those of known values that were found to the value, the others to an empty string, as these can't be put back. Null texts give null.
    """
    state = "struct<text:string,n:int,entries:array<struct<key:string,value:string>>>"
    start = F.struct(c.alias("text"), F.lit(0).alias("n"), F.array().cast("array<struct<key:string,value:string>>").alias("entries")).cast(state)
    add = lambda acc, key, value, text: F.struct(text.alias("text"), (acc.getField("n") + 1).alias("n"), F.array_append(acc.getField("entries"), F.struct(key.alias("key"), value.alias("value"))).alias("entries"))
    named = lambda kind, n: F.concat(F.lit(f"[[{kind}_"), n.cast("string"), F.lit("]]"))

    def known(acc: Column, value: Column) -> Column:
        key = named("PII", acc.getField("n"))
        hit = F.contains(acc.getField("text"), value)
        return F.when(hit, add(acc, key, value, F.replace(acc.getField("text"), value, key))).otherwise(F.struct(acc.getField("text").alias("text"), (acc.getField("n") + 1).alias("n"), acc.getField("entries").alias("entries")))

    def shape(acc: Column, kind: str, pattern: str, fits=lambda x: F.lit(True)) -> Column:
        # The text is cut at the matches; each place between two pieces gets the next number.
        def replace(a: Column) -> Column:
            found = F.filter(F.array_distinct(F.regexp_extract_all(a.getField("text"), F.lit(pattern), F.lit(0))), fits)
            ordered = F.array_sort(found, lambda x, y: F.when(F.length(x) == F.length(y), F.when(x < y, -1).when(x > y, 1).otherwise(0)).otherwise(F.length(y) - F.length(x)).cast("int"))
            return F.aggregate(ordered, a, lambda b, m: add(b, named(kind, b.getField("n")), F.lit(""), F.replace(b.getField("text"), m, named(kind, b.getField("n")))))

        return once(acc, replace)

    digits = lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 10
    wanted = F.filter(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda v: v.isNotNull() & (F.length(F.trim(v)) >= 3))
    longest = F.array_sort(wanted, lambda x, y: F.when(F.length(x) == F.length(y), F.when(x < y, -1).when(x > y, 1).otherwise(0)).otherwise(F.length(y) - F.length(x)).cast("int"))
    done = F.aggregate(longest, start, known)
    for kind, pattern, fits in (("EMAIL", EMAIL, lambda x: F.lit(True)), ("URL", r"(?:https?://|www\.)[^\s<>\",;)\]]+", lambda x: F.lit(True)), ("PHONE", r"(?:\+\d{1,3}[\s(-]?)?(?:\d[\s()-]?){9,14}\d", digits)):
        done = shape(done, kind, pattern, fits)
    return F.when(c.isNotNull(), once(done, lambda a: F.struct(a.getField("text").alias("text"), F.map_from_entries(a.getField("entries")).alias("entries"))))


def restore(c: Column, placeholders: Column) -> Column:
    """Placeholders put back from a map; unknown ones, and those without a value, stay."""
    return F.aggregate(F.filter(F.map_entries(placeholders), lambda e: e.getField("value") != ""), c, lambda acc, e: F.replace(acc, e.getField("key"), e.getField("value")))


def leaks(c: Column, values: Column) -> Column:
    """Values of three and more characters that a redacted text still holds."""
    return F.filter(values, lambda v: v.isNotNull() & (F.length(v) >= 3) & F.contains(c, v))


def scan_terms(c: Column, terms: list[str]) -> Column:
    """Terms found longest first; a hit is blanked out, so that shorter terms inside it don't count. Ascending array."""
    ordered = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))

    def step(acc: Column, term: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), term, F.lit(r"\E(?![\p{L}\p{N}])"))
        hit = F.regexp_like(acc.getField("text"), pattern)
        blanked = F.call_function("regexp_replace", acc.getField("text"), pattern, F.repeat(F.lit("\u0001"), F.length(term)))
        return F.when(hit, F.struct(blanked.alias("text"), F.array_append(acc.getField("hits"), term).alias("hits"))).otherwise(acc)

    def scan(low: Column) -> Column:
        state = F.struct(low.alias("text"), F.array().cast("array<string>").alias("hits"))
        present = F.filter(F.array(*[F.lit(t) for t in ordered]).cast("array<string>"), lambda t: F.contains(low, t))
        return F.aggregate(present, state, step, lambda acc: F.array_sort(acc.getField("hits")))

    # The lower-case text is made once, not for each term.
    return F.get(F.transform(F.array(F.lower(c)), scan), 0)


def scan_names(c: Column, names: dict[str, str]) -> Column:
    """Distinct names of the terms found, ascending; names: term to its name, terms by folded case."""
    folded = {t.lower(): n for t, n in names.items() if t.strip()}
    if not folded:
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    named = F.create_map(*[F.lit(x) for pair in sorted(folded.items()) for x in pair])
    return F.array_sort(F.array_distinct(F.transform(scan_terms(c, list(folded)), lambda t: F.try_element_at(named, t))))
