"""Free-entered values mapped to the entries of a reference list, in Spark SQL only.

Values are reduced to their letters and digits without decorations ("good knowledge of", "(3+ years)"). Each name and
alias of the reference enters without spaces, from each of its words on (a rotation), so that a pair of words may stand either way. What is not equal goes through a partition-based
pigeonhole join: a reference string of length L is cut into k + 1 segments, so that a value within k edits shares one
of them unchanged at nearly the same place; an equality join on (L, segment, piece) finds the candidates and the
built-in levenshtein verifies them. Words in any other order meet by the same principle: of three words or more with two edits at most, one is unchanged, so an equality join
on (number of words, word) finds the candidates, and what equal words leave on either side, at most two words, is compared. Values without any match come back through an anti-join with id 0.
"""

from pyspark.sql import DataFrame

from ..session import cut

# Phrases around a value that say nothing about which entry it means.
LEADING = ("good knowledge of", "experience in", "experience with", "knowledge of", "solid", "strong", "basic", "proven")
TRAILING = ("advanced", "certified", "or similar", "skills", "skill")
#: Most edits (a swap of neighbours counts as one) of strings of at least SHORT characters; shorter ones allow one, up to EXACT none.
MOST_EDITS, SHORT, EXACT = 2, 6, 3
#: Fewest characters of a word cut short by a full stop, all words together.
LEAST_PREFIX = 5

def _plain(column: str) -> str:
    """SQL: lower case, decorations off, one space between words."""
    lead, trail = "|".join(LEADING), "|".join(TRAILING)
    text = f"lower({column})"
    text = rf"regexp_replace({text}, r'\(\s*\d+\s*\+?\s*years?\s*\)', ' ')"
    text = rf"trim(regexp_replace({text}, r'[^\p{{{{L}}}}\p{{{{N}}}}+#]+', ' '))"
    for _ in range(2):
        text = rf"regexp_replace({text}, r'^(?:{lead}) | (?:{trail})$', '')"
    return text


def _edits(length: str) -> str:
    return f"CASE WHEN {length} <= {EXACT} THEN 0 WHEN {length} < {SHORT} THEN 1 ELSE {MOST_EDITS} END"


def _radius(length: str) -> str:
    """Levenshtein radius that holds all strings within the edits, since a swap of neighbours costs it two."""
    return f"({_edits(length)}) * 2"


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(value, skill_id, n_entries) for each distinct non-null value; skill_id 0 where no entry is meant.

    values has a column value, reference the columns id, name and aliases (array). Equal forms win over cut ones, those over
    fewer edits; n_entries tells how many entries are equally near, of which the smallest id is given (0 for no entry). Empty and blank values, and values of signs only, get 0; the empty table gives no row.
    """
    spark = values.sparkSession
    # Each step is cut off, as it is read several times below.
    forms = spark.sql(
        f"""
        WITH names AS (SELECT id, explode(concat(array(name), coalesce(aliases, array()))) AS form FROM {{ref}}),
        plain AS (SELECT id, {_plain('form')} AS form FROM names WHERE form IS NOT NULL),
        parts AS (SELECT id, split(form, ' ') AS w FROM plain WHERE form != ''),
        turned AS (SELECT id, w, explode(sequence(0, size(w) - 1)) AS o FROM parts)
        SELECT key, min(id) AS id, collect_set(id) AS ids FROM (SELECT id, array_join(concat(slice(w, o + 1, size(w)), slice(w, 1, o)), '') AS key FROM turned) GROUP BY key
        """,
        ref=reference,
    )
    distinct = spark.sql(
        f"""
        SELECT value, replace(plain, ' ', '') AS key, plain, value LIKE '%.%' AS cut
        FROM (SELECT value, {_plain('value')} AS plain FROM (SELECT DISTINCT value FROM {{v}} WHERE value IS NOT NULL))
        """,
        v=values,
    )
    forms, distinct = cut(forms), cut(distinct)
    equal = spark.sql("SELECT v.value, v.key, v.plain, v.cut, f.ids FROM {v} v LEFT JOIN {f} f ON v.key = f.key", v=distinct, f=forms)
    equal = cut(equal)
    # Spread by the key over all tasks: each row becomes many probes below.
    parts = max(8, spark.sparkContext.defaultParallelism)
    open_keys = spark.sql("SELECT key, plain, cut FROM {e} WHERE ids IS NULL AND key != '' GROUP BY key, plain, cut", e=equal)
    # A word cut short by a full stop: each word of a form cut to each length, compared by equality.
    cut_forms = spark.sql(
        f"""
        WITH names AS (SELECT id, explode(concat(array(name), coalesce(aliases, array()))) AS form FROM {{ref}}),
        parts AS (SELECT id, split({_plain('form')}, ' ') AS w FROM names WHERE form IS NOT NULL),
        words AS (SELECT id, w, posexplode(w) AS (i, x) FROM parts),
        cuts AS (SELECT id, w, i, x, explode(sequence(2, length(x) - 1)) AS n FROM words WHERE length(x) > 2)
        SELECT key, collect_set(id) AS ids FROM (
          SELECT id, concat(array_join(slice(w, 1, i), ''), left(x, n), array_join(slice(w, i + 2, size(w)), '')) AS key FROM cuts)
        WHERE length(key) >= {LEAST_PREFIX} GROUP BY key
        """,
        ref=reference,
    )
    open_keys = cut(open_keys.repartition(parts, "key"))
    shortened = spark.sql("SELECT DISTINCT o.key, p.ids FROM {o} o JOIN {p} p ON o.key = p.key WHERE o.cut", o=open_keys, p=cut_forms)
    segments = spark.sql(
        f"""
        WITH sized AS (SELECT key, length(key) AS len, {_radius('length(key)')} AS k FROM {{f}}),
        cuts AS (SELECT key, len, k, explode(sequence(0, k)) AS seg FROM sized WHERE k > 0 AND len > k)
        SELECT key AS ref, len, k, seg, CAST(floor(seg * len / (k + 1)) AS INT) AS at, CAST(floor((seg + 1) * len / (k + 1)) AS INT) - CAST(floor(seg * len / (k + 1)) AS INT) AS n,
               substring(key, CAST(floor(seg * len / (k + 1)) AS INT) + 1, CAST(floor((seg + 1) * len / (k + 1)) AS INT) - CAST(floor(seg * len / (k + 1)) AS INT)) AS piece
        FROM cuts
        """,
        f=forms,
    )
    segments = cut(segments)
    # With d = length of the value - L, an unchanged segment moves by at most (k - d) / 2 to the left and (k + d) / 2 to the right.
    candidates = spark.sql(
        f"""
        WITH layout AS (SELECT DISTINCT len, k, seg, at, n FROM {{s}}),
        probes AS (
          SELECT DISTINCT o.key, l.len, l.seg, substring(o.key, p + 1, l.n) AS piece
          FROM (SELECT key, explode(sequence(greatest(length(key) - 4, 1), length(key) + 4)) AS len FROM {{o}}) o
          JOIN layout l ON o.len = l.len
          LATERAL VIEW explode(sequence(l.at - l.k, l.at + l.k)) AS p
          WHERE abs(length(o.key) - l.len) <= l.k AND p >= 0 AND p + l.n <= length(o.key)
            AND p - l.at BETWEEN -floor((l.k - (length(o.key) - l.len)) / 2) AND floor((l.k + (length(o.key) - l.len)) / 2)
        )
        SELECT DISTINCT p.key, s.ref, s.k FROM probes p JOIN {{s}} s ON p.len = s.len AND p.seg = s.seg AND p.piece = s.piece
        """,
        s=segments,
        o=open_keys,
    ).repartition(parts, "key", "ref")
    # Words in another order: a shared word finds the form, and the words left over are compared, in either order where two are left.
    worded = spark.sql(
        f"""
        WITH names AS (SELECT id, explode(concat(array(name), coalesce(aliases, array()))) AS form FROM {{ref}}),
        forms AS (SELECT DISTINCT split({_plain('form')}, ' ') AS w FROM names WHERE form IS NOT NULL),
        known AS (SELECT w, size(w) AS n, length(array_join(w, '')) AS len, explode(array_distinct(w)) AS word FROM forms WHERE size(w) > 2),
        typed AS (SELECT key, split(plain, ' ') AS v, explode(array_distinct(split(plain, ' '))) AS word FROM {{o}} WHERE plain LIKE '% % %'),
        met AS (SELECT DISTINCT t.key, t.v, k.w, k.len FROM typed t JOIN known k ON size(t.v) = k.n AND t.word = k.word WHERE abs(length(t.key) - k.len) <= {MOST_EDITS}),
        -- A word that stands twice is taken off as often as the other side has it.
        left_over AS (SELECT key, w, len,
          filter(transform(v, (x, i) -> IF(size(filter(slice(v, 1, i + 1), y -> y = x)) <= size(filter(w, y -> y = x)), NULL, x)), x -> x IS NOT NULL) AS a,
          filter(transform(w, (x, i) -> IF(size(filter(slice(w, 1, i + 1), y -> y = x)) <= size(filter(v, y -> y = x)), NULL, x)), x -> x IS NOT NULL) AS b FROM met)
        SELECT DISTINCT key, array_join(w, '') AS ref, len, array_join(a, '') AS own, array_join(c, '') AS other
        FROM left_over LATERAL VIEW explode(IF(size(b) = 2, array(b, reverse(b)), array(b))) AS c WHERE size(b) <= {MOST_EDITS} AND size(a) = size(b)
        """,
        ref=reference,
        o=open_keys,
    )
    # Letters that one string has more of than the other: with levenshtein it tells swaps from replacements.
    near = spark.sql(
        f"""
        WITH pairs AS (SELECT key, ref, key AS own, ref AS other, length(ref) AS len FROM {{c}} UNION ALL SELECT key, ref, own, other, len FROM {{w}}),
        close AS (SELECT *, levenshtein(own, other, {2 * MOST_EDITS}) AS lev FROM pairs),
        bag AS (
          SELECT *, CASE WHEN own = '' THEN 0 ELSE size(filter(transform(sequence(0, length(own) - 1), i -> (substring(own, i + 1, 1), length(own) - length(replace(left(own, i), substring(own, i + 1, 1), '')) - (length(own) - i))),
                 x -> x.col2 >= length(other) - length(replace(other, x.col1, '')))) END AS more FROM close WHERE lev >= 0),
        costs AS (SELECT *, (lev + greatest(more, more + length(other) - length(own))) / 2 AS cost FROM bag),
        best AS (SELECT key, ref, cost, lev, min((cost, lev)) OVER (PARTITION BY key) AS least FROM costs WHERE cost <= {_edits('len')})
        SELECT b.key, array_distinct(flatten(collect_list(f.ids))) AS ids FROM (SELECT DISTINCT key, ref FROM best WHERE (cost, lev) = least) b JOIN {{f}} f ON b.ref = f.key GROUP BY b.key
        """,
        c=candidates,
        w=worded,
        f=forms,
    )
    fuzzy = spark.sql(
        "SELECT o.key, o.cut, CASE WHEN o.cut THEN coalesce(s.ids, n.ids) ELSE n.ids END AS ids FROM (SELECT DISTINCT key, cut FROM {o}) o LEFT JOIN {s} s ON o.key = s.key LEFT JOIN {n} n ON o.key = n.key",
        o=open_keys,
        s=shortened,
        n=near,
    )
    fuzzy = cut(fuzzy)
    found = spark.sql(
        "SELECT value, ids FROM {e} WHERE ids IS NOT NULL UNION ALL SELECT e.value, f.ids FROM {e} e JOIN {f} f ON e.key = f.key AND e.cut = f.cut WHERE e.ids IS NULL AND f.ids IS NOT NULL",
        e=equal,
        f=fuzzy,
    )
    return spark.sql(
        "SELECT value, array_min(ids) AS skill_id, size(ids) AS n_entries FROM {m} UNION ALL SELECT v.value, 0, 0 FROM {v} v LEFT ANTI JOIN {m} m ON v.value = m.value",
        m=found,
        v=distinct,
    )


def map_field_values(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """(field, record_id, pos, skill_id) of each cell (field, record_id, pos, value) that isn't a reference name itself.

    Null values are no value; repeated cells count once.
    """
    spark = cells.sparkSession
    own = spark.sql("SELECT DISTINCT c.* FROM {c} c LEFT ANTI JOIN {r} r ON c.value = r.name WHERE c.value IS NOT NULL", c=cells, r=reference)
    own = cut(own)
    mapped = map_values(own, reference)
    return spark.sql("SELECT o.field, o.record_id, o.pos, m.skill_id FROM {o} o JOIN {m} m ON o.value = m.value", o=own, m=mapped)
