r"""String functions as column expressions. All give null for null unless stated, and take texts of any length.

White space is Unicode white space and U+FEFF (Java's \s alone is ASCII); spans count code points from 0, half-open.
"""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}+#./'-]*"
_EDGE_LEFT, _EDGE_RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def _accent_table() -> tuple[str, str]:
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if base != ch and len(base) == 1:
            pairs.append((ch, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize(c: Column) -> Column:
    """Accents off, dashes and quotes in one form, lower case, trimmed; by built-ins only, so compatibility forms stay."""
    text = F.translate(F.regexp_replace(c, r"[\x{300}-\x{36F}]", ""), *_accent_table())
    text = F.regexp_replace(text, r"[\x{2010}-\x{2015}\x{2212}]", "-")
    text = F.translate(text, "\u2018\u2019\u02bc\u201c\u201d\u00a0", "\'\'\'\"\" ")
    return F.trim(F.lower(text))


def normalize_exact(c: Column) -> Column:
    """The same with full NFKD, which Spark lacks: vectorised Python."""
    import pandas as pd

    @F.pandas_udf("string")
    def nfkd(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not 0x300 <= ord(x) <= 0x36F), na_action="ignore")

    return normalize(nfkd(c))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def sentences(c: Column) -> Column:
    """Pieces cut after . ! ? before a capital or digit, and at line ends; trimmed, no empty ones."""
    parts = F.split(c, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}])|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def lines(c: Column) -> Column:
    return F.split(c, r"\r?\n")


def detect_script(c: Column) -> Column:
    """latin, cyrillic, mixed or unknown by the Latin share (bounds .9 and .1)."""
    latin, cyrillic = F.regexp_count(c, F.lit(r"\p{IsLatin}")), F.regexp_count(c, F.lit(r"\p{IsCyrillic}"))
    share = F.try_divide(latin, latin + cyrillic)
    return F.when(c.isNull(), None).when(share.isNull(), "unknown").when(share > 0.9, "latin").when(share < 0.1, "cyrillic").otherwise("mixed")


def loose_equals(a: Column, b: Column) -> Column:
    """Equal within min(2, floor(longer / 4)) edits, both in normalized form."""
    a, b = normalize(a), normalize(b)
    most = F.least(F.lit(2), F.floor(F.greatest(F.length(a), F.length(b)) / 4))
    return F.levenshtein(a, b) <= most


def find_span(text: Column, needle: Column, start: int = 0) -> Column:
    """struct(start, end) of the first occurrence from start, or null."""
    at = F.call_function("locate", needle, text, F.lit(start + 1))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(needle)).alias("end")))


def clamp_span(start: Column, end: Column, size: Column) -> Column:
    low = F.greatest(F.lit(0), F.least(start, size))
    return F.struct(low.alias("start"), F.greatest(low, F.least(end, size)).alias("end"))


def excerpt(c: Column, most: int) -> Column:
    """At most `most` characters, with an ellipsis in the middle."""
    head, tail = -(-(most - 1) // 2), (most - 1) // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("…"), F.right(c, F.lit(tail))))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def uppercase_ratio(c: Column) -> Column:
    """Capital letters by letters; 0 without letters."""
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit(r"\p{Lu}")), F.regexp_count(c, F.lit(r"\p{L}"))), F.when(c.isNotNull(), 0.0))


def escape_regex(text: str) -> str:
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}-/" else ch for ch in text)


def word_pattern(alternatives: list[str]) -> str:
    return f"(?iu){_EDGE_LEFT}(?:{'|'.join(map(escape_regex, alternatives))}){_EDGE_RIGHT}"


def contains_word(c: Column, alternatives: list[str]) -> Column:
    return c.rlike(word_pattern(alternatives))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_hash: FNV-1a, 32 bits, in base 36, over the UTF-16 units of the NUL-joined parts (nulls as empty)."""
    joined = F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    mixed = lambda h, unit: (h.bitwiseXOR(unit) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))

    def step(h: Column, unit: Column) -> Column:
        # A character beyond the first plane is two units.
        above = unit - 65536
        return F.when(unit < 65536, mixed(h, unit)).otherwise(mixed(mixed(h, F.lit(55296) + F.floor(above / 1024)), F.lit(56320) + above % 1024))

    units = F.transform(F.filter(F.split(joined, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint"))
    value = F.aggregate(units, F.lit(2166136261).cast("bigint"), step)
    return F.concat(F.lit(prefix + "_"), F.lower(F.conv(value.cast("string"), 10, 36)))


def random_id(prefix: str) -> Column:
    """prefix_ and twelve random hexadecimal digits; differs at each evaluation."""
    return F.concat(F.lit(prefix + "_"), F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(12)))


def json_object(c: Column, ddl: str) -> Column:
    """The object between the first { and the last } of a text, read by a schema; fields that don't fit it are null, and the whole is null where no object stands."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(inner != "", F.from_json(inner, ddl, {"mode": "PERMISSIVE"}))


def plural_ru(n: Column, one: str, few: str, many: str) -> Column:
    ten, hundred = F.abs(n) % 10, F.abs(n) % 100
    return F.when(hundred.between(11, 14), many).when(ten == 1, one).when(ten.between(2, 4), few).otherwise(many)


def bare_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^(?i)https?://(?:www\.)?", ""), "/+$", "")


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def round1(c: Column) -> Column:
    return F.floor(c * 10 + 0.5) / 10
