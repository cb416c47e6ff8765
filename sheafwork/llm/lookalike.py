"""One consistent form for texts that look the same.

Look-alike relations between strings and code points are joined to classes by union-find, so they are
transitive. Each class is represented by its most frequent member in the given texts, and a multi-pattern automaton
rewrites every other member, leftmost and longest first. Accents are handled on decomposed text and composed
again afterwards; characters that show nothing are dropped.
"""

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Letters drawn alike in Latin, Cyrillic and Greek, as "Latin: others".
LOOKALIKES = """
a: а
c: с ϲ
d: ԁ
e: е
h: һ
i: і
j: ј ϳ
l: ӏ
o: о ο
p: р ρ
q: ԛ
s: ѕ
v: ν ѵ
w: ԝ
x: х
y: у
A: А Α
B: В Β
C: С Ϲ
E: Е Ε
F: Ϝ
G: Ԍ
H: Н Η
I: І Ι Ӏ
J: Ј Ϳ
K: К Κ K
M: М Μ
N: Ν
O: О Ο
P: Р Ρ
Q: Ԛ
S: Ѕ
T: Т Τ
V: Ѵ
W: Ԝ
X: Х Χ
Y: Υ Ү
Z: Ζ
Å: Å
-: ‐ ‑
·: ·
;: ;
"""


def _width_and_join_rules() -> Iterator[tuple[str, str]]:
    """Relations that Unicode states itself: widths, joined letters and spaces of every kind."""
    for code in range(0xA0, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xF8FF or 0x20000 <= code:
            continue
        ch = chr(code)
        if unicodedata.category(ch) == "Zs":
            yield ch, " "
            continue
        kind, _, _ = unicodedata.decomposition(ch).partition(" ")
        if kind in ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>"):
            plain = unicodedata.normalize("NFKD", ch)
            if plain != ch and not any(unicodedata.combining(c) or c == " " for c in plain):
                yield ch, plain


@cache
def relations() -> tuple[tuple[str, str], ...]:
    pairs = list(_width_and_join_rules())
    for line in LOOKALIKES.strip().splitlines():
        latin, others = line[0], line[2:].split()
        pairs += [(other, latin) for other in others]
    return tuple((unicodedata.normalize("NFD", a) if len(a) > 1 else a, b) for a, b in pairs)


def classes(pairs: tuple[tuple[str, str], ...]) -> list[list[str]]:
    """Transitive classes of the related strings, by union-find with path halving."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        # A joined form equals its letters' representatives, so a longer string is related letter by letter.
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
    found: dict[str, list[str]] = {}
    for x in list(parent):
        found.setdefault(root(x), []).append(x)
    return [sorted(c) for c in found.values() if len(c) > 1]


@cache
def invisible() -> tuple[str, ...]:
    return tuple(chr(c) for c in range(0xA0, 0xE0200) if not 0xD800 <= c <= 0xF8FF and is_invisible(chr(c)))


def is_invisible(ch: str) -> bool:
    """Format characters and variation selectors; what they do to the look of a text is nothing."""
    code = ord(ch)
    return unicodedata.category(ch) == "Cf" and not (0x600 <= code <= 0x605 or code in (0x6DD, 0x70F, 0x8E2)) or 0xFE00 <= code <= 0xFE0F or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xE0100 <= code <= 0xE01EF


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Rewrite table: each member of a class to the most frequent one; a string counts as its rarest letter.

    Ties, and classes that never occur, go to the plainest (unchanged by NFKD), shortest, smallest member.
    """
    table: dict[str, str] = {}
    often = lambda s: min(counts.get(c, 0) for c in s)
    for members in classes(relations()):
        best = min(members, key=lambda s: (-often(s), s != unicodedata.normalize("NFKD", s), len(s), s))
        table |= {m: best for m in members if m != best}
    # Representatives of strings are themselves made of representatives.
    single = {k: v for k, v in table.items() if len(k) == 1}
    settle = lambda s: "".join(single.get(c, c) for c in s) if len(s) > 1 else s
    table = {k: settle(v) for k, v in table.items()}
    table |= dict.fromkeys(invisible(), "")
    return table


class Rewriter:
    """Greedy leftmost-longest rewriting with an Aho-Corasick automaton over decomposed text.

    Only runs of other than ASCII characters, and members with ASCII characters, need the automaton; their results are kept,
    up to KEPT of them, as they repeat.
    """

    KEPT = 200_000

    def __init__(self, table: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for member, best in table.items():
            self.automaton.add_word(member, (len(member), best))
        self.automaton.make_automaton()
        mixed = sorted((m for m in table if any(c.isascii() for c in m)), key=lambda m: (-len(m), m))
        self.plain_ascii = not any(m.isascii() for m in mixed)
        self.run = re.compile("|".join([*map(re.escape, mixed), "[^\x00-\x7f]+"]))
        self.kept: dict[str, str] = {}

    def _rewrite(self, text: str) -> str:
        out, at = [], 0
        for end, (size, best) in self.automaton.iter_long(text):
            out.append(text[at : end - size + 1])
            out.append(best)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def _run(self, match: re.Match) -> str:
        run = match.group()
        best = self.kept.get(run)
        if best is None:
            best = self._rewrite(run)
            if len(self.kept) < self.KEPT:
                self.kept[run] = best
        return best

    def __call__(self, text: str) -> str:
        if self.plain_ascii and text.isascii():
            return text
        text = self.run.sub(self._run, unicodedata.normalize("NFD", text))
        return unicodedata.normalize("NFC", text)


def code_point_counts(df: DataFrame, text: str) -> dict[str, int]:
    """How often each member letter of a class occurs in all rows; the result has at most one row a code point."""
    wanted = sorted({c for pair in relations() for s in pair for c in s})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            joined = "".join(batch[text].dropna())
            total += np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=0x110000)
        codes = np.fromiter((ord(c) for c in wanted), np.int64)
        codes = codes[total[codes] > 0]
        yield pd.DataFrame({"code": codes, "n": total[codes]})

    rows = df.select(text).mapInPandas(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {chr(r.code): r.n for r in rows}


def canonical_column(df: DataFrame, text: str, out: str, counts: dict[str, int]) -> DataFrame:
    """df with the consistent form of a text column; null stays null, an empty text stays empty."""

    best = representatives(counts)

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(best)
        for texts in batches:
            yield texts.map(rewriter, na_action="ignore")

    return df.withColumn(out, rewrite(F.col(text)))


def keyed(df: DataFrame, key: str, text: str, counts: dict[str, int]) -> DataFrame:
    """(key, look, raw): 128-bit digests of the consistent form and of the characters; null texts are left out."""

    best = representatives(counts)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = Rewriter(best)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            texts = batch[text]
            yield pd.DataFrame({"id": batch[key], "look": [digest(rewriter(t)) for t in texts], "raw": [digest(t) for t in texts]})

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(digests, "id bigint, look binary, raw binary")


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(left_id, right_id): pairs of rows that look the same but differ in their characters, smaller id first.

    Only looks with several raw forms go on. Pairs are made between raw forms, and rows join theirs by equality, so
    copies of one raw form are never compared with each other. Repeated ids of one text give each pair once.
    """
    rows = cut(keyed(df, key, text, code_point_counts(df, text)).distinct())
    several = rows.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo < hi").select("look")
    rows = rows.join(several, "look", "left_semi")
    forms = rows.select("look", "raw").distinct()
    other = forms.select("look", F.col("raw").alias("raw2"))
    twins = forms.join(other, "look").where("raw < raw2").select("raw", "raw2")
    left = rows.select(F.col("id").alias("i"), "raw")
    right = rows.select(F.col("id").alias("j"), F.col("raw").alias("raw2"))
    pairs = twins.join(left, "raw").join(right, "raw2")
    return pairs.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id")).where("left_id < right_id").distinct()


def same_look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class_id, n_links): each row whose text looks like another of other characters, with its class and the number of rows it looks like so.

    class_id is the digest of the consistent form. Copies are counted, not paired, so a look of many copies costs as much as any rows. Null texts and looks of one raw form give no row; repeated rows count once.
    """
    rows = cut(keyed(df, key, text, code_point_counts(df, text)).distinct())
    forms = rows.groupBy("look", "raw").agg(F.count("*").alias("n"))
    looks = forms.groupBy("look").agg(F.sum("n").alias("total"), F.count("*").alias("forms")).where("forms > 1")
    linked = forms.join(looks, "look").select("look", "raw", (F.col("total") - F.col("n")).alias("n_links"))
    return rows.join(linked, ["look", "raw"]).select("id", F.lower(F.hex("look")).alias("class_id"), "n_links")


def same_look_entries(df: DataFrame, key: str, array: str, reference: DataFrame, ref_id: str, ref_text: str) -> DataFrame:
    """(left_id, right_id, pos): array elements that look like a reference text but aren't the same characters.

    Null arrays, null elements and equal characters give nothing; pos counts from 1.
    """
    items = df.select(F.col(key).alias("left_id"), F.posexplode(array).alias("p", "item")).where("item is not null")
    values = items.select("item").distinct()
    counts = code_point_counts(values, "item")
    looks = canonical_column(values, "item", "look", counts)
    ref = canonical_column(reference.select(F.col(ref_id).cast("bigint").alias("right_id"), F.col(ref_text).alias("name")), "name", "look", counts)
    hits = looks.join(ref, "look").where("item != name").select("item", "right_id")
    return items.join(hits, "item").select("left_id", "right_id", (F.col("p") + 1).cast("int").alias("pos")).distinct()
