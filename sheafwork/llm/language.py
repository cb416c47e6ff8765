"""Language of texts and of paragraphs in another language, by language-bitmask n-gram filters.

One array of bytes holds a bit-sliced Bloom filter: bit b of a slot belongs to language b, so that three probes
joined by AND give at once all languages that contain an n-gram. Per sentence, the bits are counted for each
language, corrected for the filter's false positives, and the highest count decides. The filter is filled from a
bounded sample of labelled rows (SAMPLE_ROWS) in two rounds, so that wrong labels lose their weight.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import LOOKALIKES
from .sampling import hash_sample

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru")
#: Rows of the training sample (the smallest by a hash of the id), code points of an n-gram, slots of the filter.
SAMPLE_ROWS, N, SLOTS = 1800, 4, 1 << 20
#: An n-gram belongs to a language if at least this share of its weighted occurrences does, relative to its best language.
KEEP_SHARE = 0.3
MIN_WORDS = 12
#: Texts of one round of counting, which bounds the memory of the arrays.
ROUND_TEXTS = 256

# Names and codes by which a label names a language.
LABELS = {
    "en": "en eng english",
    "de": "de deu ger german",
    "fr": "fr fra fre french",
    "es": "es spa spanish",
    "pt": "pt por portuguese",
    "ru": "ru rus russian",
}
_CODE_OF = {form: code for code, forms in LABELS.items() for form in forms.split()}

_ODD = re.compile("[­̀-ͯ​-‏⁠-⁤﻿ﬀ-ﬆ！-～]")
_FOREIGN = re.compile("[\u0370-\u04ff]")
_LATIN, _OTHER = "A-Za-z\u00c0-\u024f", "\u0370-\u04ff"
_MIXED = re.compile(f"[\\w\u0300-\u036f]*(?:[{_LATIN}][\u0300-\u036f]*[{_OTHER}]|[{_OTHER}][\u0300-\u036f]*[{_LATIN}])[\\w\u0300-\u036f]*")
_MIX_EDGE = re.compile(f"[{_LATIN}][\u0300-\u036f]*[{_OTHER}]|[{_OTHER}][\u0300-\u036f]*[{_LATIN}]")
_ALIKE = [(line[0], other) for line in LOOKALIKES.strip().splitlines() for other in line[2:].split() if line[0].isalpha()]
_TO_LATIN = {ord(o): a for a, o in _ALIKE}
_TO_CYRILLIC = {ord(a): o for a, o in reversed(_ALIKE) if "\u0400" <= o <= "\u04ff"}
_ONLY_LATIN = set("bfgkmnrtuzDFGLRUVNQSWYZIJ") | {chr(c) for c in range(0xC0, 0x250)}
_ONLY_CYRILLIC = {chr(c) for c in range(0x400, 0x500)} - {o for _, o in _ALIKE}
_DROP = re.compile("[­​-‏⁠-⁤﻿]")
_SPACES = re.compile("[  -   　]")
_EMPTY_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")
_BULLET = re.compile(r"\s*(?:[-*•–—▪·‣◦]|\d{1,2}[.)])\s")
_SENTENCE = re.compile(r"(?<=[.!?…])[»”\"')]*\s+(?=\S)")
_END = re.compile(r"[.!?…:][»”\"')]*\s*$")
_NOT_PROSE = re.compile(r"@|https?:|\d{4}\s*[-–—]|\d{1,2}[./]\d{4}|(?:\d[\s().-]*){7}")
_WORD = re.compile(r"[^\W\d_]{2,}")
_SEPARATOR = "\n"


def label_code(label: str | None) -> str | None:
    """Language code that a declared label names, in any case, with or without a region; None for none."""
    if not label:
        return None
    return _CODE_OF.get(re.split(r"[-_ ]", label.strip().lower())[0])


def _one_script(match: re.Match) -> str:
    word = match.group()
    cyrillic = sum(c in _ONLY_CYRILLIC for c in word)
    latin = sum(c in _ONLY_LATIN for c in word)
    return word.translate(_TO_CYRILLIC if cyrillic > latin else _TO_LATIN)


def one_script(text: str) -> str:
    """Words that mix scripts in one script each; characters keep their places."""
    return _MIXED.sub(_one_script, text) if _MIX_EDGE.search(text) else text


def plain(text: str) -> str:
    """Text without what would break n-grams: invisible characters, other widths, decomposed accents, letters of another script in a word."""
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", one_script(_DROP.sub("", text)))
    elif _FOREIGN.search(text):
        text = one_script(text)
    return _SPACES.sub(" ", text)


def pieces(text: str) -> list[tuple[int, bool, list[str]]]:
    """(paragraph number, can be a case, sentences and duty lines) of each paragraph that has any.

    Paragraphs are the pieces between empty lines, counted from 1. One without list lines, whose words stand mostly in
    sentences and are at least MIN_WORDS, can be a case. In others the lines of four words and more count for
    the main language, except those with contact data or periods.
    """
    out = []
    number = 0
    for part in _EMPTY_LINES.split(text):
        if not part.strip():
            continue
        number += 1
        lines = [x for x in part.split("\n") if x.strip()]
        if not any(_BULLET.match(x) for x in lines):
            whole = " ".join(lines)
            chunks = _SENTENCE.split(whole)
            told = [c for c in chunks if _END.search(c) and len(_WORD.findall(c)) >= 3]
            words = len(whole.split())
            inside = sum(len(c.split()) for c in told)
            if told and inside * 10 >= words * 6:
                out.append((number, inside >= MIN_WORDS, told))
                continue
        duties = [x for x in lines if len(_WORD.findall(x)) >= 4 and not _NOT_PROSE.search(x)]
        if duties:
            out.append((number, False, duties))
    return out


def ngram_hashes(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of separator-joined lower-case segments; segment numbers; validity."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = codes == ord(_SEPARATOR)
    segment = np.cumsum(breaks)
    letter = codes > 64
    codes = np.where(letter, codes, 32).astype(np.uint64)
    n = len(codes) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for i in range(N):
        h = (h << np.uint64(16)) ^ codes[i : i + n]
    valid = (segment[:n] == segment[N - 1 :]) & letter[1 : n + 1] & letter[2 : n + 2]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h, segment[:n], valid


def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.uint64(SLOTS - 1)
    return h & m, (h >> np.uint64(21)) & m, (h >> np.uint64(42)) & m


class Filter:
    """The bit-sliced filter and each language's rate of false positives."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.slots = np.zeros(SLOTS, np.uint8)
        for bit, lang in enumerate(LANGUAGES):
            for p in probes(grams.get(lang, np.zeros(0, np.uint64))):
                self.slots[p] |= np.uint8(1 << bit)
        self.fp = np.array([((self.slots >> b) & 1).mean() ** 3 for b in range(len(LANGUAGES))])

    def counts(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected hits by segment and language, n-grams by segment)."""
        h, segment, valid = ngram_hashes(_SEPARATOR.join(segments))
        h, segment = h[valid], segment[valid]
        a, b, c = probes(h)
        mask = self.slots[a] & self.slots[b] & self.slots[c]
        total = np.bincount(segment, minlength=len(segments)).astype(float)
        # Masks are few, so one histogram by (segment, mask) serves all languages.
        table = np.bincount(segment * 64 + mask, minlength=len(segments) * 64).reshape(len(segments), 64)
        bits = (np.arange(64)[:, None] >> np.arange(len(LANGUAGES))) & 1
        hits = table @ bits
        return (hits - total[:, None] * self.fp) / (1 - self.fp), total


def train(sample: pd.DataFrame, rounds: int = 2) -> Filter:
    """Filter from labelled texts (columns text, label). The second round labels each sentence by the first filter."""
    segments, langs = [], []
    for text, label in zip(sample["text"], sample["label"]):
        code = label_code(label)
        if code and text:
            own = [s.lower().replace(_SEPARATOR, " ") for _, _, ss in pieces(plain(text)) for s in ss]
            segments += own
            langs += [LANGUAGES.index(code)] * len(own)
    lang = np.array(langs, np.int64)
    if not segments:
        return Filter({})
    h, segment, valid = ngram_hashes(_SEPARATOR.join(segments))
    h, segment = h[valid], segment[valid]
    grams, index = np.unique(h, return_inverse=True)
    found = Filter({})
    for _ in range(rounds):
        known = lang[segment] >= 0
        table = np.zeros((len(LANGUAGES), len(grams)))
        for b in range(len(LANGUAGES)):
            table[b] = np.bincount(index[known & (lang[segment] == b)], minlength=len(grams))
            table[b] /= max(1.0, table[b].sum())
        keep = (table > 0) & (table >= KEEP_SHARE * table.max(axis=0))
        found = Filter({code: grams[keep[b]] for b, code in enumerate(LANGUAGES)})
        hits, total = found.counts(segments)
        lang = np.where(total >= 8, hits.argmax(axis=1), -1)
    return found


def sample_rows(df: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """At most `rows` labelled texts, the first by a hash of the id; whole ones go to the driver."""
    known = df.where(F.col(label).isNotNull() & (F.length(F.trim(F.coalesce(text, F.lit("")))) > 40))
    few = hash_sample(known, df.count(), key, rows)
    return few.select(F.col(text).alias("text"), F.col(label).alias("label")).toPandas()


def _decide(batch: pd.DataFrame, found: Filter, key: str, text: str, label: str | None) -> Iterator[tuple]:
    """(id, para_no, lang, confidence, declared is the main one); para_no 0 is the text, others are all its prose paragraphs."""
    for begin in range(0, len(batch), ROUND_TEXTS):
        part = batch.iloc[begin : begin + ROUND_TEXTS]
        segments, owners = [], []
        shapes = []
        for row, value in enumerate(part[text]):
            shape = pieces(plain(value))
            shapes.append(shape)
            for at, (_, _, ss) in enumerate(shape):
                segments += [s.lower().replace(_SEPARATOR, " ") for s in ss]
                owners += [(row, at)] * len(ss)
        if not segments:
            continue
        hits, total = found.counts(segments)
        best = hits.argmax(axis=1)
        letters = [sum(map(len, _WORD.findall(s))) for s in segments]
        votes: dict[tuple[int, int], Counter] = {}
        for k, owner in enumerate(owners):
            if total[k] >= 4:
                votes.setdefault(owner, Counter())[int(best[k])] += letters[k]
        ids = part[key].tolist()
        labels = part[label].tolist() if label else [None] * len(part)
        for row, shape in enumerate(shapes):
            whole = Counter()
            for at in range(len(shape)):
                whole.update(votes.get((row, at), {}))
            if not whole:
                continue
            main, most = whole.most_common(1)[0]
            code = LANGUAGES[main]
            named = label_code(labels[row])
            yield ids[row], 0, code, most / whole.total(), named == code, code
            for at, (number, prose, _) in enumerate(shape):
                own = votes.get((row, at))
                if prose and own:
                    lang, n = own.most_common(1)[0]
                    yield ids[row], number, LANGUAGES[lang], n / own.total(), lang == main, code


def languages(df: DataFrame, key: str, text: str, label: str, found: Filter) -> DataFrame:
    """(id, para_no, lang, confidence, agrees, main): the language of each text (para_no 0) and of each prose paragraph.

    agrees says, for a text, that its label names lang, and for a paragraph, that lang is the text's main language;
    confidence is the share of the letters. Null, empty and unreadable texts give no row; repeated rows repeat.
    """
    fields = ["id", "para_no", "lang", "confidence", "agrees", "main"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(list(_decide(batch, found, key, text, label)), columns=fields)

    rows = df.select(key, text, label).where(F.col(text).isNotNull() & (F.length(text) > 0))
    return rows.mapInPandas(run, "id bigint, para_no int, lang string, confidence double, agrees boolean, main string")
