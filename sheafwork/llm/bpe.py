"""Byte-pair encoding of a corpus inside the JVM.

Texts are cut by the tokenizer's pattern. Distinct words, counted over the whole corpus, are folded once: the
fold takes the bytes of a word and applies the lowest-ranked merge until none is left, with a literal rank
map. The most frequent words (at most HOT_WORDS, so the map has a proven size) become a literal map from word to ids; in the
pass over the documents a word is looked up there, and a rarer one is folded in place. No document
is shuffled, so the skew of words and sources does not matter.
"""

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in the literal map, and the longest word (bytes) in it.
HOT_WORDS, HOT_BYTES = 40_000, 48
#: Above this many bytes the quadratic fold gives way to a heap in Python, with equal ids.
FOLD_BYTES = 160
RANK_BUCKETS, WORD_BUCKETS = 16_384, 16_384

#: Fixed value: the pattern by which byte_bpe_50k cuts a text, with Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    r"""The pattern with Java's \s and \S widened to Unicode white space."""
    space = r"\p{IsWhite_Space}"
    inner = pattern.replace(r"[^\s", "[^" + space)
    return inner.replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", space)


def with_constant(df: DataFrame, name: str, value: object, ddl: str) -> DataFrame:
    """df with a column that holds one value in every row: a scalar subquery over one local row.

    The optimizer moves the subquery to where the column is read, if that is at one place (see let), so the value is no part of
    the rows; each executor gets it once with the stage. A literal would be printed with every plan.
    """
    return df.select("*", df.sparkSession.createDataFrame([(value,)], f"v {ddl}").scalar().alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value standing once in the expression."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def in_buckets(entries: dict[str, object], buckets: int) -> list[dict[str, object]]:
    """The entries as maps in buckets by CRC-32, since Spark searches a map from its start."""
    table: list[dict] = [{} for _ in range(buckets)]
    for key, value in entries.items():
        table[zlib.crc32(key.encode("utf-8", "surrogatepass")) % buckets][key] = value
    return table


def lookup(table: Column, key: Column, buckets: int) -> Column:
    return F.try_element_at(F.get(table, F.crc32(key.cast("binary")) % buckets), key)


def fold(word: Column, ranks: Column) -> Column:
    """Ids of one word: its bytes as hexadecimal pieces, and the lowest-ranked neighbours joined again and again.

    One merge at a time, the leftmost of the lowest rank; ends early inside each step once no pair has a rank.
    """
    text = F.hex(F.encode(word, "UTF-8"))
    count = (F.length(text) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i * 2 - 1, F.lit(2)))
    rank = lambda piece: lookup(ranks, piece, RANK_BUCKETS)

    # The state keeps pieces and the ranks of neighbours, so a merge looks up two new pairs only.
    def pair_ranks(p: Column) -> Column:
        return F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x, i: rank(F.concat(F.get(p, i), x)))

    start = F.struct(pieces.alias("p"), pair_ranks(pieces).alias("r"))

    def merge(acc: Column, _: Column) -> Column:
        p, r = acc.getField("p"), acc.getField("r")
        low = F.array_min(r)
        at = F.array_position(r, low).cast("int")  # 1-based place of the left piece
        joined = F.concat(F.get(p, at - 1), F.get(p, at))

        def spliced(j: Column) -> Column:
            left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), j)))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 1 < F.size(p), F.array(rank(F.concat(j, F.get(p, at + 1))))).otherwise(F.array().cast("array<int>"))
            new_p = F.concat(F.slice(p, F.lit(1), at - 1), F.array(j), F.slice(p, at + 2, F.size(p)))
            new_r = F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(p)))
            return F.struct(new_p.alias("p"), new_r.alias("r"))

        return F.when(low.isNull(), acc).otherwise(spliced(joined))

    steps = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, merge, lambda acc: F.transform(acc.getField("p"), rank))


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by a heap, in n log n: for words too long for the fold."""
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    nxt, prev = list(range(1, n)) + [-1], list(range(-1, n - 1))
    heap = [(r, i, piece[i], piece[i + 1]) for i in range(n - 1) if (r := ranks.get(piece[i] + piece[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if piece[i] is not None else -1
        if j < 0 or piece[i] != a or piece[j] != b:
            continue
        piece[i], piece[j], nxt[i] = a + b, None, nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        for left in (prev[i], i):
            if left >= 0 and nxt[left] >= 0 and (r := ranks.get(piece[left] + piece[nxt[left]])) is not None:
                heapq.heappush(heap, (r, left, piece[left], piece[nxt[left]]))
    return [ranks[p] for p in piece if p is not None]


def _long_words_udf(path: str):
    @F.pandas_udf("array<array<int>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = None
        for words in batches:
            if ranks is None and words.map(len).any():
                ranks = load_ranks(path)
            yield words.map(lambda ws: [encode_word(w.encode(), ranks) for w in ws])

    return encode


def encode_column(df: DataFrame, text: str, out: str = "ids", path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """df with the ids of its column text as array<int>; null and empty texts have the empty array.

    Words are counted over all rows of df. Other columns stay as they are, whatever their names; repeated rows stay repeated.
    path: a rank file; hot_words bounds the literal map and changes no result.
    """
    spark = df.sparkSession
    path = path or tokenizer_path()
    ranks = in_buckets({k.hex().upper(): v for k, v in load_ranks(path).items()}, RANK_BUCKETS)
    rank_map = "array<map<string,int>>"
    cut = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(java_pattern(PATTERN)), F.lit(0))
    counted = df.select(F.explode(cut(F.col(text))).alias("word")).groupBy("word").count()
    # A word seen once gains nothing from the map.
    hot = counted.where((F.octet_length("word") <= HOT_BYTES) & (F.col("count") > 1)).orderBy(F.desc("count"), "word").limit(hot_words)
    apart = with_constant(hot.repartition(max(8, spark.sparkContext.defaultParallelism)).select("word"), "__bpe_ranks", ranks, rank_map)
    known = {r.word: r.ids for r in apart.select("word", let(F.col("__bpe_ranks"), lambda r: fold(F.col("word"), r)).alias("ids")).collect()}
    known = in_buckets(known, WORD_BUCKETS)
    words, long = "__bpe_words", "__bpe_long"
    staged = df.withColumn(words, cut(F.col(text)))
    staged = staged.withColumn(long, F.filter(words, lambda w: F.octet_length(w) > FOLD_BYTES))
    staged = staged.withColumn(long + "_ids", _long_words_udf(path)(F.col(long)))

    def ids(w: Column, table: Column, ranks: Column) -> Column:
        in_long = F.get(F.col(long + "_ids"), F.array_position(F.col(long), w).cast("int") - 1)
        return F.coalesce(lookup(table, w, WORD_BUCKETS), F.when(F.octet_length(w) > FOLD_BYTES, in_long).otherwise(fold(w, ranks)))

    staged = with_constant(with_constant(staged, "__bpe_ranks", ranks, rank_map), "__bpe_known", known, "array<map<string,array<int>>>")
    coded = F.flatten(let(F.col("__bpe_known"), lambda t: let(F.col("__bpe_ranks"), lambda r: F.transform(words, lambda w: ids(w, t, r)))))
    return staged.select(*[F.col(f"`{c}`") for c in df.columns if c != out], coded.alias(out))


def decode_column(df: DataFrame, ids: str, out: str, path: str | None = None) -> DataFrame:
    """Text of a column of ids: their binary pieces concatenated and read as UTF-8. A null array gives null."""
    ranks = load_ranks(path or tokenizer_path())
    pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    staged = with_constant(df, "__bpe_pieces", [p.hex() for p in pieces], "array<string>")
    hexes = let(F.col("__bpe_pieces"), lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))
    return staged.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.decode(F.unhex(hexes), "UTF-8").alias(out))
