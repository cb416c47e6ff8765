import tiktoken

from sheafwork.llm import bpe

TEXTS = [None, "", " ", "Hello world, it's 2024!", "naïve café — 東京 \U0001f600\U0001f44d", "  two  spaces\n\n\ttab", "<|endoftext|>", "a" * 700, "xq" * 400, "don't    nbsp", "Hello world, it's 2024!", "'ll 've ’s", "　wide", "line\r\nend \n"]


def test_ids_equal_the_tokenizer_and_decode_back(spark):
    encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.tokenizer_path()), special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").selectExpr("*", "'x' as word", "1 as count")
    for hot in (bpe.HOT_WORDS, 1):
        coded = bpe.decode_column(bpe.encode_column(df, "text", hot_words=hot), "ids", "back")
        rows = {r.id: r for r in coded.collect()}
        assert len(rows) == len(TEXTS)
        for i, text in enumerate(TEXTS):
            assert list(rows[i].ids) == encoding.encode_ordinary(text or "")
            assert rows[i].back == (text or "")


def test_heap_equals_fold():
    ranks = bpe.load_ranks(bpe.tokenizer_path())
    encoding = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for word in ("antidisestablishmentarianism", "aaaaaaa", "zq", "é", "ababababab"):
        assert bpe.encode_word(word.encode(), ranks) == encoding.encode_ordinary(word)


def test_empty_table(spark):
    assert bpe.encode_column(spark.createDataFrame([], "id int, text string"), "text").collect() == []
