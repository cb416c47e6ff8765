from pyspark.sql import functions as F

from sheafwork.functions import dates as D
from sheafwork.functions import text as T


def values(spark, rows, ddl, **columns):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_text(spark):
    c = F.col("t")
    rows = [(" a   b\n",), ("Ärger “x” – É’s",), (None,), ("",), ("Слово word слово word",)]
    assert [r[0] for r in values(spark, rows, "t string", s=T.squish(c))] == ["a b", "Ärger “x” – É’s", None, "", "Слово word слово word"]
    got = values(spark, rows, "t string", n=T.normalize(c), e=T.normalize_exact(c))
    assert got[1] == ('arger "x" - e\'s',) * 2 and got[2] == (None, None)
    assert [r[0] for r in values(spark, rows, "t string", s=T.detect_script(c))] == ["latin", "latin", None, "unknown", "mixed"]
    assert values(spark, [("One two. Three\n\nfour 5.5 six! Seven",)], "t string", s=T.sentences(c))[0][0] == ["One two.", "Three", "four 5.5 six!", "Seven"]
    assert values(spark, [("abcdefghij",)], "t string", e=T.excerpt(c, 6), f=T.find_span(c, F.lit("cd")))[0] == ("abc…ij", (2, 4))
    assert [r[0] for r in values(spark, [("a Go b",), ("google",), (None,)], "t string", w=T.contains_word(c, ["go", "c++"]))] == [True, False, None]


def test_stable_id_is_fnv(spark):
    def fnv(s):
        h = 2166136261
        for ch in s:
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out

    assert values(spark, [("ab", "c")], "t string, u string", i=T.stable_id("x", F.col("t"), F.col("u")))[0][0] == "x_" + fnv("ab\0c")


def test_dates(spark):
    cases = {
        "2014-03 – 2015-11": ((2014, 3, "iso"), (2015, 11, "iso"), False),
        "03/2014 to present": ((2014, 3, "numeric-month-year"), None, True),
        "août 2004 - janvier 2005": ((2004, 8, "month-name-year"), (2005, 1, "month-name-year"), False),
        "май 2007 – июнь 2009": ((2007, 5, "month-name-year"), (2009, 6, "month-name-year"), False),
        "2001 bis 2003": ((2001, None, "year-only"), (2003, None, "year-only"), False),
        "2001": ((2001, None, "year-only"), (2001, None, "year-only"), False),
        "nothing": None,
        "": None,
        None: None,
    }
    got = values(spark, [(c,) for c in cases], "t string", r=D.parse_date_range(F.col("t")))
    for (r,), want in zip(got, cases.values()):
        assert (r is None) if want is None else ((tuple(r.start), r.end and tuple(r.end), r.is_current) == want)
    assert values(spark, [(14,), (0,), (7,)], "n int", s=D.format_months(F.col("n"))) == [("1 y 2 mo",), ("0 mo",), ("7 mo",)]


def test_stable_id_counts_utf16_units(spark):
    def fnv16(text):
        h = 2166136261
        raw = text.encode("utf-16-le")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "little")) * 16777619) & 0xFFFFFFFF
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out

    assert values(spark, [("a😀б", None)], "t string, u string", i=T.stable_id("x", F.col("t"), F.col("u")))[0][0] == "x_" + fnv16("a😀б\0")


def test_normalize_loose_and_json(spark):
    got = values(spark, [(" Ａ‘É’ ʼ„x“\u00a0–Ö",)], "t string", n=T.normalize(F.col("t")))[0][0]
    assert got == "ａ'e' '„x\" -o"
    assert values(spark, [("Économie", "economie")], "t string, u string", e=T.loose_equals(F.col("t"), F.col("u")))[0][0]
    said = [("Here: ```{\"a\": 1, \"b\": \"x\"}``` done",), ("nothing",), (None,), ("{broken",)]
    assert [r[0] and tuple(r[0]) for r in values(spark, said, "t string", j=T.json_object(F.col("t"), "a int, b string"))] == [(1, "x"), None, None, None]
    ids = values(spark, [(1,), (2,)], "i int", r=T.random_id("q"))
    assert ids[0][0] != ids[1][0] and all(len(r[0]) == 14 and r[0].startswith("q_") for r in ids)


def test_ranges_with_any_dash_and_marker(spark):
    cases = {
        "2019-2021": (2019, 2021, False), "03/2015 − 04/2016": (2015, 2016, False), "2019 – to date": (2019, None, True), "gennaio 2019 – oggi": (2019, None, True), "2019~2020": (2019, 2020, False), "08-2019": (2019, 2019, False),
        "2011 - present.)": (2011, None, True), "март 2010 по н.в.": (2010, None, True), "Mai 2020 bis heute": (2020, None, True), "2010-11 to 2011-04": (2010, 2011, False),
    }
    got = values(spark, [(c,) for c in cases], "t string", r=D.parse_date_range(F.col("t")))
    for (text, (start, end, current)), r in zip(cases.items(), got):
        assert r[0] is not None and (r[0].start.year, r[0].end.year if r[0].end else None, r[0].is_current) == (start, end, current), text
