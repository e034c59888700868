import re
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

from pyspark.sql import functions as F

from jobloom.functions import codes, text, urls, vectors


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "x string" if value is None or isinstance(value, str) else "x array<double>")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_code_prefixes(spark):
    assert one(spark, "11-1011", lambda c: codes.code_prefix(c, 2)) == 11
    assert one(spark, "11-1011.00", lambda c: codes.code_prefix(c, 6)) == 111011
    assert one(spark, "x", lambda c: codes.code_prefix(c, 3)) is None
    assert one(spark, " 11-1011.03 ", codes.code_prefix_str) == "111"
    assert one(spark, "11-1011.03", codes.detailed_code) == "11-1011"
    assert one(spark, "51-9199", lambda c: codes.in_major_group(c, 51)) is True
    assert one(spark, None, lambda c: codes.in_major_group(c, 51)) is False
    assert one(spark, "12a", codes.safe_int) is None
    assert one(spark, "12a", codes.int_or_raw) == "12a"
    assert one(spark, "0012", codes.int_or_raw) == "12"


def kept_query(url, key):
    """What the canonical form means, said with the standard library."""
    u = urlparse(url)
    values = parse_qs(u.query).get(key)
    return urlunparse(u._replace(query=urlencode({key: values}, True) if values else ""))


def test_canonical_url(spark):
    urls_seen = [
        "http://a.com/p?jk=1&x=2",
        "http://a.com/p?x=2",
        "http://a.com/p?x=2#frag",
        "http://a.com/p?jk=1&jk=2&y=&jk=#top",
        "HTTP://A.com/p?jk=a%20b+c~d*e",
        "http://a.com/p?j%6B=7",
        "http://a.com/p?ajk=7",
        "http://a.com/p?",
        "http://a.com/p#",
        "http://a.com/p?jk=a=b",
        "/relative?jk=ü",
    ]
    df = spark.createDataFrame([(u,) for u in urls_seen], "u string")
    got = {r["u"]: r["c"] for r in df.select("u", urls.canonical_url(F.col("u")).alias("c")).collect()}
    assert got == {u: kept_query(u, "jk") for u in urls_seen}


def test_label_slug_and_tabs(spark):
    assert one(spark, "Café & Bar/é", text.label_slug) == "café___bar_é"
    assert one(spark, "a\tb", text.tabs_to_periods) == "a. b"
    assert one(spark, "a\tb", text.tabs_to_spaces) == "a b"


def test_chunks(spark):
    words = [str(i) for i in range(7)]
    assert one(spark, " ".join(words), lambda c: text.word_chunks(c, 3)) == ["0 1 2", "3 4 5", "6"]
    assert one(spark, "a  b", lambda c: text.word_chunks(c, 2)) == ["a ", "b"]


def test_ngrams(spark):
    got = one(spark, "an ox ate", lambda c: text.ngrams(text.long_word_tokens(c), 1, 3))
    assert got == ["an", "ox", "ate", "an ox", "ox ate", "an ox ate"]
    assert one(spark, "", lambda c: text.ngrams(text.long_word_tokens(c), 1, 2)) == []


def test_sentences_and_flags(spark):
    assert one(spark, "A b. C d.  E", text.sentences) == ["A b", "C d", "E"]
    assert one(spark, "A b. C d.", text.sentence_count) == 2
    assert one(spark, None, text.sentence_count) == 0
    assert one(spark, "End.", text.is_cut_off) is False
    for cut in (None, "", "End"):
        assert one(spark, cut, text.is_cut_off) is True


def test_cleaner(spark):
    raw = "<b>We need</b> four good cooks! Short one.\nBring your own three knives, please"
    assert one(spark, raw, text.cleaner(4)) == "we need four good cooks\tbring your own three knives please"
    assert one(spark, "too short.", text.cleaner(4)) is None
    assert one(spark, None, text.cleaner(4)) is None


def test_truncate(spark):
    assert one(spark, "abcdefgh", lambda c: text.truncate(c, 6)) == "abcd…"
    assert one(spark, "abcdef", lambda c: text.truncate(c, 6)) == "abcdef"


def test_first_field(spark):
    line = 'http://x,"a, b",c'
    assert one(spark, line, text.without_first_field) == re.sub("[^,]*,", "", line, count=1)


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.normalized) == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.normalized) == [0.0, 0.0]
    assert one(spark, [3.0, 4.0], vectors.norm) == 5.0
