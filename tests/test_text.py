import pytest
from pyspark.sql import functions as F

from wikiloom.functions import text, urls


def values(spark, inputs, expression):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_normalized(spark):
    inputs = ["  a   b ", "\t a\tb  c\n", "", "   ", "a  \t  b", "word1    word2   word3  "]
    assert values(spark, inputs, text.normalized) == [
        "a b", "a\tb c", "", "", "a \t b", "word1 word2 word3",
    ]


def test_space_words(spark):
    assert values(spark, ["", " a  b "], text.space_words) == [[""], ["a", "b"]]


def test_word_set(spark):
    got = values(spark, ["The cat, the CAT's ÜBER-cat 42!", "...", None], text.word_set)
    assert got == [["the", "cat", "s", "über", "42"], [], []]


def test_colour_number(spark):
    literals = {
        "#00cc99": 0x00CC99, "0x1F": 31, "0X1f": 31, "010": 8, "0": 0, "00": 0, "12": 12,
        "-1": 0xFFFFFF, "-#ff": (-255) & 0xFFFFFF, "+5": 5, "08": None, "#": None, "": None,
        "bogus": None, "--5": None, "2147483647": 2147483647 & 0xFFFFFF, "2147483648": None,
        "-2147483648": 0, "#FFFFFFFF": None, " 1": None, "99999999999999999999": None,
        "0xfffffffffffffffffffff": None,
    }
    assert values(spark, list(literals), text.colour_number) == list(literals.values())


def test_derived_colour_is_stable(spark):
    first, second = values(spark, ["blog", "blog"], text.derived_colour)
    assert first == second and 0 <= first <= 0xFFFFFF


def test_sentences(spark):
    inputs = ["One two. Three four. Five", "One two. Three.", "One.", "no end", "", None]
    assert values(spark, inputs, text.whole_sentences) == [
        "One two. Three four.", "One two. Three.", "One.", "no end", "", None,
    ]
    assert values(spark, inputs, text.before_last_sentence) == [
        "One two. ", "One two. ", "One.", None, None, None,
    ]


@pytest.mark.parametrize(
    "url, host",
    [
        ("http://a.b.org/x", "a.b.org"),
        ("HTTPS://user:pw@A.org:8080/x?y#z", "A.org"),
        ("ftp://a_b.org", "a_b.org"),
        ("http://a.org?x=1@2", "a.org"),
        ("http://a.org/with space", "a.org"),
        ("http:///path", ""),
        ("http:opaque", ""),
        ("http://[::1]:80/", "[::1]"),
        ("http://a.org:port/", None),
        ("not a url", None),
        ("mailto:a@b.org", None),
        ("", None),
        (None, None),
    ],
)
def test_host(spark, url, host):
    assert values(spark, [url], urls.host_of) == [host]


def test_host_label(spark):
    inputs = ["https://en.wiki.org/w", "https://wiki.org/w", "broken", None]
    assert values(spark, inputs, urls.host_label) == ["en", "!disabled", "!disabled", "!disabled"]
