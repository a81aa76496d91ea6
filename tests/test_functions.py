import pytest
from pyspark.sql import functions as F

from trovewise.functions import html, scoring, stemmers, text


def tokens(spark, value, analyzer):
    return spark.createDataFrame([(value,)], "t string").select(analyzer(F.col("t")).alias("x")).first().x


def test_english_tokens(spark):
    given = "Ab 3x9 d'or; N.A.T.o. end. re-do 7 it's! u.k x.y."
    assert " ".join(tokens(spark, given, text.Analyzer(filters=()))) == "Ab 3x9 d NATo end re do 7 it u k xy"


def test_analyzer_orders_filters_and_stops(spark):
    own = text.Analyzer(filters=("lowercase", "porter2"), stopwords=("play",), strip_html=True)
    assert tokens(spark, "<p>Playing</p><b>FLYING</b>", own) == ["fli"]
    assert tokens(spark, None, text.Analyzer()) == []
    with pytest.raises(ValueError):
        text.Analyzer(tokenizer="none")


def test_whitespace_and_lower_case_are_bytewise(spark):
    assert tokens(spark, " a\tÉB\n", text.Analyzer("whitespace")) == ["a", "Éb"]


def test_split_query(spark):
    rows = spark.createDataFrame([("17:a b:c",), ("a b",), (":x",)], "q string")
    name, rest = text.split_query(F.col("q"))
    assert [tuple(r) for r in rows.select(name, rest).collect()] == [("17", "a b:c"), (None, "a b"), ("", "x")]


def test_url_key(spark):
    row = spark.createDataFrame([("http://face.BNL.gov/a/b?c=1",)], "u string").select(text.url_key(F.col("u")).alias("k")).first()
    assert row.k == "gov.bnl.face.a.b.c.1"


@pytest.mark.parametrize(
    "word,stem",
    [("playing", "play"), ("flying", "fli"), ("I", "I"), ("consistently", "consist"), ("knackeries", "knackeri"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("ties", "tie"), ("cries", "cri"), ("kiwis", "kiwi"), ("relational", "relat"), ("conditional", "condit"), ("controlled", "control"), ("happy", "happi"), ("by", "by"), ("sensational", "sensat")],
)
def test_porter2(word, stem):
    assert stemmers.porter2_stem(word) == stem


@pytest.mark.parametrize("word,stem", [("playing", "play"), ("flying", "flying"), ("I", "i"), ("cities", "city"), ("boxes", "box")])
def test_krovetz(word, stem):
    assert stemmers.krovetz_stem(word) == stem


@pytest.mark.parametrize("page,out", [("<a>text</a>text", "text text"), ("<a><!-- comment --></a>", ""), ("<a><!-- c --></a>text", "text"), ("<p>a<br>b</p><script>x</script>", "a b"), ("", ""), (None, None)])
def test_html(page, out):
    assert html.text_of(page) == out


def test_strip_response(spark):
    rows = spark.createDataFrame([("HTTP/1.1 200\r\nA: b\r\n\r\n<b>x</b>",), ("<b>y</b>",), ("HTTP/1.1 200",)], "c string")
    assert [r.x for r in rows.select(html.strip_response(F.col("c")).alias("x")).collect()] == ["x", "y", ""]


@pytest.mark.parametrize(
    "doc_len,tf,expected",
    [(50, 10, (7.92568, 0.64436, 6.93522, 4.02992)), (50, 20, (8.26697, 1.04982, 8.10274, 2.67421)), (40, 10, (7.97838, 0.65393, 7.20648, 3.70417)), (40, 20, (8.29555, 1.05939, 8.35714, 1.93217))],
)
def test_scorers(spark, doc_len, tf, expected):
    row = spark.createDataFrame([(tf, doc_len, 10, 100, 1000, 10000, 50.0)], "tf int, doc_len int, df int, cf int, n_docs int, coll_len int, avg_len double")
    got = row.select(*[scoring.scorer(s)(scoring.facts()).alias(s) for s in ("bm25", "qld", "pl2", "dph")]).first()
    assert tuple(got) == pytest.approx(expected, abs=1e-5)


def test_dph_of_a_document_of_one_term_is_undefined(spark):
    row = spark.createDataFrame([(5, 5, 1, 5, 10, 50, 5.0)], "tf int, doc_len int, df int, cf int, n_docs int, coll_len int, avg_len double")
    assert row.select(scoring.dph(scoring.facts()).alias("s")).first().s is None


def test_quantizer(spark):
    rows = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "s double").select(scoring.quantize(F.col("s"), F.lit(10.0), 8).alias("q"))
    assert [r.q for r in rows.collect()] == [1, 128, 255]
    with pytest.raises(ValueError):
        scoring.quantize(F.col("s"), F.lit(1.0), 33)
