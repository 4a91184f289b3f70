import html.entities
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwise.functions import text
from threadwise.functions.entities import unescape_html5
from threadwise.functions.regex import portable, words_found, word_pattern


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", T.StringType())]))
    return df.select(column(F.col("x"))).first()[0]


def test_clean_text_unescapes_and_collapses(spark):
    assert one(spark, " a &lt;b&gt;\t\n c&nbsp;&nbsp;d ", text.clean_text) == "a <b> c d"


def test_one_pass_undoes_one_level(spark):
    assert one(spark, "&amp;amp; &amp;lt;", text.clean_text) == "&amp; &lt;"


def test_two_passes_undo_two_levels(spark):
    twice = lambda x: text.clean_text(text.clean_text(x))
    assert one(spark, "&amp;amp;", twice) == "&"


def test_html5_equals_the_standard_decoder(spark):
    rng = random.Random(4)
    parts = ["&", "#", "x", "X", ";", " ", "a", "amp", "lt", "notit", "not", "copy", "eacute", "0", "65",
             "128", "x80", "xD800", "1114112", "99999999999", "xFFFE", "11", "\n", "é", "&amp;", "&#38;"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(1500)]
    texts += [f"&{name}" for name in html.entities.html5] + ["", "plain", "&", "&&#x41;&"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", unescape_html5(F.col("text")).alias("plain")).collect()
    assert [r for r in found if r.plain != html.unescape(r.text)] == []


def test_html5_knows_rare_entities(spark):
    html5 = lambda x: text.clean_text(x, "html5")
    assert one(spark, "caf&eacute; &#x41;&NotEqualTilde;", html5) == "café A≂̸"
    assert one(spark, "plain", html5) == "plain"
    assert one(spark, None, html5) == ""


def test_null_and_blank(spark):
    assert one(spark, None, text.clean_text) == ""
    assert one(spark, " \t\n", text.clean_text) == ""


def test_strip_handles(spark):
    assert one(spark, "@brand @user_1 hello @other", text.strip_handles) == "hello @other"
    assert one(spark, "@élan hi", text.strip_handles) == "hi"
    assert one(spark, "@brand @user", text.strip_handles) == "@brand @user"


def test_keys(spark):
    assert one(spark, "123.0", text.clean_key) == "123"
    assert one(spark, " 1.0, 2 ,,3.0,", text.key_list) == ["1", "2", "3"]


def test_words_and_terms(spark):
    assert one(spark, "It's a very, VERY long-day", text.long_words) == ["very", "very", "longday"]
    assert sorted(one(spark, "Don't ask DON'T try it99times", text.term_set)) == ["don't", "times"]
    assert one(spark, "A bb Été x_1 7", text.word_tokens) == ["bb", "été", "x_1"]


def test_bigrams_of_short_lists(spark):
    grams = lambda x: text.unigrams_and_bigrams(text.word_tokens(x))
    assert one(spark, "", grams) == []
    assert one(spark, "one", grams) == ["one"]
    assert one(spark, "one two three", grams) == ["one", "two", "three", "one two", "two three"]


def found(spark, value, keyword):
    entries = F.array(
        F.struct(F.lit(keyword).alias("literal"), F.lit(word_pattern(keyword)).alias("pattern"))
    )
    return one(spark, value, lambda x: F.size(words_found(x, entries))) == 1


def test_whole_words(spark):
    assert found(spark, "the app, please", "app")
    assert not found(spark, "happy", "app")
    assert not found(spark, "écharge", "charge")


def test_keyword_ending_in_plus_needs_a_word_character_after_it(spark):
    assert not found(spark, "the tv+ plan", "tv+")
    assert found(spark, "the tv+x plan", "tv+")


def test_dot_stops_at_line_feed_only(spark):
    pattern = portable(r"\bcharged.{0,20}twice\b")
    assert one(spark, "charged me twice", lambda x: x.rlike(pattern))
    assert one(spark, "charged twice", lambda x: x.rlike(pattern))
    assert not one(spark, "charged\ntwice", lambda x: x.rlike(pattern))
