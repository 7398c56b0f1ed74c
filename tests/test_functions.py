"""Golden cases of text functions."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import markup, normalize, remove, replace
from textmill.functions import tokens as ft
from textmill.plans.scrubber import Pipe, Scrubber, get_component, make_pipeline, scrub


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


CASES = [
    (normalize.lower_case, "ÄB c", "äb c"),
    (normalize.bullet_points, "• a\n  ● b • c", "- a\n  - b • c"),
    (normalize.hyphenated_words, "multi-\nple self-made 12-\n34", "multiple self-made 12-\n34"),
    (normalize.quotation_marks, "“a” ‘b’", "\"a\" 'b'"),
    (lambda t: normalize.repeating_chars(t, chars="!", maxn=2), "wow!!!!! ok!", "wow!! ok!"),
    (lambda t: normalize.repeating_chars(t, chars="ha"), "hahaha", "ha"),
    (lambda t: normalize.unicode(t, form="NFC"), "é", "é"),
    (lambda t: normalize.unicode(t, form="NFKC"), "ﬁ", "fi"),
    (normalize.whitespace, "​ a\t\tb\r\n\n c  ", "a b\n c"),
    (remove.accents, "été Ñ", "ete N"),
    (lambda t: remove.accents(t, fast=True), "été ß", "ete "),
    (lambda t: remove.accents(t, accents="́"), "é è", "e è"),
    (remove.brackets, "a {b} [c] (d) e", "a    e"),
    (lambda t: remove.brackets(t, only="round"), "a [c] (d)", "a [c] "),
    (remove.digits, "a 1,234 -5 ½", "a ,  "),
    (lambda t: remove.digits(t, only=["1"]), "121", "2"),
    (remove.new_lines, "a\nb\r\n\nc\n", "abc"),
    (remove.tabs, "a\t\tb", "ab"),
    (lambda t: remove.pattern(t, pattern=["a+", "c"]), "aabc", "b"),
    (remove.punctuation, "a, b! -c_", "a b c"),
    (lambda t: remove.punctuation(t, exclude=","), "a, b!", "a, b"),
    (lambda t: remove.punctuation(t, only=["!"]), "a, b!!", "a, b"),
    (remove.tags, "<p>a <b>b</b></p><!-- x --><script>1<2</script>&amp;lt;", "a b &lt;"),
    (replace.currency_symbols, "€5 $", "_CUR_5 _CUR_"),
    (replace.digits, "1,234.5 and -7 a1", "_DIGIT_ and _DIGIT_ a1"),
    (replace.emails, "write to a.b@ex-ample.org now", "write to _EMAIL_ now"),
    (replace.emojis, "😀x", "_EMOJI_x"),
    (replace.hashtags, "#one a#two #3x", "_HASHTAG_ a#two #3x"),
    (replace.user_handles, "@me a@b", "_USER_ a@b"),
    (replace.phone_numbers, "call (555) 123-4567.", "call (_PHONE_." if False else "call _PHONE_."),
    (replace.urls, "see http://ex.org/a?b and bit.ly/abc1", "see _URL_ and _URL_"),
    (lambda t: replace.pattern(t, pattern=[{"a": "b"}, {"b": "c"}]), "ab", "cc"),
    (replace.punctuation, "a,b!!", "a b  "),
    (lambda t: replace.special_characters(t, is_html=True), "a &lt; b &amp;amp;", "a < b &amp;"),
    (lambda t: replace.special_characters(t, ruleset={"æ": "ae"}), "æ", "ae"),
    (markup.remove_comments, "a<!-- x\n -->b", "ab"),
    (markup.remove_doctype, "<?xml version='1'?><!DOCTYPE html><p>", "<p>"),
    (lambda t: markup.unwrap_tag(t, "b"), "<b class='x'>a</b><br>", "a<br>"),
    (lambda t: markup.remove_element(t, ".x"), "<p class='a x'>1<i>2</i></p><p>3</p>", "<p>3</p>"),
    (lambda t: markup.remove_element(t, "p", attribute="id", value="^a", matcher="regex"), "<p id='ab'>1</p><p id='b'>2</p>", "<p id='b'>2</p>"),
    (lambda t: markup.remove_tag(t, "#k"), "<p id='k'>a<b>c</b></p>", "a<b>c</b>"),
    (lambda t: markup.remove_attribute(t, "a", "href"), "<a href='x' id=\"y\">t</a>", '<a id="y">t</a>'),
    (lambda t: markup.remove_attribute(t, "a"), "<a href='x' id='y'>t</a>", "<a>t</a>"),
    (lambda t: markup.replace_attribute(t, "a", "href", "src", find="x", repl="z"), "<a href='xx'>t</a>", '<a src="zz">t</a>'),
    (lambda t: markup.replace_tag(t, "b", "strong"), "<b id='q'>t</b> <i>u</i>", '<strong id="q">t</strong> <i>u</i>'),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_text_function(spark, i):
    f, text, want = CASES[i]
    assert one(spark, text, f) == want


def test_nulls_stay_null(spark):
    for f, _, _ in CASES:
        assert one(spark, None, f) is None


def test_book_headers():
    body = [f"line {i}" for i in range(150)]
    text = "\n".join(["Title", "*** START OF THIS PROJECT GUTENBERG EBOOK X ***", *body, "End of Project Gutenberg's X", "licence"])
    assert remove.strip_book(text) == "\n".join(body)
    assert remove.strip_book("plain\ntext") == "plain\ntext"


@pytest.mark.parametrize(
    "f, text, want",
    [
        (ft.whitespace_tokens, " a  b\nc ", ["a", "b", "c"]),
        (ft.whitespace_tokens, "", []),
        (ft.word_tokens, "don't é_1", ["don", "t", "é_1"]),
        (ft.word_and_mark_tokens, "a, b!", ["a", ",", "b", "!"]),
        (lambda t: ft.slice_tokens(t, 3), "ab cdefg", ["abc", "def", "g"]),
        (lambda t: ft.slice_tokens(t, 3, drop_ws=False), "ab cd", ["ab ", "cd"]),
        (lambda t: ft.ngrams(ft.whitespace_tokens(t), 2), "a b c", ["a b", "b c"]),
        (lambda t: ft.ngrams(ft.whitespace_tokens(t), 4), "a b c", []),
        (lambda t: ft.filter_tokens(ft.whitespace_tokens(t), stops=["the"], filter_digits=True), "The cat 3x , sat", ["cat", "sat"]),
        (lambda t: ft.matched(ft.whitespace_tokens(t), ft.is_roman), "IV a X IIII", [0, 2]),
        (lambda t: ft.unmatched(ft.whitespace_tokens(t), ft.is_word), "a1 b 22", [0]),
    ],
)
def test_tokens(spark, f, text, want):
    assert one(spark, text, f) == want


def test_natural_order(spark):
    rows = spark.createDataFrame([("term10",), ("Term2",), ("2x",), ("10x",)], "t string").orderBy(ft.natural_key(F.col("t")))
    assert [r.t for r in rows.collect()] == ["2x", "10x", "Term2", "term10"]


def test_scrubber(spark):
    df = spark.createDataFrame([("A, B 12",)], "text string")
    s = Scrubber(["lower_case", "punctuation"])
    assert s.pipes == ["lower_case", "punctuation"]
    s.add_pipe("digits", before="punctuation")
    assert s.pipes == ["lower_case", "digits", "punctuation"]
    s.add_pipe(("repeating_chars", {"chars": " "}), last=True)
    assert s.scrub(df).first().text == "a b "
    assert s.scrub(df, disable=["digits"]).first().text == "a b 12"
    s.remove_pipe("digits")
    assert s.scrub(df).first().text == "a b 12"
    with pytest.raises(ValueError):
        s.add_pipe("tabs", first=True, last=True)
    with pytest.raises(KeyError):
        get_component("nothing")
    s.reset()
    assert s.pipes == []
    assert scrub(df, [F.upper, ("punctuation", {"only": [","]}), Pipe("tabs")]).first().text == "A B 12"
    assert one(spark, "A", make_pipeline("lower_case")) == "a"
