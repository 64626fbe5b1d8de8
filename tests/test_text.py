"""Text primitives, cleaning and validity, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from textlake.functions import cleaning, metrics, validity
from textlake.functions import text as X

ODD = ["a\u00a0b\u3000c", "x\x1cy\x1dz\x1e\x1f", "tabs\tand\r\nlines\n\n", "  ", "", "one", "café naïve", "Dr. Smith met e.g. me. U.S.A. is big! Is it? Yes.", "漢字 text"]


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame(list(enumerate(items)), f"i long, text {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_words_follow_unicode_white_space(spark):
    assert values(spark, ODD, X.words("text")) == [x.split() for x in ODD]
    assert values(spark, ODD, X.n_words("text")) == [len(x.split()) for x in ODD]
    assert values(spark, ODD, X.collapse("text")) == [" ".join(x.split()) for x in ODD]
    assert values(spark, ODD, X.strip("text")) == [x.strip() for x in ODD]


def test_sentences(spark):
    split = re.compile(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s")
    want = [[s for s in split.split(re.sub(r"\s+", " ", x).strip()) if s.strip()] for x in ODD]
    assert values(spark, ODD, X.sentences("text")) == want


def test_truncation_keeps_short_texts_as_they_are(spark):
    assert values(spark, ["a  b\nc", "a  b c d"], X.first_words("text", 3)) == ["a  b\nc", "a b c"]


def test_urls_and_mails(spark):
    texts = ["see http://a.b/c now", "see www.site.org y", "go bit.ly/abc now", "mail me@x.org!", "nothing here"]
    assert values(spark, texts, cleaning.remove_urls("text")) == ["see  now", "see  y", "go  now", "mail ", "nothing here"]


@pytest.mark.parametrize(
    ("step", "text", "want"),
    [
        (cleaning.remove_special, "8/12 and 18/20", "12 and 120"),
        (cleaning.remove_special, "wow!?!. ok", "wow. ok"),
        (cleaning.remove_special, "don’t – stop…", "don t   stop "),
        (cleaning.remove_special, "smile \U0001f600 łódź 漢字x", "smile  łódź  x"),
        (cleaning.remove_noise, "for/against r/sub coooool cooool col [Deleted] 12 likes", "fo  cool cool col  "),
        (cleaning.remove_noise, "Posted by u/some one", " one"),
        (cleaning.normalize_whitespace, "\ta  b\n\n\nc  ", "a b\nc"),
        (cleaning.html_native, "<p>a&amp;b</p><script>x<y</script><!-- c --><br/>d", "a&bd"),
        (cleaning.html_arrow, "<p>a&amp;b</p><script>x<y</script><!-- c --><br/>d &eacute;", "a&bd é"),
        (cleaning.clean_collected, " Sure,  Certainly! yes ", "Certainly! yes"),
        (cleaning.book_body, "x *** START OF THIS y *** END OF THIS z", "*** START OF THIS y "),
        (X.capitalize, "heLLO World", "Hello world"),
        (X.lower_first, "Hello", "hello"),
    ],
)
def test_steps(spark, step, text, want):
    assert values(spark, [text], step(F.col("text"))) == [want]


def test_first_present_and_first_truthy(spark):
    df = spark.createDataFrame([(None, "", "c"), ("", "b", "c"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(X.first_present("a", "b", "c")).collect()] == ["", "", None]
    assert [r[0] for r in df.select(X.first_truthy("a", "b", "c")).collect()] == ["c", "b", ""]


def test_reasons(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    texts = ["", "x" * 49, "x" * 50, "ab " * 4000, "1234567890 " * 8, "x {};[ " * 20, " ".join(["same"] * 20), " ".join(words), None, "a b c d e f g h i j " + "k" * 40]
    assert values(spark, texts, validity.reason("text")) == ["empty", "too_short", "valid", "too_long", "low_alpha_ratio", "low_alpha_ratio", "repetitive", "valid", "empty", "valid"]
    code = " ".join(words) + " a; b; c; d; e; f; g; h; i; j;"
    assert values(spark, [code], validity.reason("text")) == ["code_like"]
    assert values(spark, [" ".join(words)], validity.reason("text", language=F.lit("fr"))) == ["wrong_language_fr"]
    assert values(spark, [" ".join(words)], validity.reason("text", language=F.lit(None).cast("string"))) == ["language_detection_failed"]


def test_accepted(spark):
    long = " ".join(f"word{chr(97 + i)}" for i in range(20))
    assert values(spark, [long, " ".join(["word"] * 20), long + " 12345" * 40, "short", None, ""], validity.accepted("text")) == [True, False, False, False, False, False]


def metric_rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return metrics.evaluate(df).orderBy("i").collect()


def test_metrics(spark):
    import statistics

    text = "One two three. Four five six seven eight nine! Ten? Eleven twelve."
    lengths = [3, 6, 1, 2]
    mean, sd = statistics.mean(lengths), statistics.pstdev(lengths)
    row, equal, one, none, empty = metric_rows(spark, [text, "A b c. D e f.", "Only one here.", None, "  "])
    assert row.lengths == lengths and row.n_sentences == 4
    assert row.burstiness == round((sd - mean) / (sd + mean), 4) and row.cv == round(sd / mean * 100, 2)
    assert (row.avg_len, row.std_len, row.max_diff, row.avg_diff) == (round(mean, 2), round(sd, 2), 5.0, 3.0)
    assert equal.burstiness == -1.0 and equal.burstiness_label.startswith("Very Low")
    assert one.burstiness == 0.0 and one.burstiness_label.startswith("Moderate") and one.cv == 0.0
    assert none.burstiness is None and empty.human_score is None
    score = 100 * 0.35 + (row.burstiness + 1) * 50 * 0.35 + 100 * 0.15 + min(row.cv * 2, 100) * 0.15
    assert abs(row.human_score - score) < 0.006


def test_labels(spark):
    df = spark.createDataFrame([(0.5,), (0.1999,), (0.0,), (-0.2,), (-0.21,), (None,)], "b double")
    assert [r[0].split(" (")[0] if r[0] else None for r in df.select(metrics.burstiness_label("b")).collect()] == ["Very High", "Moderate", "Moderate", "Low", "Very Low", None]
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (9.99,), (10.0,)], "g double")
    assert [r[0].split(" (")[0] for r in df.select(metrics.grammar_label("g")).collect()] == ["Excellent", "Very Good", "Good", "Poor", "Very Poor"]



def test_names_without_semicolon_stay(spark):
    """as the SQL, both ways decode only what a semicolon ends."""
    texts = ["<p>a&ampB &amp;amp; &ampfoo; &ltx &#65;&#x42;&#67 &lt;b&gt;</p>"]
    for step in (cleaning.html_native, cleaning.html_arrow):
        assert values(spark, texts, step(F.col("text"))) == ["a&ampB &amp; &ampfoo; &ltx AB&#67 <b>"]


def test_case_of_single_characters(spark):
    """as the SQL, each character's case is one character."""
    texts = ["ßIeiN", "ŉA", "ᾳA", "\u0130ΑΣ", "aΣ", "élan", ""]
    assert values(spark, texts, X.capitalize("text")) == ["\u1e9eiein", "ŉa", "ᾼa", "\u0130ασ", "Aσ", "Élan", ""]
    assert values(spark, texts, X.lower_each("text")) == ["ßiein", "ŉa", "ᾳa", "iασ", "aσ", "élan", ""]
