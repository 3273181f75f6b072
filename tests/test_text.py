import hashlib
import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.functions import text as tx


def apply(spark, function, values, schema="v string"):
    rows = [(i, value) for i, value in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_spacing(spark):
    cases = {
        "end . Then": "end. Then", "no .": "no.", "well - known": "well-known", "$1 , 250": "$1,250", "3 . 5": "3.5",
        "a , b , c": "a, b, c", "why ? Yes .": "why? Yes.", "Berlin - Paris": "Berlin - Paris",
    }
    assert apply(spark, tx.fix_spacing, list(cases)) == list(cases.values())


def test_publisher_suffix(spark):
    cases = {
        "New tablet shown - Newsdesk": "New tablet shown",
        "Rates on hold – The Daily Paper": "Rates on hold",
        "Cloud unit expands | Example.test | Wire": "Cloud unit expands",
        "Shops rally - profit drops everywhere": "Shops rally - profit drops everywhere",
        "Analysis - this part is far too long to be a name": "Analysis - this part is far too long to be a name",
        "Plain title": "Plain title",
        "keeps - lower case": "keeps - lower case",
        "drops one - Wire - keeps lower": "drops one - Wire - keeps lower",
    }
    assert apply(spark, tx.strip_publisher, list(cases)) == list(cases.values())


def test_model_text(spark):
    rows = [
        (0, "$TSLA up, $AAPL flat, paid $5bn", "twitter_kaggle"),
        (1, "SMITH : Losses , and bail - outs - Newswire", "gdelt"),
        (2, " ".join(f"w{i}" for i in range(200)), None),
        (3, "   ", "gdelt"),
        (4, None, "gdelt"),
    ]
    df = spark.createDataFrame(rows, "i int, t string, s string")
    got = [r["o"] for r in df.select("i", tx.clean_for_model(F.col("t"), F.col("s")).alias("o")).orderBy("i").collect()]
    assert got[0] == "TSLA up, AAPL flat, paid $5bn"
    assert got[1] == "SMITH: Losses, and bail-outs"
    assert len(got[2].split()) == 128 and got[2].endswith("w127")
    assert got[3] == "" and got[4] == ""


def test_tweet_cleaning(spark):
    raw = ["RT @desk: A &amp; B &gt; C, see https://x.test/a", "Long   $KO and\n\n @you  today", "no & entity"]
    unescaped = apply(spark, tx.html_unescape, raw)
    assert unescaped == [html.unescape(value) for value in raw]
    body = apply(spark, lambda c: tx.strip_urls(tx.strip_retweet(c)), unescaped)
    assert body == ["A & B > C, see", "Long $KO and @you today", "no & entity"]
    assert apply(spark, tx.first_url, unescaped)[0] == "https://x.test/a"


def test_text_id(spark):
    df = spark.sql("SELECT TIMESTAMP '2022-01-01 10:00:00.000005' AS a, TIMESTAMP '2022-01-01 10:00:00' AS b, CAST(NULL AS TIMESTAMP) AS c")
    row = df.select(*[tx.text_id(F.lit("s"), F.col(c), F.lit("AAPL"), F.lit("töxt")).alias(c) for c in "abc"]).first()
    expected = {"a": "2022-01-01T10:00:00.000005+00:00", "b": "2022-01-01T10:00:00+00:00", "c": ""}
    for name, stamp in expected.items():
        assert row[name] == hashlib.sha1(f"s|{stamp}|AAPL|töxt".encode()).hexdigest()[:16]


def test_author_or_domain(spark):
    df = spark.createDataFrame([("Desk ", "http://a.test/x"), (" ", "http://u@b.test:80/x"), (None, None)], "n string, u string")
    assert [r[0] for r in df.select(tx.author_or_domain(F.col("n"), F.col("u"))).collect()] == ["Desk", "u@b.test:80", None]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB é$.9\n ſK-,")), max_size=30), min_size=20, max_size=20))
def test_patterns_agree_with_unicode_rules(spark, values):
    """Cashtags, whitespace and word counts follow Unicode rules on arbitrary text."""
    tags = apply(spark, tx.cashtags, values)
    assert tags == [[t.upper() for t in re.findall(fv.CASHTAG_PATTERN, v)] for v in values]
    assert apply(spark, tx.word_count, values) == [len(v.split()) for v in values]
    assert apply(spark, tx.collapse, values) == [re.sub(r"\s+", " ", v).strip() for v in values]


def test_vocabulary_guard_folds_like_case_insensitive_matching(spark):
    values = ["ſanctions on", "KELVIN K", "plain sanctions"]
    got = apply(spark, lambda c: F.array_join(tx.vocabulary_hits(tx.fold(c), ["sanctions", "k"]), ","), values)
    assert got == ["sanctions", "k", "sanctions"]


@pytest.mark.parametrize("stamp,seconds", [("20240102T030405Z", 1704164645), ("bad", None), (None, None)])
def test_headline_stamp(spark, stamp, seconds):
    df = spark.createDataFrame([(stamp,)], "s string")
    assert df.select(F.unix_seconds(tx.headline_timestamp(F.col("s")))).first()[0] == seconds
