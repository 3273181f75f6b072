import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.config import ImpactParams
from sigspark.operators import alignment, emission, impact, query, returns, sentiment
from sigspark.schemas import SIGNALS, split_valid
from sigspark.sources import writers

UTC = dt.timezone.utc
TEXTS = (
    "text_id string, ts timestamp, source string, text string, primary_ticker string, linked_tickers array<string>, ticker_hint string, "
    "ticker_hints array<string>, link_type string, is_relevant boolean, is_broadcast boolean, sentiment_score double, sentiment_confidence double"
)
NOW = dt.datetime(2024, 1, 5, 12, tzinfo=UTC)


def row(text_id, text, source="newsapi", primary=None, linked=(), hint=None, hints=None, link=None, broadcast=False):
    return (text_id, NOW, source, text, primary, list(linked), hint, hints, link, True, broadcast, 0.6, 0.9)


@pytest.fixture(scope="module")
def emitted(spark):
    rows = [
        row("single", "Phone maker reports strong sales for Q3", primary="AAPL", linked=["AAPL"]),
        row("spread", "Quarterly earnings report for three firms", "twitter_kaggle", None, ["AAPL", "MSFT", "AMZN"], broadcast=True),
        row("weak", "Three firms met", "twitter_kaggle", None, ["AAPL", "MSFT", "AMZN"], broadcast=True),
        row("spam", "pls retweet $AAPL", "twitter_kaggle", "AAPL", ["AAPL"]),
        row("hint", "General talk", "twitter_kaggle", None, [], "AAPL", ["AAPL"], "hint_only"),
        row("hints", "General talk", "twitter_kaggle", None, [], "AAPL", ["AAPL", "MSFT"], "hint_only"),
        row("market", "Federal Reserve leaves interest rates alone", "gdelt", "MARKET", ["MARKET"]),
        row("bench", "Operating profit rose", "financial_phrasebank", "AAPL", ["AAPL"]),
        row("macro", "Prices in the region", "gdelt"),
        row("loose", "Window seat dispute", "gdelt", None, [], "BA"),
    ]
    found = {}
    for signal in emission.emit_signals(spark.createDataFrame(rows, TEXTS)).collect():
        found.setdefault(signal["text_id"], []).append(signal)
    return found


def test_emission_rules(emitted):
    assert set(emitted) == {"single", "spread", "hint", "market", "macro"}
    assert [(s["ticker"], s["attribution_weight"], s["event_type"]) for s in emitted["single"]] == [("AAPL", 1.0, "Earnings")]
    assert sorted(s["ticker"] for s in emitted["spread"]) == ["AAPL", "AMZN", "MSFT"]
    assert all(s["is_broadcast"] and s["attribution_weight"] == 0.3333 for s in emitted["spread"])
    assert emitted["hint"][0]["ticker"] == "AAPL" and emitted["market"][0]["ticker"] == "MARKET" and emitted["macro"][0]["ticker"] == "MARKET"


def test_dampening(emitted):
    spread, parts = emitted["spread"][0], emitted["spread"][0]["impact_components"]
    raw = 1 + 9 * (0.45 * 0.5 + 0.3 * 0.6 + 0.15 * 0.4 + 0.1 * 0.5)
    assert spread["impact_score"] == pytest.approx(1 + (raw - 1) / 3, abs=1e-4)
    assert parts["severity_contrib"] == pytest.approx(0.225 / 3, abs=1e-4) and parts["raw_severity"] == 0.5


def test_all_emitted_signals_are_valid(spark, emitted):
    signals = spark.createDataFrame([s for group in emitted.values() for s in group], SIGNALS)
    good, bad = split_valid(signals)
    assert good.count() == sum(map(len, emitted.values())) and bad.count() == 0
    for name, value in (("impact_score", 11.0), ("sentiment_score", -1.5), ("confidence", float("nan")), ("event_type", "Nope"), ("attribution_weight", 2.0), ("ticker", None)):
        broken = signals.limit(1).withColumn(name, F.lit(value).cast(signals.schema[name].dataType))
        assert split_valid(broken)[1].count() == 1


def test_volume_signal(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(d) for d in range(40)]
    rows = [("TSLA", day, 100 if i == 39 else 10) for i, day in enumerate(days)]
    daily = spark.createDataFrame(rows, "ticker string, date date, volume bigint")
    got = {r["date"]: r["volume_signal"] for r in impact.volume_signals(daily).collect()}
    assert got[days[3]] == 0.5 and got[days[39]] == 1.0 and got[days[20]] == 0.5
    assert got[days[39] + dt.timedelta(3)] < 0.5  # an unobserved day has volume 0
    changed = daily.withColumn("volume", F.when(F.col("date") == F.lit(days[39]), 5).otherwise(F.col("volume")))
    before = {r["date"]: r["mean_volume"] for r in impact.trailing_volume(daily).collect()}
    after = {r["date"]: r["mean_volume"] for r in impact.trailing_volume(changed).collect()}
    assert before == after  # no look-ahead: a day does not enter its own window


def test_impact_weights_are_checked():
    with pytest.raises(ValueError, match="make up 1"):
        ImpactParams(weights={"severity": 0.5, "sentiment": 0.5, "source": 0.2, "volume": 0.1})


def test_sessions(spark):
    dates = [dt.date(2022, 1, d) for d in (3, 4, 5, 6, 7, 10, 11, 12, 13, 14)]
    prices = spark.createDataFrame([(d, "SPY") for d in dates] + [(dt.date(2022, 1, 8), "X")], "date date, ticker string")
    calendar = alignment.Calendar.of(alignment.trading_calendar(prices))
    assert calendar.dates == tuple(dates)
    cases = {
        "2022-01-05 20:59:59": dates[2], "2022-01-05 21:00:00": dates[3], "2022-01-07 21:00:00": dates[5], "2022-01-08 10:00:00": dates[5],
        "2022-01-14 20:00:00": dates[9], "2022-01-14 21:00:00": None, "2021-12-01 00:00:00": dates[0], None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "k string").withColumn("ts", F.col("k").cast("timestamp"))
    assert {r["k"]: r["t0"] for r in alignment.align_to_sessions(df, calendar).collect()} == cases
    large = alignment.Calendar.of(alignment.trading_calendar(prices), limit=3)
    assert large.dates is None
    assert {r["k"]: r["t0"] for r in alignment.align_to_sessions(df, large).collect()} == cases


def test_returns_have_no_look_ahead(spark):
    days = [dt.date(2022, 1, 1) + dt.timedelta(d) for d in range(40)]
    rows = [(d, t, 100.0 * (1.01 + 0.01 * (t == "A")) ** i) for i, d in enumerate(days) for t in ("A", "SPY")]
    prices = spark.createDataFrame(rows, "date date, ticker string, adj_close double")
    base = {(r["ticker"], r["date"]): r for r in returns.abnormal_returns(prices).collect()}
    assert base[("A", days[5])]["ar"] == pytest.approx(0.01) and base[("A", days[10])]["trailing_vol_20"] is None
    assert base[("A", days[11])]["trailing_vol_20"] == pytest.approx(0.02)
    shocked = prices.withColumn("adj_close", F.when(F.col("date") == F.lit(days[30]), 500.0).otherwise(F.col("adj_close")))
    after = {(r["ticker"], r["date"]): r["trailing_vol_20"] for r in returns.abnormal_returns(shocked).collect()}
    assert all(after[("A", d)] == base[("A", d)]["trailing_vol_20"] for d in days[:31])


def fixed_scorer(*names):
    class Fixed:
        labels = list(names)

        def logits(self, texts):
            return np.array([[0.0, 1.0, 3.0] for _ in texts])

    return Fixed


def test_scoring_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("1", "good day", "x"), ("2", "good  day", "x"), ("3", "  ", "x"), ("4", None, "x")], "text_id string, text string, source string")
    path = str(tmp_path / "cache")
    Fixed, Bad = fixed_scorer("Neutral", "negative", "POSITIVE"), fixed_scorer("a", "b", "c")
    scored = {r["text_id"]: r for r in sentiment.score_texts(df, Fixed, cache_path=path).collect()}
    assert scored["1"]["sentiment_label"] == "positive" and scored["1"]["p_pos"] == pytest.approx(np.exp(3) / (1 + np.e + np.exp(3)))
    assert scored["3"]["sentiment_label"] == "neutral" and scored["3"]["sentiment_confidence"] == 1.0 and scored["4"]["p_neu"] == 1.0
    cache = spark.read.parquet(path)
    assert cache.count() == 1 and sentiment.cache_misses(df, cache).count() == 0
    with pytest.raises(Exception, match="lacks labels"):
        sentiment.score_texts(df, Bad).collect()


def test_texts_are_cleaned_once(spark, tmp_path):
    """Each naming of the cleaned text in a plan runs all its patterns again."""
    Fixed = fixed_scorer("neutral", "negative", "positive")
    df = spark.createDataFrame([("1", "Profit rises 1 , 000 - Site", "newsapi"), ("2", " ", "x"), ("3", None, "gdelt")], "text_id string, text string, source string")
    pattern = "slumped"
    times = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count(pattern)
    assert times(sentiment.cache_misses(df, None)) == 1
    assert times(sentiment.score_texts(df, Fixed)) == 2  # one of the texts that are scored, one of the rows that get their scores
    ready = sentiment.with_clean_text(df).drop("text")
    assert ready.columns == ["text_id", "source", "clean_text"]
    once = sentiment.score_texts(ready, Fixed, cache_path=str(tmp_path / "scores"), clean="clean_text")
    assert {tuple(r) for r in once.select("text_id", *sentiment.SCORE_COLUMNS).collect()} == {tuple(r) for r in sentiment.score_texts(df, Fixed).select("text_id", *sentiment.SCORE_COLUMNS).collect()}


def test_filters_and_sinks(spark, emitted, tmp_path):
    with pytest.raises(ValueError):
        query.SignalFilter(min_impact=5, max_impact=2)
    with pytest.raises(ValueError):
        query.SignalFilter(since="yesterday")
    signals = spark.createDataFrame([s for group in emitted.values() for s in group], SIGNALS)
    for size in (0, 5000):
        with pytest.raises(ValueError):
            query.page(signals, limit=size)
    for fmt in ("jsonl", "csv", "parquet"):
        assert writers.export_signals(signals, str(tmp_path / fmt), fmt, query.SignalFilter(ticker="aapl")) == 3
    with pytest.raises(ValueError):
        writers.export_signals(signals, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        writers.write_parquet(signals, str(tmp_path / "big"), max_bytes=10)


def test_filters_do_not_copy_pattern_work(spark):
    """A filter on a linked or classified column stays above the pattern matching."""
    from sigspark.operators.classify import classify_events
    from sigspark.operators.linking import link_entities

    df = spark.createDataFrame([("$KO up", "newsapi")], "text string, source string")
    plan = classify_events(link_entities(df).filter("is_relevant")).filter("event_type = 'Other'")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("scan(") == 2 and len(text) < 200_000
    assert plan.count() == 1


def test_long_exports_stay_partitioned(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS text_id", "'TK' AS ticker", "timestampadd(SECOND, id % 50, TIMESTAMP '2024-01-01') AS ts", "id % 7 AS n")
    rows = rows.unionByName(rows.where("text_id < 40"))  # equal rows
    want = [tuple(r) for r in rows.orderBy("ts", "text_id", "ticker").collect()]
    monkeypatch.setattr(query, "ONE_TASK_ROWS", 100)
    for limit, offset in ((None, 10), (None, 0), (2000, 500), (None, 5000), (60, 10)):
        got = query.ordered_slice(rows, None, limit, offset)
        assert got.columns == rows.columns
        assert [tuple(r) for r in got.collect()] == want[offset:][:limit]
        if limit != 60:
            assert "Limit" not in got._jdf.queryExecution().executedPlan().toString()


def test_export_is_not_cut_to_a_page(spark, tmp_path):
    from sigspark.sources.writers import export_signals

    rows = spark.range(3000).selectExpr("id AS text_id", "'TK' AS ticker", "timestampadd(SECOND, id, TIMESTAMP '2024-01-01') AS ts", "1.0 AS impact_score")
    assert export_signals(rows, str(tmp_path / "all")) == 3000
    assert export_signals(rows, str(tmp_path / "many"), limit=2500) == 2500
    assert export_signals(rows, str(tmp_path / "rest"), offset=10) == 2990
    with pytest.raises(ValueError):
        export_signals(rows, str(tmp_path / "bad"), limit=-1)


def test_lexicon_keeps_decimals_and_takes_a_table(spark):
    df = spark.createDataFrame([(1, "ok fine"), (2, None), (3, "Fine, FINE!")], "id int, text string")
    words = {"ok": 0.04, "fine": 0.25}
    table = spark.createDataFrame(list(words.items()), "word string, valence double")
    for lexicon in (words, table):
        got = {r["id"]: r["compound"] for r in sentiment.lexicon_scores(df, lexicon, "id").collect()}
        assert got == pytest.approx({1: 0.29 / (0.29**2 + 15) ** 0.5, 2: 0.0, 3: 0.5 / (0.5**2 + 15) ** 0.5})


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from sigspark.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(ValueError):
        shared_dir(cluster, "x")
