import json

import pytest
from pyspark.sql import functions as F

from sigspark.config import Dictionary
from sigspark.operators.dedupe import merge_by_url
from sigspark.plans import ingest
from sigspark.sources import prices, readers


def test_tweets(spark, tmp_path):
    path = tmp_path / "tweets.csv"
    path.write_text(
        "Date,Tweet,Stock Name,Company Name\n"
        '2022-01-02 10:00:00+00:00,"Cloud sales grow, says ""desk""",GOOG,Alphabet\n'
        '2022-01-02 09:00:00+00:00,"Cloud sales grow, says ""desk""",GOOG,Alphabet\n'
        '2022-01-02 09:00:00+00:00,"Cloud sales grow, says ""desk""",AAPL,Apple\n'
        '2022-01-03 12:00:00+00:00,"Record quarter\nfor phones",AAPL,Apple\n'
        "2022-01-04 14:00:00+00:00,Cars delivered in december,NIO,NIO\n"
        "2022-01-05 15:00:00+00:00,Great stock!,AAPL,Apple\n"
    )
    texts, audit = ingest.normalize_tweets(readers.read_tweets(spark, str(path)), ["AAPL", "GOOGL"])
    rows = {r["text"]: r for r in texts.collect()}
    assert len(rows) == 2
    merged = rows['Cloud sales grow, says "desk"']
    assert merged["ticker_hints"] == ["AAPL", "GOOGL"] and merged["ticker_hint"] == "AAPL"
    assert merged["dup_count"] == 3 and str(merged["ts"]) == "2022-01-02 09:00:00"
    assert rows["Record quarter for phones"]["dup_count"] == 1
    counts = audit.first().asDict()
    assert counts == {"raw_count": 6, "dropped_non_universe": 1, "dropped_short": 1, "kept_count": 4, "kept_undated": 0,
                      "dropped_per_hint_dups": 1, "dropped_cross_hint_dups": 1, "final_count": 2}


def test_articles(spark, tmp_path):
    def article(title, description, url, hour, name="Wire"):
        return {"source": {"id": None, "name": name}, "title": title, "description": description, "url": url,
                "publishedAt": f"2026-10-04T{hour:02d}:00:00Z"}

    payload = {"status": "ok", "articles": [
        article("Phones sell well", "More soon [+12 chars]", "https://n.test/1", 12),
        article("Phones sell well (again)", "More", "https://n.test/1", 13, "Other"),
        article("[Removed]", "[Removed]", "https://n.test/2", 14),
        article("No source", None, "https://m.test/3", 15, " "),
    ]}
    (tmp_path / "Apple_20261005_010000.json").write_text(json.dumps(payload))
    texts, audit = ingest.normalize_articles(readers.read_articles(spark, str(tmp_path)))
    rows = {r["url"]: r for r in texts.collect()}
    assert set(rows) == {"https://n.test/1", "https://m.test/3"}
    first = rows["https://n.test/1"]
    assert first["text"] == "Phones sell well. More soon" and first["dup_count"] == 2 and first["ticker_hint"] == "AAPL"
    assert first["author_or_domain"] == "Wire" and rows["https://m.test/3"]["author_or_domain"] == "m.test"
    counts = audit.first()
    assert (counts["dropped_removed_or_empty"], counts["dropped_dups"], counts["final_count"]) == (1, 1, 2)
    (tmp_path / "Unknown_20261005_010000.json").write_text(json.dumps(payload))
    with pytest.raises(ValueError):
        readers.read_articles(spark, str(tmp_path))


def test_headlines(spark, tmp_path):
    rows = [
        {"url": "u1", "title": "Rates stay put again", "seendate": "20260101T000000Z", "domain": "a.test"},
        {"url": "u1", "title": "Rates stay put again", "seendate": "20260102T000000Z", "domain": "a.test"},
        {"url": "u2", "title": "RATES stay put, again!", "seendate": "bad", "domain": "b.test"},
        {"url": "u3", "title": "Too short", "seendate": "20260101T000000Z", "domain": "c.test"},
    ]
    (tmp_path / "SPY_20260101_000000.json").write_text(json.dumps(rows))
    (tmp_path / "KO_20260101_000000.json").write_text(json.dumps(rows[2:3]))
    texts, audit = ingest.normalize_headlines(readers.read_headlines(spark, str(tmp_path)))
    got = sorted((r["ticker_hint"], r["url"], r["dup_count"]) for r in texts.collect())
    assert got == [("KO", "u2", 1), ("MARKET", "u1", 2)]
    counts = audit.first()
    assert counts["dropped_short"] == 1 and counts["final_count"] == 2
    assert counts["kept_count"] == counts["dropped_dups"] + counts["final_count"]


def test_labelled(spark, tmp_path):
    path = tmp_path / "all.csv"
    path.write_bytes('Neutral ,"Profit was EUR 15 mn ."\nneutral,"Profit was EUR 15 mn ."\npositive,"Café sales rose ."\n'.encode("latin-1"))
    texts, _ = ingest.normalize_labelled(readers.read_labelled_news(spark, str(path)))
    got = sorted((r["raw_label"], r["text"], r["dup_count"]) for r in texts.collect())
    assert got == [("neutral", "Profit was EUR 15 mn.", 2), ("positive", "Café sales rose.", 1)]


def test_theme_files(spark, tmp_path):
    assert readers.read_theme_files(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "a.tsv").write_text("1\tX;Y\tz\n2\tonly\n")
    rows = readers.read_theme_files(spark, str(tmp_path), 3).orderBy("c0").collect()
    assert [tuple(r) for r in rows] == [("1", "X;Y", "z"), ("2", "only", None)]


def test_url_merge(spark):
    df = spark.createDataFrame(
        [
            ("b", "2024-01-02", "u", ["AAPL"], ["V"], ["AAPL"], 2, True, "AAPL"),
            ("a", "2024-01-01", "u", ["MSFT", "KO"], [], ["KO"], 3, False, "KO"),
            ("c", "2024-01-03", None, ["PG"], [], [], 1, True, "PG"),
            ("d", "2024-01-03", " ", ["PG"], [], [], 1, True, "PG"),
        ],
        "text_id string, ts string, url string, linked_tickers array<string>, other_cashtags array<string>, ticker_hints array<string>, "
        "dup_count bigint, is_relevant boolean, primary_ticker string",
    ).withColumns({"n_linked_tickers": F.lit(1), "is_broadcast": F.lit(False), "attribution_weight": F.lit(1.0), "ts": F.col("ts").cast("timestamp")})
    rows = {r["text_id"]: r for r in merge_by_url(df).collect()}
    assert set(rows) == {"a", "c", "d"}
    merged = rows["a"]
    assert merged["linked_tickers"] == ["AAPL", "KO", "MSFT"] and merged["other_cashtags"] == ["V"] and merged["ticker_hints"] == ["AAPL", "KO"]
    assert (merged["dup_count"], merged["is_relevant"], merged["is_broadcast"], merged["primary_ticker"]) == (5, True, True, None)
    assert merged["attribution_weight"] == 0.3333


def test_corpus_plan(spark):
    schema = "text_id string, ts timestamp, source string, ticker_hint string, ticker_hints array<string>, title string, text string, url string, author_or_domain string, raw_label string, dup_count bigint"
    one = lambda source, url: spark.createDataFrame([("i", None, source, "KO", ["KO"], None, "Coke and $KO rise", url, None, None, 1)], schema)
    corpus = ingest.linked_corpus(one("twitter_kaggle", None), one("newsapi", "u"), one("gdelt", "u"))
    assert sorted(r["primary_ticker"] for r in corpus.collect()) == ["KO", "KO", "KO"]


def test_price_shapes(spark):
    wide = spark.createDataFrame([("2024-01-02", 1.0, 2.0, None)], "Date string, `Close|AAPL` double, `KO|Close` double, `Open|AAPL` double")
    rows = prices.standardize_prices(prices.wide_to_long(wide)).orderBy("ticker").collect()
    assert [(str(r["date"]), r["ticker"], r["close"], r["adj_close"]) for r in rows] == [("2024-01-02", "AAPL", 1.0, None), ("2024-01-02", "KO", 2.0, None)]
    bare = spark.createDataFrame([("2024-01-02", "x"), ("2024-01-03", "5")], "date string, close string")
    assert [(r["ticker"], r["close"], r["adj_close"]) for r in prices.standardize_prices(bare, "ko").collect()] == [("KO", 5.0, 5.0)]
    series = json.dumps({"2024-01-01": {"4. close": "1"}, "2024-01-05": {"1. open": "2", "4. close": "3"}})
    row = prices.from_daily_map(spark.createDataFrame([("ko", series)], "ticker string, payload string"), "2024-01-02").collect()
    assert [(str(r["date"]), r["ticker"], r["open"], r["close"], r["volume"]) for r in row] == [("2024-01-05", "KO", 2.0, 3.0, 0.0)]


def test_dictionary_names():
    names = Dictionary.default().query_names()
    assert names["Apple_Inc."] == "AAPL" and names["S_P_500_ETF"] == "SPY"
