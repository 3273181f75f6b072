"""Text functions, deduplication, linking, classification, sentiment, impact, emission."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sigspark import fixed_values as fv
from sigspark.checks import text_sql  # noqa: F401  (defines the linking and classification SQL)
from sigspark.checks.registry import query, wrap
from sigspark.checks.text_sql import quoted, spacing_sql
from sigspark.checks.views import define, signals, sql_with, table, texts
from sigspark.config import EventRules
from sigspark.functions import text as tx
from sigspark.functions.numeric import clip, sigmoid
from sigspark.operators import dedupe, emission, impact, profile, sentiment
from sigspark.operators.classify import classify_events, matched_rules
from sigspark.operators.linking import link_entities, split_cashtags, unlink_generic_terms
from sigspark.config import Dictionary
from sigspark.schemas import signal_is_valid
from sigspark.session import persist_table, shared_dir

# ------------------------------------------------------------------ text functions

DECORATED = """SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'RT @desk_' || (doc_id % 7) || ':  ' ELSE '' END, text,
  CASE WHEN doc_id % 3 = 0 THEN ' see https://t.co/' || doc_id || '?a=b and www.ex.test/p ' ELSE '' END) AS raw FROM documents"""


def decorated(spark, folder):
    return table(spark, folder, "documents").selectExpr(
        "doc_id",
        "concat(CASE WHEN doc_id % 5 = 0 THEN concat('RT @desk_', doc_id % 7, ':  ') ELSE '' END, text, "
        "CASE WHEN doc_id % 3 = 0 THEN concat(' see https://t.co/', doc_id, '?a=b and www.ex.test/p ') ELSE '' END) AS raw",
    )


@query("clean_text", rf"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(body, 'https?://\S+|www\.\S+', '', 'gi'), '\s+', ' ', 'g'))) AS clean_md5,
  nullif(regexp_extract(body, 'https?://\S+|www\.\S+', 0, 'i'), '') AS url
FROM (SELECT doc_id, regexp_replace(raw, '^RT\s+@\w+:\s*', '', 'i') AS body FROM ({DECORATED}))""")
def clean_text(spark, folder):
    body = decorated(spark, folder).withColumn("body", tx.strip_retweet(F.col("raw")))
    return body.select("doc_id", F.md5(tx.strip_urls(F.col("body")).cast("binary")).alias("clean_md5"), tx.first_url(F.col("body")).alias("url"))


@query("html_unescape", r"""
SELECT page_id, md5(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) AS text_md5 FROM pages""")
def html_unescape(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", F.md5(tx.html_unescape(F.col("html")).cast("binary")).alias("text_md5"))


@query("word_filter", wrap(r"""
SELECT doc_id, n_words FROM (SELECT doc_id, CASE WHEN trim(text, E' \n\t\r') = '' THEN 0
  ELSE len(string_split_regex(trim(text, E' \n\t\r'), '\s+')) END AS n_words FROM documents) WHERE n_words >= 3""", "", "n_words"))
def word_filter(spark, folder):
    counted = table(spark, folder, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))
    return counted.filter("n_words >= 3")


@query("text_ids", """
SELECT doc_id, substr(sha1(concat_ws('|', 'twitter_kaggle', strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S') || '+00:00',
  CASE WHEN doc_id % 2 = 0 THEN 'AAPL' ELSE '' END, text)), 1, 16) AS text_id FROM documents""")
def text_ids(spark, folder):
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("doc_id").cast("int"))
    hint = F.when(F.col("doc_id") % 2 == 0, "AAPL")
    return table(spark, folder, "documents").select("doc_id", tx.text_id(F.lit("twitter_kaggle"), ts, hint, F.col("text")).alias("text_id"))


@query("event_ids", """
SELECT event_id, substr(sha1(concat_ws('|', event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00', '', props)), 1, 16) AS text_id FROM events""")
def event_ids(spark, folder):
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", tx.text_id(F.col("event_type"), F.col("ts"), None, F.col("props")).alias("text_id"))


@query("normalized_title", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'))) AS title_md5 FROM documents""")
def normalized_title(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.normalized_title(F.col("text")).cast("binary")).alias("title_md5"))


HEADLINES = """SELECT doc_id, concat('Report ', doc_id, ' ', replace(text, '|', ' '),
  [' - Daily Desk', ' | Example.test', ' - profit drops again', ' — wire news', ' - One - Two Three', ''][doc_id % 6 + 1]) AS title FROM documents"""
SUFFIX = r"\s+(?:–|—|-|\|)\s+([^–—|\-]+)$"


def headlines(spark, folder):
    suffixes = [" - Daily Desk", " | Example.test", " - profit drops again", " — wire news", " - One - Two Three", ""]
    lead = F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(" "), F.translate("text", "|", " "))
    suffix = F.get(F.array(*[F.lit(s) for s in suffixes]), (F.col("doc_id") % 6).cast("int"))
    return table(spark, folder, "documents").select("doc_id", F.concat(lead, suffix).alias("title"))


@query("publisher_suffix", rf"""
WITH RECURSIVE it AS (
  SELECT doc_id, trim(title, E' \n\t\r') AS t FROM ({HEADLINES})
  UNION ALL
  SELECT doc_id, trim(regexp_replace(t, {quoted(SUFFIX)}, ''), E' \n\t\r') FROM (
    SELECT doc_id, t, trim(regexp_extract(t, {quoted(SUFFIX)}, 1), E' \n\t\r') AS s FROM it WHERE regexp_matches(t, {quoted(SUFFIX)}))
  WHERE s <> '' AND len(string_split_regex(s, '\s+')) < 8 AND NOT regexp_matches(s, {quoted(fv.FINANCE_WORDS_PATTERN)}, 'i')
    AND (regexp_matches(s, '^\p{{Lu}}') OR contains(s, '.')))
SELECT doc_id, arg_min(t, length(t)) AS title FROM it GROUP BY doc_id""")
def publisher_suffix(spark, folder):
    return headlines(spark, folder).select("doc_id", tx.strip_publisher(F.col("title")).alias("title"))


define("unpublished", rf"""SELECT text_id, trim(text, E' \n\t\r') AS t FROM texts_v WHERE source <> 'twitter_kaggle'
UNION ALL
SELECT text_id, trim(regexp_replace(t, {quoted(SUFFIX)}, ''), E' \n\t\r') FROM (
  SELECT text_id, t, trim(regexp_extract(t, {quoted(SUFFIX)}, 1), E' \n\t\r') AS s FROM unpublished WHERE regexp_matches(t, {quoted(SUFFIX)}))
WHERE s <> '' AND len(string_split_regex(s, '\s+')) < 8 AND NOT regexp_matches(s, {quoted(fv.FINANCE_WORDS_PATTERN)}, 'i')
  AND (regexp_matches(s, '^\p{{Lu}}') OR contains(s, '.'))""", "texts_v")
define("model_text", rf"""SELECT text_id, source, array_to_string(list_filter(string_split_regex(body, '\s+'), lambda x: x <> '')[1:128], ' ') AS clean FROM (
  SELECT text_id, source, CASE WHEN source = 'twitter_kaggle' THEN regexp_replace(text, '\$([A-Za-z]{{1,5}}(?:\.[A-Za-z]{{1,2}})?)\b', ' \1 ', 'g') ELSE {spacing_sql('kept')} END AS body
  FROM texts_v LEFT JOIN (SELECT text_id, arg_min(t, length(t)) AS kept FROM unpublished GROUP BY text_id) USING (text_id))""", "texts_v", "unpublished")


@query("clean_for_model", sql_with("model_text", "SELECT text_id, md5(clean) AS clean_md5, len(list_filter(string_split(clean, ' '), lambda x: x <> '')) AS n_words FROM model_text"))
def clean_for_model(spark, folder):
    """Texts of all sources, each cleaned by its source's rule."""
    rows = texts(spark, folder)
    clean = tx.clean_for_model(F.col("text"), F.col("source"))
    return rows.select("text_id", clean.alias("c")).select("text_id", F.md5(F.col("c").cast("binary")).alias("clean_md5"), tx.word_count(F.col("c")).alias("n_words"))


@query("title_description", r"""
SELECT conv_id, turn, CASE WHEN d <> '' THEN t || '. ' || d ELSE t END AS text FROM (
  SELECT conv_id, turn, 'Title ' || conv_id AS t, CASE WHEN turn % 2 = 0 THEN 'Part ' || turn ELSE '' END AS d FROM conversations)""")
def title_description(spark, folder):
    """Truncation marks and empty descriptions."""
    rows = table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "concat('Title ', conv_id) AS title",
        "CASE WHEN turn % 2 = 0 THEN concat('Part ', turn, ' [+', conv_id, ' chars]') ELSE ' [+12 chars]' END AS description",
    )
    return rows.select("conv_id", "turn", tx.title_and_description(F.col("title"), F.col("description")).alias("text"))


@query("author_or_domain", r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Desk ' || page_id ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) END AS author FROM pages""")
def author_or_domain(spark, folder):
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" Desk "), F.col("page_id").cast("string"), F.lit(" "))).when(F.col("page_id") % 3 == 1, F.lit("  "))
    return table(spark, folder, "pages").select("page_id", tx.author_or_domain(name, F.col("url")).alias("author"))


@query("headline_timestamps", """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT ELSE -1 END AS seconds FROM events""")
def headline_timestamps(spark, folder):
    """Compact UTC stamps; malformed ones become null."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stamp = F.when(F.col("event_id") % 7 == 0, "not a date").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    return rows.select("event_id", F.coalesce(F.unix_seconds(tx.headline_timestamp(stamp)), F.lit(-1)).alias("seconds"))


@query("headlines_200", sql_with("texts_v", "SELECT text_id, substr(coalesce(title, text), 1, 200) AS headline FROM texts_v"))
def headlines_200(spark, folder):
    return texts(spark, folder).select("text_id", tx.headline(F.col("title"), F.col("text")).alias("headline"))


@query("canonical_labels", sql_with("texts_v", """
SELECT text_id, ticker FROM (SELECT text_id, CASE text_id % 5 WHEN 0 THEN 'GOOGL' WHEN 1 THEN 'META' WHEN 2 THEN 'MARKET' WHEN 3 THEN 'KO' ELSE 'XYZ' END AS ticker
FROM texts_v) WHERE ticker IN ('GOOGL', 'META', 'MARKET', 'KO')"""))
def canonical_labels(spark, folder):
    names = F.array(*[F.lit(n) for n in ("goog", "fb", "Spy", "ko", "xyz")])
    ticker = tx.canonical_ticker(F.get(names, (F.col("text_id") % 5).cast("int")))
    return texts(spark, folder).select("text_id", ticker.alias("ticker")).filter(F.col("ticker").isin("GOOGL", "META", "MARKET", "KO"))


@query("calendar_keys", "SELECT event_id, strftime(ts, '%Y-%m') AS month, CAST(date_trunc('week', ts) AS DATE) AS week FROM events")
def calendar_keys(spark, folder):
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", tx.month_key(F.col("ts")).alias("month"), tx.week_key(F.to_date("ts")).alias("week"))


@query("bounded_numbers", wrap("""
SELECT event_id, greatest(1, least(10, value / 20)) AS clipped, CASE WHEN value - 25 < -20 THEN 0 WHEN value - 25 > 20 THEN 1
  ELSE 1 / (1 + exp(-(value - 25))) END::DOUBLE AS squashed FROM events""", "clipped squashed"))
def bounded_numbers(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", clip(F.col("value") / 20.0, 1.0, 10.0).alias("clipped"), sigmoid(F.col("value") - 25.0).alias("squashed")
    )


@query("signal_validation", wrap("""
SELECT valid, count(*) AS n FROM (SELECT abs(s) <= 1 AND i BETWEEN 1 AND 10 AND c BETWEEN 0 AND 1 AND e IN ('view', 'Other') AS valid FROM (
  SELECT (event_id % 300) / 200.0 - 0.5 AS s, 1 + (event_id % 100) / 10.0 AS i, (event_id % 11) / 10.0 AS c,
    CASE WHEN event_id % 13 = 0 THEN 'Unknown' ELSE 'Other' END AS e FROM events)) GROUP BY valid""", "", "n"))
def signal_validation(spark, folder):
    rows = table(spark, folder, "events").selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts", "'T' AS ticker", "'s' AS source", "CAST(event_id AS STRING) AS text_id", "'h' AS headline",
        "(event_id % 300) / 200D - 0.5D AS sentiment_score", "1 + (event_id % 100) / 10D AS impact_score", "(event_id % 11) / 10D AS confidence",
        "CASE WHEN event_id % 13 = 0 THEN 'Unknown' ELSE 'Other' END AS event_type", "CAST(NULL AS DOUBLE) AS event_confidence",
        "CAST(NULL AS STRING) AS secondary_event", "CAST(NULL AS DOUBLE) AS attribution_weight",
    )
    return rows.groupBy(signal_is_valid().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ deduplication

@query("dup_counts", wrap("SELECT md5(text) AS text_md5, count(*) AS dup_count FROM documents GROUP BY text", "", "dup_count"))
def dup_counts(spark, folder):
    counted = dedupe.dup_count(table(spark, folder, "documents").select("doc_id", "text"), ["text"], "doc_id")
    return counted.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "dup_count")


@query("keep_first", wrap("""
SELECT doc_id, source, dup_count FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY text) AS dup_count,
  row_number() OVER (PARTITION BY text ORDER BY doc_id % 50, doc_id) AS rn FROM documents) WHERE rn = 1""", "", "dup_count"))
def keep_first(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source", "text", (F.col("doc_id") % 50).alias("seen"))
    return dedupe.keep_first(documents, ["text"], ["seen", "doc_id"], "dup_count").select("doc_id", "source", "dup_count")


@query("cross_label_merge", wrap("""
SELECT min(doc_id) AS doc_id, string_agg(DISTINCT source, ',' ORDER BY source) AS labels, min(source) AS label, count(*) AS dup_count
FROM documents GROUP BY text, lang""", "", "dup_count"))
def cross_label_merge(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source", "text", "lang")
    per_label = dedupe.keep_first(documents, ["text", "lang", "source"], ["doc_id"], "dup_count")
    merged = dedupe.merge_labels(per_label, ["text", "lang"], "source", ["doc_id"])
    return merged.select("doc_id", F.array_join("sources", ",").alias("labels"), F.col("source").alias("label"), "dup_count")


@query("two_stage_dedupe", wrap(r"""
SELECT doc_id, source, dup_count FROM (
  SELECT *, row_number() OVER (PARTITION BY source, norm ORDER BY doc_id) AS rt FROM (
    SELECT doc_id, source, count(*) OVER (PARTITION BY source, url) AS dup_count, row_number() OVER (PARTITION BY source, url ORDER BY doc_id) AS ru,
      trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS norm
    FROM (SELECT *, doc_id % 97 AS url FROM documents)) WHERE ru = 1) WHERE rt = 1""", "", "dup_count"))
def two_stage_dedupe(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source", "text", (F.col("doc_id") % 97).alias("url"))
    by_url = dedupe.keep_first(documents, ["source", "url"], ["doc_id"], "dup_count")
    keyed = by_url.withColumn("norm", tx.normalized_title(F.col("text")))
    return dedupe.keep_first(keyed, ["source", "norm"], ["doc_id"]).select("doc_id", "source", "dup_count")


@query("url_merge", wrap(sql_with("linked", """
SELECT url, min_by(text_id, {'t': ts, 'i': text_id}) AS text_id, array_to_string(list_sort(list_distinct(flatten(list(linked_tickers)))), ',') AS linked,
  array_to_string(list_sort(list_distinct(flatten(list(other_cashtags)))), ',') AS other, sum(dup_count) AS dup_count,
  bool_or(is_relevant) AS is_relevant, len(list_filter(list_distinct(flatten(list(linked_tickers))), lambda t: t <> 'MARKET')) >= 3 AS is_broadcast
FROM linked WHERE source <> 'twitter_kaggle' AND text_id % 11 <> 0 GROUP BY url
UNION ALL SELECT NULL, text_id, array_to_string(list_sort(linked_tickers), ','), array_to_string(other_cashtags, ','), dup_count, is_relevant, is_broadcast
FROM linked WHERE source <> 'twitter_kaggle' AND text_id % 11 = 0"""), "", "dup_count"))
def url_merge(spark, folder):
    """Copies under one URL become one row; rows without URL pass."""
    news = texts(spark, folder).filter(F.col("source") != "twitter_kaggle")
    news = news.withColumn("url", F.when(F.col("text_id") % 11 != 0, F.col("url")))
    merged = dedupe.merge_by_url(link_entities(news))
    return merged.select(
        "url", "text_id", F.array_join(F.array_sort("linked_tickers"), ",").alias("linked"), F.array_join("other_cashtags", ",").alias("other"),
        "dup_count", "is_relevant", "is_broadcast",
    )


@query("step_audit", wrap(r"""
SELECT count(*) AS raw_count, count_if(lang <> 'en') AS dropped_language, count_if(lang = 'en' AND n_chars < 200) AS dropped_short,
  count_if(lang = 'en' AND n_chars >= 200) AS kept_count FROM documents""", "", "raw_count dropped_language dropped_short kept_count"))
def step_audit(spark, folder):
    documents = table(spark, folder, "documents")
    return dedupe.step_counts(documents, {"language": F.col("lang") != "en", "short": F.col("n_chars") < 200})


# ------------------------------------------------------------------ linking and classification

# The SQL engine's \\b knows ASCII letters only, so a match that runs up to the last word
# boundary of a line may end earlier there. Matched texts are compared up to their last
# ASCII letter or digit.
TAIL = "[^A-Za-z0-9_]+$"
TRIGGERS_SQL = f"md5(array_to_string(list_transform(matched_triggers, lambda t: regexp_replace(t, '{TAIL}', '')), '|')) AS triggers_md5"


def triggers_md5():
    trimmed = F.transform("matched_triggers", lambda term: F.regexp_replace(term, TAIL, ""))
    return F.md5(F.array_join(trimmed, "|").cast("binary")).alias("triggers_md5")


@query("cashtags", sql_with("tagged", r"""
SELECT text_id, array_to_string(list_transform(regexp_extract_all(text, '\$([A-Za-z]{1,5}(?:\.[A-Za-z]{1,2})?)\b', 1), lambda t: upper(t)), ',') AS tags FROM texts_v"""))
def cashtags(spark, folder):
    return texts(spark, folder).select("text_id", F.array_join(tx.cashtags(F.col("text")), ",").alias("tags"))


@query("cashtag_split", sql_with("raw_evidence", """
SELECT text_id, array_to_string(tags, ',') AS known, array_to_string(list_sort(list_distinct(unknown)), ',') AS other FROM raw_evidence"""))
def cashtag_split(spark, folder):
    known, unknown = split_cashtags(tx.cashtags(F.col("text")), Dictionary.default())
    return texts(spark, folder).select(
        "text_id", F.array_join(known, ",").alias("known"), F.array_join(F.array_sort(F.array_distinct(unknown)), ",").alias("other")
    )


@query("entity_links", wrap(sql_with("linked", """
SELECT text_id, array_to_string(linked_tickers, ',') AS linked, primary_ticker, link_type, link_confidence, n_linked_tickers, is_broadcast,
  array_to_string(other_cashtags, ',') AS other, attribution_weight, is_relevant, matched_term, ticker_hint FROM linked"""),
    "link_confidence attribution_weight", "n_linked_tickers"))
def entity_links(spark, folder):
    linked = link_entities(texts(spark, folder))
    return linked.select(
        "text_id", F.array_join("linked_tickers", ",").alias("linked"), "primary_ticker", "link_type", "link_confidence", "n_linked_tickers",
        "is_broadcast", F.array_join("other_cashtags", ",").alias("other"), "attribution_weight", "is_relevant", "matched_term", "ticker_hint",
    )


@query("generic_term_unlink", sql_with("linked", r"""
SELECT text_id, array_to_string(CASE WHEN g THEN list_filter(linked_tickers, lambda t: t <> 'MSFT') ELSE linked_tickers END, ',') AS linked,
  CASE WHEN NOT (g AND coalesce(primary_ticker = 'MSFT', false)) THEN primary_ticker END AS primary_ticker, CASE WHEN NOT g THEN link_type END AS link_type
FROM (SELECT *, text_id % 2 = 0 AND NOT regexp_matches(text || ' ' || coalesce(title, ''), '\b(?:microsoft|msft)\b', 'i') AS g FROM linked)"""))
def generic_term_unlink(spark, folder):
    linked = link_entities(texts(spark, folder))
    marked = linked.withColumn("matched_term", F.when(F.col("text_id") % 2 == 0, "Windows").otherwise(F.col("matched_term")))
    return unlink_generic_terms(marked).select("text_id", F.array_join("linked_tickers", ",").alias("linked"), "primary_ticker", "link_type")


_RULES = EventRules()
_RULE_ROWS = " UNION ALL ".join(
    f"SELECT text_id, {quoted(event)} AS event_type, {i} AS rule, r{_RULES.rank(event)}_{i} AS term, {weight}::DOUBLE AS weight FROM hits"
    for event, triggers in _RULES.triggers.items()
    for i, (_, weight) in enumerate(triggers)
)


@query("event_rules", wrap(sql_with("hits", f"SELECT text_id, event_type, rule, md5(regexp_replace(term, '{TAIL}', '')) AS term_md5, weight FROM ({_RULE_ROWS}) WHERE term IS NOT NULL"), "weight", "rule"))
def event_rules(spark, folder):
    rows = matched_rules(texts(spark, folder), "text_id")
    return rows.select("text_id", "event_type", "rule", F.md5(F.regexp_replace("term", TAIL, "").cast("binary")).alias("term_md5"), "weight")


@query("event_classes", wrap(sql_with("classified", f"""
SELECT text_id, event_type, event_confidence, {TRIGGERS_SQL}, secondary_event, is_template, is_calendar,
  is_analyst_action FROM classified"""), "event_confidence"))
def event_classes(spark, folder):
    classified = classify_events(texts(spark, folder))
    return classified.select(
        "text_id", "event_type", "event_confidence", triggers_md5(),
        "secondary_event", "is_template", "is_calendar", "is_analyst_action",
    )


# ------------------------------------------------------------------ sentiment

LEXICON = {
    "beat": 1.85, "jump": 1.2, "growth": 2.1, "upgraded": 1.5, "nice": 1.8, "launch": 0.9, "lift": 1.1, "good": 1.9,
    "probe": -1.27, "junk": -2.2, "cuts": -1.1, "sanctions": -1.9, "fails": -2.3, "drop": -1.6, "troubled": -2.0, "bad": -2.5,
}


@query("lexicon_sentiment", wrap(sql_with("texts_v", f"""
SELECT text_id, compound, CASE WHEN compound >= 0.05::DOUBLE THEN 'positive' WHEN compound <= -0.05::DOUBLE THEN 'negative' ELSE 'neutral' END AS lexicon_label
FROM (SELECT text_id, x / sqrt(x * x + 15) AS compound FROM (SELECT t.text_id, CAST(coalesce(sum(l.v), 0) AS DOUBLE) AS x FROM (
    SELECT text_id, unnest(string_split_regex(lower(text), '[^a-z'']+')) AS w FROM texts_v) t
  LEFT JOIN (VALUES {', '.join(f"('{w}', {v}::DECIMAL(18, 9))" for w, v in LEXICON.items())}) l(w, v) ON l.w = t.w GROUP BY t.text_id))"""), "compound"))
def lexicon_sentiment(spark, folder):
    return sentiment.lexicon_scores(texts(spark, folder), LEXICON, "text_id")


class LengthScorer:
    """Deterministic stand-in for a model: logits from the length of a text."""

    labels = ["neutral", "Positive", "negative"]

    def logits(self, batch):
        return np.array([[len(text) % 7, len(text) % 5, len(text) % 3] for text in batch], dtype=float)


PROBABILITIES = """SELECT text_id, exp(n % 5) / s AS p_pos, exp(n % 3) / s AS p_neg, exp(n % 7) / s AS p_neu FROM (
  SELECT text_id, n, exp(n % 7) + exp(n % 5) + exp(n % 3) AS s FROM (SELECT text_id, length(clean) AS n FROM model_text WHERE clean <> ''))
UNION ALL SELECT text_id, 0, 0, 1 FROM model_text WHERE clean = ''"""
SCORES = f"""SELECT text_id, p_pos - p_neg AS sentiment_score, CASE WHEN p_pos >= p_neg AND p_pos >= p_neu THEN 'positive' WHEN p_neg >= p_neu THEN 'negative' ELSE 'neutral' END
  AS sentiment_label, greatest(p_pos, p_neg, p_neu) AS sentiment_confidence, p_pos, p_neg, p_neu FROM ({PROBABILITIES})"""


@query("model_scores", wrap(sql_with("model_text", SCORES), "sentiment_score sentiment_confidence p_pos p_neg p_neu"))
def model_scores(spark, folder):
    """Distinct cleaned texts are scored once in Arrow batches and joined back by content hash."""
    rows = texts(spark, folder).select("text_id", "text", "source")
    return sentiment.score_texts(rows, LengthScorer).select("text_id", *sentiment.SCORE_COLUMNS)


BLANKED = SCORES.replace("FROM model_text", "FROM (SELECT text_id, CASE WHEN text_id % 7 < 3 THEN '' ELSE clean END AS clean FROM model_text)")


@query("blank_scores", wrap(sql_with("model_text", BLANKED), "sentiment_score sentiment_confidence p_pos p_neg p_neu"))
def blank_scores(spark, folder):
    """Blank and null texts are neutral with full confidence; no model sees them."""
    rows = texts(spark, folder).select("text_id", "source", F.when(F.col("text_id") % 7 == 0, " \n\t").when(F.col("text_id") % 7 > 2, F.col("text")).alias("text"))
    return sentiment.score_texts(rows, LengthScorer).select("text_id", *sentiment.SCORE_COLUMNS)


@query("cache_misses", sql_with("model_text", """
SELECT DISTINCT sha1(clean) AS cache_key FROM model_text WHERE sha1(clean) NOT IN (SELECT sha1(clean) FROM model_text WHERE text_id % 3 = 0 AND text_id % 2 = 0)"""))
def cache_misses(spark, folder):
    rows = texts(spark, folder)
    cached = sentiment.cache_misses(rows.filter("text_id % 3 = 0 AND text_id % 2 = 0"), None)
    return sentiment.cache_misses(rows, cached).select("cache_key")


@query("cached_scores", wrap(sql_with("model_text", f"SELECT text_id, 3 AS n_runs, 1 AS n_rows, p_pos FROM ({SCORES})"), "p_pos", "n_runs n_rows"))
def cached_scores(spark, folder):
    """Three runs on one cache folder: each returns every row once, with the same scores."""
    rows = sentiment.with_clean_text(texts(spark, folder).select("text_id", "text", "source"))
    rows = persist_table(rows.select("text_id", "clean_text"), "clean")  # three runs over the same rows, which are cleaned once
    path, runs = shared_dir(spark, "scores"), None
    for n, part in enumerate((rows.filter("text_id % 2 = 0"), rows, rows)):
        scored = persist_table(sentiment.score_texts(part, LengthScorer, cache_path=path, clean="clean_text").select("text_id", "p_pos", F.lit(n).alias("run")), "scored")
        runs = scored if runs is None else runs.unionByName(scored)
    # even ids took part in all three runs, odd ones in two
    counted = runs.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("run", "p_pos").alias("r"), F.count_distinct("p_pos").alias("v"), F.max("p_pos").alias("p_pos")
    )
    return counted.select("text_id", (F.col("n") + F.pmod("text_id", F.lit(2))).alias("n_runs"), (F.col("n") / F.col("r") * F.col("v")).cast("long").alias("n_rows"), "p_pos")


@query("sanity_report", wrap(sql_with("texts_v", r"""
SELECT source, count(*) AS n_rows, count_if(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) > 128) AS n_truncated,
  avg(sentiment_score) AS mean_score, stddev_samp(sentiment_score) AS std_score, count_if(sentiment_score < -0.2::DOUBLE) AS n_negative,
  count_if(abs(sentiment_score) <= 0.2::DOUBLE) AS n_neutral, count_if(sentiment_score > 0.2::DOUBLE) AS n_positive FROM texts_v GROUP BY source"""),
    "mean_score std_score", "n_rows n_truncated n_negative n_neutral n_positive"))
def sanity_report(spark, folder):
    score = F.col("sentiment_score")
    label = F.when(score < -0.2, "negative").when(score > 0.2, "positive").otherwise("neutral")
    return sentiment.sanity_report(texts(spark, folder).withColumn("sentiment_label", label))


@query("sentiment_by_ticker", wrap(sql_with("signals_v", """
SELECT ticker, count(sentiment_score) AS n, avg(sentiment_score) AS mean, stddev_samp(sentiment_score) AS std FROM signals_v GROUP BY ticker"""), "mean std", "n"))
def sentiment_by_ticker(spark, folder):
    return profile.grouped_summary(signals(spark, folder), "ticker", "sentiment_score")


@query("extreme_scores", wrap(sql_with("signals_v", """
(SELECT text_id, sentiment_score, 'positive' AS side FROM signals_v ORDER BY sentiment_score DESC, text_id LIMIT 4)
UNION ALL (SELECT text_id, sentiment_score, 'negative' FROM signals_v ORDER BY sentiment_score, text_id LIMIT 4)"""), "sentiment_score"))
def extreme_scores(spark, folder):
    return sentiment.extremes(signals(spark, folder)).select("text_id", "sentiment_score", "side")


@query("majority_baseline", """SELECT doc_id, 'neutral' AS predicted, 0.0::DOUBLE AS predicted_score FROM labels""")
def majority_baseline(spark, folder):
    return sentiment.majority_baseline(table(spark, folder, "labels").select("doc_id"))


# ------------------------------------------------------------------ impact and emission

define("impacts", """SELECT *, greatest(1, least(10, 1 + 9 * (c1 + c2 + c3 + c4))) AS impact FROM (
  SELECT text_id, attribution_weight, is_broadcast, 0.45::DOUBLE * sev AS c1, 0.3::DOUBLE * abs(sentiment_score) AS c2, 0.15::DOUBLE * src AS c3, 0.1::DOUBLE * vol AS c4,
    sev, abs(sentiment_score) AS strength, src, vol FROM (SELECT *,
      CASE event_type WHEN 'Product Launch' THEN 0.35 WHEN 'Earnings' THEN 0.5 WHEN 'Merger/Acquisition' THEN 0.6 WHEN 'Credit Event' THEN 0.9 ELSE 0.15 END::DOUBLE AS sev,
      CASE source WHEN 'newsapi' THEN 0.9 WHEN 'gdelt' THEN 0.7 WHEN 'twitter_kaggle' THEN 0.4 ELSE 0.5 END::DOUBLE AS src,
      least(1, ln(1 + 1 + text_id % 20) / ln(11)) AS vol FROM signals_v))""", "signals_v")


def impact_rows(spark, folder):
    rows = signals(spark, folder).withColumn("dup_count", 1 + F.col("text_id") % 20)
    return impact.with_impact(rows.withColumn("volume_signal", impact.news_volume_signal(F.col("dup_count"))))


COMPONENTS = ["severity_contrib", "sentiment_contrib", "source_contrib", "volume_contrib", "raw_severity", "raw_sentiment_abs", "raw_source_weight", "raw_volume_signal"]


@query("impact_components", wrap(sql_with("impacts", """
SELECT text_id, round(impact, 4) AS impact_raw, round(c1, 4) AS severity_contrib, round(c2, 4) AS sentiment_contrib, round(c3, 4) AS source_contrib,
  round(c4, 4) AS volume_contrib, round(sev, 4) AS raw_severity, round(strength, 4) AS raw_sentiment_abs, round(src, 4) AS raw_source_weight,
  round(vol, 4) AS raw_volume_signal FROM impacts"""), "impact_raw " + " ".join(COMPONENTS)))
def impact_components(spark, folder):
    return impact_rows(spark, folder).select("text_id", "impact_raw", "impact_components.*")


@query("broadcast_impact", wrap(sql_with("impacts", """
SELECT text_id, round(CASE WHEN is_broadcast THEN 1 + (round(impact, 4) - 1) * attribution_weight ELSE round(impact, 4) END, 4) AS impact_score,
  round(CASE WHEN is_broadcast THEN round(c4, 4) * attribution_weight ELSE c4 END, 4) AS volume_contrib FROM impacts"""), "impact_score volume_contrib"))
def broadcast_impact(spark, folder):
    return impact.dampen_broadcast(impact_rows(spark, folder)).select("text_id", "impact_score", "impact_components.volume_contrib")


@query("template_drop_audit", wrap(sql_with("classified", """
SELECT source, count(*) AS n_dropped, count_if(is_calendar) AS n_calendar FROM classified WHERE is_relevant AND (is_template OR is_calendar) GROUP BY source"""),
    "", "n_dropped n_calendar"))
def template_drop_audit(spark, folder):
    return emission.dropped_by_source(classify_events(emission.eligible(link_entities(texts(spark, folder)))))


@query("target_routing", wrap(sql_with("routed", "SELECT text_id, ticker, attribution_weight, is_broadcast FROM routed"), "attribution_weight"))
def target_routing(spark, folder):
    classified = classify_events(emission.eligible(link_entities(texts(spark, folder))))
    return emission.route(classified.filter(~emission.is_dropped())).select("text_id", "ticker", "attribution_weight", "is_broadcast")


@query("signal_emission", wrap(sql_with("emitted", f"""
SELECT text_id, ticker, source, md5(substr(coalesce(title, text), 1, 200)) AS headline_md5, round(sentiment_score, 4) AS sentiment_score, event_type,
  round(impact_score, 4) AS impact_score, round(0.5 * sentiment_confidence + 0.5 * event_confidence, 4) AS confidence, event_confidence,
  secondary_event, round(attribution_weight, 4) AS attribution_weight, {TRIGGERS_SQL}, is_broadcast,
  is_analyst_action FROM emitted"""), "sentiment_score impact_score confidence event_confidence attribution_weight"))
def signal_emission(spark, folder):
    """Flagship: texts -> links -> events -> impact -> signals."""
    emitted = emission.emit_signals(link_entities(texts(spark, folder)))
    return emitted.select(
        "text_id", "ticker", "source", F.md5(F.col("headline").cast("binary")).alias("headline_md5"), "sentiment_score", "event_type", "impact_score",
        "confidence", "event_confidence", "secondary_event", "attribution_weight",
        triggers_md5(), "is_broadcast", "is_analyst_action",
    )
