"""SQL counterparts of linking, classification and emission, written out from the same
fixed values (RE2 dialect: no look-around, which the patterns used here do not need)."""

from __future__ import annotations

import re

from sigspark import fixed_values as fv
from sigspark.checks.views import define
from sigspark.config import Dictionary, EventRules


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(quoted(value) for value in values) + "]"


def found(body: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {quoted(body)}, 'i')"


def extract(body: str, column: str = "text") -> str:
    return f"nullif(regexp_extract({column}, {quoted(body)}, 0, 'i'), '')"


def words(terms) -> str:
    return "|".join(rf"\b{re.escape(term)}\b" for term in terms)


def canonical(column: str) -> str:
    cases = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in fv.TICKER_SYNONYMS.items())
    return f"CASE upper({column}) {cases} ELSE upper({column}) END"


TAG = r"\$([A-Za-z]{1,5}(?:\.[A-Za-z]{1,2})?)\b"


def linking_sql(source: str) -> None:
    """Defines ``linked``: the texts of ``source`` with all link columns."""
    dictionary = Dictionary.default()
    companies = [c for c in dictionary.companies if fv.TICKER_SYNONYMS.get(c.ticker, c.ticker) != "MARKET"]
    define("tagged", f"""SELECT *, list_filter(list_transform(regexp_extract_all(text, {quoted(TAG)}, 1), lambda t: upper(t)),
    lambda t: NOT list_contains({strings(fv.CURRENCY_CODES)}, t)) AS symbols,
  CASE WHEN len(ticker_hints) > 0 THEN list_transform(ticker_hints, lambda h: {canonical('h')})
    WHEN ticker_hint IS NOT NULL THEN [{canonical('ticker_hint')}] ELSE []::VARCHAR[] END AS hints
FROM {source}""", source)
    universe = strings(dictionary.universe)
    known = f"(list_contains({universe}, {canonical('t')}) OR list_contains({universe}, t))"
    columns = []
    for i, c in enumerate(companies):
        columns.append(f"{extract(words(c.products + c.executives))} AS p{i}")
        columns.append(f"{extract(words(c.aliases))} AS a{i}")
        bare = "false" if c.ticker in fv.WORDLIKE_SYMBOLS else f"regexp_matches(text, {quoted(words([c.ticker]))})"
        columns.append(f"{bare} AS b{i}")
    define("raw_evidence", f"""SELECT *, {', '.join(columns)}, {extract('|'.join(fv.MACRO_PATTERNS))} AS macro FROM (
  SELECT *, list_transform(list_filter(symbols, lambda t: {known}), lambda t: {canonical('t')}) AS tags,
    list_filter(symbols, lambda t: NOT {known}) AS unknown FROM tagged)""", "tagged")
    entries = []
    for i, c in enumerate(companies):
        tag = f"len(list_filter(tags, lambda t: t = {quoted(c.ticker)}))"
        alias = f"a{i}"
        if c.is_ambiguous:
            support = [f"{tag} > 0", f"p{i} IS NOT NULL", rf"regexp_matches(a{i}, '\S\s+\S|\.')", found(words(c.context_words))]
            alias = f"(CASE WHEN a{i} IS NOT NULL AND ({' OR '.join(support)}) THEN a{i} END)"
        first = lambda hit, body, flags: f"CASE WHEN {hit} THEN length(regexp_extract(text, {quoted(f'(?{flags})^(.*?)(?:{body})')}, 1)) ELSE 999999999 END"
        position = ", ".join([
            f"CASE WHEN {tag} > 0 THEN greatest(0, instr(upper(text), {quoted('$' + c.ticker)}) - 1) ELSE 999999999 END",
            first(f"p{i} IS NOT NULL", words(c.products + c.executives), "is"),
            first(f"{alias} IS NOT NULL", words(c.aliases), "is"),
            first(f"b{i}", words([c.ticker]), "s"),
        ])
        entries.append(f"""{{'ticker': {quoted(c.ticker)},
  'kind': CASE WHEN {tag} > 0 THEN 'cashtag' WHEN {alias} IS NOT NULL THEN 'company_name' WHEN p{i} IS NOT NULL THEN 'product_or_exec' ELSE 'ticker_symbol' END,
  'confidence': CASE WHEN {tag} > 0 THEN 0.95 WHEN {alias} IS NOT NULL THEN 0.85 WHEN p{i} IS NOT NULL THEN 0.75 ELSE 0.6 END::DOUBLE,
  'term': CASE WHEN {tag} > 0 THEN {quoted('$' + c.ticker)} WHEN {alias} IS NOT NULL THEN {alias} WHEN p{i} IS NOT NULL THEN p{i} ELSE {quoted(c.ticker)} END,
  'mentions': {tag} + (p{i} IS NOT NULL)::INT + ({alias} IS NOT NULL)::INT + b{i}::INT,
  'position': least({position}),
  'ordinal': CASE WHEN {tag} > 0 THEN list_position(tags, {quoted(c.ticker)}) ELSE {1_000_000 + i} END}}""")
    define("evidence", f"""SELECT *, list_filter([{', '.join(entries)}], lambda e: e.mentions > 0) AS found,
  CASE WHEN list_contains(tags, 'MARKET') THEN {{'kind': 'cashtag', 'confidence': 0.95::DOUBLE, 'term': '$MARKET'}}
    WHEN macro IS NOT NULL THEN {{'kind': 'company_name', 'confidence': 0.85::DOUBLE, 'term': macro}} END AS market
FROM raw_evidence""", "raw_evidence")
    define("decided", """SELECT *, CASE WHEN n >= 3 THEN NULL
    WHEN n = 2 THEN CASE WHEN len(hinted) > 0 THEN list_min(hinted)
      WHEN found[1].mentions <> found[2].mentions THEN CASE WHEN found[1].mentions > found[2].mentions THEN names[1] ELSE names[2] END
      WHEN found[1].position <> found[2].position THEN CASE WHEN found[1].position < found[2].position THEN names[1] ELSE names[2] END
      WHEN found[1].ordinal < found[2].ordinal THEN names[1] ELSE names[2] END
    WHEN n = 1 THEN names[1] WHEN market IS NOT NULL THEN 'MARKET'
    WHEN source = 'twitter_kaggle' AND len(hints) > 0 THEN list_min(hints) END AS primary_ticker
FROM (SELECT *, list_filter(names, lambda t: list_contains(hints, t)) AS hinted FROM (
  SELECT *, len(found) AS n, list_transform(found, lambda e: e.ticker) AS names FROM evidence))""", "evidence")
    define("linked", """SELECT * EXCLUDE (hints, symbols, tags, unknown, found, market, n, names, hinted, ticker_hint),
  CASE WHEN hint_only THEN [list_min(hints)] WHEN primary_ticker IS NOT NULL
    THEN list_concat([primary_ticker], list_filter(everything, lambda t: t <> primary_ticker)) ELSE everything END AS linked_tickers,
  CASE WHEN n >= 3 THEN CASE WHEN len(list_filter(found, lambda e: e.kind = 'cashtag')) > 0 THEN 'cashtag' ELSE 'company_name' END
    WHEN n > 0 THEN chosen.kind WHEN market IS NOT NULL THEN market.kind WHEN hint_only THEN 'hint_only' END AS link_type,
  CASE WHEN n >= 3 THEN list_max(list_transform(found, lambda e: e.confidence)) WHEN n > 0 THEN chosen.confidence
    WHEN market IS NOT NULL THEN market.confidence WHEN hint_only THEN 0.4 END::DOUBLE AS link_confidence,
  CASE WHEN hint_only THEN 1 ELSE n END AS n_linked_tickers, n >= 3 AS is_broadcast,
  CASE WHEN n > 0 OR market IS NOT NULL THEN list_sort(list_distinct(unknown)) ELSE unknown END AS other_cashtags,
  CASE WHEN n > 0 THEN round(1.0::DOUBLE / n, 4) WHEN market IS NOT NULL OR hint_only THEN 1 ELSE 0 END::DOUBLE AS attribution_weight,
  n > 0 OR market IS NOT NULL OR hint_only AS is_relevant,
  CASE WHEN n >= 3 THEN 'broadcast' WHEN n > 0 THEN chosen.term WHEN market IS NOT NULL THEN market.term WHEN hint_only THEN 'hint' END AS matched_term,
  coalesce(list_min(list_filter(hints, lambda h: list_contains(everything, h))), list_min(hints), ticker_hint) AS ticker_hint
FROM (SELECT *, n = 0 AND market IS NULL AND source = 'twitter_kaggle' AND len(hints) > 0 AS hint_only,
  list_filter(found, lambda e: e.ticker = primary_ticker)[1] AS chosen,
  list_sort(list_concat(names, CASE WHEN market IS NOT NULL THEN ['MARKET'] ELSE []::VARCHAR[] END)) AS everything FROM decided)""", "decided")


def classification_sql(source: str) -> None:
    """Defines ``hits`` and ``classified`` over ``source``."""
    rules = EventRules()
    columns, measures, candidates = [], [], []
    for event, triggers in rules.triggers.items():
        rank = rules.rank(event)
        names = [f"r{rank}_{i}" for i in range(len(triggers))]
        columns += [f"{extract(body)} AS {name}" for name, (body, _) in zip(names, triggers)]
        count = " + ".join(f"({name} IS NOT NULL)::INT" for name in names)
        best = ", ".join(f"CASE WHEN {name} IS NOT NULL THEN {weight}::DOUBLE END" for name, (_, weight) in zip(names, triggers))
        measures += [f"{count} AS n{rank}", f"greatest({best}) AS w{rank}",
                     f"list_filter([{', '.join(names)}], lambda x: x IS NOT NULL) AS t{rank}"]
        allowed = f"n{rank} > 0"
        if event == "Credit Event":
            allowed += (f" AND NOT {found(fv.CREDIT_SPECULATION_PATTERN)} AND NOT ({found(fv.CREDIT_SWAP_PATTERN)} AND NOT "
                        f"{found(fv.CREDIT_SWAP_CONTEXT_PATTERN)}) AND ({found(fv.CREDIT_AGENCY_PATTERN)} OR {found(fv.CREDIT_FILING_PATTERN)})")
        if event == "Geopolitical":
            allowed += f" AND NOT {found(fv.GEO_EXCLUSION_PATTERN)}"
        score = f"least(1.0::DOUBLE, w{rank} + CASE WHEN n{rank} > 1 THEN least(0.1::DOUBLE, 0.05::DOUBLE * (n{rank} - 1)) ELSE 0 END)"
        candidates.append(f"""CASE WHEN {allowed} THEN {{'loss': -{score}, 'rank': {rank}, 'event': {quoted(event)},
  'terms': list_sort(list_distinct(t{rank}))}} END""")
    define("hits", f"SELECT *, {', '.join(columns)} FROM {source}", source)
    define("ranked", f"""SELECT *, list_sort(list_filter([{', '.join(candidates)}], lambda c: c IS NOT NULL)) AS c
FROM (SELECT *, {', '.join(measures)} FROM hits)""", "hits")
    tweet, geo = "source = 'twitter_kaggle'", "coalesce(c[1].event = 'Geopolitical', false)"
    define("classified", f"""SELECT * EXCLUDE (c, rejected, is_spam, score, analyst, {', '.join(f'n{k}, w{k}, t{k}' for k in range(7))}),
  CASE WHEN c[1] IS NULL OR rejected THEN 'Other' ELSE c[1].event END AS event_type,
  CASE WHEN c[1] IS NULL THEN 0.2 WHEN {tweet} AND {found(fv.HYPOTHETICAL_PATTERN)} AND NOT {found(fv.CREDIT_AGENCY_PATTERN)}
    THEN least(score, 0.6) ELSE score END::DOUBLE AS event_confidence,
  CASE WHEN c[1] IS NULL OR rejected THEN []::VARCHAR[] WHEN analyst THEN list_concat(c[1].terms, ['analyst_action']) ELSE c[1].terms END AS matched_triggers,
  c[2].event AS secondary_event, is_spam OR is_calendar AS is_template, analyst AS is_analyst_action
FROM (SELECT *, CASE WHEN rejected THEN 0.2 WHEN {geo} AND {tweet} AND NOT {found(fv.GEO_ACTOR_PATTERN)} THEN least(-c[1].loss, 0.6)
    ELSE -c[1].loss END::DOUBLE AS score FROM (
  SELECT *, {found(fv.TEMPLATE_PATTERN)} AS is_spam,
    {found(fv.CALENDAR_PATTERN)} OR len(regexp_extract_all(text, '\\$[A-Za-z]+')) >= 5 AS is_calendar,
    coalesce(c[1].event = 'Earnings', false) AND {found(fv.ANALYST_ACTION_PATTERN)} AS analyst,
    {geo} AND {tweet} AND (NOT {found(fv.GEO_EVENT_PATTERN)} OR ({found(fv.STOCK_OPINION_PATTERN)} AND NOT {found(fv.GEO_ACTOR_PATTERN)})) AS rejected
  FROM ranked))""", "ranked")


def emission_sql() -> None:
    """Defines ``emitted`` from ``linked`` and classified rows (``classified`` over ``linked``)."""
    define("tweet_days", """SELECT ticker_hint AS ticker, CAST(ts AS DATE) AS date, count(*) AS volume FROM linked
WHERE is_relevant AND source = 'twitter_kaggle' AND ticker_hint IS NOT NULL GROUP BY ALL""", "linked")
    define("day_signals", """SELECT q.ticker, q.date, CASE WHEN n < 7 THEN 0.5 WHEN s IS NULL OR s = 0 THEN
    CASE WHEN v > m THEN 1 WHEN v < m THEN 0 ELSE 0.5 END ELSE 1 / (1 + exp(-(v - m) / s)) END::DOUBLE AS volume_signal
FROM (SELECT q.*, coalesce(d.volume, 0) AS v FROM (
  SELECT ticker, CAST(date + to_days(k) AS DATE) AS date, avg(volume) AS m, stddev_samp(volume) AS s, count(*) AS n
  FROM tweet_days, (SELECT CAST(range AS INTEGER) AS k FROM range(1, 31)) GROUP BY 1, 2) q
  LEFT JOIN tweet_days d ON q.ticker = d.ticker AND q.date = d.date) q""", "tweet_days")
    severity = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in fv.SEVERITY.items())
    sources = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in fv.SOURCE_WEIGHTS.items())
    define("routed", """SELECT * EXCLUDE (target, attribution_weight, is_broadcast), target.t AS ticker, target.w AS attribution_weight, target.b AS is_broadcast
FROM (SELECT *, unnest(CASE
    WHEN is_broadcast OR len(companies) >= 3 THEN CASE WHEN event_type <> 'Other' AND event_confidence >= 0.8::DOUBLE THEN
      list_transform(companies, lambda t: {'t': t, 'w': 1.0::DOUBLE / len(companies), 'b': true}) END
    WHEN primary_ticker = 'MARKET' OR ticker_hint = 'MARKET' THEN [{'t': 'MARKET', 'w': 1.0::DOUBLE, 'b': false}]
    WHEN len(companies) > 0 THEN [{'t': CASE WHEN list_contains(companies, primary_ticker) THEN primary_ticker ELSE companies[1] END, 'w': 1.0::DOUBLE, 'b': false}]
    WHEN primary_ticker IS NULL AND ticker_hint IS NULL THEN [{'t': 'MARKET', 'w': 1.0::DOUBLE, 'b': false}] END) AS target
  FROM (SELECT *, list_filter(linked_tickers, lambda t: t <> 'MARKET') AS companies FROM classified
        WHERE is_relevant AND NOT is_template))""", "classified")
    define("emitted", f"""SELECT *, CASE WHEN is_broadcast AND attribution_weight < 1 THEN 1 + (raw - 1) * attribution_weight ELSE raw END AS impact_score
FROM (SELECT *, round(greatest(1, least(10, 1 + 9 * (0.45::DOUBLE * sev + 0.3::DOUBLE * abs(sentiment_score) + 0.15::DOUBLE * src + 0.1::DOUBLE * vol))), 4) AS raw
  FROM (SELECT r.*, CASE event_type {severity} END::DOUBLE AS sev, CASE source {sources} END::DOUBLE AS src,
    CASE WHEN source = 'twitter_kaggle' THEN coalesce(s.volume_signal, 0.5) ELSE least(1, ln(1 + dup_count) / ln(11)) END::DOUBLE AS vol
    FROM routed r LEFT JOIN day_signals s ON r.ticker = s.ticker AND CAST(r.ts AS DATE) = s.date))""", "routed", "day_signals")


linking_sql("texts_v")
classification_sql("linked")
emission_sql()


# look-arounds become captures; twice, since a captured neighbour belongs to the next match as well
SPACING = [
    (r"(\d)(?:\s+,\s*|\s*,\s+)(\d)", r"\1,\2"), (r"(\d)(?:\s+\.\s*|\s*\.\s+)(\d)", r"\1.\2"), (r"([a-zA-Z0-9])\s+-\s+([a-z0-9])", r"\1-\2"), (r"\s+([,.:;?!])(\s|$)", r"\1\2"),
]


def spacing_sql(column: str) -> str:
    for pattern, to in SPACING:
        for _ in range(2):
            column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column
