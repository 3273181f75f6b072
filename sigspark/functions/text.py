"""Text column expressions. All but HTML unescaping stay inside the JVM."""

import html
import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark import fixed_values as fv
from sigspark.functions.numeric import let

# whitespace as Unicode sees it, plus the ASCII separators
SPACE = r"[\s\x1c-\x1f]"


def pattern(body: str, ignore_case: bool = True) -> str:
    """Unicode classes, Unicode case folding, and only ``\\n`` as line end."""
    return ("(?iUd)" if ignore_case else "(?Ud)") + body


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: Column, body: str, ignore_case: bool = True) -> Column:
    return F.rlike(text, F.lit(pattern(body, ignore_case)))


def first_match(text: Column, body: str, group: int = 0, ignore_case: bool = True) -> Column:
    """Text of the leftmost match, or null. The pattern must not match the empty string."""
    return F.nullif(F.regexp_extract(text, pattern(body, ignore_case), group), F.lit(""))


def remove(text: Column, body: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, pattern(body, ignore_case), "")


WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# letters that fold to ASCII under case-insensitive matching but not under lower()
FOLDED, FOLDED_TO = "\u017f\u0131\u0130\u212a", "siik"


def contains_any(text: Column, pieces: list[str]) -> Column:
    found = F.lit(False)
    for piece in pieces:
        found = found | F.contains(text, F.lit(piece))
    return found


def fold(text: Column) -> Column:
    """Lower case, such that any case-insensitive ASCII match is a literal match here."""
    return F.lower(F.when(contains_any(text, list(FOLDED)), F.translate(text, FOLDED, FOLDED_TO)).otherwise(text))


def vocabulary_hits(folded: Column, vocabulary: list[str]) -> Column:
    """Which of these words (ASCII letters and digits) occur as whole tokens: one pass over the text.

    Patterns with required words are only run where one of those words is among the hits,
    which is what keeps many patterns over long texts affordable.
    """
    literals = F.array(*[F.lit(word) for word in sorted(set(vocabulary))])
    return F.array_intersect(F.split(folded, "[^a-z0-9]+"), literals)


def key_word(term: str) -> str | None:
    """Longest ASCII run of a literal term: a token of every text the term occurs in."""
    runs = re.findall(r"[a-z0-9]+", term.lower())
    return max(runs, key=len) if runs else None


def any_word(hits: Column, vocabulary: list[str]) -> Column:
    return F.arrays_overlap(hits, F.array(*[F.lit(word) for word in vocabulary]))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    trimmed = trim(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, rf"(?U){SPACE}+")
    )


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def html_unescape(text: Column) -> Column:
    """Character references -> characters. Only texts holding ``&`` cross to Python."""

    @F.pandas_udf(T.StringType())
    def unescape(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return F.coalesce(unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def strip_retweet(text: Column) -> Column:
    return remove(text, fv.RETWEET_PATTERN)


def first_url(text: Column) -> Column:
    return first_match(text, fv.URL_PATTERN)


def strip_urls(text: Column) -> Column:
    return collapse(remove(text, fv.URL_PATTERN))


def canonical_ticker(symbol: Column, synonyms: dict[str, str] | None = None) -> Column:
    synonyms = fv.TICKER_SYNONYMS if synonyms is None else synonyms
    upper = F.upper(symbol)
    result = upper
    for alias, target in synonyms.items():
        result = F.when(upper == alias, F.lit(target)).otherwise(result)
    return result


def iso_utc(ts: Column) -> Column:
    """``2022-01-01T00:00:00[.123456]+00:00``; the session runs in UTC."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.when(F.unix_micros(ts) % 1000000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(F.lit(""))
    return F.concat(whole, micros, F.lit("+00:00"))


def text_id(source: Column, ts: Column | None, hint: Column | None, text: Column) -> Column:
    """First 16 hex digits of sha1 over ``source|ts|hint|text``."""
    blank = F.lit("")
    parts = [
        source,
        blank if ts is None else F.coalesce(iso_utc(ts), blank),
        blank if hint is None else F.coalesce(hint, blank),
        text,
    ]
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def fix_spacing(text: Column) -> Column:
    """Undo token spacing of news feeds: numbers, lower-case hyphen words, punctuation."""
    text = F.regexp_replace(text, r"(?U)(?<=\d)\s*,\s*(?=\d)", ",")
    text = F.regexp_replace(text, r"(?U)(?<=\d)\s*\.\s*(?=\d)", ".")
    text = F.regexp_replace(text, r"(?U)(?<=[a-zA-Z0-9])\s+-\s+(?=[a-z0-9])", "-")
    return F.regexp_replace(text, r"(?Ud)\s+([,.:;?!])(?=\s|$)", "$1")


def strip_publisher(text: Column) -> Column:
    """Drop trailing ``- Site`` / ``| Site`` parts until one looks like content.

    A part goes when it has 1-7 words, no finance word, and starts upper-case or holds a
    dot. The fold runs once per separator in the text and is skipped without separators.
    """
    suffix_pattern = pattern(fv.PUBLISHER_SUFFIX_PATTERN, ignore_case=False)

    def step(state: Column, _: Column) -> Column:
        current = state["text"]

        def shorter(suffix: Column) -> Column:
            strippable = (
                (suffix != "")
                & (F.size(F.split(suffix, rf"(?U){SPACE}+")) < 8)
                & ~matches(suffix, fv.FINANCE_WORDS_PATTERN)
                & (F.rlike(suffix, F.lit(r"^\p{Lu}")) | F.contains(suffix, F.lit(".")))
            )
            return F.when(strippable, trim(F.regexp_replace(current, suffix_pattern, "")))

        # the suffix and the shorter text are used several times, and each costs a search of the whole text
        stepped = let(
            let(trim(F.regexp_extract(current, suffix_pattern, 1)), shorter),
            lambda cut: F.struct(F.coalesce(cut, current).alias("text"), cut.isNull().alias("done")),
        )
        return F.when(state["done"], state).otherwise(stepped)

    trimmed = trim(text)
    separator = r"(?U)\s(?:–|—|-|\|)(?=\s)"
    folded = F.aggregate(
        F.sequence(F.lit(1), F.regexp_count(trimmed, F.lit(separator))),
        F.struct(trimmed.alias("text"), F.lit(False).alias("done")),
        step,
        lambda state: state["text"],
    )
    return F.when(F.rlike(trimmed, F.lit(separator)), folded).otherwise(trimmed)


def clean_for_model(text: Column, source: Column | None = None, max_words: int = 128) -> Column:
    """Model input: per-source cleaning, whitespace collapsed, at most ``max_words`` words."""
    raw = F.coalesce(text, F.lit(""))
    src = F.lower(F.coalesce(source, F.lit(""))) if source is not None else F.lit("")
    prepared = (
        F.when(src.isin(*fv.NEWS_SOURCES), fix_spacing(strip_publisher(raw)))
        .when(src.isin(*fv.TWEET_SOURCES), F.regexp_replace(raw, "(?U)" + fv.CASHTAG_PATTERN, " $1 "))
        .otherwise(fix_spacing(raw))
    )
    # the text is named once, since each naming would run all patterns again; a blank one is cut into one empty word
    tokens = F.split(trim(prepared), rf"(?U){SPACE}+", max_words + 1)
    return F.array_join(F.slice(tokens, 1, max_words), " ")


def title_and_description(title: Column, description: Column) -> Column:
    """``title. description`` with the truncation mark removed; the title alone without one."""
    head = trim(fix_spacing(F.coalesce(title, F.lit(""))))
    tail = fix_spacing(trim(remove(F.coalesce(description, F.lit("")), fv.TRUNCATION_PATTERN)))
    return F.when(tail != "", F.concat(head, F.lit(". "), tail)).otherwise(head)


def author_or_domain(name: Column, url: Column) -> Column:
    named = F.nullif(trim(name), F.lit(""))
    return F.coalesce(named, F.when(url.isNotNull(), F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))))


def utc_timestamp(value: Column, fmt: str | None = None) -> Column:
    """Parse to a UTC timestamp; unparsable text becomes null."""
    return F.try_to_timestamp(value, F.lit(fmt)) if fmt else F.try_to_timestamp(value)


def headline_timestamp(value: Column) -> Column:
    return utc_timestamp(value, "yyyyMMdd'T'HHmmss'Z'")


def normalized_title(title: Column) -> Column:
    """Lower case, ASCII punctuation removed, whitespace collapsed."""
    return collapse(F.translate(F.lower(title), string.punctuation, ""))


def headline(title: Column, text: Column) -> Column:
    return F.substring(F.coalesce(F.nullif(title, F.lit("")), trim(text)), 1, 200)


def cashtags(text: Column) -> Column:
    """Upper-case ``$TAG`` symbols in text order, duplicates kept."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + fv.CASHTAG_PATTERN), F.lit(1))
    return F.when(F.contains(text, F.lit("$")), F.transform(found, lambda tag: F.upper(tag))).otherwise(
        F.array().cast("array<string>")
    )


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_key(date: Column) -> Column:
    """Monday of the week; identifies a Monday-to-Sunday period."""
    return F.to_date(F.date_trunc("week", date))
