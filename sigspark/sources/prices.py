"""Price tables: reshape, standardize, consolidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.schemas import PRICE_COLUMNS

# accepted spellings of each column
VARIANTS = {
    "date": ["date", "datetime"],
    "open": ["open"],
    "high": ["high"],
    "low": ["low"],
    "close": ["close"],
    "adj_close": ["adj close", "adjclose", "adjusted_close", "adj_close"],
    "volume": ["volume"],
}
FIELDS = ["Open", "High", "Low", "Close", "Adj Close", "Volume"]


def wide_to_long(wide: DataFrame, date: str = "Date", separator: str = "|") -> DataFrame:
    """Columns named ``Field|TICKER`` or ``TICKER|Field`` -> one row per date and ticker.

    Each row is expanded in place into its tickers: no shuffle.
    """
    by_ticker: dict[str, dict[str, str]] = {}
    for name in wide.columns:
        if name == date or separator not in name:
            continue
        left, right = name.split(separator, 1)
        field, ticker = (left, right) if left in FIELDS else (right, left)
        by_ticker.setdefault(ticker, {})[field] = name
    entries = F.array(
        *[
            F.struct(
                F.lit(ticker).alias("ticker"),
                *[
                    (F.col(f"`{columns[field]}`").cast("double") if field in columns else F.lit(None).cast("double")).alias(field)
                    for field in FIELDS
                ],
            )
            for ticker, columns in by_ticker.items()
        ]
    )
    return wide.select(F.col(f"`{date}`").alias("Date"), F.explode(entries).alias("_e")).select("Date", "_e.*")


def standardize_prices(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """Column spellings, numeric coercion, adj_close := close if missing; rows without date or close go."""
    present = {name.strip().lower(): name for name in raw.columns}
    columns = {}
    for target, spellings in VARIANTS.items():
        found = [F.col(f"`{present[spelling]}`") for spelling in spellings if spelling in present]
        columns[target] = F.coalesce(*found) if found else None
    numeric = {
        name: column.cast("string").try_cast("double") if column is not None else F.lit(None).cast("double")
        for name, column in columns.items()
        if name != "date"
    }
    if columns["adj_close"] is None:
        numeric["adj_close"] = numeric["close"]
    symbol = F.col(f"`{present['ticker']}`") if "ticker" in present else F.lit(ticker or "UNKNOWN")
    day = columns["date"].cast("string").try_cast("timestamp").cast("date") if columns["date"] is not None else F.lit(None).cast("date")
    tidy = raw.select(day.alias("date"), F.upper(symbol).alias("ticker"), *[numeric[name].alias(name) for name in PRICE_COLUMNS[2:]])
    return tidy.dropna(subset=["date", "close"])


SERIES_SCHEMA = "map<string, map<string, string>>"


def from_daily_map(payloads: DataFrame, start: str, ticker: str = "ticker", payload: str = "payload") -> DataFrame:
    """JSON ``{"date": {"1. open": ...}}`` -> price rows from ``start`` on."""
    series = F.from_json(payload, SERIES_SCHEMA)
    rows = payloads.select(F.upper(ticker).alias("ticker"), F.explode(series).alias("day", "v")).filter(F.col("day") >= start)
    number = lambda name: F.col("v").getItem(name).try_cast("double")
    return rows.select(
        F.to_date("day").alias("date"), "ticker", number("1. open").alias("open"), number("2. high").alias("high"),
        number("3. low").alias("low"), number("4. close").alias("close"), number("4. close").alias("adj_close"),
        F.coalesce(number("5. volume"), F.lit(0.0)).alias("volume"),
    )


def prefer(primary: DataFrame, fallback: DataFrame, key: str = "ticker") -> DataFrame:
    """All primary rows, and fallback rows of keys the primary source does not have."""
    known = primary.select(key).distinct()
    return primary.unionByName(fallback.join(known, key, "left_anti"))
