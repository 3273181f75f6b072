"""Parameters of the operators, and the company dictionary as data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sigspark import fixed_values as fv


@dataclass(frozen=True)
class Company:
    ticker: str
    legal_name: str = ""
    aliases: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    executives: tuple[str, ...] = ()
    context_words: tuple[str, ...] = ()
    is_ambiguous: bool = False
    ticker_ambiguous: bool = False


@dataclass(frozen=True)
class Dictionary:
    """Companies to link texts to, in priority order."""

    companies: tuple[Company, ...]
    synonyms: dict[str, str] = field(default_factory=lambda: dict(fv.TICKER_SYNONYMS))
    wordlike_symbols: tuple[str, ...] = tuple(fv.WORDLIKE_SYMBOLS)
    currency_codes: tuple[str, ...] = tuple(fv.CURRENCY_CODES)
    macro_patterns: tuple[str, ...] = tuple(fv.MACRO_PATTERNS)

    @property
    def universe(self) -> list[str]:
        names = []
        for company in self.companies:
            for symbol in (self.synonyms.get(company.ticker, company.ticker), company.ticker):
                if symbol not in names:
                    names.append(symbol)
        return names

    @staticmethod
    def default() -> Dictionary:
        return Dictionary.from_mapping(fv.COMPANIES)

    @staticmethod
    def from_mapping(companies: dict) -> Dictionary:
        names = ("aliases", "products", "executives", "context_words")
        return Dictionary(
            tuple(
                Company(
                    ticker=ticker,
                    legal_name=entry.get("legal_name", ""),
                    is_ambiguous=bool(entry.get("is_ambiguous", False)),
                    ticker_ambiguous=bool(entry.get("ticker_ambiguous", False)),
                    **{name: tuple(entry.get(name) or ()) for name in names},
                )
                for ticker, entry in companies.items()
            )
        )

    @staticmethod
    def from_file(path: str) -> Dictionary:
        """Read a ``companies:`` mapping from JSON, or from YAML where PyYAML is installed."""
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            return Dictionary.from_mapping(json.loads(text)["companies"])
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs PyYAML; use a .json file instead") from error
        return Dictionary.from_mapping(yaml.safe_load(text)["companies"])

    def term_rows(self) -> list[tuple[str, str, str, bool]]:
        rows = []
        for company in self.companies:
            for kind, terms in (
                ("alias", company.aliases),
                ("product", company.products),
                ("executive", company.executives),
                ("context", company.context_words),
            ):
                rows.extend((company.ticker, kind, term, company.is_ambiguous) for term in terms)
        return rows

    def terms(self, spark: SparkSession) -> DataFrame:
        """Dimension table: one row per (ticker, kind, term)."""
        return spark.createDataFrame(
            self.term_rows(), "ticker string, kind string, term string, is_ambiguous boolean"
        )

    def query_names(self) -> dict[str, str]:
        """File-safe query name -> ticker, for article files named after their query."""
        names: dict[str, str] = {}
        for company in self.companies:
            for label in (company.ticker, *company.aliases[:1], company.legal_name, *company.aliases):
                if label:
                    names[file_safe(label)] = company.ticker
        return names


def file_safe(label: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "_-." else "_" for ch in label)


@dataclass(frozen=True)
class EventRules:
    """Weighted patterns per event class; earlier precedence wins ties."""

    triggers: dict[str, list[tuple[str, float]]] = field(
        default_factory=lambda: {k: list(v) for k, v in fv.EVENT_TRIGGERS.items()}
    )
    precedence: tuple[str, ...] = tuple(fv.EVENT_PRECEDENCE)

    def rank(self, event: str) -> int:
        return self.precedence.index(event) if event in self.precedence else 99

    def rows(self) -> list[tuple[str, int, str, float]]:
        return [
            (event, number, pattern, float(weight))
            for event, rules in self.triggers.items()
            for number, (pattern, weight) in enumerate(rules)
        ]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.rows(), "event_type string, rule int, pattern string, weight double"
        )


@dataclass(frozen=True)
class ImpactParams:
    weights: dict[str, float] = field(default_factory=lambda: dict(fv.IMPACT_WEIGHTS))
    severity: dict[str, float] = field(default_factory=lambda: dict(fv.SEVERITY))
    source_weights: dict[str, float] = field(default_factory=lambda: dict(fv.SOURCE_WEIGHTS))
    trailing_days: int = fv.VOLUME_TRAILING_DAYS
    min_days: int = fv.VOLUME_MIN_DAYS
    fallback: float = fv.VOLUME_FALLBACK
    dup_base: float = fv.NEWS_DUP_BASE

    def __post_init__(self) -> None:
        total = sum(self.weights.values())
        if abs(total - 1.0) > 1e-5:
            raise ValueError(f"the four parts of an impact score need weights that make up 1, these make up {total:.6f}")


@dataclass(frozen=True)
class PortfolioParams:
    universe: tuple[str, ...] = tuple(fv.INDEX_UNIVERSE)
    k: float = fv.PORTFOLIO["k"]
    half_life_days: float = fv.PORTFOLIO["half_life_days"]
    deadband: float = fv.PORTFOLIO["deadband"]
    neg_multiplier: float = fv.PORTFOLIO["neg_multiplier"]
    min_weight_mult: float = fv.PORTFOLIO["min_weight_mult"]
    max_weight_mult: float = fv.PORTFOLIO["max_weight_mult"]
    max_turnover: float = fv.PORTFOLIO["max_turnover"]
    hold_threshold_bps: float = fv.PORTFOLIO["hold_threshold_bps"]
    sources: tuple[str, ...] = ("twitter_kaggle",)

    def __post_init__(self) -> None:
        if not self.universe:
            raise ValueError("a portfolio needs one ticker at least")
        if self.min_weight_mult > 1.0 or self.max_weight_mult < 1.0:
            raise ValueError("min_weight_mult above 1 or max_weight_mult below 1 leaves no weights that add up to 1")

    @property
    def base_weight(self) -> float:
        return 1.0 / len(self.universe)

    @property
    def min_weight(self) -> float:
        return self.min_weight_mult * self.base_weight

    @property
    def max_weight(self) -> float:
        return self.max_weight_mult * self.base_weight

    @property
    def alpha(self) -> float:
        return 1.0 - 2.0 ** (-1.0 / self.half_life_days)

    def with_(self, **changes) -> PortfolioParams:
        return replace(self, **changes)
