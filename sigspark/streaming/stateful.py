"""Stateful stream operators: trailing volume, smoothed scores, capped weights.

State is kept per ticker (a window of daily counts, or one score) or per portfolio (one
weight per universe ticker): small and bounded, whatever the volume of the stream.

Days may come in any order and in any micro-batch. A day waits in the state until the watermark
says that no earlier one can come; then it is taken, in order. So only what the watermark has
declared late is left out, and the last ``delay`` of a stream comes out once a later row (of any
key, a heartbeat for example) has moved the watermark on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigspark.config import ImpactParams, PortfolioParams

VOLUME_OUTPUT = "ticker string, date date, volume long, mean_volume double, std_volume double, n_days long"
VOLUME_STATE = "days array<int>, counts array<long>, waiting_days array<int>, waiting_counts array<long>"
DAY_MS = 86_400_000


def wait_for_watermark(state: GroupState, waiting: list[int]) -> tuple[list[int], list[int]]:
    """Places of the waiting days to take now, in order of days, and of those that go on waiting; asks to be woken for these."""
    watermark = state.getCurrentWatermarkMs()
    order = sorted(range(len(waiting)), key=lambda i: waiting[i])
    ready = [i for i in order if waiting[i] * DAY_MS <= watermark]
    later = order[len(ready) :]
    if later:
        state.setTimeoutTimestamp(max(waiting[later[0]] * DAY_MS - 1, watermark + 1))
    return ready, later


def day_number(value) -> int:
    return (pd.Timestamp(value) - pd.Timestamp("1970-01-01")).days


def trailing_volume_stream(daily: DataFrame, params: ImpactParams | None = None, delay: str = "7 days") -> DataFrame:
    """Trailing mean, std and observed days per (ticker, day) that the watermark has passed.

    Needs complete daily counts (ticker, day_start, volume; one row per ticker and day). A null
    volume is a heartbeat: it moves the watermark and gives no row.
    """
    span = (params or ImpactParams()).trailing_days

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, counts, waiting, waiting_counts = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        for frame in frames:
            known = frame[frame["volume"].notna()]
            waiting += [day_number(d) for d in known["day_start"]]
            waiting_counts += [int(v) for v in known["volume"]]
        ready, later = wait_for_watermark(state, waiting)
        out = []
        for i in ready:
            day, volume = waiting[i], waiting_counts[i]
            kept = [(d, c) for d, c in zip(days, counts) if d >= day - span]
            days, counts = [d for d, _ in kept], [c for _, c in kept]
            values = np.array(counts, dtype=float)
            mean = float(values.mean()) if len(values) else None
            std = float(values.std(ddof=1)) if len(values) > 1 else None
            out.append((key[0], (pd.Timestamp("1970-01-01") + pd.Timedelta(days=day)).date(), volume, mean, std, len(values)))
            days.append(day)
            counts.append(volume)
        state.update((days, counts, [waiting[i] for i in later], [waiting_counts[i] for i in later]))
        yield pd.DataFrame(out, columns=["ticker", "date", "volume", "mean_volume", "std_volume", "n_days"])

    timed = daily.withWatermark("day_start", delay)
    return timed.groupBy("ticker").applyInPandasWithState(update, VOLUME_OUTPUT, VOLUME_STATE, "append", GroupStateTimeout.EventTimeTimeout)


WEIGHT_OUTPUT = "portfolio string, t0 date, ticker string, score double, weight double, turnover double"
WEIGHT_STATE = "scores array<double>, weights array<double>, waiting array<int>, waiting_scores array<double>"


def fill_to_one(weights: np.ndarray, low: float, high: float) -> np.ndarray:
    """Weights within [low, high] that add up to 1: after clipping, all that have room move by one common amount.

    The amount is found directly: with the rooms in ascending order, the smallest k of them are used up whole and
    the others share what then is missing.
    """
    inside = np.minimum(np.maximum(weights, low), high)
    missing = 1.0 - inside.sum()
    room = high - inside if missing > 0 else inside - low
    ordered = np.sort(room)
    used = np.concatenate(([0.0], np.cumsum(ordered)))[:-1]
    shares = (abs(missing) - used) / np.arange(len(room), 0, -1)
    enough = np.flatnonzero(shares <= ordered)
    amount = shares[enough[0]] if len(enough) else ordered[-1]
    return inside + np.sign(missing) * np.minimum(room, amount)


def rebalance_stream(daily_scores: DataFrame, params: PortfolioParams | None = None, delay: str = "7 days") -> DataFrame:
    """One rebalance per portfolio and day, with smoothed scores and weights carried as state.

    Input: (portfolio, t0 timestamp, scores array<double>) with one raw score per universe
    ticker, in universe order; null scores are a heartbeat. The same weights as the batch path.
    """
    params = params or PortfolioParams()
    universe, base = list(params.universe), params.base_weight
    low, high, alpha, k, cap = params.min_weight, params.max_weight, params.alpha, params.k, params.max_turnover
    size = len(universe)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            scores, weights, waiting, flat = (list(x) for x in state.get)
        else:
            scores, weights, waiting, flat = [0.0] * size, [base] * size, [], []
        scores, weights = np.array(scores), np.array(weights)
        for frame in frames:
            for day, raw in zip(frame["t0"], frame["scores"]):
                if raw is not None:
                    waiting.append(day_number(day))
                    flat += [float(x) for x in raw]
        ready, later = wait_for_watermark(state, waiting)
        rows = np.array(flat).reshape(-1, size)
        out = []
        for i in ready:
            scores = scores + alpha * (rows[i] - scores)
            lifted = np.exp(k * scores)
            change = fill_to_one(lifted / lifted.sum(), low, high) - weights
            needed = float(np.abs(change).sum()) / 2
            weights = weights + change * (cap / needed if needed > max(cap, 1e-9) else 1.0)
            weights = weights / weights.sum()
            day = (pd.Timestamp("1970-01-01") + pd.Timedelta(days=waiting[i])).date()
            out += [(key[0], day, t, float(s), float(w), min(needed, cap)) for t, s, w in zip(universe, scores, weights)]
        left = rows[later].ravel().tolist() if later else []
        state.update((scores.tolist(), weights.tolist(), [waiting[i] for i in later], left))
        yield pd.DataFrame(out, columns=["portfolio", "t0", "ticker", "score", "weight", "turnover"])

    timed = daily_scores.withWatermark("t0", delay)
    return timed.groupBy("portfolio").applyInPandasWithState(update, WEIGHT_OUTPUT, WEIGHT_STATE, "append", GroupStateTimeout.EventTimeTimeout)
