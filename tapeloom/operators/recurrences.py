"""True recurrences: one step function for each, run over a symbol's bars in batch or on a stream.

A step function takes the state so far (None at first) and a row, and returns the new state and
the values to emit. In batch ``run`` applies it along partitions sorted by symbol and time. ``tapeloom.streaming.stateful`` runs the same functions with kept state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tapeloom.operators import grouped


@dataclass(frozen=True)
class Recurrence:
    inputs: Sequence[str]
    outputs: Sequence[str]  # all double
    step: Callable[[object, tuple], tuple[object, tuple]]


def run(bars: DataFrame, r: Recurrence, symbol: str = "symbol", time: str = "datetime") -> DataFrame:
    """(symbol, datetime, outputs) in batch."""
    return grouped.stepped(bars, symbol, time, r.inputs, r.outputs, r.step)


def ema(n: int, column: str = "close") -> Recurrence:
    """Exponential mean with weights that sum to one from the first row on."""
    keep = 1 - 2 / (n + 1)

    def step(state, row):
        top, bottom = state or (0.0, 0.0)
        state = (keep * top + row[0], keep * bottom + 1.0)
        return state, (state[0] / state[1],)

    return Recurrence([column], ["ema"], step)


def kalman(q: float = 1e-4, r: float = 1e-4, p: float = 1e6, x: str = "open", y: str = "close") -> Recurrence:
    """Slope, intercept and residual of y = slope x + intercept, both random walks; q is added to every covariance."""

    def step(state, row):
        (slope, intercept), (p00, p01, p11) = state or ((0.0, 0.0), (p, 0.0, p))
        x, y = row
        p00, p01, p11 = p00 + q, p01 + q, p11 + q
        error = y - (slope * x + intercept)
        a, b = p00 * x + p01, p01 * x + p11
        s = x * a + b + r
        g, h = a / s, b / s
        slope, intercept = slope + g * error, intercept + h * error
        state = ((slope, intercept), (p00 - g * a, p01 - g * b, p11 - h * b))
        return state, (slope, intercept, y - slope * x - intercept)

    return Recurrence([x, y], ["slope", "intercept", "residual"], step)


def cusum(threshold: float) -> Recurrence:
    """1 or -1 where the cumulated log return passes the threshold upwards or downwards, which resets that side."""

    def step(state, row):
        if state is None:
            return (row[0], 0.0, 0.0), (0.0,)
        last, up, down = state
        move = math.log(row[0] / last)
        up, down = max(0.0, up + move), min(0.0, down + move)
        if down < -threshold:
            return (row[0], up, 0.0), (-1.0,)
        if up > threshold:
            return (row[0], 0.0, down), (1.0,)
        return (row[0], up, down), (0.0,)

    return Recurrence(["close"], ["event"], step)


def supertrend(n: int, k: float, use_close: bool = False) -> Recurrence:
    """Bands around the typical price at k average true ranges; the band behind the trend only tightens."""

    def step(state, row):
        high, low, close = row
        ranges, prior, (upper, lower, direction) = state or ((), None, (0.0, 0.0, 0.0))
        true = high - low if prior is None else max(high - low, abs(high - prior), abs(low - prior))
        ranges = (*ranges, true)[-n:]
        atr, middle = sum(ranges) / len(ranges), close if use_close else (high + low) / 2
        up, down = middle + k * atr, middle - k * atr
        if close > upper:
            now = 1.0
        elif close < lower:
            now = -1.0
        else:
            now = direction
            if now > 0:
                down = max(down, lower)
            if now < 0:
                up = min(up, upper)
        return (ranges, close, (up, down, now)), (up, down, now, float(now != direction))

    return Recurrence(["high", "low", "close"], ["upper", "lower", "direction", "changed"], step)


def order_blocks(n: int, tolerance: float, keep: int = 5) -> Recurrence:
    """Count of open bullish and bearish blocks, and the newest of each: bars at the centre of 2n+1 with peak volume.

    ``tolerance`` is the per cent by which the centre's volume may fall short of the peak. A bullish
    block (recent lows below the older ones) is gone when the lowest close of n bars is under it.
    """

    def step(state, row):
        rows, bull, bear = state or ((), (), ())
        rows = (*rows, row)[-(2 * n + 1) :]
        if len(rows) == 2 * n + 1:
            high, low, _, volume = rows[n]
            recent = rows[n + 1 :]
            if volume >= max(r[3] for r in rows) * (1 - tolerance / 100):
                rising = min(r[1] for r in recent) > low
                if rising:
                    bull = (*bull, ((high + low) / 2, low))[-keep:]
                elif max(r[0] for r in recent) < high:
                    bear = (*bear, (high, (high + low) / 2))[-keep:]
            closes = [r[2] for r in rows[-n:]]
            bull = tuple(b for b in bull if min(closes) >= b[1])
            bear = tuple(b for b in bear if max(closes) <= b[0])
        last = lambda blocks, k: blocks[-1][k] if blocks else math.nan
        return (rows, bull, bear), (float(len(bull)), float(len(bear)), last(bull, 0), last(bull, 1), last(bear, 0), last(bear, 1))

    return Recurrence(["high", "low", "close", "volume"], ["n_bull", "n_bear", "bull_top", "bull_bottom", "bear_top", "bear_bottom"], step)


def macd(fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close") -> Recurrence:
    """Difference of two exponential means that start at the first value, the mean of that, and what is between them."""
    a, b, c = (2 / (n + 1) for n in (fast, slow, signal))

    def step(state, row):
        x = row[0]
        quick, late, mean = state or (x, x, 0.0)
        quick, late = quick + a * (x - quick), late + b * (x - late)
        dif = quick - late
        mean += c * (dif - mean)
        return (quick, late, mean), (dif, mean, dif - mean)

    return Recurrence([column], ["dif", "dem", "histogram"], step)


def vidya(n: int, column: str = "close") -> Recurrence:
    """Exponential mean whose weight follows how one-sided the last n moves were; starts at the first value."""
    a = 2 / (n + 1)

    def step(state, row):
        x = row[0]
        moves, prior, mean = state or ((), x, x)
        moves = (*moves, x - prior)[-n:]
        total = sum(map(abs, moves))
        mean += a * (abs(sum(moves)) / total if total else 0.0) * (x - mean)
        return (moves, x, mean), (mean,)

    return Recurrence([column], ["vidya"], step)


def kvo(fast: int = 34, slow: int = 55) -> Recurrence:
    """Volume oscillator: exponential means of the volume force, which is signed by the typical price's trend.

    The force compares a bar's range with the ranges added up since the trend turned. Zero at first.
    """
    a, b = 2 / (fast + 1), 2 / (slow + 1)

    def step(state, row):
        high, low, close, volume = row
        price, size = high + low + close, high - low
        if state is None:
            return (price, size, 0.0, size, 0.0, 0.0), (0.0,)
        prior, before, trend, added, quick, late = state
        now = 1.0 if price > prior else -1.0
        added = added + size if now == trend else before + size
        force = volume * abs(2 * size / added - 1) * now * 100 if added else 0.0
        quick, late = quick + a * (force - quick), late + b * (force - late)
        return (price, size, now, added, quick, late), (quick - late,)

    return Recurrence(["high", "low", "close", "volume"], ["kvo"], step)
