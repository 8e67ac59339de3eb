"""The public catalogue of formulaic alphas, as expressions of the factor language.

``{r}`` is the one-period return, ``{advN}`` the mean money of N periods. Numbers missing from the
catalogue need industries.
"""

from __future__ import annotations

import re

RETURN = "($close / Ref($close, 1) - 1)"

#: The formulas, in the order of their numbers.
FORMULAS = {
    1: "CSRank(IdxMax(Power(If({r} < 0, Std({r}, 20), $close), 2), 5)) - 0.5",
    2: "-1 * Corr(CSRank(Delta(Log($volume), 2)), CSRank(($close - $open) / $open), 6)",
    3: "-1 * Corr(CSRank($open), CSRank($volume), 10)",
    4: "-1 * Rank(CSRank($low), 9)",
    5: "CSRank($open - Sum($vwap, 10) / 10) * (-1 * CSRank($close - $vwap))",
    6: "-1 * Corr($open, $volume, 10)",
    7: "If({adv20} < $volume, 0 - Rank(Abs(Delta($close, 7)), 60) * Sign(Delta($close, 7)), -1)",
    8: "-1 * CSRank(Sum($open, 5) * Sum({r}, 5) - Ref(Sum($open, 5) * Sum({r}, 5), 10))",
    9: "If(0 < Min(Delta($close, 1), 5), Delta($close, 1), If(Max(Delta($close, 1), 5) < 0, Delta($close, 1), -1 * Delta($close, 1)))",
    10: "CSRank(If(0 < Min(Delta($close, 1), 4), Delta($close, 1), If(Max(Delta($close, 1), 4) < 0, Delta($close, 1), -1 * Delta($close, 1))))",
    11: "(CSRank(Max($vwap - $close, 3)) + CSRank(Min($vwap - $close, 3))) * CSRank(Delta($volume, 3))",
    12: "Sign(Delta($volume, 1)) * (-1 * Delta($close, 1))",
    13: "-1 * CSRank(Cov(CSRank($close), CSRank($volume), 5))",
    14: "-1 * CSRank(Delta({r}, 3)) * Corr($open, $volume, 10)",
    15: "-1 * Sum(CSRank(Corr(CSRank($high), CSRank($volume), 3)), 3)",
    16: "-1 * CSRank(Cov(CSRank($high), CSRank($volume), 5))",
    17: "-1 * CSRank(Rank($close, 10)) * CSRank(Delta(Delta($close, 1), 1)) * CSRank(Rank($volume / {adv20}, 5))",
    18: "-1 * CSRank(Std(Abs($close - $open), 5) + ($close - $open) + Corr($close, $open, 10))",
    19: "-1 * Sign(($close - Ref($close, 7)) + Delta($close, 7)) * (1 + CSRank(1 + Sum({r}, 250)))",
    20: "-1 * CSRank($open - Ref($high, 1)) * CSRank($open - Ref($close, 1)) * CSRank($open - Ref($low, 1))",
    21: "If(Mean($close, 8) + Std($close, 8) < Mean($close, 2), -1, If(Mean($close, 2) < Mean($close, 8) - Std($close, 8), 1, If($volume <= {adv20}, 1, -1)))",
    22: "-1 * Delta(Corr($high, $volume, 5), 5) * CSRank(Std($close, 20))",
    23: "If(Mean($high, 20) < $high, -1 * Delta($high, 2), 0)",
    24: "If(Delta(Mean($close, 100), 100) / Ref($close, 100) <= 0.05, Min($close, 100) - $close, -1 * Delta($close, 3))",
    25: "CSRank(-1 * {r} * {adv20} * $vwap * ($high - $close))",
    26: "0 - Max(Corr(Rank($volume, 5), Rank($high, 5), 5), 3)",
    27: "If(0.5 < CSRank(Mean(Corr(CSRank($volume), CSRank($vwap), 6), 2)), -1, 1)",
    28: "CSScale(Corr({adv20}, $low, 5) + ($high + $low) / 2 - $close)",
    29: "Min(Prod(CSRank(Sum(Min(CSRank(-Delta($close - 1, 5)), 2), 1)), 1), 5) + Rank(Ref(-1 * {r}, 6), 5)",
    30: "(1.0 - CSRank(Sign($close - Ref($close, 1)) + Sign(Ref($close, 1) - Ref($close, 2)) + Sign(Ref($close, 2) - Ref($close, 3)))) * Sum($volume, 5) / Sum($volume, 20)",
    31: "CSRank(WMA(-CSRank(Delta($close, 10)), 10)) + CSRank(-Delta($close, 3)) + Sign(Corr({adv20}, $low, 12))",
    32: "CSScale(Mean($close, 7) - $close) + 20 * CSScale(Corr($vwap, Ref($close, 5), 230))",
    33: "CSRank($close / ($close - $open))",
    34: "CSRank(2 - CSRank(Std({r}, 2) / Std({r}, 5)) - CSRank(Delta($close, 1)))",
    35: "Rank($volume, 32) * (1 - Rank($close + $high - $low, 16)) * (1 - Rank({r}, 32))",
    36: "2.21 * CSRank(Corr($close - $open, Ref($volume, 1), 15)) + 0.7 * CSRank($open - $close) + 0.73 * CSRank(Rank(Ref(-1 * {r}, 6), 5)) + CSRank(Abs(Corr($vwap, {adv20}, 6))) + 0.6 * CSRank((Mean($close, 200) - $open) * ($close - $open))",
    37: "CSRank(Corr(Ref($open - $close, 1), $close, 200)) + CSRank($open - $close)",
    38: "-CSRank(Rank($close, 10)) * CSRank($close / $open)",
    39: "-CSRank(Delta($close, 7) * (1 - CSRank(WMA($volume / {adv20}, 9)))) * (1 + CSRank(Sum({r}, 250)))",
    40: "-CSRank(Std($high, 10)) * Corr($high, $volume, 10)",
    41: "Power($high * $low, 0.5) - $vwap",
    42: "CSRank($vwap - $close) / CSRank($vwap + $close)",
    43: "Rank($volume / {adv20}, 20) * Rank(-1 * Delta($close, 7), 8)",
    44: "-1 * Corr($high, CSRank($volume), 5)",
    45: "-CSRank(Mean(Ref($close, 5), 20)) * Corr($close, $volume, 2) * CSRank(Corr(Sum($close, 5), Sum($close, 20), 2))",
    46: "If(0.25 < (Ref($close, 20) - Ref($close, 10)) / 10 - (Ref($close, 10) - $close) / 10, -1, If((Ref($close, 20) - Ref($close, 10)) / 10 - (Ref($close, 10) - $close) / 10 < 0, 1, -1 * ($close - Ref($close, 1))))",
    47: "CSRank(1 / $close) * CSRank($high - $close) * $volume / {adv20} * $high / Mean($high, 5) - CSRank($vwap - Ref($vwap, 5))",
    49: "If((Ref($close, 20) - Ref($close, 10)) / 10 - (Ref($close, 10) - $close) / 10 < -0.1, 1, -1 * ($close - Ref($close, 1)))",
    50: "-1 * Max(CSRank(Corr(CSRank($volume), CSRank($vwap), 5)), 5)",
    51: "If((Ref($close, 20) - Ref($close, 10)) / 10 - (Ref($close, 10) - $close) / 10 < -0.05, 1, -1 * ($close - Ref($close, 1)))",
    52: "(Ref(Min($low, 5), 5) - Min($low, 5)) * CSRank((Sum({r}, 240) - Sum({r}, 20)) / 220) * Rank($volume, 5)",
    53: "-1 * Delta((($close - $low) - ($high - $close)) / ($close * 1.000001 - $low), 9)",
    54: "-1 * ($low - $close) * Power($open, 5) / (($low * 1.000001 - $high) * Power($close, 5))",
    55: "-1 * Corr(CSRank(($close - Min($low, 12)) / (Max($high, 12) - Min($low, 12))), CSRank($volume), 6)",
    56: "-1 * CSRank(Sum({r}, 10) / Sum(Sum({r}, 2), 3)) * CSRank({r} * $open_interest)",
    57: "-1 * ($close - $vwap) / WMA(CSRank(IdxMax($close, 30)), 2)",
    60: "CSScale(CSRank(IdxMax($close, 10))) - 2 * CSScale(CSRank((($close - $low) - ($high - $close)) / ($high - $low) * $volume))",
    61: "If(CSRank($vwap - Min($vwap, 16)) < CSRank(Corr($vwap, {adv180}, 17)), 1, 0)",
    62: "If(CSRank(Corr($vwap, Sum({adv20}, 22), 9)) < CSRank(If(2 * CSRank($open) < CSRank(($high + $low) / 2) + CSRank($high), 1, 0)), -1, 0)",
    64: "If(CSRank(Corr(Sum($open * 0.178404 + $low * (1 - 0.178404), 12), Sum({adv120}, 12), 16)) < CSRank(Delta(($high + $low) / 2 * 0.178404 + $vwap * (1 - 0.178404), 3)), -1, 0)",
    65: "If(CSRank(Corr($open * 0.00817205 + $vwap * (1 - 0.00817205), Sum({adv60}, 8), 6)) < CSRank($open - Min($open, 13)), -1, 0)",
    66: "-(CSRank(WMA(Delta($vwap, 3), 7)) + Rank(WMA(($low * 0.96633 + $low * (1 - 0.96633) - $vwap) / ($open - ($high + $low) / 2), 11), 6))",
    68: "If(Rank(Corr(CSRank($high), CSRank({adv15}), 9), 14) < CSRank(Delta($close * 0.518371 + $low * (1 - 0.518371), 1)), -1, 0)",
    71: "Greater(Rank(WMA(Corr(Rank($close, 3), Rank({adv180}, 12), 18), 4), 15), Rank(WMA(Power(CSRank($low + $open - 2 * $vwap), 2), 16), 4))",
    72: "CSRank(WMA(Corr(($high + $low) / 2, {adv40}, 8), 10)) / CSRank(WMA(Corr(Rank($vwap, 3), Rank($volume, 18), 6), 2))",
    73: "-Greater(CSRank(WMA(Delta($vwap, 4), 3)), Rank(WMA(-1 * (Delta($open * 0.147155 + $low * (1 - 0.147155), 2) / ($open * 0.147155 + $low * (1 - 0.147155))), 3), 16))",
    74: "If(CSRank(Corr($close, Sum({adv30}, 37), 15)) < CSRank(Corr(CSRank($high * 0.0261661 + $vwap * (1 - 0.0261661)), CSRank($volume), 11)), -1, 0)",
    75: "If(CSRank(Corr($vwap, $volume, 4)) < CSRank(Corr(CSRank($low), CSRank({adv50}), 12)), 1, 0)",
    77: "Less(CSRank(WMA(($high + $low) / 2 - $vwap, 20)), CSRank(WMA(Corr(($high + $low) / 2, {adv40}, 3), 5)))",
    78: "Power(CSRank(Corr(Sum($low * 0.352233 + $vwap * (1 - 0.352233), 19), Sum({adv40}, 19), 6)), CSRank(Corr(CSRank($vwap), CSRank($volume), 6)))",
    81: "If(CSRank(Sum(Log(CSRank(Power(CSRank(Corr($vwap, Sum({adv10}, 49), 8)), 4))), 15)) < CSRank(Corr(CSRank($vwap), CSRank($volume), 5)), -1, 0)",
    83: "CSRank(Ref(($high - $low) / Mean($close, 5), 2)) * CSRank($volume) * Mean($close, 5) * ($vwap - $close) / ($high * 1.0000001 - $low)",
    85: "Power(CSRank(Corr($high * 0.876703 + $close * (1 - 0.876703), {adv30}, 9)), CSRank(Corr(Rank(($high + $low) / 2, 3), Rank($volume, 10), 7)))",
    86: "If(Rank(Corr($close, Sum({adv20}, 14), 6), 20) < CSRank(($open + $close) - ($vwap + $open)), -1, 0)",
    88: "Less(CSRank(WMA(CSRank($open) + CSRank($low) - (CSRank($high) + CSRank($close)), 8)), Rank(WMA(Corr(Rank($close, 8), Rank({adv60}, 20), 8), 6), 2))",
    92: "Less(Rank(WMA(If(($high + $low) / 2 + $close < $low + $open, 1, 0), 14), 18), Rank(WMA(Corr(CSRank($low), CSRank({adv30}), 8), 7), 7))",
    94: "-Power(CSRank($vwap - Min($vwap, 11)), Rank(Corr(Rank($vwap, 19), Rank({adv60}, 4), 18), 2))",
    95: "If(CSRank($open - Min($open, 12)) < Rank(CSRank(Corr(Sum(($high + $low) / 2, 19), Sum({adv40}, 19), 12)), 12), 1, 0)",
    96: "-Greater(Rank(WMA(Corr(CSRank($vwap), CSRank($volume), 4), 4), 8), Rank(WMA(IdxMax(Corr(Rank($close, 7), Rank({adv60}, 4), 3), 12), 14), 13))",
    98: "CSRank(WMA(Corr($vwap, Sum({adv5}, 26), 4), 7)) - CSRank(WMA(Rank(IdxMin(Corr(CSRank($open), CSRank({adv15}), 21), 9), 7), 8))",
    99: "If(CSRank(Corr(Sum(($high + $low) / 2, 19), Sum({adv60}, 19), 8)) < CSRank(Corr($low, $volume, 6)), -1, 0)",
    101: "($close - $open) / ($high - $low + 0.001)",
}


def alpha(number: int) -> str:
    """The formula with its macros written out."""
    return re.sub(r"\{adv(\d+)\}", r"Mean($money, \1)", FORMULAS[number]).replace("{r}", RETURN)


def alphas(numbers=None) -> dict[str, str]:
    return {f"alpha{n:03d}": alpha(n) for n in (numbers or FORMULAS)}
