"""Line measures, signals and checks around models, on small tables worked out by hand."""

import itertools
import random
from collections import Counter, defaultdict
from datetime import date

from pyspark.sql import functions as F

from tapeloom.operators import lines, recurrences, signals, structure

BAR = "symbol string, datetime date, open double, high double, low double, close double, volume double"


def _bars(spark, closes, symbol="a"):
    rows = [(symbol, date(2024, 1 + i // 28, 1 + i % 28), c, c + 1.0, c - 1.0, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def _line(spark, *rows):
    kind = "symbol string, id int, start_at date, end_at date, start_value double, end_value double, high double, low double, up boolean"
    return spark.createDataFrame([("a", i, a, b, s, e, max(s, e), min(s, e), e > s) for i, a, b, s, e in rows], kind)


def test_shared_intervals(spark):
    at = spark.createDataFrame([(3.0, 1.0, 2.0, 5.0), (1.0, 2.0, 2.0, 3.0), (1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    found = at.select(lines.shared(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()
    assert [None if r.x is None else tuple(r.x) for r in found] == [(3.0, 2.0), (2.0, 2.0), None]


def test_bounds_across_months(spark):
    bars = _bars(spark, [float(i) for i in range(60)])
    found = lines.bounds(_line(spark, (0, date(2024, 1, 27), date(2024, 2, 2), 26.0, 29.0)), bars).collect()
    assert [(r.top, r.bottom, r.vwap) for r in found] == [(30.0, 25.0, 27.5)]


def test_anchored_vwap_without_bars_is_null(spark):
    bars = _bars(spark, [1.0, 2.0, 3.0])
    line = lambda end: _line(spark, (0, date(2024, 1, 1), end, 1.0, 2.0))
    assert lines.anchored_vwap(line(date(2024, 1, 3)), bars).first().vwap is None
    assert lines.anchored_vwap(line(date(2024, 1, 1)), bars).first().vwap == 2.5


def test_channel_breaks_downward(spark):
    bars = _bars(spark, [10.0, 1.0, 12.0, 4.0, 13.0, 9.0, 2.0])
    day = lambda i: date(2024, 1, 1 + i)
    ends = [(0, day(0), day(1), 10.0, 1.0), (1, day(1), day(2), 1.0, 12.0), (2, day(2), day(3), 12.0, 4.0), (3, day(3), day(4), 4.0, 13.0)]
    found = lines.channel(_line(spark, *ends), bars, 4).first()
    assert (found.up_slope, found.down_slope, found.signal) == (0.5, 1.5, -1)
    assert lines.channel(_line(spark, *ends), bars, 5).count() == 0


def test_inside_keeps_first_to_last_along_the_way(spark):
    day = lambda i: date(2024, 1, 1 + i)
    upper = _line(spark, (0, day(0), day(9), 1.0, 9.0))
    lower = _line(spark, (0, day(0), day(1), 3.0, 1.0), (1, day(1), day(4), 1.0, 5.0), (2, day(4), day(6), 5.0, 4.0), (3, day(6), day(9), 4.0, 9.0), (4, day(9), day(12), 9.0, 2.0))
    assert sorted(r.id for r in lines.inside(upper, lower).collect()) == [1, 2, 3]


def test_fractal_power_of_a_strong_top(spark):
    rows = [("a", date(2024, 1, 1), 9.0, 10.0, 8.0, 9.5, 1.0), ("a", date(2024, 1, 2), 11.0, 12.0, 10.0, 11.5, 1.0), ("a", date(2024, 1, 3), 10.0, 10.5, 5.0, 5.5, 1.0)]
    bars = spark.createDataFrame(rows, BAR)
    assert [r.power for r in lines.fractal_power(structure.structure(bars, "any"), bars).collect()] == [5]


def test_crossovers_wait_for_the_warm_up(spark):
    at = spark.createDataFrame([("a", i, f, 2.0) for i, f in enumerate([1.0, 3.0, 1.0, 2.0, 3.0])], "symbol string, datetime int, f double, s double")
    crosses = lambda n: [r.cross for r in signals.crossovers(at, "f", "s", n).orderBy("datetime").collect()]
    assert crosses(0) == [0, 1, -1, 0, 0]
    assert crosses(2) == [0, 0, -1, 0, 0]


def test_structure_breaks_and_turns(spark):
    bars = _bars(spark, [1.0, 5.0, 2.0, 3.0, 7.5, 6.0, 9.0, 4.0, 1.0, 0.5])
    found = signals.market_structure(bars, 1).orderBy("datetime").collect()
    assert [r["break"] for r in found] == [None, None, None, None, "up BOS", None, "up BOS", "down CHoCH", None, None]


def test_top_share_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(i, 0.5) for i in range(7)] + [(7, 0.9), (8, None), (9, 0.1)], "k int, p double")
    found = {r.k for r in signals.top_share(rows, "p", 0.4, "k").where("top").collect()}
    assert found == {7, 0, 1, 2}
    assert signals.top_share(rows.limit(0), "p", 0.4, "k").count() == 0


def test_relabelled_and_votes(spark):
    rows = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.8), (2, 1, 0.2), (3, 0, 0.1)], "k int, label int, proba double")
    assert [r.label for r in signals.relabelled(rows, 0.5, "k").orderBy("k").collect()] == [1, 0, 0, 1]
    vote = signals.majority([F.lit(0.9), F.lit(0.2)])
    assert spark.range(1).select(vote.alias("v")).first().v == 0


def test_range_breaks(spark):
    at = spark.createDataFrame([("a", date(2024, 1, d)) for d in (1, 2, 3, 6)], "symbol string, datetime date")
    assert [(r.extra_us, r.at.day) for r in signals.range_breaks(at).collect()] == [(2 * 86_400_000_000, 4)]


def test_pair_residuals_of_a_perfect_pair_are_null(spark):
    base = _bars(spark, [1.0, 2.0, 4.0, 4.0]).select("datetime", "close")
    found = signals.pair_residuals(_bars(spark, [2.0, 4.0, 8.0, 8.0]), base, 1).collect()
    assert len(found) == 3
    assert all(r.residual is None or r.residual < 3 for r in found)


def _steps(r, rows):
    state, out = None, []
    for row in rows:
        state, made = r.step(state, row)
        out.append(made)
    return out


def test_macd_of_a_constant_is_zero_and_of_a_rise_positive():
    assert _steps(recurrences.macd(), [(5.0,)] * 4) == [(0.0, 0.0, 0.0)] * 4
    assert all(dif > 0 for dif, _, _ in _steps(recurrences.macd(3, 6, 4), [(float(i),) for i in range(9)])[1:])


def test_vidya_stands_still_where_moves_cancel_out():
    found = [x for (x,) in _steps(recurrences.vidya(2), [(1.0,), (2.0,), (1.0,), (2.0,)])]
    assert found[2] == found[1] == found[3]
    assert [x for (x,) in _steps(recurrences.vidya(3), [(0.0,), (2.0,), (4.0,)])] == [0.0, 1.0, 2.5]


def test_kvo_by_hand():
    rows = [(2.0, 1.0, 1.5, 10.0), (4.0, 2.0, 3.0, 10.0), (5.0, 3.0, 4.0, 6.0)]
    # Forces: 10 * |2 * 2 / 3 - 1| * 100, then 6 * |2 * 2 / 5 - 1| * 100; weights 1 and 1/2.
    one, two = 1000 / 3, 120.0
    found = [x for (x,) in _steps(recurrences.kvo(1, 3), rows)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(found, [0.0, one - one / 2, two - (one / 2 + (two - one / 2) / 2)], strict=True))


def test_fractal_power_of_a_bottom_mirrors_a_top(spark):
    rows = [("a", date(2024, 1, 1), -9.0, -8.0, -10.0, -9.5, 1.0), ("a", date(2024, 1, 2), -11.0, -10.0, -12.0, -11.5, 1.0), ("a", date(2024, 1, 3), -10.0, -5.0, -10.5, -5.5, 1.0)]
    bars = spark.createDataFrame(rows, BAR)
    found = lines.fractal_power(structure.structure(bars, "any"), bars).collect()
    assert [r.power for r in found] == [5]


def test_equal_swings(spark):
    at = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 2, -1, 5.0), ("a", 3, 1, 10.05), ("a", 4, 1, 12.0)], "symbol string, datetime int, indicator int, price double")
    assert [r.equal for r in signals.equal_swings(at, F.lit(0.1)).orderBy("datetime").collect()] == [False, False, True, False]


def test_meta_label_takes_the_first_of_equals(spark):
    made = signals.meta_label([F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.25), F.lit(0.25))], F.lit(0))
    assert spark.range(1).select(*(c.alias(k) for k, c in made.items())).first().asDict() == {"predict_prob": 0.375, "label": 1}


def slow_zones(lines):
    """Lists of line numbers, by the docstring's words; lines are (up, high, low)."""
    out, i = [], 0
    while i <= len(lines) - 4:
        top, bottom = min(lines[i + 1][1], lines[i + 3][1]), max(lines[i + 1][2], lines[i + 3][2])
        run = list(itertools.takewhile(lambda k: top >= bottom and lines[k][2] <= top and lines[k][1] >= bottom, range(i, len(lines))))
        if len(run) >= 4:
            out.append((run, top, bottom))
            i = run[-1]
        else:
            i += 1
    return out


def slow_points(lines, power):
    out, before = set(), None
    for number, (run, top, bottom) in enumerate(slow_zones(lines)):
        first, last = run[0], run[-1]
        up = lines[last][0]
        most = max(lines[k][1] for k in run) if up else min(lines[k][2] for k in run)
        beyond = most == lines[last][1 if up else 2]
        inner = run[1:-1] if beyond else run[1:]
        gg, dd = max(lines[k][1] for k in inner), min(lines[k][2] for k in inner)
        way = None
        if lines[first][0] == up and ((lines[first][2] <= dd and lines[last][1] >= gg) if up else (lines[first][1] >= gg and lines[last][2] <= dd)):
            way = up
        weak, side = way is not None and power[last] < power[first], "sell" if up else "buy"
        if len(inner) - 1 < 9:  # the level counts the lines within but one
            if weak and before and before[0] == first and before[1] == way and (before[2] < dd if up else before[3] > gg):
                out.add((last, number, "1" + side))
            if len(run) >= 7 and lines[first][0] == up:
                _, high, low = lines[run[-3]]
                if (high == gg and (high > lines[last][1] or weak)) if up else (low == dd and (low < lines[last][2] or weak)):
                    out.add((last, number, "2" + side))
            if len(run) >= 5 and last + 1 < len(lines):
                back, high, low = lines[last + 1]
                if high < bottom if back else low > top:
                    out.add((last + 1, number, "3" + ("sell" if back else "buy")))
        before = (last, way, gg, dd)
    return out


def test_trade_points_against_brute_force(spark):
    draw, rows = random.Random(3), []
    for symbol in range(40):
        at = 1000.0
        for day in range(400):
            move, reach = draw.gauss(0, 4), abs(draw.gauss(0, 1))
            rows.append((symbol, date.fromordinal(730000 + day), at, max(at, at + move) + reach, min(at, at + move) - reach, at + move))
            at += move
    bars = spark.createDataFrame(rows, "symbol int, datetime date, open double, high double, low double, close double")
    made = structure.structure(bars, "any")
    lines = made.where("kind = 'stroke'")
    power = structure.line_power(lines, bars.withColumn("move", F.col("close") - F.col("open")), "move")
    found, kinds = {(r["symbol"], r["id"], r["zone"], r["point"]) for r in structure.trade_points(lines, made.where("kind = 'zone'"), power).collect()}, Counter()
    own, weights = defaultdict(dict), {(r["symbol"], r["id"]): r["total"] for r in power.collect()}
    for r in lines.collect():
        own[r["symbol"]][r["id"]] = (r["up"], r["high"], r["low"])
    expected = set()
    for symbol, some in own.items():
        listed = [some[k] for k in range(len(some))]
        expected |= {(symbol, *p) for p in slow_points(listed, [weights[symbol, k] for k in range(len(listed))])}
    assert found == expected
    kinds.update(p for *_, p in found)
    assert set(kinds) == {k + side for k in "123" for side in ("buy", "sell")}


def test_coefficients_that_halve(spark):
    from tapeloom.operators import evaluate

    half, rate = evaluate.half_life([1, 2, 3, 4, 5], [0.8 * 0.5 ** (k / 3) for k in range(5)])
    assert abs(half - 3) < 1e-6 and rate < 0
