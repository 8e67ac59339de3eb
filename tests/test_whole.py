"""Queries over the whole tables, against brute force on them."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom import queries
from tapeloom.operators import events
from tapeloom.operators import order as ordering
from tapeloom.sources import market

SF10 = "/root/testdata/sf0.01"


def test_bootstrap_draws_from_all_events_of_all_symbols(spark):
    bars = defaultdict(list)
    for r in market.panel(spark, SF10).select("symbol", "datetime").collect():
        bars[r["symbol"]].append(r["datetime"])
    cells = defaultdict(lambda: defaultdict(set))
    start = F.trunc("o_orderdate", "month")
    for r in market.table(spark, SF10, "orders").select("o_orderkey", "o_custkey", start.alias("a"), F.add_months(start, 3).alias("b")).collect():
        symbol = r["o_custkey"] % 50
        if own := {d for d in bars[symbol] if r["a"] <= d <= r["b"]}:
            cells[symbol][r["o_orderkey"]] = own
    found = defaultdict(list)
    for r in sorted(queries.queries()["ev_bootstrap"](spark, SF10).collect(), key=lambda r: r["nth"]):
        found[r["symbol"]].append(r["event_id"])
    assert set(found) == set(cells) and {len(v) for v in found.values()} == {20}
    assert any(i % 5 for v in found.values() for i in v)
    for symbol in list(found)[:3]:
        ids, used, draw = sorted(cells[symbol]), Counter(), np.random.default_rng([1, *str(symbol).encode()])
        for i in found[symbol]:
            p = np.array([sum(1 / (1 + used[d]) for d in sorted(cells[symbol][k])) / len(cells[symbol][k]) for k in ids])
            assert ids[int(draw.choice(len(ids), p=p / p.sum()))] == i
            used.update(cells[symbol][i])


def test_arrivals_of_all_symbols(spark):
    found = {(r["symbol"], r["side"], r["spread"]): r["intensity"] for r in queries.queries()["quote_arrivals"](spark, SF10).collect()}
    ticks = defaultdict(list)
    for r in market.ticks(spark, SF10).select("symbol", F.unix_micros("ts").alias("us"), "price").collect():
        ticks[r["symbol"]].append((r["us"] / 1000, r["price"]))
    assert {k[0] for k in found} == set(ticks) and len(found) == 8 * len(ticks) and max(ticks) >= 20
    day = 86_400_000
    for symbol in (0, 20, max(ticks)):
        rows = sorted(ticks[symbol])
        first, last = rows[0][0], rows[-1][0]
        slots = [s for s in (first + day * i for i in range(int((last - first) // day) + 1)) if s >= last - 20 * day]
        for side, spread in itertools.product(("buy", "sell"), (5.0, 20.0, 50.0, 100.0)):
            waited, filled = 0.0, 0
            for s in slots:
                mid = [p for t, p in rows if t <= s][-1]
                later = [(t, p) for t, p in rows if t > s]
                crossed = [t for t, p in later if (p + 1 < mid - spread if side == "buy" else p - 1 > mid + spread)]
                filled += bool(crossed)
                waited += (crossed[0] if crossed else last) - s
            assert found[symbol, side, spread] == pytest.approx(day * filled / waited if waited else 0.0, rel=1e-6)
    for name in ("quote_ak_regression", "quote_ak_pairs"):
        assert {r["symbol"] for r in queries.queries()[name](spark, SF10).collect()} == set(ticks)


def slow_overfit(values, parts):
    """values: {trial: {t: value}}; ranks of the best trial of each half in the other, smoothed."""
    times = sorted({t for own in values.values() for t in own})
    size, rest = divmod(len(times), parts)
    part = {t: i for i, t in enumerate(times)}
    cut = [k * size + min(k, rest) for k in range(parts + 1)]
    part = {t: next(k for k in range(parts) if cut[k] <= i < cut[k + 1]) for t, i in part.items()}

    def ratio(own, chosen):
        x = [v for t, v in own.items() if part[t] in chosen]
        if not x:
            return -math.inf
        mean = sum(x) / len(x)
        return mean / math.sqrt(max(sum(v * v for v in x) / len(x) - mean**2, 1e-30))

    logits = []
    for inside in itertools.combinations(range(parts), parts // 2):
        a = [ratio(values[k], set(inside)) for k in sorted(values)]
        b = [ratio(values[k], set(range(parts)) - set(inside)) for k in sorted(values)]
        w = (sum(v < b[a.index(max(a))] for v in b) + 1) / (len(values) + 1)
        logits.append(math.log(w / (1 - w)))
    width = 1.06 * max(float(np.std(logits)), 1e-9) * len(logits) ** -0.2
    return sum(0.5 * (1 + math.erf(-v / width / math.sqrt(2))) for v in logits) / len(logits)


def test_overfit_tries_every_supplier(spark):
    values = defaultdict(dict)
    for r in market.panel(spark, SF10).collect():
        values[r["symbol"]][r["datetime"]] = r["close"] / r["open"] - 1
    assert len(values) > 8
    assert queries.queries()["ev_overfit"](spark, SF10).first()[0] == pytest.approx(slow_overfit(values, 6))


def test_overfit_with_a_trial_that_is_missing_in_a_half(spark):
    draw = np.random.default_rng(5)
    values = {k: {t: float(draw.normal()) for t in range(4 if k == 2 else 12)} for k in range(5)}
    rows = [(t, k, v) for k, own in values.items() for t, v in own.items()]
    assert events.overfit_probability(spark.createDataFrame(rows, "t int, trial int, value double"), 6) == pytest.approx(slow_overfit(values, 6))


def test_positions_and_sums_over_heavy_ties(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, 1, 1, 1, 1, draw.randint(0, 400)]), k, draw.random()) for k in range(3000)]
    df = spark.createDataFrame(rows, "t int, id long, v double").repartition(5)
    ranges = ordering.Ranges(df, "t", "id", 20)
    sizes = Counter(r["b"] for r in df.select(ranges.bucket(df).alias("b")).collect())
    assert len(sizes) >= 15 and max(sizes.values()) <= 600
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = {r["id"]: (r["_i"], r["upto"]) for r in ordering.running_sum(ordering.numbered(df, "t", "id"), "v", "t", "id").collect()}
    total = 0.0
    for i, (_, k, v) in enumerate(expected):
        total += v
        assert found[k][0] == i and found[k][1] == pytest.approx(total)


def test_folds_purged_of_overlaps_by_brute_force(spark):
    draw = random.Random(5)
    rows = [(k, draw.randint(0, 300), draw.choice([0, 3, 60])) for k in range(400)]
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), F.col(n).cast("int"))
    df = spark.createDataFrame(rows, "event_id long, a int, n int").select("event_id", day("a").alias("event_starts"), F.date_add(day("a"), F.col("n")).alias("event_ends"))
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for n, tested in ((5, 1), (4, 2)):
        even = tested > 1
        size, rest = divmod(len(rows), n)
        fold = [i // size for i in range(len(rows))] if even else [k for k in range(n) for _ in range(size + (k < rest))]
        expected = set()
        for c, combo in enumerate(itertools.combinations(range(n), tested)):
            test = [r for r, f in zip(ordered, fold, strict=True) if f in combo]
            for r, f in zip(ordered, fold, strict=True):
                if f in combo:
                    expected.add((c, r[0], "test"))
                elif not any(r[1] <= x[1] + x[2] and x[1] <= r[1] + r[2] for x in test):
                    expected.add((c, r[0], "train"))
        found = events.combinatorial_purged(df, n, tested) if even else events.purged_k_fold(df, n)
        assert {tuple(r) for r in found.collect()} == expected
