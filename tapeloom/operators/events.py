"""Labels of bars, sample weights of events, and cross-validation without leaks.

Bars have symbol and datetime (unique together); events have event_id, symbol, event_starts and
event_ends (inclusive). Questions of the form "which bars does an event cover" are answered by
sorted sweeps and differences of running sums, not by joins on ranges.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import safe
from tapeloom.operators import grouped
from tapeloom.operators import order as ordering


def _bars() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("datetime")


# -- labels ---------------------------------------------------------------------------------------


def _pivots(close: np.ndarray, high: np.ndarray, low: np.ndarray, threshold: float) -> list[tuple[int, float, str | None]]:
    """(index, value, kind) of the turning points of closes; a peak's value is its high, a trough's its low."""
    if not len(close):
        return []
    found: list[tuple[int, float, str | None]] = [(0, float(close[0]), None)]
    value = {"Peak": high, "Trough": low}
    end = len(close) - 1
    for i in range(1, len(close)):
        last = found[-1][1]
        change = (close[i] - last) / abs(last) if last else 0.0
        if len(found) == 1:
            if abs(change) >= threshold:
                kind = "Peak" if change > 0 else "Trough"
                found[0] = (0, found[0][1], "Trough" if change > 0 else "Peak")
                found.append((i, float(value[kind][i]), kind))
            continue
        rising = found[-2][1] <= last  # the last pivot is a peak
        same, other, sign = ("Peak", "Trough", 1) if rising else ("Trough", "Peak", -1)
        if sign * (close[i] - last) >= 0:
            found[-1] = (i, float(value[same][i]), same)
        elif -sign * change >= threshold or i == end:
            found.append((i, float(value[other][i]), other))
    return found


def zigzag(bars: DataFrame, threshold: float) -> DataFrame:
    """(symbol, datetime, value, kind): the turning points."""
    kinds = {f.name: f.dataType for f in bars.schema}
    schema = T.StructType([T.StructField("symbol", kinds["symbol"]), T.StructField("datetime", kinds["datetime"]), T.StructField("value", T.DoubleType()), T.StructField("kind", T.StringType())])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("datetime", kind="stable").reset_index(drop=True)
        found = _pivots(*(rows[c].to_numpy(float) for c in ("close", "high", "low")), threshold)
        at = [i for i, _, _ in found]
        return rows.loc[at, ["symbol", "datetime"]].assign(value=[v for _, v, _ in found], kind=[k for _, _, k in found])

    return grouped.by_symbol(bars.select("symbol", "datetime", "close", "high", "low"), "symbol", ["datetime"], one, schema)


def labels(bars: DataFrame, *, threshold: float = 0.02, stop_loss: float | None = None, cut_label: bool = True, log_return: bool = True) -> DataFrame:
    """Bars with event_starts, event_ends, label (return to the next turning point) and count_index.

    With ``stop_loss``, where the worst bar before the end loses as much, its return and time are
    taken instead. ``cut_label`` clips at five deviations of the symbol. Bars before the second
    turning point are dropped.
    """
    pivots = zigzag(bars, threshold)
    own = Window.partitionBy("symbol").orderBy("datetime")
    pivots = pivots.withColumns({"next_value": F.lead("value").over(own), "event_ends": F.lead("datetime").over(own), "nth": F.row_number().over(own)})
    second = pivots.where("nth = 2").select("symbol", F.col("datetime").alias("second"))
    at = bars.join(pivots.drop("value", "kind", "nth"), ["symbol", "datetime"], "left")
    last = lambda c: F.last(c, ignorenulls=True).over(_bars())
    at = at.withColumns({"target": last("next_value"), "event_ends": last("event_ends")}).withColumn("label", safe.ratio(F.col("target"), F.col("close")) - 1)
    if stop_loss is not None:
        at = at.where(F.col("datetime") < F.col("event_ends"))
        # Within an event, a bar's worst later bar is a running extreme from the event's end backwards.
        back = Window.partitionBy("symbol", "event_ends").orderBy(F.col("datetime").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ends = bars.select("symbol", F.col("datetime").alias("event_ends"), F.struct("low", F.lit(0).alias("k"), F.col("datetime").alias("at")).alias("end_low"), F.struct("high", F.lit(0).alias("k"), F.col("datetime").alias("at")).alias("end_high"))
        at = at.join(ends, ["symbol", "event_ends"], "left")
        key = lambda c: F.struct(c, F.lit(0).alias("k"), F.col("datetime").alias("at"))
        worst, best = F.least(F.min(key("low")).over(back), F.col("end_low")), F.greatest(F.max(key("high")).over(back), F.col("end_high"))
        at = at.withColumns({"worst": worst, "best": best})
        fall, rise = F.least(F.col("worst.low") / F.col("close") - 1, F.lit(0.0)), F.greatest(F.col("best.high") / F.col("close") - 1, F.lit(0.0))
        long_out, short_out = (F.col("label") > 0) & (fall <= -stop_loss), (F.col("label") <= 0) & (rise >= stop_loss)
        at = at.withColumns({
            "event_ends": F.when(long_out, F.col("worst.at")).when(short_out, F.col("best.at")).otherwise(F.col("event_ends")),
            "label": F.when(long_out, fall).when(short_out, rise).otherwise(F.col("label")),
        }).drop("worst", "best", "end_low", "end_high")
    at = at.join(second, "symbol").where(F.col("datetime") >= F.col("second")).drop("second", "target", "next_value")
    if cut_label:
        every = Window.partitionBy("symbol")
        mean, spread = F.avg("label").over(every), 5 * F.stddev_pop("label").over(every)
        at = at.withColumn("label", safe.clip(F.col("label"), mean - spread, mean + spread))
    at = at.withColumns({"event_starts": F.col("datetime"), "count_index": F.row_number().over(_bars()) - 1})
    return at.withColumn("label", F.when(F.col("label") > -1, F.log1p("label"))) if log_return else at


def forward_returns(bars: DataFrame, first: int, last: int) -> DataFrame:
    """label_i for i in [first, last): close i bars on over close, less 1."""
    return bars.withColumns({f"label_{i}": safe.ratio(F.lead("close", i).over(_bars()), F.col("close")) - 1 for i in range(first, last)})


def rare_labels_dropped(rows: DataFrame, least: float, classes: int = 2, label: str = "label") -> DataFrame:
    """Drops the rarest class while its share is under ``least`` and more than ``classes`` are left."""
    counts = sorted(((r["count"], r[label]) for r in rows.groupBy(label).count().collect()), key=lambda x: (x[0], str(x[1])))
    while len(counts) > classes and counts[0][0] < least * sum(n for n, _ in counts):
        counts.pop(0)
    return rows.where(F.col(label).isin([v for _, v in counts if v is not None]))


# -- weights --------------------------------------------------------------------------------------


def concurrency(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(symbol, datetime, n_events): events that cover each bar, by a sweep over starts and ends."""
    marks = (
        events.select("symbol", F.col("event_starts").alias("datetime"), F.lit(0).alias("rank"), F.lit(1).alias("step"))
        .union(bars.select("symbol", "datetime", F.lit(1), F.lit(0)))
        .union(events.select("symbol", "event_ends", F.lit(2), F.lit(-1)))
        .groupBy("symbol", "datetime", "rank").agg(F.sum("step").alias("step"))
    )
    swept = marks.withColumn("n_events", F.sum("step").over(Window.partitionBy("symbol").orderBy("datetime", "rank")))
    return swept.where("rank = 1").select("symbol", "datetime", "n_events")


def _over_events(bars: DataFrame, events: DataFrame, value: str) -> DataFrame:
    """(event_id, total, n_bars) of ``value`` over the bars of each event, as a difference of running sums."""
    marks = (
        bars.select("symbol", "datetime", F.lit(1).alias("rank"), F.coalesce(value, F.lit(0.0)).alias("v"), F.lit(1).alias("n"), F.lit(None).cast("bigint").alias("event_id"), F.lit(0).alias("sign"))
        .union(events.select("symbol", "event_starts", F.lit(0), F.lit(0.0), F.lit(0), "event_id", F.lit(-1)))
        .union(events.select("symbol", "event_ends", F.lit(2), F.lit(0.0), F.lit(0), "event_id", F.lit(1)))
    )
    w = Window.partitionBy("symbol").orderBy("datetime", "rank").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.withColumns({"sv": F.sum("v").over(w), "sn": F.sum("n").over(w)}).where("sign <> 0")
    return swept.groupBy("event_id").agg(F.sum(F.col("sv") * F.col("sign")).alias("total"), F.sum(F.col("sn") * F.col("sign")).alias("n_bars"))


def average_uniqueness(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, uniqueness): mean of 1 / concurrency over an event's bars."""
    shared = concurrency(bars, events).withColumn("v", safe.ratio(F.lit(1), F.nullif("n_events", F.lit(0))))
    return _over_events(shared, events, "v").select("event_id", safe.ratio(F.col("total"), F.col("n_bars")).alias("uniqueness"))


def return_weights(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, weight): absolute sum of log returns over concurrency, scaled to sum to the number of events."""
    returns = bars.select("symbol", "datetime", F.ln(F.col("close") / F.lag("close").over(_bars())).alias("r"))
    shared = returns.join(concurrency(bars, events), ["symbol", "datetime"]).withColumn("v", safe.ratio(F.col("r"), F.nullif("n_events", F.lit(0))))
    raw = _over_events(shared, events, "v").select("event_id", F.abs("total").alias("raw"))
    total = raw.agg(F.sum("raw").alias("s"), F.count("*").alias("n"))  # one row
    return raw.crossJoin(F.broadcast(total)).select("event_id", safe.ratio(F.col("raw") * F.col("n"), F.col("s")).alias("weight"))


def indicators(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, symbol, datetime): the 1-cells of the event by bar matrix, joined within months, not by ranges over all bars."""
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    spans = events.withColumn("m", F.explode(F.sequence(month("event_starts"), month("event_ends"), F.expr("interval 1 month"))))
    both = bars.select("symbol", "datetime", month("datetime").alias("m")).join(spans, ["symbol", "m"])
    return both.where(F.col("datetime").between(F.col("event_starts"), F.col("event_ends"))).select("event_id", "symbol", "datetime")


def label_uniqueness(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, symbol, datetime, uniqueness) for each 1-cell: 1 over the cell's concurrency."""
    cells = indicators(bars, events)
    n = cells.groupBy("symbol", "datetime").agg(F.count("*").alias("n"))
    return cells.join(n, ["symbol", "datetime"]).select("event_id", "symbol", "datetime", (1 / F.col("n")).alias("uniqueness"))


def time_decay(weights: DataFrame, oldest: float, order: str = "event_starts", value: str = "uniqueness") -> DataFrame:
    """Adds ``decay``: linear in the cumulated value, 1 for the newest; a negative ``oldest`` gives the first part zero."""
    total = F.lit(weights.agg(F.sum(value)).first()[0]).cast("double")
    summed = ordering.running_sum(weights, value, order, "event_id", "_upto")
    slope = safe.ratio(F.lit(1.0 - oldest), total) if oldest >= 0 else safe.ratio(F.lit(1.0), (oldest + 1) * total)
    return summed.withColumn("decay", F.greatest(F.lit(0.0), 1 - slope * total + slope * F.col("_upto"))).drop("_upto")


def sequential_bootstrap(cells: DataFrame, draws: int, seed: int = 1, replace: bool = True, most_events: int = 10_000) -> list[int]:
    """Event ids drawn one by one with probability by average uniqueness given those drawn.

    Serial by nature, so on the driver; the number of events is checked against ``most_events``.
    """
    if (n := cells.select("event_id").distinct().count()) > most_events:
        raise ValueError(f"{n} events; at most {most_events} can be drawn from in sequence")
    rows = cells.select("event_id", "symbol", "datetime").toPandas()
    return _drawn(rows, draws, np.random.default_rng(seed), replace)


def sequential_bootstrap_by_symbol(cells: DataFrame, draws: int, seed: int = 1, replace: bool = True) -> DataFrame:
    """(symbol, nth, event_id): a sequential bootstrap for each symbol, one task each.

    Events of different symbols share no bar, so none changes the uniqueness of another's. What a
    symbol draws depends on the seed and the symbol alone.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        symbol = rows["symbol"].iloc[0]
        out = _drawn(rows.sort_values(["event_id", "datetime"]), draws, np.random.default_rng([seed, *str(symbol).encode()]), replace)
        return pd.DataFrame({"symbol": [symbol] * len(out), "nth": range(len(out)), "event_id": out})

    schema = T.StructType([T.StructField("symbol", cells.schema["symbol"].dataType), T.StructField("nth", T.IntegerType()), T.StructField("event_id", T.LongType())])
    return grouped.by_symbol(cells.select("event_id", "symbol", "datetime"), "symbol", ["event_id", "datetime"], one, schema)


def _drawn(rows: pd.DataFrame, draws: int, draw: np.random.Generator, replace: bool) -> list[int]:
    if rows.empty:
        return []
    ids, who = np.unique(rows["event_id"], return_inverse=True)
    bar = rows.groupby(["symbol", "datetime"], sort=True).ngroup().to_numpy()
    used, out, open_ = np.zeros(bar.max() + 1), [], np.ones(len(ids), bool)
    size = np.bincount(who)
    for _ in range(draws if replace else min(draws, len(ids))):
        p = np.where(open_, np.bincount(who, 1 / (1 + used[bar])) / size, 0.0)
        k = int(draw.choice(len(ids), p=p / p.sum()))
        used[bar[who == k]] += 1
        open_[k] = replace
        out.append(int(ids[k]))
    return out


# -- cross-validation -----------------------------------------------------------------------------


def embargo_times(bars: DataFrame, share: float, time: str = "datetime") -> DataFrame:
    """(datetime, embargo_ends): the bar time a share of all bars later, at most the last."""
    step = int(bars.count() * share)
    last = F.lit(bars.agg(F.max(time)).first()[0])
    at = ordering.numbered(bars.select(time), time)
    later = at.select((F.col("_i") - step).alias("_i"), F.col(time).alias("_later"))
    return at.join(later, "_i", "left").select(time, F.coalesce("_later", last).alias("embargo_ends"))


def folds(events: DataFrame, n: int, even: bool = False) -> DataFrame:
    """Adds ``fold``: n runs of consecutive events; the first ones get the remainder, or with ``even`` it is left out."""
    size, rest = divmod(events.count(), n)
    at, i = ordering.numbered(events, "event_starts", "event_id"), F.col("_i")
    if even:
        return at.withColumn("fold", F.floor(i / max(size, 1)).cast("int")).where(i < size * n).drop("_i")
    cut = rest * (size + 1)
    fold = F.when(i < cut, F.floor(i / (size + 1))).otherwise(rest + F.floor((i - cut) / max(size, 1)))
    return at.withColumn("fold", fold.cast("int")).drop("_i")


def touched(dealt: DataFrame, n: int) -> DataFrame:
    """(event_id, fold, hit): for each event, whether it overlaps an event of fold 0, 1 .. n - 1.

    An event overlaps a fold if the latest end (``test_ends``) among the fold's events that start by
    its own end is not before its start. One running maximum for each fold answers that for all
    events at once; it goes over ranges of time, and each range starts with the maxima before it.
    """
    none = F.lit(None)
    ends = {g: F.when(F.col("fold") == g, F.col("test_ends")) for g in range(n)}
    starts = dealt.select(F.col("event_starts").alias("t"), F.lit(0).alias("rank"), none.cast(dealt.schema["event_id"].dataType).alias("event_id"), "fold", "test_ends", none.cast(dealt.schema["event_starts"].dataType).alias("begins"))
    asked = dealt.select(F.col("event_ends").alias("t"), F.lit(1).alias("rank"), "event_id", "fold", none.cast(dealt.schema["test_ends"].dataType).alias("test_ends"), F.col("event_starts").alias("begins"))
    ranges = ordering.Ranges(dealt, "event_starts")
    marks = starts.union(asked)
    marks = marks.withColumn("_range", ranges.bucket(marks, "t")).withColumns({f"_e{g}": e for g, e in ends.items()})
    # A row for each range, a column for each fold: the maxima of all earlier ranges.
    upto = marks.groupBy("_range").agg(*(F.max(f"_e{g}").alias(f"_m{g}") for g in ends))
    past = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    upto = upto.select("_range", *(F.max(f"_m{g}").over(past).alias(f"_m{g}") for g in ends))
    own = Window.partitionBy("_range").orderBy("t", "rank").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.select("_range", "rank", "event_id", "fold", "begins", *(F.max(f"_e{g}").over(own).alias(f"_e{g}") for g in ends)).where("rank = 1")
    hit = [F.coalesce(F.greatest(f"_e{g}", f"_m{g}") >= F.col("begins"), F.lit(False)) for g in ends]
    return swept.join(F.broadcast(upto), "_range").select("event_id", "fold", F.array(*hit).alias("hit"))  # at most 2 x RANGES rows


def _parts(hits: DataFrame, tests: list[tuple[int, ...]], name: str) -> DataFrame:
    """(name, event_id, part) for each set of test folds; events of other folds that overlap one of them are left out."""
    part = lambda c: F.when(F.col("fold").isin(*c), "test").when(~F.array_contains(F.array(*(F.get("hit", F.lit(g)) for g in c)), True), "train")
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias(name), part(c).alias("part")) for i, c in enumerate(tests))))
    return hits.select("event_id", rows.alias("x")).select(f"x.{name}", "event_id", "x.part").where("part IS NOT NULL")


def purged_k_fold(events: DataFrame, n: int, embargo: DataFrame | None = None) -> DataFrame:
    """(fold, event_id, part): for each fold its test events, and its training events purged of overlaps.

    ``embargo`` maps a test event's end to a later one (datetime, embargo_ends).
    """
    dealt = folds(events, n)
    if embargo is None:
        dealt = dealt.withColumn("test_ends", F.col("event_ends"))
    else:
        dealt = dealt.join(embargo.withColumnRenamed("datetime", "event_ends"), "event_ends", "left").withColumn("test_ends", F.coalesce("embargo_ends", "event_ends"))
    return _parts(touched(dealt, n), [(k,) for k in range(n)], "fold")


def combinatorial_purged(events: DataFrame, groups: int, tested: int) -> DataFrame:
    """(combination, event_id, part) for each choice of ``tested`` of equal groups as the test set."""
    dealt = folds(events, groups, even=True).withColumn("test_ends", F.col("event_ends"))
    return _parts(touched(dealt, groups), list(itertools.combinations(range(groups), tested)), "combination")


def backtest_paths(groups: int, tested: int) -> list[list[tuple[int, int]]]:
    """Paths through the combinations: for each path, (group, combination) that tests it."""
    where = {g: [i for i, c in enumerate(itertools.combinations(range(groups), tested)) if g in c] for g in range(groups)}
    return [[(g, where[g][k]) for g in range(groups)] for k in range(len(where[0]))]


# -- bets and scores ------------------------------------------------------------------------------


def bet_size(p: Column, classes: int = 2) -> Column:
    """Bet from a class probability: 0 at an even chance, towards 1 at certainty."""
    z = safe.ratio(p - 1.0 / classes, F.sqrt(p * (1 - p)))
    return F.greatest(2 * safe.normal_cdf(z) - 1, F.lit(0.0))


def sharpe(x: Column) -> Column:
    return safe.ratio(F.avg(x), F.stddev_pop(x))


def negative_mse(p: Column, y: Column) -> Column:
    return -F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, least: float = 1e-15) -> Column:
    """Mean negative log likelihood of 0/1 labels under the probabilities of 1, which are kept off 0 and 1 by ``least``."""
    sure = lambda x: F.ln(F.greatest(x, F.lit(least)))
    return -F.avg(F.when(y == 1, sure(p)).otherwise(sure(1 - p)))


def accuracy(p: Column, y: Column, cut: float = 0.5) -> Column:
    """Share of rows whose probability is on the side of ``cut`` that their 0/1 label is."""
    return F.avg(((p >= cut).cast("int") == y).cast("double"))


def pinball(p: Column, y: Column, q: float) -> Column:
    """Mean quantile loss."""
    return F.avg(F.greatest(q * (y - p), (q - 1) * (y - p)))


def overfit_probability(results: DataFrame, partitions: int) -> float:
    """Probability of backtest overfitting from (t, trial, value): how often the best trial of one half of time ranks low in the other.

    Sharpe ratios of (trial, partition) come from sums in Spark; combinations of the few partitions
    are formed on the driver, and the logits' density is smoothed by a Gaussian kernel.
    """
    times = results.select("t").distinct().withColumn("part", F.ntile(partitions).over(Window.orderBy("t")) - 1)
    sums = results.join(times, "t").groupBy("trial", "part").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q")).toPandas()
    trials = sorted(sums["trial"].unique())
    cube = np.zeros((3, len(trials), partitions))
    for k, c in enumerate(("n", "s", "q")):
        cube[k, np.searchsorted(trials, sums["trial"]), sums["part"]] = sums[c]

    def ratios(parts) -> np.ndarray:
        n, s, q = cube[:, :, list(parts)].sum(axis=2)
        with np.errstate(invalid="ignore"):
            mean = s / n
            return np.where(n > 0, mean / np.sqrt(np.maximum(q / n - mean**2, 1e-30)), -np.inf)  # without a value: last

    logits = []
    for inside in itertools.combinations(range(partitions), partitions // 2):
        best, outside = int(ratios(inside).argmax()), ratios(sorted(set(range(partitions)) - set(inside)))
        w = ((outside < outside[best]).sum() + 1) / (len(trials) + 1)
        logits.append(math.log(w / (1 - w)))
    x = np.array(logits)
    width = 1.06 * max(x.std(), 1e-9) * len(x) ** -0.2
    return float(np.mean([0.5 * (1 + math.erf(-v / width / math.sqrt(2))) for v in x]))


def _scales(rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """One row: an offset ``_c_0`` and a width ``_c_1`` for each column c."""
    f = {"minmax": lambda c: (F.min(c), F.max(c) - F.min(c)), "standard": lambda c: (F.avg(c), F.stddev_pop(c))}[how]
    return rows.agg(*(x.alias(f"_{c}_{k}") for c in columns for k, x in enumerate(f(c))))


def scaled(rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Min-max or standard scaling by statistics of all rows (one broadcast row)."""
    at = rows.crossJoin(F.broadcast(_scales(rows, columns, how)))
    return at.select(*(safe.ratio(F.col(c) - F.col(f"_{c}_0"), F.col(f"_{c}_1")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def unscaled(rows: DataFrame, fitted: DataFrame, columns: list[str], how: str) -> DataFrame:
    """The inverse of ``scaled``: rows on the scale of ``fitted``, the rows that the statistics come from."""
    at = rows.crossJoin(F.broadcast(_scales(fitted, columns, how)))
    return at.select(*((F.col(c) * F.col(f"_{c}_1") + F.col(f"_{c}_0")).alias(c) if c in columns else F.col(c) for c in rows.columns))
