"""Queries of labels, weights, cross-validation and factor evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom import sql
from tapeloom.operators import evaluate, events
from tapeloom.plans.compile import evaluate as factors
from tapeloom.sources import market


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from ``orders``: a customer's order opens one of 3 months on one of 50 symbols."""
    o = market.table(spark, sf_dir, "orders")
    start = F.trunc("o_orderdate", "month")
    return o.select(F.col("o_orderkey").alias("event_id"), F.pmod("o_custkey", F.lit(50)).alias("symbol"), start.alias("event_starts"), F.add_months(start, 3).alias("event_ends"))


def _weights(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql.singles(f(market.panel(spark, sf_dir), spans(spark, sf_dir)))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with a factor and forward returns."""
    p = events.forward_returns(market.panel(spark, sf_dir), 1, 4)
    f = factors(market.panel(spark, sf_dir), {"f1": "$close / $open - 1", "f2": "$volume / Mean($volume, 3)", "f3": "$high / $low"})
    return p.join(f, ["symbol", "datetime"])


def _frame(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql.singles(f(frame(spark, sf_dir)))


def _panel(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql.singles(f(market.panel(spark, sf_dir)))


def _decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spans(spark, sf_dir)
    u = events.average_uniqueness(market.panel(spark, sf_dir), e).join(e.select("event_id", "event_starts"), "event_id").where("uniqueness IS NOT NULL")
    return sql.singles(events.time_decay(u, 0.5).select("event_id", "decay"))


def _k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.purged_k_fold(spans(spark, sf_dir), 3)


def _k_fold_embargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = spans(spark, sf_dir).select(F.col("event_ends").alias("datetime")).distinct()
    return events.purged_k_fold(spans(spark, sf_dir), 3, events.embargo_times(months, 0.05))


def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sequential_bootstrap_by_symbol(events.indicators(market.panel(spark, sf_dir), spans(spark, sf_dir)), 20)


def _overfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market.panel(spark, sf_dir).select(F.col("datetime").alias("t"), F.col("symbol").alias("trial"), (F.col("close") / F.col("open") - 1).alias("value"))
    return spark.createDataFrame([(events.overfit_probability(t, 6),)], "probability double")


_QUERIES = {
    "ev_zigzag": _panel(lambda p: events.zigzag(p, 0.5)), "ev_labels": _panel(lambda p: events.labels(p, threshold=0.5).select("symbol", "datetime", "event_ends", "label", "count_index")),
    "ev_labels_stop_loss": _panel(lambda p: events.labels(p, threshold=0.5, stop_loss=0.3).select("symbol", "datetime", "event_ends", "label", "count_index")),
    "ev_forward_returns": _panel(lambda p: events.forward_returns(p, 1, 4).select("symbol", "datetime", "label_1", "label_2", "label_3")),
    "ev_concurrency": _weights(lambda p, e: events.concurrency(p, e)), "ev_uniqueness": _weights(events.average_uniqueness), "ev_return_weights": _weights(events.return_weights),
    "ev_indicators": _weights(events.indicators), "ev_label_uniqueness": _weights(events.label_uniqueness), "ev_time_decay": _decayed,
    "ev_purged_k_fold": _k_fold, "ev_embargoed_k_fold": _k_fold_embargo, "ev_combinatorial_purged": lambda s, d: events.combinatorial_purged(spans(s, d), 4, 2),
    "ev_embargo": lambda s, d: events.embargo_times(market.panel(s, d).select("datetime").distinct(), 0.05), "ev_bootstrap": _bootstrap, "ev_overfit": _overfit,
    "ev_bet_size": _panel(lambda p: p.select("symbol", "datetime", events.bet_size(F.col("low") / F.col("high")).alias("bet"))),
    "ev_sharpe": _panel(lambda p: p.groupBy("symbol").agg(events.sharpe(F.col("close") / F.col("open") - 1).alias("sharpe"), events.negative_mse(F.col("open"), F.col("close")).alias("negative_mse"), events.pinball(F.col("open"), F.col("close"), 0.9).alias("pinball"))),
    "ev_minmax": _panel(lambda p: events.scaled(p.select("symbol", "datetime", "volume"), ["volume"], "minmax")), "ev_standard": _panel(lambda p: events.scaled(p.select("symbol", "datetime", "volume"), ["volume"], "standard")),
    "eval_three_sigma": _frame(lambda f: evaluate.extremes(f, "three_sigma", ["f1"], 2.0).select("symbol", "datetime", "f1_low", "f1_high", "f1_clip")),
    "eval_mad": _frame(lambda f: evaluate.extremes(f, "mad", ["f1"], 2.0).select("symbol", "datetime", "f1_low", "f1_high", "f1_clip")),
    "eval_quantile": _frame(lambda f: evaluate.extremes(f, "quantile", ["f1"], low=0.1, high=0.9).select("symbol", "datetime", "f1_low", "f1_high", "f1_clip")),
    "eval_zscore": _frame(lambda f: evaluate.scale(f, "zscore", ["f1"]).select("symbol", "datetime", "f1_zscore")), "eval_robust": _frame(lambda f: evaluate.scale(f, "robust", ["f1"]).select("symbol", "datetime", "f1_robust")),
    "eval_minmax": _frame(lambda f: evaluate.scale(f, "minmax", ["f1"]).select("symbol", "datetime", "f1_minmax")),
    "eval_ic": _frame(lambda f: evaluate.information_coefficients(f, "f1", "label_1")), "eval_rank_ic": _frame(lambda f: evaluate.information_coefficients(f, "f1", "label_1", "spearman")),
    "eval_ic_summary": _frame(lambda f: evaluate.ic_summary(evaluate.information_coefficients(f, "f1", "label_1"))), "eval_multi_period_ic": _frame(lambda f: evaluate.multi_period_ic(f, "f1", 1, 4)),
    "eval_groups": _frame(lambda f: evaluate.group_returns(f, "f1", "label_1")), "eval_monthly_heat": _frame(lambda f: evaluate.monthly_heat(evaluate.information_coefficients(f, "f1", "label_1"))),
    "eval_autocorr": _frame(lambda f: evaluate.autocorrelation(f, "f1")), "eval_turnover": _frame(lambda f: evaluate.turnover(f, "f1")),
    "eval_corr_matrix": _frame(lambda f: evaluate.correlation_matrix(f, ["f1", "f2", "f3"])), "eval_screen": _frame(lambda f: evaluate.screen(f, ["f1", "f2", "f3"], "label_1", 0.9)),
    "eval_qq": _frame(lambda f: evaluate.normal_quantile_points(f, "f1")),
    "eval_cross_events": _frame(lambda f: f.withColumn("prev", F.lag("f1").over(Window.partitionBy("symbol").orderBy("datetime"))).where("f1 > 1 AND prev < 1").select("symbol", "datetime", "f1")),
}

_E = """e AS (SELECT o_orderkey AS event_id, o_custkey % 50 AS symbol, date_trunc('month', o_orderdate)::DATE AS event_starts,
  (date_trunc('month', o_orderdate) + INTERVAL 3 MONTH)::DATE AS event_ends FROM orders)"""
_O = "(PARTITION BY symbol ORDER BY datetime)"
_BASE = f"""WITH {sql.PANEL}, {_E}, cells AS (SELECT event_id, p.symbol, datetime FROM panel p JOIN e ON p.symbol = e.symbol AND datetime BETWEEN event_starts AND event_ends),
n AS (SELECT symbol, datetime, count(*) AS n FROM cells GROUP BY ALL),
u AS (SELECT event_id, avg(1.0::DOUBLE / n) AS uniqueness FROM cells JOIN n USING (symbol, datetime) GROUP BY event_id)"""
_F = f"""WITH {sql.PANEL}, f AS (SELECT *, "close" / open - 1 AS f1, high / low AS f3, CASE WHEN count(volume) OVER w = 3 THEN volume / avg(volume) OVER w END AS f2,
  lead("close", 1) OVER o / "close" - 1 AS label_1, lead("close", 2) OVER o / "close" - 1 AS label_2, lead("close", 3) OVER o / "close" - 1 AS label_3
  FROM panel WINDOW o AS {_O}, {sql.window(3)})"""


def _corr(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def _rank(x: str) -> str:
    return f"rank() OVER (PARTITION BY datetime ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY datetime, {x}) - 1) / 2.0::DOUBLE"


def _bounds(low: str, high: str) -> str:
    return f"{_F}, b AS (SELECT *, {low} AS f1_low, {high} AS f1_high FROM f) SELECT symbol, datetime, f1_low, f1_high, least(greatest(f1, f1_low), f1_high) AS f1_clip FROM b"


def oracle_sql() -> dict[str, str]:
    day = "OVER (PARTITION BY datetime)"
    few = f"WITH {_E}, o AS (SELECT *, row_number() OVER (ORDER BY event_starts, event_id) - 1 AS i, count(*) OVER () AS n FROM e)"
    fold = f"{few}, d AS (SELECT *, CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE n % 3 + (i - (n % 3) * (n // 3 + 1)) // (n // 3) END::INT AS fold FROM o)"
    combos = "c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS combination, a, b FROM (SELECT unnest([0, 1, 2, 3]) AS a), (SELECT unnest([0, 1, 2, 3]) AS b) WHERE a < b)"
    groups = [f"group_{g}" for g in range(1, 6)]
    whole = "OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING)"
    mad = f"{_F}, m AS (SELECT *, median(f1) {day} AS m FROM f), s AS (SELECT *, median(abs(f1 - m)) {day} AS s FROM m)"
    raw: dict[str, tuple[str, tuple[str, ...]]] = {
        "ev_forward_returns": (f"{_F} SELECT symbol, datetime, label_1, label_2, label_3 FROM f", ("label_1", "label_2", "label_3")),
        "ev_concurrency": (f"{_BASE} SELECT p.symbol, p.datetime, coalesce(n, 0)::BIGINT AS n_events FROM panel p LEFT JOIN n USING (symbol, datetime)", ()),
        "ev_uniqueness": (f"{_BASE} SELECT e.event_id, uniqueness FROM e LEFT JOIN u USING (event_id)", ("uniqueness",)),
        "ev_return_weights": (
            f"""{_BASE}, r AS (SELECT symbol, datetime, ln("close" / lag("close") OVER {_O}) AS r FROM panel),
s AS (SELECT e.event_id, abs(coalesce(sum(r / n), 0)) AS raw FROM e LEFT JOIN cells USING (event_id) LEFT JOIN r ON r.symbol = cells.symbol AND r.datetime = cells.datetime LEFT JOIN n ON n.symbol = cells.symbol AND n.datetime = cells.datetime GROUP BY e.event_id)
SELECT event_id, raw * count(*) OVER () / sum(raw) OVER () AS weight FROM s""", ("weight",),
        ),
        "ev_indicators": (f"{_BASE} SELECT event_id, symbol, datetime FROM cells", ()),
        "ev_label_uniqueness": (f"{_BASE} SELECT event_id, symbol, datetime, 1.0::DOUBLE / n AS uniqueness FROM cells JOIN n USING (symbol, datetime)", ("uniqueness",)),
        "ev_time_decay": (
            f"{_BASE}, c AS (SELECT event_id, sum(uniqueness) OVER (ORDER BY event_starts, event_id ROWS UNBOUNDED PRECEDING) AS upto, sum(uniqueness) OVER () AS total FROM u JOIN e USING (event_id)) "
            "SELECT event_id, greatest(0, 1 - 0.5::DOUBLE / total * total + 0.5::DOUBLE / total * upto) AS decay FROM c", ("decay",),
        ),
        "ev_purged_k_fold": (
            f"{fold} SELECT fold, event_id, 'test' AS part FROM d UNION ALL SELECT k::INT, event_id, 'train' FROM d a, (SELECT unnest([0, 1, 2]) AS k) WHERE a.fold <> k "
            "AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT fold, event_starts, event_ends FROM d) b WHERE b.fold = k AND a.event_starts <= b.event_ends AND b.event_starts <= a.event_ends)", (),
        ),
        "ev_embargoed_k_fold": (
            f"{fold}, t AS (SELECT DISTINCT event_ends FROM e), k AS (SELECT event_ends, row_number() OVER (ORDER BY event_ends) AS i, count(*) OVER () AS n, max(event_ends) OVER () AS z FROM t), "
            "g AS (SELECT a.event_ends, coalesce(b.event_ends, a.z) AS embargo_ends FROM k a LEFT JOIN k b ON b.i = a.i + floor(a.n * 0.05)), "
            "x AS (SELECT DISTINCT fold, event_starts, embargo_ends FROM d JOIN g USING (event_ends)) "
            "SELECT fold, event_id, 'test' AS part FROM d UNION ALL SELECT k::INT, event_id, 'train' FROM d a, (SELECT unnest([0, 1, 2]) AS k) WHERE a.fold <> k "
            "AND NOT EXISTS (SELECT 1 FROM x b WHERE b.fold = k AND a.event_starts <= b.embargo_ends AND b.event_starts <= a.event_ends)", (),
        ),
        "ev_combinatorial_purged": (
            f"{few}, d AS (SELECT *, (i // (n // 4))::INT AS fold FROM o WHERE i < n // 4 * 4), {combos} "
            "SELECT combination::INT AS combination, event_id, 'test' AS part FROM c, d WHERE fold IN (a, b) UNION ALL SELECT combination::INT, x.event_id, 'train' FROM c, d x WHERE x.fold NOT IN (a, b) "
            "AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT fold, event_starts, event_ends FROM d) y WHERE y.fold IN (a, b) AND x.event_starts <= y.event_ends AND y.event_starts <= x.event_ends)", (),
        ),
        "ev_embargo": (
            f"WITH {sql.PANEL}, t AS (SELECT DISTINCT datetime FROM panel), k AS (SELECT *, row_number() OVER (ORDER BY datetime) AS i, count(*) OVER () AS n, max(datetime) OVER () AS z FROM t) "
            "SELECT a.datetime, coalesce(b.datetime, a.z) AS embargo_ends FROM k a LEFT JOIN k b ON b.i = a.i + floor(a.n * 0.05)", (),
        ),
        "ev_sharpe": (
            f"WITH {sql.PANEL} SELECT symbol, avg(\"close\" / open - 1) / nullif(stddev_pop(\"close\" / open - 1), 0) AS sharpe, -avg((open - \"close\") ** 2) AS negative_mse, avg(greatest(0.9::DOUBLE * (\"close\" - open), (0.9::DOUBLE - 1) * (\"close\" - open))) AS pinball FROM panel GROUP BY symbol",
            ("sharpe", "negative_mse", "pinball"),
        ),
        "ev_minmax": (f"WITH {sql.PANEL} SELECT symbol, datetime, (volume - min(volume) OVER ()) / nullif(max(volume) OVER () - min(volume) OVER (), 0) AS volume FROM panel", ("volume",)),
        "ev_standard": (f"WITH {sql.PANEL} SELECT symbol, datetime, (volume - avg(volume) OVER ()) / nullif(stddev_pop(volume) OVER (), 0) AS volume FROM panel", ("volume",)),
        "eval_three_sigma": (_bounds(f"avg(f1) {day} - 2 * stddev_samp(f1) {day}", f"avg(f1) {day} + 2 * stddev_samp(f1) {day}"), ("f1_low", "f1_high", "f1_clip")),
        "eval_mad": (f"{mad} SELECT symbol, datetime, m - 2 * s AS f1_low, m + 2 * s AS f1_high, least(greatest(f1, m - 2 * s), m + 2 * s) AS f1_clip FROM s", ("f1_low", "f1_high", "f1_clip")),
        "eval_quantile": (_bounds(f"quantile_cont(f1, 0.1) {day}", f"quantile_cont(f1, 0.9) {day}"), ("f1_low", "f1_high", "f1_clip")),
        "eval_zscore": (f"{_F} SELECT symbol, datetime, (f1 - avg(f1) {day}) / nullif(stddev_samp(f1) {day}, 0) AS f1_zscore FROM f", ("f1_zscore",)),
        "eval_robust": (f"{mad} SELECT symbol, datetime, (f1 - m) / nullif(s, 0) AS f1_robust FROM s", ("f1_robust",)),
        "eval_minmax": (f"{_F} SELECT symbol, datetime, (f1 - min(f1) {day}) / nullif(max(f1) {day} - min(f1) {day}, 0) AS f1_minmax FROM f", ("f1_minmax",)),
        "eval_ic": (f"{_F} SELECT datetime, {_corr('f1', 'label_1')} AS ic, count(*) AS n FROM f WHERE label_1 IS NOT NULL GROUP BY datetime", ("ic",)),
        "eval_rank_ic": (f"{_F}, r AS (SELECT datetime, {_rank('f1')} AS x, {_rank('label_1')} AS y FROM f WHERE label_1 IS NOT NULL) SELECT datetime, {_corr('x', 'y')} AS ic, count(*) AS n FROM r GROUP BY datetime", ("ic",)),
        "eval_multi_period_ic": (
            f"{_F}, l AS ({' UNION ALL '.join(f'SELECT {i} AS period, datetime, f1, label_{i} AS y FROM f WHERE label_{i} IS NOT NULL' for i in (1, 2, 3))}), "
            f"c AS (SELECT period, datetime, {_corr('f1', 'y')} AS ic FROM l GROUP BY ALL) SELECT period, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std FROM c GROUP BY period", ("ic_mean", "ic_std"),
        ),
        "eval_groups": (
            f"{_F}, k AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY f1 DESC, symbol) - 1 AS k, count(*) {day} // 5 AS m FROM f WHERE label_1 IS NOT NULL), "
            f"g AS (SELECT datetime, {', '.join(f'avg(label_1) FILTER (k // m = {i}) AS group_{i + 1}' for i in range(5))}, avg(label_1) AS average FROM k WHERE m > 0 GROUP BY datetime), "
            f"l AS (SELECT *, (group_1 - group_5) / 2 AS long_short, group_1 - average AS long_average FROM g) "
            f"SELECT *, {', '.join(f'sum({c}) {whole} AS cum_{c}' for c in (*groups, 'long_short', 'long_average'))} FROM l",
            (*groups, "average", "long_short", "long_average", *(f"cum_{c}" for c in (*groups, "long_short", "long_average"))),
        ),
        "eval_monthly_heat": (
            f"{_F}, c AS (SELECT datetime, {_corr('f1', 'label_1')} AS ic FROM f WHERE label_1 IS NOT NULL GROUP BY datetime) "
            f"SELECT year(datetime)::INT AS year, {', '.join(f'avg(ic) FILTER (month(datetime) = {i}) AS m{i}' for i in range(1, 13))} FROM c GROUP BY 1", tuple(f"m{i}" for i in range(1, 13)),
        ),
        "eval_autocorr": (
            f"{_F}, p AS (SELECT *, lag(f1) OVER {_O} AS g FROM f), r AS (SELECT datetime, ({_rank('f1')}) / count(f1) {day} AS x, CASE WHEN g IS NOT NULL THEN ({_rank('g')}) / count(g) {day} END AS y FROM p) "
            f"SELECT datetime, covar_samp(x, y) / nullif(stddev_samp(CASE WHEN y IS NOT NULL THEN x END) * stddev_samp(y), 0) AS autocorr FROM r GROUP BY datetime", ("autocorr",),
        ),
        "eval_turnover": (
            f"{_F}, p AS (SELECT symbol, datetime, f1, lag(f1) OVER {_O} AS g FROM f), k AS (SELECT *, count(*) {day} // 5 AS m, row_number() OVER (PARTITION BY datetime ORDER BY f1 DESC, symbol) AS t0, "
            "row_number() OVER (PARTITION BY datetime ORDER BY g DESC, symbol) AS t1, row_number() OVER (PARTITION BY datetime ORDER BY f1, symbol) AS b0, row_number() OVER (PARTITION BY datetime ORDER BY g, symbol) AS b1 FROM p WHERE g IS NOT NULL) "
            "SELECT datetime, 1 - count(*) FILTER (t0 <= m AND t1 <= m)::DOUBLE / max(m) AS top, 1 - count(*) FILTER (b0 <= m AND b1 <= m)::DOUBLE / max(m) AS bottom FROM k WHERE m > 0 GROUP BY datetime", ("top", "bottom"),
        ),
        "eval_corr_matrix": (
            f"{_F} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0) AS corr FROM f" for a, b in (("f1", "f2"), ("f1", "f3"), ("f2", "f3"))), ("corr",),
        ),
        "eval_cross_events": (f"{_F}, p AS (SELECT *, lag(f1) OVER {_O} AS prev FROM f) SELECT symbol, datetime, f1 FROM p WHERE f1 > 1 AND prev < 1", ("f1",)),
    }
    return {k: sql.rounded(q, *c) for k, (q, c) in raw.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
