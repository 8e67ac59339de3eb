"""Queries of line measures, signals, further indicators and checks around models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom import sql
from tapeloom.functions import safe
from tapeloom.operators import events, features, lines, recurrences, signals, structure
from tapeloom.plans.registry import Panel
from tapeloom.sources import market

N, PERIODS = 5, (1, 3, 6)


def spans(p: DataFrame, unit: str) -> DataFrame:
    """A line for each of a symbol's calendar units, from its first bar's close to its last bar's."""
    made = p.groupBy("symbol", F.trunc("datetime", unit).alias("u")).agg(
        F.min("datetime").alias("start_at"), F.max("datetime").alias("end_at"), F.min_by("close", "datetime").alias("start_value"), F.max_by("close", "datetime").alias("end_value"), F.count("*").alias("n"),
    )
    own = Window.partitionBy("symbol").orderBy("u")
    high, low = F.greatest("start_value", "end_value"), F.least("start_value", "end_value")
    return made.withColumns({"id": F.row_number().over(own), "high": high, "low": low, "up": F.col("end_value") > F.col("start_value")}).drop("u")


def finished(p: DataFrame, unit: str) -> DataFrame:
    """The lines of ``spans`` without each symbol's last, which bars to come may still move."""
    return spans(p, unit).withColumn("_last", F.max("id").over(Window.partitionBy("symbol"))).where("id < _last").drop("_last")


def _shared(p: DataFrame) -> DataFrame:
    own = Window.partitionBy("symbol").orderBy("id")
    before = lambda c: F.lag(c).over(own)
    at = spans(p, "year").withColumn("x", lines.shared(F.col("high"), F.col("low"), before("high"), before("low")))
    return at.select("symbol", "id", F.col("x.high").alias("high"), F.col("x.low").alias("low"))


def _moved(p: DataFrame) -> DataFrame:
    return p.withColumn("move", F.col("close") - F.col("open"))


def _levels(p: DataFrame) -> DataFrame:
    low = spans(p, "quarter")
    return lines.levels(spans(p, "year"), low, structure.line_power(low, _moved(p), "move"))


def _power(p: DataFrame) -> DataFrame:
    return lines.fractal_power(structure.structure(p, "old"), p)


def _means(p: DataFrame) -> DataFrame:
    return p.withColumns({"fast": F.avg("close").over(Panel().last(2)), "slow": F.avg("close").over(Panel().last(6))})


def _base(p: DataFrame) -> DataFrame:
    return p.groupBy("datetime").agg(F.sum("money").alias("m"), F.sum("volume").alias("v")).select("datetime", (F.col("m") / F.col("v")).alias("close"))


def _changes(p: DataFrame) -> Callable[..., DataFrame]:
    own = Panel().past()
    ahead = safe.ratio(F.lead("close").over(own), F.col("close")) - 1
    return lambda period: p.select("symbol", "datetime", (safe.ratio(F.col("close"), F.lag("close", period).over(own)) - 1).alias("x"), ahead.alias("y"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a label and a made-up score in [0, 1)."""
    o = market.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"), (F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 1000).alias("proba"))


def _majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = [F.pmod(F.col("o_orderkey") * k, F.lit(100)) / 100 for k in (7, 31, 57)]
    return _scored(spark, sf_dir).select("o_orderkey", signals.majority(votes).alias("vote"))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [F.array(*(F.pmod(F.col("o_orderkey") * k + i, F.lit(16)) / 16 for i in range(2))) for k in (3, 7)]
    return _scored(spark, sf_dir).select("o_orderkey", *(c.alias(k) for k, c in signals.meta_label(models, F.col("label")).items()))


def _l1(t: DataFrame) -> DataFrame:
    return t.groupBy("symbol", "ts").agg(F.min("price").alias("p")).select("symbol", "ts", (F.col("p") - 1).alias("bid"), (F.col("p") + 1).alias("ask"))


def _ticks(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql.singles(f(market.ticks(spark, sf_dir)))


def _panel(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql.singles(f(market.panel(spark, sf_dir)))


_QUERIES = {
    "line_bounds": _panel(lambda p: lines.bounds(spans(p, "year"), p, "open")), "line_anchored_vwap": _panel(lambda p: lines.anchored_vwap(finished(p, "year"), p)),
    "line_angle": _panel(lambda p: spans(p, "year").select("symbol", "id", lines.angle(F.col("start_value"), F.col("end_value"), F.col("n") - 1).alias("angle"))),
    "line_shared": _panel(_shared), "line_crossings": _panel(lambda p: lines.crossings_within(spans(p, "year"), p, "open", "close")),
    "line_zero_crossings": _panel(lambda p: lines.crossings_within(spans(p, "year"), _moved(p), "move")), "line_channel": _panel(lambda p: lines.channel(finished(p, "quarter"), p, 6)),
    "line_inside": _panel(lambda p: lines.inside(spans(p, "year"), spans(p, "quarter")).select("symbol", "upper_id", "id")), "line_levels": _panel(_levels),
    "chan_fractal_power": _panel(_power), "chan_paused": _panel(lambda p: lines.paused(structure.structure(p, "any"), p)),
    "chan_zone_ratio": _panel(lambda p: structure.zone_ratio(structure.structure(p, "any").where("kind = 'zone'"))),
    "sig_crossover": _panel(lambda p: signals.crossovers(_means(p), "fast", "slow", 12)), "sig_pair_residual": _panel(lambda p: signals.pair_residuals(p, _base(p), 6)),
    "sig_market_structure": _panel(lambda p: signals.market_structure(p, 2)), "sig_equal_swings": _panel(lambda p: signals.equal_swings(features.peaks(p, 2), F.col("price") * 0.01)),
    "feat_macd": _panel(lambda p: recurrences.run(p, recurrences.macd(3, 6, 4))), "feat_vidya": _panel(lambda p: recurrences.run(p, recurrences.vidya(N))),
    "feat_kvo": _panel(lambda p: recurrences.run(p, recurrences.kvo(3, 6))),
    "line_macd_crossings": _panel(lambda p: lines.crossings_within(spans(p, "year"), recurrences.run(p, recurrences.macd(3, 6, 4)), "dif", "dem")),
    "feat_oscillators": _panel(lambda p: signals.oscillators(p, N)), "quote_spreads": _ticks(lambda t: signals.spreads(_l1(t), 20)),
    "eval_range_breaks": _ticks(lambda t: signals.range_breaks(t.select("symbol", F.date_trunc("day", "ts").alias("datetime")))),
    "eval_in_out": _panel(lambda p: signals.in_out_correlation(_changes(p)(1), "x", "y")), "eval_parameter_grid": _panel(lambda p: signals.parameter_grid(_changes(p), {"period": PERIODS}, "x", "y", least_rows=10)),
    "ev_top_share": lambda s, d: signals.top_share(_scored(s, d), "proba", 0.3, "o_orderkey"), "ev_relabelled": lambda s, d: signals.relabelled(_scored(s, d), 0.3, "o_orderkey"),
    "ev_majority": _majority, "ev_meta_label": _meta,
    "ev_rare_labels": lambda s, d: events.rare_labels_dropped(market.table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label")), 0.1),
    "agg_value_counts": lambda s, d: market.table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy())),
    "sort_union": lambda s, d: market.table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(market.table(s, d, "supplier").select("s_nationkey")),
    "sort_except": lambda s, d: market.table(s, d, "customer").select("c_custkey").exceptAll(market.table(s, d, "orders").select("o_custkey").distinct()),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def _spans(unit: str, name: str) -> str:
    return f"""{name}0 AS (SELECT symbol, date_trunc('{unit}', datetime) AS u, min(datetime) AS start_at, max(datetime) AS end_at, arg_min("close", datetime) AS start_value, arg_max("close", datetime) AS end_value, count(*) AS n
  FROM panel GROUP BY ALL),
{name} AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY u))::INT AS id, greatest(start_value, end_value) AS high, least(start_value, end_value) AS low, end_value > start_value AS up FROM {name}0)"""


def oracle_sql() -> dict[str, str]:
    p, o = f"WITH {sql.PANEL}", "(PARTITION BY symbol ORDER BY datetime)"
    year, quarter = _spans("year", "y"), _spans("quarter", "q")
    last = "SELECT * FROM {0} QUALIFY id < max(id) OVER (PARTITION BY symbol)"
    bars = "FROM panel b JOIN y ON b.symbol = y.symbol AND datetime BETWEEN start_at AND end_at"
    inside = f"""{p}, {year}, {quarter}, j AS (SELECT y.symbol, y.id AS upper_id, y.up AS way, q.id, q.up, q.high, q.low, q.start_at, q.end_at FROM y JOIN q ON y.symbol = q.symbol AND q.end_at >= y.start_at AND q.start_at <= y.end_at),
i AS (SELECT * FROM j QUALIFY id BETWEEN min(CASE WHEN up = way THEN id END) OVER (PARTITION BY symbol, upper_id) AND max(CASE WHEN up = way THEN id END) OVER (PARTITION BY symbol, upper_id))"""
    orders = "o AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS label, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS proba FROM orders)"
    top = f"WITH {orders}, t AS (SELECT *, row_number() OVER (ORDER BY proba DESC, o_orderkey) <= floor(0.3 * count(*) OVER ()) AS top FROM o)"
    crossings = lambda a, b: (
        f"""{p}, {year}, j AS (SELECT b.symbol, id, datetime, {a} AS x, {b} AS z {bars}), k AS (SELECT *, lag(x) OVER i AS x1, lag(z) OVER i AS z1 FROM j WINDOW i AS (PARTITION BY symbol, id ORDER BY datetime))
SELECT symbol, id, count(*) FILTER (x1 < z1 AND x > z) AS ups, count(*) FILTER (x1 > z1 AND x < z) AS downs FROM k GROUP BY symbol, id"""
    )
    change = lambda k: f"""SELECT {k} AS period, symbol, datetime, "close" / lag("close", {k}) OVER o - 1 AS x, lead("close") OVER o / "close" - 1 AS y FROM panel WINDOW o AS {o}"""
    both = """covar_samp(x, y) FILTER ({0}) / nullif((stddev_samp(x) FILTER ({0} AND y IS NOT NULL)) * (stddev_samp(y) FILTER ({0} AND x IS NOT NULL)), 0)"""
    halves = "e AS (SELECT *, row_number() OVER (PARTITION BY period, symbol ORDER BY datetime) <= floor(0.7 * count(*) OVER (PARTITION BY period, symbol)) AS early FROM c)"
    corrs = f"{both.format('early')} AS in_sample, {both.format('NOT early')} AS out_sample"
    full = lambda v, k=N: f"CASE WHEN count(c1) OVER (PARTITION BY symbol ORDER BY datetime ROWS {k - 1} PRECEDING) = {k} THEN {v} END"
    uo = lambda k: f"(sum(bp) OVER w{k} / nullif(sum(tr) OVER w{k}, 0))"
    # A mean that starts at its first value: the first row has the weight that is left over.
    mean = lambda x, a: f"(SELECT sum(b.{x} * pow(1 - {a}, a.i - b.i) * CASE WHEN b.i = 1 THEN 1 ELSE {a} END) FROM {{0}} b WHERE b.symbol = a.symbol AND b.i <= a.i)"
    dem = "(SELECT sum(b.dif * pow(1 - 2 / 5.0::DOUBLE, a.i - b.i) * (2 / 5.0::DOUBLE)) FROM d b WHERE b.symbol = a.symbol AND b.i <= a.i)"
    macd = f"""{p}, n AS (SELECT *, row_number() OVER {o} AS i FROM panel),
d AS MATERIALIZED (SELECT symbol, datetime, i, {mean('"close"', '(2 / 4.0::DOUBLE)').format('n')} - {mean('"close"', '(2 / 7.0::DOUBLE)').format('n')} AS dif FROM n a), m AS MATERIALIZED (SELECT symbol, datetime, dif, {dem} AS dem FROM d a)"""
    raw: dict[str, tuple[str, tuple[str, ...]]] = {
        "line_bounds": (
            f'{p}, {year} SELECT b.symbol, id, max(b.high) AS top, min(b.low) AS bottom, sum("close" * volume) / sum(volume) AS vwap, max(open) AS high_open, min(open) AS low_open {bars} GROUP BY b.symbol, id',
            ("top", "bottom", "vwap", "high_open", "low_open"),
        ),
        "line_anchored_vwap": (
            f"""{p}, {year}, a AS (SELECT symbol, max(end_at) AS anchor FROM ({last.format('y')}) GROUP BY symbol)
SELECT a.symbol, anchor, sum("close" * volume) FILTER (datetime > anchor) / sum(volume) FILTER (datetime > anchor) AS vwap FROM panel JOIN a ON panel.symbol = a.symbol GROUP BY ALL""", ("vwap",),
        ),
        "line_angle": (f"{p}, {year} SELECT symbol, id, degrees(atan((end_value - start_value) / start_value / nullif(n - 1, 0))) AS angle FROM y", ("angle",)),
        "line_shared": (
            f"""{p}, {year}, k AS (SELECT symbol, id, least(high, lag(high) OVER i) AS high, greatest(low, lag(low) OVER i) AS low, lag(id) OVER i AS before FROM y WINDOW i AS (PARTITION BY symbol ORDER BY id))
SELECT symbol, id, CASE WHEN before IS NOT NULL AND high >= low THEN high ELSE CASE WHEN before IS NULL THEN high END END AS high, CASE WHEN before IS NULL OR high >= low THEN low END AS low FROM k""", ("high", "low"),
        ),
        "line_crossings": (crossings("open", '"close"'), ()), "line_zero_crossings": (crossings('"close" - open', "0"), ()),
        "feat_macd": (f"{macd} SELECT *, dif - dem AS histogram FROM m", ("dif", "dem", "histogram")),
        "line_macd_crossings": (
            f"""{macd}, {year}, j AS (SELECT b.symbol, id, datetime, dif AS x, dem AS z {bars.replace('panel', 'm')}), k AS (SELECT *, lag(x) OVER i AS x1, lag(z) OVER i AS z1 FROM j WINDOW i AS (PARTITION BY symbol, id ORDER BY datetime))
SELECT symbol, id, count(*) FILTER (x1 < z1 AND x > z) AS ups, count(*) FILTER (x1 > z1 AND x < z) AS downs FROM k GROUP BY symbol, id""", (),
        ),
        "line_inside": (f"{inside} SELECT symbol, upper_id, id FROM i", ()),
        "line_levels": (
            f"""{inside}, w AS (SELECT i.symbol, i.upper_id, i.id, sum(abs(b."close" - b.open)) AS total FROM i JOIN panel b ON b.symbol = i.symbol AND b.datetime BETWEEN i.start_at AND i.end_at GROUP BY ALL),
k AS (SELECT i.*, CASE WHEN up THEN i.high > lag(i.high, 2) OVER g AND i.low > lag(i.low, 2) OVER g ELSE i.high < lag(i.high, 2) OVER g AND i.low < lag(i.low, 2) OVER g END AND total < lag(total, 2) OVER g AS d
  FROM i JOIN w USING (symbol, upper_id, id) WINDOW g AS (PARTITION BY i.symbol, i.upper_id ORDER BY i.id))
SELECT symbol, upper_id, count(*) AS n_lines, max(id) AS last_id, arg_max(coalesce(d, false), id) AS line_divergence FROM k GROUP BY symbol, upper_id""", (),
        ),
        "line_channel": (
            f"""{p}, {quarter}, r AS ({last.format('q')}), b AS (SELECT symbol, datetime, "close", row_number() OVER {o} AS i, lag("close") OVER {o} AS prior FROM panel),
e AS (SELECT q.*, b.i FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY id DESC) <= 6 AND count(*) OVER (PARTITION BY symbol) >= 6) q JOIN b ON b.symbol = q.symbol AND b.datetime = q.end_at),
f0 AS (SELECT symbol, regr_slope(high, i) FILTER (up) AS us, regr_intercept(high, i) FILTER (up) AS ui, regr_slope(low, i) FILTER (NOT up) AS ds, regr_intercept(low, i) FILTER (NOT up) AS di FROM e GROUP BY symbol),
f AS (SELECT symbol, if(isnan(us), NULL, us) AS us, if(isnan(us), NULL, ui) AS ui, if(isnan(ds), NULL, ds) AS ds, if(isnan(ds), NULL, di) AS di FROM f0),
l AS (SELECT f.*, b.i, b."close" AS c, b.prior, ui + us * b.i AS u, di + ds * b.i AS d FROM f JOIN b ON b.symbol = f.symbol QUALIFY row_number() OVER (PARTITION BY f.symbol ORDER BY datetime DESC) = 1)
SELECT symbol, us AS up_slope, u AS upper, ds AS down_slope, d AS lower, CASE WHEN us > 0 AND us < ds AND d < u AND prior > d AND c < d THEN -1 WHEN ds < 0 AND ds > us AND d < u AND prior < u AND c > u THEN 1 ELSE 0 END AS signal FROM l""",
            ("up_slope", "upper", "down_slope", "lower"),
        ),
        "sig_crossover": (
            f"""{p}, m AS (SELECT symbol, datetime, avg("close") OVER (PARTITION BY symbol ORDER BY datetime ROWS 1 PRECEDING) AS f, avg("close") OVER (PARTITION BY symbol ORDER BY datetime ROWS 5 PRECEDING) AS s, row_number() OVER {o} AS i FROM panel),
k AS (SELECT *, lag(f) OVER {o} AS f1, lag(s) OVER {o} AS s1 FROM m) SELECT symbol, datetime, CASE WHEN i <= 12 THEN 0 WHEN f1 < s1 AND f > s THEN 1 WHEN f1 > s1 AND f < s THEN -1 ELSE 0 END AS cross FROM k""", (),
        ),
        "sig_pair_residual": (
            f"""{p}, m AS (SELECT datetime, sum(money) / sum(volume) AS b FROM panel GROUP BY 1),
k AS (SELECT symbol, datetime, "close" / lag("close", 6) OVER o - 1 AS change, b / lag(b, 6) OVER o - 1 AS base_change FROM panel JOIN m USING (datetime) WINDOW o AS {o}),
g AS (SELECT * FROM k WHERE change IS NOT NULL AND base_change IS NOT NULL), f AS (SELECT symbol, regr_slope(change, base_change) AS s, regr_intercept(change, base_change) AS c FROM g GROUP BY symbol),
r AS (SELECT g.*, change - (c + s * base_change) AS e FROM g JOIN f USING (symbol))
SELECT symbol, datetime, change, base_change, abs((e - avg(e) OVER (PARTITION BY symbol)) / nullif(stddev_pop(e) OVER (PARTITION BY symbol), 0)) AS residual FROM r""", ("change", "base_change", "residual"),
        ),
        "sig_market_structure": (
            f"""{p}, k AS (SELECT *, count(*) OVER w = 5 AS whole, max(high) OVER w AS mh, min(low) OVER w AS ml, lag(high, 2) OVER {o} AS h2, lag(low, 2) OVER {o} AS l2 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY datetime ROWS 4 PRECEDING)),
s AS (SELECT symbol, datetime, "close" AS c, CASE WHEN whole AND mh = h2 THEN h2 END AS t, CASE WHEN whole AND ml = l2 THEN l2 END AS b FROM k),
h AS (SELECT *, last_value(t IGNORE NULLS) OVER a AS th, last_value(b IGNORE NULLS) OVER a AS bh, last_value(t IGNORE NULLS) OVER z AS tp, last_value(b IGNORE NULLS) OVER z AS bp, count(t) OVER a AS nt, count(b) OVER a AS nb FROM s
  WINDOW a AS (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, min(CASE WHEN c > th THEN datetime END) OVER (PARTITION BY symbol, nt) = datetime AS u, min(CASE WHEN c < bh THEN datetime END) OVER (PARTITION BY symbol, nb) = datetime AS d FROM h),
w AS (SELECT *, CASE WHEN u THEN 1 WHEN d THEN -1 END AS way FROM g), v AS (SELECT *, last_value(way IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
SELECT symbol, datetime, CASE WHEN t IS NOT NULL THEN CASE WHEN t > coalesce(tp, 0) THEN 'HH' ELSE 'LH' END WHEN b IS NOT NULL THEN CASE WHEN b < coalesce(bp, 0) THEN 'LL' ELSE 'HL' END END AS swing,
  CASE way WHEN 1 THEN 'up ' WHEN -1 THEN 'down ' END || CASE WHEN before <> way THEN 'CHoCH' ELSE 'BOS' END AS "break" FROM v""", (),
        ),
        "sig_equal_swings": (
            f"""{p}, k AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS t, min(low) OVER w AS b FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s AS (SELECT symbol, datetime, CASE WHEN high = t THEN 1 ELSE -1 END AS indicator, CASE WHEN high = t THEN high ELSE low END AS price FROM k WHERE n = 5 AND (high = t OR low = b))
SELECT *, coalesce(abs(price - lag(price) OVER (PARTITION BY symbol, indicator ORDER BY datetime)) < price * 0.01::DOUBLE, false) AS equal FROM s""", ("price",),
        ),
        "feat_oscillators": (
            f"""{p}, k AS (SELECT *, row_number() OVER {o} AS i, lag("close") OVER {o} AS c1, stddev_pop("close") OVER (PARTITION BY symbol ORDER BY datetime ROWS {N - 1} PRECEDING) AS sd FROM panel),
m AS (SELECT *, "close" - least(low, c1) AS bp, greatest(high, c1) - least(low, c1) AS tr, coalesce((2 * "close" - high - low) / nullif(high - low, 0) * volume, 0) AS flow FROM k)
SELECT symbol, datetime, {full(f'100 * (4 * {uo(N)} + 2 * {uo(2 * N)} + {uo(4 * N)}) / 7', 4 * N)} AS uo, {full(f'100 * sum(high - open) OVER w{N} / nullif(sum(open - low) OVER w{N}, 0)')} AS ar,
  {full(f'100 * sum(greatest(high - c1, 0)) OVER w{N} / nullif(sum(greatest(c1 - low, 0)) OVER w{N}, 0)')} AS br, {full(f'100 * ("close" - ((regr_intercept("close", i) OVER w{N}) + (regr_slope("close", i) OVER w{N}) * i)) / "close"')} AS cfo,
  {full(f'(covar_samp("close", i) OVER w{N} / nullif(stddev_samp("close") OVER w{N} * stddev_samp(i) OVER w{N}, 0)) ** 2')} AS r2, {full(f'regr_slope("close", i) OVER w{N}')} AS slope,
  {full(f'100 * sum(CASE WHEN "close" > c1 THEN sd ELSE 0 END) OVER w{N} / nullif(sum(CASE WHEN "close" <> c1 THEN sd ELSE 0 END) OVER w{N}, 0)')} AS rvi,
  {full(f'("close" - avg("close") OVER w{N}) / nullif(avg(tr) OVER w{N}, 0)')} AS pgo, sum(flow) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS ad
FROM m WINDOW {sql.window(N, f'w{N}')}, {sql.window(2 * N, f'w{2 * N}')}, {sql.window(4 * N, f'w{4 * N}')}""", ("uo", "ar", "br", "cfo", "r2", "slope", "rvi", "pgo", "ad"),
        ),
        "quote_spreads": (
            f"""WITH {sql.TICKS}, k AS (SELECT symbol, ts, min(price) AS mid FROM ticks GROUP BY ALL HAVING min(price) > 0)
SELECT symbol, ts, 2 / mid AS relative_spread, abs(mid / first_value(mid) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) - 1) + 2 / mid AS variation FROM k""", ("relative_spread", "variation"),
        ),
        "eval_range_breaks": (
            f"""WITH {sql.TICKS}, k AS (SELECT DISTINCT symbol, date_trunc('day', ts)::TIMESTAMP AS d FROM ticks), g AS (SELECT *, epoch_us(lead(d) OVER (PARTITION BY symbol ORDER BY d)) - epoch_us(d) AS gap FROM k),
l AS (SELECT *, min(gap) OVER (PARTITION BY symbol) AS least FROM g) SELECT symbol, gap - least AS extra_us, make_timestamp(epoch_us(d) + least) AS at FROM l WHERE gap > least""", (),
        ),
        "eval_in_out": (f"{p}, c AS ({change(1)}), {halves} SELECT symbol, {corrs} FROM e GROUP BY symbol", ("in_sample", "out_sample")),
        "eval_parameter_grid": (
            f"""{p}, c0 AS ({' UNION ALL '.join(f'({change(k)})' for k in PERIODS)}), m AS (SELECT *, avg(x) OVER g AS mean, 5 * stddev_samp(x) OVER g AS spread FROM c0 WINDOW g AS (PARTITION BY period, symbol)),
c AS (SELECT period, symbol, datetime, CASE WHEN x IS NOT NULL THEN least(greatest(x, mean - spread), mean + spread) END AS x, y FROM m), {halves}, r AS (SELECT period, symbol, count(*) AS n, {corrs} FROM e GROUP BY period, symbol)
SELECT * FROM r WHERE sign(in_sample) = sign(out_sample) AND n >= 10""", ("in_sample", "out_sample"),
        ),
        "ev_top_share": (f"{top} SELECT * FROM t", ()), "ev_relabelled": (f"{top} SELECT o_orderkey, (CASE WHEN label = 1 THEN top ELSE NOT top END)::INT AS label, proba FROM t", ()),
        "ev_majority": ("SELECT o_orderkey, ((o_orderkey * 7 % 100 > 50)::INT + (o_orderkey * 31 % 100 > 50)::INT + (o_orderkey * 57 % 100 > 50)::INT >= 2)::INT AS vote FROM orders", ()),
        "ev_meta_label": (
            f"""WITH {orders}, m AS (SELECT *, ((o_orderkey * 3 % 16) + (o_orderkey * 7 % 16)) / 32.0::DOUBLE AS a, (((o_orderkey * 3 + 1) % 16) + ((o_orderkey * 7 + 1) % 16)) / 32.0::DOUBLE AS b FROM o)
SELECT o_orderkey, b AS predict_prob, ((b > a)::INT = label)::INT AS label FROM m""", (),
        ),
        "ev_rare_labels": ("SELECT o_orderkey, o_orderstatus AS label FROM orders WHERE o_orderstatus IN (SELECT o_orderstatus FROM orders GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT count(*) FROM orders))", ()),
        "agg_value_counts": ("SELECT o_orderstatus, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS rate FROM orders GROUP BY 1", ()),
        "sort_union": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", ()),
        "sort_except": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", ()),
    }
    return {k: sql.rounded(q, *c) for k, (q, c) in raw.items()}
