"""The factor language, published numbers, invariants of bars and folds, streams against batches, and SQL on the smallest tables."""

import importlib.util

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tapeloom import queries
from tapeloom.catalog import factors
from tapeloom.operators import bars, events, features, quotes, recurrences, structure
from tapeloom.plans.alphas import FORMULAS, alpha
from tapeloom.plans.compile import Plan, evaluate
from tapeloom.plans.expression import ExpressionError, parse
from tapeloom.sources import market
from tapeloom.streaming import stateful

SF = "/root/testdata/sf0.001"
HIGHS = [138.23, 138.49, 138.87, 139.06, 139.28, 139.53, 139.61, 139.68, 139.84, 139.89, 140.17, 140.47, 140.61, 140.72, 141.05, 141.06]
LOWS = [137.41, 137.5, 137.69, 137.79, 137.89, 138.0, 138.09, 138.18, 138.28, 138.38, 138.47, 138.57, 138.67, 138.76, 138.86, 138.96]
VOLUMES = [438.33, 690.89, 1138.94, 1186.38, 1391.53, 1511.03, 1078.97, 1065.64, 1207.42, 1036.27, 1535.06, 1578.72, 1772.86, 1727.96, 1791.76, 1434.92]


@pytest.mark.parametrize(
    ("text", "tree"),
    [("1+2*3", "Add(Constant(1.0),Mul(Constant(2.0),Constant(3.0)))"), ("-$a**2", "Neg(Power(Feature(a),Constant(2.0)))"), ("2**-1", "Power(Constant(2.0),Constant(-1.0))"), ("$a-$b-$c", "Sub(Sub(Feature(a),Feature(b)),Feature(c))"),
     ("$a<$b+1", "Lt(Feature(a),Add(Feature(b),Constant(1.0)))"), ("($a<1)&($b>2)|($c==3)", "Or(And(Lt(Feature(a),Constant(1.0)),Gt(Feature(b),Constant(2.0))),Eq(Feature(c),Constant(3.0)))")],
)
def test_precedence(text, tree):
    assert str(parse(text)) == tree


@pytest.mark.parametrize("text", ["$a<$b<$c", "1+", "f(", "$a and $b", "__import__", "$a $b", "(1", "$a;1"])
def test_rejected(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_shared_parts_are_computed_once(spark):
    plan = Plan({str(n): parse(alpha(n)) for n in FORMULAS})
    assert parse("Mean($a, 3)") is parse("Mean( $a , 3 )")
    assert len(plan.names) < sum(len(Plan({"x": parse(alpha(n))}).names) for n in FORMULAS)


def test_unknown_operator_and_field(spark):
    p = market.panel(spark, SF)
    for text in ("Nope($close)", "Mean($close)", "Mean($close, $open)", "$nothing"):
        with pytest.raises(ExpressionError):
            evaluate(p, {"x": text})


def test_constant_series_correlation_is_null(spark):
    p = spark.createDataFrame([("a", i, 1.0, float(i)) for i in range(6)], "symbol string, datetime int, x double, y double")
    assert {r["c"] for r in evaluate(p, {"c": "Corr($x, $y, 3)"}).collect()} == {None}


def test_null_in_a_window(spark):
    p = spark.createDataFrame([("a", i, None if i == 2 else float(i)) for i in range(6)], "symbol string, datetime int, x double")
    found = evaluate(p, {"full": "Mean($x, 2)", "part": "Rank($x, 3)", "n": "Count($x, 2)"}).orderBy("datetime").collect()
    assert [r["full"] for r in found] == [None, 0.5, None, None, 3.5, 4.5]
    assert found[2]["part"] is None and found[3]["part"] == 1.0 and [r["n"] for r in found][1:] == [2, 1, 1, 2, 2]


def _bars(spark):
    rows = [("a", i, h, lo, h, v) for i, (h, lo, v) in enumerate(zip(HIGHS, LOWS, VOLUMES, strict=True))]
    return spark.createDataFrame(rows, "symbol string, datetime int, high double, low double, close double, volume double")


def test_microstructure_published_numbers(spark):
    r = features.microstructure(_bars(spark), 5).orderBy(F.col("datetime").desc()).first()
    expected = {
        "roll_spread": 0.15962455951389545, "roll_variance": 0.0572299999999844, "high_low_volatility": 0.008682445296228003, "cs_spread": 0.010504, "cs_volatility": 0.002311,
        "kyle_lambda": 0.0001092478534217924, "amihud_lambda": 5.517580116293106e-9, "hasbrouck_lambda": 2.650398114976172e-6, "vpin": 0.8605053721383698,
    }
    for k, v in expected.items():
        assert r[k] == pytest.approx(v, abs=1e-6), k
    assert r["kyle_t"] == pytest.approx(93509.72002350067, rel=1e-6)


def test_entropies_published_numbers(spark):
    p = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "symbol string, datetime int, x double")
    at = p.withColumn("c", features.codes(F.col("x"), 2, 0.0, 1.0)).withColumn("m", features.message(F.col("c"), 8))
    r = at.select(
        "m", features.shannon_entropy(F.col("m")).alias("s"), *(features.plugin_entropy(F.col("m"), w).alias(f"p{w}") for w in (1, 2, 3)), *(features.konto_entropy(w)(F.col("m")).alias(f"k{w}") for w in (0, 1, 2)),
    ).where("m IS NOT NULL").first()
    assert r["s"] == 1.0
    assert [r[f"p{w}"] for w in (1, 2, 3)] == pytest.approx([1.0, 0.9211854965885542, 0.750543055795941])
    assert [r[f"k{w}"] for w in (0, 1, 2)] == pytest.approx([0.9682408185206046, 0.6428571428571429, 0.8453133337179499])


def test_fractional_difference_published_number(spark):
    p = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "symbol string, datetime int, x double")
    assert p.select("datetime", features.fracdiff(F.col("x"), 0.9, 10).alias("d")).orderBy(F.col("datetime").desc()).first()["d"] == pytest.approx(2.60561581, abs=1e-6)


def test_bars_conserve_volume_and_value(spark):
    t = market.ticks(spark, SF)
    total = t.agg(F.sum("quantity").alias("q"), F.sum(F.col("price") * F.col("quantity")).alias("v")).first()
    value = bars.threshold_bars(t, "value", 20000)
    assert value.agg(F.sum("amount")).first()[0] == pytest.approx(total["v"]) and value.agg(F.sum("volume")).first()[0] == pytest.approx(total["q"])
    assert value.where("full AND abs(amount - 20000) > 1e-6").count() == 0
    made = bars.extended_bars(t, 20000)
    levels = [c for c in made.columns if "_level_" in c]
    assert made.agg(sum(F.sum(c) for c in levels)).first()[0] == pytest.approx(total["v"])
    foot = bars.footprint_bars(t, "7 days", 10.0, 2.0)
    assert foot.agg(F.sum("volume")).first()[0] == pytest.approx(total["q"])
    assert foot.where("point_of_control < low OR point_of_control > high OR abs(delta) > volume").count() == 0


def test_recurrences_against_plain_loops(spark):
    closes = [100.0, 101.0, 99.0, 104.0, 108.0, 97.0, 95.0, 99.0, 103.0]
    p = spark.createDataFrame([("a", i, c) for i, c in enumerate(closes)], "symbol string, datetime int, close double")
    found = [r["ema"] for r in recurrences.run(p, recurrences.ema(3)).orderBy("datetime").collect()]
    for i, v in enumerate(found):
        w = [0.5 ** (i - k) for k in range(i + 1)]
        assert v == pytest.approx(sum(a * b for a, b in zip(w, closes, strict=False)) / sum(w))
    line = spark.createDataFrame([("a", i, float(i), 3.0 * i + 2) for i in range(60)], "symbol string, datetime int, open double, close double")
    last = recurrences.run(line, recurrences.kalman()).orderBy(F.col("datetime").desc()).first()
    assert last["slope"] == pytest.approx(3, abs=0.05) and abs(last["residual"]) < 0.05
    assert {r["event"] for r in recurrences.run(p, recurrences.cusum(0.04)).collect()} == {0.0, 1.0, -1.0}


def test_stateful_stream_equals_batch(spark, tmp_path):
    t = market.ticks(spark, SF).select("symbol", "ts", F.col("price").alias("close")).where("symbol < 10")
    for i, day in enumerate((15, 32)):
        t.where((F.dayofmonth("ts") < day) & (F.dayofmonth("ts") >= (0, 15)[i])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stateful.run(stream, recurrences.ema(5)).writeStream.format("memory").queryName("ema_stream").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    query.stop()
    key = lambda rows: sorted((r["symbol"], r["ts"], round(r["ema"], 9)) for r in rows)
    assert key(spark.table("ema_stream").collect()) == key(recurrences.run(t, recurrences.ema(5), time="ts").collect())


def test_purged_folds_never_overlap(spark):
    e = spark.createDataFrame([(i, "a", i, i + 3) for i in range(20)], "event_id long, symbol string, s int, e int")
    e = e.select("event_id", "symbol", F.date_add(F.lit("2020-01-01").cast("date"), F.col("s")).alias("event_starts"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("e")).alias("event_ends"))
    rows = events.purged_k_fold(e, 4).collect()
    for k in range(4):
        test, train = ({r["event_id"] for r in rows if r["fold"] == k and r["part"] == part} for part in ("test", "train"))
        assert len(test) == 5 and all(abs(a - b) > 3 for a in test for b in train) and train
    assert len(events.backtest_paths(6, 2)) == 5


def test_structure_alternates(spark):
    found = structure.structure(market.panel(spark, SF), "any")
    strokes = found.where("kind = 'stroke'").orderBy("symbol", "id").collect()
    assert strokes and all(a["up"] != b["up"] for a, b in zip(strokes, strokes[1:], strict=False) if a["symbol"] == b["symbol"])
    assert found.where("kind = 'zone' AND end_value <= start_value").count() == 0


def test_sources(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", "1,10.5,2.0,21.0,1700000000000,true\n2,10.6,1.0,10.6,1700000001000,false\n")
    assert [r["price"] for r in market.read_zipped_csv(spark, str(tmp_path / "*.zip"), market.TRADE).orderBy("trade_id").collect()] == [10.5, 10.6]
    r = spark.range(1).select(market.script_json(F.lit('<script id="d" type="j">{"a":1}</script>'), "d").alias("j"), market.tags(F.lit("['x', 'y']")).alias("t"), market.bar_type_parts(F.lit("ETH-PERP.X-250-VALUE-LAST-EXTERNAL")).alias("b")).first()
    assert r["j"] == '{"a":1}' and r["t"] == ["x", "y"] and r["b"]["aggregation"] == "VALUE" and r["b"]["step"] == "250"


@pytest.mark.parametrize("name", ["op_flagship", "op_wma", "op_rank", "op_csrank", "bar_value", "feat_roll_spread", "ev_uniqueness", "eval_groups", "join_as_of", "st_tumbling"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders", "customer", "nation", "supplier", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    own = queries.queries()[name](spark, SF)
    assert sorted(own.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in names)) for r in own.collect()) == sorted(map(str, found.fetchall()))


def test_every_topic_has_queries_and_entry_runs(spark):
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(factors.OPS) > 50
    assert __spark_entry__.entry(spark).count() > 0
    assert (importlib.util.find_spec("tapeloom.llm") is None) or "op1_language_id" in __spark_entry__.queries()


def _zero_priced(spark, folder):
    """Events of symbols whose prices are zero here and there: within a block, at its ends, twice running, always, and below zero."""
    zeros = {0: [37], 1: [30], 2: [60], 3: [45, 46], 4: [1, 69], 5: range(70), 6: [], 7: [0]}
    rows = [(s * 100 + i, s, i, 0.0 if i in own else -5.0 if s == 6 and i == 40 else 20.0 + (i * 37 + s) % 50) for s, own in zeros.items() for i in range(70)]
    rows += [(900 + i, 8, i, 0.0 if i == 3 else 5.0 + i) for i in range(5)]
    ts = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("i"))).cast("timestamp_ntz")
    made = spark.createDataFrame(rows, "event_id long, user_id long, i int, value double")
    made.select("event_id", ts.alias("ts"), "user_id", "value", F.format_string('{"k": %d}', F.col("i") % 9).alias("props")).write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("name", ["quote_sigma", "bar_zscore", "quote_sigma_auto"])
def test_prices_of_zero_as_in_sql(spark, tmp_path, name):
    _zero_priced(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    own = queries.queries()[name](spark, str(tmp_path))
    assert sorted(str(tuple(r[c] for c in names)) for r in own.collect()) == sorted(map(str, found.fetchall()))


def test_sigmas_leave_out_blocks_with_a_price_of_zero(spark):
    prices = [0.0 if i == 37 else 20.0 + (i * 37) % 50 for i in range(95)]
    mids = spark.createDataFrame([(0, i, x) for i, x in enumerate(prices)], "symbol int, i int, mid double")
    made = quotes.sigmas(mids)
    hl, co = np.log([(max(prices[a : a + 30]) / min(prices[a : a + 30]), prices[a + 30] / prices[a]) for a in (0, 60)]).T
    found = made.select("gk", "parkinson", quotes.select_sigma().alias("sigma")).first()
    assert found.gk == found.sigma == pytest.approx(np.sqrt(np.mean(0.5 * hl**2 - (2 * np.log(2) - 1) * co**2)))
    assert found.parkinson == pytest.approx(np.sqrt(np.mean(hl**2) / (4 * np.log(2))))
