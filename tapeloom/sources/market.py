"""Schemas of market data, readers, and how the sample tables become ticks and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D = "DOUBLE"
#: Column names and types of the files that are read and written.
TRADE = "trade_id BIGINT, price DOUBLE, quantity DOUBLE, quoteQty DOUBLE, timestamp BIGINT, buyer_maker BOOLEAN"
AGG_TRADE = "trade_id BIGINT, price DOUBLE, quantity DOUBLE, first_trade_id BIGINT, last_trade_id BIGINT, timestamp BIGINT, buyer_maker BOOLEAN"
KLINE = (
    "open_time BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, close_time BIGINT, quote_volume DOUBLE, "
    "count BIGINT, taker_buy_volume DOUBLE, taker_buy_quote_volume DOUBLE, ignore STRING"
)
METRICS = (
    "create_time TIMESTAMP, symbol STRING, sum_open_interest DOUBLE, sum_open_interest_value DOUBLE, count_toptrader_long_short_ratio DOUBLE, "
    "sum_toptrader_long_short_ratio DOUBLE, count_long_short_ratio DOUBLE, sum_taker_long_short_vol_ratio DOUBLE"
)
BAR = "bar_type STRING, instrument_id STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, ts_event BIGINT, ts_init BIGINT"


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A parquet table, with a forced schema if one is given."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False) -> DataFrame:
    """CSV files (a path, a glob or several) under our column names; NaN becomes NULL."""
    found = spark.read.schema(schema).csv(path, header=header, mode="FAILFAST", enforceSchema=True)
    return found.select(*(F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


def read_zipped_csv(spark: SparkSession, glob: str, schema: str, header: bool = False) -> DataFrame:
    """CSV members of ZIP files. A ZIP can't be split, so each file is one task's work, streamed line by line."""
    import io
    import zipfile

    def lines(batches):
        import pyarrow as pa

        for b in batches:
            for raw in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".csv")):
                        with z.open(name) as f:
                            rows = [x.decode().rstrip("\r\n") for i, x in enumerate(f) if i or not header]
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    text = spark.read.format("binaryFile").load(glob).select("content").mapInArrow(lines, "value string")
    return text.select(F.from_csv("value", F.lit(schema), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_arrow_stream(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC stream as a DataFrame."""
    import pyarrow.ipc

    with pyarrow.ipc.open_stream(path) as reader:
        return spark.createDataFrame(reader.read_all())


def write_catalog(bars: DataFrame, path: str, by: str = "instrument_id", least_rows: int = 0, mode: str = "overwrite") -> bool:
    """Bars as Parquet, a directory for each instrument; nothing and False if there are fewer rows than asked for."""
    if least_rows and bars.limit(least_rows).count() < least_rows:
        return False
    bars.repartition(by).write.mode(mode).partitionBy(by).parquet(path)
    return True


def kline_bars(klines: DataFrame, bar_type: str, instrument: str) -> DataFrame:
    """Bars from klines; the closing time in nanoseconds."""
    ts = (F.col("close_time") * 1_000_000).alias("ts_event")
    return klines.select(F.lit(bar_type).alias("bar_type"), F.lit(instrument).alias("instrument_id"), "open", "high", "low", "close", "volume", ts, ts.alias("ts_init"))


def script_json(html: Column, element_id: str) -> Column:
    """The JSON text inside ``<script id=...>`` of an HTML page; NULL if there is none."""
    return F.nullif(F.regexp_extract(html, f"(?s)<script[^>]*\\bid=[\"']?{element_id}[\"']?[^>]*>(.*?)</script>", 1), F.lit(""))


def book_levels(prefix: str, depth: int = 5) -> Column:
    """(price, size) of a snapshot's levels as one array, from columns such as bp1, bz1."""
    return F.array(*(F.struct(F.col(f"{prefix}p{i}").alias("price"), F.col(f"{prefix}z{i}").alias("size")) for i in range(1, depth + 1)))


def tags(column: Column) -> Column:
    """``"['a', 'b']"`` as an array of strings."""
    return F.from_json(F.translate(column, "'", '"'), "array<string>")


def bar_type_parts(bar_type: Column) -> Column:
    """Instrument, step, aggregation, price type and source of a bar type's name."""
    pattern = r"^(.+)-(\d+)-([A-Z_]+)-([A-Z]+)-([A-Z]+)$"
    names = ("instrument_id", "step", "aggregation", "price_type", "source")
    return F.struct(*(F.regexp_extract(bar_type, pattern, i + 1).alias(n) for i, n in enumerate(names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; timestamps without a zone are taken as UTC, NaN as NULL."""
    found = read_parquet(spark, f"{sf_dir}/{name}.parquet")
    kinds = {"timestamp_ntz": lambda c: F.col(c).cast("timestamp"), "double": lambda c: F.nanvl(c, F.lit(None).cast("double"))}
    return found.select(*(kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in found.dtypes))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, price, quantity, buyer_maker) from ``events``: value is the price, k of props the quantity."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("quantity"), (F.pmod("event_id", F.lit(2)) == 0).alias("buyer_maker"), F.col("event_id").alias("trade_id"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars for each supplier from ``lineitem``: unique by (symbol, datetime)."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.trunc("l_shipdate", "month").alias("datetime"))
        .agg(
            F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("money"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"), F.count("*").cast("double").alias("open_interest"),
        )
    )
