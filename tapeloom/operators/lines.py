"""Measures of chart lines: rows (symbol, id, start_id, end_id, start_at, end_at, start_value, end_value, high, low, up).

Nothing here walks bars one by one. Bars meet lines by an interval join on the symbol and on
months, so a long history is spread over tasks; line counts are far below bar counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions import safe


def _lines() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("id")


def _last(lines: DataFrame, n: int = 1) -> DataFrame:
    """The last n lines of each symbol."""
    back = Window.partitionBy("symbol").orderBy(F.col("id").desc())
    return lines.withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= n).drop("_k")


def within(bars: DataFrame, lines: DataFrame, *columns: str) -> DataFrame:
    """(symbol, id, datetime, columns): the bars from a line's first to its last, both included."""
    months = F.sequence(F.trunc("start_at", "month"), F.trunc("end_at", "month"), F.expr("interval 1 month"))
    spans = lines.select(F.col("symbol").alias("_s"), "id", "start_at", "end_at", F.explode(months).alias("_m"))
    meets = (F.col("symbol") == F.col("_s")) & (F.trunc("datetime", "month") == F.col("_m")) & F.col("datetime").between(F.col("start_at"), F.col("end_at"))
    return bars.join(spans, meets).select("symbol", "id", "datetime", *columns)


def bounds(lines: DataFrame, bars: DataFrame, *extremes: str) -> DataFrame:
    """(symbol, id, top, bottom, vwap) over a line's bars, and the most and least of further columns, such as an RSI."""
    more = [f(c).alias(f"{name}_{c}") for c in extremes for f, name in ((F.max, "high"), (F.min, "low"))]
    made = within(bars, lines, "high", "low", "close", "volume", *extremes).groupBy("symbol", "id")
    return made.agg(F.max("high").alias("top"), F.min("low").alias("bottom"), safe.ratio(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("vwap"), *more)


def anchored_vwap(lines: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, anchor, vwap) of the bars after the end of each symbol's last line; NULL where none came."""
    anchor = lines.groupBy("symbol").agg(F.max_by("end_at", "id").alias("anchor"))
    after = F.col("datetime") > F.col("anchor")
    weight = F.when(after, F.col("volume"))
    return bars.join(anchor, "symbol").groupBy("symbol", "anchor").agg(safe.ratio(F.sum(F.col("close") * weight), F.sum(weight)).alias("vwap"))


def angle(start: Column, end: Column, bars: Column) -> Column:
    """Slope of a line in degrees: its relative move for each bar."""
    return F.degrees(F.atan(safe.ratio(safe.ratio(end - start, start), bars)))


def shared(a: Column, b: Column, c: Column, d: Column) -> Column:
    """What the intervals a..b and c..d share, as (high, low); touching counts, NULL if nothing."""
    high, low = F.least(F.greatest(a, b), F.greatest(c, d)), F.greatest(F.least(a, b), F.least(c, d))
    return F.when(high >= low, F.struct(high.alias("high"), low.alias("low")))


def crossing(one: Column, two: Column, window: WindowSpec) -> Column:
    """1 where one was below two and is above it, -1 the other way, else 0; strict on both sides."""
    before = F.signum(F.lag(one).over(window) - F.lag(two).over(window))
    now = F.signum(one - two)
    return F.when((before < 0) & (now > 0), 1).when((before > 0) & (now < 0), -1).otherwise(0)


def crossings_within(lines: DataFrame, bars: DataFrame, one: str, two: str | None = None) -> DataFrame:
    """(symbol, id, ups, downs): crossings of two columns, or of a column and zero, between bars of one line."""
    at = within(bars, lines, one, *([two] if two else []))
    inside = Window.partitionBy("symbol", "id").orderBy("datetime")
    at = at.withColumn("_x", crossing(F.col(one), F.col(two) if two else F.lit(0.0), inside))
    return at.groupBy("symbol", "id").agg(F.count_if(F.col("_x") == 1).alias("ups"), F.count_if(F.col("_x") == -1).alias("downs"))


def channel(lines: DataFrame, bars: DataFrame, n: int = 5) -> DataFrame:
    """(symbol, up_slope, upper, down_slope, lower, signal) at each symbol's last bar.

    Straight lines through the highs of the upward and the lows of the downward ones among the last
    n lines, over the position of their ends. Signal: -1 where a narrowing upward channel's lower
    line is broken by the last close, 1 where a narrowing downward one's upper line is, else 0;
    without n lines the symbol is left out.
    """
    own = Window.partitionBy("symbol").orderBy("datetime")
    count = Window.partitionBy("symbol")
    placed = bars.select("symbol", "datetime", "close", F.row_number().over(own).alias("i"), F.lag("close").over(own).alias("prior"))
    ends = _last(lines, n).withColumn("n", F.count(F.lit(1)).over(count)).where(F.col("n") == n)
    ends = ends.join(placed.select("symbol", F.col("datetime").alias("end_at"), "i"), ["symbol", "end_at"])
    line = lambda value, side: [f(F.when(side, F.col(value)), F.when(side, F.col("i"))) for f in (F.regr_slope, F.regr_intercept)]
    (us, ui), (ds, di) = line("high", F.col("up")), line("low", ~F.col("up"))
    fitted = ends.groupBy("symbol").agg(us.alias("up_slope"), ui.alias("_ui"), ds.alias("down_slope"), di.alias("_di"))
    last = placed.groupBy("symbol").agg(F.max_by(F.struct("i", "close", "prior"), "datetime").alias("b"))
    at = fitted.join(last, "symbol").withColumns({"upper": F.col("_ui") + F.col("up_slope") * F.col("b.i"), "lower": F.col("_di") + F.col("down_slope") * F.col("b.i")})
    ordered = F.col("lower") < F.col("upper")
    falls = (F.col("up_slope") > 0) & (F.col("up_slope") < F.col("down_slope")) & ordered & (F.col("b.prior") > F.col("lower")) & (F.col("b.close") < F.col("lower"))
    rises = (F.col("down_slope") < 0) & (F.col("down_slope") > F.col("up_slope")) & ordered & (F.col("b.prior") < F.col("upper")) & (F.col("b.close") > F.col("upper"))
    return at.select("symbol", "up_slope", "upper", "down_slope", "lower", F.when(falls, -1).when(rises, 1).otherwise(0).alias("signal"))


def inside(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(symbol, upper_id, id, lower's columns): the lower level's lines in each line of the upper level.

    Those whose time overlaps the upper line's, from the first to the last that go its way.
    """
    spans = upper.select(F.col("symbol").alias("_s"), F.col("id").alias("upper_id"), F.col("up").alias("_up"), F.col("start_at").alias("_from"), F.col("end_at").alias("_to"))
    both = lower.join(spans, (F.col("symbol") == F.col("_s")) & (F.col("end_at") >= F.col("_from")) & (F.col("start_at") <= F.col("_to")))
    group = Window.partitionBy("symbol", "upper_id")
    along = F.when(F.col("up") == F.col("_up"), F.col("id"))
    both = both.withColumns({"_a": F.min(along).over(group), "_b": F.max(along).over(group)})
    return both.where(F.col("id").between(F.col("_a"), F.col("_b"))).select("symbol", "upper_id", *[c for c in lower.columns if c != "symbol"])


def levels(upper: DataFrame, lower: DataFrame, power: DataFrame) -> DataFrame:
    """(symbol, upper_id, n_lines, last_id, line_divergence) for each line of the upper level.

    The last lower line diverges from the one two before if it goes further at both ends with less
    ``power`` (symbol, id, total).
    """
    at = inside(upper, lower).join(power.select("symbol", "id", "total"), ["symbol", "id"], "left")
    own = Window.partitionBy("symbol", "upper_id").orderBy("id")
    prior = lambda c: F.lag(c, 2).over(own)
    higher = (F.col("high") > prior("high")) & (F.col("low") > prior("low"))
    deeper = (F.col("high") < prior("high")) & (F.col("low") < prior("low"))
    weaker = F.coalesce(F.when(F.col("up"), higher).otherwise(deeper) & (F.col("total") < prior("total")), F.lit(False))
    at = at.withColumn("_d", weaker)
    return at.groupBy("symbol", "upper_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("id").alias("last_id"), F.max_by("_d", "id").alias("line_divergence"))


def fractal_power(chart: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, id, power) of the fractals in ``structure``'s rows: 0 to 5, a point for each sign of strength in the third bar.

    The third merged bar must be a single bar that moves away from the fractal, else 0. Points: it
    lies wholly in the far half of the second, is the furthest of the three, closes beyond the
    first two, is longer than the second, and closes within 0.3 of its range from its far end.
    A bottom is a top turned upside down, so both are read from one set of signed columns.
    """
    merged = chart.where("kind = 'merged'").select("symbol", "id", "start_id", "end_id", "start_at", "high", "low")
    own = _lines()
    first = lambda c, k: F.lag(c, k).over(own)
    three = merged.select(
        "symbol", (F.col("id") - 1).alias("middle"), (F.col("start_id") == F.col("end_id")).alias("single"), F.col("start_at").alias("datetime"), F.col("high").alias("h3"), F.col("low").alias("l3"),
        first("high", 1).alias("h2"), first("low", 1).alias("l2"), first("high", 2).alias("h1"), first("low", 2).alias("l1"),
    )
    marks = chart.where("kind = 'fractal'").select("symbol", "id", F.col("start_id").alias("middle"), "up")
    at = marks.join(three, ["symbol", "middle"]).join(bars.select("symbol", "datetime", "open", "close", F.col("high").alias("bh"), F.col("low").alias("bl")), ["symbol", "datetime"])
    # far: the end that a move away from the fractal makes for, as a number that grows along the move.
    sign = F.when(F.col("up"), -1.0).otherwise(1.0)
    far = lambda k: F.when(F.col("up"), -F.col(f"l{k}")).otherwise(F.col(f"h{k}"))
    near = lambda k: F.when(F.col("up"), -F.col(f"h{k}")).otherwise(F.col(f"l{k}"))
    close, moved = sign * F.col("close"), sign * (F.col("close") - F.col("open")) >= 0
    left = F.when(F.col("up"), F.col("close") - F.col("bl")).otherwise(F.col("bh") - F.col("close"))
    signs = [
        near(3) > (near(2) + far(2)) / 2, (far(3) > far(1)) & (far(3) > far(2)), (close > far(1)) & (close > far(2)),
        F.col("h3") - F.col("l3") > F.col("h2") - F.col("l2"), F.coalesce(safe.ratio(left, F.col("bh") - F.col("bl")) < 0.3, F.lit(False)),
    ]
    points = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    return at.select("symbol", "id", F.when(F.col("single") & moved, points).otherwise(0).alias("power"))


def paused(chart: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, id, paused) of each symbol's last stroke: whether the last close lies beyond the bar after its end."""
    after = chart.where("kind = 'merged'").select("symbol", (F.col("id") - 1).alias("end_id"), F.col("high").alias("_h"), F.col("low").alias("_l"))
    line = _last(chart.where("kind = 'stroke'").select("symbol", "id", "end_id", "up"))
    last = bars.groupBy("symbol").agg(F.max_by("close", "datetime").alias("close"))
    beyond = F.when(F.col("up"), F.col("close") < F.col("_l")).otherwise(F.col("close") > F.col("_h"))
    return line.join(after, ["symbol", "end_id"], "left").join(last, "symbol").select("symbol", "id", F.coalesce(beyond, F.lit(False)).alias("paused"))
