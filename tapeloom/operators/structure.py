"""Chart structure of bars: merged bars, fractals, strokes, zones, as rows with a kind.

One call for each symbol walks its bars in time; everything that needs only a line's ends is
DataFrame code over the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import safe
from tapeloom.operators import grouped

#: Least distance of a stroke's ends, in merged bars and in bars, by rule.
RULES = {"old": (4, 0), "new": (3, 4), "any": (0, 0)}


@dataclass
class Merged:
    first: int
    last: int
    high: float
    low: float
    members: list[int] = field(default_factory=list)


def merge(high: list[float], low: list[float]) -> list[Merged]:
    """Bars in which none contains its neighbour; going up the higher bounds are kept, going down the lower."""
    out: list[Merged] = []
    for i, (h, lo) in enumerate(zip(high, low, strict=True)):
        top = out[-1] if out else None
        if top is None or not (top.high >= h and top.low <= lo or top.high <= h and top.low >= lo):
            out.append(Merged(i, i, h, lo, [i]))
            continue
        if len(out) < 2:
            top.high, top.low = max(top.high, h), min(top.low, lo)
        else:
            pick = max if out[-2].high < top.high else min
            top.high, top.low = pick(top.high, h), pick(top.low, lo)
        top.last = i
        top.members.append(i)
    return out


@dataclass
class Fractal:
    at: int  # index of the middle merged bar
    top: bool
    bar: Merged

    @property
    def value(self) -> float:
        return self.bar.high if self.top else self.bar.low


def fractals(bars: list[Merged]) -> list[Fractal]:
    """Merged bars whose high and low are both above, or both below, their neighbours'."""
    out = []
    for i in range(1, len(bars) - 1):
        a, b, c = bars[i - 1 : i + 2]
        if a.high < b.high > c.high and a.low < b.low > c.low:
            out.append(Fractal(i, True, b))
        elif a.high > b.high < c.high and a.low > b.low < c.low:
            out.append(Fractal(i, False, b))
    return out


def turning(found: list[Fractal], rule: str) -> list[Fractal]:
    """Alternating fractals: of neighbours alike the more extreme, of opposite ones those far enough apart and clear of each other."""
    merged_gap, bar_gap = RULES[rule]
    out: list[Fractal] = []
    for f in found:
        last = out[-1] if out else None
        if last is None:
            out.append(f)
        elif f.top == last.top:
            if rule == "any" or (f.bar.high >= last.bar.high if f.top else f.bar.low <= last.bar.low):
                out[-1] = f
        else:
            up, down = (f, last) if f.top else (last, f)
            clear = up.bar.high > down.bar.low and up.bar.low > down.bar.high
            if rule == "any" or clear and f.at - last.at >= merged_gap and f.bar.last - last.bar.last >= bar_gap:
                out.append(f)
    return out


@dataclass
class Line:
    start: Fractal
    end: Fractal

    @property
    def up(self) -> bool:
        return not self.start.top

    @property
    def high(self) -> float:
        return max(self.start.value, self.end.value)

    @property
    def low(self) -> float:
        return min(self.start.value, self.end.value)


def segments(lines: list[Line]) -> list[Line]:
    """Lines of lines: an upward one runs to the last line whose end is a new high before a down-line's low breaks the previous one."""
    out: list[Line] = []
    i = 0
    while i + 2 < len(lines):
        up, best = lines[i].up, i
        k = i + 2
        while k < len(lines):
            new = lines[k].high > lines[best].high if up else lines[k].low < lines[best].low
            if new:
                best = k
            elif (lines[k - 1].low < lines[k - 3].low if up else lines[k - 1].high > lines[k - 3].high) if k >= 3 else False:
                break
            k += 2
        if best == i:
            i += 1
            continue
        out.append(Line(lines[i].start, lines[best].end))
        i = best + 1
    return out


@dataclass
class Zone:
    first: int
    last: int
    zg: float  # top and bottom of what the second and fourth lines share
    zd: float
    gg: float  # extremes of the lines between the first and the last; of the last too unless it goes beyond them
    dd: float
    way: bool | None  # up or down if the first and last lines go that way, from outside the extremes to outside them


def zones(lines: list[Line]) -> list[Zone]:
    """Stretches of four lines or more that all meet what the second and fourth share; one ends where a line does not, and the next may begin with its last line."""
    out, i = [], 0
    while i + 3 < len(lines):
        zg, zd = min(lines[i + 1].high, lines[i + 3].high), max(lines[i + 1].low, lines[i + 3].low)
        k = i
        while zg >= zd and k < len(lines) and lines[k].low <= zg and lines[k].high >= zd:
            k += 1
        if k - i < 4:
            i += 1
            continue
        first, last, every = lines[i], lines[k - 1], lines[i:k]
        beyond = last.high == max(x.high for x in every) if last.up else last.low == min(x.low for x in every)
        core = lines[i + 1 : k - 1 if beyond else k]
        gg, dd = max(x.high for x in core), min(x.low for x in core)
        way = None
        if first.up == last.up and (first.low <= dd and last.high >= gg if first.up else first.high >= gg and last.low <= dd):
            way = first.up
        out.append(Zone(i, k - 1, zg, zd, gg, dd, way))
        i = k - 1
    return out


ROW = "kind string, id int, start_id int, end_id int, start_at {t}, end_at {t}, start_value double, end_value double, high double, low double, up boolean"


def structure(bars: DataFrame, rule: str = "old") -> DataFrame:
    """Rows of kind merged, fractal, stroke, segment, zone, in one table.

    ``start_id`` and ``end_id`` refer to the rows that a row is made of: bars of a merged bar, the
    merged bar of a fractal, fractals' merged bars of a line, lines of a zone. A zone's values are
    its bottom and top; high and low its extremes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    columns = ["symbol", "kind", "id", "start_id", "end_id", "start_at", "end_at", "start_value", "end_value", "high", "low", "up"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("datetime", kind="stable").reset_index(drop=True)
        symbol, at = rows["symbol"].iloc[0], rows["datetime"].tolist()
        merged = merge(rows["high"].tolist(), rows["low"].tolist())
        found = fractals(merged)
        ends = turning(found, rule)
        strokes = [Line(a, b) for a, b in zip(ends, ends[1:], strict=False)]
        out = [(symbol, "merged", i, m.first, m.last, at[m.first], at[m.last], m.low, m.high, m.high, m.low, None) for i, m in enumerate(merged)]
        out += [(symbol, "fractal", i, f.at, f.at, at[f.bar.first], at[f.bar.last], f.value, f.value, f.bar.high, f.bar.low, f.top) for i, f in enumerate(found)]
        for kind, lines in (("stroke", strokes), ("segment", segments(strokes))):
            out += [(symbol, kind, i, x.start.at, x.end.at, at[x.start.bar.last], at[x.end.bar.last], x.start.value, x.end.value, x.high, x.low, x.up) for i, x in enumerate(lines)]
        for i, z in enumerate(zones(strokes)):
            a, b = strokes[z.first], strokes[z.last]
            out.append((symbol, "zone", i, z.first, z.last, at[a.start.bar.last], at[b.end.bar.last], z.zd, z.zg, z.gg, z.dd, z.way))
        return pd.DataFrame(out, columns=columns)

    schema = f"symbol {kinds['symbol']}, " + ROW.format(t=kinds["datetime"])
    return grouped.by_symbol(bars.select("symbol", "datetime", "high", "low"), "symbol", ["datetime"], one, schema)


def line_power(lines: DataFrame, bars: DataFrame, value: str) -> DataFrame:
    """(symbol, id, total, up, down, most, least) of a column over the bars between a line's ends."""
    span = lines.select(F.col("symbol").alias("s"), "id", "start_at", "end_at")
    both = bars.join(span, (F.col("symbol") == F.col("s")) & F.col("datetime").between(F.col("start_at"), F.col("end_at")))
    v = F.col(value)
    return both.groupBy("symbol", "id").agg(F.sum(F.abs(v)).alias("total"), F.sum(F.greatest(v, F.lit(0.0))).alias("up"), F.sum(F.least(v, F.lit(0.0))).alias("down"), F.max(v).alias("most"), F.min(v).alias("least"))


def divergences(power: DataFrame, lines: DataFrame) -> DataFrame:
    """(symbol, id, diverges): lines that go further than the one before last in their direction with less power."""
    w = Window.partitionBy("symbol").orderBy("id")
    at = lines.join(power.select("symbol", "id", "total"), ["symbol", "id"])
    prior = lambda c: F.lag(c, 2).over(w)
    further = F.when(F.col("up"), F.col("high") > prior("high")).otherwise(F.col("low") < prior("low"))
    return at.select("symbol", "id", F.coalesce(further & (F.col("total") < prior("total")), F.lit(False)).alias("diverges"))


def zone_ratio(zone_rows: DataFrame) -> DataFrame:
    """(symbol, id, ratio): the shared part of a zone's whole range, in per cent."""
    return zone_rows.select("symbol", "id", (100 * safe.ratio(F.col("end_value") - F.col("start_value"), F.col("high") - F.col("low"))).alias("ratio"))


def trade_points(lines: DataFrame, zone_rows: DataFrame, power: DataFrame) -> DataFrame:
    """(symbol, id, zone, point): the first, second and third kind of buying and selling points, at the line ``id``.

    A zone's first line enters it, its last one leaves it. Leaving is weak if the zone points up or
    down and the last line has less power than the first.

    First: a zone that begins with the last line of one that points the same way and lies clear of
    it is left weakly. Second: of seven lines or more, the last but two went to the zone's extreme,
    and the last one, in the direction of the first, does not reach it or is weak. Third: of five
    lines or more, the line after the last comes back and stays outside what the lines share.
    """
    own = Window.partitionBy("symbol").orderBy("id")
    line = lines.join(power.select("symbol", "id", "total"), ["symbol", "id"]).select("symbol", "id", F.struct("up", "high", "low", "total").alias("x"))
    at = lambda name: line.select("symbol", F.col("id").alias(f"{name}_id"), F.col("x").alias(name))
    z = zone_rows.select("symbol", "id", F.col("start_id").alias("enters_id"), F.col("end_id").alias("leaves_id"), F.col("start_value").alias("zd"), F.col("end_value").alias("zg"), F.col("high").alias("gg"), F.col("low").alias("dd"), F.col("up").alias("way"))
    z = z.withColumns({"n": F.col("leaves_id") - F.col("enters_id") + 1, "back_id": F.col("leaves_id") + 1, "third_id": F.col("leaves_id") - 2})
    z = z.join(at("enters"), ["symbol", "enters_id"]).join(at("leaves"), ["symbol", "leaves_id"]).join(at("third"), ["symbol", "third_id"], "left").join(at("back"), ["symbol", "back_id"], "left")
    beyond = F.when(F.col("leaves.up"), F.col("leaves.high") >= F.col("gg")).otherwise(F.col("leaves.low") <= F.col("dd"))
    z = z.withColumns({
        "weak": F.coalesce(F.col("way").isNotNull() & (F.col("leaves.total") < F.col("enters.total")), F.lit(False)),
        "same": F.when(F.col("enters.up") == F.col("leaves.up"), F.col("leaves.up")), "inner": F.col("n") - 2 - beyond.cast("int"),
    })
    before = lambda c: F.lag(c).over(own)
    follows = (before("leaves_id") == F.col("enters_id")) & (before("way") == F.col("way")) & F.when(F.col("way"), before("gg") < F.col("dd")).otherwise(before("dd") > F.col("gg"))
    z = z.withColumn("trend", F.coalesce(follows, F.lit(False)))
    young = F.col("inner") < 9  # nine lines within make a zone of the next level
    short = F.when(F.col("same").isNull(), False).when(F.col("same"), (F.col("third.high") == F.col("gg")) & ((F.col("third.high") > F.col("leaves.high")) | F.col("weak"))).otherwise(
        (F.col("third.low") == F.col("dd")) & ((F.col("third.low") < F.col("leaves.low")) | F.col("weak"))
    )
    outside = F.when(F.col("back.up"), F.col("back.high") < F.col("zd")).otherwise(F.col("back.low") > F.col("zg"))
    side = lambda up: F.when(up, "sell").otherwise("buy")
    point = lambda k, when, i, up: F.when(young & when, F.struct(F.col(i).alias("line"), F.concat(F.lit(k), side(F.col(up))).alias("point")))
    found = F.array(
        point("1", F.col("trend") & F.col("weak"), "leaves_id", "way"), point("2", (F.col("n") >= 7) & short, "leaves_id", "same"), point("3", (F.col("n") >= 5) & outside, "back_id", "back.up"),
    )
    return z.select("symbol", F.col("id").alias("zone"), F.explode(F.filter(found, lambda p: p.isNotNull())).alias("p")).select("symbol", F.col("p.line").alias("id"), "zone", "p.point")
