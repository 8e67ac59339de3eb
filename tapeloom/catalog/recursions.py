"""SQL for the queries of recurrences, labels and statistics whose queries are in the other modules."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession

from tapeloom import sql

_O = "(PARTITION BY symbol ORDER BY datetime)"
_N = f'n AS (SELECT *, "close" AS c, high AS h, low AS l, row_number() OVER {_O} - 1 AS i, count(*) OVER (PARTITION BY symbol) - 1 AS z FROM panel)'


def _recursive(start: str, step: str, more: str = "", rows: str = "n") -> str:
    """CTE r: ``start`` for each symbol's first row, ``step`` from r and the next row n."""
    return f"""WITH RECURSIVE {sql.PANEL}, {_N}{more},
r AS (SELECT symbol, datetime, i, {start} FROM {rows} n WHERE i = 0 UNION ALL SELECT n.symbol, n.datetime, n.i, {step} FROM r JOIN {rows} n ON n.symbol = r.symbol AND n.i = r.i + 1)"""


def cdf(z: str) -> str:
    """The normal distribution function by the published approximation that the engine uses."""
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({z}) / sqrt(2)))"
    poly = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    erf = f"(1 - {poly} * exp(-({z}) * ({z}) / 2))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


def _kalman(q: float = 1e-4, r: float = 1e-4, p: float = 1e6) -> str:
    def step(at: str, slope: str, cut: str, p00: str, p01: str, p11: str) -> str:
        return f"""(SELECT {{'slope': slope + g * e, 'cut': cut + k * e, 'p00': p00 - g * a, 'p01': p01 - g * b, 'p11': p11 - k * b}} FROM (SELECT *, a / s AS g, b / s AS k FROM (SELECT *, a * x + b + {r!r}::DOUBLE AS s FROM
  (SELECT *, y - (slope * x + cut) AS e, p00 * x + p01 AS a, p01 * x + p11 AS b FROM (SELECT {at}.open AS x, {at}.c AS y, {slope} AS slope, {cut} AS cut, {p00} + {q!r}::DOUBLE AS p00, {p01} + {q!r}::DOUBLE AS p01, {p11} + {q!r}::DOUBLE AS p11)))))"""

    first = step("n", "0.0::DOUBLE", "0.0::DOUBLE", f"{p!r}::DOUBLE", "0.0::DOUBLE", f"{p!r}::DOUBLE")
    after = step("n", "r.s.slope", "r.s.cut", "r.s.p00", "r.s.p01", "r.s.p11")
    found = _recursive(f"open AS x, c AS y, {first} AS s", f"n.open, n.c, {after}")
    return f"{found} SELECT symbol, datetime, s.slope AS slope, s.cut AS intercept, y - s.slope * x - s.cut AS residual FROM r"


def _cusum(threshold: float) -> str:
    up, down = "greatest(0, up + ln(n.c / r.last))", "least(0, down + ln(n.c / r.last))"
    low, high = f"{down} < -{threshold}", f"{up} > {threshold}"
    found = _recursive(
        "c AS last, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0.0::DOUBLE AS event",
        f"n.c, CASE WHEN {low} THEN {up} WHEN {high} THEN 0 ELSE {up} END, CASE WHEN {low} THEN 0 ELSE {down} END, CASE WHEN {low} THEN -1 WHEN {high} THEN 1 ELSE 0 END",
    )
    return f"{found} SELECT symbol, datetime, event FROM r"


def _supertrend(n: int, k: float) -> str:
    more = f""", t AS (SELECT *, (h + l) / 2 AS mid, avg(CASE WHEN i = 0 THEN h - l ELSE greatest(h - l, abs(h - prior), abs(l - prior)) END) OVER (PARTITION BY symbol ORDER BY datetime ROWS {n - 1} PRECEDING) AS atr
  FROM (SELECT *, lag(c) OVER {_O} AS prior FROM n))"""
    up, down = f"n.mid + {k} * n.atr", f"n.mid - {k} * n.atr"
    now = "(CASE WHEN n.c > r.upper THEN 1.0 WHEN n.c < r.lower THEN -1.0 ELSE r.direction END)"
    flat = "n.c <= r.upper AND n.c >= r.lower"
    found = _recursive(
        f"{up} AS upper, {down} AS lower, (CASE WHEN c > 0 THEN 1.0 WHEN c < 0 THEN -1.0 ELSE 0.0 END)::DOUBLE AS direction, (c <> 0)::INT::DOUBLE AS changed",
        f"CASE WHEN {flat} AND r.direction < 0 THEN least({up}, r.upper) ELSE {up} END, CASE WHEN {flat} AND r.direction > 0 THEN greatest({down}, r.lower) ELSE {down} END, {now}::DOUBLE, ({now} <> r.direction)::INT::DOUBLE",
        more, "t",
    )
    return f"{found} SELECT symbol, datetime, upper, lower, direction, changed FROM r"


def _vidya(n: int) -> str:
    more = f""", t AS (SELECT *, coalesce(abs(sum(d) OVER w) / nullif(sum(abs(d)) OVER w, 0), 0) AS k FROM (SELECT *, coalesce(c - lag(c) OVER {_O}, 0) AS d FROM n) WINDOW {sql.window(n)})"""
    return f"{_recursive('c AS vidya', f'vidya + {2 / (n + 1)!r}::DOUBLE * n.k * (n.c - vidya)', more, 't')} SELECT symbol, datetime, vidya FROM r"


def _kvo(fast: int, slow: int) -> str:
    way = "(CASE WHEN n.h + n.l + n.c > r.price THEN 1.0 ELSE -1.0 END)"
    added = f"(CASE WHEN {way} = trend THEN added + (n.h - n.l) ELSE size + (n.h - n.l) END)"
    force = f"(CASE WHEN {added} <> 0 THEN n.volume * abs(2 * (n.h - n.l) / {added} - 1) * {way} * 100 ELSE 0 END)"
    found = _recursive(
        "h + l + c AS price, h - l AS size, 0.0::DOUBLE AS trend, h - l AS added, 0.0::DOUBLE AS quick, 0.0::DOUBLE AS late",
        f"n.h + n.l + n.c, n.h - n.l, {way}::DOUBLE, {added}, quick + {2 / (fast + 1)!r}::DOUBLE * ({force} - quick), late + {2 / (slow + 1)!r}::DOUBLE * ({force} - late)",
    )
    return f"{found} SELECT symbol, datetime, quick - late AS kvo FROM r"


def _zigzag(threshold: float) -> str:
    """CTE pivots (symbol, datetime, value, kind). A step keeps the last turning point or closes it and opens the next."""
    change = "(CASE WHEN v <> 0 THEN (n.c - v) / abs(v) ELSE 0 END)"
    peak = "(before <= v)"  # the last point is a peak
    first = f"(cnt = 1 AND abs({change}) >= {threshold})"
    on = f"(cnt > 1 AND CASE WHEN {peak} THEN n.c >= v ELSE n.c <= v END)"
    turn = f"(cnt > 1 AND NOT {on} AND ((CASE WHEN {peak} THEN -{change} ELSE {change} END) >= {threshold} OR n.i = n.z))"
    new = f"CASE WHEN {first} THEN CASE WHEN {change} > 0 THEN n.h ELSE n.l END WHEN {on} THEN CASE WHEN {peak} THEN n.h ELSE n.l END WHEN {turn} THEN CASE WHEN {peak} THEN n.l ELSE n.h END ELSE v END"
    kind = f"CASE WHEN {first} THEN CASE WHEN {change} > 0 THEN 'Peak' ELSE 'Trough' END WHEN {on} THEN CASE WHEN {peak} THEN 'Peak' ELSE 'Trough' END WHEN {turn} THEN CASE WHEN {peak} THEN 'Trough' ELSE 'Peak' END ELSE kind END"
    closed = f"CASE WHEN {first} THEN CASE WHEN {change} > 0 THEN 'Trough' ELSE 'Peak' END ELSE kind END"
    found = _recursive(
        "1 AS cnt, datetime AS spot, c AS v, NULL::VARCHAR AS kind, NULL::DOUBLE AS before, false AS added, datetime AS old_at, c AS old_v, NULL::VARCHAR AS old_kind, z",
        f"cnt + ({first} OR {turn})::INT, CASE WHEN {first} OR {on} OR {turn} THEN n.datetime ELSE spot END, {new}, {kind}, CASE WHEN {first} OR {turn} THEN v ELSE before END, {first} OR {turn}, spot, v, {closed}, n.z",
    )
    return f"{found}, pivots AS (SELECT symbol, old_at AS datetime, old_v AS value, old_kind AS kind FROM r WHERE added UNION ALL SELECT symbol, spot, v, kind FROM r WHERE i = z)"


def _labels(threshold: float, stop_loss: float | None = None) -> str:
    out = f"""{_zigzag(threshold)},
p AS (SELECT *, lead(value) OVER {_O} AS next_value, lead(datetime) OVER {_O} AS ends, row_number() OVER {_O} AS nth FROM pivots),
q AS (SELECT b.*, p.next_value, p.ends FROM panel b LEFT JOIN p USING (symbol, datetime)),
f AS (SELECT symbol, datetime, "close" AS c, last_value(ends IGNORE NULLS) OVER w AS event_ends, last_value(next_value IGNORE NULLS) OVER w / "close" - 1 AS label FROM q
  WINDOW w AS (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING))"""
    if stop_loss is not None:
        out += f""",
g AS (SELECT f.*, min({{'x': b.low, 'at': b.datetime}}) AS worst, max({{'x': b.high, 'at': b.datetime}}) AS best FROM f JOIN panel b ON b.symbol = f.symbol AND b.datetime > f.datetime AND b.datetime <= f.event_ends GROUP BY ALL),
h AS (SELECT *, least(worst.x / c - 1, 0) AS fall, greatest(best.x / c - 1, 0) AS rise FROM g),
e AS (SELECT symbol, datetime, CASE WHEN label > 0 AND fall <= -{stop_loss} THEN worst.at WHEN label <= 0 AND rise >= {stop_loss} THEN best.at ELSE event_ends END AS event_ends,
  CASE WHEN label > 0 AND fall <= -{stop_loss} THEN fall WHEN label <= 0 AND rise >= {stop_loss} THEN rise ELSE label END AS label FROM h)"""
    last = "f" if stop_loss is None else "e"
    return out + f""",
k AS (SELECT x.* FROM {last} x JOIN p ON p.symbol = x.symbol AND p.nth = 2 WHERE x.datetime >= p.datetime),
m AS (SELECT *, avg(label) OVER (PARTITION BY symbol) AS mean, 5 * stddev_pop(label) OVER (PARTITION BY symbol) AS spread, row_number() OVER {_O} - 1 AS count_index FROM k),
o AS (SELECT *, CASE WHEN label IS NOT NULL THEN least(greatest(label, mean - spread), mean + spread) END AS cut FROM m)
SELECT symbol, datetime, event_ends, CASE WHEN cut > -1 THEN ln(1 + cut) END AS label, count_index FROM o"""


def _quantile_points(n: int = 20) -> str:
    ps = [(i + 0.5) / n for i in range(n)]
    listed = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"
    return f"""WITH {sql.PANEL}, s AS (SELECT quantile_cont("close" / open - 1, {listed(ps)}) AS q, avg("close" / open - 1) AS m, stddev_samp("close" / open - 1) AS d FROM panel)
SELECT unnest({listed(ps)}) AS p, unnest(q) AS sample, unnest(list_transform({listed(NormalDist().inv_cdf(p) for p in ps)}, lambda z: m + d * z)) AS normal FROM s"""


def oracle_sql() -> dict[str, str]:
    z = "((low / high - 0.5) / nullif(sqrt(low / high * (1 - low / high)), 0))"
    vpin = f"""WITH {sql.PANEL}, a AS (SELECT *, "close" - lag("close") OVER {_O} AS dp FROM panel), b AS (SELECT *, dp / nullif(stddev_samp(dp) OVER s, 0) AS z FROM a WINDOW {sql.window(6, 's')}),
c AS (SELECT *, CASE WHEN count(dp) OVER w = 5 THEN abs(2 * volume * {cdf('z')} - volume) END AS imbalance FROM b WINDOW {sql.window(5)})
SELECT symbol, datetime, CASE WHEN count(imbalance) OVER w = 5 THEN avg(imbalance) OVER w / volume END AS vpin FROM c WINDOW {sql.window(5)}"""
    words = "list_transform(generate_series(1, 7), lambda i: msg[i:i + 1])"
    plugin = f"""WITH {sql.PANEL}, k AS (SELECT *, (greatest(floor(("close" / open) / 0.5), 0)::BIGINT % 62)::INT AS code FROM panel),
m AS (SELECT symbol, datetime, CASE WHEN count(code) OVER w = 8 THEN list(code) OVER w END AS msg FROM k WINDOW {sql.window(8)}), v AS (SELECT symbol, datetime, CASE WHEN msg IS NOT NULL THEN {words} END AS words FROM m)
SELECT symbol, datetime, -list_sum(list_transform(list_distinct(words), lambda c: len(list_filter(words, lambda v: v = c)) / 7.0::DOUBLE * log2(len(list_filter(words, lambda v: v = c)) / 7.0::DOUBLE))) / 2 AS entropy FROM v"""
    sequence = f"""WITH {sql.PANEL}, m AS (SELECT symbol, datetime, list(volume::BIGINT) OVER w AS v FROM panel WINDOW {sql.window(4)})
SELECT symbol, datetime, '[' || array_to_string(list_transform(v, lambda x: '{{"v":' || x || '}}'), ',') || ']' AS sequence FROM m"""
    raw: dict[str, tuple[str, tuple[str, ...]]] = {
        "feat_kalman": (_kalman(), ("slope", "intercept", "residual")), "ev_cusum": (_cusum(0.5), ()), "feat_supertrend": (_supertrend(5, 2.0), ("upper", "lower")),
        "feat_vidya": (_vidya(5), ("vidya",)), "feat_kvo": (_kvo(3, 6), ("kvo",)), "ev_zigzag": (f"{_zigzag(0.5)} SELECT * FROM pivots", ("value",)),
        "ev_labels": (_labels(0.5), ("label",)), "ev_labels_stop_loss": (_labels(0.5, 0.3), ("label",)),
        "ev_bet_size": (f"WITH {sql.PANEL}, b AS (SELECT symbol, datetime, {z} AS z FROM panel) SELECT symbol, datetime, greatest(2 * {cdf('z')} - 1, 0) AS bet FROM b", ("bet",)),
        "eval_qq": (_quantile_points(), ("p", "sample", "normal")), "feat_vpin": (vpin, ("vpin",)), "feat_plugin_entropy": (plugin, ("entropy",)), "feat_sequences": (sequence, ()),
    }
    return {k: sql.rounded(q, *c) for k, (q, c) in raw.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {}
