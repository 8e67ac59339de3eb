"""SimHash near-duplicates, found exactly with vantage-point trees over fingerprints.

Distinct fingerprints are points in Hamming space. A vantage-point tree, grown on the driver from
a bounded sample of them, splits the space into shards: each inner node holds a vantage point and
a radius. A point lives in one home shard. By the triangle inequality two points within ``RADIUS``
that a node separates both lie within ``RADIUS`` of its boundary, so sending the inner ones among
those across as visitors brings every such pair together in at least one shard. Each shard then
splits further with vantage points of its own and emits a spanning star of its links, never all
pairs; connected components of the stars are found by joins.

Defined results: a text without words (null and empty too) has fingerprint zero, linked like any
other; fewer than three words make one shingle; rows that share a doc_id or a fingerprint are in
one component; a null doc_id has no place in the order, so a component's id is its smallest
non-null doc_id (null if it has none); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import forget, looked_up, pick, rewritten, written

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Distinct fingerprints that a shard is meant to hold, and the bounds of the tree's sample.
SHARD_POINTS, SAMPLE_LEAST, SAMPLE_MOST = 32768, 4096, 1_000_000
#: Homes below which a shard is not split further; rows and columns of a block of comparisons.
_LEAF, _BLOCK, _WIDTH = 256, 64, 4096


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over hashed word shingles, repeats included; a bit is set in over half."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    if len(found) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - SHINGLE + 1].tolist()
    ends, digest = ends[SHINGLE - 1 :].tolist(), xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the memory that a very long text takes
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter(map(fingerprint, b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _away(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part the points about evenly; None if none of a few do.

    Of a few candidates it takes the one with the fewest points near its boundary.
    """
    draw, best = np.random.default_rng(seed), None
    for vantage in points[draw.integers(0, len(points), 4)]:
        d = _away(points, vantage)
        counts = np.bincount(d, minlength=65)
        inside = np.cumsum(counts)
        for mu in {int(np.median(d)) + k for k in (-1, 0, 1)} & set(range(65)):
            small = min(inside[mu], len(points) - inside[mu])
            crossing = inside[mu] - (inside[mu - RADIUS] if mu >= RADIUS else 0)
            if 4 * small >= len(points) and (best is None or crossing < best[0]):
                best = (int(crossing), vantage, mu)
    return best and best[1:]


def grow(sample: np.ndarray, leaf: int, seed: int = 1) -> list:
    """The tree as nested lists: [vantage, radius, inner, outer], or [] for a shard."""
    split = _split(sample, seed) if len(sample) > leaf else None
    if split is None:
        return []
    inside = _away(sample, split[0]) <= split[1]
    return [*split, grow(sample[inside], leaf, 2 * seed), grow(sample[~inside], leaf, 2 * seed + 1)]


def n_shards(tree: list) -> int:
    return n_shards(tree[2]) + n_shards(tree[3]) if tree else 1


def _sides(d: np.ndarray, mu: int, vantage: int, home: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((goes in, belongs in), (goes out, belongs out)) for points at distance d from a node's vantage point.

    Near the boundary the homes of one side visit the other - one way is enough to meet, and its
    direction follows the vantage point, so that visitors spread evenly; visitors go to both.
    """
    outward = bool(int(vantage) & 1)
    inner = d <= mu
    go_in = inner | (d <= mu + RADIUS) & ~(home & outward)
    go_out = ~inner | (d > mu - RADIUS) & ~(home & (not outward))
    return (go_in, inner), (go_out, ~inner)


def route(tree: list, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes, home) for each shard: its home points and the visitors from across a boundary."""
    stack, shard = [(tree, np.arange(len(points)), np.ones(len(points), bool))], 0
    while stack:
        node, at, home = stack.pop()
        if not node:
            yield shard, at, home
            shard += 1
            continue
        vantage, mu, inner, outer = node
        d = _away(points[at], np.uint64(vantage))
        for side, go, stays in ((outer, *_sides(d, mu, vantage, home)[1]), (inner, *_sides(d, mu, vantage, home)[0])):
            stack.append((side, at[go], (home & stays)[go]))


def _near(some: np.ndarray, many: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (into some, into many) of the pairs within RADIUS; it stops soon after more than ``most`` are found."""
    found, n = [(np.empty(0, np.int64),) * 2], 0
    for k in range(0, len(many), _WIDTH):  # pieces that fit a processor's cache
        piece = many[k : k + _WIDTH]
        if len(hits := np.flatnonzero(_away(some[:, None], piece[None, :]) <= RADIUS)):
            a, b = np.divmod(hits, len(piece))
            found.append((a, b + k))
            if (n := n + len(a)) > most:
                break
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _stars(points: np.ndarray, labels: np.ndarray, own: np.ndarray, guests: np.ndarray) -> None:
    """Links points[own] with each other and with points[guests] within RADIUS, lowering labels (indexes of parents) to common roots.

    Of two points within RADIUS one is at home in some shard where both are, so guests are compared
    with homes only: the work is homes times rows, however many visit.
    """
    left, n_own = np.concatenate((own, guests)), len(own)
    while n_own:
        seeds = left[: min(_BLOCK, n_own)]
        a, b = _near(points[seeds], points[left], len(left) + len(seeds))  # each seed finds itself too
        if len(a) <= len(left) + len(seeds):
            _join(labels, seeds[a], left[b])
            left, n_own = left[len(seeds) :], n_own - len(seeds)
            continue
        # Many are alike: breadth-first from the seed with the most neighbours; what it reaches needs no more comparing.
        first = int(np.bincount(a).argmax())
        frontier, pool, at_home = left[first : first + 1], np.delete(left, first), np.delete(np.arange(len(left)) < n_own, first)
        group = [frontier]
        while len(frontier) and len(pool):
            reached = _reached(points[frontier], points[pool])
            frontier, pool, at_home = pool[reached], pool[~reached], at_home[~reached]
            group.append(frontier)
        group = np.concatenate(group)
        _join(labels, np.full(len(group), group[0]), group)
        left, n_own = pool, int(at_home.sum())


def _reached(some: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of ``many`` lie within RADIUS of one of ``some``."""
    out = np.zeros(len(many), bool)
    for k in range(0, len(some), _BLOCK):
        at = np.flatnonzero(~out)
        for piece in np.split(at, range(_WIDTH, len(at), _WIDTH)):
            out[piece] = (_away(some[k : k + _BLOCK, None], many[None, piece]) <= RADIUS).any(axis=0)
    return out


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives each a and its b one root, the smallest of their groups."""
    while len(a):
        ups = _roots(labels, a), _roots(labels, b)
        low, high = np.minimum(*ups), np.maximum(*ups)
        open_ = low < high
        a, b, low, high = (x[open_] for x in (a, b, low, high))
        np.minimum.at(labels, high, low)


def _roots(labels: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = labels[at]
    while True:
        higher = labels[up]
        if (higher == up).all():
            labels[at] = up
            return up
        up = higher


def link(points: np.ndarray, home: np.ndarray, seed: int = 1) -> np.ndarray:
    """For each point the index of its group's root: groups of points joined by links in this shard.

    Splits by vantage points until few homes are left or splitting stops paying: a split halves
    the homes, and of the rows that visit it keeps about three in four on either side.
    """
    labels, stack = np.arange(len(points)), [(np.flatnonzero(home), np.flatnonzero(~home), seed)]
    while stack:
        own, guests, seed = stack.pop()
        split = _split(points[own], seed) if len(own) > _LEAF else None
        if split is not None:
            vantage, mu = split
            both, home_of = np.concatenate((own, guests)), np.arange(len(own) + len(guests)) < len(own)
            (go_in, stays_in), (go_out, stays_out) = _sides(_away(points[both], vantage), mu, vantage, home_of)
            inner, outer = ((both[go & home_of & stays], both[go & ~(home_of & stays)]) for go, stays in ((go_in, stays_in), (go_out, stays_out)))
            if sum(len(h) * (len(h) + len(g)) for h, g in (inner, outer)) <= 0.95 * len(own) * len(both):
                stack += [(*inner, 2 * seed), (*outer, 2 * seed + 1)]
                continue
        _stars(points, labels, own, guests)
    return _roots(labels, np.arange(len(points)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, over edges (a, b) with a > b.

    Alternates large-star and small-star steps (Kiveris et al., 2014) as group-bys with minima,
    until the edges are stars around their smallest node. Each round is a written table; a node
    with very many edges is spread over tasks by ``looked_up``.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = looked_up(both, least, "u")
        moved = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if large else (
            linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))
        )
        return moved.where(F.col("a") != F.col("b")).distinct()

    def is_stars(e: DataFrame) -> bool:
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("up")), F.struct(F.col("b").alias("u"), F.lit(0).alias("up")))).alias("x"))
        ups = ends.groupBy("x.u").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("least"))
        return ups.where((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("least") == 0)).isEmpty()

    spark = edges.sparkSession
    edges, path = rewritten(edges.select("a", "b").distinct(), "edges")
    while not is_stars(edges):
        half, between = rewritten(star(edges, True), "edges")
        edges, after = rewritten(star(half, False), "edges")
        forget(spark, path, between)
        path = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def links(points: DataFrame, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(a, b), a > b: stars of links at 3 bits or fewer among the distinct fingerprints in ``points.fp``."""
    n = points.count()
    size = int(min(max(SAMPLE_LEAST, 4 * n // shard_points), SAMPLE_MOST))
    # Those whose hashes are lowest: about so many, without a sort.
    low = int(min(1.0, size / max(n, 1)) * (1 << 31))
    some = points.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 31)) <= low).collect()
    sample = np.sort(np.array([r[0] for r in some], np.int64).view(np.uint64))
    tree = grow(sample, max(2, int(shard_points * min(1.0, len(sample) / max(n, 1)))))
    shards, tree = n_shards(tree), points.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for shard, at, home in route(tree.value, fp.view(np.uint64)):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(fp[at]), pa.array(home)], ["shard", "fp", "home"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def ended() -> pa.RecordBatch:
            fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
            roots = link(fp.view(np.uint64), home)
            at = np.flatnonzero(roots != np.arange(len(fp)))
            ends = fp[at], fp[roots[at]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(*ends)), pa.array(np.minimum(*ends))], ["a", "b"])

        for batch in batches:
            shard, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi and shard[lo] != now:
                    if held:
                        yield ended()
                    now, held = shard[lo], []
                held.append((fp[lo:hi], home[lo:hi]))
        if held:
            yield ended()

    # A number of partitions of its own keeps shards, small in bytes but not in work, from being put together.
    dealt = points.select("fp").mapInArrow(deal, "shard long, fp long, home boolean").repartition(min(4 * shards, 10_000), "shard")
    return dealt.sortWithinPartitions("shard", "fp").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, *, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: components of links at 3 bits or fewer."""
    prints = written(fingerprints(docs), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    groups = components(links(points, shard_points))
    # From fingerprints to documents: a group's id is its smallest doc_id; a lone fingerprint's is its own.
    rooted = points.join(groups, points["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = written(looked_up(rooted.select("fp", "root"), named, "root").select("fp", "component_id"), "ids")
    return looked_up(prints, ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
