"""Near-duplicates by the Jaccard similarity of word shingles, reached through fingerprints and checked exactly.

SimHash fingerprints of texts whose sets of five-word shingles have a similarity of 0.8 differ in
about 10 of 64 bits. A vantage-point tree parts nothing at that radius: unrelated fingerprints lie
32 bits apart with a spread of 4, so all of them are near every boundary. The tree therefore finds
the links of up to 3 bits, and links beyond them are looked for among texts that agree in one of
``BANDS`` groups of ``ROWS`` least shingle hashes each; a pair at 0.8 is in none of them with a
probability of 3 in a million, a closer one with less. All links found that way are candidates
only: what they connect is compared by whole shingle sets, and only pairs that reach the
similarity count.

A connected group of candidates that has more than ``UNIT`` shingles is cut into blocks of half as
many, and every two blocks meet in a task of their own, so no task holds a group of any size.

Defined results: letters A-Z are lower-cased; fewer than five words make one shingle; texts
without words (null and empty too) are alike; of each group one row stays, that with the smallest
doc_id (null last), of equal ids the one whose text has the least hash, of equal rows one; an empty
table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import simhash_vp
from tapeloom.llm.common import NO_ID, looked_up, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Shingles (8 bytes each) that a task compares at once.
UNIT = 1 << 22
_draw = np.random.default_rng(11)
_TIMES = _draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 512  # shingles whose least hashes are sought at once


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):  # a polynomial in the words' hashes
        total = total * _MIX + h[k : len(h) - width + 1 + k]
    return np.unique(_mixed(total ^ np.uint64(width)))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A hash for each band of least hashes; none for a text without words."""
    if not len(found):
        return np.empty(0, np.int64)
    short, least = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), _PIECE):
        np.minimum(least, (short[at : at + _PIECE, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = _mixed(keys * _MIX + row)
    return keys.view(np.int64)


def set_fingerprint(found: np.ndarray) -> int:
    """SimHash over a set of shingles; a bit is set in over half."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, n, fp, keys) of (doc_id, text): node is a hash of the shingle set, n its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in b.column(2).to_pylist():
                found = shingles(text)
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                sizes.append(len(found))
                prints.append(set_fingerprint(found))
                keys.append(band_keys(found))
            ends = np.cumsum([0, *map(len, keys)])
            made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made[0], pa.array(sizes, pa.int64()), made[1], lists], ["doc_id", "text_hash", "node", "n", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, "doc_id long, text_hash long, node long, n long, fp long, keys array<long>")


def candidates(found: DataFrame) -> DataFrame:
    """(a, b), a > b: stars over the nodes that share a band, a fingerprint, or lie within 3 bits."""
    rows = found.select(F.explode("keys").alias("key"), "node")
    # Bands with one node only, nearly all, end here.
    shared = written(rows.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("key", "b"), "bands")
    banded = looked_up(rows, shared, "key").select(F.col("node").alias("a"), "b")
    points = written(found.groupBy("fp").agg(F.min("node").alias("node")), "points")
    alike = looked_up(found.select("fp", F.col("node").alias("a")), points.select("fp", F.col("node").alias("b")), "fp").select("a", "b")
    near = written(simhash_vp.links(points), "links")
    near = looked_up(near.withColumnRenamed("a", "fp"), points.select("fp", F.col("node").alias("x")), "fp").select(F.col("b").alias("fp"), "x")
    near = looked_up(near, points.select("fp", F.col("node").alias("y")), "fp").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return banded.union(alike).union(near).where("a > b").distinct()


def spanning(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of indexes that reach the similarity and connect all that such pairs connect."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(1, 0)] if both >= similarity * (sizes.sum() - both) - 1e-9 else []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    values, first, counts = np.unique(flat[order], return_index=True, return_counts=True)
    owner, left, pairs = owner[order], np.ones(n, bool), []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed], todo = False, [seed]
        while todo and left.any():
            x = todo.pop()
            at = np.searchsorted(values, sets[x])
            many = counts[at]
            spots = np.repeat(first[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            both = np.bincount(owner[spots], minlength=n)
            reached = np.flatnonzero(left & (both >= similarity * (sizes[x] + sizes - both) - 1e-9))
            left[reached] = False
            pairs += [(int(y), x) for y in reached]
            todo += reached.tolist()
    return pairs


def _row(doc_id: str = "doc_id", text_hash: str = "text_hash"):
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("i"), F.col(text_hash).alias("h"))


def checked(docs: DataFrame, found: DataFrame, pairs: DataFrame, unit: int = UNIT, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a > b: pairs of nodes that reach the similarity, connecting all that such pairs among candidates connect."""
    groups = simhash_vp.components(pairs)
    members = written(groups.union(groups.select("component", "component")).distinct(), "candidates")
    # One row stands for all texts of a node.
    stands = looked_up(found.select("node", "n", _row().alias("r")), members, "node").groupBy("node", "component").agg(F.min("r").alias("r"), F.min("n").alias("n"))
    stands = written(stands, "stands")
    size = F.sum("n")
    weights = stands.groupBy("component").agg(F.when(size <= unit, F.lit(1)).otherwise(F.ceil(2 * size / unit)).cast("long").alias("blocks"))
    placed = looked_up(stands, weights, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    texts = docs.select(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64("text").alias("h")).alias("r"), "text")
    dealt = looked_up(texts, written(placed.select("r", "node", "component", "block", "blocks"), "placed"), "r")
    # With one block a group is one unit; with more each two different blocks are, which compares within blocks too.
    zero = F.lit(0).cast("long")
    others = F.filter(F.sequence(zero, F.col("blocks") - 1), lambda k: k != F.col("block"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(zero)).otherwise(others))
    dealt = dealt.withColumn("other", other).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def ended() -> pa.RecordBatch:
            nodes = list(held)
            links = spanning([held[k] for k in nodes], similarity) if len(nodes) > 1 else []
            ends = [(max(nodes[x], nodes[y]), min(nodes[x], nodes[y])) for x, y in links]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for *key, node, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    if len(held) > 1:
                        yield ended()
                    now, held = key, {}
                if node not in held:
                    held[node] = shingles(text)
        if len(held) > 1:
            yield ended()

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_unit = dealt.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return by_unit.mapInArrow(run, "a long, b long").distinct()


def first_of_each(docs: DataFrame, *, unit: int = UNIT, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``."""
    names = docs.columns
    at = docs.toDF(*[f"_{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"_{names.index(c)}") for c in ("doc_id", "text"))
    own = at.select(doc_id.alias("doc_id"), text.alias("text"))
    found = written(sketches(own), "sketches")
    groups = written(simhash_vp.components(checked(own, found, candidates(found), unit, similarity)), "groups")
    # The order of rows: doc_id, null last, then hash of the text.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = written(found.groupBy("node").agg(F.min(order).alias("best"), F.count("*").alias("rows")), "nodes")
    linked = groups.union(groups.select("component", "component")).distinct()
    linked = written(looked_up(rows, linked, "node"), "linked")
    best = linked.groupBy("component").agg(F.min("best").alias("of_all"))
    lost = written(looked_up(linked, best, "component").where("best <> of_all").select("node"), "lost")
    several = rows.where("rows > 1").select("node", "best")
    drop = looked_up(found, lost, "node", "left_semi").select(_row().alias("r"))
    drop = drop.union(looked_up(found, several, "node").where(order != F.col("best")).select(_row().alias("r")))
    drop = written(drop.distinct(), "dropped")
    alike = looked_up(found, several, "node").where(order == F.col("best")).groupBy(_row().alias("r")).count().where("count > 1").select("r")
    alike = written(alike, "repeated")
    key = F.struct(F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text).alias("h"))
    kept = looked_up(at.withColumn("r", key), drop, "r", "left_anti")
    if not alike.isEmpty():
        once = looked_up(kept, alike, "r", "left_semi").dropDuplicates(["r"])
        kept = looked_up(kept, alike, "r", "left_anti").union(once)
    return kept.drop("r").toDF(*names)
