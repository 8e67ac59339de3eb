"""Context-triggered piecewise hashing of documents.

A hash of the last seven bytes decides where a chunk ends: where it is -1 modulo the block size.
Each chunk gives one character. The block size follows the text's length, so a signature has at
most 64 characters, and is kept for twice the block size too; two fingerprints compare if they
share a block size, by edit distance between the signatures.

Defined results: null is the empty text, whose fingerprint is ``3::``; it is like itself (1) and
unlike others (0); the next document of the only one is itself; rows are ordered by doc_id (null
first), then hash of the text, then text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import NO_ID, pick

LEAST_BLOCK, LENGTH, WINDOW, COMMON = 3, 64, 7, 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_MIX, _SEGMENT = np.uint64(0x9E3779B97F4A7C15), 1 << 20


def window_hashes(data: bytes) -> np.ndarray:
    """For each byte a 32-bit hash of the seven bytes that end with it (zeros before the text)."""
    out, padded = np.empty(len(data), np.uint32), bytes(WINDOW - 1) + data + bytes(8)
    for k in range(min(8, len(data))):  # eight interleaved, unaligned views give every offset
        words = np.frombuffer(padded, "<u8", count=len(out[k::8]), offset=k)
        out[k::8] = ((words << np.uint64(8)) * _MIX) >> np.uint64(32)  # the shift drops the eighth byte
    return out


def triggers(data: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, hashes): where chunks may end at this block size or a multiple of it."""
    ends, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    for at in range(0, len(data), _SEGMENT):  # bounds the memory that a very long text takes
        before = min(at, WINDOW - 1)
        h = window_hashes(data[at - before : at + _SEGMENT])[before:]
        found = np.flatnonzero(h % np.uint32(block) == block - 1)
        ends.append(found + (at + 1))
        hashes.append(h[found])
    return np.concatenate(ends), np.concatenate(hashes)


def _signature(data: bytes, ends: np.ndarray) -> str:
    """A character for each chunk; beyond LENGTH chunks the last takes all the rest."""
    cuts = [0, *ends[: LENGTH - 1].tolist(), len(data)]
    return "".join(ALPHABET[xxhash.xxh64_intdigest(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at twice the block``."""
    data = (text or "").encode("utf-8", "replace")
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    at, (ends, hashes) = max(LEAST_BLOCK, block // 2), triggers(data, max(LEAST_BLOCK, block // 2))
    while block > LEAST_BLOCK and (hashes % np.uint32(block) == block - 1).sum() < LENGTH // 4:
        block //= 2
        if block < at:
            at, (ends, hashes) = block, triggers(data, block)
    fine, wide = (ends[hashes % np.uint32(b) == b - 1] for b in (block, 2 * block))
    return f"{block}:{_signature(data, fine)}:{_signature(data, wide)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one addition for each character of b."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) per character.

    0 without a common run of COMMON characters, or of half the shorter signature if that is less.
    """
    if a == b:
        return 1.0
    run = max(1, min(COMMON, len(a) // 2, len(b) // 2))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; fingerprints whose block sizes are neither equal nor one twice the other give 0."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    pairs = [(x1, y1), (x2, y2)] if bx == by else [(x2, y1)] if by == 2 * bx else [(x1, y2)] if bx == 2 * by else []
    return max((_alike(a, b) for a, b in pairs if a and b), default=0.0)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, guest): rows dealt by ranges of (doc_id, hash of the text), each with the row that follows it.

    Ranges come from approximate quantiles of all ids; an id that fills several of them, as null
    may, is cut by equal parts of the hash. The first row of a range is also sent, as a guest, to
    the range before it (of the first range, to the last), so that every row's successor is in its
    range. No range is collected: tasks read it as a sorted stream.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("own"), F.xxhash64("text").alias("h"), "doc_id", "text")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(F.percentile_approx("own", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    cuts = []
    for own, times in sorted(Counter(found if n > 1 else []).items()):
        cuts += [(own, (k << 64) // times - (1 << 63)) for k in range(1, times)] + [(own, (1 << 63) - 1)]

    def deal(lo: int, hi: int) -> Column:  # number of cuts below the row, by halving
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        own, h = cuts[mid]
        below = (F.col("own") < own) | (F.col("own") == own) & (F.col("h") <= h)
        return F.when(below, deal(lo, mid)).otherwise(deal(mid + 1, hi))

    dealt = docs.withColumn("bucket", deal(0, len(cuts)))
    firsts = sorted((r["bucket"], r["x"]["own"], r["x"]["h"]) for r in dealt.groupBy("bucket").agg(F.min(F.struct("own", "h")).alias("x")).collect())
    if firsts:
        before = F.create_map(*(F.lit(x) for i, (b, _, _) in enumerate(firsts) for x in (b, firsts[i - 1][0])))
        place = lambda b, guest: F.struct(b.alias("bucket"), F.lit(guest).alias("guest"))
        once, twice = F.array(place(F.col("bucket"), 0)), F.array(place(F.col("bucket"), 0), place(before[F.col("bucket")], 1))
        is_first = F.struct("own", "h").isin([F.struct(F.lit(own).alias("own"), F.lit(h).alias("h")) for _, own, h in firsts])
        dealt = dealt.withColumn("at", F.explode(F.when(is_first, twice).otherwise(once))).select("own", "h", "doc_id", "text", "at.bucket", "at.guest")
    else:
        dealt = dealt.withColumn("guest", F.lit(0))
    # Buckets under keys that hash to partitions of their own, so that no task gets two.
    slots = spark.range(40 * n).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("slot"), F.col("id").cast("int").alias("key")).groupBy("slot").agg(F.min("key").alias("key")).collect()
    keys = {r["slot"]: r["key"] for r in slots}
    named = F.element_at(F.array(*(F.lit(keys.get(i, 40 * n + i)) for i in range(len(cuts) + 1))), F.col("bucket") + 1)
    dealt = dealt.withColumn("bucket", named)
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "own", "h", "text").select("bucket", "doc_id", "text", "guest")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, that of its text half replaced by the next document's, and likenesses."""

    def row(doc: tuple, after: tuple) -> tuple:
        _, doc_id, text, _, own = doc
        n = len(text)
        edited = text[: n - n // 2] + after[2][: n // 2]
        near = fingerprint(edited)
        return doc_id, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), own, near, likeness(own, near), likeness(own, after[4])

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for bucket, doc_id, text, guest in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if guest and last is not None and last[0] == bucket and last[3]:
                    continue  # a further row that shares the guest's id
                now = (bucket, doc_id, text or "", guest, fingerprint(text))
                if last is not None and last[0] == bucket and not last[3]:
                    out.append(row(last, now))
                last = now
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)

    return with_next(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
