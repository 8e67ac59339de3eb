"""Line deduplication over levelled sorted runs of line hashes.

A *run* is a table of distinct line keys, bucketed and sorted by key hash, with the number of
documents that hold a key and the largest of their ids. Each batch of documents is counted, and a
merge anti-join against the runs parts its keys: the unseen ones become a run on level 0, the seen
ones a table of *updates* beside it, so that a key lies in one run only. ``fan_out`` runs on a
level are merged into one on the next, and so are their updates; ``b`` batches leave O(log b) runs
and a key is rewritten O(log b) times. As runs share their buckets and are sorted, the joins and
merges read them side by side without a shuffle or a sort.

Defined results: a null or empty text is one empty line; a null doc_id counts as one document
before all others; rows that share a doc_id count as one document and each is filtered; an empty
table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import BLANKS, NO_ID, forget, looked_up, pick, table_path, written

MIN_POINTS, MIN_DOCS, FAN_OUT = 40, 5, 3
_STRIP = BLANKS.encode()


def line_hash(line: bytes, min_points: int = MIN_POINTS) -> bytes | None:
    """128-bit hash of a line's key (the line itself lower-cased before), None if the key is short."""
    key = line.strip(_STRIP)
    if len(key) < min_points or (not key.isascii() and len(key.decode()) < min_points):
        return None
    return xxhash.xxh3_128_digest(key)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split(b"\n")


def line_keys(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, key): the distinct hashed line keys of each row, null ids as ``NO_ID``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {h for line in _lines(t) if (h := line_hash(line.lower(), min_points))}
                ids += [NO_ID if i is None else i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, key binary")


class LineRuns:
    """The levelled runs, kept as tables in the shared folder.

    ``levels[i]`` lists (run, updates) on level i, as names of tables; the first batch has no
    updates (None). A failed task only recomputes its part of one write; a run counts once its
    write has been committed. Counts add up because a document belongs to one batch.
    """

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out, self.levels = spark, fan_out, [[]]
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.paths: dict[str, str] = {}

    @contextmanager
    def _as_sorted(self) -> Iterator[None]:
        """Within, tables are read by buckets, those with one file for each as sorted, and never broadcast."""
        wanted = {
            "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        }
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _write(self, sums: DataFrame, kind: str) -> str:
        name = f"line_{kind}_{uuid.uuid4().hex}"
        self.paths[name] = table_path(self.spark, name)
        sums.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self.paths[name]).saveAsTable(name)
        if len(self.spark.table(name).inputFiles()) > self.buckets:
            raise RuntimeError("a run was not written bucket by bucket, so it may hold a key twice")
        return name

    def _forget(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            forget(self.spark, self.paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """One row for each key of the tables, read bucket by bucket.

        The condition always holds: it makes rows of the scans' column batches, as a union of
        batches (Spark 4.1) puts buckets after each other while its plan has them side by side.
        """
        every = reduce(DataFrame.union, [self.spark.table(n).where("n_docs > 0") for n in names])
        return every.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def runs(self) -> list[str]:
        return [run for level in self.levels for run, _ in level]

    def unseen(self, sums: DataFrame) -> DataFrame:
        """The rows of a counted batch whose key no run holds: a merge anti-join with each run."""
        for run in self.runs():
            sums = sums.join(self.spark.table(run).select("key").hint("merge"), "key", "left_anti")
        return sums

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of (doc_id, key): unseen keys as a run, counts of the others as updates."""
        counted = keys.select("doc_id", "key").distinct().groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        with self._as_sorted():
            batch = self._write(counted, "batch")
            if not self.runs():
                self.levels[0].append((batch, None))
            else:
                sums = self.spark.table(batch)
                run = self._write(self.unseen(sums), "run")
                seen = sums.join(self.spark.table(run).select("key").hint("merge"), "key", "left_anti")
                self.levels[0].append((run, self._write(seen, "updates")))
                self._forget(batch)
            level = 0
            while len(self.levels[level]) >= self.fan_out:
                full, self.levels[level] = self.levels[level], []
                parts = [[t for pair in full if (t := pair[k])] for k in (0, 1)]
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append((self._write(self._merged(parts[0]), "run"), self._write(self._merged(parts[1]), "updates") if parts[1] else None))
                self._forget(*parts[0], *parts[1])
                level += 1

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(key, last_doc) of keys in ``min_docs`` documents or more, over all runs and updates, as a written table."""
        with self._as_sorted():
            held = self._merged([t for level in self.levels for pair in level for t in pair if t])
            return written(held.where(F.col("n_docs") >= min_docs).select("key", "last_doc"), "frequent-lines")

    def close(self) -> None:
        """Deletes the runs."""
        self._forget(*self.paths)
        self.levels = [[]]


def _without(marked: DataFrame, min_points: int, text_out: bool, more: list[str]) -> DataFrame:
    """Drops from each row's ``text`` the lines whose key is in ``gone``; ``more`` names columns passed through."""
    names = ["text", "n_lines", "n_dropped", "kept_sha256"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for t, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines, kept = _lines(t), None
                if gone:
                    gone = set(gone)
                    kept = [x for x in lines if line_hash(x.lower(), min_points) not in gone]
                body = b"\n".join(lines if kept is None else kept)
                rows.append((body.decode() if text_out else None, len(lines), 0 if kept is None else len(lines) - len(kept), hashlib.sha256(body).hexdigest()))
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *made], [*more, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name in more]
    return marked.select("text", "gone", *more).mapInArrow(run, ", ".join([*fields, "text string", "n_lines long", "n_dropped long", "kept_sha256 string"]))


def _marked(docs: DataFrame, doc_id: str, text: str, min_points: int, min_docs: int, batches: int) -> DataFrame:
    """``docs`` with ``gone``: the keys that each document loses (null: none)."""
    spark, path = docs.sparkSession, table_path(docs.sparkSession, "line-keys")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    line_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), min_points).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("doc_id long, key binary, batch int").parquet(path)
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("doc_id", "key"))
    frequent = runs.frequent(min_docs)
    runs.close()
    # The line keys look up the frequent ones; what is left is a short list for each document.
    drops = looked_up(keys.select("doc_id", "key"), frequent, "key").where(F.col("doc_id") < F.col("last_doc"))
    drops = drops.groupBy("doc_id").agg(F.collect_set("key").alias("gone")).withColumnRenamed("doc_id", "own")
    return docs.join(drops, F.coalesce(F.col(doc_id), F.lit(NO_ID)) == F.col("own"), "left").drop("own")


def dedup_lines(docs: DataFrame, *, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, batches: int = 1, text_out: bool = True) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept_sha256) with frequent lines left only in the largest doc_id.

    A line goes if its key (blanks stripped at both ends, A-Z lower-cased) has ``min_points`` code
    points or more, at least ``min_docs`` documents hold it, and a larger doc_id does too. The
    other lines stay in order, joined by a line feed. ``batches`` splits the documents by a hash of
    doc_id, one run each, as they would arrive over time; any number gives the same result.
    ``text`` is null in the result without ``text_out``.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return _without(_marked(docs, "doc_id", "text", min_points, min_docs, batches), min_points, text_out, ["doc_id"])


def without_frequent_lines(docs: DataFrame, *, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, batches: int = 1) -> DataFrame:
    """The rows of ``docs`` with their columns, ``text`` less frequent lines and ``n_chars`` (if any) its length."""
    at = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    doc_id, text = (f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    marked = _marked(at, doc_id, text, min_points, min_docs, batches).withColumnRenamed(text, "text")
    others = [c for c in at.columns if c != text]
    kept = _without(marked, min_points, True, others)
    made = {text: F.col("text")}
    if "n_chars" in docs.columns:
        made[f"_{docs.columns.index('n_chars')}"] = F.length("text").cast("long")
    return kept.select(*[made.get(c, F.col(c)).alias(n) for c, n in zip(at.columns, docs.columns, strict=True)])
