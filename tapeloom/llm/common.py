"""What the text operators share: column picking, shared-folder tables, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words, as a regular-expression class and as characters.
BLANK_CLASS = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a missing document id wherever ids are ordered or grouped: before all others.
NO_ID = -(2**63)
#: Rows of ids, hashes and numbers (under 100 bytes) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows with texts that a Python worker gets at once.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Makes the session hand Python at most ``BATCH_ROWS`` rows at once, as a default of 10,000 long texts fills an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Only the named columns, whatever else ``df`` has.

    A name is matched exactly first and without regard to case second, so extra columns such
    as ``TEXT`` beside ``text`` never make the choice ambiguous. ``renamed`` maps a new name to
    a column's name. A missing column raises ``ValueError``.
    """
    at = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    out = []
    for new, old in [*((n, n) for n in names), *renamed.items()]:
        found = [i for i, c in enumerate(df.columns) if c == old] or [i for i, c in enumerate(df.columns) if c.lower() == old.lower()]
        if not found:
            raise ValueError(f"no column {old!r} among {df.columns}")
        out.append(at[f"_{found[0]}"].alias(new))
    return at.select(*out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none a temporary one serves on a local master, as in tests; on a
    cluster, whose executors could not read it, that is a ``RuntimeError``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tapeloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _files(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a table. The application's tables are deleted when its driver ends."""
    own = f"{shared_folder(spark).rstrip('/')}/tapeloom/{spark.sparkContext.applicationId}"
    fs, at = _files(spark, own)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        fs, at = _files(spark, path)
        fs.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage, survives executors."""
    return rewritten(df, name)[0]


def rewritten(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` with the table's path, for ``forget``."""
    spark, schema = df.sparkSession, df.schema
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def looked_up(many: DataFrame, one: DataFrame, key: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """``many`` joined (inner, left_semi, left_anti) with ``one``, which has a row for each ``key``.

    ``one`` is broadcast if it has at most ``most`` rows. Else both are shuffled, but for keys that
    fill over a thousandth of ``many``: at most a thousand, so their rows of ``one`` are broadcast
    and no task gets all rows of such a key.
    """
    most = BROADCAST_ROWS if most is None else most
    if one.count() <= most:
        return many.join(F.broadcast(one), key, how)
    least = many.count() // 1000 + 1
    heavy = many.groupBy(key).count().where(F.col("count") > least).select(key)
    rest = many.join(F.broadcast(heavy), key, "left_anti").join(one.hint("merge"), key, how)
    few = one.join(F.broadcast(heavy), key, "left_semi")
    return many.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(few), key, how).select(*rest.columns).union(rest)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANK_CLASS + "+"))


def count_words(text: Column) -> Column:
    """Number of words, as long; 0 for null."""
    return F.size(words(text)).cast("long")


def sample_by_hash(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows, the same ones each time: those whose key hashes low.

    All rows if there are no more than ``rows``. Needs no sort and no shuffle.
    """
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 20)) < int(rows / total * (1 << 20)) + 1)
