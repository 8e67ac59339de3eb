"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source's target is a number of words. Within a source a document's expected copies are
proportional to its weight - by default the number of binary digits of its size, so that a document
of 1000 words is expected twice as often as one of 30 - and at most ``MOST_COPIES``; what that
bound cuts off goes to the other documents by weight. The whole part of the expected copies is
taken for certain; the rest is the inclusion probability in an order sample: documents are ranked
by random odds over inclusion odds, ``U / (1 - U)`` over ``p / (1 - p)``, and taken in that order.
What is fixed is the sample's size in words, the source's target less the certain copies: the last
document is taken if at least half of it fits. Random numbers are hashes of doc_id and text, so
reruns agree.

A source's order is never sorted as a whole: sums over 64 ranges of the rank key find the range
in which the target falls, that range is cut by 64 again while it has many rows, and only the
rows of the last one are sorted.

Defined results: null or empty texts have size 0 and are not taken; a null source is a source,
ordered last; rows alike in doc_id and text share their random number, and where the target falls
among them any of them are taken; a source without words has target 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import count_words, looked_up, pick, written

WEIGHTS, SHARE, MOST_COPIES, SEED = (5, 2, 1), 1.5, 2, "mix"
#: Parts that a range of the rank key is cut into, as a power of two, how often, and the rows at which cutting stops.
CUT_BITS, MOST_CUTS, RANGE_ROWS = 6, 7, 256
#: Weights of documents are whole numbers up to this, so a source has few of them.
MOST_WEIGHT = 1000


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 of the id and the MD5 of the text."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(key), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs).

    ``share`` of all words is dealt by weight; a target stops at ``most`` times its source's size
    and the excess is dealt again by weight. In the order of size over weight the sources that stop
    are a prefix, which gives the shares of the others in closed form.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    upto, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # level: words for each unit of weight if this source and those after it don't stop.
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / F.sum("w").over(after)
    ranked = weighed.withColumn("level", level).withColumn("stops", F.lit(most) * F.col("source_size") <= F.col("level") * F.col("w"))
    final = F.min(F.when(~F.col("stops"), F.struct(F.row_number().over(order).alias("k"), "level"))).over(Window.partitionBy())
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(final.isNull(), F.lit(most) * F.col("source_size")).otherwise(F.least(F.lit(most) * F.col("source_size"), final["level"] * F.col("w")))
    return ranked.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _source(*more: str) -> Column:
    """The source (null has a place of its own) and further columns as one key."""
    return F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), *more)


def expectations(groups: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """(source, own, words, source_size, target, whole, p): expected copies of documents with weight ``own``.

    ``groups`` has (source, own, words). In the order of falling weight those at the bound are a
    prefix, which gives the copies for each unit of weight of the others in closed form.
    """
    at = groups.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    down = Window.partitionBy("source").orderBy(F.col("own").desc())
    before, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    unit = (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.nullif(F.sum(F.col("own") * F.col("words")).over(rest), F.lit(0))
    at = at.withColumn("unit", unit)
    unit = F.max_by("unit", F.when(F.col("unit") * F.col("own") < most, F.col("own"))).over(Window.partitionBy("source"))
    expected = F.when(F.col("own") == 0, F.lit(0.0)).when(unit.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), unit * F.col("own")))
    at = at.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    return at.withColumn("p", F.col("expected") - F.col("whole")).select("source", "own", "words", "source_size", "target", "whole", "p")


def _cuts(rows: DataFrame, left: DataFrame, range_rows: int) -> DataFrame:
    """(s, lo, hi, left): where each source's order stops. Keys below lo are taken, those from hi on are not.

    Of the keys in between so many words are taken as ``left`` says. ``rows`` has (s, key, size),
    ``left`` the words to take for each s.
    """
    cuts, level = left.select("s", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), "left", F.lit(None).cast("long").alias("n")), 0
    while level < MOST_CUTS and (not level or not cuts.where(F.col("n") > range_rows).isEmpty()):
        level += 1
        parts = float(1 << CUT_BITS * level)
        inside = rows if level == 1 else looked_up(rows, cuts.where(F.col("n") > range_rows).select("s", "lo", "hi"), "s").where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
        sums = inside.groupBy("s", F.floor(F.col("key") * parts).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bin"))  # at most 1 << CUT_BITS rows of a source
        sums = sums.withColumn("before", upto - F.col("words")).join(cuts.select("s", F.col("left").alias("_left")), "s")
        # The first part that does not fit whole.
        over = F.col("before") + F.col("words") > F.col("_left")
        first = sums.where(over).groupBy("s").agg(F.min(F.struct("bin", "before", "n")).alias("x"))
        at = cuts.join(first, "s", "left")
        done = F.col("x").isNull() if level == 1 else F.col("x").isNull() & (F.col("n") > range_rows)
        new = F.col("x").isNotNull()
        cuts = written(
            at.select(
                "s", F.when(new, F.col("x.bin") / parts).when(done, F.lit(2.0) if level == 1 else F.col("hi")).otherwise(F.col("lo")).alias("lo"),
                F.when(new, (F.col("x.bin") + 1) / parts).when(done, F.lit(2.0) if level == 1 else F.col("hi")).otherwise(F.col("hi")).alias("hi"),
                F.when(new, F.col("left") - F.col("x.before")).otherwise(F.col("left")).alias("left"), F.when(new, F.col("x.n")).when(done, F.lit(0)).otherwise(F.col("n")).alias("n"),
            ), "cuts",
        )
    return cuts.select("s", "lo", "hi", "left")


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, weight_col: str | None = None, seed: str = SEED,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, source, size, text_hash, source_size, target, copies, taken) for each row.

    ``weight_col`` names a column with the documents' weights (rounded to whole numbers from 0 to
    ``MOST_WEIGHT``; null: 1; 0: never taken). ``taken`` is copies times size.
    """
    named = {"doc_id": "doc_id", "source": "source", "text": "text"} | ({"given": weight_col} if weight_col else {})
    size = count_words(F.col("text"))
    own = F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(0), F.coalesce(F.round(F.col("given")).cast("int"), F.lit(1)))) if weight_col else F.length(F.bin("size"))
    sized = pick(docs, **named).select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), *(["given"] if weight_col else []))
    sized = written(sized.select("doc_id", "source", "size", "text_hash", "u", F.when(F.col("size") == 0, 0).otherwise(own).alias("own")), "sizes")
    groups = sized.groupBy("source", "own").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    goal = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs")), weights, share, most).drop("n_docs")
    plan = written(expectations(groups, goal, most).withColumn("g", _source("own")), "mix-plan")  # a row for each source and weight
    rows = looked_up(sized.withColumn("g", _source("own")), plan.select("g", "source_size", "target", "whole", "p"), "g").drop("g", "own")
    # The key runs from 0 to 1 as the ratio of odds runs from 0 to infinity.
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.greatest(F.col("p"), F.lit(1e-12)))
    rows = rows.withColumn("key", odds / (1 + odds)).withColumn("s", _source())
    left = plan.withColumn("s", _source()).groupBy("s").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("left"))
    cuts = _cuts(rows.where("p > 0").select("s", "key", "size"), left, range_rows)
    rows = looked_up(rows, cuts, "s")
    inside = (F.col("p") > 0) & (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))
    keep = ["doc_id", "source", "size", "text_hash", "source_size", "target", "whole"]
    sure = rows.where(~inside).select(*keep, F.when((F.col("p") > 0) & (F.col("key") < F.col("lo")), 1).otherwise(0).alias("more"))
    # Of a range with few rows: taken if at least half of it fits, so the sum misses by half a document at most.
    order = Window.partitionBy("s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(inside).withColumn("fits", F.sum("size").over(order) - F.col("size") / 2 <= F.col("left")).select(*keep, F.when(F.col("fits"), 1).otherwise(0).alias("more"))
    copies = (F.col("whole") + F.col("more")).cast("long")
    return sure.union(edge).select("doc_id", "source", "size", "text_hash", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``.

    Rows are told apart by doc_id, source and text; of those alike in all three each gets as many
    copies as the others, or one more.
    """
    plan = mix(docs, **options)
    plan = plan.groupBy(F.col("doc_id").alias("i"), F.col("source").alias("c"), F.col("text_hash").alias("h")).agg(F.sum("copies").alias("all"), F.count("*").alias("rows")).where(F.col("all") > 0)
    at = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    doc_id, source, text = (F.col(f"_{docs.columns.index(c)}") for c in ("doc_id", "source", "text"))
    at = at.withColumn("_h", F.xxhash64(text))
    both = at.join(plan, doc_id.eqNullSafe(F.col("i")) & source.eqNullSafe(F.col("c")) & (F.col("_h") == F.col("h")))
    nth = F.when(F.col("rows") == 1, 1).otherwise(F.row_number().over(Window.partitionBy(doc_id, source, F.col("_h")).orderBy(F.lit(1))))
    both = both.withColumn("_n", (F.floor(F.col("all") / F.col("rows")) + F.when(nth <= F.col("all") % F.col("rows"), 1).otherwise(0)).cast("int")).where("_n > 0")
    return both.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*[f"_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
