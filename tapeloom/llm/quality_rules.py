"""Quality rules as a short-circuit cascade, with DataFrame operations only.

A rule rejects a document. On a bounded sample each rule's cost and selectivity (share it rejects)
are estimated, and the rules are put in the order of rejection per cost; a document is tested by the
rules in that order until one rejects it. A rule's cost is the work that it would do on the sample's
documents: characters or words gone through, times what one takes. The clock is not asked, so the
same table gives the same order each time. The order decides only what is computed, never the verdict.

The measures of the contract are computed for every row, ``n_repeat_words``, the dearest, too, as the
query returns them; ``filtered`` needs no measures and runs all rules, those of the contract among
them, as one cascade.

Defined results: a null or empty text has no words and is rejected as too short; rows are treated
alike whatever their doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import BLANK_CLASS, BLANKS, pick, words, written

SYMBOLS = "#*$%&|<>"
#: Rows on which cost and selectivity are estimated: about so many, chosen at random.
SAMPLE_ROWS = 10_000
#: Nanoseconds for a character or word: to split text, to replace in it, to hash and sort windows of words (measured on one core).
SPLIT, REPLACE, WINDOWS = 5, 15, 570
WINDOW = 3


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK_CLASS + "+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")


def n_repeat_words(found: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more, the first included.

    If all windows' hashes differ there are none. Otherwise windows are sorted by hash and words,
    so equal ones are neighbours (compared by their words), and the positions they cover counted.
    """
    last = F.size(found) - WINDOW
    at, word = F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.get(found, i)
    digest = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))
    hashed = F.transform(at, digest)
    windows = F.sort_array(F.transform(at, lambda i: F.struct(digest(i).alias("h"), word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("at"))))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def covered(s: Column) -> Column:  # s: the sorted windows, as a lambda's argument, so computed once
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["at"])), start, step, lambda acc: acc["n"])

    none = (last < 1) | (F.size(F.array_distinct(hashed)) == F.size(hashed))
    return F.when(none, F.lit(0)).otherwise(F.transform(F.array(windows), covered)[0]).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes a boolean expression from a document's text and its array of words, ``work`` one of its cost in nanoseconds."""

    name: str
    rejects: Callable[[Column, Column], Column]
    work: Callable[[Column, Column], Column] = lambda t, w: REPLACE * F.length(t)


def base_rules() -> list[Rule]:
    """The rules of the contract."""
    return [
        Rule("short", lambda t, w: F.size(w) < 50, lambda t, w: F.lit(1)),
        Rule("repeats", lambda t, w: 100 * n_repeat_words(w) > 50 * F.size(w), lambda t, w: WINDOWS * F.size(w)),
    ]


def further_rules() -> list[Rule]:
    """Of the usual web-text heuristics those that spare clean prose."""

    def same_lines(t: Column, w: Column) -> Column:
        return F.transform(F.array(lines_with_words(t)), lambda lines: 2 * n_dup_lines(lines) > F.size(lines))[0]

    return [
        Rule("symbols", lambda t, w: 10 * n_symbols(t) > F.size(w), lambda t, w: SPLIT * F.length(t)),
        Rule("word_length", lambda t, w: ~word_chars(t).between(2 * F.size(w), 15 * F.size(w))),
        Rule("same_lines", same_lines, lambda t, w: SPLIT * F.length(t)),
        Rule("capitals", lambda t, w: 2 * n_capitals(t) > word_chars(t), lambda t, w: 2 * REPLACE * F.length(t)),
    ]


def ordered(docs: DataFrame, given: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by estimated rejection for each nanosecond, highest first; of equals as given."""
    text, total = F.coalesce("text", F.lit("")), docs.count()
    # A random sample rather than a limit, which would send as many rows of every partition to one task.
    some = docs.select("text").sample(min(1.0, sample_rows / max(total, 1)), seed=5)
    sample = written(some.select(text.alias("text"), words(text).alias("words")), "rule-sample")
    t, w = F.col("text"), F.col("words")
    shares = [F.avg(r.rejects(t, w).cast("double")) for r in given]
    found = sample.agg(*shares, *(F.avg(r.work(t, w)) for r in given)).first()
    worth = {r.name: (found[i] or 0.0) / max(1.0, found[len(given) + i] or 0.0) for i, r in enumerate(given)}
    return sorted(given, key=lambda r: -worth[r.name])


def verdict(in_order: Sequence[Rule], text: Column, found: Column) -> Column:
    """Whether no rule rejects; later rules are evaluated only where the earlier ones let pass."""
    passed = F.lit(True)
    for r in reversed(in_order):
        passed = F.when(r.rejects(text, found), F.lit(False)).otherwise(passed)
    return passed


def measure(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base measures of each row, base_failed, and the cascade's verdict in kept."""
    docs = pick(docs, "doc_id", "text")
    text, found = F.col("text"), F.col("words")
    # The always true condition is not deterministic to the optimiser, so a filter on the result stays
    # above this projection and never has the splitting written into each of its lambdas.
    once = F.when(F.spark_partition_id() >= 0, words(text))
    split = docs.withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", "text", once.alias("words"))
    measured = split.select(
        "doc_id", "text", "words", F.size(found).cast("long").alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"),
        n_dup_lines(lines_with_words(text)).alias("n_dup_lines"), n_repeat_words(found).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(ordered(docs, further_rules(), sample_rows), text, found))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.withColumn("base_failed", failed).select(*names, "base_failed", kept.alias("kept"))


def filtered(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the whole cascade lets pass, unchanged."""
    at = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(f"_{docs.columns.index('text')}"), F.lit(""))
    order = ordered(pick(docs, "text"), [*base_rules(), *further_rules()], sample_rows)
    # The words are a lambda's argument, so they are split once however the filter is moved about.
    return at.where(F.transform(F.array(words(text)), lambda found: verdict(order, text, found))[0]).toDF(*docs.columns)
