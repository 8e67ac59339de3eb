"""Each stage of the pipeline against brute force over what the stage before it kept."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tapeloom.llm import mixing, quality_rules, spm_bpe
from tests.llm.test_text import AWKWARD, SCHEMA, SF1, slow_lines, slow_measures, slow_similar, split_words


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mixture", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


def prose_rows():
    """Rows that the rules let pass, among awkward ones: without source, language or length, near and exact copies, shared lines, a very long text."""
    draw = random.Random(21)
    vocabulary = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(draw.choices(vocabulary, k=n))
    shared = prose(20)
    rows = [(100 + i, f"{prose(60)}\n{shared if i % 2 else shared.upper()}\n{prose(20)}", "en", ("a", "b", None)[i % 3], 9) for i in range(12)]
    base = prose(150)
    rows += [(200 + i, base + " " + " ".join(vocabulary[:i]), None, "c", None) for i in range(6)] + [(300, base, "en", None, 5), (301, prose(30_000), "en", "a", 1)]
    return [r for r in AWKWARD if r[0] not in (5, None)] + rows


@pytest.mark.parametrize("kind", ["tables", "awkward"])
def test_stages(spark, tmp_path, kind):
    docs = spark.read.parquet(f"{SF1}/documents.parquet") if kind == "tables" else spark.createDataFrame(prose_rows(), SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept, columns = {}, docs.columns
    for name in ("quality", "lines", "near_copies", "mixture"):
        stages[name](spark, docs.withColumn("extra", F.lit(1)).withColumn("_0", F.lit("clash")), SF1).write.parquet(str(tmp_path / name))
        kept[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
    before, after = kept["quality"]
    passed = {r["doc_id"] for r in quality_rules.measure(spark.createDataFrame(before, SCHEMA)).where("kept").collect()}
    assert {r["doc_id"] for r in after} == passed and not any(slow_measures(r["text"])[5] for r in after)
    before, after = kept["lines"]
    dropped = Counter({(i, h): n for (i, _, _, h), n in slow_lines([(r["doc_id"], r["text"]) for r in before]).items()})
    assert Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in after) == dropped
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = kept["near_copies"]
    groups = slow_similar([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(groups.values())) and len(after) < len(before)
    before, after = kept["mixture"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(before, SCHEMA)).collect()}
    assert Counter(r["doc_id"] for r in after) == Counter({i: n for i, n in copies.items() if n})
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=spm_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in after}
    found = stages["tokens"](spark, docs, SF1).collect()
    assert len(found) == len(after)
    assert all(list(r["ids"]) == reference.encode_ordinary(texts[r["doc_id"]]) for r in random.Random(0).sample(found, min(40, len(found))))
    assert sum(len(split_words(t)) for t in texts.values()) > 0


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    draw = random.Random(22)
    prose = " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(80))
    others = [" ".join("".join(draw.choices("ijklmnop", k=5)) for _ in range(80)) for _ in range(4)]
    # Copies without an id and rows repeated whole: one of them stays, and the mix may take it twice.
    rows = [*AWKWARD, (None, prose, None, None, None), (None, prose, None, None, None), *[(i, t, "en", "a", 1) for i, t in enumerate(others)], (2, others[2], "en", "a", 1)]
    for k, given in enumerate((rows, [])):
        spark.createDataFrame(given, SCHEMA).write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / str(k))).collect()
        if not given:
            assert not found
            continue
        counts = Counter(r["doc_id"] for r in found)
        assert set(counts) <= {None, 0, 1, 2, 3} and set(counts.values()) <= {1, 2}
        assert sum(counts.values()) * 80 == pytest.approx(1.5 * 5 * 80, abs=160)
        assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in found)
