"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings, hashed. Those that tell the labels apart best on the
labelled sample are kept; over their presence in a document the machine learns a weight each and a
vector each, so that pairs of terms add the product of their vectors: what an insult and a group
mention say only together.

Defined results: null, empty and letterless texts get the score of no terms at all (a number like
any other); with no labelled rows every score is 0; rows that share a doc_id are treated alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import text_arrays
from tapeloom.llm.common import pick

BUCKETS, TERMS, FACTORS = 1 << 20, 4096, 8
SHORTEST, LONGEST = 3, 10  # letters of a word's beginnings
STEPPED = 64  # letters up to which words are hashed side by side; longer ones are hashed one by one
LEAST_DOCS = 3
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.05, 1e-5


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(12))) & np.uint32(BUCKETS - 1)


def terms(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, owner) by kind of term: the beginnings of 3, 4 .. 10 letters, and all words whole."""
    codes, starts, ends, owner = text_arrays.letters(texts)
    size, h = ends - starts, np.full(len(starts), 0x9747B28C, np.uint32)
    at = np.arange(len(starts))
    for k in range(min(STEPPED, int(size.max(initial=0)))):
        h = (h[size[at] > k] if k else h) * np.uint32(0x01000193) + codes[starts[at := at[size[at] > k]] + k]
        if SHORTEST <= k + 1 <= LONGEST:
            yield _mixed(h), owner[at]
        whole = size[at] == k + 1
        yield _mixed(~h[whole]), owner[at[whole]]
    at = np.flatnonzero(size > STEPPED)
    yield _mixed(np.array([xxhash.xxh32_intdigest(codes[starts[i] : ends[i]].tobytes()) for i in at], np.uint32)), owner[at]


def present(texts: list[str], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owner, term) once for each term in a text, sorted; ``kept`` maps buckets to terms or -1."""
    found = []
    for group in text_arrays.groups(texts):
        own = [texts[i] for i in group]
        for part in text_arrays.pieces(own[0]) if len(own) == 1 else [own]:
            for buckets, owner in terms([part] if isinstance(part, str) else part):
                if kept is not None:
                    t = kept[buckets]
                    buckets, owner = t[t >= 0], owner[t >= 0]
                found.append((owner + group[0]).astype(np.int64) << 32 | buckets.astype(np.int64))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


@dataclass
class Machine:
    kept: np.ndarray  # buckets -> term or -1
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The machine's output for n texts: all pairs in time linear in the terms."""
        linear = np.bincount(owner, self.weights[term], n)
        sums, squares = np.zeros((n, self.vectors.shape[1])), np.zeros(n)
        np.add.at(sums, owner, self.vectors[term])
        squares += np.bincount(owner, (self.vectors[term] ** 2).sum(axis=1), n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*present(texts, self.kept), len(texts)), -30, 30)))


def train(owner: np.ndarray, term: np.ndarray, label: np.ndarray, kept: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad over shuffled mini-batches; deterministic."""
    draw, n = np.random.default_rng(seed), len(label)
    k = int(kept.max(initial=-1)) + 1
    rate = min(max(label.mean() if n else 0.0, 1e-6), 1 - 1e-6)
    m = Machine(kept, float(np.log(rate / (1 - rate))), np.zeros(k), draw.normal(0, 0.02, (k, FACTORS)))
    if not n:
        m.bias = -30.0
        return m
    begin = np.searchsorted(owner, np.arange(n + 1))
    gb, gw, gv = 1e-2, np.full(k, 1e-2), np.full((k, FACTORS), 1e-2)
    for _ in range(EPOCHS):
        order = draw.permutation(n)
        for s in range(0, n, BATCH):
            docs = order[s : s + BATCH]
            at = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            who, what = np.repeat(np.arange(len(docs)), begin[docs + 1] - begin[docs]), term[at]
            v = m.vectors[what]
            sums = np.zeros((len(docs), FACTORS))
            np.add.at(sums, who, v)
            out = m.bias + np.bincount(who, m.weights[what], len(docs)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(who, (v**2).sum(axis=1), len(docs)))
            error = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[docs]
            dw = np.bincount(what, error[who], k) / len(docs) + DECAY * m.weights
            dv = np.zeros_like(m.vectors)
            np.add.at(dv, what, error[who, None] * (sums[who] - v))
            dv = dv / len(docs) + DECAY * m.vectors
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + error.mean() ** 2
            m.weights -= RATE * dw / np.sqrt(gw)
            m.vectors -= RATE * dv / np.sqrt(gv)
            m.bias -= RATE * error.mean() / np.sqrt(gb)
    return m


def learn(rows: DataFrame, n_terms: int = TERMS) -> Machine:
    """The machine from (text, label). Document counts of terms are summed in Spark; the best are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, label = b.column(0).to_pylist(), b.column(1).to_numpy()
            owner, term = present(texts)
            found, place = np.unique(term, return_inverse=True)
            toxic = np.bincount(place, label[owner], len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(place, minlength=len(found))), pa.array(toxic)], ["term", "n", "toxic"])

    total, toxic = (x or 0 for x in rows.agg(F.count("*"), F.sum("label")).first())
    sums = rows.mapInArrow(count, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST_DOCS)
    base = toxic / total if total else 0.0
    # Chi-square of a term's share of toxic documents against all documents' share.
    excess = F.col("toxic") - F.col("n") * F.lit(base)
    best = sums.orderBy((excess * excess / F.col("n")).desc(), "term").limit(n_terms).select("term").collect()
    kept = np.full(BUCKETS, -1, np.int32)
    kept[[r[0] for r in best]] = np.arange(len(best))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, term = present(b.column(0).to_pylist(), kept)
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([own, b.column(1)], ["terms", "label"])

    # Bounded by the sample: its documents' kept terms.
    found = rows.mapInArrow(features, "terms array<int>, label int").toArrow().to_pydict()
    order = sorted(range(len(found["label"])), key=lambda i: (found["terms"][i], found["label"][i]))
    sizes = [len(found["terms"][i]) for i in order]
    term = np.array([t for i in order for t in found["terms"][i]], np.int64)
    return train(np.repeat(np.arange(len(order)), sizes), term, np.array([found["label"][i] for i in order], float), kept)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for each row."""
    machine = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS and TERMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for at in range(0, len(texts), 512):
                out.append(machine.value.scores(texts[at : at + 512]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
