"""Language identification by multilingual mixture inference.

A language is a distribution of character trigrams (with word edges). Each word of a document has
a likelihood under each language; expectation-maximisation finds the proportions of the languages
among the document's words. The set of languages has the best likelihood less a penalty for each
language beyond the first: from the best single language, one language at a time joins or leaves
the set, the one that gains most, until none gains. The prediction is the language with most words.

Defined results: null, empty and letterless texts are ``und`` with score 0; rows without a lang
are not learned from; with nothing to learn from every text is ``und``; rows that share a doc_id
are treated alike; ties go to the language first by name; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import text_arrays
from tapeloom.llm.common import pick, sample_by_hash

BUCKETS = 1 << 16
#: Documents to learn from: all up to this many, else about so many, chosen by hash of their id.
FIT_DOCS = 20_000
#: Log likelihood that a further language must gain, times the logarithm of the number of words.
PENALTY, STEPS = 3.0, 12
UNKNOWN = "und"


def trigrams(codes: np.ndarray) -> np.ndarray:
    """A bucket for each code: the trigram around it."""
    c = codes.astype(np.uint32)
    h = c[:-2] * np.uint32(0x85EBCA6B) + c[1:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logs: np.ndarray  # buckets x languages, float32

    def word_logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods of all words x languages, owner of each word)."""
        codes, starts, ends, owner = text_arrays.letters(texts)
        if not len(starts):
            return np.empty((0, len(self.languages)), np.float32), owner
        grams = trigrams(codes)[codes[1:-1] != 0]
        at = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
        return np.add.reduceat(self.logs[grams], at, axis=0), owner

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, has words): a row of proportions for each text, zero outside its set."""
        if len(texts) == 1 and len(texts[0]) > text_arrays.PIECE:
            logs = np.concatenate([self.word_logs([p])[0] for p in text_arrays.pieces(texts[0])])
            owner = np.zeros(len(logs), np.int64)
        else:
            logs, owner = self.word_logs(texts)
        out, has = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        if len(logs):
            docs, starts, counts = np.unique(owner, return_index=True, return_counts=True)
            has[docs] = True
            out[docs] = self._select(logs, starts, counts)
        return out, has

    def _select(self, logs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        single = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
        best = single.argmax(axis=1)
        rows = np.arange(len(starts))
        if logs.shape[1] == 1:
            return np.ones((len(starts), 1))
        top = logs.max(axis=1, keepdims=True)
        likely = np.exp(np.maximum(logs - top, -60))
        base = np.add.reduceat(top[:, 0], starts, dtype=np.float64)
        chosen = np.zeros(single.shape)
        chosen[rows, best] = 1.0
        value = single[rows, best]
        full, _ = self._em(likely, starts, counts, np.full(single.shape, 1.0 / single.shape[1]), STEPS)
        # Where one language has all but a word, no set of more can pay.
        open_, member = np.flatnonzero((1 - full.max(axis=1)) * counts > 0.5), chosen > 0
        while len(open_):
            words = np.concatenate([np.arange(s, s + c) for s, c in zip(starts[open_], counts[open_], strict=True)])
            now, n = value[open_].copy(), counts[open_]
            begin = np.concatenate(([0], np.cumsum(n)[:-1]))
            share, sets = chosen[open_], member[open_]
            for j in range(logs.shape[1]):
                moved = member[open_]
                moved[:, j] ^= True
                cost = base[open_] - PENALTY * (moved.sum(axis=1) - 1) * np.log(n + 1.0)
                # No mixture is likelier than the best language of the set for each word.
                most = np.log(np.maximum((likely[words] * np.repeat(moved, n, axis=0)).max(axis=1).astype(np.float64), 1e-300))
                at = np.flatnonzero(moved.any(axis=1) & (np.add.reduceat(most, begin) + cost > now))
                if len(at):
                    some, gained = self._fit(likely, starts[open_[at]], n[at], moved[at], full[open_[at]])
                    better = gained + cost[at] > now[at] + 1e-9
                    now[at[better]], share[at[better]], sets[at[better]] = (gained + cost[at])[better], some[better], moved[at[better]]
            gains = now > value[open_]
            open_, now, share, sets = open_[gains], now[gains], share[gains], sets[gains]
            value[open_], chosen[open_], member[open_] = now, share, sets
        return chosen

    @classmethod
    def _fit(cls, likely: np.ndarray, starts: np.ndarray, counts: np.ndarray, sets: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log likelihood) of documents' words under the languages of their sets; ``near`` is where the steps begin."""
        words = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts, strict=True)])
        share = np.where(sets, near + 1e-3, 0.0)
        return cls._em(likely[words], np.concatenate(([0], np.cumsum(counts)[:-1])), counts, share / share.sum(axis=1, keepdims=True), STEPS)

    @staticmethod
    def _em(likely: np.ndarray, starts: np.ndarray, counts: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log likelihood) after so many steps from the given proportions."""
        for _ in range(steps):
            q = likely * np.repeat(share, counts, axis=0)
            share = np.add.reduceat(q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300), starts, axis=0) / counts[:, None]
        total = (likely * np.repeat(share, counts, axis=0)).sum(axis=1)
        return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), starts)


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """The model from the rows of (doc_id, text, lang) with a text and a lang; whole texts, counted in Spark."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = sample_by_hash(known, "doc_id", fit_docs, known.select("doc_id").count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in text_arrays.pieces(text):
                    codes = text_arrays.letters([piece])[0]
                    own += np.bincount(trigrams(codes)[codes[1:-1] != 0], minlength=BUCKETS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    sums = known.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most languages x BUCKETS rows, whatever the corpus.
    found = sums.toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    table = np.zeros((BUCKETS, len(names)))
    if names:
        table[found["bucket"].to_numpy(), np.searchsorted(names, found["lang"].to_numpy(zero_copy_only=False).astype(str))] = found["n"].to_numpy()
    p = (table + 0.3) / (table.sum(axis=0, keepdims=True) + 0.3 * BUCKETS)
    return Model(names, np.log(p).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, mixture): score is the share of the predicted language's words."""
    model = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            langs, scores, mixed = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for at in text_arrays.groups(texts) if m.languages else ():
                share, has = m.mixtures([texts[i] for i in at])
                for i, own, ok in zip(at, share, has, strict=True):
                    if ok:
                        k = int(own.argmax())
                        langs[i], scores[i] = m.languages[k], min(1.0, float(own[k]))
                        mixed[i] = [(m.languages[j], float(own[j])) for j in np.flatnonzero(own)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "mixture"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string, double>")
