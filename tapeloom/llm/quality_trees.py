"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are binned by quantiles of the labelled sample; each tree is grown level by level from
histograms of gradients. Trees are complete and flattened into arrays, so that all documents of a
batch go down all trees at once.

Defined results: null and empty texts have all statistics zero and a score like any other; with no
labelled rows every score is 0; rows that share a doc_id are treated alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.common import pick

TREES, DEPTH, RATE, BINS = 80, 4, 0.15, 64
SHRINK, LEAST_HESSIAN = 1.0, 2.0
_KINDS = {
    "lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "other": range(0x80, 0x100),
    "stop": b".", "comma": b",", "shout": b"!?", "bar": b"|", "symbol": b"#*$%&<>@^~=+_\\{}[]", "mark": b"\"'()-:;/",
}
NAMES = (
    "log_words", "log_bytes", "bytes_per_word", "longest_word", "short_words", "distinct_words", "distinct_windows", "lines", "words_per_line",
    "distinct_lines", "lines_stopped", "capitalised", *(f"share_{k}" for k in _KINDS),
)
_CLASS = np.zeros((256, len(_KINDS)))
for _j, _bytes in enumerate(_KINDS.values()):
    _CLASS[list(_bytes), _j] = 1


def statistics(text: str | None) -> list[float]:
    """The document's statistics in the order of NAMES."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / sizes.sum()
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 1.0
    return [
        np.log1p(n), np.log1p(len(data)), sizes.mean(), np.log1p(sizes.max()), (sizes <= 3).mean(), len(set(words)) / n, windows, np.log1p(len(lines)), n / len(lines),
        len(set(lines)) / len(lines), sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), sum(map(bytes.istitle, words)) / n, *kinds,
    ]


@dataclass
class Trees:
    bias: float
    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # go right if greater
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of statistics."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.above[trees, at])
        total = self.bias + self.leaf[trees, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss with histograms; deterministic."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    out = Trees(-30.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return out
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    out.bias = float(np.log(rate / (1 - rate)))
    total, kept = np.full(len(y), out.bias), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, above, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        at = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            gains = np.zeros((x.shape[1], width, BINS))
            for j in range(x.shape[1]):
                place = (at - first) * BINS + binned[:, j]
                left_g = np.bincount(place, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                left_h = np.bincount(place, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK) - all_g**2 / (all_h + SHRINK)
                gains[j] = np.where((left_h >= LEAST_HESSIAN) & (all_h - left_h >= LEAST_HESSIAN), gain, 0)
            for k in range(width):
                j, b = np.unravel_index(gains[:, k].argmax(), (x.shape[1], BINS))
                if gains[j, k, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], above[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > above[at])
        sum_g, sum_h = (np.bincount(at - inner, v, leaves) for v in (g, h))
        leaf = -RATE * sum_g / (sum_h + SHRINK)
        total += leaf[at - inner]
        for to, v in zip(kept, (feature, above, leaf), strict=True):
            to.append(v)
    out.feature, out.above, out.leaf = map(np.stack, kept)
    return out


def learn(rows: DataFrame) -> Trees:
    """The trees from (text, label); only the sample's statistics reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(0).to_pylist()]).reshape(-1, len(NAMES))
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([own, b.column(1)], ["x", "label"])

    found = rows.mapInArrow(run, "x array<double>, label int").toArrow().to_pydict()
    order = sorted(range(len(found["label"])), key=lambda i: (found["x"][i], found["label"][i]))
    return train(np.array([found["x"][i] for i in order]).reshape(-1, len(NAMES)), np.array([found["label"][i] for i in order], float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(trees.scores(x))], ["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
