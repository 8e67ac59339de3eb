"""Byte-level BPE run by a sentencepiece model that is written directly from a vocabulary of ranks.

Each byte is mapped to one printable character, so that every token becomes a piece; a piece's
score is its negative rank, and the normaliser is the identity. sentencepiece then merges the best
scored, leftmost pair first, which is what byte-level BPE does by ranks. Nothing is trained and no
file is written: the model is serialised into memory and shipped with the task.

Defined results: null and empty texts have no tokens; rows are treated alike whatever their
doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from tapeloom.llm.common import pick

#: Pre-tokens whose encoding a worker remembers before the oldest are forgotten, and those handled at once.
REMEMBERED, AT_ONCE = 200_000, 20_000


def byte_alphabet() -> list[str]:
    """A character for each byte: itself where printable and not blank, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the last id is the unknown piece."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold every single byte")
    alphabet, n = byte_alphabet(), len(tokens)

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    pieces = b"".join(piece("".join(alphabet[b] for b in t), -float(r), 1) for r, t in enumerate(tokens))
    off = 2**64 - 1  # -1: the model has no such piece
    trainer = _number(3, 2) + _number(4, n + 1) + _number(40, n) + _number(41, off) + _number(42, off) + _number(43, off)
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + piece("<unk>", 0.0, 2) + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """Encodes and decodes texts; remembers the encodings of a bounded number of pre-tokens.

    Once ``known`` is full it becomes ``before``, whose entries return to ``known`` as they are
    met; those not met again are gone when it fills the next time.
    """

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_alphabet()))  # as latin-1 text, a byte is its own code point
        back = {c: b for b, c in self.table.items()}
        self.tokens = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}

    def _learn(self, parts: list[str]) -> None:
        """Makes ``known`` hold all of ``parts``."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before, new = self.known, self.before, []
        for p in set(parts):
            if p not in known:
                if (ids := before.get(p)) is None:
                    new.append(p)
                else:
                    known[p] = ids
        if new:
            mapped = [p.encode("utf-8", "replace").decode("latin-1").translate(self.table) for p in new]
            known.update(zip(new, self.model.encode(mapped, num_threads=1), strict=True))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text: each match of the pattern is encoded separately."""
        waiting, count = [], 0
        for text in texts:
            waiting.append(self.split(text))
            count += len(waiting[-1])
            if count >= AT_ONCE:
                yield from self._ids(waiting)
                waiting, count = [], 0
        yield from self._ids(waiting)

    def _ids(self, several: list[list[str]]) -> Iterator[list[int]]:
        if len(several) == 1:  # perhaps a very long text
            parts, ids = several[0], []
            for at in range(0, len(parts), AT_ONCE):
                some = parts[at : at + AT_ONCE]
                self._learn(some)
                ids += chain.from_iterable(map(self.known.__getitem__, some))
            yield ids
            return
        self._learn(list(chain.from_iterable(several)))
        for parts in several:
            yield list(chain.from_iterable(map(self.known.__getitem__, parts)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, by the inverse of the byte mapping."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, ids_out: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) for each row.

    ``ids_sha256`` is of the decimal ids joined by a space, ``decoded_sha256`` of the bytes that
    the ids decode to; ``ids`` is null without ``ids_out``. The rank file is read on the driver.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        digits = [str(i) for i in range(len(codec.tokens))]
        for b in batches:
            out, counts, named, back = [], [], [], []
            for ids in codec.encode_all([text or "" for text in b.column(1).to_pylist()]):
                if ids_out:
                    out.append(pa.array(ids, pa.int32()))
                counts.append(len(ids))
                named.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            if ids_out:
                ends = [0]
                for n in counts:
                    ends.append(ends[-1] + n)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(out) if out else pa.array([], pa.int32()))
            else:
                ids = pa.nulls(b.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), ids, pa.array(counts, pa.int64()), pa.array(named, pa.string()), pa.array(back, pa.string())], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
