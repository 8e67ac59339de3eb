"""Fuzzy search for short licence notices: exact seeds by the pigeonhole principle, verified by bounded edits.

A notice has words that may be misspelt and, after them, a *tail* that tells it from its relatives
(a version, the terms of a Creative Commons licence) and must stand as it is. Words that occur with
``k`` edits or fewer keep at least one of their ``k + 1`` pieces intact. All notices' pieces are
searched in one pass over the normalised text (A-Z lower-cased, words joined by one space); around
each hit that has the tail near, the regex library matches the words with at most ``k`` errors,
from the beginning of a word to the end of one, and reports the span. Base phrases are found
exactly, on word boundaries.

Defined results: null and empty texts have no words and no labels; rows are treated alike whatever
their doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tapeloom.llm.common import pick

#: Fixed values of the contract: phrases whose words must stand consecutively, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Terms of the Creative Commons licences, short and long, and the versions they came in.
_TERMS = {
    "by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives",
    "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives",
}
_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _creative_commons() -> Iterator[tuple[str, str, str]]:
    for short, long in _TERMS.items():
        for version in _VERSIONS:
            label = "cc-" + short.replace(" ", "-")
            yield label, "licensed under", f"cc {short} {version}"
            yield label, "under a creative commons", f"{long} {version}"


def _gnu() -> Iterator[tuple[str, str, str]]:
    """Each family with the versions there are, and without a number."""
    for label, name, versions in (("gpl", "general", "23"), ("lgpl", "lesser general", "23"), ("agpl", "affero general", "3")):
        for opening in ("licensed under the", "under the terms of the"):
            words = f"{opening} gnu {name} public license"
            yield label, words, ""
            yield from ((f"{label}-{v}", words, tail) for v in versions for tail in (f"version {v}", f"v{v}"))


#: Notices searched with edits: label, words that may have edits, and a tail that may not. The words
#: are those with which projects usually name a licence or with which the public licence text opens.
NOTICES = (
    ("mit", "released under the mit license", ""),
    ("mit", "licensed under the mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ""),
    ("apache-2", "licensed under the apache license version", "2 0"),
    ("apache-2", "licensed under the apache license", "2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", ""),
    ("bsd", "licensed under the bsd license", ""),
    ("bsd-2", "licensed under the", "bsd 2 clause license"),
    ("bsd-3", "licensed under the", "bsd 3 clause license"),
    ("mpl-2", "subject to the terms of the mozilla public license", "v 2 0"),
    ("mpl-2", "licensed under the mozilla public license", "2 0"),
    ("epl-2", "licensed under the eclipse public license", "2 0"),
    ("cc0", "creative commons zero public domain dedication", ""),
    ("cc0", "dedicated to the public domain under", "cc0 1 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ""),
    ("isc", "licensed under the isc license", ""),
    ("zlib", "this software is provided as is without any express or implied warranty in no event", ""),
    ("boost-1", "distributed under the boost software license version", "1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
    *_gnu(),
    *_creative_commons(),
)
#: Edits allowed for so many characters of a notice's words; short ones, which differ by little, get fewer.
CHARS_PER_EDIT, MOST_EDITS = 14, 4
_SPLIT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


@dataclass(frozen=True)
class Span:
    label: str
    start: int  # in bytes of the normalised text
    end: int
    edits: int
    notice_chars: int


def normal(text: str | None) -> tuple[bytes, int]:
    """The words of a text joined by single spaces, one at either end too; and their number."""
    found = (text or "").encode("utf-8", "replace").translate(_SPLIT).split()
    return b" " + b" ".join(found) + b" " if found else b" ", len(found)


def places(body: bytes, phrase: bytes) -> Iterator[int]:
    at = body.find(phrase)
    while at >= 0:
        yield at
        at = body.find(phrase, at + 1)


class Search:
    def __init__(self, notices: Sequence[tuple[str, str, str]] = NOTICES):
        self.base = [(b" " + p.encode() + b" ", label) for p, label in BASE.items()]
        self.notices, seeds = [], {}
        for k, (label, words, tail) in enumerate(notices):
            body, tail, edits = words.encode(), (b" " + tail.encode() + b" " if tail else b""), min(MOST_EDITS, len(words) // CHARS_PER_EDIT)
            cuts = [len(body) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(body[a:b].decode("latin-1"), []).append((k, a))
            # What follows the words, if the notice has no tail of its own, is the end of a word.
            pattern = rb"(?b)(?<= )(?:%s){e<=%d}%s" % (regex.escape(body, literal_spaces=True), edits, rb"(?= )" if not tail else b"(?=%s)" % tail)
            self.notices.append((label, len(body), edits, tail, regex.compile(pattern)))
        self.seeds = ahocorasick.Automaton()
        for seed, owners in seeds.items():
            self.seeds.add_word(seed, (len(seed), owners))
        self.seeds.make_automaton()

    def verified(self, body: bytes) -> list[Span]:
        """A span for each place where a notice's words stand with few enough edits, and its tail after them."""
        tried, found = set(), set()
        for last, (length, owners) in self.seeds.iter(body.decode("latin-1")):
            for k, offset in owners:
                label, size, edits, tail, pattern = self.notices[k]
                begin = max(0, last + 1 - length - offset - edits - 1)
                if (k, begin) in tried:
                    continue
                tried.add((k, begin))
                window = body[begin : begin + size + 2 * edits + 2 + max(1, len(tail))]
                if tail not in window:
                    continue
                if m := pattern.search(window):
                    end = begin + m.end() + max(0, len(tail) - 1)
                    found.add(Span(label, begin + m.start(), end, sum(m.fuzzy_counts), size + max(0, len(tail) - 1)))
        return list(found)

    def spans(self, body: bytes) -> list[Span]:
        """Verified spans, the best of those that overlap: fewest edits for their length, then the longer, then the first."""
        found = sorted(self.verified(body), key=lambda s: (s.edits / s.notice_chars, -s.notice_chars, s.start, s.label))
        best: list[tuple[int, int, Span]] = []
        for s in found:
            at = bisect_left(best, (s.start, s.end))
            if (at == 0 or best[at - 1][1] <= s.start) and (at == len(best) or best[at][0] >= s.end):
                best.insert(at, (s.start, s.end, s))
        return [s for _, _, s in best]

    def scan(self, text: str | None) -> dict:
        body, n_words = normal(text)
        starts, base = [], set()
        for phrase, label in self.base:
            for at in places(body, phrase):
                starts.append(at)
                base.add(label)
        spans = self.spans(body)
        likeness = [1.0 - s.edits / s.notice_chars for s in spans]
        gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32) if starts or spans else None
        word = lambda at: int(np.searchsorted(gaps, at))  # noqa: E731  (number of spaces before a place)
        return {
            "n_words": n_words, "n_base": len(starts),
            "first_word": word(min(starts)) if starts else None, "last_word": word(max(starts)) if starts else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s.label for s in spans})),
            "score": 1.0 if base else max(likeness, default=0.0),
            "spans": [
                {"label": s.label, "first": word(s.start) - 1, "last": word(s.end) - 1, "edits": s.edits, "matched": body[s.start : s.end].decode("utf-8", "replace").strip()}
                for s in spans
            ],
        }


SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64()), ("matched", pa.string())])
_TYPES = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(SPAN),
}


def scan_licenses(docs: DataFrame, notices: Sequence[tuple[str, str, str]] = NOTICES) -> DataFrame:
    """For each row its base places, labels, score and spans.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 for a
    base phrase, else 1 less the best span's edits per character, else 0), spans (label, first and
    last word from 0, edits, matched text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(notices)
        for b in batches:
            rows = [search.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([r[c] for r in rows], k) for c, k in _TYPES.items())], ["doc_id", *_TYPES])

    return pick(docs, "doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first: bigint, last: bigint, edits: bigint, matched: string>>",
    )
