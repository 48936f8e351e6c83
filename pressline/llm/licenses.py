"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are overlapping runs of words, so a passage of up to ``STRIDE`` words is whole in one of them. A template is found in
a block if the block holds at least the template's threshold share of its distinct words. Words are ordered by how often they
stand in all documents, rarest first. Then a block can only reach a threshold if it has one of the template's few first words
(prefix filter), enough words at all (length filter), and enough words left behind the first common one (positional
filter); what passes is verified. No block that meets the threshold is missed.

Templates are a parameter and broadcast; they are bounded by ``MOST_TEMPLATES``. Texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pressline.llm.frames import Batches, by_batch, narrow, texts

BLOCK = 48
STRIDE = 24
MOST_TEMPLATES = 10_000

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    """``exact``: the words must also stand consecutively, and each such place is counted."""

    label: str
    text: str
    threshold: float = 0.8
    exact: bool = False


# Phrases and sentences of public licenses.
TEMPLATES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache", "you may not use this file except in compliance with the license"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc", "licensed under cc by nc 4 0"),
    Template("cc", "licensed under a creative commons attribution license"),
    Template("proprietary", "all rights reserved unauthorized copying of this file is strictly prohibited"),
)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Index:
    """Templates as sets of word ranks, rarest word first; 0 is any word no template has."""

    templates: tuple[Template, ...]
    rank: dict[bytes, int]
    sets: list[list[int]]
    need: list[int]
    sequences: list[list[int]]
    prefix: dict[int, list[tuple[int, int]]]
    rare: np.ndarray

    @staticmethod
    def of(templates: tuple[Template, ...], counts: dict[bytes, int]) -> Index:
        split = [words(t.text) for t in templates]
        for template, own in zip(templates, split, strict=True):
            if not own or len(own) > STRIDE:
                raise ValueError(f"a template has 1 to {STRIDE} words: {template.text!r}")
        ordered = sorted({w for own in split for w in own}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i + 1 for i, w in enumerate(ordered)}
        sequences = [[rank[w] for w in own] for own in split]
        sets = [sorted(set(own)) for own in sequences]
        need = [max(1, ceil(t.threshold * len(own) - 1e-9)) for t, own in zip(templates, sets, strict=True)]
        prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (own, n) in enumerate(zip(sets, need, strict=True)):
            for i, r in enumerate(own[: len(own) - n + 1]):
                prefix.setdefault(r, []).append((t, i))
        rare = np.zeros(len(rank) + 1, bool)
        rare[list(prefix)] = True
        return Index(templates, rank, sets, need, sequences, prefix, rare)

    def ranks(self, own: list[bytes]) -> np.ndarray:
        known = self.rank.get
        return np.fromiter((known(w, 0) for w in own), np.int32, len(own))

    def in_block(self, block: list[int]) -> list[tuple[int, float]]:
        """(template, containment) for a block given as its distinct ranks in order."""
        candidates = set()
        for j, r in enumerate(block):
            for t, i in self.prefix.get(r, ()):
                left = 1 + min(len(self.sets[t]) - i - 1, len(block) - j - 1)
                if len(block) >= self.need[t] and left >= self.need[t]:
                    candidates.add(t)
        found, members = [], set(block)
        for t in sorted(candidates):
            common = sum(r in members for r in self.sets[t])
            if common >= self.need[t]:
                found.append((t, common / len(self.sets[t])))
        return found

    def scan(self, text: str | None) -> tuple:
        """``(n_words, n_places, first, last, exact labels, labels, score)`` of a whole text."""
        own = words(text)
        ranks = self.ranks(own)
        at = np.flatnonzero(self.rare[ranks]) // STRIDE
        places, labels, exact, score = set(), set(), set(), 0.0
        for b in np.union1d(at, at[at > 0] - 1).tolist():
            block = ranks[b * STRIDE : b * STRIDE + BLOCK]
            distinct = np.unique(block)
            for t, share in self.in_block(distinct[distinct > 0].tolist()):
                template = self.templates[t]
                if template.exact:
                    starts = _starts(block, self.sequences[t])
                    if not len(starts):
                        continue
                    places.update((t, b * STRIDE + s) for s in starts.tolist())
                    exact.add(template.label)
                labels.add(template.label)
                score = max(score, share)
        starts = [p for _, p in places]
        return (
            len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(exact)),
            ",".join(sorted(labels)), score,
        )


def _starts(block: np.ndarray, sequence: list[int]) -> np.ndarray:
    """Where the words of a phrase stand consecutively in a block."""
    fits = np.ones(max(len(block) - len(sequence) + 1, 0), bool)
    for k, r in enumerate(sequence):
        fits &= block[k : k + len(fits)] == r
    return np.flatnonzero(fits)


def word_counts(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How often each of the templates' words stands in all texts; as many rows as there are such words reach the driver."""
    def count(batches: Batches) -> Batches:
        sums = dict.fromkeys(wanted, 0)
        for batch in batches:
            for text in texts(batch.column(0)):
                for w in words(text):
                    if w in sums:
                        sums[w] += 1
        found = [(w, n) for w, n in sums.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64())], ["w", "n"])

    counted = narrow(docs, "text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in counted.collect()}


FIELDS = (
    ("n_words", LongType()), ("n_base", LongType()), ("first_word", LongType()), ("last_word", LongType()),
    ("base_labels", StringType()), ("labels", StringType()), ("score", DoubleType()),
)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row of ``docs(doc_id, text, ...)``.

    ``n_base``: places at which the words of an exact template stand consecutively, of all exact templates; ``first_word`` and
    ``last_word`` are their smallest and largest start (words from 0), null without a place. ``labels``: those of all templates
    found; ``score``: the largest containment among them, 0 without one. Labels are distinct, sorted, comma-joined.

    A null, empty or wordless text has no words and finds nothing. Repeated rows keep one row each; an empty table gives an
    empty table.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} are broadcast")
    docs = narrow(docs, "doc_id", "text")
    counts = word_counts(docs, {w for t in templates for w in words(t.text)})
    shared = docs.sparkSession.sparkContext.broadcast(Index.of(tuple(templates), counts))

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        rows = [index.scan(t) for t in texts(batch.column(1))]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *[name for name, _ in FIELDS]])

    return docs.mapInArrow(run, StructType([docs.schema["doc_id"], *[StructField(*f) for f in FIELDS]]))
