"""Benchmark decontamination: the phrases of a benchmark searched in an FM-index of each shard of the documents.

Shards are runs of documents within a task; texts are never shuffled. Words outside the benchmark's vocabulary cannot be
part of a phrase, so a run of them is one separator symbol in the index. Phrases are found by backward search on wavelet
ranks, located by sampled suffix positions and merged to removal spans.

The benchmark is taken in blocks of about ``BLOCK_BYTES`` of text, longer items in pieces. One block at a time passes the
driver and is broadcast; with more than one, what each block finds is written below the shared folder and merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pressline.llm.fm_index import FmIndex
from pressline.llm.frames import by_whole_batch, free_name, narrow, stored, texts
from pressline.session import work_folder

WINDOW = 13
BLOCK_BYTES = 4 << 20
# Symbols of a shard; a longer text is indexed in pieces that overlap by a window less one word.
SHARD = 1 << 20

SEPARATOR = 1
FIRST_WORD = 2
_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Phrases:
    """The windows of some items: ``length`` symbols of ``sequence`` from ``start`` on belong to item number ``item``."""

    vocabulary: dict[bytes, int]
    sequence: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray

    @staticmethod
    def of(items: list[str | None]) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        sequence, start, length, item = [], [], [], []
        for number, text in enumerate(items):
            own = words(text)
            first = len(sequence)
            sequence += [vocabulary.setdefault(w, len(vocabulary) + FIRST_WORD) for w in own]
            size = min(len(own), WINDOW)
            for k in range(len(own) - size + 1 if own else 0):
                start.append(first + k)
                length.append(size)
                item.append(number)
        return Phrases(vocabulary, *[np.array(x, np.int64) for x in (sequence, start, length, item)])

    def last_symbols(self, phrases: np.ndarray, j: int) -> np.ndarray:
        return self.sequence[self.start[phrases] + self.length[phrases] - 1 - j]


class Shard:
    """Pieces of texts of some rows, searched together."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.parts: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.size = 0
        self.hits: list[np.ndarray] = []
        self.items: list[np.ndarray] = []

    def add(self, row: int, symbols: np.ndarray) -> None:
        """Adds the symbols of a whole text."""
        step = SHARD - WINDOW + 1
        for first in range(0, max(len(symbols) - WINDOW + 1, 1), step):
            part = symbols[first : first + SHARD]
            known = part != SEPARATOR
            if not known.any():
                continue
            # One separator stands before each run of known words; the words keep their places in ``at``.
            begins = known & ~np.append(False, known[:-1])
            place = np.flatnonzero(known)
            slot = np.arange(len(place)) + np.cumsum(begins)[place]
            packed = np.full(slot[-1] + 1, SEPARATOR, np.int32)
            packed[slot] = part[place]
            at = np.full(len(packed), -1, np.int64)
            at[slot] = place + first
            if self.size and self.size + len(packed) > SHARD:
                self.search()
            self.parts.append((packed, at, row))
            self.size += len(packed)

    def search(self) -> None:
        """Indexes and searches what was added; keeps (row, word) of hit words and (row, item) of found items."""
        if not self.parts:
            return
        symbols = np.concatenate([p[0] for p in self.parts])
        at = np.concatenate([p[1] for p in self.parts])
        row = np.repeat([p[2] for p in self.parts], [len(p[0]) for p in self.parts])
        self.parts, self.size = [], 0
        phrases = self.phrases
        index = FmIndex(symbols, len(phrases.vocabulary) + FIRST_WORD)
        low, high = index.search(phrases.last_symbols, len(phrases.start), phrases.length)
        edges = np.zeros(len(symbols) + 1, np.int64)
        for phrase, place in index.occurrences(low, high):
            np.add.at(edges, place, 1)
            np.add.at(edges, place + phrases.length[phrase], -1)
            self.items.append(np.unique(np.stack([row[place], phrases.item[phrase]], 1), axis=0))
        hit = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        self.hits.append(np.stack([row[hit], at[hit]], 1))


def _unique(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *parts]), axis=0)


def _lists(row: np.ndarray, n_rows: int, values: pa.Array) -> pa.ListArray:
    """One list per row of values that are ordered by row."""
    offsets = np.searchsorted(row, np.arange(n_rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _spans(hits: np.ndarray, n_rows: int) -> pa.ListArray:
    """Runs of neighbouring hit words, as word numbers from (inclusive) and to (exclusive)."""
    row, at = hits[:, 0], hits[:, 1]
    begins = np.ones(len(hits), bool)
    begins[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    ends = np.append(begins[1:], True) if len(hits) else begins
    made = pa.StructArray.from_arrays([pa.array(at[begins]), pa.array(at[ends] + 1)], ["start", "end"])
    return _lists(row[begins], n_rows, made)


def _earlier(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[list]]:
    """Hit words and items that blocks left in the last two columns of a batch."""
    spans, items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
    hits = []
    for row, own in enumerate(spans):
        for span in own:
            at = np.arange(span["start"], span["end"])
            hits.append(np.stack([np.full(len(at), row), at], 1))
    return hits, items


@dataclass
class Found:
    """What is known of the rows of a batch: word counts, unique (row, hit word), sorted item ids."""

    n_words: np.ndarray
    hits: np.ndarray
    items: list[list[str]]

    def n_hit(self) -> np.ndarray:
        return np.bincount(self.hits[:, 0], minlength=len(self.n_words))

    def spans(self) -> pa.ListArray:
        return _spans(self.hits, len(self.n_words))

    def item_lists(self) -> pa.Array:
        return pa.array(self.items, pa.list_(pa.string()))


def _find(texts_: Iterator[str | None], ids: list, phrases: Phrases, hits: list[np.ndarray], items: list[list]) -> Found:
    shard, n_words = Shard(phrases), []
    known = phrases.vocabulary.get
    for row, text in enumerate(texts_):
        own = words(text)
        n_words.append(len(own))
        shard.add(row, np.fromiter((known(w, SEPARATOR) for w in own), np.int64, len(own)))
    shard.search()
    named: dict[int, set] = {}
    for row, item in _unique(shard.items).tolist():
        if ids[item] is not None:
            named.setdefault(row, set()).add(ids[item])
    lists = [sorted(named.get(row, set()).union(items[row] if items else ())) for row in range(len(n_words))]
    return Found(np.array(n_words, np.int64), _unique(shard.hits + hits), lists)


def _one_pass(docs: DataFrame, block: tuple[list, list], finish, schema: StructType) -> tuple[DataFrame, Broadcast]:
    """``docs`` searched for one block; ``finish(batch, found)`` makes the rows. The broadcast must live as long as they are read."""
    ids, items = block
    shared, place = docs.sparkSession.sparkContext.broadcast((ids, Phrases.of(items))), docs.columns.index("text")

    @by_whole_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, phrases = shared.value
        return finish(batch, _find(texts(batch.column(place)), ids, phrases, [], []))

    return docs.mapInArrow(run, schema), shared


def _pieces(benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """``(id, text)`` of the items that have a text; one of more than a block in pieces that overlap by a window less one word."""
    items = narrow(benchmark, "item_id", "text").where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = pa.array(pieces(batch.column(1)[i].as_py(), block_bytes), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(parts), pa.string()), parts], ["id", "text"])

    return items.mapInArrow(run, "id string, text string")


def pieces(text: str, most_bytes: int) -> list[str]:
    """A text in pieces of about ``most_bytes``, so that each window of words is in one of them."""
    own = words(text) if len(text.encode("utf-8", "surrogatepass")) > most_bytes else []
    if len(own) <= WINDOW:
        return [text]
    found, first, size = [], 0, 0
    for k, word in enumerate(own):
        if size + len(word) + 1 > most_bytes and k - first >= WINDOW:
            found.append(own[first:k])
            first = k - WINDOW + 1
            size = sum(len(w) + 1 for w in own[first:k])
        size += len(word) + 1
    return [b" ".join(part).decode("utf-8", "surrogatepass") for part in [*found, own[first:]]]


def dealt(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``(id, text, b)`` and the number of blocks ``b``; pieces are dealt by a hash, a block is about ``block_bytes`` of text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:
        return _pieces(benchmark, block_bytes).withColumn("b", F.lit(0)), 1
    parts = stored(_pieces(benchmark, block_bytes), "benchmark-pieces")
    n = -(-(parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    return parts.withColumn("b", F.expr(f"pmod(xxhash64(id, text), {n})")), n


def _block(parts: DataFrame, b: int) -> tuple[list, list]:
    rows = parts.where(F.col("b") == b).select("id", "text").collect()
    return [r["id"] for r in rows], [r["text"] for r in rows]


def _by_block(numbered: DataFrame, row: str, parts: DataFrame, n: int, finish, schema: StructType) -> DataFrame:
    """The rows ``finish(batch, found)`` makes of ``(row, spans, items)`` for what any block finds; a text without hits has no row."""
    read = numbered.select(F.col(f"`{row}`").alias("row"), "text")
    folder = work_folder(read.sparkSession, "benchmark-hits")
    hit = StructType([StructField("row", LongType()), StructField("n", LongType()), StructField("spans", SPANS),
                      StructField("items", ArrayType(StringType()))])

    def keep(batch: pa.RecordBatch, found: Found) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found.n_words), found.spans(), found.item_lists()], ["row", "n", "spans", "items"])
        return made.filter(pa.array(found.n_hit() > 0))

    for b in range(n):
        made, shared = _one_pass(read, _block(parts, b), keep, hit)
        made.write.parquet(f"{folder}/b={b}")
        shared.destroy()
    hits = read.sparkSession.read.schema(hit).parquet(*[f"{folder}/b={b}" for b in range(n)])
    whole = hits.groupBy("row").agg(
        F.max("n").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    @by_whole_batch
    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, items = _earlier(batch)
        return finish(batch, Found(batch.column(1).to_numpy(), _unique(places), items))

    return whole.mapInArrow(merge, schema)


def removal_spans(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, spans, items)`` for every row of ``docs(doc_id, text, ...)``.

    ``spans``: the words of the text inside any occurrence of a window of ``WINDOW`` consecutive words of an item (of all
    its words, if it has fewer), merged, from 0 and without the end. ``items``: ids of those items as text, each once, sorted.
    A null, empty or wordless text or item has no words and no hits. An item without id marks words but is not named;
    repeated items count once. Repeated documents keep one row each; empty tables give no rows, or no hits.
    """
    docs = narrow(docs, "doc_id", "text")

    def finish(batch: pa.RecordBatch, found: Found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found.n_words), found.spans(), found.item_lists()], ["doc_id", "n_words", "spans", "items"]
        )

    found = [StructField("n_words", LongType()), StructField("spans", SPANS), StructField("items", ArrayType(StringType()))]
    schema = StructType([docs.schema["doc_id"], *found])
    parts, n = dealt(benchmark, block_bytes)
    if n == 1:
        return _one_pass(docs, _block(parts, 0), finish, schema)[0]
    numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate-docs")
    hits = _by_block(numbered, "row", parts, n, finish, StructType([StructField("doc_id", LongType()), *found]))
    hits = hits.select(F.col("doc_id").alias("row"), "spans", "items")

    @by_whole_batch
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([len(words(t)) for t in texts(batch.column(1))], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), made, batch.column(2)], ["doc_id", "n_words", "row"])

    counted = numbered.mapInArrow(count, StructType([docs.schema["doc_id"], found[0], StructField("row", LongType())]))
    none = [F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) for f in found[1:]]
    return counted.join(hits, "row", "left").select("doc_id", "n_words", *none)


def n_hit(spans: str = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def is_contaminated(hit: F.Column, n_words: F.Column, least_percent: int = 5) -> F.Column:
    """Some word is hit, and at least that share of all words."""
    return (hit > 0) & (100 * hit >= least_percent * n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, least_percent: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; see ``removal_spans``."""
    def finish(batch: pa.RecordBatch, found: Found) -> pa.RecordBatch:
        hit = found.n_hit()
        return batch.filter(pa.array((hit == 0) | (100 * hit < least_percent * found.n_words)))

    def refuse(batch: pa.RecordBatch, found: Found) -> pa.RecordBatch:
        return batch.select([0]).filter(pa.array(100 * found.n_hit() >= least_percent * found.n_words))

    parts, n = dealt(benchmark, block_bytes)
    if n == 1:
        return _one_pass(docs, _block(parts, 0), finish, docs.schema)[0]
    row = free_name(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-docs")
    refused = _by_block(numbered, row, parts, n, refuse, StructType([StructField("row", LongType())]))
    return numbered.join(refused, numbered[row] == refused["row"], "left_anti").drop(row)
