"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Every word generates its edits as 64-bit hashes and asks a blocked Bloom filter of the words of the edit's length. Only hits are
shuffled: they meet the vocabulary by equality of the hash, and the two words themselves are compared, so false hits vanish.
Being near is symmetric, so a word generates its deletions and the replacements by a greater code point; the other half
of each pair is the other word's.

The hash of a text is a polynomial in an odd base modulo 2**64, so the hash of each edit comes from that of its word in
constant time, whatever the length. Filters are built in Spark and broadcast in turns of at most ``TURN_BLOCKS`` blocks:
a vocabulary beyond that is searched turn by turn, by target length and, within one, by slices of the hash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.llm.frames import by_batch, by_whole_batch, narrow, stored, texts
from pressline.session import cut_lineage

# Code points a word can consist of once A-Z are lower-cased; edits insert and replace these.
ALPHABET = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
MIN_LENGTH = 7
MIN_COUNT = 2
# A form is this many times as frequent as its variant.
RATIO = 10
# One of so many (document, run) pairs loses a code point.
DROP_EVERY = 31
# Words of this length and more share one filter, so the number of filters is bounded.
LAST_SHARD = 64
# A block has eight lanes of 32 bits and takes about 16 words. A turn broadcasts at most this many blocks, 32 MB.
WORDS_A_BLOCK = 16
TURN_BLOCKS = 1 << 20
# Edits hashed at a time in a task.
STEP = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)

Filters = dict[int, tuple[int, int, np.ndarray]]


def words_of(doc_id: object, text: str | None, min_length: int = MIN_LENGTH) -> Counter[str]:
    """The words of one text with their number: its runs of letters, some of which lose a code point by their hash."""
    lowered = (text or "").encode().lower().decode()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter[str] = Counter()
    for run, n in Counter(re.findall(rf"[a-zÀ-ÿ]{{{min_length},}}", lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_length:
                continue
        found[run] += n
    return found


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: the words of all texts of ``docs(doc_id, text)`` with at least ``min_count`` occurrences."""

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter[str] = Counter()
        for doc_id, text in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
            total.update(words_of(doc_id, text, min_length))
        return pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    counted = narrow(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _same_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length: their places in the column and their code points as a matrix."""
    groups: dict[int, list[int]] = {}
    words = column.to_pylist()
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    for length, places in groups.items():
        if length:
            joined = "".join(words[i] for i in places).encode("utf-32-le", "surrogatepass")
            yield np.array(places), np.frombuffer(joined, np.uint32).reshape(-1, length).astype(np.uint64)


def _terms(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base by position, and the running sums of the terms of the hash."""
    powers = np.cumprod(np.full(points.shape[1], BASE))[::-1] * INVERSE
    return powers, np.cumsum(points * powers, axis=1)


def hashed(vocab: DataFrame) -> DataFrame:
    """Adds ``h``, the 64-bit hash of each word."""

    @by_whole_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.zeros(batch.num_rows, np.uint64)
        for places, points in _same_length(batch.column(0)):
            found[places] = _mixed(_terms(points)[1][:, -1])
        return batch.append_column("h", pa.array(found.view(np.int64)))

    return vocab.select("word", "n").mapInArrow(run, "word string, n long, h long")


def _edits(points: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """The edits of words of one length, as ``(shorter, row of the word, hash)``; a bounded number at a time."""
    rows, length = points.shape
    powers, sums = _terms(points)
    whole = sums[:, -1:]
    wide = max(1, STEP // (rows * len(alphabet)))
    for start in range(0, length, wide):
        here = slice(start, min(start + wide, length))
        before = sums[:, here] - points[:, here] * powers[here]
        shorter = before * INVERSE + (whole - sums[:, here])
        # Within a run of equal code points each deletion gives the same text.
        fresh = np.ones(shorter.shape, bool)
        fresh[:, 1:] = points[:, here][:, 1:] != points[:, here][:, :-1]
        if start:
            fresh[:, 0] = points[:, start] != points[:, start - 1]
        row, _ = np.nonzero(fresh)
        yield True, row, _mixed(shorter[fresh])
        change = alphabet[None, None, :] - points[:, here, None]
        greater = alphabet[None, None, :] > points[:, here, None]
        row, _, _ = np.nonzero(greater)
        yield False, row, _mixed((whole[:, :, None] + change * powers[here][None, :, None])[greater])


def _shard(length: int) -> int:
    return min(length, LAST_SHARD)


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(slices)


def _blocks(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _bits(h: np.ndarray, lane: int) -> np.ndarray:
    """The bit a hash sets in one lane."""
    return np.uint32(1) << ((h.astype(np.uint32) * LANES[lane]) >> np.uint32(27))


def _contains(blocks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the filter; each lane is asked for what the ones before let through."""
    left = np.arange(len(h))
    at = _blocks(h, len(blocks))
    for lane in range(len(LANES)):
        left = left[blocks[at[left], lane] & _bits(h[left], lane) != 0]
    return left


def turns(counts: dict[int, int], turn_blocks: int = TURN_BLOCKS) -> list[dict[int, tuple[int, int, int]]]:
    """Filters to broadcast together, as ``{shard: (slice, slices, blocks)}``, from the number of words of each shard."""
    found: list[dict[int, tuple[int, int, int]]] = []
    left = 0
    for shard, n in sorted(counts.items()):
        need = -(-n // WORDS_A_BLOCK)
        slices = -(-need // turn_blocks)
        size = -(-need // slices)
        for part in range(slices):
            if size > left or shard in found[-1]:
                found.append({})
                left = turn_blocks
            found[-1][shard] = (part, slices, size)
            left -= size
    return found


def filters(vocab: DataFrame, turn: dict[int, tuple[int, int, int]]) -> Filters:
    """The filters of one turn: blocks are filled in Spark, at most ``TURN_BLOCKS`` of them reach the driver."""
    starts = dict(zip(turn, np.cumsum([0, *(size for _, _, size in turn.values())]).tolist(), strict=False))

    @by_whole_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        shards = np.minimum(batch.column(0).to_numpy(zero_copy_only=False), LAST_SHARD)
        block, lanes = [np.zeros(0, np.int64)], [np.zeros((0, len(LANES)), np.uint32)]
        for shard, (part, slices, size) in turn.items():
            some = h[shards == shard]
            some = some[_slice(some, slices) == part]
            block.append(starts[shard] + _blocks(some, size))
            lanes.append(np.stack([_bits(some, lane) for lane in range(len(LANES))], axis=1))
        quads = np.ascontiguousarray(np.concatenate(lanes)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(block)), *(pa.array(q) for q in quads.T)], ["block", "q0", "q1", "q2", "q3"]
        )

    filled = vocab.select(F.length("word").alias("length"), "h").mapInArrow(run, "block long, q0 long, q1 long, q2 long, q3 long")
    merged = filled.groupBy("block").agg(*[F.bit_or(f"q{i}").alias(f"q{i}") for i in range(4)]).toArrow()
    lanes = np.zeros((sum(size for _, _, size in turn.values()), 4), np.int64)
    if merged.num_rows:
        lanes[merged["block"].to_numpy()] = np.stack([merged[f"q{i}"].to_numpy() for i in range(4)], axis=1)
    lanes = lanes.view(np.uint32)
    return {
        shard: (part, slices, lanes[starts[shard] : starts[shard] + size]) for shard, (part, slices, size) in turn.items()
    }


def hits(vocab: DataFrame, found: Filters, alphabet: str = ALPHABET) -> DataFrame:
    """``(word_h, near_h)``: edits of the words that the filters may hold."""
    sent = vocab.sparkSession.sparkContext.broadcast(found)
    letters = np.array(sorted(map(ord, set(alphabet))), np.uint64)

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(1).to_numpy(zero_copy_only=False)
        words, nears = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for places, points in _same_length(batch.column(0)):
            length = points.shape[1]
            if sent.value.keys().isdisjoint({_shard(length), _shard(length - 1)}):
                continue
            for shorter, row, h in _edits(points, letters):
                part, slices, blocks = sent.value.get(_shard(length - shorter), (0, 0, None))
                if blocks is None:
                    continue
                if slices > 1:
                    mine = _slice(h, slices) == part
                    row, h = row[mine], h[mine]
                kept = _contains(blocks, h)
                words.append(own[places[row[kept]]])
                nears.append(h[kept])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(words)), pa.array(np.concatenate(nears).view(np.int64))], ["word_h", "near_h"]
        )

    # Edits are hundreds of rows a word: the words are dealt out evenly before.
    spread = vocab.select("word", "h").repartition(_tasks(vocab))
    return spread.mapInArrow(run, "word_h long, near_h long").distinct()


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def near_words(vocab: DataFrame, alphabet: str = ALPHABET, turn_blocks: int = TURN_BLOCKS) -> DataFrame:
    """``(word, near, near_n)``, both ways: the words of ``vocab(word, n, h)`` that differ by exactly one code point inserted,
    deleted or replaced. Words consist of code points of ``alphabet``."""
    counts = vocab.groupBy(F.least(F.length("word"), F.lit(LAST_SHARD)).alias("shard")).count().collect()
    one = vocab.select(F.col("h").alias("word_h"), F.col("word"), F.col("n"))
    other = vocab.select(F.col("h").alias("near_h"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = None
    for turn in turns({row["shard"]: row["count"] for row in counts}, turn_blocks):
        found = hits(vocab, filters(vocab, turn), alphabet)
        pairs = found if pairs is None else cut_lineage(pairs.unionByName(found))
    if pairs is None:
        return one.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    exact = cut_lineage(
        pairs.join(other, "near_h").join(one, "word_h")
        .where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
    )
    back = exact.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return exact.select("word", "near", "near_n").unionByName(back)


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the end of each chain of forms. Each round doubles the steps taken; a form is
    more frequent than its variant, so chains end."""
    reached = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = cut_lineage(reached.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        ))
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def variants(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, turn_blocks: int = TURN_BLOCKS
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of ``docs(doc_id, text, ...)``.

    ``form`` is the near word with the most occurrences, the smaller one by code points among equals, if it has at least
    ``ratio`` (2 or more) times those of the word, else null with ``form_n`` null; ``root`` is where following forms ends, the word itself
    without a form; ``n_near`` counts the near words. Null and empty texts have no words. Each row counts, so repeated rows and
    ids count again; a null ``doc_id`` is hashed as an empty one. Other columns are not read. An empty table gives an empty table.
    """
    vocab = stored(hashed(vocabulary(docs, min_length, min_count)), "spelling-words")
    best = near_words(vocab, ALPHABET, turn_blocks).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    )
    taken = -F.col("best.m") >= ratio * F.col("n")
    judged = cut_lineage(vocab.select("word", "n").join(best, "word", "left").select(
        "word", F.when(taken, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.m")).alias("form_n"),
    ))
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
