"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is a Spark aggregation over all labelled rows; only the log-probability matrix (buckets x languages, at most
``MATRIX_BYTES``) reaches the driver and is broadcast. Scoring gathers matrix rows for the n-grams of a text in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from pressline.llm.frames import Batches, by_batch, narrow, plus, texts

UNKNOWN = "und"
SIZES = (2, 3)
BUCKETS = 1 << 15
# The matrix never grows beyond this; with very many languages it has fewer buckets.
MATRIX_BYTES = 32 << 20
LEAST_BUCKETS = 1 << 10
# N-grams whose evidence a score counts at most: longer texts do not push it closer to 1.
EVIDENCE = 64
# Characters hashed at a time; bounds the memory a long text takes.
STEP = 1 << 18

_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """``weights[bucket, language]``: log-probabilities; ``prior[language]``: log share of the training rows."""

    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray


def buckets(text: str, n_buckets: int):
    """Yields arrays of n-gram buckets of the lower-cased text with a space at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - (n_buckets.bit_length() - 1))
    for start in range(0, len(codes), STEP):
        part = codes[start : start + STEP + max(SIZES) - 1]
        for n in SIZES:
            many = min(len(part) - n + 1, STEP)
            if many <= 0:
                continue
            mixed = np.full(many, n, np.uint32)
            for j in range(n):
                mixed = (mixed ^ part[j : j + many]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
            yield (mixed * np.uint32(0x85EBCA6B)) >> shift


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def train(labelled: DataFrame) -> Model:
    """Counts over all rows of ``labelled(text, lang)`` with both set.

    A table without such rows gives a model without languages, which answers ``und``.
    """
    labelled = narrow(labelled, "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(rows))
    if not languages:
        return Model((), np.zeros(0), np.zeros((0, 0), np.float32))
    n_buckets = BUCKETS
    while n_buckets * len(languages) * 4 > MATRIX_BYTES:
        n_buckets //= 2
    if n_buckets < LEAST_BUCKETS:
        raise ValueError(f"{len(languages)} languages need a matrix over {MATRIX_BYTES} bytes")

    def count(batches: Batches) -> Batches:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(n_buckets, np.int64)
                for found in buckets(text, n_buckets):
                    sums[lang] += np.bincount(found, minlength=n_buckets)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])],
                ["lang", "bucket", "n"],
            )

    counted = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    counts = np.zeros((n_buckets, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[found["bucket"].to_numpy(np.int64), found["lang"].map(place).to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    weights = np.log((counts + 0.5) / (counts + 0.5).sum(0)).astype(np.float32)
    shares = np.array([rows[x] for x in languages], float)
    return Model(languages, np.log(shares / shares.sum()), weights)


def judge(text: str | None, model: Model) -> tuple[str, float]:
    """Language and score of one text. The first language in name order wins a tie."""
    if not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    total, n = np.zeros(len(model.languages)), 0
    for found in buckets(text, len(model.weights)):
        total += model.weights[found].sum(0, dtype=np.float64)
        n += len(found)
    best = int(np.argmax(total + model.prior))
    tempered = total * min(1.0, EVIDENCE / n) + model.prior
    chances = np.exp(tempered - tempered.max())
    return model.languages[best], float(chances[best] / chances.sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) instead of its text; the prediction reads the text only.

    A null text, or one without a letter, gives ``und`` with score 0. Every row gets one row; repeated rows too. Columns of
    these two names are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [judge(t, shared.value) for t in texts(batch.column(place))]
        rest = [i for i in range(batch.num_columns) if i != place]
        return pa.RecordBatch.from_arrays(
            [batch.column(i) for i in rest] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            [batch.schema.names[i] for i in rest] + ["lang_pred", "score"],
        )

    return docs.mapInArrow(run, plus(docs.drop("text"), ("lang_pred", StringType()), ("score", DoubleType())))


def in_a_language(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least that score. Nulls in other columns do not matter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def clear(text: str | None) -> bool:
        lang, score = judge(text, shared.value)
        return lang != UNKNOWN and score >= least_score

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([clear(t) for t in texts(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for rows whose id's CRC-32 leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train_without_held_out(docs: DataFrame, folds: int = 4, fold: int = 2) -> Model:
    """A model of the rows that are surely not held out: those without an id are not learned from either."""
    return train(docs.where(~held_out(F.col("doc_id"), folds, fold)).where("doc_id IS NOT NULL"))


def predictions(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang, ...)``; see ``identify``."""
    found = identify(narrow(docs, "doc_id", "text"), train_without_held_out(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
