"""Quality rules per document, and a verdict per host from the failures of all its documents.

A host's failure rate is shrunk towards the rate of all hosts with a beta prior whose strength is estimated from the
spread between hosts, so that a host with few documents is not judged by them alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pressline.llm.frames import by_batch, free_name, narrow, plus, stored, texts

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Limits:
    """Rules of a document and the rate from which a host is refused."""

    least_words: int = 20
    most_repeat_percent: int = 30
    most_symbols_percent: int = 10
    most_dup_lines_percent: int = 30
    host_rate: float = 0.8


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that stand at two places or more; exact.

    Ranks of 1, 2, 4 and 8 words are built by doubling; the exact ranks are only built for texts whose window hashes repeat.
    """
    if len(words) <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    mixed = ranks.astype(np.uint64)
    for step in (1, 2, 4):
        mixed = mixed[:-step] * np.uint64(0x9E3779B97F4A7C15) + (mixed[step:] ^ (mixed[step:] >> np.uint64(29)))
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    for step in (1, 2, 4):
        _, ranks = np.unique(ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:], return_inverse=True)
    twice = (np.bincount(ranks)[ranks] > 1).astype(np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(twice)] += twice
    edges[WINDOW : WINDOW + len(twice)] -= twice
    return int((np.cumsum(edges) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``; all 0 for null."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeat_words(words), len(lines),
    )


def with_counts(docs: DataFrame, into: str, *kept: str) -> DataFrame:
    """The columns ``kept`` of ``docs`` and a struct column ``into`` with the counts of ``text``."""
    docs = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(into))
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        last = batch.num_columns - 1
        found = np.array([counts(t) for t in texts(batch.column(last))], np.int64).reshape(-1, len(COUNTS))
        made = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(COUNTS))], fields=list(kind))
        return pa.RecordBatch.from_arrays([*batch.columns[:last], made], batch.schema.names)

    made = StructType([StructField(c, LongType()) for c in COUNTS])
    return docs.mapInArrow(run, plus(docs.drop(into), (into, made)))


def rules(c: str, limits: Limits) -> dict[str, F.Column]:
    """Name to failure of each document rule over the counts in struct column ``c``; never null."""
    at = {n: F.col(f"{c}.{n}") for n in COUNTS}
    return {
        "few_words": at["n_words"] < limits.least_words,
        "repeated_passages": 100 * at["n_repeat_words"] > limits.most_repeat_percent * at["n_words"],
        "symbols": 100 * at["n_symbols"] > limits.most_symbols_percent * at["word_chars"],
        "repeated_lines": 100 * at["n_dup_lines"] > limits.most_dup_lines_percent * at["n_lines"],
    }


def beta_prior(hosts: DataFrame, failed: str) -> tuple[float, float]:
    """``(a, b)`` of the beta prior by moments over ``hosts(n_docs, <failed>)``; one row of sums reaches the driver.

    The spread between hosts beyond what chance explains sets its strength. Without such spread, or with one host, the
    prior weighs as much as ten thousand documents: then all hosts count as alike. Without rows it is flat.
    """
    rate = F.col(failed) / F.col("n_docs")
    sums: Row = hosts.agg(
        F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum(failed).alias("f"), F.sum(1 / F.col("n_docs")).alias("inverse"),
        F.sum(rate).alias("r"), F.sum(rate * rate).alias("rr"),
    ).first()
    if not sums["n"]:
        return 1.0, 1.0
    mean = (sums["f"] + 0.5) / (sums["n"] + 1)
    chance = mean * (1 - mean)
    k = sums["k"]
    spread = (sums["rr"] - sums["r"] ** 2 / k) / (k - 1) if k > 1 else 0.0
    between = spread - chance * sums["inverse"] / k
    strength = min(1e4, max(2.0, chance / between - 1)) if between > 0 else 1e4
    return mean * strength, (1 - mean) * strength


def host_verdicts(judged: DataFrame, host: str, counted: str, limits: Limits) -> DataFrame:
    """``(host, n_docs, <rule>_rate..., any_rule_rate, host_kept)`` from one row per document; null hosts are one host of their own.

    ``any_rule`` counts the documents that fail one rule or more, so junk of several kinds adds up.

    Sums are partial before the shuffle, so a host with a third of all rows is a few rows in it.
    """
    checks = rules(counted, limits)
    checks["any_rule"] = reduce(or_, checks.values())
    sums = stored(
        judged.groupBy(F.col(f"`{host}`").alias("host")).agg(
            F.count("*").alias("n_docs"), *[F.sum(c.cast("long")).alias(name) for name, c in checks.items()]
        ),
        "quality-hosts",
    )
    rates = []
    for name in checks:
        a, b = beta_prior(sums, name)
        rates.append(((F.col(name) + a) / (F.col("n_docs") + a + b)).alias(f"{name}_rate"))
    shrunk = sums.select("host", "n_docs", *rates)
    worst = F.greatest(*[F.col(f"{name}_rate") for name in checks])
    return shrunk.withColumn("host_kept", worst < limits.host_rate)


def judge(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """``(doc_id, <counts>, base_failed, kept)`` for every row of ``docs(doc_id, text, <host>, ...)``.

    A null or empty text counts 0 words and so fails. A document stays if it passes the base rules and its host is kept; a
    host is refused if the shrunk rate of a rule, or of documents that fail any rule, reaches ``host_rate``. Repeated rows keep one row each; an empty table
    gives an empty table.
    """
    counted = stored(with_counts(narrow(docs, "doc_id", host, "text").withColumnRenamed(host, "host"), "c", "doc_id", "host"),
                     "quality-counts")
    return _verdicts(counted, limits).select("doc_id", *[F.col(f"c.{n}").alias(n) for n in COUNTS], "base_failed", "kept")


def _verdicts(counted: DataFrame, limits: Limits) -> DataFrame:
    hosts = stored(host_verdicts(counted, "host", "c", limits).select("host", "host_kept"), "quality-verdicts")
    checks = rules("c", limits)
    base = checks["few_words"] | checks["repeated_passages"]
    refused = hosts.where("NOT host_kept").select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    joined = counted.join(refused, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    return joined.select("*", base.alias("base_failed"), (~base & F.col("bad").isNull()).alias("kept"))


def kept_documents(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps.

    Hosts are judged in a first pass over all texts; the second counts again and drops, so texts are not shuffled: the
    refused hosts are joined by Spark's own choice, and are few rows of one name each.
    """
    into = free_name(docs, "quality_counts")
    hosts = stored(
        host_verdicts(with_counts(docs, into, host), host, into, limits).where("NOT host_kept").select(F.col("host").alias("bad_host")),
        "quality-refused",
    )

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([passes(t, limits) for t in texts(batch.column(place))], pa.bool_()))

    place = docs.columns.index("text")
    passed = docs.mapInArrow(run, docs.schema)
    return passed.join(hosts, passed[host].eqNullSafe(hosts["bad_host"]), "left_anti")


def passes(text: str | None, limits: Limits) -> bool:
    """The base rules on one text."""
    found = dict(zip(COUNTS, counts(text), strict=True))
    n = found["n_words"]
    return n >= limits.least_words and 100 * found["n_repeat_words"] <= limits.most_repeat_percent * n
