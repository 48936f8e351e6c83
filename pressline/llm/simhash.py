"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, components.

Two 64-bit fingerprints that differ in at most ``d`` bits agree on at least two of ``d + 2`` blocks. So every fingerprint
is keyed by each pair of its blocks, the keys are joined and the Hamming distance is verified. Exact copies fall together
before that: only distinct fingerprints are keyed.

A key with more than ``DENSE`` fingerprints (a large group of near copies) would give pairs with the square of its size. Its
members are linked through shared points instead: fingerprints within ``d`` bits have a point at ``d // 2`` bits from one
and ``d - d // 2`` from the other, and members of one point are all within ``d`` of its centre-most one. That gives the same
components with a fixed number of rows per fingerprint, for groups of any size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pressline.llm.components import components
from pressline.llm.frames import by_batch, free_name, narrow, plus, stored, texts
from pressline.session import cut_lineage

BITS = 64
SEED = 42
# Fingerprints in one block pair beyond which they are linked through points rather than pairs.
DENSE = 64
# Shingles hashed before their bits are counted; bounds the memory a long text takes.
STEP = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The fingerprint of one text: the bits set in over half of the shingle hashes; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    counts = np.zeros(BITS, np.int64)
    for start in range(0, n, STEP):
        stop = min(start + STEP, n)
        part = [words[start + j : stop + j] for j in range(k)]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*part, strict=True))), "<u8", stop - start
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the 64-bit fingerprint as a signed long, 0 for a null or wordless text."""
    docs = narrow(docs, "doc_id", "text")

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t, shingle_words) for t in texts(batch.column(1))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def block_masks(max_distance: int) -> list[int]:
    """A mask of each pair of the ``max_distance + 2`` blocks."""
    blocks = max_distance + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [_signed(a | b) for a, b in combinations(each, 2)]


def links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """``(a, b)``: links between the distinct values of ``fps.fp`` that give the components of "at most that many bits differ"."""
    masks = F.array(*[F.lit(m) for m in block_masks(max_distance)])
    keyed = fps.select("fp").distinct().select("fp", F.posexplode(masks).alias("block", "mask"))
    keyed = keyed.select("fp", "block", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    sizes = keyed.groupBy("block", "bits").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(keyed.join(sizes, ["block", "bits"]))

    few = members.where(F.col("n") <= DENSE)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    pairs = (
        few.select("block", "bits", F.col("fp").alias("a"))
        .join(few.select("block", "bits", F.col("fp").alias("b")), ["block", "bits"])
        .where(F.col("a") < F.col("b")).where(near).select("a", "b")
    )
    dense = members.where(F.col("n") > DENSE).select("fp").distinct()
    return pairs.unionByName(_through_points(dense, max_distance))


def _through_points(fps: DataFrame, max_distance: int) -> DataFrame:
    """Each fingerprint linked to one at the centre of every point they share; linear in the number of fingerprints."""
    inner, outer = max_distance // 2, max_distance - max_distance // 2
    flips = [[], []]
    for r in range(outer + 1):
        for bits in combinations(range(BITS), r):
            flips[r > inner].append(_signed(sum(1 << b for b in bits)))
    shifts = F.array(*[
        F.struct(F.lit(m).alias("flip"), F.lit(far == 0).alias("core")) for far, some in enumerate(flips) for m in some
    ])
    points = fps.select("fp", F.explode(shifts).alias("s")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("s.flip")).alias("point"), F.col("s.core").alias("core")
    )
    centres = points.where("core").groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("other"))
    if inner == outer:
        centres = centres.where("b < other")
    return points.join(centres, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _grouped(docs: DataFrame, shingle_words: int, max_distance: int) -> DataFrame:
    """``(doc_id, fp, component_id, root)`` for every row; ``root`` names the component also where ids repeat or are null."""
    fps = stored(fingerprints(docs, shingle_words), "simhash-fingerprints")
    groups = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = cut_lineage(components(links(groups, max_distance)).withColumnRenamed("node", "fp"))
    linked = groups.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("root_id"))
    linked = roots.join(smallest, "root").select("fp", "root_id", "root")
    named = groups.join(linked, "fp", "left").select(
        "fp", F.coalesce("root_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links of at most ``max_distance`` differing bits,
    the row's own included. Null, empty and wordless texts have fingerprint 0 and link like any other. Repeated rows and
    repeated ids keep one row each. A null ``doc_id`` never becomes a ``component_id``: its row takes the smallest id of its
    component, or null if that has none. An empty table gives an empty table.
    """
    return _grouped(docs, shingle_words, max_distance).drop("root")


def fingerprint_text(fp) -> F.Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each_group(docs: DataFrame, shingle_words: int = 3, max_distance: int = 2) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, all columns, of which one per near-duplicate group stays.

    It is that with the smallest ``doc_id``, a null one last, and of these the smallest fingerprint: rows that share an id but
    not their text are told apart. Of rows with the same id and fingerprint one stays. Null, empty and wordless texts are one
    group. An empty table gives an empty table.

    Only rows whose id is null or repeats are read again for their fingerprint.
    """
    found = cut_lineage(_grouped(docs, shingle_words, max_distance))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "fp")).alias("k")
    kept = found.groupBy("root").agg(first).select("k.doc_id", "k.fp")
    often = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1").select("doc_id")

    row_id, row_fp = free_name(docs, "kept_id"), free_name(docs, "simhash_fp")
    ids = kept.join(often, "doc_id", "left_anti").where("doc_id IS NOT NULL").select(F.col("doc_id").alias(row_id))
    named = docs.join(ids, docs["doc_id"] == F.col(row_id), "left_semi")
    if often.isEmpty():
        return named
    same = F.col(row_id).eqNullSafe(docs["doc_id"])
    unclear = docs.join(often.select(F.col("doc_id").alias(row_id)), same, "left_semi")
    marked = _with_fingerprint(unclear, row_fp, shingle_words)
    pairs = kept.select(F.col("doc_id").alias(row_id), F.col("fp").alias(f"_{row_fp}"))
    one = marked.join(
        pairs, marked["doc_id"].eqNullSafe(F.col(row_id)) & (F.col(row_fp) == F.col(f"_{row_fp}")), "left_semi"
    ).dropDuplicates(["doc_id", row_fp])
    return named.unionByName(one.drop(row_fp))


def _with_fingerprint(docs: DataFrame, name: str, shingle_words: int) -> DataFrame:
    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index("text"))
        found = np.fromiter((fingerprint(t, shingle_words) for t in texts(column)), np.uint64, batch.num_rows)
        return batch.append_column(name, pa.array(found.view(np.int64)))

    return docs.mapInArrow(run, plus(docs, (name, LongType())))
