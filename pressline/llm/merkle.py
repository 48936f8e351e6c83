"""Merkle manifest of a dataset: a hash tree per source, a tree of the sources, a proof per document.

Nodes are rows ``(tree, lo, hi, kids)``: the half-open interval of leaf ranks a node covers, and its at most three children with
theirs. On the way up, nodes of a level meet by the bucket of their lower end. On the way down, a node meets the one node of
the next level whose interval contains its own (joined by tree and bucket of that level), takes over what that one knows
about its ancestors, and finds its siblings as the children of that interval without its own. No group has more than three
rows, whatever the size of a source, and each level is a third of the one below.

Ranks come from a range sort: a row's place in its partition plus the rows of its tree in the partitions before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressline.llm.frames import narrow, stored
from pressline.session import cut_lineage

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """SHA-256 of the fields of a row, each with its length in bytes in front, ``-`` for null."""
    return F.sha2(F.concat(*[_part(replaced.get(c, F.col(c))) for c in FIELDS]), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``lo``, the rank from 0 within ``tree``, and ``n``, the size of the tree, to ``rows(tree, ...)``.

    ``order`` sorts the rows of a tree and must tell any two apart that differ; null is first. Rows come from a written table. One
    tree may hold all of them: it is sorted by ranges of ``order``, and only a row per tree and partition goes through a window.
    """
    tie = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "tie")]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = tie.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("tie")
    placed = stored(dealt.select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
    ), "merkle-ranks")
    sizes = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "tree", "part", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("here").over(Window.partitionBy("tree")).alias("n"),
    )
    return placed.join(starts, ["tree", "part"]).withColumn("lo", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _grown(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` from those of the level below, ``(tree, n, lo, hi, digest, doc_id, now)``."""
    kid = F.struct("lo", "hi", "digest", "doc_id", "now")
    return nodes.groupBy("tree", "n", F.floor(F.col("lo") / F.lit(FANOUT**level)).alias("bucket")).agg(
        F.array_sort(F.collect_list(kid)).alias("kids")
    ).select("tree", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "kids")


def _node_digest() -> Column:
    return F.sha2(_joined(F.col("kids.digest")), 256)


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Nodes ``(tree, n, lo, hi, kids)`` of level 1, 2, ... over ``leaves(tree, n, lo, digest, doc_id, now)``.

    A tree ends at the first level where one node covers it, so a level holds only trees with more nodes below.
    """
    id_type = leaves.schema["doc_id"].dataType.simpleString()
    below = leaves.select("tree", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest", "doc_id", "now")
    largest = leaves.agg(F.max("n")).first()[0] or 0
    found: list[DataFrame] = []
    level = 1
    while FANOUT ** (level - 1) < largest:
        # Each level is written: plans stay small, and the levels above read a third of what this one did.
        grown = stored(_grown(below.where(F.col("n") > FANOUT ** (level - 1)), level), "merkle-level")
        found.append(grown)
        below = grown.select(
            "tree", "n", "lo", "hi", _node_digest().alias("digest"), F.lit(None).cast(id_type).alias("doc_id"),
            F.lit(None).cast("string").alias("now"),
        )
        level += 1
    return found


def _is_top(level: int) -> Column:
    """Whether a node of ``level`` covers its whole tree."""
    return F.col("n") <= FANOUT**level


def _step(kids: Column, lo: Column, hi: Column) -> Column:
    """The siblings of an interval: what its parent covers before and after it."""
    left = F.filter(kids, lambda k: k["hi"] <= lo)
    right = F.filter(kids, lambda k: k["lo"] >= hi)
    return F.struct(_joined(left["digest"]).alias("left"), _joined(right["digest"]).alias("right"))


def _climb(kids: Column, lo: Column, hi: Column, path: Column) -> Column:
    return F.concat(F.array(_step(kids, lo, hi)), path)


def paths(found: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``(tree, doc_id, digest, now, path, subroot, root)`` for the leaves below the nodes ``found``.

    ``path`` lists the siblings from the leaf to the root; ``tops(tree, path, subroot, root)`` has what is above each tree.
    """
    above: DataFrame | None = None
    for level in range(len(found), 0, -1):
        nodes = found[level - 1]
        own = nodes.where(_is_top(level)).join(tops, "tree").select("tree", "lo", "hi", "kids", "path", "subroot", "root")
        if above is not None:
            bucket = F.floor(F.col("lo") / F.lit(FANOUT ** (level + 1)))
            parents = above.select(
                "tree", bucket.alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("kids").alias("p_kids"),
                F.col("path").alias("p_path"), "subroot", "root",
            )
            held = nodes.where(~_is_top(level)).withColumn("bucket", bucket).join(parents, ["tree", "bucket"]).where(
                "p_lo <= lo AND hi <= p_hi"
            )
            own = own.unionByName(held.select(
                "tree", "lo", "hi", "kids", _climb(F.col("p_kids"), F.col("lo"), F.col("hi"), F.col("p_path")).alias("path"),
                "subroot", "root",
            ))
        above = own
    leaf = above.select("tree", "kids", "path", "subroot", "root", F.explode("kids").alias("leaf"))
    return leaf.select(
        "tree", "leaf.doc_id", "leaf.digest", "leaf.now",
        _climb(F.col("kids"), F.col("leaf.lo"), F.col("leaf.hi"), F.col("path")).alias("path"), "subroot", "root",
    )


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def _sources(leaves: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``(tree, subroot)``: the top of each source."""
    tops = [leaves.where("n = 1").select("tree", F.col("digest").alias("subroot"))]
    for level, nodes in enumerate(found, 1):
        tops.append(nodes.where(_is_top(level)).select("tree", _node_digest().alias("subroot")))
    return reduce(DataFrame.unionByName, tops)


def manifest(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, now, folded_root, path)`` for each row of
    ``docs(doc_id, source, lang, n_chars, text, ...)``.

    ``now`` is the text to verify, by default the text itself: ``folded_root`` is the root its leaf gives with the siblings of the
    manifest, so it equals ``root`` where nothing has changed. Null fields have a mark of their own, so null and empty differ;
    a null source is a tree of its own, before all others. Rows with one id are ordered by their leaves; repeated rows are leaves
    each. Other columns are not read. An empty table gives an empty table.
    """
    own = narrow(docs, *FIELDS)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    made = stored(own.select(
        tree.alias("tree"), "doc_id", leaf_digest().alias("digest"),
        leaf_digest(text=F.col("text") if now is None else now).alias("now"),
    ), "merkle-leaves")
    leaves = cut_lineage(ranked(made, ["doc_id", "digest"]))
    found = levels(leaves)

    sources = _sources(leaves, found).select(
        F.lit("").alias("tree"), F.col("tree").alias("doc_id"), F.col("subroot").alias("digest"), F.col("subroot").alias("now")
    )
    upper = cut_lineage(ranked(stored(sources, "merkle-sources"), ["doc_id"]))
    upper_levels = levels(upper)
    top = (upper_levels[-1].select(_node_digest()) if upper_levels else upper.select("digest")).first()
    root = F.lit(top[0] if top else None).cast("string").alias("root")
    none = F.array().cast("array<struct<left: string, right: string>>").alias("path")
    if upper_levels:
        below = paths(upper_levels, upper.select("tree").limit(1).select("tree", none, root.alias("subroot"), root))
    else:
        below = upper.select("doc_id", "digest", none, root)
    placed = below.select(F.col("doc_id").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    tops = cut_lineage(placed)

    alone = leaves.where("n = 1").join(tops, "tree").select("tree", "doc_id", "digest", "now", "path", "subroot", "root")
    every = alone if not found else alone.unionByName(paths(found, tops))
    siblings = _joined(F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    return every.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "now",
        folded(F.col("now"), F.col("path")).alias("folded_root"), "path",
    )


def without_line_ends() -> Column:
    """The text without line ends where the id's CRC-32 is even, else as it is: what ``op12_merkle`` verifies."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
