from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pressline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, lo int, tree string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(digests):
    """The levels of a tree and, per leaf, its siblings from the bottom up."""
    paths = [[] for _ in digests]
    at = list(range(len(digests)))
    level = digests
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // 3 * 3 : place // 3 * 3 + 3]
            paths[i].append((run[: place % 3], run[place % 3 + 1 :]))
            at[i] = place // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    """leaf -> list of (id, leaf, subroot, root, proof, folded root) of its rows."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for source in order:
        mine = sorted(trees[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[source] = (mine, *climb([leaf(r) for r in mine]))
    root, upper = climb([made[s][1] for s in order])
    found = []
    for source, above in zip(order, upper):
        mine, subroot, paths = made[source]
        for row, path in zip(mine, paths):
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            acc = leaf((*row[:4], text))
            for left, right in path + above:
                acc = h(*left, acc, *right)
            proof = h(*[d for left, right in path + above for d in left + right])
            found.append((row[0], leaf(row), subroot, root, proof, acc))
    return sorted(found, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = merkle.manifest(docs, merkle.without_line_ends())
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4, 9, 10), (28, 1, 1, 1), (100, 0, 5, 27)])
def test_against_a_plain_tree(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = []
    for s, n in enumerate(sizes):
        source = [None, "", "é", "b"][s]
        rows += [(rng.randrange(10**9), source, rng.choice([None, "de"]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "ü\n\n" * 50, "z"])) for _ in range(n)]
    check(spark, rows)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(1, "a", None, None, "x"), (1, "a", None, None, "x"), (1, "a", None, None, "y\n"), (None, "a", None, None, "n"), (None, "a", None, None, None),
            (2, "a", "-", 0, ""), (2, None, "-", 0, ""), (-5, "a", "", -1, "\n")]
    check(spark, rows)


def test_null_and_empty_fields_differ(spark):
    docs = spark.createDataFrame([(1, "a", None, 1, "", 1, "", ""), (1, "a", "", 1, None, 1, "", ""), (1, "a", None, 1, None, 1, "", "")], SCHEMA)
    assert docs.select(merkle.leaf_digest().alias("d")).distinct().count() == 3


def test_untampered_rows_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4}", "de", i, f"text {i}\n", 0, "", "") for i in range(200)], SCHEMA)
    found = merkle.manifest(docs)
    assert found.filter("folded_root = root").count() == 200
    tampered = merkle.manifest(docs, F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text")))
    assert [r["doc_id"] for r in tampered.filter("folded_root <> root").collect()] == [7]
    assert found.select("path").filter(F.size("path") < 3).count() == 0


def test_ranks_of_one_large_tree(spark):
    """Ranks run on over the partitions of a range sort; no task numbers a whole tree."""
    rows = spark.range(5000).select(F.lit("t").alias("tree"), (F.col("id") * 7919 % 5003).alias("k"))
    got = merkle.ranked(rows, ["k"])
    assert [r["lo"] for r in got.orderBy("k").select("lo").collect()] == list(range(5000))
    assert {r["n"] for r in got.select("n").distinct().collect()} == {5000}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(tree" in text and "windowspecdefinition(tree#0, k" not in text


def test_no_group_is_larger_than_the_fanout(spark):
    docs = spark.createDataFrame([(i, "one", "de", i, "x", 0, "", "") for i in range(300)], SCHEMA)
    made = docs.select(F.lit("t").alias("tree"), "doc_id", merkle.leaf_digest().alias("digest"), F.lit("").alias("now"))
    for level in merkle.levels(merkle.ranked(made, ["doc_id"])):
        assert level.filter(F.size("kids") > merkle.FANOUT).count() == 0


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
