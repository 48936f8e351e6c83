from __future__ import annotations

import random

import pytest
import xxhash
from helpers import rows, smallest_reachable

from pressline.llm import simhash
from pressline.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text: str | None, k: int = 3) -> int:
    words = [w.encode() for w in (text or "").replace("\x85", "\x85").encode().lower().decode().split(" ") if w] if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def sample_texts(n: int) -> list[str | None]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)] + ["Ärger", "ÉTÉ", "the"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 60, 400]))) for _ in range(n // 3)]
    near = [t + " tail" for t in base]
    return [None, "", " \t\n", "A", "a", *base, *near, *base[:10]]


def test_fingerprints_equal_the_plain_ones():
    for text in sample_texts(60):
        assert simhash.fingerprint(text) == plain_fingerprint(text if text and text.strip() else None)


def test_long_text_is_counted_in_steps(monkeypatch):
    text = " ".join(f"x{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("ä b c",)], "s string").selectExpr("xxhash64(s) h").first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("ä b c".encode(), 42)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_components_of_fingerprints(spark, monkeypatch, distance):
    rng = random.Random(distance)
    values = {0}
    while len(values) < 220:  # walks of one or two bits: chains, dense groups and strangers
        start = rng.choice(sorted(values)) if rng.random() < 0.85 else rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            start ^= 1 << rng.choice([0, 1, 2, 15, 16, 33, 47, 63])
        values.add(start)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = smallest_reachable(sorted(signed), lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= distance)
    for dense in (10_000, 2):  # all by pairs, nearly all through points
        monkeypatch.setattr(simhash, "DENSE", dense)
        got = {r["node"]: r["root"] for r in components(simhash.links(fps, distance)).collect()}
        assert {v: got.get(v, v) for v in signed} == want


def test_near_duplicates_against_brute_force(spark):
    texts = sample_texts(40)
    table = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y"), (None, "A", "x", "y"), (None, "only this one here", "x", "y")]
    got = simhash.near_duplicates(spark.createDataFrame(table, SCHEMA))
    prints = {i: simhash.fingerprint(t) for i, t in enumerate(texts)}
    want = smallest_reachable(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    found = got.collect()
    assert len(found) == len(table)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    lost = {r["fp"] % (1 << 64): r["component_id"] for r in found if r["doc_id"] is None}
    assert lost == {simhash.fingerprint("A"): want[3], simhash.fingerprint("only this one here"): None}


def test_one_row_of_each_group_stays(spark):
    same = "one two three four five six seven"
    table = [(4, same, "f", "c"), (2, same, "f", "c"), (2, same, "f", "c"), (None, same, "f", "c"), (7, "something else stands here", "f", "c"),
             (None, "without any id at all", "f", "c"), (None, "without any id at all", "f", "c"), (9, None, None, None), (8, "", None, None)]
    got = simhash.one_of_each_group(spark.createDataFrame(table, SCHEMA))
    assert got.columns == ["doc_id", "text", "fp", "component_id"]
    assert rows(got.select("doc_id", "text")) == sorted(
        [(2, same), (7, "something else stands here"), (None, "without any id at all"), (8, "")], key=repr)


def test_repeated_ids_with_other_texts(spark):
    a, b = "one two three four five six seven", "quite another text with other words in it"
    for table, want in (
        ([(2, a), (2, b)], [(2, a), (2, b)]),
        ([(1, b), (2, b), (2, a)], [(1, b), (2, a)]),
        ([(2, a), (2, b), (1, a), (1, b)], [(1, a), (1, b)]),
        ([(None, a), (None, a), (None, b), (3, b)], [(None, a), (3, b)]),
    ):
        docs = spark.createDataFrame(table, "doc_id long, text string")
        assert rows(simhash.one_of_each_group(docs)) == sorted(want, key=repr)


def test_extra_columns_with_the_names_used_inside(spark):
    a = "one two three four five six seven"
    schema = "doc_id long, text string, kept_id long, simhash_fp string, root int, n int, fp int"
    docs = spark.createDataFrame([(1, a, 7, "x", 1, 1, 1), (2, a, 8, "y", 2, 2, 2), (2, "b c d", 9, "z", 3, 3, 3)], schema)
    got = simhash.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert rows(got) == [(1, a, 7, "x", 1, 1, 1), (2, "b c d", 9, "z", 3, 3, 3)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each_group(empty).collect() == []
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(5, 5), (None, 3), (3, None), (0, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
