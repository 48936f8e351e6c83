from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from helpers import rows
from pyspark.sql import functions as F

from pressline.llm import spelling

SCHEMA = "doc_id long, text string, n int, form string, word string"


def plain_words(table, min_length=7, min_count=2):
    """Words and their numbers, code point by code point."""
    total = Counter()
    for doc_id, text in table:
        run = ""
        for c in [*(text or ""), " "]:
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                total[word] += len(word) >= min_length
            run = ""
    return {w: n for w, n in total.items() if n >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(table, **limits):
    words = plain_words(table, **limits)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), words[w], len(near[w]), form[w] and words[form[w]]) for w in words), key=repr)


def table(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in pairs], SCHEMA)


def sample(seed, n=60):
    rng = random.Random(seed)
    base = ["aaaaaaa", "aaaaaaaa", "aaaabaaa", "abababab", "straße", "straßenbahn", "Überÿmäßig", "government", "goverment", "governmental", "À×éàaaaa"]
    found = []
    for i in range(n):
        words = []
        for _ in range(rng.choice([0, 3, 40])):
            w = rng.choice(base[: rng.choice([3, len(base)])])
            if rng.random() < 0.2:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "b", "é", "ÿ"]) + w[at + rng.choice([0, 1]) :]
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w]))
        found.append((i, rng.choice([" ", ", ", "\n", "1", "_"]).join(words)))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_brute_force(spark, seed):
    pairs = [*sample(seed), (None, "governmentt government"), (3, "governmentt"), (3, None), (4, ""), (5, " ĀΑbcdefgh ")]
    pairs += [(100 + i, "government " * 40) for i in range(3)] + [(200, "a" * 5000 + " " + "a" * 5000 + " " + "a" * 4999 + " " + "a" * 4999)]
    got = rows(spelling.variants(table(spark, pairs)))
    want = plain_variants(pairs)
    assert got == want
    assert any(r[1] for r in want)


def test_filters_in_turns_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS_A_BLOCK", 2)
    pairs = sample(3)
    want = plain_variants(pairs)
    assert rows(spelling.variants(table(spark, pairs), turn_blocks=3)) == want
    vocab = spelling.hashed(spelling.vocabulary(table(spark, pairs)))
    counts = {r["s"]: r["n"] for r in vocab.groupBy(F.length("word").alias("s")).agg(F.count("*").alias("n")).collect()}
    made = spelling.turns(counts, 3)
    assert len(made) > 2 and all(sum(size for _, _, size in t.values()) <= 3 for t in made)
    assert any(slices > 1 for t in made for _, slices, _ in t.values())


def test_chains_of_forms(spark):
    counts = {"abcdefgh": 4000, "abcdefg": 300, "abcdefx": 20, "abcdexx": 2}
    ids = iter(range(1000))
    pairs = []
    for w, n in counts.items():
        i = next(i for i in ids if zlib.crc32(f"{i}:{w}".encode()) % spelling.DROP_EVERY)
        pairs.append((i, f"{w} " * n))
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(table(spark, pairs)).collect()}
    assert got == {"abcdexx": ("abcdefx", "abcdefgh"), "abcdefx": ("abcdefg", "abcdefgh"), "abcdefg": ("abcdefgh", "abcdefgh"), "abcdefgh": (None, "abcdefgh")}


def test_edits_are_all_there(spark):
    """Every deletion and every greater replacement, once, whatever the step."""
    import numpy as np

    letters = np.array(sorted(map(ord, spelling.ALPHABET)), np.uint64)
    words = ["aabbcccx", "ÿéaazzzq"]
    points = np.array([[ord(c) for c in w] for w in words], np.uint64)

    def hash_of(text):
        codes = np.array([[ord(c) for c in text]], np.uint64)
        return int(spelling._mixed(spelling._terms(codes)[1][:, -1])[0])

    want = Counter()
    for r, w in enumerate(words):
        want.update({(True, r, hash_of(v)): 1 for v in {w[:i] + w[i + 1 :] for i in range(len(w))}})
        want.update((False, r, hash_of(w[:i] + c + w[i + 1 :])) for i in range(len(w)) for c in spelling.ALPHABET if c > w[i])
    for step in (1, 500, 1 << 20):
        spelling_step, spelling.STEP = spelling.STEP, step
        try:
            got = Counter((s, int(r), int(h)) for s, row, hs in spelling._edits(points, letters) for r, h in zip(row, hs))
        finally:
            spelling.STEP = spelling_step
        assert got == want


def test_empty_tables_and_plans(spark):
    for pairs in ([], [(1, None), (2, ""), (3, "short words only")]):
        found = spelling.variants(table(spark, pairs))
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"] and found.collect() == []
