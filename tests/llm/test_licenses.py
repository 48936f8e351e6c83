from __future__ import annotations

import random
import re

from pressline.llm import licenses as L

SCHEMA = "doc_id long, text string, labels int, n_words string, score int"


def plain_words(text: str | None) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain(text, templates) -> tuple:
    own, places, labels, exact, score = plain_words(text), [], set(), set(), 0.0
    for t in templates:
        words = plain_words(t.text)
        if t.exact:
            at = [p for p in range(len(own)) if own[p : p + len(words)] == words]
            places += at
            if at:
                labels.add(t.label), exact.add(t.label)
                score = 1.0
            continue
        for b in range(0, max(len(own), 1), L.STRIDE):
            block = set(own[b : b + L.BLOCK])
            share = len(set(words) & block) / len(set(words))
            if share >= t.threshold - 1e-12:
                labels.add(t.label)
                score = max(score, share)
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(exact)), ",".join(sorted(labels)), score


def test_against_brute_force(spark):
    rng = random.Random(3)
    phrases = [t.text for t in L.TEMPLATES] + ["MIT\nLicense", "mit-license", "MIT licenses", "General Public. License!", "license", "mit", "permission granted to any copy"]
    texts = [None, "", "..."]
    for _ in range(150):
        parts = [rng.choice([*phrases, " ".join(rng.choice(["the", "of", "this", "license", "x", "Ü"]) for _ in range(rng.randrange(1, 60)))])
                 for _ in range(rng.randrange(1, 8))]
        if rng.random() < 0.4:
            parts = [" ".join(w for w in " ".join(parts).split() if rng.random() < 0.9)]
        texts.append(" ".join(parts))
    table = [(i, t, 1, "n", 1) for i, t in enumerate(texts)] + [(None, "MIT License", 1, "n", 1), (3, texts[3], 1, "n", 1)]
    got = sorted(map(tuple, L.scan(spark.createDataFrame(table, SCHEMA)).collect()), key=repr)
    assert got == sorted([(i, *plain(t, L.TEMPLATES)) for i, t, *_ in table], key=repr)
    assert {x for r in got for x in r[6].split(",")} > {"mit", "apache", "gpl", "bsd"}


def test_rare_words_first_and_filters_lose_nothing():
    templates = (L.Template("a", "x y z w v", 0.6), L.Template("b", "z w", 1.0), L.Template("c", "v q", 0.5))
    rng = random.Random(1)
    for counts in ({}, {b"z": 9, b"w": 8, b"x": 1}, {b"q": 5, b"v": 7}):
        index = L.Index.of(templates, counts)
        assert index.sets[1] == sorted(index.sets[1])
        for _ in range(200):
            words = rng.sample([b"x", b"y", b"z", b"w", b"v", b"q"], rng.randrange(0, 6))
            block = sorted(index.rank[w] for w in words)
            want = {t for t, own in enumerate(index.sets) if len(set(own) & set(block)) >= index.need[t]}
            assert {t for t, _ in index.in_block(block)} == want


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []
