from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pressline.llm import decontaminate as D
from pressline.llm.fm_index import FmIndex, suffix_order

SCHEMA = "doc_id long, text string, spans string, items int, n_words string"


def plain_words(text: str | None) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain(text, items):
    own, hit, found = plain_words(text), set(), set()
    for item_id, item in items:
        words = plain_words(item)
        k = min(13, len(words))
        for i in range(len(words) - k + 1 if words else 0):
            for j in range(len(own) - k + 1):
                if own[j : j + k] == words[i : i + k]:
                    hit |= set(range(j, j + k))
                    found |= {str(item_id)} - {"None"}
    return len(own), hit, sorted(found)


def data(seed: int):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "the", "Über", "x1", "of"]
    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 13, 14, 30]))) for i in range(8)] + [(None, text(15)), (20, None), (21, ""), (22, "..."), (3, text(14))]
    docs = []
    for i in range(40):
        parts = [text(rng.randrange(0, 30))] + [rng.choice(["unknown word", rng.choice([t for _, t in items if t])]) for _ in range(rng.randrange(3))] + [text(9)]
        docs.append((i, " ".join(parts)))
    return docs + [(50, None), (51, ""), (52, "!?"), (None, items[3][1]), (1, docs[1][1])], items


@pytest.mark.parametrize(("seed", "block_bytes", "shard"), [(1, 1 << 20, 1 << 20), (2, 60, 1 << 20), (3, 1 << 20, 20), (4, 100, 14)])
def test_spans_against_brute_force(spark, monkeypatch, seed, block_bytes, shard):
    docs, items = data(seed)
    monkeypatch.setattr(D, "SHARD", shard)
    frame = spark.createDataFrame([(i, t, "s", 1, "n") for i, t in docs], SCHEMA).coalesce(2)
    got = D.removal_spans(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes).collect()
    found = sorted((repr(r["doc_id"]), r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in got)
    want = []
    for i, t in docs:
        n, hit, named = plain(t, items)
        spans = [(s, min(e for e in range(s, n + 1) if e not in hit)) for s in sorted(hit) if s - 1 not in hit]
        want.append((repr(i), n, spans, named))
    assert found == sorted(want)


def test_shard_in_one_process(monkeypatch):
    """Pieces of a long text, without Spark's workers, which do not see a patched size."""
    docs, items = data(7)
    phrases = D.Phrases.of([t for _, t in items])
    ids = [None if i is None else str(i) for i, _ in items]
    for shard in (14, 40, 1 << 20):
        monkeypatch.setattr(D, "SHARD", shard)
        found = D._find(iter([t for _, t in docs]), ids, phrases, [], [])
        for row, (_, text) in enumerate(docs):
            n, hit, named = plain(text, items)
            assert (found.n_words[row], {int(w) for r, w in found.hits if r == row}, found.items[row]) == (n, hit, named)


def test_suffix_order_and_search():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 2), (50, 2), (500, 3), (400, 60)):
        text = rng.integers(1, kinds + 1, n)
        full = np.append(text, 0).tolist()
        assert suffix_order(np.array(full)).tolist() == sorted(range(n + 1), key=lambda i: full[i:])
        index = FmIndex(text, kinds + 1, sample=7)
        phrases = [rng.integers(1, kinds + 1, 3).tolist() for _ in range(20)]
        low, high = index.search(lambda p, j: np.array([phrases[i][2 - j] for i in p], np.int64), 20, np.full(20, 3))
        found = {k: set() for k in range(20)}
        for phrase, place in index.occurrences(low, high):
            for k, at in zip(phrase.tolist(), place.tolist(), strict=True):
                found[k].add(at)
        for k, phrase in enumerate(phrases):
            assert found[k] == {i for i in range(n - 2) if text[i : i + 3].tolist() == phrase}


def test_clean_documents_stay_whole(spark):
    item = " ".join(f"w{i}" for i in range(20))
    table = [(1, item, "s", 1, "n"), (2, f"{item} " + "other " * 379, "s", 1, "n"), (3, f"{item} " + "other " * 381, "s", 1, "n"), (4, None, "s", 1, "n"),
             (5, " ".join(item.split()[:12]), "s", 1, "n"), (None, "clean", None, None, None)]
    kept = D.clean_documents(spark.createDataFrame(table, SCHEMA), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "spans", "items", "n_words"]
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == ["3", "4", "5", "None"]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", "s", 1, "n")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in D.removal_spans(docs, none).collect()] == [(1, 2, [], [])]
    assert D.removal_spans(docs.limit(0), none).collect() == []
    assert D.clean_documents(docs, none).count() == 1


def test_one_block_at_a_time_on_the_driver(spark, monkeypatch):
    docs, items = data(5)
    words = " ".join(f"w{i % 7}{i % 11}{i % 13}" for i in range(200))
    items.append((30, words))
    docs += [(60, " ".join(words.split()[40:90])), (61, words)]
    frame, bench = spark.createDataFrame([(i, t, "s", 1, "n") for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    whole, sizes, make = D.removal_spans(frame, bench).collect(), [], D.Phrases.of
    clean = D.clean_documents(frame, bench).collect()
    monkeypatch.setattr(D.Phrases, "of", staticmethod(lambda parts: sizes.append([len(t) for t in parts]) or make(parts)))
    freed, destroy = [], D.Broadcast.destroy
    monkeypatch.setattr(D.Broadcast, "destroy", lambda self, *a: freed.append(len(sizes)) or destroy(self, *a))
    parts = D.removal_spans(frame, bench, 400)
    assert len(sizes) > 2 and freed == list(range(1, len(sizes) + 1))
    assert max(n for block in sizes for n in block) <= 400
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole))
    assert sorted(map(repr, D.clean_documents(frame, bench, block_bytes=400).collect())) == sorted(map(repr, clean))


def test_pieces_hold_every_window():
    own = [f"w{i}" for i in range(100)]
    for most in (1, 60, 200, 10_000):
        parts = [p.split() for p in D.pieces(" ".join(own), most)]
        windows = [tuple(p[i : i + 13]) for p in parts for i in range(len(p) - 12)]
        assert windows == [tuple(own[i : i + 13]) for i in range(88)] and min(map(len, parts)) >= 13
