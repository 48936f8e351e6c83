from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pressline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, decoded int"
PASSAGE = "The passage that many documents share, and which is long enough to be cut into chunks of its own. " * 8


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def source():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def odd_texts(n: int) -> list[str]:
    rng = random.Random(n)
    bits = ["a", "B", " ", "  ", "\n", "é", "é", "ẖ", "H̱", "'s", "'", "1", "<|endoftext|>", "<|ENDOFTEXT|>", " ", " ", "中", "x.", "\x1c",
            "\x85", "\x0b", "ﬁ", "İ", "Σ", ".", "!?", "Word", "word,", "WORD;", "don't", "🙂", "﻿", "́"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_ids_are_the_library_s(source, library):
    own = bpe.Encoder(source)
    assert own.by_word
    for text in [*odd_texts(4000), PASSAGE]:
        assert bpe.unpacked(bpe.encode(bpe.encode_bytes(text), own, {})) == library(text), repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_joins_are_repaired(monkeypatch, name):
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 2)
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        own = bpe.Encoder(file.read())
    rng = random.Random(1)
    for text in [*odd_texts(300), PASSAGE, *(" ".join(odd_texts(k)) for k in (5, 20))]:
        data = bpe.encode_bytes(text)
        places = bpe.cuts(data)
        assert places[0] == 0 and places[-1] == len(data)
        chunks = {data[a:b] for a, b in zip(places, places[1:]) if rng.random() < 0.6}
        shared = {bpe._hash(c): (c, own.library(c)) for c in chunks}
        assert bpe.encode(data, own, shared) == own.library(data), repr(text)


def test_a_small_memo_and_small_pieces(source, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    monkeypatch.setattr(bpe, "LEARN_WORDS", 3)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 40)
    own = bpe.Encoder(source)
    text = " ".join(odd_texts(200)) + PASSAGE
    assert bpe.unpacked(bpe.encode(bpe.encode_bytes(text), own, {})) == library(text)


def test_cuts_depend_on_content_only(monkeypatch):
    passage = PASSAGE.encode()
    alone = bpe.cuts(passage)
    shifted = [c - 777 for c in bpe.cuts(b"x y" * 259 + passage)]
    assert len(alone) > 4 and set(alone[2:-1]) <= set(shifted)
    monkeypatch.setattr(bpe, "HASH_STEP", 50)
    assert bpe.cuts(passage) == alone


def test_shared_chunks_and_results(spark, library, source):
    texts = [f"own words {i} {PASSAGE} and an end {i}" for i in range(6)] + [None, "", "<|endoftext|> x", PASSAGE, PASSAGE]
    table = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1)]
    frame = spark.createDataFrame(table, SCHEMA)
    assert bpe.shared_chunks(frame, source)
    got = bpe.coded(frame, PATH).collect()
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == sorted((repr(i), library(t)) for i, t, *_ in table)
    decode = Tokenizer.from_file(PATH).decode
    assert all(r["decoded"] == decode(r["ids"], skip_special_tokens=False) for r in got)
    found = {r["doc_id"]: r for r in bpe.digests(frame, PATH).collect()}
    assert found[0]["ids_sha256"] == hashlib.sha256(" ".join(map(str, library(texts[0]))).encode()).hexdigest()
    assert found[6]["n_tokens"] == 0 and found[6]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert bpe.coded(spark.createDataFrame([], SCHEMA), PATH).collect() == []
