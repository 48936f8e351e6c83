from __future__ import annotations

import random
import re

from helpers import rows

from pressline.llm import quality

SCHEMA = "doc_id long, text string, source string, kept string, c int, host string, bad_host string"
SPACES = " \t\n\x0b\x0c\r"


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    words = [w for w in re.split(f"[{SPACES}]", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(lines)


def test_counts_against_brute_force():
    rng = random.Random(2)
    pieces = ["a b c d e f g h", "a b c d e f g h i", "x", "é ü", "\n", " ", "\x1c", "###", "line one\nline one", "\t", "<b>"]
    for _ in range(300):
        text = rng.choice([" ", "\n", ""]).join(rng.choice(pieces) for _ in range(rng.randrange(0, 14)))
        assert quality.counts(text) == plain_counts(text), repr(text)
    assert quality.counts(None) == (0,) * 6


def test_eight_equal_words_in_a_row():
    assert quality.repeat_words([b"a"] * 8) == 0
    assert quality.repeat_words([b"a"] * 9) == 9
    assert quality.repeat_words([b"b", *[b"a"] * 9, b"c"]) == 9


def documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short"
    table = [(i, good, "good", "x", 1, "h", "b") for i in range(50)] + [(100 + i, bad, "good", "x", 1, "h", "b") for i in range(3)]
    table += [(200 + i, bad, "farm", "x", 1, "h", "b") for i in range(60)] + [(300, good, "farm", "x", 1, "h", "b")]
    table += [(400, good, None, "x", 1, "h", "b"), (None, good, "good", None, None, None, None), (401, None, None, "x", 1, "h", "b"),
              (402, bad, "tiny", "x", 1, "h", "b"), (403, good, "tiny", "x", 1, "h", "b"), (0, good, "good", "x", 1, "h", "b")]
    return spark.createDataFrame(table, SCHEMA)


def test_hosts_decide_and_small_hosts_are_shrunk(spark):
    got = {r["doc_id"]: r for r in quality.judge(documents(spark)).collect()}
    assert got[0]["kept"] and not got[100]["kept"] and got[100]["base_failed"]
    assert not got[300]["kept"] and not got[300]["base_failed"]
    assert got[400]["kept"] and not got[401]["kept"] and got[403]["kept"] and got[None]["kept"]
    assert quality.judge(documents(spark)).count() == documents(spark).count()


def mixed_hosts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    symbols, lines = f"{good} " + "#" * 40, "\n".join([good, *["one line"] * 6])
    table = [(i, good, "good", "x", 1, "h", "b") for i in range(100)]
    table += [(200 + i, (symbols, lines)[i % 2] if i < 58 else good, "mixed", "x", 1, "h", "b") for i in range(60)]
    table += [(300 + i, (symbols, lines)[i % 2] if i < 20 else good, "mostly clean", "x", 1, "h", "b") for i in range(60)]
    return spark.createDataFrame(table, SCHEMA)


def test_junk_of_several_kinds_adds_up(spark):
    docs = mixed_hosts(spark)
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert not any(r["base_failed"] for r in judged.values())
    assert {i for i, r in judged.items() if not r["kept"]} == set(range(200, 260))
    assert {r["source"] for r in quality.kept_documents(docs).select("source").collect()} == {"good", "mostly clean"}


def test_kept_documents_are_those_judged_kept(spark):
    docs = documents(spark)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    want = [r["doc_id"] for r in quality.judge(docs).where("kept").collect()]
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, want))


def test_prior_of_one_host_and_of_none(spark):
    assert quality.beta_prior(spark.createDataFrame([], "n_docs long, f long"), "f") == (1.0, 1.0)
    a, b = quality.beta_prior(spark.createDataFrame([(10, 5)], "n_docs long, f long"), "f")
    assert abs(a / (a + b) - 0.5) < 1e-9
    a, b = quality.beta_prior(spark.createDataFrame([(100, 90), (100, 10), (100, 50)], "n_docs long, f long"), "f")
    assert 2 <= a + b < 20


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(quality.judge(empty)) == [] and rows(quality.kept_documents(empty)) == []
