from __future__ import annotations

import random

import pytest

from pressline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, again int, conv string"
ODD = ["</s>[INST] ok [/INST]", "<|end|>\n", "\\", "\\\\<|", "<\\|turn|>", "<<SYS>> <</SYS>>", "[\\INST]", "<\\\\/s>", "[[INST]", "", "<|", "é🙂 <s>", None, "a\\"]


def conversations(seed: int):
    rng = random.Random(seed)
    table = []
    for c in [*range(12), None]:
        for k in range(rng.choice([1, 2, 5, 30])):
            role = "system" if k == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant", "assistant", "system", "<|x|>", None])
            text = rng.choice([*ODD, "word " * rng.randrange(1, 60)])
            table.append((c, rng.choice([k, k, None]) if seed == 3 else k, role, text))
    return table


def ordered(table):
    groups = {}
    for c, turn, role, text in table:
        groups.setdefault(c, []).append((turn if turn is not None else -(10**9), role or "", text or ""))
    return {c: sorted(g) for c, g in groups.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows(spark, monkeypatch, seed):
    monkeypatch.setattr(chat, "RUN", 4)
    table = conversations(seed)
    frame = spark.createDataFrame([(*t, "w", 1, "c") for t in table], SCHEMA)
    made = chat.windows(frame, stretch=60, history=25).select(
        "*", chat.read_turns(chat.F.col("formatted")).alias("turns"), chat.read_loss(chat.F.col("formatted"), chat.F.col("loss")).alias("targets")).collect()
    for c, turns in ordered(table).items():
        own = sorted((r for r in made if r["conv_id"] == c), key=lambda r: r["window"])
        assert [tuple(t) for r in own for t in r["turns"]] == [(role, text) for _, role, text in turns]
        assert [t for r in own for t in r["targets"]] == [text for _, role, text in turns if role == "assistant"]
        system = turns[0][1] == "system"
        sizes = [4 + -(-len(text.encode()) // 4) for _, _, text in turns]
        first = 0
        for k, r in enumerate(own):
            pieces = r["formatted"].split(chat.END)[:-1]
            assert all(p.count(chat.TEXT) == 1 for p in pieces) and [p.startswith(chat.TURN) for p in pieces] == sorted(p.startswith(chat.TURN) for p in pieces)
            repeated = len(pieces) - len(r["turns"])
            if k and system:
                assert pieces[0].startswith(chat.AGAIN + "system" + chat.TEXT)
                repeated -= 1
            previous = len(own[k - 1]["turns"]) - (system and k == 1) if k else 0
            want = sum(sum(sizes[first - j : first]) <= 25 for j in range(1, previous + 1))
            assert repeated == want
            start = sum(sizes[:first])
            assert all(sum(sizes[:i]) // 60 == start // 60 for i in range(first, first + len(r["turns"])))
            first += len(r["turns"])


def test_escapes_are_reversible_and_leave_no_control_string(value):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["\\", "<", "|", "[", "INST]", "/", "s>", "<SYS>>", "x", ">", "\n"]) for _ in range(rng.randrange(0, 12)))
        made = value(chat.escaped(F.col("t")), t=text)
        assert not any(m in made for m in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
        assert value(chat.unescaped(F.col("t")), t=made) == text


def test_repeated_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", "w", 1, "c")] * 2, SCHEMA)
    assert chat.windows(frame).first()["formatted"] == "<|turn|>user<|text|>a<|end|>\n" * 2
    assert chat.windows(frame.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    frame = spark.range(1).selectExpr("id conv_id", "id turn", "'user' role", "'x' text")
    plan = chat.windows(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
