from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from pressline.llm import secrets

SCHEMA = "doc_id long, text string, source string, lang string, row long, kind int, owner string, value_hash string"
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
WIDER = {kind.name: kind for kind in secrets.KINDS if not kind.base}
ORDER = [*BASE, *WIDER]


def plain_candidates(text):
    """(start, kind number, end, value) of all kinds, before owners are counted."""
    text = text or ""
    found = []
    for name, (pattern, group, least) in BASE.items():
        # Case of ASCII letters only: Python's own folding also takes two other letters for s and k.
        found += [(m.start(), ORDER.index(name), m.end(), m.group(group)) for m in pattern.finditer(text)
                  if len(m.group(group)) >= least and m.group(0).isascii()]
    for name, kind in WIDER.items():
        for m in re.finditer(kind.pattern, text):
            v = m.group(kind.value)
            if len(v) < kind.least or sum(c in "0123456789" for c in v) < kind.digits or len(set(v)) < kind.varied:
                continue
            found.append((m.start(), ORDER.index(name), m.end(), v))
    return sorted(s for s in found if s[1] < 3 or not any(b[1] < s[1] and b[0] < s[2] and s[0] < b[2] for b in found))


def plain_scan(table):
    each = [(i, source, plain_candidates(text)) for i, (_, text, source, _) in enumerate(table)]
    owners = {}
    for _, source, spans in each:
        for *_, value in spans:
            owners.setdefault(value, set()).add(source)

    def verdict(value):
        return "copied" if len(owners[value]) >= 3 else "live" if len(owners[value]) == 1 else "shared"

    return [
        (table[i][0], [(s, k, e, len(owners[v]), verdict(v)) for s, k, e, v in spans if k < 3 or verdict(v) == "live"])
        for i, _, spans in each
    ]


def scan(spark, table):
    docs = spark.createDataFrame([(*r, 1, 2, "o", "v") for r in table], SCHEMA)
    found = secrets.scan(docs, F.to_json(F.struct("source", "lang")), F.col("source")).collect()
    return [(r["doc_id"], [(s["start"], s["kind"], s["end"], s["n_owners"], s["verdict"]) for s in r["spans"]]) for r in found]


def compare(spark, table):
    assert sorted(scan(spark, table), key=repr) == sorted(plain_scan(table), key=repr)


HEX = "0123456789abcdef" * 3
LIVE = "Zq81kd92ls03Xmc74Bvn56Tyu"


def test_kinds_and_places(spark):
    texts = [
        None, "", "nothing here", "password=hunter2", "PassWord : 'abc", "token = \"abcdef\" api_key:xyz12345 apikey = ABC", "secret: token: abcdefgh",
        "x" + HEX + "g", "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + "AKIA" + "C" * 16, "ä🙂 token=🙂 secret=äbc passwd==a=b=c=d", "Passwd: abcdef\npassword\n=abcdef",
        "toKen=abcdefgh ſecret=abcdefgh", f"ghp_{LIVE} and {LIVE}", f"token={LIVE}", f"eyJ{LIVE}.{LIVE}.{LIVE}", "a" * 30, "1" * 30, "deadbeef" * 5 + "Z9" * 9,
        "🙂" * 5 + f" {LIVE[::-1]} " + "🙂" * 3 + LIVE, "token=" * 50,
    ]
    compare(spark, [(i, t, f"s{i % 2}", "de") for i, t in enumerate(texts)])


def test_random_texts(spark):
    rng = random.Random(4)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "abcdef", "AKIA", "ABCDEFGH01234567", HEX, LIVE, "ghp_", "eyJ", ".", "\n", "ü", "🙂", "x"]
    table = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([3, 20, 200]))), f"s{rng.randrange(6)}", "de") for i in range(80)]
    compare(spark, table)


def test_owners_tell_examples_from_live_values(spark):
    example, shared, own = LIVE, LIVE[::-1], "Aa11Bb22Cc33Dd44Ee55Ff66Gg"
    table = [(i, f"see {example} there", f"s{i % 4}", "de") for i in range(12)]
    table += [(20, f"{shared}", "s0", "de"), (21, f"{shared}", "s1", "de"), (30, f"{own}", "s9", "de"), (31, f"{own} {own}", "s9", "fr"), (31, f"{own}", "s9", None)]
    compare(spark, table)
    got = dict(scan(spark, table))
    assert got[0] == [] and got[20] == [] and got[30][0][4] == "live"
    found = secrets.ownership(spark.createDataFrame(
        [("v", "r1", "a"), ("v", "r1", "a"), ("v", "r2", "a"), ("v", "r1", "b"), ("v", None, None), ("w", None, None)], "value_hash string, repository string, owner string"))
    assert {r["value_hash"]: (r["n_repositories"], r["n_owners"]) for r in found.collect()} == {"v": (4, 3), "w": (1, 1)}


def test_repeated_rows_and_null_columns(spark):
    row = (None, f"token=abcdef {HEX}", None, None)
    compare(spark, [row, row, (1, None, None, None), (1, row[1], "a", "b")])


def test_a_text_of_many_matches(spark):
    text = "token=abcdef, " * 20_000 + LIVE
    [(_, spans)] = scan(spark, [(1, text, "a", "de")])
    assert len(spans) == 20_001 and spans[-2][:3] == (14 * 19_999, 0, 14 * 19_999 + 12) and spans[-1][0] == len(text) - len(LIVE)


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "token=abcdef", "a", "de", 1, 2, "o", "v")], SCHEMA)
    marked = docs.select(secrets.matches(F.col("text")).alias("m"), F.lit(1).alias("row"), F.lit("r").alias("repository"), "owner")
    for df in (marked, secrets.candidates(marked)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_no_value_is_written(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh", "a", "de", 1, 2, "o", "v")], SCHEMA)
    made = docs.select(F.to_json(secrets.matches(F.col("text"))).alias("m")).first()["m"]
    assert "abcdefgh" not in made


def test_empty_table(spark):
    assert scan(spark, []) == []
