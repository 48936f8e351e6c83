from __future__ import annotations

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from check_queries import TABLES, bag
from pressline.llm import queries


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, sf_dir, db, name):
    frame = entry.queries()[name](spark, sf_dir)
    result = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert bag(frame.columns, frame.collect()) == bag(columns, result.fetchall())


def test_every_operator_has_a_query():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages_on_the_given_documents(spark, sf_dir):
    """Each stage keeps whole rows of its input, and the drops are those the queries report."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in docs.collect()}
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns, name
        after = [tuple(r) for r in made.collect()]
        assert set(after) <= before and 0.5 * len(before) < len(after) == len(set(after)), name
        docs = spark.createDataFrame(after, docs.schema)
    name, stage = corpus_pipeline.STAGES[-1]
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = stage(spark, docs, sf_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def test_odd_rows_pass_through_all_stages(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans int, quality_counts string"
    good = " ".join(f"Word{i} der die und" for i in range(40))
    table = [(1, good, "de", "a", 1, 1, "q"), (1, good, "de", "a", 1, 1, "q"), (2, None, None, None, None, None, None), (3, "", "de", "a", 1, 1, "q"),
             (None, good + " other ending", None, None, None, None, None), (4, good * 300, "de", "a", 1, 1, "q")]
    docs = spark.createDataFrame(table, schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf_dir)
            frame.count()
    assert set(corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).columns) == set(docs.columns)
