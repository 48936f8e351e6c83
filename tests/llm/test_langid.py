from __future__ import annotations

import numpy as np
import pytest

from pressline.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, held_out int"


@pytest.fixture(scope="module")
def docs(spark):
    words = {"en": "the of and to in that with for this from", "de": "der die und in den von zu das mit sich", "fr": "de la le et les des en un une du"}
    found = [(i, " ".join(w.split()[(i + k) % 10] for k in range(12)), lang, "x", 1) for i in range(60) for lang, w in [list(words.items())[i % 3]]]
    return spark.createDataFrame([*found, (100, None, "en", "x", 1), (101, "123 ...", "en", "x", 1), (102, "the und la", None, "x", 1),
                                  (None, "der die und von zu", "fr", "x", 1), (103, "", "xx", None, None)], SCHEMA)


def plain_model(docs) -> dict[str, dict[int, int]]:
    from zlib import crc32
    sums = {}
    for r in docs.collect():
        if r["text"] is not None and r["lang"] is not None and r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 4 != 2:
            own = sums.setdefault(r["lang"], {})
            for found in langid.buckets(r["text"], langid.BUCKETS):
                for b in found.tolist():
                    own[b] = own.get(b, 0) + 1
    return sums


def test_counts_are_those_of_all_training_rows(docs):
    model = langid.train_without_held_out(docs)
    want = plain_model(docs)
    assert list(model.languages) == sorted(want)
    for k, lang in enumerate(model.languages):
        counts = np.zeros(langid.BUCKETS)
        for b, n in want[lang].items():
            counts[b] = n
        assert np.allclose(model.weights[:, k], np.log((counts + 0.5) / (counts + 0.5).sum()), atol=1e-4)


def test_predictions(docs):
    got = langid.predictions(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (0, 1, 2)] == ["en", "de", "fr"]
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (100, 101, 103))
    assert by_id[None]["lang_pred"] == "de" and by_id[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_accuracy_on_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.predictions(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_a_long_text_is_hashed_in_steps(monkeypatch):
    text = "äöü some text " * 50
    whole = [np.sort(np.concatenate(list(x))) for x in [list(langid.buckets(text, 1024))]][0]
    monkeypatch.setattr(langid, "STEP", 7)
    assert np.array_equal(np.sort(np.concatenate(list(langid.buckets(text, 1024)))), whole)


def test_rows_that_stay(docs):
    kept = langid.in_a_language(docs, langid.train_without_held_out(docs))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= set(range(60)) | {None}
    assert not {100, 101, 103} & {r["doc_id"] for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.predictions(empty).collect() == []
    one = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert [tuple(r)[2:] for r in langid.predictions(one).collect()] == [("und", 0.0)]
