"""Cases that every operator has to stand: repeated and null ids, very long texts, clashing columns, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featurespark.llm import chat, language, licences, toxicity
from tests.llm.conftest import TEXTS, TOKENIZER

#: Columns named like those that the operators give out themselves.
WIDE = "doc_id long, text string, score double, predicted int, lang_pred string, license string, row long, _row long, keep boolean"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, 9.0, 9, "zz", "zz", 9, 9, True) for i, t in rows], WIDE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def said(spark):
    return spark.createDataFrame([(i, "a kind word for all" if i % 6 else "you idiot and scum") for i in range(240)], "doc_id long, text string")


def test_toxicity_of_repeated_long_and_null_rows(spark, said, labels):
    model = toxicity.fit(said, labels, F.lit(True))
    long_ = "kind words " * 200_000
    rows = [(1, "idiot scum"), (1, "a kind word"), (1, "idiot scum"), (None, "idiot scum"), (2, None), (3, ""), (4, long_), (5, long_ + "idiot scum")]
    found = toxicity.score(wide(spark, rows), model)
    assert found.columns == ["doc_id", "score", "predicted"]
    got = sorted(((r.doc_id or -1, r.predicted) for r in found.collect()))
    assert got == [(-1, 1), (1, 0), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]


def languages(spark):
    words = {"aa": "aka bako cado dako", "bb": "ilin mires rines tinel"}
    rows = [(i, (words["aa"], words["bb"])[i % 2], ("aa", "bb")[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_repeated_long_and_null_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 30)
    model = language.fit(languages(spark), 30)
    long_ = "aka bako cado dako " * 100_000
    rows = [(1, "aka bako"), (1, "ilin mires"), (1, "aka bako"), (None, "rines tinel"), (2, None), (3, ""), (4, long_), (5, "x" * 300_000), (6, "12 !")]
    found = language.predict(wide(spark, rows), *model)
    assert found.columns == ["doc_id", "lang_pred", "score"]
    got = sorted((r.doc_id or -1, r.lang_pred) for r in found.collect())
    assert [g for g in got if g[0] != 5] == [(-1, "bb"), (1, "aa"), (1, "aa"), (1, "bb"), (2, "und"), (3, "und"), (4, "aa"), (6, "und")]
    assert len(got) == 9
    kept = language.keep_known(languages(spark).unionByName(languages(spark).where("doc_id < 4")), F.lit(True))
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 64


def test_of_equally_likely_languages_the_first_by_name(spark):
    weights = language.Network(3).weights
    flat = {k: np.zeros_like(v) for k, v in weights.items()}
    found = language.predict(wide(spark, [(1, "some words")]), ["cc", "dd", "ee"], flat).first()
    assert found.lang_pred == "cc" and found.score == pytest.approx(1 / 3)


def test_licences_of_repeated_and_null_ids(spark):
    rows = [(1, "Licensed under CC BY 4.0."), (1, "Licensed under CC BY 4.0."), (None, "Licensed under CC BY 4.0."), (None, None), (2, "x " * 300_000)]
    found = {(r.doc_id, r.license): r.n_units for r in licences.scan_licences(wide(spark, rows)).collect()}
    assert found == {(1, "CC-BY-4.0"): 2, (None, "CC-BY-4.0"): 1}


def test_conversations_with_repeated_rows(spark):
    rows = [(1, 0, "user", "a", 5)] * 3 + [(1, 1, "assistant", "b", 5)] * 2 + [(None, None, None, None, 5)] * 2
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest_conversations(chat.format_conversations(table, TOKENIZER)).collect()}
    assert found == {1: (5, 2), None: (2, 0)}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_stand_null_texts_repeated_ids_and_own_columns(spark, tmp_path, name):
    labels = [(i, int("idiot" in (t or ""))) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i % 5 if i % 4 else None, t, "en" if i % 2 else None, "s", 1, 7, 8) for i, t in enumerate([*TEXTS, *TEXTS])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long, row long").coalesce(3)
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) <= len(rows) and all(r["_row"] == 7 and r["row"] == 8 for r in found)
    if name == "exact_copies":
        assert len(found) == len({" ".join((t or "").split()) if (t or "").strip() else (t or "")[:1] and " " for t in TEXTS})
