"""Document statistics against plain loops; boosted trees: monotonic, vectorised as walked, right on held-out rows."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from featurespark.llm import quality, queries
from tests.llm.conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return (*n, len(words) < 10 or 100 * len(covered) > 20 * len(words))


def base_of(r):
    return tuple(r[c] for c in [*quality.BASE, "base_failed"])


def texts(seed=3):
    draw = random.Random(seed)
    some = [" ".join(draw.choice("a b c dd é".split()) for _ in range(draw.randrange(40))) for _ in range(40)]
    lined = ["\n".join(draw.choice(["x y", "z", " ", "", "x y ", "#*| <"]) for _ in range(9)) for _ in range(20)]
    return [*TEXTS, *some, *lined, "one two three four five " * 4, "w " * 60_000, "q\x0bq\x0cq\x85q\x1fq"]


def test_statistics(spark):
    model = quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0), np.array(list(quality.FEATURES.values())))
    rows = [(i if i != 4 else None, t, 1, "x") for i, t in enumerate(texts())] + [(0, "a repeated id", 1, "x")]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept string"), model).collect()
    assert sorted(map(repr, ((r.doc_id, *base_of(r)) for r in found))) == sorted(map(repr, ((d, *brute(t)) for d, t, *_ in rows)))
    assert all(r.kept == (not r.base_failed) for r in found)


def walk(model, row):
    total = model["bias"]
    for at in model["roots"]:
        while model["left"][at] != at:
            at = model["left"][at] if row[model["feature"][at]] <= model["threshold"][at] else model["right"][at]
        total += model["value"][at]
    return 1 / (1 + np.exp(-total))


def test_trees_are_monotonic_and_scored_as_walked():
    draw = np.random.default_rng(5)
    features = draw.normal(size=(1_500, 4))
    chance = 1 / (1 + np.exp(-(2 * features[:, 0] - 1.5 * features[:, 1] + np.sin(3 * features[:, 2]))))
    label = (draw.random(1_500) < chance).astype(float)
    signs = np.array([1, -1, 0, 1])
    model = quality.train(features[:1_000], label[:1_000], signs)
    found = quality.score(model, features)
    assert np.allclose(found[:50], [walk(model, r) for r in features[:50]])
    assert ((found[1_000:] > 0.5) == (label[1_000:] > 0.5)).mean() > 0.75
    steps = np.linspace(-4, 4, 80)
    for feature, sign in enumerate(signs):
        for row in features[:60]:
            line = np.tile(row, (len(steps), 1))
            line[:, feature] = steps
            assert not sign or (sign * np.diff(quality.score(model, line)) >= -1e-12).all()


def test_free_trees_would_not_be_monotonic():
    draw = np.random.default_rng(6)
    features = draw.normal(size=(800, 2))
    label = (np.abs(features[:, 0]) > 0.8).astype(float)
    steps = np.column_stack((np.linspace(-3, 3, 60), np.zeros(60)))
    free = quality.score(quality.train(features, label, np.array([0, 0])), steps)
    bound = quality.score(quality.train(features, label, np.array([1, 0])), steps)
    assert (np.diff(free) < 0).any() and (np.diff(bound) >= 0).all()


def test_labels_missing_or_of_one_kind(spark, documents):
    labels = "doc_id long, quality int, toxic int"
    for rows, keeps in (([], True), ([(5, 1, 0)], True), ([(7, 0, 0)], False), ([(None, 0, 0), (7, None, 0)], True)):
        found = quality.judge(documents, quality.fit(documents, spark.createDataFrame(rows, labels))).collect()
        assert len(found) == len(TEXTS) and all(r.kept == (keeps and not r.base_failed) for r in found)
    empty = documents.limit(0)
    assert quality.judge(empty, quality.fit(empty, spark.createDataFrame([], labels))).count() == 0


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.fit(documents, labels.filter(~held))
    rows = quality.judge(documents, model).join(labels.filter(held), "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    passed = [r for r in good if not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.99 * len(passed) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    texts_ = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.QUERIES["op12_boosted_quality_rules"](spark, folder).collect()
    assert len(found) == len(texts_) and all(base_of(r) == brute(texts_[r.doc_id]) for r in found)
    assert all(not (r.kept and r.base_failed) for r in found)
