"""Language of whole texts: a byte network labels every position, a document pools its positions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurespark.llm.common import column_slices, filtered, once_per_worker
from featurespark.llm.gru import LONGEST, Network, pad

#: Bounds of what the network learns from: documents of each language, and words of each document.
TRAIN_DOCUMENTS, TRAIN_WORDS = 300, 80

EPOCHS = 3

#: Words whose sums a worker remembers.
MEMO_WORDS = 400_000

#: The label of texts without a letter.
UNDETERMINED = "und"

#: Below this probability no language is believed, whatever the number of languages.
LEAST_SCORE = 0.35


def _pieces(word: str) -> list[bytes]:
    """A word with a space before and behind, in sequences that the network takes."""
    raw = f" {word} ".encode()
    return [raw[i : i + LONGEST] for i in range(0, len(raw), LONGEST)]


class Labeller:
    """Pooled label probabilities of texts; what the positions of a word give is computed once and remembered."""

    def __init__(self, network: Network, labels: int) -> None:
        self._network, self._labels = network, labels
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._sums = np.zeros((0, self._labels + 1), np.float64)

    def _learn(self, words: list[str]) -> None:
        """Add the sums of probabilities over the positions of new words, and how many positions they have."""
        lettered = [i for i, w in enumerate(words) if any(map(str.isalpha, w))]
        parts = [(i, p) for i in lettered for p in _pieces(words[i])]
        parts.sort(key=lambda x: len(x[1]))
        sums = np.zeros((len(words), self._labels + 1), np.float64)
        for begin in range(0, len(parts), 4_096):
            block = parts[begin : begin + 4_096]
            table, there = pad([p for _, p in block])
            found = self._network.probabilities(table, there).sum(1)
            np.add.at(sums, [i for i, _ in block], np.column_stack((found, there.sum(1))))
        self._number |= {w: len(self._sums) + i for i, w in enumerate(words)}
        self._sums = np.concatenate((self._sums, sums))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The mean probabilities of each text, and whether it has a letter."""
        if len(self._number) > MEMO_WORDS:
            self._clear()
        words = [t.lower().split() for t in texts]
        new = {w for w in chain.from_iterable(words) if w not in self._number}
        if new:
            self._learn(sorted(new))
        count = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self._number.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
        total = np.zeros((len(texts), self._labels + 1))
        filled = np.flatnonzero(count)
        if len(filled):
            total[filled] = np.add.reduceat(self._sums[at], (np.cumsum(count) - count)[filled])
        positions = total[:, -1]
        return total[:, :-1] / np.maximum(positions, 1)[:, None], positions > 0


def training_words(labelled: DataFrame, documents: int = TRAIN_DOCUMENTS, words: int = TRAIN_WORDS) -> list[tuple[str, str]]:
    """(language, word) from a bounded number of documents per language and words per document.

    Documents are taken in the order of a hash of their id, first within 64 slots of a language, so that a frequent
    language does not meet in one task; words at even steps through the whole text, long ones in parts of LONGEST signs
    that are drawn like words.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in column_slices(batches):
            found = []
            for text in texts:
                parts = (w[i : i + LONGEST] for w in text.lower().split() for i in range(0, len(w), LONGEST))
                all_ = [p for p in parts if any(map(str.isalpha, p))]
                picked = [all_[i * len(all_) // words] for i in range(words)] if len(all_) > words else all_
                found.append(" ".join(picked))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["lang", "words"])

    digest = F.xxhash64("doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("slot", F.pmod(digest, F.lit(64)))
    for keys in (["lang", "slot"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(digest, "doc_id")
        ids = ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= documents)
    chosen = F.broadcast(ids.select("doc_id", "lang"))
    rows = labelled.join(chosen, ["doc_id", "lang"], "left_semi").select("lang", "text")
    found = rows.mapInArrow(task, "lang string, words string").collect()
    return sorted((r.lang, w) for r in found for w in r.words.split())


def fit(labelled: DataFrame, epochs: int = EPOCHS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and network weights learned from the rows of `labelled` that have a language and an id."""
    pairs = training_words(labelled.filter("lang is not null and doc_id is not null"))
    languages = sorted({lang for lang, _ in pairs})
    network = Network(max(1, len(languages)))
    parts = [(languages.index(lang), p) for lang, w in pairs for p in _pieces(w)]
    network.train([p for _, p in parts], np.array([n for n, _ in parts], np.int64), epochs)
    return languages, network.weights


def _labeller(name: str, weights: object) -> Labeller:
    held = weights.value
    network = Network(held["out"].shape[1])
    network.weights = held
    return Labeller(network, held["out"].shape[1])


def _predicting(documents: DataFrame, languages: list[str], weights: dict[str, np.ndarray]) -> Callable:
    """A function for tasks that gives the labels and scores of texts."""
    packed, name = documents.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex

    def predicted(texts: list[str]) -> tuple[list[str], np.ndarray]:
        labeller = once_per_worker("language", _labeller, name, using=(packed,))
        mean, lettered = labeller(texts)
        known = lettered & (len(languages) > 0)
        best = mean.argmax(1)
        label = [languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return label, np.where(known, np.minimum(mean.max(1), 1.0), 0.0)

    return predicted


def predict(documents: DataFrame, languages: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, `lang_pred` and `score`, the pooled probability of that language, for every whole text.

    Texts without a letter, null texts, and all texts when nothing was learned are `und` with score 0. Of equally
    probable languages the first by name is taken. Ids may be null or repeated; other columns are not read.
    """
    predicted = _predicting(documents, languages, weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in column_slices(batches):
            label, score = predicted(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        task, "doc_id long, lang_pred string, score double"
    )


def keep_known(documents: DataFrame, trusted: Column) -> DataFrame:
    """The documents whose language is told with LEAST_SCORE at least, learned from the `trusted` rows.

    All columns are kept, whatever their names. Null and empty texts and texts without a letter have no language and
    go; repeated rows are judged each by itself, rows with a null id as well; an empty table stays empty. When nothing
    can be learned no language is known, and all rows go. Each row is judged where it is read.
    """
    predicted = _predicting(documents, *fit(documents.filter(trusted)))

    def keeps(texts: list[str]) -> np.ndarray:
        label, score = predicted(texts)
        return np.array([x != UNDETERMINED for x in label], bool) & (score >= LEAST_SCORE)

    return filtered(documents, keeps)
