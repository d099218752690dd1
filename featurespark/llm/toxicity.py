"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import column_slices, filtered, once_per_worker

#: Labelled documents that voters, label model and classifier are fitted on, the first by a hash of their id.
TRAIN_DOCUMENTS = 6_000

#: Voters that the lexicon may have; each is a word or the beginning of words.
MOST_VOTERS = 400

#: A voter's part of toxic documents, counted with so many more documents that are none, must be so large.
LEAST_PRECISION, CAUTION = 0.8, 1

#: The part of the toxic documents in which a voter must occur.
LEAST_COVER = 0.01

#: Chi-square of a feature against the posterior labels from which on the classifier has a weight for it.
LEAST_CHI_SQUARE = 30

#: Letters of the beginnings of words that are looked at besides whole words.
BEGINNINGS = (4, 5, 6)

#: Words whose features a worker remembers.
MEMO_WORDS = 400_000

_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

#: Plain insults, voters whether or not the labels show them.
INSULTS = (
    "bastard clown creep cretin degenerate disgusting dumb filth freak garbage idiot imbecile jerk loser lowlife moron "
    "parasite pathetic pig retard scum scumbag sleazy stupid trash vermin vile worthless"
).split()

#: Votes that look at the whole text instead of its words.
PATTERNS = {
    "shouting": re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{3,}\b){2,}"),
    "exclamations": re.compile(r"!{2,}"),
    "masked word": re.compile(r"\b\w[*#@$]{2,}\w*\b"),
    "stretched word": re.compile(r"(\w)\1{3,}"),
}


def features_of(word: bytes) -> list[int]:
    """The word itself and its beginnings, as hashes."""
    text = word.decode("utf-8", "replace")
    found = [xxhash.xxh3_64_intdigest(b"=" + word)]
    found += [xxhash.xxh3_64_intdigest(b"^" + text[:n].encode()) for n in BEGINNINGS if len(text) > n]
    return found


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_TO_SPACE).split())


def patterns_of(text: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(b"~" + k.encode()) for k, p in PATTERNS.items() if p.search(text)]


def _sample(documents: DataFrame, labels: DataFrame, trusted: Column, most: int) -> list[tuple[np.ndarray, int]]:
    """Features and label of the first labelled documents by a hash of their id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in column_slices(batches):
            raw = []
            for text in texts:
                found = {f for w in words_of(text) for f in features_of(w)} | set(patterns_of(text))
                raw.append(np.array(sorted(found), np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["toxic", "features"])

    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(trusted)
    first = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("toxic", "text")
    found = rows.mapInArrow(task, "toxic int, features binary").collect()
    return sorted(((np.frombuffer(r.features, np.uint64), int(r.toxic > 0)) for r in found), key=lambda x: x[0].tobytes())


class LabelModel:
    """Accuracies of voters that fire or stay silent, by expectation-maximisation over their votes.

    A voter fires with one probability in toxic documents and another in clean ones; what firing tells is their
    ratio. That no voter fires is one more vote, for clean. Votes that go together in clean documents are no
    independent evidence: from the residual correlations there each voter gets a weight, one over one plus its positive correlations with the others, and the estimation
    goes on with these weights. How often a voter fired for trusted labels counts as much in it as the estimate
    itself, so that the two classes keep their meaning.
    """

    def __init__(self, rounds: int = 6) -> None:
        self._rounds = rounds

    def fit(self, votes: np.ndarray, label: np.ndarray) -> LabelModel:
        """`votes` has a row per document and a column per voter; trusted labels say how often voters were right."""
        votes = self._with_silence(votes)
        seen = np.stack((1 - label, label)) @ votes
        size = np.array([(1 - label).sum(), label.sum()])[:, None]
        self.prior, self.weight = float(np.clip(label.mean(), 0.01, 0.99)), np.ones(votes.shape[1])
        share = 1 - np.exp(votes @ np.log1p(-np.clip(seen[1] / (seen.sum(0) + CAUTION), 0, 0.99)))
        for again in range(2):
            for _ in range(self._rounds):
                classes = np.stack((1 - share, share))
                self.fires = (classes @ votes + seen + 0.05) / (classes.sum(1)[:, None] + size + 1)
                share = self._share(votes)
            if not again:
                self.correlation = self._residual(votes, share)
                self.weight = 1 / (1 + np.where(self.correlation > 0.1, self.correlation, 0).sum(1))
        return self

    @staticmethod
    def _with_silence(votes: np.ndarray) -> np.ndarray:
        return np.column_stack((votes, ~votes.any(1)))

    def _share(self, votes: np.ndarray) -> np.ndarray:
        told = votes @ (np.log(self.fires[1] / self.fires[0]) * self.weight) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(told, -30, 30)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._share(self._with_silence(votes))

    def _residual(self, votes: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Correlations of the voters among clean documents, where votes that agree without a cause mislead."""
        rest = (votes - self.fires[0]) * np.sqrt(1 - share)[:, None]
        cover = rest.T @ rest
        spread = np.sqrt(np.diag(cover) + 0.5)
        found = cover / spread / spread[:, None]
        np.fill_diagonal(found, 0)
        return found


def _choose_voters(rows: np.ndarray, columns: np.ndarray, label: np.ndarray, width: int, most: int) -> np.ndarray:
    """Features whose documents are mostly labelled toxic, and mostly not covered by one better feature."""
    count, toxic = np.bincount(columns, minlength=width), np.bincount(columns, label[rows], width)
    surely = toxic / (count + CAUTION)
    likely = np.flatnonzero((surely >= LEAST_PRECISION) & (toxic >= LEAST_COVER * label.sum()))
    gain = toxic * surely
    likely = likely[np.argsort(-gain[likely], kind="stable")[: 3 * most]]
    place = np.full(width, -1)
    place[likely] = np.arange(len(likely))
    cast = place[columns] >= 0
    fired = np.zeros((len(likely), len(label)), np.float32)
    fired[place[columns[cast]], rows[cast]] = 1
    together = fired @ fired.T
    chosen: list[int] = []
    for i in range(len(likely)):
        if len(chosen) < most and (not chosen or together[i, chosen].max() < 0.7 * together[i, i]):
            chosen.append(i)
    return likely[chosen]


def _logistic(rows: np.ndarray, columns: np.ndarray, n: int, width: int, label: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights of present features by gradient steps with an own rate for each weight (Adam), slightly shrunk."""
    weight, bias = np.zeros(width), -2.0
    mean, square, mean_b, square_b = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weight[columns], n) + bias, -30, 30)))
        error = (score - label) / n
        grad = np.bincount(columns, error[rows], width) + 1e-4 * weight / np.sqrt(step)
        grad_b = error.sum()
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        mean_b += 0.1 * (grad_b - mean_b)
        square_b += 0.01 * (grad_b**2 - square_b)
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        weight -= 0.1 * fix * mean / (np.sqrt(square) + 1e-8)
        bias -= 0.1 * fix * mean_b / (np.sqrt(square_b) + 1e-8)
    return weight, float(bias)


def fit(documents: DataFrame, labels: DataFrame, trusted: Column, most: int = TRAIN_DOCUMENTS) -> dict:
    """Weights of the linear classifier: {"bias": b, "weights": {feature: weight}}.

    Only rows of `labels` that fulfil `trusted` are read for labels: they choose the lexicon of voters, state the part
    of toxic documents and anchor the label model. The classifier sees its posterior labels alone.
    """
    sample = _sample(documents, labels, trusted, most)
    if not sample or len({y for _, y in sample}) < 2:
        return {"bias": -2.0 if not sample or not sample[0][1] else 2.0, "weights": {}}
    label = np.array([y for _, y in sample])
    size = np.array([len(f) for f, _ in sample])
    columns, features = pd.factorize(np.concatenate([f for f, _ in sample]), sort=True)
    columns = columns.astype(np.int32)
    rows = np.repeat(np.arange(len(label), dtype=np.int32), size)
    sample.clear()
    voters = _choose_voters(rows, columns, label, len(features), MOST_VOTERS)
    fixed = [b"~" + k.encode() for k in PATTERNS] + [b"=" + w.encode() for w in INSULTS]
    stated = np.isin(features, np.array([xxhash.xxh3_64_intdigest(k) for k in fixed], np.uint64))
    voters = np.unique(np.concatenate((voters, np.flatnonzero(stated))))
    place = np.full(len(features), -1)
    place[voters] = np.arange(len(voters))
    cast = place[columns] >= 0
    votes = np.zeros((len(label), len(voters)))
    votes[rows[cast], place[columns[cast]]] = 1
    share = LabelModel().fit(votes, label).posterior(votes)
    count, mass = np.bincount(columns, minlength=len(features)), np.bincount(columns, share[rows], len(features))
    expected = count * share.mean()
    used = (count >= 3) & ((mass - expected) ** 2 >= LEAST_CHI_SQUARE * expected * (1 - share.mean()))
    number = np.cumsum(used) - 1
    kept = used[columns]
    weight, bias = _logistic(rows[kept], number[columns[kept]], len(label), int(used.sum()), share)
    strong = np.abs(weight) > 0.02
    return {"bias": bias, "weights": dict(zip(features[used][strong].tolist(), weight[strong].tolist(), strict=True))}


class Scorer:
    """Scores of texts; the features of a word that have a weight are looked up once and remembered."""

    def __init__(self, name: str, model: object) -> None:
        held = model.value
        self._bias, self._weights = held["bias"], held["weights"]
        self._words: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self._words) > MEMO_WORDS:
            self._words.clear()
        known, weights, out = self._words, self._weights, []
        for text in texts:
            found: set[int] = set(patterns_of(text))
            for word in words_of(text):
                features = known.get(word)
                if features is None:
                    features = known[word] = tuple(f for f in features_of(word) if f in weights)
                if features:
                    found.update(features)
            out.append(self._bias + sum(weights.get(f, 0.0) for f in sorted(found)))
        return 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, `score` from 0 to 1 and `predicted` (1 from 0.5 on) for every whole text.

    Null and empty texts have no features and get the score of the classifier's constant. Ids may be null or
    repeated; other columns are not read.
    """
    packed, name = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once_per_worker("toxicity", Scorer, name, using=(packed,))
        for batch, texts in column_slices(batches):
            found = scorer(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, score double, predicted int")


def drop_toxic(documents: DataFrame, labels: DataFrame, trusted: Column) -> DataFrame:
    """The documents that the classifier, fitted on the `trusted` labels, does not call toxic.

    All columns are kept, whatever their names. Null and empty texts stay unless all trusted labels are toxic; repeated
    rows are judged each by itself, rows with a null id as well; an empty table stays empty. Each row is judged where it
    is read.
    """
    model = fit(documents, labels, trusted)
    packed, name = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    return filtered(documents, lambda texts: once_per_worker("toxicity", Scorer, name, using=(packed,))(texts) < 0.5)
