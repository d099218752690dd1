"""Quality of whole texts: fixed rules on document statistics, then boosted trees that learned from labels."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import column_slices, once_per_worker

#: Labelled documents that the trees learn from at most, the first by a hash of their id.
TRAIN_DOCUMENTS = 8_000

#: Fixed values of the rules: signs that count as symbols, white space between words, words of a window, least words,
#: and the greatest part (in hundredths) of words in repeated windows.
SYMBOLS, WHITE_SPACE, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", " \t\n\v\f\r", 5, 10, 20

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: What the trees see, and how the verdict may depend on it: 1 never falls when the value grows, -1 never rises, 0 free.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "repeated_lines": -1,
    "repeated_words": -1,
    "distinct_words": 1,
    "commonest_word": -1,
    "upper_letters": -1,
    "digits": 0,
    "closing_signs": 0,
    "other_signs": -1,
    "exclamations": -1,
    "words_per_line": 0,
    "longest_word": 0,
}

#: Shape of the trees.
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, SHRINK = 60, 4, 0.2, 48, 2.0, 1.0

#: Documents whose probability of being good is lower are not kept.
LEAST_SCORE = 0.5

_UPPER, _LOWER, _DIGIT, _CLOSING, _OTHER, _SHOUT = range(1, 7)
_KIND = np.zeros(256, np.uint8)
for _kind, _signs in (
    (_OTHER, bytes(range(33, 127))), (_UPPER, bytes(range(65, 91))), (_LOWER, bytes([*range(97, 123), *range(128, 256)])),
    (_DIGIT, b"0123456789"), (_CLOSING, b".,;:?"), (_SHOUT, b"!"),
):
    _KIND[np.frombuffer(_signs, np.uint8)] = _kind


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of `values`, `size` long each."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    end = np.cumsum(size)
    return total[end] - total[end - size]


def _repeated(codes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Words per text that lie in a window of WINDOW words found twice or more in the text."""
    last = len(codes) - WINDOW + 1
    if last < 1:
        return np.zeros(n, np.int64)
    inside = text[:last] == text[WINDOW - 1 :]
    gram = codes[:last]
    for i in range(1, WINDOW):
        following = codes[i : last + i]
        gram = pd.factorize(gram * (int(codes.max()) + 1) + following)[0]
    begin = np.flatnonzero(inside)
    number, names = pd.factorize(text[begin] * (int(gram.max()) + 1) + gram[begin])
    again = begin[np.bincount(number, minlength=len(names))[number] > 1]
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return np.bincount(text, np.cumsum(change[:-1]) > 0, n).astype(np.int64)


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of BASE and the values of FEATURES, one row per text, over whole texts."""
    n = len(texts)
    raw = [t.encode() for t in texts]
    words = [r.split() for r in raw]
    count = np.array([len(w) for w in words], np.int64)
    flat = [w for part in words for w in part]
    text = np.repeat(np.arange(n), count)
    codes, names = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
    repeated = _repeated(codes, text, n)
    chars = np.array([len(t) - sum(map(t.count, WHITE_SPACE)) for t in texts], np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    lines = [[x for x in t.split("\n") if x.strip(WHITE_SPACE)] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    dup_lines = n_lines - np.array([len(set(x)) for x in lines], np.int64)
    base = np.column_stack((count, chars, symbols, dup_lines, repeated)).reshape(n, len(BASE))

    pair, kinds = pd.factorize(text * (len(names) + 1) + codes)
    often = np.bincount(pair, minlength=len(kinds))
    owner = np.asarray(kinds, np.int64) // (len(names) + 1)
    distinct, commonest = np.bincount(owner, minlength=n), np.zeros(n, np.int64)
    np.maximum.at(commonest, owner, often)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, np.array([len(w) for w in flat], np.int64))
    size = np.array([len(r) for r in raw], np.int64)
    kind = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    of = {k: _sums(kind == k, size) for k in (_UPPER, _LOWER, _DIGIT, _CLOSING, _OTHER, _SHOUT)}
    some = np.maximum(count, 1)
    signs = np.maximum(sum(of.values()), 1)
    features = np.column_stack((
        np.log1p(count), chars / some, symbols / some, dup_lines / np.maximum(n_lines, 1), repeated / some,
        distinct / some, commonest / some, of[_UPPER] / np.maximum(of[_UPPER] + of[_LOWER], 1), of[_DIGIT] / signs,
        of[_CLOSING] / some, of[_OTHER] / some, of[_SHOUT] / some, count / np.maximum(n_lines, 1), np.log1p(longest),
    ))
    return base, features.reshape(n, len(FEATURES))


class Trees:
    """Boosted trees as flat arrays of nodes; a leaf points to itself."""

    def __init__(self) -> None:
        self.feature, self.threshold, self.left, self.right, self.value = ([] for _ in range(5))
        self.roots: list[int] = []
        self.bias = 0.0

    def node(self, value: float) -> int:
        at = len(self.feature)
        for column, item in ((self.feature, 0), (self.threshold, np.inf), (self.left, at), (self.right, at), (self.value, value)):
            column.append(item)
        return at

    def arrays(self) -> dict:
        kinds = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "value": np.float64, "roots": np.int32}
        return {name: np.array(getattr(self, name), kind) for name, kind in kinds.items()} | {"bias": self.bias}


def score(model: dict, features: np.ndarray) -> np.ndarray:
    """Probability of a good document: every row goes down all trees at once, level by level."""
    total = np.full(len(features), model["bias"])
    if len(model["roots"]):
        node = np.tile(model["roots"], (len(features), 1))
        row = np.arange(len(features))[:, None]
        for _ in range(DEPTH):
            down = features[row, model["feature"][node]] <= model["threshold"][node]
            node = np.where(down, model["left"][node], model["right"][node])
        total += model["value"][node].sum(1)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _grow(trees: Trees, binned: np.ndarray, edges: list[np.ndarray], signs: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> int:
    """One tree on slopes and curvatures of the loss.

    The values that a node may take lie between bounds. A split on a constrained feature must order its two values,
    and their middle bounds what may follow on either side, so that the whole tree is monotonic.
    """
    width = max(len(e) for e in edges) + 1

    def value(g: np.ndarray, h: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip(-g / (h + SHRINK), low, high)

    def gain(g: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        return -(2 * g * v + (h + SHRINK) * v * v)

    root = trees.node(0.0)
    waiting = [(root, np.arange(len(binned)), -np.inf, np.inf, 0)]
    while waiting:
        at, rows, low, high, level = waiting.pop()
        g, h = slope[rows].sum(), bend[rows].sum()
        own = value(g, h, low, high)
        trees.value[at] = RATE * float(own)
        if level == DEPTH or len(rows) < 2:
            continue
        cell = (binned[rows] + np.arange(binned.shape[1]) * width).ravel()
        shape = (binned.shape[1], width)
        size = shape[0] * width
        left_g = np.bincount(cell, np.repeat(slope[rows], shape[0]), size).reshape(shape).cumsum(1)[:, :-1]
        left_h = np.bincount(cell, np.repeat(bend[rows], shape[0]), size).reshape(shape).cumsum(1)[:, :-1]
        left, right = value(left_g, left_h, low, high), value(g - left_g, h - left_h, low, high)
        better = gain(left_g, left_h, left) + gain(g - left_g, h - left_h, right) - gain(g, h, own)
        fits = (left_h >= LEAST_WEIGHT) & (h - left_h >= LEAST_WEIGHT) & (signs[:, None] * (right - left) >= 0)
        fits &= np.arange(width - 1) < np.array([len(e) for e in edges])[:, None]
        better = np.where(fits, better, -np.inf)
        feature, cut = np.unravel_index(int(better.argmax()), better.shape)
        if not better[feature, cut] > 1e-6:
            continue
        middle, down = (left[feature, cut] + right[feature, cut]) / 2, binned[rows, feature] <= cut
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}
        one, two = bounds[int(signs[feature])]
        trees.feature[at], trees.threshold[at] = int(feature), float(edges[feature][cut])
        trees.left[at], trees.right[at] = trees.node(0.0), trees.node(0.0)
        waiting += [(trees.left[at], rows[down], *one, level + 1), (trees.right[at], rows[~down], *two, level + 1)]
    return root


def train(features: np.ndarray, label: np.ndarray, signs: np.ndarray) -> dict:
    """Boosted trees for the logistic loss; thresholds are quantiles of the values. One class alone gives no trees."""
    trees = Trees()
    share = float(np.clip(label.mean() if len(label) else 1.0, 0.001, 0.999))
    trees.bias = float(np.log(share / (1 - share)))
    if 0 < label.sum() < len(label):
        points = np.linspace(0, 1, BINS + 1)[1:-1]
        edges = [np.unique(np.quantile(column, points)) for column in features.T]
        binned = np.column_stack([np.searchsorted(e, column) for e, column in zip(edges, features.T, strict=True)])
        total = np.full(len(label), trees.bias)
        for _ in range(TREES):
            chance = 1 / (1 + np.exp(-total))
            trees.roots.append(_grow(trees, binned, edges, signs, chance - label, chance * (1 - chance)))
            alone = trees.arrays() | {"roots": np.array(trees.roots[-1:], np.int32), "bias": 0.0}
            chance = score(alone, features)
            total += np.log(chance / (1 - chance))
    return trees.arrays()


def fit(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> dict:
    """Trees learned from `quality` of at most `most` labelled documents; statistics are taken in tasks.

    Of several labels of one document the lowest counts; rows without an id or a quality teach nothing. Without
    labels, or with one kind only, there are no trees and the verdict is that kind (keep, if nothing is known).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in column_slices(batches):
            raw = [row.tobytes() for row in statistics(texts)[1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["good", "features"])

    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", (F.col("q") > 0).cast("int").alias("good"))
    rows = documents.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("good", "text")
    found = sorted((r.good, bytes(r.features)) for r in rows.mapInArrow(task, "good int, features binary").collect())
    features = np.frombuffer(b"".join(f for _, f in found), np.float64).reshape(-1, len(FEATURES))
    return train(features, np.array([g for g, _ in found], np.float64), np.array(list(FEATURES.values())))


def _model(name: str, packed: object) -> dict:
    return packed.value


def judge(documents: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, the numbers of BASE, base_failed, `score` and kept.

    A document fails the rules with fewer than LEAST_WORDS words or more than MOST_REPEATED hundredths of its words in
    repeated windows; others are kept when the trees give them LEAST_SCORE. Null texts have no words. Ids may be null
    or repeated, each row is judged by itself, other columns are not read, an empty table gives no rows.
    """
    packed, name = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = once_per_worker("quality", _model, name, using=(packed,))
        for batch, texts in column_slices(batches):
            base, features = statistics(texts)
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            good = score(held, features)
            columns = [*base.T, failed, good, ~failed & (good >= LEAST_SCORE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns)],
                ["doc_id", *BASE, "base_failed", "score", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, schema)
