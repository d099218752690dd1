"""Byte-pair merges of many words at once."""

from __future__ import annotations

import json

import numpy as np

#: Words merged at once.
BLOCK = 20_000

_NONE = np.int32(2**31 - 1)


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


class Merger:
    """Merges by rank: the pair of lowest rank first, the leftmost of equal ones."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary: dict[str, int] = model["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        signs = byte_signs()
        of_byte = {s: b for b, s in enumerate(signs)}
        self.byte_id = np.array([vocabulary[s] for s in signs], np.uint32)
        left = np.array([vocabulary[a] for a, _ in pairs], np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], np.uint64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.uint32)
        key = (left << np.uint64(32)) | right
        order = np.argsort(key, kind="stable")
        self._key, self._rank, self._made = key[order], order.astype(np.int32), made
        self.bytes_of = {i: bytes(of_byte[s] for s in token) for token, i in vocabulary.items()}
        for token in model["added_tokens"]:
            self.bytes_of[token["id"]] = token["content"].encode()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right
        at = np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)
        return np.where(self._key[at] == key, self._rank[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words in order, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        count = np.zeros(len(words), np.int64)
        order = np.argsort(size, kind="stable")
        done: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            longest = size[order[min(at + BLOCK, len(order)) - 1]]
            block = order[at : at + max(1, min(BLOCK, 4_000_000 // max(1, int(longest))))]
            at += len(block)
            width = max(1, int(size[block].max()))
            inside = np.arange(width) < size[block][:, None]
            spots = np.where(inside, begin[block][:, None] + np.arange(width), 0)
            symbols = self.byte_id[raw[spots]] if len(raw) else np.zeros(spots.shape, np.uint32)
            length = self._merge(symbols, size[block].copy())
            count[block] = length
            done.append((block, symbols[np.arange(width) < length[:, None]]))
        flat = np.zeros(int(count.sum()), np.uint32)
        first = np.cumsum(count) - count
        for block, ids in done:
            length = count[block]
            shift = np.repeat(first[block] - (np.cumsum(length) - length), length)
            flat[shift + np.arange(len(ids))] = ids
        return flat, count

    def _merge(self, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Merge the rows of `symbols` in place; returns their lengths."""
        width = symbols.shape[1]
        if width < 2:
            return length
        column = np.arange(width)
        ranks = self._ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(-1, width - 1)
        ranks[column[1:] >= length[:, None]] = _NONE
        rows = np.arange(len(symbols))
        work, left = symbols, ranks
        while len(rows):
            best = left.argmin(1)
            here = np.arange(len(rows))
            rank = left[here, best]
            open_ = rank != _NONE
            if not open_.all():
                symbols[rows[~open_]] = np.pad(work[~open_], ((0, 0), (0, width - work.shape[1])))
                rows, work, left, best, rank = rows[open_], work[open_], left[open_], best[open_], rank[open_]
                if not len(rows):
                    break
                here = np.arange(len(rows))
            work[here, best] = self._made[rank]
            moved = np.arange(work.shape[1] - 1) > best[:, None]
            work = np.where(moved, work[:, 1:], work[:, :-1])
            left = np.where(moved[:, : left.shape[1] - 1], left[:, 1:], left[:, :-1])
            length[rows] -= 1
            if not left.shape[1]:
                symbols[rows] = np.pad(work, ((0, 0), (0, width - work.shape[1])))
                break
            for shift in (-1, 0):
                spot = best + shift
                fits = (spot >= 0) & (spot + 1 < length[rows])
                row, col = here[fits], spot[fits]
                left[row, col] = self._ranks(work[row, col], work[row, col + 1])
            gone = (best + 1 >= length[rows]) & (best < left.shape[1])
            left[here[gone], best[gone]] = _NONE
        return length
