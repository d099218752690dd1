"""Byte-level tokenizer words: cutting texts into words with numpy and encoding each distinct word once."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain
from operator import attrgetter

import numpy as np
import pandas as pd

from featurespark.llm.common import starts, take_runs
from featurespark.llm.merges import byte_signs

LETTER, NUMBER, OTHER, BLANK, END, UNKNOWN = 0, 1, 2, 3, 4, 255

#: Codes beyond Unicode: the end of a text, an added token, the rest of an added token.
TEXT_END, ADDED, SKIPPED = 0x110000, 0x110001, 0x110002

#: The sign that stands for each byte; the last byte is in no text.
_SIGNS = np.array([ord(s) for s in byte_signs()], "<u4")

#: Becomes the last byte where words are joined, and the sign of that byte.
_BETWEEN, _BETWEEN_SIGN = "\udcff", byte_signs()[-1]

#: Words that the library's model gets at once.
JOINED = 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Spread digests over the places where a word may stand: the first one, and the way from each to the next.
_SPREAD = np.array([[0xBF58476D1CE4E5B9], [0x94D049BB133111EB]], np.uint64)

#: Words that the memory of one worker holds before it forgets, and codes of a word on the average.
MEMO_WORDS, MEMO_CODES = 300_000, 32


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Words:
    """The words of some texts: where each distinct one stands, and for each word in order its number and its text.

    Number -1 stands for the added token.
    """

    def __init__(self, joined: str, codes: np.ndarray, *arrays: np.ndarray) -> None:
        self.joined, self.codes = joined, codes
        self.begin, self.size, self.digest, self.number, self.text = arrays

    def strings(self, which: np.ndarray) -> list[str]:
        spots = zip(self.begin[which].tolist(), self.size[which].tolist(), strict=True)
        return [self.joined[b : b + n] for b, n in spots]


class Splitter:
    """Cuts texts where the byte-level pre-tokenizer cuts them.

    A word is a run of letters, of digits or of other signs with one leading space, an English contraction, or
    white space. The kind of each character is asked from the tokenizer itself when it is first met, so that both
    follow the same version of Unicode.
    """

    def __init__(self, tokenizer, added: str | None) -> None:
        self._ask = tokenizer.pre_tokenizer.pre_tokenize_str
        self._kinds = np.full(SKIPPED + 1, UNKNOWN, np.uint8)
        self._kinds[TEXT_END:] = END
        self._added = added
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        self._power = np.full(n, _BASE, np.uint64)
        self._inverse = np.full(n, _INVERSE, np.uint64)
        self._power[0] = self._inverse[0] = 1
        np.cumprod(self._power, out=self._power)
        np.cumprod(self._inverse, out=self._inverse)

    def _kind(self, code: int) -> int:
        sign = chr(code)
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self._ask(before + sign)) == 1:
                return kind
        return BLANK

    def split(self, texts: list[str]) -> Words:
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[ends] = TEXT_END
        if self._added and self._added in joined:
            for found in re.finditer(re.escape(self._added), joined):
                codes[found.start() : found.end()] = SKIPPED
                codes[found.start()] = ADDED
        kinds = self._kinds[codes]
        if (unknown := kinds == UNKNOWN).any():
            for code in np.unique(codes[unknown]).tolist():
                self._kinds[code] = self._kind(code)
            kinds = self._kinds[codes]
        first = np.flatnonzero(_word_starts(codes, kinds))
        code = codes[first]
        digest, number, lead = self.distinct(codes, first)
        begin, size = first[lead], np.append(first, len(codes))[lead + 1] - first[lead]
        ended = code == TEXT_END
        text = np.cumsum(ended) - ended
        number[code == ADDED] = -1
        kept = ~ended & (code != SKIPPED)
        return Words(joined, codes, begin, size, digest, number[kept], text[kept])

    def distinct(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Equal runs of codes, each from one of `first` to the next, get equal numbers: by a running hash, then compared
        code by code. Returns digest of each number, numbers, and a run of each number."""
        n = len(codes)
        if n > len(self._power):
            self._powers(2 * n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint32(1)) * self._power[:n], out=total[1:])
        length = np.diff(first, append=n)
        digest = (np.append(total[first[1:]], total[n]) - total[first]) * self._inverse[first]
        digest += length.astype(np.uint64)
        number, values = pd.factorize(digest)
        lead = _leads(number, len(values))
        model = lead[number]
        if (length != length[model]).any() or (take_runs(codes, first[model], length) != codes).any():
            pieces = [codes[b : b + n].tobytes() for b, n in zip(first.tolist(), length.tolist(), strict=True)]
            number, values = pd.factorize(np.array(pieces, object))
            lead = _leads(number, len(values))
        return digest[lead], number, lead


def _leads(number: np.ndarray, n: int) -> np.ndarray:
    """The first place of each number."""
    lead = np.empty(n, np.int64)
    lead[number[::-1]] = np.arange(len(number))[::-1]
    return lead


def _word_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    before = np.concatenate(([END], kinds[:-1])).astype(np.uint8)
    space = codes == 32
    after_space = np.concatenate(([False], space[:-1]))
    solid, blank = kinds <= OTHER, kinds == BLANK
    run = solid & (kinds != before)
    start = (kinds == END) | (run & ~after_space)
    start[np.flatnonzero(run & after_space) - 1] = True
    start |= blank & ((before != BLANK) | np.concatenate((solid[1:], [False])))
    quote = np.flatnonzero((codes == 39) & (before != OTHER) & ~after_space)
    quote = quote[quote + 2 < len(codes)] if len(quote) else quote
    if len(quote):
        one, two = codes[quote + 1], codes[quote + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    return start


class Growing:
    """An array that is added to at its end, with room to spare, so that adding does not copy what is there."""

    def __init__(self, kind: type) -> None:
        self._room, self._size = np.zeros(1 << 10, kind), 0

    def __len__(self) -> int:
        return self._size

    def add(self, more: np.ndarray) -> None:
        size = self._size + len(more)
        if size > len(self._room):
            room = np.empty(max(size, 2 * len(self._room)), self._room.dtype)
            room[: self._size] = self.all
            self._room = room
        self._room[self._size : size] = more
        self._size = size

    @property
    def all(self) -> np.ndarray:
        return self._room[: self._size]


class WordIds:
    """Ids of words, each encoded when first met; holds a bounded number of words.

    A full memory keeps the words that were met again since the last time, if these are less than half, else nothing.
    Words are found by their digest, in a table of which half is free at least, and compared sign by sign with the word
    held under it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MEMO_WORDS) -> None:
        self._encode, self._most = encode, most
        self._clear()

    def _clear(self) -> None:
        self._digest = Growing(np.uint64)
        self._make_table(self._most)
        self._begin, self._length = Growing(np.int64), Growing(np.int64)
        self._from, self._size = Growing(np.int64), Growing(np.int64)
        self._ids, self._codes = Growing(np.uint32), Growing(np.uint32)
        self._again = Growing(np.bool_)

    def _forget(self) -> None:
        kept = np.flatnonzero(self._again.all)
        digest, length, size = self._digest.all[kept], self._length.all[kept], self._size.all[kept]
        ids = take_runs(self._ids.all, self._begin.all[kept], length)
        codes = take_runs(self._codes.all, self._from.all[kept], size)
        self._clear()
        if 2 * len(kept) > self._most or 2 * len(codes) > MEMO_CODES * self._most:
            return
        self._hold(digest, ids, length, codes, size)

    def _make_table(self, words: int) -> None:
        bits = (2 * words).bit_length()
        self._table, self._shift = np.full(1 << bits, -1, np.int32), np.uint64(64 - bits)
        self._enter(0)

    def _places(self, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each digest in the table, and the step to the next."""
        place, step = ((digest * _SPREAD) >> self._shift).view(np.int64)
        return place, step | 1

    def _enter(self, begin: int) -> None:
        """Put the words held from `begin` on into the table."""
        slot = np.arange(begin, len(self._digest), dtype=np.int32)
        place, step = self._places(self._digest.all[begin:])
        while len(slot):
            free = np.flatnonzero(self._table.take(place) < 0)
            self._table[place[free]] = slot[free]
            left = np.flatnonzero(self._table.take(place) != slot)
            slot, step = slot[left], step[left]
            place = (place[left] + step) & (len(self._table) - 1)

    def _find(self, digest: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where words of these digests and sizes are held, or -1."""
        found, left = np.full(len(digest), -1, np.int64), np.arange(len(digest))
        place, step = self._places(digest)
        while len(left):
            slot = self._table.take(place)
            taken = np.flatnonzero(slot >= 0)
            slot, left, place, step = slot[taken], left[taken], place[taken], step[taken]
            same = (self._digest.all.take(slot) == digest[left]) & (self._size.all.take(slot) == size[left])
            found[left[same]] = slot[same]
            other = np.flatnonzero(~same)
            left, step = left[other], step[other]
            place = (place[other] + step) & (len(self._table) - 1)
        return found

    def _hold(
        self, digest: np.ndarray, ids: np.ndarray, length: np.ndarray, codes: np.ndarray, size: np.ndarray
    ) -> np.ndarray:
        """Where the words are held from now on."""
        slot = np.arange(len(digest)) + len(self._digest)
        self._digest.add(digest)
        self._begin.add(starts(length) + len(self._ids))
        self._from.add(starts(size) + len(self._codes))
        self._length.add(length)
        self._size.add(size)
        self._ids.add(ids)
        self._codes.add(codes)
        self._again.add(np.zeros(len(size), bool))
        if 2 * len(self._digest) > len(self._table):
            self._make_table(2 * len(self._digest))
        else:
            self._enter(len(self._digest) - len(digest))
        return slot

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and begin and length in them of each distinct word."""
        if len(self._digest) > self._most or len(self._codes) > MEMO_CODES * self._most:
            self._forget()
        size = words.size
        slot = self._find(words.digest, size)
        known = slot >= 0
        same = take_runs(words.codes, words.begin[known], size[known]) == take_runs(
            self._codes.all, self._from.all[slot[known]], size[known]
        )
        if not same.all():
            known[np.flatnonzero(known)[np.repeat(np.arange(known.sum()), size[known])[~same]]] = False
        self._again.all[slot[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            flat, length = self._encode(words.strings(new))
            codes = take_runs(words.codes, words.begin[new], size[new])
            slot[new] = self._hold(words.digest[new], flat, length, codes, size[new])
        length = self._length.all[slot]
        return take_runs(self._ids.all, self._begin.all[slot], length), starts(length), length


class TextEncoder:
    """Ids of whole texts: words by `Splitter`, ids of each distinct word by `encode_words`.

    With `plain` the strings of added tokens are ordinary text.
    """

    def __init__(
        self, path: str, encode_words: Callable | None = None, most: int = MEMO_WORDS, plain: bool = False
    ) -> None:
        self.tokenizer = load_tokenizer(path)
        self.tokenizer.encode_special_tokens = plain
        if hasattr(self.tokenizer.model, "_resize_cache"):
            # The library would keep 10,000 of the joined strings of `_library`, about 60 MB, though hardly one comes twice.
            self.tokenizer.model._resize_cache(0)
        added = {} if plain else self.tokenizer.get_added_tokens_decoder()
        if len(added) > 1:
            raise ValueError("tokenizers with several added tokens are not handled")
        self.added_id, self.added = next(((k, v.content) for k, v in added.items()), (0, None))
        self.splitter = Splitter(self.tokenizer, self.added)
        self._between = None if encode_words else self._sign_between()
        self.words = WordIds(encode_words or self._library, most)

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words are cut already, so the library's model gets them in its byte signs."""
        raw = np.frombuffer(_BETWEEN.join(words).encode(errors="surrogateescape"), np.uint8)
        signs = _SIGNS.take(raw).tobytes().decode("utf-32-le").split(_BETWEEN_SIGN)
        cut, number = self.tokenizer.model.tokenize, attrgetter("id")
        if self._between is None:
            tokens = list(map(cut, signs))
            length = np.fromiter(map(len, tokens), np.int64, len(tokens))
            return np.fromiter(map(number, chain.from_iterable(tokens)), np.uint32, int(length.sum())), length
        # Each call has a cost of its own, so some words go together, each with the sign after it.
        joined = [_BETWEEN_SIGN.join([*signs[i : i + JOINED], ""]) for i in range(0, len(signs), JOINED)]
        ids = np.fromiter(map(number, chain.from_iterable(map(cut, joined))), np.uint32)
        ends = ids == self._between
        return ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1

    def _sign_between(self) -> int | None:
        """The id of the sign that stands for the byte of no text, when the model never merges it with another."""
        model, found = self.tokenizer.model, [t for t in self.tokenizer.get_vocab() if _BETWEEN_SIGN in t]
        plain = type(model).__name__ == "BPE" and not (
            model.ignore_merges or model.dropout or model.unk_token or model.byte_fallback
            or model.continuing_subword_prefix or model.end_of_word_suffix
        )
        return model.token_to_id(_BETWEEN_SIGN) if plain and found == [_BETWEEN_SIGN] else None

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many belong to each text; `end_id` is added to each text."""
        words = self.splitter.split(texts)
        flat, begin, length = self.words.of(words)
        known = len(begin)
        extra = [self.added_id] if end_id is None else [self.added_id, end_id]
        begin = np.append(begin, np.arange(len(extra)) + len(flat))
        length = np.append(length, np.ones(len(extra), np.int64))
        flat = np.append(flat, np.array(extra, np.uint32))
        number = np.where(words.number < 0, known, words.number)
        if end_id is not None:
            at = np.searchsorted(words.text, np.arange(len(texts)), "right")
            number = np.insert(number, at, len(begin) - 1)
            text = np.insert(words.text, at, np.arange(len(texts)))
        else:
            text = words.text
        size = length[number]
        count = np.bincount(text, size, len(texts)).astype(np.int64)
        return take_runs(flat, begin[number], size), count
