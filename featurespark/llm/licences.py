"""Licence notices in texts: Dice coefficient of word bigrams with templates, pruned by size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import column_slices

#: Notices of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Passages of licence texts and file headers that the notices above don't tell apart or don't reach; looked for as
#: passages only. Of licences whose passages overlap the one most alike counts.
PASSAGES = (
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("CC-BY-4.0", "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"),
)

#: Licences whose texts hold the whole text of another one, which isn't named beside them.
HOLDS = {"BSD-3-Clause": "BSD-2-Clause"}

#: Bigrams alike, in hundredths of the Dice coefficient.
LEAST_PERCENT = 80


_PLAIN = bytes(b if chr(b).isascii() and (chr(b).isalnum() or b == 10) else 32 for b in range(256))

#: Words whose bigrams are added at a time, until there are more than any template allows.
CHUNK = 256


def _lines(text: str) -> list[list[bytes]]:
    """The words of each line: ASCII lower case, all but letters and digits taken as space."""
    return [line.split() for line in text.encode().lower().translate(_PLAIN).split(b"\n")]


def _bigrams(words: list[bytes], most: int) -> set[tuple[bytes, bytes]]:
    """Distinct pairs of neighbouring words; a set larger than `most` may be incomplete."""
    found: set[tuple[bytes, bytes]] = set()
    for begin in range(0, len(words) - 1, CHUNK):
        part = words[begin : begin + CHUNK + 1]
        found.update(zip(part, part[1:], strict=False))
        if len(found) > most:
            break
    return found


class Scanner:
    """Compares units with templates whose size leaves enough in reach."""

    def __init__(
        self, templates: tuple[tuple[str, str], ...], percent: int, passages: tuple[tuple[str, str], ...] = ()
    ) -> None:
        self._percent = percent
        self._wanted = [(name, _bigrams([w for line in _lines(t) for w in line], 1 << 30)) for name, t in templates]
        sizes = [len(w) for _, w in self._wanted if w]
        self._most = max((n * (200 - percent) // percent for n in sizes), default=0)
        self._fits = {
            n: [(name, w) for name, w in self._wanted if (200 - percent) * min(n, len(w)) >= percent * max(n, len(w))]
            for n in range(1, self._most + 1)
        }
        self._sought = list({(n, frozenset(w)): None for n, w in self._wanted})
        for name, text in passages:
            self._sought.append((name, frozenset(_bigrams([w for line in _lines(text) for w in line], 1 << 30))))
        self._sought = [(name, wanted) for name, wanted in self._sought if wanted]
        self._known = frozenset().union(*(w for _, w in self._sought))

    def unit(self, words: list[bytes], found: dict[str, tuple[float, int]]) -> dict[str, float]:
        """Add what one line or text is most alike: coefficient and number of templates by licence. Its own ones.

        Versions of one licence have much in common, so only the licence of the best template counts; of equal ones all.
        """
        had, alike = _bigrams(words, self._most), []
        for name, wanted in self._fits.get(len(had), ()):
            common, both = len(had & wanted), len(had) + len(wanted)
            if 200 * common >= self._percent * both:
                alike.append((name, 2 * common / both))
        top = max((dice for _, dice in alike), default=0.0)
        names = {name: dice for name, dice in alike if dice == top}
        for name, dice in alike:
            if name in names:
                best, n = found.get(name, (0.0, 0))
                found[name] = max(best, dice), n + 1
        return names

    def _windows(self, words: list[bytes], hits: list[int], wanted: frozenset) -> Iterator[tuple[float, int, int]]:
        """(dice, begin, stop) of the best window of words from each of `hits`, where it is in reach.

        A best window begins and ends with bigrams of the template, and its first bigram doesn't come again in it:
        without such ends it had no fewer common bigrams. Windows from a place go on until its bigram comes again or
        there are more others than the template allows, so that at most one for each of its bigrams is open anywhere.
        """
        most = len(wanted) * (200 - self._percent) // self._percent
        for begin in hits:
            first, had, common, best = (words[begin], words[begin + 1]), set(), 0, None
            for end in range(begin, len(words) - 1):
                pair = words[end], words[end + 1]
                if pair in had:
                    if pair == first:
                        break
                    continue
                had.add(pair)
                if len(had) > most:
                    break
                if pair in wanted:
                    common += 1
                    both = len(had) + len(wanted)
                    if 200 * common >= self._percent * both and (best is None or 2 * common / both > best[0]):
                        best = 2 * common / both, begin, end + 2
            if best:
                yield best

    def passages(
        self, lines: list[list[bytes]], taken: list[dict[str, float]], found: dict[str, tuple[float, int]]
    ) -> None:
        """Add passages of the whole text; `taken` has the licences that each line matches, alone or in the whole text.

        Of passages that overlap only the most alike is looked at, and it counts unless one of its lines matches the
        same licence, or another one as well.
        """
        words = [w for line in lines for w in line]
        own = self._known.intersection(zip(words, islice(words, 1, None), strict=False))
        sought = [(n, w) for n, w in self._sought if (200 - self._percent) * len(own & w) >= self._percent * len(w)]
        if not sought:
            return
        places = [i for i, pair in enumerate(zip(words, islice(words, 1, None), strict=False)) if pair in own]
        candidates = []
        for name, wanted in sought:
            hits = [i for i in places if (words[i], words[i + 1]) in wanted]
            candidates += [(-dice, begin, stop, name) for dice, begin, stop in self._windows(words, hits, wanted)]
        if not candidates:
            return
        line_of = [i for i, line in enumerate(lines) for _ in line]
        used = bytearray(len(words))
        for low, begin, stop, name in sorted(candidates):
            if any(used[begin:stop]):
                continue
            used[begin:stop] = b"\1" * (stop - begin)
            across = (taken[i] for i in range(line_of[begin], line_of[stop - 1] + 1))
            if not any(name in t or max(t.values(), default=0) >= -low for t in across):
                best, n = found.get(name, (0.0, 0))
                found[name] = max(best, -low), n + 1

    def text(self, text: str) -> dict[str, tuple[float, int]]:
        found: dict[str, tuple[float, int]] = {}
        lines = _lines(text)
        taken = [self.unit(words, found) for words in lines]
        if len(lines) > 1:
            whole = self.unit([w for words in lines for w in words], found)
            taken = [names | whole for names in taken] if whole else taken
        self.passages(lines, taken, found)
        for name, held in HOLDS.items():
            if name in found:
                found.pop(held, None)
        return found


def scan_licences(
    documents: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    percent: int = LEAST_PERCENT,
    passages: tuple[tuple[str, str], ...] = PASSAGES,
) -> DataFrame:
    """(doc_id, license, dice, n_units): the licences whose notices stand in a document.

    Compared are every line and, if a text has several lines, the whole text; what no line and not the whole text
    matches is searched for passages of any words next to each other, over the ends of lines too, that are as much
    alike (see Scanner.passages). A text that begins and ends elsewhere than a notice thus still counts. The Dice coefficient is twice the
    common bigrams over all bigrams of both; as common ones are at most the smaller set, a unit is compared only with
    templates whose size leaves `percent` in reach, and its bigrams are counted only as far as any template goes. Of
    several licences that one unit is like, the most alike counts.
    `dice` is the best of a licence in a document, n_units counts its units and passages in reach. Null, empty and one-word texts
    match nothing; rows with equal ids count as one document, those without an id as well; other columns are not read; an
    empty table gives no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, percent, passages)
        for batch, texts in column_slices(batches):
            rows = [
                (key, name, dice, n)
                for key, text in zip(batch.column(0).to_pylist(), texts, strict=True)
                for name, (dice, n) in scanner.text(text).items()
            ]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "dice", "n_units"])

    schema = "doc_id long, license string, dice double, n_units long"
    found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, schema)
    return found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.sum("n_units").alias("n_units"))


def licence_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = LEAST_PERCENT) -> str:
    """Lines and whole texts over a view `documents`, for an engine with list functions; it knows no passages."""
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(templates))
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    words = f"string_split(trim(regexp_replace(translate(t, {upper}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pairs = "CASE WHEN len(w) < 2 THEN [] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return f"""
        WITH template AS (
            SELECT n, license, {pairs} AS wanted
            FROM (SELECT n, license, {words} AS w FROM (VALUES {values}) AS v(n, license, t))
        ),
        line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents),
        unit AS (
            SELECT row_number() OVER () AS u, * FROM (
                SELECT * FROM line
                UNION ALL
                SELECT doc_id, text FROM documents WHERE contains(text, chr(10)))
        ),
        had AS (SELECT u, doc_id, {pairs} AS had FROM (SELECT u, doc_id, {words} AS w FROM unit)),
        scored AS (
            SELECT u, doc_id, license, len(list_intersect(had, wanted)) AS c, len(had) + len(wanted) AS s
            FROM had JOIN template ON len(had) BETWEEN len(wanted) / 2 AND len(wanted) * 2 AND len(had) > 0
        ),
        alike AS (SELECT *, CAST(2 * c AS DOUBLE) / s AS dice FROM scored WHERE 200 * c >= {percent} * s),
        first AS (SELECT *, max(dice) OVER (PARTITION BY u, license) AS own, max(dice) OVER (PARTITION BY u) AS top FROM alike)
        SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units
        FROM first WHERE own = top GROUP BY doc_id, license
    """
