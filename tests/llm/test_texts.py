"""Copies, language, toxicity, licences, conversations and the pipeline against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featurespark.llm import chat, common, exact, language, licences, near, toxicity
from featurespark.llm.components import components
from featurespark.llm.gru import Network, pad
from featurespark.llm.near import shingles
from featurespark.llm.words import load_tokenizer
from tests.llm.conftest import TEXTS, TOKENIZER

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("round_bytes", [64 << 20, 1 << 17])
def test_exact_groups(spark, documents, monkeypatch, round_bytes):
    monkeypatch.setattr(exact, "ROUND_BYTES", round_bytes)
    monkeypatch.setattr(exact, "BITS_PER_DOCUMENT", 1 << 18)
    rows = {r.row: r for r in exact.exact_groups(documents).collect()}
    numbered = documents.withColumn("row", F.monotonically_increasing_id()).collect()
    assert len(rows) == len(numbered)
    for r in numbered:
        same = [o for o in numbered if normal(o.text) == normal(r.text)]
        lead = min(same, key=lambda o: (o.doc_id is None, o.doc_id or 0, o.row))
        found = rows[r.row]
        assert found.keep_id == lead.doc_id and found.group_size == len(same)
        assert found.kept == (r.row == lead.row)
        assert found.text_sha256 == hashlib.sha256(normal(r.text).encode()).hexdigest()
    kept = exact.drop_exact_copies(documents)
    assert kept.columns == documents.columns
    assert kept.count() == len({normal(t) for t in TEXTS})


def test_digests_are_read_a_fixed_number_of_times(spark, documents, monkeypatch):
    """However many rounds the filter takes, and nothing but the result is left behind."""
    monkeypatch.setattr(exact, "BITS_PER_DOCUMENT", 1 << 19)
    read = {}
    for round_bytes in (64 << 20, 1 << 18, 1 << 17):
        monkeypatch.setattr(exact, "ROUND_BYTES", round_bytes)
        seen = []
        plain = common.Scratch.table

        def watched(self, df, name, *folders):
            out = plain(self, df, name, *folders)
            seen.append((name, out.count()))
            return out

        monkeypatch.setattr(common.Scratch, "table", watched)
        read[round_bytes] = sorted(tuple(r) for r in exact.exact_groups(documents).select("row", "group_size", "kept").collect())
        monkeypatch.setattr(common.Scratch, "table", plain)
        assert dict(seen).get("dealt", len(TEXTS)) == len(TEXTS)
    assert len({str(rows) for rows in read.values()}) == 1


def dropping(spark):
    """The four dropping stages with a table of 100 rows on which each keeps the ids below 60."""
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(100)], "doc_id long, toxic int")
    words = "concat_ws(' ', 'own', id % 60, id % 60 + 1, 'word', id % 60, 'end')"
    return {
        "exact": (words, exact.drop_exact_copies),
        "near": (words, near.drop_near_copies),
        "language": ("if(id < 60, 'aka bako cado', '12 34')", lambda d: language.keep_known(d, F.lit(True))),
        "toxicity": ("if(id < 60, 'a kind word', 'you idiot scum')", lambda d: toxicity.drop_toxic(d, labels, F.lit(True))),
    }


SPLITS = "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"


@pytest.mark.parametrize("stage", ["exact", "near", "language", "toxicity"])
def test_stages_drop_the_right_rows_though_files_are_split_otherwise_later(spark, tmp_path, monkeypatch, stage):
    """Also on an input that is dealt out anew, with clashing column names, and whatever the plan reads of it."""
    monkeypatch.setattr(language, "EPOCHS", 40)
    text, drop = dropping(spark)[stage]
    rows = spark.range(0, 100, 1, 10).selectExpr("id AS doc_id", f"{text} AS text", "'aa' AS lang", "id AS _row", "id AS row", "'k' AS key")
    rows.write.parquet(str(tmp_path / "documents"))
    for dealt in (False, True):
        try:
            spark.conf.set(SPLITS[0], "128m")
            docs = spark.read.parquet(str(tmp_path / "documents"))
            docs = docs.repartition(4) if dealt else docs
            kept = drop(docs)
            spark.conf.set(SPLITS[0], "1")
            spark.conf.set(SPLITS[1], "1")
            assert kept.columns == docs.columns
            assert sorted((r.doc_id, r["_row"]) for r in kept.collect()) == [(i, i) for i in range(60)]
        finally:
            for name in SPLITS:
                spark.conf.unset(name)


def test_links_are_found_though_files_are_split_otherwise_later(spark, tmp_path, monkeypatch):
    """The split settings change after the first table that the operator writes."""
    rows = spark.range(0, 90, 1, 9).selectExpr(
        "id AS doc_id", "concat_ws(' ', transform(sequence(0, 40), i -> concat('w', id % 45, 'x', i)), if(id < 45, 'a', 'b')) AS text"
    )
    rows.write.parquet(str(tmp_path / "documents"))
    for first, then in (("128m", "1"), ("1", "128m")):
        written = []
        plain = common.Scratch.table

        def counted(self, df, name, *folders):
            out = plain(self, df, name, *folders)
            written.append(name)
            spark.conf.set(SPLITS[0], then)
            spark.conf.set(SPLITS[1], "1")
            return out

        monkeypatch.setattr(common.Scratch, "table", counted)
        try:
            spark.conf.set(SPLITS[0], first)
            groups = near.near_groups(spark.read.parquet(str(tmp_path / "documents")))
            assert groups.select("component_id").distinct().count() == 45 and written
        finally:
            monkeypatch.setattr(common.Scratch, "table", plain)
            for name in SPLITS:
                spark.conf.unset(name)


def test_hot_groups_are_joined_whole(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'copy', concat('own ', id)) AS text")
    found = exact.exact_groups(rows).groupBy("keep_id", "group_size").count().orderBy(F.desc("count")).first()
    assert tuple(found) == (0, 2000, 2000)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(90, 91), (91, 90)]])
def test_components(spark, edges):
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    leader = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in leader:
        for u, v in edges:
            if u in leader:
                leader[u] = leader[v] = min(leader[u], leader[v])
    assert found == leader


def test_files_of_small_work_tables_follow_their_rows(spark, monkeypatch):
    written, plain = [], common.Scratch.table
    monkeypatch.setattr(common.Scratch, "table", lambda *a: (table := plain(*a), written.append((a[2], len(table.inputFiles()))))[0])
    texts = [" ".join(f"{w}{i // 4}" for w in "abcdefghij") + f" {i % 2}" for i in range(200)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        groups = near.near_groups(documents)
        paths = spark.range(20).selectExpr("id u", "id + 1 v")
        assert len(components(paths).inputFiles()) <= 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(groups.inputFiles()) == 1
    assert [n for name, n in written if name in ("groups", "stars", "open", "named")] == [1] * 4
    assert {n for (one, _), (name, n) in zip(written, written[1:], strict=False) if (one, name) == ("edges", "edges")} == {1}
    assert {(r.doc_id, r.component_id) for r in groups.collect()} == {(i, i // 4 * 4) for i in range(200)}


def copies(seed=1):
    """Texts in families at all similarities around the limit, short ones, and a chain whose ends differ."""
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for family in range(12):
        base = random.choices(words, k=random.choice([6, 30, 120]))
        for member in range(9):
            text = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 12))):
                text[random.randrange(len(text))] = random.choice(words)
            texts.append(" ".join(text))
    chain = random.choices(words, k=60)
    for step in range(20):
        texts.append(" ".join(chain))
        chain = chain[2:] + random.choices(words, k=2)
    return texts + ["", None, "One", "one", "two", "A b", "a  B", "a b"]


@pytest.mark.parametrize(("width", "block"), [(2, 1024), (2, 4), (5, 1024)])
def test_near_groups_equal_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr(near, "BLOCK", block)
    texts = copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id").cache()
    sets = [frozenset(shingles(t, width).tolist()) for t in texts]
    plain = [(t or "").lower().split() for t in texts]
    assert [len(s) for s in sets] == [len({tuple(w[i : i + min(width, len(w))]) for i in range(max(1, len(w) - width + 1))}) if w else 0 for w in plain]
    leader = list(range(len(texts)))
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in leader:
        for a, b in links:
            leader[a] = leader[b] = min(leader[a], leader[b])
    rows = near.near_groups(docs, width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(sets[i]), leader[i], leader[i] == i) for i in range(len(texts))
    }


def test_near_groups_of_odd_rows(documents):
    rows = near.near_groups(documents).collect()
    assert len(rows) == len(TEXTS)
    assert {r.component_id for r in rows if r.doc_id in (3, 5) or r.doc_id is None} == {3}
    assert near.drop_near_copies(documents).columns == documents.columns


def test_gradients_of_the_network():
    network = Network(3, hidden=4, seed=1)
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    table, there = pad([b"abc", b"ab", b"cabab"])
    label = np.array([0, 1, 2])

    def loss():
        found = network.probabilities(table, there)
        return -sum(np.log(found[i, t, label[i]]) for i in range(3) for t in range(table.shape[1]) if there[i, t]) / there.sum()

    grads = network.gradients(table, there, label)
    random.seed(2)
    for name, weights in network.weights.items():
        for _ in range(6):
            at = tuple(random.randrange(97, 100) if d == 256 else random.randrange(d) for d in weights.shape)
            weights[at] += 1e-4
            up = loss()
            weights[at] -= 2e-4
            down = loss()
            weights[at] += 1e-4
            assert abs((up - down) / 2e-4 - grads[name][at]) < 2e-3


def tongue(lang, seed):
    random.seed(seed)
    parts = {"aa": ["ka", "ko", "ki"], "bb": ["zu", "sch", "ein"]}[lang]
    return " ".join("".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(40))


def test_language_on_held_out_texts(spark):
    rows = [(i, tongue(lang, i), lang) for i in range(60) for lang in (["aa", "bb"][i % 2],)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, weights = language.fit(learned.filter("doc_id < 40"))
    assert languages == ["aa", "bb"]
    odd = spark.createDataFrame([(100, None, None), (101, " 12 !", "aa"), (None, "koka", None)], learned.schema)
    found = {r.doc_id: r for r in language.predict(learned.filter("doc_id >= 40").union(odd), languages, weights).collect()}
    assert all(found[i].lang_pred == lang and 0.5 < found[i].score <= 1 for i, _, lang in rows if i >= 40)
    assert [(found[i].lang_pred, found[i].score) for i in (100, 101)] == [("und", 0.0)] * 2
    assert found[None].lang_pred == "aa"
    nothing = language.fit(learned.filter("false"))
    assert {r.lang_pred for r in language.predict(learned, *nothing).collect()} == {"und"}


def test_toxicity_on_held_out_texts(spark):
    random.seed(4)
    words = [f"w{chr(97 + i)}x" for i in range(26)]
    texts = [" ".join(random.choices(words, k=30)) for _ in range(400)]
    toxic = [i % 5 == 0 for i in range(400)]
    texts = [f"{t} {random.choice(['idiot', 'gremblin', 'gremblot'])}, {random.choice(words)}" if y else t for t, y in zip(texts, toxic, strict=True)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (901, ""), (None, "idiot!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)] + [(None, 1, 1), (900, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 1)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i in range(400) if i % 4 == 1 and found[i].predicted != toxic[i]]
    assert len(wrong) <= 2
    assert found[None].predicted == 1 and found[900].score == found[901].score < 0.5
    none = toxicity.fit(docs, labels.filter("false"), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_correlated_votes_weigh_less():
    random.seed(6)
    label = np.array([int(random.random() < 0.2) for _ in range(3000)])
    fires = lambda: np.array([random.random() < (0.6 if y else 0.05) for y in label], float)
    one, two = fires(), fires()
    model = toxicity.LabelModel().fit(np.column_stack((one, one, two)), label)
    assert model.weight[0] < 0.75 and model.weight[2] > 0.8
    assert (model.posterior(np.array([[1, 1, 1], [0, 0, 0]])) > 0.5).tolist() == [True, False]


def bigrams(text):
    words = re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in text)).split()
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)}


def test_licences_equal_brute_force(spark):
    texts = {
        1: "Intro text\nReleased under the MIT License!\nend", 2: "licensed UNDER cc by-nc 4.0", 3: None, 4: "", 5: "MIT",
        6: "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software and\nassociated documentation files",
        7: "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.", 8: "word " * 3000,
    }
    want = {}
    for key, text in texts.items():
        lines = (text or "").split("\n")
        for unit in lines + ([text] if len(lines) > 1 else []):
            a, scores = bigrams(unit), []
            for name, notice in licences.TEMPLATES:
                b = bigrams(notice)
                if a and 200 * len(a & b) >= 80 * (len(a) + len(b)):
                    scores.append((name, 2 * len(a & b) / (len(a) + len(b))))
            winners = {name for name, x in scores if x == max(y for _, y in scores)}
            for name, x in scores:
                if name in winners:
                    dice, n = want.get((key, name), (0, 0))
                    want[key, name] = max(dice, x), n + 1
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, license string")
    found = {(r.doc_id, r.license): (r.dice, r.n_units) for r in licences.scan_licences(docs).collect()}
    assert found == want and len(found) >= 4
    assert licences.scan_licences(docs.filter("false")).count() == 0


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU{} General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("int main() {}\n" * 40 + MIT + "\nmore text\n" * 40, {"MIT": 1}),
        (GPL.format("") + "\nimport os\n", {"GPL-3.0": 1}),
        (GPL.format(" Affero") + "\nimport os, so, much, more, than, that\n" * 20, {"AGPL-3.0": 1}),
        (" * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n", {"BSD-2-Clause": 1}),
        ("All parts of this text are free to share. Licensed under the Apache License, Version 2.0.", {"Apache-2.0": 1}),
        ("Here it is. Licensed under CC BY 4.0. That was it, and the other is licensed under CC BY-NC 4.0. " + "So much. " * 9, {"CC-BY-4.0": 1, "CC-BY-NC-4.0": 1}),
        ("We talk of it. Released under the MIT License, it says. " * 3000, {"MIT": 3000}),
        ("licensed under the license of the public software in the general terms " * 300, {}),
    ],
)
def test_notices_within_lines_and_over_lines(text, want):
    found = licences.Scanner(licences.TEMPLATES, 80, licences.PASSAGES).text(text)
    assert {name: n for name, (_, n) in found.items()} == want


def header(family, version, sign, more="(at your option) any later version"):
    return (
        f"# This program is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {family}\n# "
        f"as published by the Free Software Foundation{',' if sign == ':' else ';'} either version {version} of the License, or\n# {more}.\n"
    )


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (header("General Public License", "2", ";"), "GPL-2.0"),
        (header("General Public License", "3", ":"), "GPL-3.0"),
        (header("Lesser General Public License", "2.1", ";"), "LGPL-2.1"),
        (header("Lesser General Public License", "3", ":"), "LGPL-3.0"),
        (header("Affero General Public License", "3", ":"), "AGPL-3.0"),
        (BSD, "BSD-2-Clause"), (BSD + THIRD, "BSD-3-Clause"), (ISC, "ISC"), (MIT, "MIT"),
        ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.", "Zlib"),
    ],
)
def test_relatives_are_told_apart(text, want):
    scanner = licences.Scanner(licences.TEMPLATES, 80, licences.PASSAGES)
    for within in ("{}", "line\n{}\nline of code", "words before {} words after"):
        assert set(scanner.text(within.format(text))) == {want}, within
    assert set(scanner.text(" ".join(text.replace("#", " ").split()))) == {want}


def test_passages_equal_all_windows():
    random.seed(11)
    scanner = licences.Scanner((), 80, (("one", "a b c d e f"), ("two", "c d a g h")))
    for _ in range(300):
        text = " ".join(random.choices("abcdefgh", [5, 4, 4, 4, 3, 3, 1, 1], k=random.randint(2, 24)))
        words = text.split()
        for name, notice in (("one", "a b c d e f"), ("two", "c d a g h")):
            alone = licences.Scanner((), 80, ((name, notice),)).text(text)
            units = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
            best = max(2 * len(bigrams(u) & bigrams(notice)) / (len(bigrams(u)) + len(bigrams(notice))) for u in units)
            assert alone.get(name, (0,))[0] == (best if best >= 0.8 else 0)
            assert scanner.text(text).get(name, (0,))[0] <= best


def test_passages_of_documents(spark):
    docs = spark.createDataFrame([(1, "x\n" + MIT), (1, "y " + MIT), (2, None), (3, "MIT")], "doc_id long, text string")
    assert [tuple(r) for r in licences.scan_licences(docs).collect()] == [(1, "MIT", 1.0, 2)]


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", r"[\INST] \ <\\/s>", "<<SYS>> <s> [OUT]", "[[INST]", "", "a<", "x [/INST"])
def test_template_is_reversible(text):
    turns = [("system", text), ("user", text), ("assistant", text), ("tool</s>", text), ("assistant", "b")]
    rendered, spans = chat.render(turns, True)
    assert chat.parse(rendered) == turns
    assert [chat.unescape(rendered[a:b]) for a, b in spans] == [text, "b"]
    assert not chat.CONTROL.sub("", chat.escape(text)) == "" or text == "" or "\\" in chat.escape(text)


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 3)
    monkeypatch.setattr(chat, "PART_CHARS", 60)
    said = [None, "", "été 😀 </s>[INST]", " lead and trail ", "short", "x" * 200]
    rows = [(c, t, ["user", "assistant", "system", None][t % 4], random.Random(c * 31 + t).choice(said), 1) for c in (1, 2, -7) for t in range(9)]
    rows += [(None, 0, "assistant", "no id", 1), (5, None, "user", "no turn", 1), (5, 7, "assistant", "late", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    found = {r.conv_id: r for r in chat.digest_conversations(chat.format_conversations(table, TOKENIZER)).collect()}
    for key in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == key), key=lambda r: -1 if r[1] is None else r[1])]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = found[key]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.render(turns, True)[0])
    assert chat.format_conversations(table.filter("false"), TOKENIZER).count() == 0


@pytest.mark.parametrize(("turns", "length"), [(600, 30), (40, 80_000)])
def test_long_conversations_have_the_ids_of_their_whole_text(spark, turns, length):
    """Whatever stands at the cuts: nothing, signs, quotes, blanks."""
    draw = random.Random(turns)
    ends = ["", "s", "'", " ", "[", "]", ">", "<", "\n", "/", "é", "1", "<|endoftext|>"]
    said = [draw.choice(ends) + " ".join(draw.choice(["so", "it's", "[x]", "a>"]) for _ in range(length // 5)) + draw.choice(ends) for _ in range(turns)]
    roles = [draw.choice(["user", "assistant", "system", "tool"]) for _ in said]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, said, strict=True))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(table, TOKENIZER).orderBy("part", "piece").collect()
    assert len(parts) > 2
    whole = chat.render(list(zip(roles, said, strict=True)), True)
    assert "".join(p.text for p in parts) == whole[0]
    encoding = load_tokenizer(TOKENIZER).encode(whole[0], add_special_tokens=False)
    assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist() == encoding.ids
    learned, _ = chat.mask(np.array(encoding.offsets, np.int64), whole[1])
    assert b"".join(p.learned for p in parts) == learned.tobytes()


def test_training_draws_from_all_of_a_long_word(spark):
    word = "".join(chr(97 + i // 30) for i in range(600))
    rows = spark.createDataFrame([(1, "aa", word), (2, "aa", "x " + word)], "doc_id long, lang string, text string")
    drawn = [w for _, w in language.training_words(rows)]
    assert {word[i : i + language.LONGEST] for i in range(0, 600, language.LONGEST)} <= set(drawn)


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    random.seed(8)
    rows = [(i, tongue(["aa", "bb"][i % 2], 1000 + i), ["aa", "bb"][i % 2]) for i in range(60)]
    rows += [(100, rows[3][1], "bb"), (101, rows[4][1] + " kakoko", "aa"), (102, "123 456", "aa"), (103, None, None)]
    rows += [(200 + i, tongue("aa", 2000 + i) + " idiot " + tongue("aa", 3000 + i), "aa") for i in range(20)]
    docs = spark.createDataFrame([(a, b, c, "s", 1) for a, b, c in rows], EMPTY)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 1) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0
    stay = {r.doc_id for r in kept.collect()}
    assert stay <= set(range(60)) and len(stay) >= 58
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == stay
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], EMPTY).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("parts", "part"), [(5, 0), (3, 1)])
def test_held_out_rule(spark, parts, part):
    rows = spark.range(-3, 200).union(spark.sql("SELECT CAST(NULL AS bigint)")).withColumn("out", common.held_out(F.col("id"), parts, part))
    for r in rows.collect():
        assert r.out == (r.id is not None and zlib.crc32(str(r.id).encode()) % parts == part)


def test_workers_keep_the_objects_of_one_operator_only():
    first = common.once_per_worker("one", list, (1, 2))
    assert common.once_per_worker("one", list, (1, 2)) is first
    common.once_per_worker("two", dict)
    assert common.once_per_worker("one", list, (1, 2)) is not first
    for i in range(20):
        common.once_per_worker("one", list, (i,))
    assert len(common._KEPT) <= common.MOST_KEPT + 1
    common._KEPT.clear()


def test_steps_on_keys_release_the_words_of_near_copies():
    rows = SimpleNamespace(select=lambda *_: rows, mapInArrow=lambda task, _: task, join=lambda *_: rows)
    for task in (near._first_keys(rows), near._tables(rows)):
        shingles("words that are remembered")
        assert any(common._KEPT.get(k) for k in common._KEPT if k != "owner")
        assert list(task(iter([]))) == []
        assert [k for k in common._KEPT if k != "owner"] == []
    common._KEPT.clear()
