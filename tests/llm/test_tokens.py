"""Packing, token files and lexicon against the tokenizers library itself."""

import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurespark.llm import lexicon, packing, repair
from featurespark.llm.lexicon import Transducer
from featurespark.llm.merges import Merger, byte_signs
from featurespark.llm.words import TextEncoder, load_tokenizer
from tests.llm.conftest import TEXTS, TOKENIZER

SIGNS = "' s t re ve ll d m \n \t a é 1 ² ! 中 ​ Ⅷ ़ \x1c \x85 😀 _ - \r\n \x00 　".split(" ") + [" ", "  ", "<|endoftext|>"]


def library(texts, end=()):
    return [e.ids + list(end) for e in load_tokenizer(TOKENIZER).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("own_merges", [False, True])
def test_encoder_equals_library_on_random_signs(own_merges):
    random.seed(3)
    merger = Merger(TOKENIZER)
    encoder = TextEncoder(TOKENIZER, (lambda ws: merger.encode([w.encode() for w in ws])) if own_merges else None, most=500)
    for _ in range(300):
        texts = ["".join(random.choice(SIGNS) for _ in range(random.randint(0, 14))) for _ in range(4)]
        flat, count = encoder.encode(texts, 0)
        assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == library(texts, [0])


def test_packing_places_every_id_once(documents):
    rows = packing.pack(documents, TOKENIZER, window=64).collect()
    want = dict(zip(range(len(TEXTS)), library(TEXTS, [0]), strict=True))
    want[None] = want.pop(4)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.doc_tokens == len(want[r.doc_id])
    for key, ids in want.items():
        found = sorted(pieces[key])
        assert [i for _, p in found for i in p] == ids
        assert [s for s, _ in found] == np.cumsum([0] + [len(p) for _, p in found])[:-1].tolist()
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist()
        assert sum(n for _, n in places) <= 64
    short = [s for s in sequences.values() if sum(n for _, n in s) < 64]
    assert len(short) <= documents.rdd.getNumPartitions()


def test_level_minimises_the_sum_of_squares():
    random.seed(5)
    packer = packing.Packer(32)
    for _ in range(400):
        size = random.randint(1, 31)
        count = packer._count.copy()
        costs = {}
        for level in [0] + [x for x in range(1, 33 - size) if count[x]]:
            after = count.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 32
            costs[level] = int((after[1:32] ** 2).sum())
        best = packer.level(size)
        assert costs[best] == min(costs.values())
        list(packer.add(0, np.ones(size, np.uint32)))


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_grammar_round_trip_and_random_access():
    random.seed(7)
    ids = np.array([random.choice([1, 2, 3]) if random.random() < 0.4 else i % 5 for i in range(5000)] + [7] * 999 + [0], np.uint32)
    last = np.zeros(len(ids), bool)
    last[[10, 11, 2500, len(ids) - 1]] = True
    rules, body, ends = repair.compress(ids, last, 10)
    grammar = repair.Grammar(rules, 10)
    assert len(body) < len(ids) / 2
    assert (grammar.expand(body) == ids).all()
    assert grammar.lengths[body][: np.flatnonzero(ends)[0] + 1].sum() == 11
    for begin, end in ((0, 1), (17, 900), (4999, 6000), (0, 6000)):
        assert (grammar.part(body, begin, end) == ids[begin:end]).all()


@pytest.mark.parametrize("seed", range(6))
def test_no_pair_is_left_twice(seed):
    """What remains has no pair that could still be replaced, runs aside, and every rule is used."""
    draw = np.random.default_rng(seed)
    ids = draw.integers(0, 4 + seed, 3_000).astype(np.uint32)
    ids[500:700] = 2
    last = draw.random(3_000) < 0.002
    last[-1] = True
    rules, body, ends = repair.compress(ids, last, 20)
    assert (repair.Grammar(rules, 20).expand(body) == ids).all()
    assert ends.sum() == last.sum()
    inner = [(int(a), int(b)) for a, b, e in zip(body[:-1], body[1:], ends[:-1]) if not e and a != b]
    assert not inner or np.unique(inner, axis=0, return_counts=True)[1].max() < 2
    assert set(range(20, 20 + len(rules))) <= set(rules.ravel().tolist()) | set(body.tolist())


@pytest.mark.parametrize("symbols", [50_257, 1 << 31])
def test_runs_and_blocks_shrink_to_their_rules(symbols):
    """Also where pair and place do not fit one number."""
    ids = {"run": np.full(100_000, 5, np.uint32), "blocks": np.tile(np.r_[np.full(50, 7), np.arange(10) + 100], 2_000).astype(np.uint32)}
    for name, flat in ids.items():
        last = np.zeros(len(flat), bool)
        last[-1] = True
        rules, body, _ = repair.compress(flat, last, symbols)
        assert len(body) + 2 * len(rules) < 100, name
    grammar = repair.Grammar(*repair.compress(ids["run"], np.arange(100_000) == 99_999, 10)[:1], 10)
    assert len(grammar.rules) <= 17


def test_random_access_opens_only_what_it_covers():
    draw = np.random.default_rng(1)
    ids = np.tile(draw.integers(0, 1_000, 4_000), 50).astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    rules, body, _ = repair.compress(ids, last, 1_000)
    for begin in (0, 777, 123_456, len(ids) - 20):
        grammar = repair.Grammar(rules, 1_000)
        assert (grammar.part(body, begin, begin + 20) == ids[begin : begin + 20]).all()
        assert grammar.opened < 20 + 4 * np.log2(len(ids))
    assert len(rules) > 3_000


def test_token_files_in_order(spark, documents, tmp_path):
    path = str(tmp_path / "tokens")
    repair.write_tokens(documents, TOKENIZER, path, parts=3, shard_ids=500)
    rows = repair.read_tokens(spark, path).orderBy("start").collect()
    order = sorted(range(len(TEXTS)), key=lambda i: -1 if i == 4 else i)
    want = library([TEXTS[i] for i in order], [0])
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == want
    assert [r.doc_id for r in rows] == [None if i == 4 else i for i in order]
    assert [r.start for r in rows] == np.cumsum([0] + [len(x) for x in want])[:-1].tolist()
    shard = spark.read.parquet(path).orderBy("part", "shard").first().asDict()
    assert repair.read_document(shard, 1, 0).tolist() == want[1]


def test_token_files_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    repair.write_tokens(empty, TOKENIZER, str(tmp_path / "none"), parts=2)
    assert repair.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_transducer_numbers_words_and_shares_suffixes():
    words = sorted({w.encode() for w in "talking walking talked walked talk walk king a ab".split()})
    found = Transducer.map(Transducer.build(words, [[i, i + 1] for i in range(len(words))]).pack())
    assert found.find(words).tolist() == list(range(len(words)))
    assert found.find([b"", b"wal", b"walkingx", b"x" * 99]).tolist() == [-1] * 4
    assert len(found.keys) < sum(map(len, words)) - 10


@pytest.mark.parametrize("least", [1, 1000])
def test_lexicon_encodes_and_decodes_like_the_library(documents, monkeypatch, least):
    monkeypatch.setattr(lexicon, "LEAST_COUNT", least)
    rows = lexicon.encode(documents, TOKENIZER, decoded=True, listed=True).collect()
    tokenizer = load_tokenizer(TOKENIZER)
    want = {(None if i == 4 else i): x for i, x in enumerate(library(TEXTS))}
    assert len(rows) == len(want)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] and r.n_tokens == len(want[r.doc_id])
        assert r.listed == ",".join(map(str, want[r.doc_id]))
        assert r.text == tokenizer.decode(want[r.doc_id], skip_special_tokens=False)


def test_lexicon_of_nothing(spark):
    assert lexicon.encode(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def letters(number: int, size: int) -> str:
    """A word of letters only, another one for each number."""
    return "".join(chr(97 + number // 26**k % 26) for k in range(size))


def test_words_met_again_outlive_a_full_memory():
    encoder, plain, asked = TextEncoder(TOKENIZER, most=200), load_tokenizer(TOKENIZER), []
    encode = encoder.words._encode
    encoder.words._encode = lambda words: asked.extend(words) or encode(words)
    for k in range(40):
        text = "always the same" + "".join(" " + letters(50 * k + i, 6) for i in range(50))
        assert encoder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(encoder.words._digest) <= 200 + 53
    assert len(asked) == len(set(asked)) > 40 * 50


def test_new_words_go_to_the_library_together():
    encoder, cut, calls = TextEncoder(TOKENIZER), load_tokenizer(TOKENIZER).model.tokenize, []
    counted = SimpleNamespace(tokenize=lambda signs: calls.append(signs) or cut(signs))
    encoder.tokenizer = SimpleNamespace(model=counted)
    texts = ["".join(" " + letters(i, 6) for i in range(4_000)), "été\x00ÿ 中文 ÿÿ"]
    flat, count = encoder.encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == library(texts)
    assert len(calls) <= 4_010 / 16 + 1


def test_words_stay_apart_when_the_model_merges_every_sign(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    signs = byte_signs()
    merges = [("a", signs[255]), (signs[255], signs[32])]
    vocabulary = {t: i for i, t in enumerate([*signs, *map("".join, merges)])}
    own = Tokenizer(models.BPE(vocabulary, merges))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.save(str(tmp_path / "own.json"))
    text = "a a ba 1a"
    found = TextEncoder(str(tmp_path / "own.json")).encode([text])[0].tolist()
    assert found == own.encode(text).ids == [vocabulary[s] for s in text.replace(" ", signs[32])]


def test_one_text_with_more_words_than_the_memory():
    encoder = TextEncoder(TOKENIZER, most=10)
    for begin in (0, 0, 700):
        text = "".join(" " + letters(begin + i, 6) for i in range(900))
        assert encoder.encode([text])[0].tolist() == library([text])[0]


def test_a_memory_of_mostly_common_words_stays_bounded():
    encoder, plain = TextEncoder(TOKENIZER, most=100), load_tokenizer(TOKENIZER)
    for k in (0, 1, 1, 2, 2, 0, 3):
        text = "".join(" " + letters(60 * k + i, 6) for i in range(60))
        assert encoder.encode([text, "", text])[0].tolist() == 2 * plain.encode(text, add_special_tokens=False).ids
        assert len(encoder.words._digest) <= 160


def test_new_words_do_not_copy_the_memory():
    import tracemalloc

    n = 50_000
    encoder = TextEncoder(TOKENIZER, lambda words: (np.zeros(len(words), np.uint32), np.ones(len(words), np.int64)))
    for words in (range(n), range(n, n + 5)):
        encoder.encode(["".join(" " + letters(i, 24) for i in words)])
    tracemalloc.start()
    try:
        encoder.encode(["".join(" " + letters(i, 24) for i in range(n + 5, n + 10))])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 * n  # the signs of the words are 100 bytes each


#: Reads the memory of a process of its own, without mapped files, in MB.
MEMORY = """
import gc, re, sys
import pyarrow as pa
from featurespark.llm import common

def held():
    gc.collect()
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
"""


def measured(code, *arguments):
    """The number that the code prints at last in a process of its own."""
    ran = [sys.executable, "-c", MEMORY + code, *arguments]
    return float(subprocess.run(ran, cwd=Path(__file__).parents[2], check=True, capture_output=True, text=True).stdout.split()[-1])


def test_the_library_keeps_no_words():
    grown = measured(
        """
from featurespark.llm.words import TextEncoder
letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(10))
encoder = TextEncoder(sys.argv[1])
encoder._library([letters(i) for i in range(16)])
common._LIBC.malloc_trim(0)
before = held()
for begin in range(0, 160_000, 4_000):
    encoder._library([letters(7 * i) for i in range(begin, begin + 4_000)])
common._LIBC.malloc_trim(0)
print(held() - before)
""",
        TOKENIZER,
    )
    assert grown < 15


def test_a_packing_worker_gives_large_blocks_back():
    grown = measured(
        """
from types import SimpleNamespace
import numpy as np
from featurespark.llm import packing

kept = []

class Encoder:
    def __init__(self, path):
        pass

    def encode(self, texts, end_id):
        return np.zeros(2 * len(texts), np.uint32), np.full(len(texts), 2)

class Table:
    schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}
    __getitem__ = lambda self, name: SimpleNamespace(cast=lambda kind: None)
    select = lambda self, *columns: self
    mapInArrow = lambda self, task, schema: task

def batches():
    for size in (28, 24, 20, 16):
        data = b"x" * (size << 20)
        kept.append(bytes(100_000))
        del data
        yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a"])], ["doc_id", "text"])

packing.TextEncoder = Encoder
packing.TaskContext = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
task = packing.pack(Table(), "")
before = held()
for _ in range(3):
    list(task(batches()))
print(held() - before)
"""
    )
    assert grown < 15
