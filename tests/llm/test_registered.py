"""The registered queries of operators that SQL can't express: their exact columns, against the libraries and plain loops."""

import hashlib
import zlib

import numpy as np
import pytest

from featurespark.llm.queries import QUERIES
from featurespark.llm.words import load_tokenizer
from tests.llm.conftest import TOKENIZER

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoded(texts):
    tokenizer = load_tokenizer(TOKENIZER)
    return {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, encoded):
    rows = QUERIES["op1_sum_of_squares_packing"](spark, FOLDER).collect()
    pieces, sequences = {}, {}
    for r in rows:
        whole = [*encoded[r.doc_id], 0]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == crc(whole[r.start : r.start + r.length])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(encoded)
    for key, parts in pieces.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
        assert sum(n for _, n in parts) == len(encoded[key]) + 1
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
    filled = [sum(n for _, n in parts) for parts in sequences.values()]
    assert max(filled) <= 1024 and sum(filled) > 0.98 * 1024 * len(filled)


def test_token_files(spark, encoded):
    rows = sorted(QUERIES["op2_repair_tokens"](spark, FOLDER).collect(), key=lambda r: r.doc_id)
    start, want = 0, []
    for key in sorted(encoded):
        ids = [*encoded[key], 0]
        want.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == want


def test_toxicity(spark, texts):
    rows = QUERIES["op3_weak_supervision_toxicity"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_neighbours(spark):
    rows = QUERIES["op5_learned_partitions"](spark, FOLDER).collect()
    table = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    keys = np.array(sorted(table))
    vectors = np.stack([table[k] for k in keys])
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert r.score == pytest.approx(np.linalg.norm(table[r.query_id] - table[r.vec_id]), rel=1e-12)
    assert set(found) == {int(k) for k in keys if k % 100 == 0}
    hits = 0
    for key, listed in found.items():
        assert [r for r, _, _ in sorted(listed)] == list(range(1, 11))
        assert [(s, v) for _, v, s in sorted(listed)] == sorted((s, v) for _, v, s in listed)
        distance = np.linalg.norm(vectors - table[key], axis=1)
        best = [int(keys[i]) for i in np.lexsort((keys, distance)) if keys[i] != key][:10]
        hits += len({v for _, v, _ in listed} & set(best))
    assert hits >= 0.9 * 10 * len(found)


def test_conversations(spark):
    turns = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", said), ("assistant", said)]
    rows = {r.conv_id: r for r in QUERIES["op6_offset_aligned_chat"](spark, FOLDER).collect()}
    assert set(rows) == set(turns)
    for key, listed in turns.items():
        r, loss = rows[key], "".join(t for role, t in listed if role == "assistant")
        assert r.n_turns == len(listed) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in listed).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars > sum(len(t) for _, t in listed)


def test_lexicon(spark, texts, encoded):
    tokenizer = load_tokenizer(TOKENIZER)
    rows = QUERIES["op8_transducer_lexicon"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = encoded[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language(spark, texts):
    rows = QUERIES["op9_byte_gru_language"](spark, FOLDER).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    right = []
    for r in rows:
        out = zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert r.held_out == out and 0 <= r.score <= 1
        assert r.lang_pred in {"und", *langs.values()}
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))
        if out and langs[r.doc_id]:
            right.append(r.lang_pred == langs[r.doc_id])
    assert np.mean(right) > 0.95
