"""Cross-tokenizer alignment against the libraries themselves and plain loops over tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from featurespark.llm import alignment, queries
from tests.llm.conftest import TEXTS, TOKENIZER

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<s> </s> <unk> <0x41>", "a▁b", "tabs\tand\nlines  \n\n x", "no-break space ﬁ ①", "中文字没有空格" * 30, " leading", "\0", "é" * 700]


def brute(rows):
    """Rows of (doc_id, text) -> the columns of the query, by comparing every byte range."""
    a_model, b_model = Tokenizer.from_file(TOKENIZER), SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    signs = {v: k for k, v in enumerate(alignment.byte_signs())}
    documents, counts = [], Counter()
    for doc, text in rows:
        if not text:
            documents.append((doc, [], [], [], []))
            continue
        raw = b" " + text.encode()
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        tokens_a = [bytes(signs[s] for s in a_model.id_to_token(i)) for i in a]
        pieces = [b_model.id_to_piece(i) for i in b]
        tokens_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if b"".join(tokens_a) != raw or b"".join(tokens_b) != raw:
            documents.append((doc, [], [], [], []))
            continue
        ranges = []
        for tokens in (tokens_a, tokens_b):
            ends = [0]
            for t in tokens:
                ends.append(ends[-1] + len(t))
            ranges.append(list(zip(ends, ends[1:])))
        shared = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, links, low = [], [], 0
        for cut in shared:
            in_a = [i for i, (s, e) in enumerate(ranges[0]) if low <= s and e <= cut]
            in_b = [i for i, (s, e) in enumerate(ranges[1]) if low <= s and e <= cut]
            groups.append(",".join(str(a[i]) for i in in_a) + "|" + ",".join(str(b[i]) for i in in_b))
            links += [(a[i], b[j]) for i in in_a for j in in_b if max(ranges[0][i][0], ranges[1][j][0]) < min(ranges[0][i][1], ranges[1][j][1])]
            low = cut
        counts.update(links)
        documents.append((doc, a, b, groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted(
        (
            (doc, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
             sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc, a, b, groups, links in documents
        ),
        key=repr,
    )


def plain(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("common", [1 << 18, 40, 1])
def test_every_document(spark, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON_PART", common)
    draw = random.Random(4)
    rows = list(enumerate([*TEXTS, *ODD, *TEXTS[3:6]])) + [(None, "one text without an id"), (3, "a repeated id")]
    rows += [(100 + i, "".join(draw.choice("ab é.\n\t中😀'1▁<") for _ in range(60))) for i in range(30)]
    wide = [(d, t, 1, b"p") for d, t in rows]
    found = alignment.align_tokens(spark.createDataFrame(wide, "doc_id long, text string, row long, pairs binary"), TOKENIZER, PIECES)
    assert plain(found) == brute(rows)


def test_windows_are_cut_at_anchors_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", 3)
    aligner = alignment.Aligner(TOKENIZER, PIECES)
    texts = ["the cat sat on the mat and the cat sat", "", "the cat sat on the mat and the cat sat"]
    for _ in range(3):
        rows = list(aligner.rows(texts))
        assert rows[0] == rows[2] and rows[1] == (0, 0, 0, 0, "", b"", b"")
    a, count_a, b, _ = aligner.tokens(texts)
    windows = aligner.windows(a, count_a, b)
    assert len(windows.number) == 20 and len(windows.begin) == 6
    words = [b"".join(aligner.a.tokens[i] for i in a[s : s + n]) for s, n in zip(windows.begin_a, windows.size_a)]
    assert words[:10] == [b" " + w.encode() for w in texts[0].split()]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokens(empty, TOKENIZER, PIECES).count() == 0


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 3_000]
    found = alignment.align_tokens(spark.createDataFrame(short, "doc_id long, text string"), TOKENIZER, PIECES)
    assert plain(found) == brute(short)
    whole = plain(queries.QUERIES["op13_cross_tokenizer_alignment"](spark, folder))
    assert sorted(r[0] for r in whole) == sorted(d for d, _ in rows)
    known = {r[0]: (r[1:5], r[7]) for r in whole}
    assert all(known[r[0]] == (r[1:5], r[7]) for r in brute(short))
