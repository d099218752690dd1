"""Conversations as training text: whole conversations rendered and encoded once, masks aligned by offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import once_per_worker
from featurespark.llm.words import load_tokenizer

#: Fixed values of the template: what stands before and after the text of a turn, by role.
TEMPLATE = {
    "system": ("<<SYS>> ", " <</SYS>></s>"),
    "user": ("[INST] ", " [/INST]</s>"),
    "assistant": ("[OUT] ", "</s>"),
}
OTHER_ROLE = ("[ROLE] ", " [/ROLE]", "</s>")
BEGIN = "<s>"

#: Every turn ends with this letter and sign. Byte-level tokenizers cut words between letters and signs, so a text cut
#: before the sign has the ids of the whole text.
LAST_SIGN = ">"

#: A control string, with any number of backslashes after its first sign; in texts each gets one more.
CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|OUT\]|/?ROLE\]|/?s>|<SYS>>|</SYS>>)")
ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|OUT\]|/?ROLE\]|/?s>|<SYS>>|</SYS>>)")

#: Roles whose text is learned.
LEARNED = ("assistant",)

#: Turns of one rendered part, and characters after which a part is closed; they bound what a task holds and change
#: neither text nor ids of a conversation.
PART_TURNS, PART_CHARS = 256, 1 << 20


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], first: bool) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns, and where in it the learned texts stand."""
    out, at, spans = [BEGIN] if first else [], len(BEGIN) if first else 0, []
    for role, text in turns:
        if role in TEMPLATE:
            before, after = TEMPLATE[role]
        else:
            before, after = f"{OTHER_ROLE[0]}{escape(role)}{OTHER_ROLE[1]}", OTHER_ROLE[2]
        body = escape(text)
        if role in LEARNED:
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns, at = [], len(BEGIN) if text.startswith(BEGIN) else 0
    while at < len(text):
        for role, (before, after) in TEMPLATE.items():
            if text.startswith(before, at):
                end = text.index(after, at + len(before))
                turns.append((role, unescape(text[at + len(before) : end])))
                break
        else:
            middle = text.index(OTHER_ROLE[1], at)
            role, before, after = unescape(text[at + len(OTHER_ROLE[0]) : middle]), "", OTHER_ROLE[2]
            end = text.index(after, middle)
            turns.append((role, unescape(text[middle + len(OTHER_ROLE[1]) : end])))
        at = end + len(after)
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens reach into a span, and the parts of the spans that tokens cover, joined.

    Both are sorted, so that each span finds its first and last token by binary search.
    """
    learned, covered = np.zeros(len(offsets), np.uint8), []
    begin, end = offsets[:, 0], offsets[:, 1]
    for low, high in spans:
        first, last = np.searchsorted(end, low, "right"), np.searchsorted(begin, high, "left")
        if first < last and low < high:
            learned[first:last] = 1
            covered.append((max(low, int(begin[first])), min(high, int(end[last - 1]))))
    return learned, covered


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Rendered and encoded conversations, one row per part of a conversation.

    Input: conv_id, turn, role, text; other columns are not read. Turns are taken by number, ties by role and text; null
    texts and roles are empty, null turns come first, rows with a null conv_id are one conversation, repeated rows are
    repeated turns. Short conversations are one part. Others are cut every PART_TURNS turn numbers and PART_CHARS
    characters, so that no conversation has to fit one task, and always before the last sign of a turn: there the
    tokenizer begins a new word, so the parts in order have the text and the ids that the whole conversation has when
    it is rendered and encoded at once. Columns: conv_id, part and piece (their order), `text`, `ids` and `learned`
    (one byte a token), `spans` (pairs of 64-bit places in `text` under the mask). Control strings inside texts get a
    backslash that `unescape` takes away. An empty table gives no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker("chat", load_tokenizer, tokenizer)
        now, lowest, highest, held, size, piece = None, None, None, [], 0, 0

        def done(more: bool) -> pa.RecordBatch:
            """One part; `more` says that the same part of the conversation goes on."""
            begins, ends = now[1] == lowest and piece == 0, now[1] == highest and not more
            text, spans = render(held, begins)
            before = "" if begins else LAST_SIGN
            text = before + (text if ends else text[: -len(LAST_SIGN)])
            encoding = encoder.encode(text, add_special_tokens=False)
            spans = [(low + len(before), high + len(before)) for low, high in spans]
            learned, covered = mask(np.array(encoding.offsets, np.int64).reshape(-1, 2), spans)
            values = [
                now[0], now[1], piece, text, np.array(encoding.ids, "<u4").tobytes(), learned.tobytes(),
                np.array(covered, "<i8").tobytes(),
            ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        names = ["conv_id", "part", "piece", "text", "ids", "learned", "spans"]
        for batch in batches:
            for conv, part, first, last, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = (conv, part) == now
                if held and (not same or size >= PART_CHARS):
                    yield done(same)
                    piece = piece + 1 if same else 0
                    held, size = [], 0
                now, lowest, highest = (conv, part), first, last
                held.append((role or "", text or ""))
                size += len(text or "") + 32
        if held:
            yield done(False)

    part = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-1)).cast("long")
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").withColumn("part", part)
    bounds = rows.groupBy("conv_id").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    long_ = bounds.filter("first <> last").withColumnRenamed("conv_id", "id")
    joined = rows.join(long_, rows.conv_id.eqNullSafe(F.col("id")), "left")
    joined = joined.withColumns({"first": F.coalesce("first", "part"), "last": F.coalesce("last", "part")})
    dealt = joined.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    schema = "conv_id long, part long, piece long, text string, ids binary, learned binary, spans binary"
    return dealt.select("conv_id", "part", "first", "last", "role", "text").mapInArrow(task, schema)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its parts: turns and learned text as running hashes and counts.

    Input: what `format_conversations` gives; parts may come in any order, an empty table gives no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        open_, now, turns, loss, counts = False, None, None, None, None
        out: list[tuple] = []

        def row() -> tuple:
            return now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        for batch in batches:
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begins = not open_ or conv != now
                if begins:
                    if open_:
                        out.append(row())
                    open_, now, turns, loss, counts = True, conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                whole = text if begins else text.removeprefix(LAST_SIGN)
                for role, said in parse(whole if whole.endswith(OTHER_ROLE[2]) else whole + LAST_SIGN):
                    turns.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                for low, high in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist():
                    said = unescape(text[low:high])
                    loss.update(said.encode())
                    counts[1] += len(said)
                counts[2] += len(text)
            if out:
                yield batch_of(out)
                out = []
        if open_:
            yield batch_of([row()])

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "text", "spans").mapInArrow(task, schema)
