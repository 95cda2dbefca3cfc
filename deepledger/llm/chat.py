"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Conversations whose tokens and offsets a task holds as Python objects at a time.
SLICE = 64
TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
#: A control string inside a text gets one backslash more after its first character, so none is left as it stands.
#: Openings of this template's marks and of marks that other chat templates use.
CONTROL = r"<(?P<b>\\*)(?P<r>\||/?s>)|\[(?P<c>\\*)(?P<i>/?INST\])"
ESCAPE = re.compile(CONTROL)
UNESCAPE = re.compile(CONTROL.replace(r"\\*", r"\\+"))


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: f"{m[0][0]}{m[0][2:]}", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn, read from a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        say = formatted.index(SAY, at)
        end = formatted.index(END, say)
        out.append((unescape(formatted[at + len(TURN) : say]), unescape(formatted[say + len(SAY) : end]), say + len(SAY), end))
        at = end + len(END)
    return out


def masked_tokens(spans: list[tuple[int, int]], starts: list[int], ends: list[int]) -> list[int]:
    """1 for each token that lies in one of the sorted spans; both borders of a span are found by binary search."""
    mask = [0] * len(starts)
    for a, b in spans:
        if a < b:
            lo, hi = bisect_left(starts, a), bisect_right(ends, b)
            mask[lo:hi] = [1] * (hi - lo)
    return mask


def masked_text(formatted: str, starts: list[int], ends: list[int], mask: list[int]) -> str:
    """The unescaped text under a mask, each character once: bytes of one character may be several tokens."""
    parts, begin, end = [], None, 0
    for a, b, m in zip(starts, ends, mask):
        if m:
            if begin is None:
                begin, end = a, b
            end = max(end, b)
        elif begin is not None:
            parts.append(unescape(formatted[begin:end]))
            begin = None
    if begin is not None:
        parts.append(unescape(formatted[begin:end]))
    return "".join(parts)


SCHEMA = "conv_id long, formatted string, input_ids array<int>, starts array<int>, ends array<int>, loss_mask array<int>"


def format_chats(turns: DataFrame, tokenizer: str, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): formatted text, token ids, token offsets, loss mask.

    A whole conversation is rendered, encoded once with offsets, and the spans of `loss_role` texts are intersected with the
    token spans. The marks are added special tokens, so no token crosses a border of a text.
    tokenizer: path of a `tokenizers` file, the same on all machines.
    Turns are ordered by (turn, role, text), nulls first; ties and repeated rows are kept as turns of their own. Null role or
    text: empty. Rows with null conv_id form one conversation with null id. Other columns are ignored. No rows: no rows.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.select("conv_id", said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import AddedToken, Tokenizer

        coder = Tokenizer.from_file(tokenizer)
        coder.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, SAY, END)])
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                texts, loss = [], []
                for said in part["turns"].to_pylist():
                    pieces, spans, at = [], [], 0
                    for x in said:
                        head, body = f"{TURN}{escape(x['role'])}{SAY}", escape(x["text"])
                        if x["role"] == loss_role:
                            spans.append((at + len(head), at + len(head) + len(body)))
                        pieces += (head, body, END)
                        at += len(head) + len(body) + len(END)
                    texts.append("".join(pieces))
                    loss.append(spans)
                codes = coder.encode_batch(texts, add_special_tokens=False)
                starts, ends = [[o[0] for o in c.offsets] for c in codes], [[o[1] for o in c.offsets] for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [part["conv_id"], pa.array(texts), pa.array([c.ids for c in codes], pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())),
                     pa.array(ends, pa.list_(pa.int32())), pa.array([masked_tokens(*x) for x in zip(loss, starts, ends)], pa.list_(pa.int32()))],
                    names=["conv_id", "formatted", "input_ids", "starts", "ends", "loss_mask"],
                )

    return whole.mapInArrow(encode, SCHEMA)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of turns and masked text, taken only from the columns of `format_chats`."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, max(1, whole.num_rows), SLICE)):
            rows = []
            for x in batch.to_pylist():
                turns = parse(x["formatted"])
                said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
                loss = masked_text(x["formatted"], x["starts"], x["ends"], x["loss_mask"])
                rows.append((x["conv_id"], len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(x["formatted"]), len(x["input_ids"]), sum(x["loss_mask"])))
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if n.endswith("sha256") else pa.int64()) for n, v in zip(names, zip(*rows) if rows else [[]] * len(names))], names=names)

    return chats.mapInArrow(digest, DIGESTS)
