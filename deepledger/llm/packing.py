"""Tokenisation into pieces and sum-of-squares packing of the pieces into sequences."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deepledger.llm.common import clean_name, cut

#: Pieces that one task packs. More tasks, each with a few sequences left part full, take their place as the input grows.
SHARD_ROWS = 100_000
_CODERS: dict[str, object] = {}


def encoder(path: str):
    """text -> ids of the `tokenizers` file at path. With a .tiktoken file of the same vocabulary beside it, ordinary text takes that faster coder."""
    if path not in _CODERS:
        import os

        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _CODERS[path] = lambda text: slow.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast(text)
        else:
            _CODERS[path] = lambda text: slow.encode(text, add_special_tokens=False).ids
    return _CODERS[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece (from 0), start, length, ids (little-endian unsigned 32-bit).

    A document is its ids and then `end_id`; null and empty text: `end_id` alone. Only a document longer than `capacity` is cut;
    its first piece takes the remainder and the others are full. Repeated rows give repeated pieces; a null doc_id is kept.
    Other columns are left out. tokenizer: path of a `tokenizers` file, the same on all machines. No rows: no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = array("I", encode(text) if text else ())
                    ids.append(end_id)
                    n, start, piece = len(ids), 0, 0
                    while start < n:
                        length = (n - start - 1) % capacity + 1
                        rows.append((doc, piece, start, length, ids[start : start + length].tobytes()))
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the given order.

    With N(g) open bins of residual gap g, each length goes where the sum of N(g)**2 over 0 < g < capacity becomes smallest,
    into a new bin included; ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)  # of open bins by gap; a full bin and an unused one count nothing
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        old = count[s:capacity]
        change = np.where(old > 0, count[: capacity - s] - old + 1.0, np.inf)  # half of the change
        if len(change):
            change[0] -= 0.5  # a bin that becomes full counts nothing
        fresh = count[capacity - s] + 0.5 if s < capacity else 0.0
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] <= fresh:
            gap, b = s + best, stacks[s + best].pop()
            count[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """pieces with sequence_id and offset: each in one sequence of at most `capacity` tokens, gapless from offset 0.

    A full piece is a sequence by itself. The others are dealt evenly, whatever their keys, to tasks of about `shard_rows`, and
    each task packs its own, longest first. Needs a column `length` from 1 to `capacity`; other columns pass through.
    Equal pieces are packed each for itself. No rows: no rows. The input is read once, through a checkpoint.
    """
    row, shard = clean_name(pieces, "_row"), clean_name(pieces, "_shard")
    pieces = cut(pieces.drop("sequence_id", "offset").withColumn(row, F.monotonically_increasing_id()))
    part = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_rows))
    schema = StructType(part.schema.fields + StructType.fromDDL("sequence_id long, offset long").fields)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", row], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        first = pd.Series(pdf[row].to_numpy()).groupby(bins).transform("min").to_numpy()  # a number that no other task gives
        return pdf.assign(sequence_id=first, offset=offsets).drop(columns=shard)

    # the row number's hash deals evenly: it is unique
    placed = part.withColumn(shard, F.pmod(F.xxhash64(row), F.lit(shards))).groupBy(shard).applyInPandas(place, schema)
    full = pieces.where(F.col("length") == capacity).select("*", F.col(row).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full).drop(row)
