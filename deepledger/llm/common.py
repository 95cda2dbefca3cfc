"""Shared pieces of the training-data operators: table access, durable cuts and byte-level text kernels."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; bounds its memory, not what it reads.
CHUNK_BYTES = 1 << 20
GOLDEN = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session within one process (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="deepledger-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place


def scratch(spark: SparkSession, label: str) -> str:
    """A path for a table of one run in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows of a narrow table that one partition holds when it is compacted.
PART_ROWS = 250_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder.

    rows: a bound on the rows of a narrow table, which then gets no more partitions, and files, than it needs.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(rows // PART_ROWS + 1)).checkpoint(eager=True)


#: Rows of a narrow table up to which it is broadcast after being counted; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def join_counted(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """big joined to small, a narrow table that is cut and counted first: broadcast up to BROADCAST_ROWS, else an ordinary join."""
    small = cut(small)
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD6E8FEB86659FD93
_SEEDS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64; as many are kept as any chunk has asked for, those of a longer text than a chunk are not."""
    make = lambda size: (_odd_powers(_BASE, size), _odd_powers(pow(_BASE, -1, 1 << 64), size))
    if n > CHUNK_BYTES + 1:
        return make(n)
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = make(min(max(n + n // 4, 1 << 14), CHUNK_BYTES + 1))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each; a longer text is alone in its range."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if len(sizes):
        yield begin, len(sizes)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: prefix sums of seeded bytes times powers, shifted back to position 0."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SEEDS[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a text's border: starts, ends, and each text's offsets among them."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]
    to = offsets[1:][offsets[1:] > 0] - 1
    last[to] = inside[to]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ([^\\x20\\x09-\\x0D]+ after lower-casing A-Z) of all texts, and each text's offsets among them."""
    data, offsets = text_bytes(column)
    starts, ends, at = spans_of(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
    return hash_spans(ascii_lower(data), starts, ends), at


_MULT = mix64(np.arange(11, 75, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; a text of fewer words has its whole sequence as one."""
    words, at = word_hashes(column)
    full = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        full += words[i : i + len(full)] * _MULT[i]
    full = mix64(full + np.uint64(k))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(mix64(np.array([(words[a:b] * _MULT[: b - a]).sum(dtype=np.uint64)]) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def clean_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet."""
    while wanted in df.columns:
        wanted += "_"
    return wanted


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: each of its ids but the smallest with the smallest id that its own edges reach."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(ids))
    while True:  # hook the larger root to the smaller, then shorten all paths
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    far = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], names=["u", "v"])


def _with_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a partition, and each smallest id with itself."""
    for batch in _forest(batches):
        roots = pa.array(np.unique(batch.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0), roots]), pa.concat_arrays([batch.column(1), roots])], names=["id", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id (a long) reachable over undirected edges, for every id on an edge. The edges are read twice: cut them first.

    In each round a partition, of about PART_ROWS edges, turns its own edges into stars; one partition is then done. If there are
    several, a large-star and a small-star step follow, each a grouped minimum and a join, until a round changes nothing.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    size, before = edges.count(), None
    if size < PART_ROWS:  # all edges in one partition
        return edges.coalesce(1).mapInArrow(_with_roots, "id long, component long")
    while True:
        parts = size // PART_ROWS + 1
        edges = cut(edges.coalesce(parts).mapInArrow(_forest, "u long, v long"))
        if parts == 1:  # all edges were together
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u != v").distinct(), size)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u != v").distinct(), size)
        now = edges.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("h")).first()
        if now == before:
            break
        size, before = now["n"], now
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.union(roots)
