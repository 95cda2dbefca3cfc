"""A Merkle manifest of a dataset: a tree of digests for each source, one above the sources, and a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from deepledger.llm.common import clean_name, cut, join_counted

#: Nodes under one, levels of a block and of a subtree that the traversal keeps.
ARITY, BLOCK_LEVELS, SUBTREE_LEVELS = 3, 6, 2
#: Blocks, with the proofs above them, up to which they are broadcast after being counted.
BROADCAST_BLOCKS = 20_000
PATH = "array<struct<left: binary, right: binary>>"


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields end to end, each `-` if null, else its UTF-8 bytes' count, `:` and its value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]), 256)


def _node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class _Subtree:
    """The nodes of one subtree from height `low` to below `high`, grown leaf by leaf; `root` is that at height `high`."""

    __slots__ = ("arity", "low", "high", "nodes", "open", "root")

    def __init__(self, low: int, high: int, arity: int):
        self.arity, self.low, self.high = arity, low, high
        self.nodes: list[list[str]] = [[] for _ in range(low, high)]
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.root = ""

    def _put(self, height: int, node: str) -> None:
        if height == self.high:
            self.root = node
            return
        if height >= self.low:
            self.nodes[height - self.low].append(node)
        self.open[height].append(node)

    def feed(self, leaf: str) -> None:
        self._put(0, leaf)
        height = 0
        while height < self.high and len(self.open[height]) == self.arity:
            node, self.open[height] = _node(self.open[height]), []
            height += 1
            self._put(height, node)

    def finish(self) -> _Subtree:
        """The last run of each height may be short, down to a single node."""
        for height in range(self.high):
            if self.open[height]:
                node, self.open[height] = _node(self.open[height]), []
                self._put(height + 1, node)
        return self


def authentication_paths(leaves: list[str], height: int, arity: int = ARITY, step: int = SUBTREE_LEVELS) -> tuple[str, Iterator[list[tuple[str, str]]]]:
    """The node `height` levels above the leaves, and for each leaf in turn its siblings to the left and to the right, level by level.

    Fractal traversal: subtrees of `step` levels are stacked from the leaf to the root. Those that hold the leaf exist; beside each
    but the topmost the next one, which is desired, takes one leaf at each step, so it is whole when its turn comes. Besides the
    leaves only these nodes are held.
    """
    bounds = [*range(0, height, step), height] if height else []
    layers = list(zip(bounds, bounds[1:]))
    existing = []
    for low, high in layers:
        tree = _Subtree(low, high, arity)
        for leaf in leaves[: arity**high]:
            tree.feed(leaf)
        existing.append(tree.finish())

    def walk() -> Iterator[list[tuple[str, str]]]:
        desired = [_Subtree(low, high, arity) for low, high in layers[:-1]]
        path: list[tuple[str, str]] = [("", "")] * height
        for x in range(len(leaves)):
            for (low, high), tree in zip(layers, existing):
                for t in range(low, high):
                    if x % arity**t:
                        continue  # the same node of this height as before
                    at = x // arity**t % arity ** (high - t)
                    run = at - at % arity
                    row = tree.nodes[t - low]
                    path[t] = "".join(row[run:at]), "".join(row[at + 1 : run + arity])
            yield path
            for i, (low, high) in enumerate(layers[:-1]):
                width = arity**high
                ahead = x + width
                if ahead < len(leaves):
                    desired[i].feed(leaves[ahead])
                if (x + 1) % width == 0:
                    existing[i], desired[i] = desired[i].finish(), _Subtree(low, high, arity)

    return existing[-1].root if existing else leaves[0], walk()


def _levels(total: int, arity: int, most: int) -> int:
    """Levels of runs until one node remains, at most so many."""
    levels = 0
    while total > 1 and levels < most:
        total, levels = -(-total // arity), levels + 1
    return levels


def numbered(rows: DataFrame, group: str, order: list[str], at: str, total: str) -> DataFrame:
    """rows with their place (from 0) in their group by the given columns, nulls first, and the group's size.

    Rows are range-partitioned by group and order, so that a large group lies in many partitions, and counted by group and
    partition; only these counts are summed up within a group. Rows that are equal in all of `order` are told apart arbitrarily.
    """
    own, part, first, before = (clean_name(rows, c) for c in ("_own", "_part", "_first", "_before"))
    rows = cut(rows).withColumn(own, F.monotonically_increasing_id())
    ordered = [F.col(c).asc_nulls_first() for c in (group, *order, own)]
    rows = cut(rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop(own))
    rows = rows.withColumn(own, F.monotonically_increasing_id()).withColumn(part, F.shiftright(own, 33))
    counts = rows.groupBy(group, part).agg(F.min(own).alias(first), F.count("*").alias(before))
    each = Window.partitionBy(group)
    counts = counts.withColumns({total: F.sum(before).over(each), before: F.sum(before).over(each.orderBy(part)) - F.col(before)})
    out = join_counted(rows, counts, [group, part], "inner")
    return out.withColumn(at, F.col(own) - F.col(first) + F.col(before)).drop(own, part, first, before)


def _climbed(nodes: DataFrame, arity: int, levels: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Of (group, at, total, node, others): rows with `path` within their block and its number, and (group, block, above, top).

    A block is `arity ** levels` nodes of a group in a row; blocks are dealt by group and number, so none is larger and a large group
    has many. The nodes above the blocks are climbed in the same way, until each group has one.
    """
    size = arity**levels
    blocks = nodes.withColumn("block", F.floor(F.col("at") / size)).repartition("group", "block").sortWithinPartitions("group", "block", "at")
    kept = [f for f in blocks.schema.fields if f.name not in ("node", "at")]
    schema = StructType([*kept, StructField("node", blocks.schema["node"].dataType), *StructType.fromDDL(f"path {PATH}, block_root string").fields])

    def walk(table: pa.Table) -> pa.RecordBatch:
        group, block, total, node = (table[c].to_pylist() for c in ("group", "block", "total", "node"))
        lefts, rights, ends, roots = [], [], [0], [None] * len(node)
        begin = 0
        while begin < len(node):
            end = begin + 1
            while end < len(node) and block[end] == block[begin] and group[end] == group[begin]:
                end += 1
            roots[begin], paths = authentication_paths(node[begin:end], _levels(total[begin], arity, levels), arity, step)
            for path in paths:
                for left, right in path:
                    lefts.append(bytes.fromhex(left))
                    rights.append(bytes.fromhex(right))
                ends.append(len(lefts))
            begin = end
        pairs = pa.StructArray.from_arrays([pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], names=["left", "right"])
        own = [table[f.name].combine_chunks() for f in kept]
        columns = [*own, table["node"].combine_chunks(), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(roots, pa.string())]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the block that the batches so far end with
        for batch in batches:
            if not batch.num_rows:
                continue
            block, group = np.asarray(batch["block"].to_numpy()), batch["group"].to_pylist()
            if rest and (rest[-1]["block"][-1].as_py() != block[0] or rest[-1]["group"][-1].as_py() != group[0]):
                yield walk(pa.Table.from_batches(rest))
                rest = []
            start = len(group) - 1
            while start and block[start - 1] == block[-1] and group[start - 1] == group[-1]:
                start -= 1
            if start:
                yield walk(pa.Table.from_batches([*rest, batch.slice(0, start)]))
                rest = []
            rest.append(batch.slice(start))
        if rest:
            yield walk(pa.Table.from_batches(rest))

    rows = cut(blocks.mapInArrow(work, schema))
    roots = rows.where("block_root is not null").select("group", "block", F.ceil(F.col("total") / size).alias("total"), F.col("block_root").alias("node"))
    rows = rows.drop("block_root")
    if roots.where("total > 1").isEmpty():  # a group has one block
        return rows, roots.select("group", "block", F.array().cast(PATH).alias("above"), F.col("node").alias("top"))
    inner, outer = _climbed(roots.withColumnRenamed("block", "at").withColumn("number", F.col("at")), arity, levels, step)
    above = _joined(inner, outer).select("group", F.col("number").alias("block"), F.concat("path", "above").alias("above"), "top")
    return rows, cut(above)


def _joined(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, ["group", "block"])


def manifest(docs: DataFrame, keep: list[str] | None = None, arity: int = ARITY, levels: int = BLOCK_LEVELS, step: int = SUBTREE_LEVELS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, and the columns to keep) for every row of docs (doc_id, source, lang, n_chars, text).

    leaf: the digest of the row. In a source, leaves by ascending doc_id are hashed in runs of `arity`, a last one of fewer too, until
    one node remains, its subroot; subroots by source, null first, likewise give root. proof: for each level from the leaf to
    the root the siblings' digests (32 bytes each) to the left and to the right. `folded` gives the root back.

    Blocks of `arity ** levels` leaves are traversed each in one task, with subtrees of `step` levels. The nodes above are far
    fewer, are treated in the same way, and their proofs are joined to the blocks and then appended to those of the rows.

    Null fields count as `-`; a null doc_id comes first. Rows of one doc_id are ordered by their leaf; equal ones have equal leaves
    and a place, and a proof, each. A lone leaf is its subroot, a lone subroot the root. Very long texts are hashed by Spark in place
    and travel no further. Other columns are left out unless kept. No rows: no rows.
    """
    keep = keep or []
    leaves = docs.select("doc_id", "source", digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("node"), F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"))
    leaves = leaves.withColumn("group", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
    rows, blocks = _climbed(numbered(leaves, "group", ["doc_id", "node"], "at", "total"), arity, levels, step)
    sources = blocks.where("block = 0").select(F.lit(0).alias("group"), F.col("group").alias("source"), F.col("top").alias("node"))
    inner, outer = _climbed(numbered(sources, "group", ["source"], "at", "total"), arity, levels, step)
    sources = _joined(inner, outer).select(F.col("source").alias("group"), F.concat("path", "above").alias("over"), F.col("top").alias("root"))
    blocks = cut(join_counted(blocks, sources, ["group"], "inner"))
    out = _joined(rows, blocks).withColumn("proof", F.concat("path", "above", "over"))
    own = [F.col("kept")[c].alias(c) for c in keep]
    return out.select("doc_id", "source", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", "proof", *own)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the hex digests of a proof, end to end."""
    return F.sha2(_hex(F.aggregate(proof, F.lit(b""), lambda all, p: F.concat(all, p["left"], p["right"]))), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has with the siblings of a proof."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(_hex(p["left"]), node, _hex(p["right"])), 256))
