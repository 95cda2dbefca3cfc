"""Exact similarity join of documents on shingle sets, size-aware: subsets for small sets, inverted lists for large ones.

Two sets link when 100 * |A & B| >= 80 * |A | B|. All sets share one order of shingles, that of their hashes. A set of n sends its
first K(n) = n - ceil(0.8 n) + 2 + n // 20 shingles: of any linked pair, the set whose prefix ends first has at least
2 + min(n, m) // 20 of them in the other's prefix, hence 2 + ceil(0.8 n) // 20 for any partner of a set of n. Shingles that occur in
one prefix only cannot be shared, so a set with fewer others is done. Of the sets left, all shingles are counted in the same way: a
set needs ceil(0.8 n) of them in others. What it shares is ordered by frequency, rare first, and its candidates follow from its
rarest |shared| - ceil(0.8 n) + 1 shingles (inverted lists) or from the pairs among one more (subsets of fixed size).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from deepledger.llm.common import GOLDEN, connected_components, cut, join_counted, mix64, scratch, shingle_sets, slices

#: Words of a shingle; partitions of shingles and of sets, many more than a cluster's tasks.
WORDS, BUCKETS = 5, 2048
#: Sets of at most so many shingles link only to equal ones.
TINY = 3
#: Cost of a list entry that is only scanned, against a signature that is emitted and shuffled.
SCAN_COST = 0.05
#: Sets of a list up to which its pairs are looked at one by one.
LIST_ROWS = 16
#: Bytes of text that a task works on at once, and entries of packed buckets.
SLICE, ENTRIES = 1 << 18, 1 << 17


def prefix_size(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - -(-4 * n // 5) + 2 + n // 20)


def least_in_prefix(n: np.ndarray) -> np.ndarray:
    return 2 + -(-4 * n // 5) // 20


def least_in_set(n: np.ndarray) -> np.ndarray:
    return -(-4 * n // 5)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever the order of its members."""
    return tuple(int(mix64(tokens ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (GOLDEN, 0xC2B2AE3D27D4EB4F))


def sketch(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, f1, f2, low): a number of the row, set size, fingerprint and the first K(n) hashes, packed, of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE):
                sets = shingle_sets(batch["text"].slice(a, b - a), WORDS)
                marks = [fingerprint(s) for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                low = [s[:k].tobytes() if n > TINY else None for s, k, n in zip(sets, prefix_size(sizes).tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].slice(a, b - a), batch["doc_id"].slice(a, b - a), pa.array(sizes), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(low, pa.binary())],
                    names=["row", "doc_id", "n", "f1", "f2", "low"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "row long, doc_id long, n long, f1 long, f2 long, low binary")


PACKED = "bucket int, base long, keys binary, at binary, more binary"


def _packed(bucket: np.ndarray, keys: np.ndarray, at: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its 64-bit keys, the numbers `at` as 32-bit distances from a base, and a 32-bit value with each."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, at, more = bucket[order], keys[order], at[order], more[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    bases = [int(at[a:b].min()) for a, b in zip(cuts, ends)]
    wide = any(int(at[a:b].max()) - x >= 1 << 32 for a, b, x in zip(cuts, ends, bases))
    size = np.uint64 if wide else np.uint32  # told apart by length
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts], pa.int32()), pa.array(bases, pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
         pa.array([(at[a:b] - x).astype(size).tobytes() for a, b, x in zip(cuts, ends, bases)], pa.binary()), pa.array([more[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts, ends)], pa.binary())],
        names=["bucket", "base", "keys", "at", "more"],
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, numbers and values of batches in the order of their buckets: of so many whole buckets at a time that they hold ENTRIES keys."""
    rows = ((x, *y) for b in batches for x, *y in zip(b["bucket"].to_pylist(), b["base"].to_pylist(), b["keys"], b["at"], b["more"]))
    keys, at, more, held = [], [], [], 0
    for _, own in itertools.groupby(rows, lambda x: x[0]):
        if held >= ENTRIES:
            yield np.concatenate(keys), np.concatenate(at), np.concatenate(more)
            keys, at, more, held = [], [], [], 0
        for _, base, k, a, m in own:
            keys.append(np.frombuffer(k.as_buffer(), np.uint64))
            place = a.as_buffer()
            at.append(np.frombuffer(place, np.uint64 if place.size == 8 * len(keys[-1]) else np.uint32).astype(np.int64) + base)
            more.append(np.frombuffer(m.as_buffer(), np.uint32) if m.is_valid else np.zeros(len(keys[-1]), np.uint32))
            held += len(keys[-1])
    if held:
        yield np.concatenate(keys), np.concatenate(at), np.concatenate(more)


def _bucket_of(x: np.ndarray) -> np.ndarray:
    return (mix64(x.astype(np.uint64) ^ np.uint64(GOLDEN)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def shared_tokens(sets: DataFrame, least: Callable[[np.ndarray], np.ndarray], with_tokens: bool) -> DataFrame:
    """(node, n, tokens, df) of the sets (row, n, low) of which at least least(n) members are in others: those members, rare first, and in how many sets each is.

    Members go to the buckets of their hashes, packed, and what is shared comes back to the buckets of the sets; a task holds
    a few buckets at a time. Without with_tokens only its number comes back, and tokens and df are empty.
    """

    def by_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["low"], 8 * ENTRIES):
                low = batch["low"].slice(a, b - a).to_pylist()
                tokens = np.frombuffer(b"".join(low), np.uint64)
                at = np.repeat(batch["row"].to_numpy()[a:b], [len(x) // 8 for x in low])
                out = _packed(_bucket_of(tokens), tokens, at, np.zeros(len(tokens)))
                yield out.set_column(4, "more", pa.nulls(out.num_rows, pa.binary()))

    def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, rows, _ in _unpacked(batches):
            order = np.argsort(tokens, kind="stable")
            tokens, rows = tokens[order], rows[order]
            first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] ^ np.uint64(1)) != 0)
            df = np.repeat(np.diff(first, append=len(tokens)), np.diff(first, append=len(tokens)))
            keep = df > 1
            if not keep.any():
                continue
            if with_tokens:
                yield _packed(_bucket_of(rows[keep]), tokens[keep], rows[keep], df[keep])
            else:
                some, k = np.unique(rows[keep], return_counts=True)
                yield _packed(_bucket_of(some), k.astype(np.uint64), some, np.ones(len(some)))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, n = batch["row"].to_numpy(), batch["n"].to_numpy()
                yield _packed(_bucket_of(rows), n.astype(np.uint64), rows, np.zeros(len(n)))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows, df in _unpacked(batches):
            is_size = df == 0
            order = np.argsort(rows[is_size])
            known, n_of = rows[is_size][order], keys[is_size][order].astype(np.int64)
            tokens, rows, df = keys[~is_size], rows[~is_size], df[~is_size]
            nodes, inverse, counts = np.unique(rows, return_inverse=True, return_counts=True)
            if not with_tokens:
                counts = np.bincount(inverse, weights=tokens.astype(np.float64), minlength=len(nodes)).astype(np.int64)
            n = n_of[np.searchsorted(known, nodes)] if len(nodes) else np.zeros(0, np.int64)
            live = counts >= least(n)
            if with_tokens:
                order = np.lexsort((tokens, df, inverse))
                order = order[live[inverse[order]]]
                ends = np.concatenate([[0], np.cumsum(counts[live])])
            else:
                order, ends = np.zeros(0, np.int64), np.zeros(int(live.sum()) + 1, np.int64)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[live]), pa.array(n[live]), lists(tokens[order].view(np.int64)), lists(df[order].astype(np.int32))], names=["node", "n", "tokens", "df"])

    postings = sets.select("row", "low").mapInArrow(by_token, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    found = postings.mapInArrow(by_set, PACKED)
    every = sets.select("row", "n").mapInArrow(sizes, PACKED)
    return found.union(every).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(select, "node long, n long, tokens array<long>, df array<int>")


def boundary(shared: DataFrame) -> int:
    """The set size up to which pairs of shingles are enumerated, as a power of two, where the two costs together are least.

    An entry of a list is emitted once and scanned against the list's other entries, but never more than LIST_ROWS of them: the sets
    of longer lists meet a pivot and one set of the largest component, not each other.
    """
    lists = F.aggregate(F.slice("df", 1, F.col("p")), F.lit(0).cast("long"), lambda a, x: a + F.least(x, F.lit(LIST_ROWS)))
    costs = shared.withColumn("p", F.size("tokens") - _least() + 1).groupBy(F.floor(F.log2("n")).alias("level"))
    rows = sorted(costs.agg(F.sum(F.col("p") * (F.col("p") + 1) / 2).alias("subsets"), F.sum(F.col("p") + lists * SCAN_COST).alias("lists")).collect())  # a row for each power of two
    best, at = sum(r["lists"] for r in rows), 0
    total = best
    for r in rows:
        total += r["subsets"] - r["lists"]
        if total < best:
            best, at = total, 2 ** (r["level"] + 1) - 1
    return at


def _least():
    return F.floor((F.col("n") * 4 + 4) / 5).cast("int")


def signatures(shared: DataFrame, light: int) -> DataFrame:
    """(sig, at, node, n): any linked pair has a sig in common; `at` counts a set's of either kind from 0, rarest first.

    Sets of at most `light` shingles give pairs of shingles, larger ones and those that may link to them single shingles.
    """
    prefix = lambda more: F.slice("tokens", 1, F.greatest(F.lit(0), F.size("tokens") - _least() + more))
    single = shared.where(F.col("n") >= -(-4 * light // 5)).select(F.posexplode(prefix(1)).alias("at", "sig"), "node", "n").select("sig", "at", "node", "n")
    ends = shared.where(F.col("n") <= light).withColumn("p", prefix(2)).select("node", "n", "p", F.posexplode("p").alias("j", "b")).where("j > 0")
    pairs = ends.select("node", "n", "j", "b", F.posexplode(F.slice("p", 1, F.col("j"))).alias("i", "a"))
    return single.unionByName(pairs.select(F.xxhash64("a", "b").alias("sig"), F.expr("cast(j * (j - 1L) / 2 + i as int)").alias("at"), "node", "n"))


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, low): all shingle hashes, packed, of the documents of (node, doc_id, f1, f2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part["text"], WORDS)
                same = [i for i, s in enumerate(sets) if fingerprint(s) == (part["f1"][i].as_py(), part["f2"][i].as_py())]
                yield pa.RecordBatch.from_arrays([part["node"].take(pa.array(same, pa.int64())), pa.array([len(sets[i]) for i in same], pa.int64()), pa.array([sets[i].tobytes() for i in same], pa.binary())], names=["node", "n", "low"])

    wanted = join_counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), nodes, ["doc_id"], "inner")
    return wanted.select("node", "f1", "f2", "text").mapInArrow(work, "node long, n long, low binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link. Each side's sets are shuffled once to the pairs; batches of them are intersected."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 80 * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("low").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("low").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _near(a: str, b: str):
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def _differences(spots: DataFrame, sets: DataFrame) -> DataFrame:
    """(main, node, n, c, d): the shingles that are in one only of the sets of node and main."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [np.setxor1d(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)) for x, y in zip(batch["x"], batch["y"])]
            out = batch.select(["main", "node", "n", "c"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(apart, pa.list_(pa.int64()))], names=[*out.schema.names, "d"])

    both = spots.join(sets.select("node", F.col("low").alias("x")), "node").join(sets.select(F.col("node").alias("main"), F.col("low").alias("y")), "main")
    return both.select("main", "node", "n", "c", "x", "y").mapInArrow(work, "main long, node long, n long, c long, d array<long>")


def _joined(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """tokens with the components of the edges (u, v) between its components in the place of `c` and `top`."""
    labels = cut(connected_components(edges, "u", "v"))
    for c in ("c", "top"):
        tokens = tokens.join(labels.select(F.col("id").alias(c), F.col("component").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return cut(tokens)


def _apart(tokens: DataFrame) -> Row:
    """sets: how many there are of all `main`; pairs: a bound on those of them in different components that share a token."""

    def across(parts: DataFrame, *of: str) -> DataFrame:
        sums = parts.groupBy(*of, "c").agg(F.count("*").alias("k")).groupBy(*of).agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("inside"))
        return sums.withColumn("pairs", (F.col("k") * F.col("k") - F.col("inside")) / 2)

    by_sets = across(tokens.select("main", "node", "c").distinct(), "main")
    by_tokens = across(tokens, "main", "t").groupBy("main").agg(F.sum("pairs").alias("met"))
    both = by_sets.join(by_tokens, "main").agg(F.sum("k").alias("sets"), F.sum(F.least("pairs", "met")).alias("pairs"))
    return both.select(F.coalesce("sets", F.lit(0)).alias("sets"), F.coalesce("pairs", F.lit(0.0)).alias("pairs")).first()


def near_reference(spots: DataFrame, sets: DataFrame, votes: int = 4, list_rows: int = LIST_ROWS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Links, pairs yet to be verified, and pairs verified on the way, among the sets (node, n, c) of each `main`, told apart by how they differ from it.

    With D the difference of a set from main's, two sets link when |Da| + |Db| - 2 |Da & Db| <= (na + nb) / 9. Those that link
    whatever they share all link to the set of least 9 |D| - n. All others share a member of D, and at least |Da| - na / 4 of them,
    so each gives its rarest such members to a join. Copies of one text differ from it in little, and not in the same places.
    The first member that two sets share is followed in both by all others they share, so it counts only where enough follow it;
    what a pair shares is then at least its counted members, and at most those and the fewer of what follows the last of them.
    A large group would still give pairs by the square of its size. So while there may be more than `list_rows` pairs for each
    set, every member of D picks one of its sets, each set is compared with the `votes` picked ones it meets most often, and those
    that link become one component, inside which no pair is looked at. A round that leaves more than nine tenths of the pairs is the last.
    """
    apart = cut(_differences(spots, sets)).withColumn("m", F.size("d"))
    apart = apart.withColumn("far", 9 * F.col("m") - F.col("n"))
    hub = apart.groupBy("main").agg(F.min_by(F.struct("node", "c", "far"), F.struct("far", "node")).alias("hub"))
    star = apart.join(hub, "main").where((F.col("c") != F.col("hub.c")) & (F.col("far") + F.col("hub.far") <= 0))
    links = cut(star.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"), F.col("c").alias("u"), F.col("hub.c").alias("v")))
    tokens = apart.select("main", "node", "n", "c", "m", F.explode("d").alias("t"))
    tokens = tokens.join(tokens.groupBy("main", "t").agg(F.count("*").alias("df")).where("df > 1"), ["main", "t"])
    own, need = Window.partitionBy("main", "node"), F.greatest(F.lit(1), F.ceil(F.col("m") - F.col("n") / 4)).cast("int")
    tokens = tokens.withColumns({"rest": need - 1, "k": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("df", "t"))})
    tokens = tokens.where(F.col("rank") + F.col("rest") <= F.col("k")).select("main", "t", "node", "n", "c", "m", (F.col("k") - F.col("rank")).alias("after"))
    tokens = _joined(tokens.withColumn("top", F.col("main")), links)
    fields = ("node", "n", "c", "m", "after")
    side = lambda x: tokens.select("main", "t", "top", *[F.col(c).alias(f"{c}_{x}") for c in fields])
    needed = 9 * (F.col("m_a") + F.col("m_b")) - F.col("n_a") - F.col("n_b")  # 18 times what a pair must share
    follow = F.least("after_a", "after_b")
    may_link = (F.col("c_a") != F.col("c_b")) & _near("n_a", "n_b") & (18 * (follow + 1) >= needed)
    some = tried = last = None
    for seed in itertools.count():
        size = _apart(tokens)
        if size["pairs"] <= list_rows * size["sets"] or last is not None and size["pairs"] > 0.9 * last:
            break
        last = size["pairs"]
        some = cut(join_counted(sets, spots.select("node").distinct(), ["node"], "left_semi")) if some is None else some
        pivots = tokens.groupBy("main", "t").agg(F.min_by(F.struct(*fields), F.xxhash64("node", "t", F.lit(seed))).alias("p"))
        met = side("a").join(pivots.select("main", "t", *[F.col(f"p.{c}").alias(f"{c}_b") for c in fields]), ["main", "t"]).where(may_link).groupBy(*[f"{c}_{x}" for c in ("node", "c") for x in "ab"]).agg(F.count("*").alias("k"))
        best = met.withColumn("rank", F.row_number().over(Window.partitionBy("node_a").orderBy(F.desc("k"), "node_b"))).where(F.col("rank") <= votes)
        pairs = best.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.col("c_a").alias("u"), F.col("c_b").alias("v")).dropDuplicates(["a", "b"])
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        new = cut(pairs.join(verified(pairs.select("a", "b"), some), ["a", "b"]))
        links, tokens = links.union(new), _joined(tokens, new)
    pairs = side("a").where("c_a != top").join(side("b").drop("top"), ["main", "t"]).where(may_link & F.expr("c_b = top or node_a < node_b"))
    pairs = pairs.groupBy("main", *[f"{c}_{x}" for c in ("node", "n", "m") for x in "ab"]).agg(F.count("*").alias("k"), F.min(follow).alias("more"))
    pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), (needed - 18 * F.col("k")).alias("short"), "more")
    pairs = cut(pairs.where("short <= 18 * more"))
    return links.select("a", "b").union(pairs.where("short <= 0").select("a", "b")), pairs.where("short > 0").select("a", "b"), tried


def link_components(sigs: DataFrame, sets: DataFrame, rounds: int = 2, votes: int = 4, list_rows: int = LIST_ROWS) -> DataFrame:
    """(id, component) of the sets on a link, never looking at all pairs of one list.

    In a few rounds each set is compared with one pivot: of the pivots of its first `votes` lists, of which every list picks one
    by hash, that which most of them picked. Groups of near copies so fall into few components. Then, in all lists with several
    components left, one for all lists of the same members, the members outside the largest meet those of the other components: pair by pair in lists of at most
    `list_rows`, and by their differences from one set of the largest component in longer ones.
    """
    labels, links, tried = None, None, None
    some = cut(sigs.where(F.col("at") < votes))
    for seed in range(rounds):
        members = some.withColumn("c", F.col("node")) if labels is None else some.join(labels, F.col("node") == F.col("id"), "left").select("sig", "node", "n", F.coalesce("component", "node").alias("c"))
        group = members.groupBy("sig").agg(F.min_by(F.struct("node", "n", "c"), F.xxhash64("node", "sig", F.lit(seed))).alias("p"), F.count("*").alias("k")).where("k > 1")
        edges = members.join(group.select("sig", "p"), "sig").where((F.col("c") != F.col("p.c")) & _near("n", "p.n"))
        best = edges.groupBy("node", F.col("p.node").alias("pivot")).agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("pivot", F.struct("k", "pivot")).alias("pivot"))
        pairs = cut(best.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
        new = verified(pairs, sets)
        links = cut(new if links is None else links.union(new))
        tried = pairs if tried is None else tried.union(pairs)
        labels = cut(connected_components(links))
    members = cut(sigs.join(labels, F.col("node") == F.col("id"), "left").select("sig", "node", "n", F.coalesce("component", "node").alias("c")))
    marks = {"x": F.xxhash64("node"), "y": F.xxhash64("node", F.lit(1))}  # 128 bits of a list's members, whatever their order
    sizes = members.groupBy("sig", "c").agg(F.count("*").alias("k"), *[F.bit_xor(v).alias(k) for k, v in marks.items()])
    # ties are broken alike in all lists, so that lists of the same sets agree on one component
    main = sizes.groupBy("sig").agg(F.max_by("c", F.struct("k", F.xxhash64("c"), "c")).alias("main"), F.count("*").alias("groups"), F.sum("k").alias("k"), *[F.bit_xor(k).alias(k) for k in marks])
    # of the lists of the very same sets one is enough
    main = main.where("groups > 1").groupBy("k", *marks).agg(F.min_by(F.struct("sig", "main"), "sig").alias("one")).select("one.sig", "one.main", "k")
    open_lists = cut(members.join(main, "sig"))
    near, unsure, seen = near_reference(open_lists.where(F.col("k") > list_rows).select("node", "n", "c", "main").distinct(), sets, votes, list_rows)
    short = open_lists.where(F.col("k") <= list_rows)
    outside = short.where("c != main").select("sig", F.col("node").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    pairs = outside.join(short.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb")), "sig")
    pairs = pairs.where((F.col("ca") != F.col("cb")) & _near("na", "nb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(pairs.union(unsure).distinct().join(tried if seen is None else tried.union(seen), ["a", "b"], "left_anti"))
    return connected_components(cut(links.union(near).union(verified(pairs, sets))))


def similarity_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: the smallest doc_id reachable over links of similarity 0.8 or more.

    Null and empty texts have empty sets and link to nothing. Repeated texts share a set and so a component; rows that share a
    doc_id each get a row. A row with null doc_id links to nothing and its component_id is null. Other columns are left out. No
    rows: no rows. Sets are told apart by 128 bits, shingles within a pair by 64.
    """
    spark = docs.sparkSession
    sketch(docs).write.parquet(path := scratch(spark, "sketch"))
    sketches = spark.read.parquet(path)
    filled = sketches.where("n > 0 and doc_id is not null").select("row", "doc_id", "n", "f1", "f2")
    reps = cut(filled.groupBy("f1", "f2").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    copies = filled.join(reps.where("copies > 1").select("f1", "f2", "node"), ["f1", "f2"]).where("row != node").select("row")
    prefixes = join_counted(sketches.where("low is not null and doc_id is not null").select("row", "n", "low"), copies, ["row"], "left_anti")
    active = cut(shared_tokens(prefixes, least_in_prefix, with_tokens=False).select("node"))
    wanted = sketches.select(F.col("row").alias("node"), "doc_id", "f1", "f2").join(active, "node")
    sets = cut(full_sets(docs, wanted).dropDuplicates(["node"]))
    shared = cut(shared_tokens(sets.withColumnRenamed("node", "row"), least_in_set, with_tokens=True))
    sigs = cut(signatures(shared, boundary(shared)))
    labels = link_components(sigs, sets)
    named = reps.join(labels, F.col("node") == F.col("id"), "left").withColumn("c", F.coalesce("component", "node"))
    smallest = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "c").select("f1", "f2", "component_id")
    linked = filled.join(named, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sketches.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
