"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deepledger.llm.common import cut

#: Vectors of a block, blocks of a shard and queries of a batch: what one step scores and what one task holds.
BLOCK, SHARD_BLOCKS, BATCH = 256, 64, 4096
SCHEMA = "query_id long, vec_id long, score long"


def quantize(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each component, as double before; vectors null or with null or non-finite components are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(fit & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("terms"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def search_shard(queries: pd.DataFrame, docs: pd.DataFrame, k: int, exact_bits: int = 53) -> pd.DataFrame:
    """The k best documents of one shard for each query of one batch: score descending, then vec_id.

    A block's bound for a query is the sum over terms of the larger of q*max and q*min. Blocks are visited by descending bound
    and scored through their forward index (the block's term rows) until the next bound is below the query's kth score.
    Sums stay exact in doubles below 2**53; larger ones take Python integers.
    """
    width = max(map(len, [*queries["terms"], *docs["terms"]]), default=0)
    q, d = _matrix(queries["terms"], width), _matrix(docs["terms"], width)
    if len(q) and len(d) and width and np.log2(max(1, np.abs(q).max())) + np.log2(max(1, np.abs(d).max())) + np.log2(width) >= exact_bits:
        q, d = (np.array([[*map(int, x)] + [0] * (width - len(x)) for x in t], object).reshape(-1, width) for t in (queries["terms"], docs["terms"]))
    ids, own = docs["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    blocks = [slice(i, i + BLOCK) for i in range(0, len(d), BLOCK)]
    top, low = np.stack([d[b].max(0) for b in blocks]), np.stack([d[b].min(0) for b in blocks])
    positive, negative = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
    bounds = positive @ top.T + negative @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list] = [[] for _ in q]  # (-score, vec_id), ascending
    live = np.arange(len(q))
    for step in range(len(blocks)):
        # queries whose next bound may still reach their kth score; those at the same block are scored together
        at = order[live, step]
        may = np.array([len(best[i]) < k or bounds[i, b] >= -best[i][-1][0] for i, b in zip(live, at)], bool)
        live, at = live[may], at[may]
        if not len(live):
            break
        for b in np.unique(at):
            rows = live[at == b]
            scores = q[rows] @ d[blocks[b]].T
            here = ids[blocks[b]]
            for i, s in zip(rows, scores):
                n = min(len(s), k + 1)
                kth = np.partition(s, len(s) - n)[len(s) - n] if len(s) > n else s.min()
                if len(best[i]) == k:
                    kth = max(kth, -best[i][-1][0])
                hit = np.flatnonzero(s >= kth)
                best[i] = sorted(best[i] + [(-int(s[j]), int(here[j])) for j in hit if here[j] != own[i]])[:k]
    rows = [(int(own[i]), v, -s) for i, found in enumerate(best) for s, v in found]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best of all vectors but its own id; ties to the smaller vec_id.

    Both have (vec_id, terms), terms an array of integers; a shorter array counts as ending in zeros. Repeated ids on the vectors'
    side compete as rows of their own; repeated queries count once. Fewer vectors than k: all. Empty sides: no rows.
    Vectors, ordered by id, form shards of SHARD_BLOCKS blocks, and queries form batches; each (batch, shard) pair is a task's
    group of bounded size, and a query's candidates, k from each shard, meet in a window.
    """
    vectors, queries = cut(vectors.select("vec_id", "terms")), queries.select("vec_id", "terms").dropDuplicates(["vec_id"])
    n, m = vectors.count(), queries.count()
    shards, batches = max(1, -(-n // (BLOCK * SHARD_BLOCKS))), max(1, -(-m // BATCH))
    # even document ranges without a global window: a range partition per shard
    ranged = vectors.repartitionByRange(shards, "vec_id", F.xxhash64("terms")).withColumn("shard", F.spark_partition_id())
    bounds = ranged.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    if bounds > 4 * BLOCK * SHARD_BLOCKS:  # many rows of one id
        ranged = vectors.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    batched = queries.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches)))
    left = batched.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("batch", "shard")
    right = ranged.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long")))).groupBy("batch", "shard")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        return search_shard(a, b.sort_values("vec_id"), k)

    found = left.cogroup(right).applyInPandas(search, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
