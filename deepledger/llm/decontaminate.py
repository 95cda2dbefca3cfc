"""Benchmark decontamination: containment search of short items inside long documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deepledger.llm.common import BROADCAST_ROWS, cut, join_counted

WORDS = 5


def _words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _shingled(rows: DataFrame, width: int) -> DataFrame:
    """rows, with `words` exploded to its shingles of `width` words: w0 to w4 (empty beyond width) and their hash."""
    count = F.size("words") - (width - 1)
    each = F.arrays_zip(*[F.slice("words", i + 1, count).alias(f"w{i}") for i in range(width)])
    kept = [c for c in rows.columns if c != "words"]
    out = rows.where(F.size("words") >= width).select(*kept, F.inline(each).alias(*[f"w{i}" for i in range(width)]))
    out = out.withColumns({f"w{i}": F.lit("") for i in range(width, WORDS)})
    return out.withColumn("hash", F.xxhash64(*[f"w{i}" for i in range(WORDS)]))


GRAM = [f"w{i}" for i in range(WORDS)]


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, width, size, hash, rank, w0..w4): each item's distinct shingles by ascending hash. Of fewer words, the item is one shingle."""
    rows = items.where("item_id is not null").select("item_id", _words("text").alias("words")).withColumn("width", F.least(F.size("words"), F.lit(WORDS)))
    every = None
    for width in range(1, WORDS + 1):
        one = _shingled(rows.where(F.col("width") == width), width)
        every = one if every is None else every.unionByName(one)
    own = Window.partitionBy("item_id")
    every = every.dropDuplicates(["item_id", *GRAM]).withColumn("size", F.count("*").over(own))
    return every.withColumn("rank", F.row_number().over(own.orderBy("hash", *GRAM)))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) where a document holds at least `percent` of an item's distinct shingles.

    An item's signature is its m = size - ceil(percent * size) + 1 smallest hashes (a bottom-m MinHash sketch): a document that
    holds enough of the item holds one of them, so nothing is missed. Documents are partitioned by size, in powers of two. A
    partition's sketch keeps the hashes up to the largest signature hash of the items that can fit into it, so a document gives
    only that share of its shingles to the join. Candidates are then verified on the words of all their shingles.

    Null or empty texts hold nothing and are in nothing. Shingles of rows that share a doc_id add up, once one row alone is long
    enough for the item; those of an item_id add up likewise. Null ids take no part. Shorter documents than an item's shingle hold none. Other columns are left out. Empty tables: no rows.
    """
    shingles = cut(item_shingles(items))
    need = F.ceil(F.col("size") * percent / 100)
    signature = shingles.where(F.col("rank") <= F.col("size") - need + 1).select("hash", "item_id", "size", "width")
    small = signature.count() <= BROADCAST_ROWS
    # a row for each width and power of two: the smallest partition that an item of this signature fits in, and the largest hash
    tops = signature.groupBy("width", F.floor(F.log2(need.cast("double"))).cast("int").alias("level")).agg(F.max("hash").alias("top")).collect()
    rows = docs.where("doc_id is not null").select("doc_id", _words("text").alias("words"))
    found = None
    for width in sorted({r["width"] for r in tops}):
        levels = {r["level"]: r["top"] for r in tops if r["width"] == width}
        level = F.floor(F.log2(F.col("most").cast("double"))).cast("int")
        top = F.lit(None).cast("long")
        for at in sorted(levels):
            top = F.when(level >= at, F.lit(max(v for k, v in levels.items() if k <= at))).otherwise(top)
        sized = rows.withColumn("most", F.size("words") - (width - 1)).where("most > 0").withColumn("top", top).where("top is not null").select("doc_id", "words", "top")
        sketch = _shingled(sized, width).where(F.col("hash") <= F.col("top")).select("doc_id", "hash")
        side = signature.where(F.col("width") == width).select("hash", "item_id")
        one = sketch.join(F.broadcast(side) if small else side, "hash").select("doc_id", "item_id")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return shingles.select(F.lit(None).cast("long").alias("doc_id"), "item_id", F.lit(0).cast("long").alias("item_shingles"), F.lit(0).cast("long").alias("shared"), F.lit(0.0).alias("containment")).limit(0)
    candidates = cut(found.distinct())
    texts = join_counted(rows, candidates.select("doc_id").distinct(), ["doc_id"], "inner")
    wanted = join_counted(shingles.select("item_id", "size", "hash", "width", *GRAM), candidates.select("item_id").distinct(), ["item_id"], "left_semi")
    wanted = cut(wanted)
    held, small = None, wanted.count() <= BROADCAST_ROWS
    for width in sorted({r["width"] for r in tops}):
        side = wanted.where(F.col("width") == width).drop("width")
        one = _shingled(texts, width).join(F.broadcast(side) if small else side, ["hash", *GRAM]).select("doc_id", "item_id", "size", *GRAM)
        held = one if held is None else held.unionByName(one)
    counted = held.distinct().groupBy("doc_id", "item_id", F.col("size").alias("item_shingles")).agg(F.count("*").alias("shared"))
    return counted.where(F.col("shared") * 100 >= F.col("item_shingles") * percent).withColumn("containment", F.col("shared") / F.col("item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents that hold at least `percent` of an item. Rows with null doc_id stay."""
    return join_counted(docs, contained_items(docs, items, percent).select("doc_id").distinct(), ["doc_id"], "left_anti")
