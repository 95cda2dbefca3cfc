"""The corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark text goes, personal data is masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deepledger.llm import decontaminate, jaccard, packing, pii, toxicity
from deepledger.llm.common import cut, join_counted, scratch, table
from deepledger.llm.queries import tokenizer_path

#: Documents at least so likely toxic are rejected.
TOXIC = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, does not hold to be toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model).where(F.col("p_toxic") < TOXIC).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies, once; those of no group; all of null doc_id.

    Of rows that share that doc_id the least stays, by the hash of all columns and then by the columns in turn.
    """
    groups = cut(jaccard.similarity_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")))
    kept = join_counted(docs, groups.where("doc_id != component_id").select("doc_id"), ["doc_id"], "left_anti")
    repeated = groups.where("doc_id = component_id and rows > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = join_counted(kept, repeated, ["doc_id"], "left_semi").select("doc_id", F.struct(F.xxhash64(*docs.columns).alias("order"), F.struct(*docs.columns).alias("row")).alias("all"))
    once = again.groupBy("doc_id").agg(F.min("all").alias("all")).select(*[F.col("all")["row"][c].alias(c) for c in docs.columns])
    return join_counted(kept, repeated, ["doc_id"], "left_anti").unionByName(once)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 80 % of the shingles of every benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted anew."""
    masked = pii.detect_pii(docs).withColumns({"text": F.col("pii_text"), "n_chars": F.coalesce(F.char_length("pii_text").cast("long"), F.col("n_chars"))})
    return masked.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    pieces = packing.tokenize_pieces(docs, tokenizer_path())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A fitted model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, name))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
