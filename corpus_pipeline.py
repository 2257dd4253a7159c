"""A corpus pipeline of five stages over documents: toxic documents go, one document of each near-duplicate group stays,
repeated passages go, contaminated documents go, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm import common, decontaminate, ngram_join, packing, substring_dedup, toxicity
from quantpanel.llm.queries import TOXIC_AT, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that toxicity scores at TOXIC_AT or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return common.without(docs, toxicity.score_toxicity(docs, labels).where(F.col("score") >= TOXIC_AT))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word-shingle Jaccard similarity 0.8 or more stays, that of the smallest doc_id.

    Documents without words link with nothing and stay, and so do rows with a null doc_id. Of rows that repeat a doc_id
    and its text the first by the values of all columns stays; other texts of a doc_id are documents of their own.
    """
    groups = common.store(ngram_join.jaccard_groups(docs, shingle_words=5, percent=80).where("doc_id is not null"), "groups")
    common.release(spark)
    left = common.without(docs, groups.where("not kept"))
    again = common.store(groups.where("kept").groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"), "repeated")
    if again.isEmpty():
        return left
    once = common.without(left, again)
    row = common.unused(docs, "row")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = left.select(F.struct(*columns).alias(row), F.col("doc_id"), F.xxhash64("text").alias("th")).join(again, ["doc_id", "th"], "left_semi")
    first = rows.groupBy("doc_id", "th").agg(F.min(row).alias(row)).select(f"{row}.*")
    return once.unionByName(first)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated 35-word windows go; the text and n_chars change, rows stay."""
    out = substring_dedup.cut_repeats(docs, window=35)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that benchmark passages contaminate go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return common.without(docs, decontaminate.contamination(docs, items).where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("near duplicates", near_duplicates), ("repeated passages", cut_repeats), ("decontamination", decontaminated), ("packing", packed)]
#: The fitted model and the packer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
