"""The queries of the corpus operators: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversation_trie, decontaminate, embedding_dedup, licences, mixing, ngram_join, packing, quality, substring_dedup, tokens, toxicity, warc

TOXIC_AT, QUALITY_AT = 0.3, 0.7


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())
    return tokens.read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_groups(table(spark, sf_dir, "documents", "doc_id", "text"), shingle_words=3, percent=90)
    return out.select("doc_id", F.col("n_shingles").cast("long"), "component_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), least=0.9)


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return out.select("doc_id", _held_out(), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", _held_out(), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).drop("th")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), window=35, texts=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source"), weights=(5, 2, 1))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_trie.prefix_nodes(conversation_trie.rebuilt(turns))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"))


def queries() -> dict:
    ops = (op1_token_output, op2_ngram_join, op3_embedding_dedup, op4_toxicity, op5_licence_scan, op6_quality, op7_best_fit_packing, op8_decontamination, op9_substring_dedup, op10_warc, op11_source_mix, op12_conversation_trie, op13_phrase_collocations)
    return {f.__name__: f for f in ops}
