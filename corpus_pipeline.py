"""A corpus from raw documents to packed sequences: each stage is an operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import common
from quillmere.llm.exact_dedup import without_copies
from quillmere.llm.ngram_join import ngram_join
from quillmere.llm.packing import best_fit_pack
from quillmere.llm.substring_dedup import substring_dedup
from quillmere.llm.toxicity import fit_lexicon, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on a bounded sample of labels, doesn't reject."""
    lexicon = fit_lexicon(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return without_toxic(docs, lexicon)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the document with the largest doc_id stays, once."""
    return without_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links the one with the smallest doc_id stays."""
    gone = common.written(ngram_join(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct(), "near-copies")
    maybe, clean = common.Filter(gone, "__hash").split(docs.withColumn("__own", F.xxhash64(common.text_of("text"))), "__own")
    left = maybe.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left_anti")
    return clean.unionByName(left).select(docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has leave the later ones; a document of which no word is left goes."""
    found = substring_dedup(docs).where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("kept_text").alias("__kept"))
    found = common.written(found.dropDuplicates(["__id", "__hash"]), "without-passages")
    maybe, clean = common.Filter(found, "__hash").split(docs.withColumn("__own", F.xxhash64(common.text_of("text"))), "__own")
    joined = maybe.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    joined = joined.where(F.col("__kept").isNull() | F.col("__kept").rlike(r"\S"))
    changed = {"text": F.coalesce("__kept", "text"), "n_chars": F.when(F.col("__kept").isNotNull(), F.length("__kept")).otherwise(F.col("n_chars"))}
    return clean.select(docs.columns).unionByName(joined.select([changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return best_fit_pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", drop_passages), ("best_fit_packing", pack)]

#: Similarity joins, alignment and packing can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
