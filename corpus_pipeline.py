"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens. Each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the columns of documents, the last one the tokens. What a
stage rejects is gone and what it changes is changed: n_chars follows the text. Rows with a null doc_id pass the stages like others; null texts
are judged as empty ones and stay null.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from tilewright.llm.jobs import checkpoint_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is under the threshold go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.grade(), quality.GRADES)
    scored = quality.score(docs.select(*COLUMNS), model, keep_text=True)
    return scored.filter(F.element_at("at_least", -1) >= quality.SELECT_FROM).withColumnRenamed("__text", "text").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; a document that has lost all its words goes."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    bare = (F.col("n_dropped") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return out.filter(~F.coalesce(bare, F.lit(False))).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays; of wholly repeated rows one. Linked: a Jaccard of 0.8 or more on shingles of 5 words."""
    groups = jaccard_join.link_components(docs, size=5, per_cent=80, tries=8)
    later = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    same = Window.partitionBy("doc_id", "__copy").orderBy("n_chars")
    left = docs.select(*COLUMNS, F.xxhash64("text").alias("__copy")).join(later, "doc_id", "left_anti")
    return left.withColumn("__at", F.row_number().over(same)).filter(F.col("doc_id").isNull() | (F.col("__at") == 1)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): the ids of each text, and whether they decode to its bytes."""
    vocabulary = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "text")
    back = bpe.decode(bpe.encode(own, vocabulary), vocabulary)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet to the shared folder and read again by the next."""
    at = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
