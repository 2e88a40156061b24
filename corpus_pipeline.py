"""The corpus pipeline: four stages over ``documents``, each written and read again.

1. quality rules: documents that the rules or the robust outlier test reject go;
2. n-gram Jaccard join: one document of each group of near copies stays, that with the
   smallest id;
3. benchmark decontamination: documents that hold benchmark items go;
4. SentencePiece: the remaining texts, encoded and decoded (the last stage's result).

Each stage takes all that its predecessor kept. Rows with a null ``doc_id`` pass the
stages that decide by id. Where rows share a ``doc_id``, stage 1 judges each row, stage 2
keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.llm import mcd, ngram_join, sentencepiece_bpe, templates
from revisit.llm.shared import give_back, keep, named


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. Rows are matched by 128 bits of id and text, so
    rows that share an id are judged apart, in a column that no document has."""
    columns, key = docs.columns, "row_key"
    while key in map(str.lower, columns):
        key += "_"
    bits = [F.hex(F.xxhash64(F.lit(salt), "doc_id", "text")) for salt in (1, 2)]
    keyed = docs.withColumn(key, F.concat_ws("-", *bits))
    verdict = mcd.judge(keyed, carry=(key,))
    rejected = verdict.filter(~F.col("kept")).select(key).distinct()
    return keyed.join(rejected, key, "left_anti").select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    classes = keep(ngram_join.near_duplicates(docs), "pipeline-classes")
    copies = classes.filter("doc_id != component_id").select("doc_id").distinct()
    # Ids that several rows share are one document: one of their rows stays.
    shared = (classes.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("doc_id"))
    alone = docs.join(copies.unionByName(shared), "doc_id", "left_anti").select(*docs.columns)
    first = (docs.join(shared, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id"))
             .agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return alone.unionByName(first)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = templates.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every remaining text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.digest_columns(sentencepiece_bpe.encode_decode(docs, model))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", one_of_each_group),
          ("benchmark decontamination", without_benchmark), ("SentencePiece", tokens)]

ORACLE_SQL = None  # no stage but the last can be told in SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder,
    and what a stage wrote on its way there is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = named()
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        give_back(spark, before, docs)
    return docs
