"""From raw documents to packed training windows; each stage is one operator of basalt.llm.

quality: documents that the decision list or the fixed limits reject go. near_dup: of each group of near
copies (five-word shingles, similarity 0.8) the document of the smallest doc_id stays (null: the last), of
rows that are equal in doc_id and text one. decontaminate: documents that hold a benchmark item go. secrets:
findings are replaced in the texts. packing: the pieces of packed windows. All stages but the last return the
columns of documents. Different texts under one doc_id, or under none, are separate documents throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import decontaminate, near_dup, packing, quality, secrets
from basalt.llm.common import table, written
from basalt.llm.queries import tokenizer_path

#: SQL can express neither the learned rules nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
KEY = "_pipeline_key"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality.judged(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).where("kept")
    return kept.select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of doc_id and text, in a column of a name of its own."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    near = near_dup.near_duplicates(keyed, width=5, low=80, matches=near_dup.least_matches(0.8), id_col=KEY)
    near = near.select(F.col("doc_id").alias(KEY), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    stay = keyed.select("doc_id", KEY).join(near, KEY).groupBy("component_id").agg(F.min(order)[KEY].alias(KEY)).select(KEY)
    return keyed.join(stay, KEY, "left_semi").dropDuplicates([KEY]).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY).select(F.col("doc_id").alias(KEY)).distinct()
    return keyed.join(found, KEY, "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.scan(docs).withColumn("text", secrets.redact())
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows of the documents that stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
