"""A corpus from raw documents: clean, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, neardup, packing, spans, toxicity
from spanloom.llm.common import scratch, write


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the keys in the one column of ``keys``; rows with a null key stay."""
    gone = keys.toDF("__key").distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__key"), "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic (score below 0.5).

    Null and empty texts hold no word that counts, score the prior's bias and stay; so does every
    document if there are no labels. Rows with null or repeated keys are judged by their texts; an
    empty table stays empty; all columns of documents pass through, whatever else is in them.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(model)(F.col("text").cast("string")) < 0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, by shingles of five words and a similarity of 0.8: the one with the least doc_id.

    Documents without words (null, empty, blank) are equal, and one of them stays. Rows with a null
    key always stay, and so do all rows of a group's least key, whatever their texts. An empty
    table stays empty.
    """
    found = neardup.similar_groups(docs, shingle=5, similarity=0.8)
    return _without(docs, found.where("component < doc_id").select("doc_id"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentence spans that an earlier one has; n_chars follows the text.

    Every row stays; a null text stays null, and a null n_chars null. Earlier is told by doc_id,
    then by the text's hash; null keys come last. An empty table stays empty.
    """
    made = spans.drop_repeats(docs)
    return made.withColumn("n_chars", F.when(F.col("removed_chars") > 0, F.col("n_chars") - F.col("removed_chars")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, and so do rows with a null key. Of a repeated key all
    rows go if one of its texts holds an item. Without documents or items nothing goes.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontam.contaminated(docs, items).select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; a null or empty text is one piece, the end id."""
    made = packing.pack(docs, as_ids=False)
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages are a trained model, fingerprints and tokens, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"stage-{name}")
            write(docs, path)
            docs = spark.read.parquet(path)
    return docs
