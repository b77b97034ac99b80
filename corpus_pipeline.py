"""The corpus pipeline: reject low quality, drop repeated lines, keep one of near copies, mix the sources, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents.
run() writes each stage's result as Parquet in the shared folder and reads it for the next. Nulls, empty texts and
tables, and repeated rows are treated as the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import line_dedup, mixing, packing, quality, simhash
from folio.llm.queries import word_tokenizer
from folio.llm.store import materialize

#: No SQL expresses these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from labels of these documents."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 40 and more characters that five documents hold, but for the last of these."""
    out = line_dedup.cleaned(docs, least=40, documents=5)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies; of repeated rows one.

    Texts link whose sets of five-word shingles have a likeness (Jaccard) of 0.8 or more; all such pairs are found.
    """
    return simhash.one_of_each(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mix(docs, cycle=(3, 1, 2), share=1.5, max_epochs=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, word_tokenizer(), capacity=4096)


STAGES = [("quality", reject), ("line dedup", lines), ("near-dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
