"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of ``documents``. Stages judge rows, not ids: rows with
a null doc_id and repeated rows pass through each stage like all others, except that the duplicate
stage keeps one row of each doc_id that it keeps, by a rule that no partitioning changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontam, jaccard_join, pii, quality
from loomgraph.llm.common import bounded_batches
from loomgraph.llm.queries import WORD_BPE
from loomgraph.tables import drop_folder, settle, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the current policy accepts; columns named like measures stay as they are."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    judged = quality.apply_policy(quality.rule_ledger(docs.withColumnsRenamed(own), own["text"]), "v1")
    return judged.where("kept").select(*own.values()).withColumnsRenamed({new: old for old, new in own.items()})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones: that with the smallest doc_id.

    Of several rows with that doc_id the one with the smallest text stays, then the one with the
    smallest hash. A row without doc_id goes if a document with one is in its group; in a group
    of such rows alone, one stays by the same rule. Rows without words all stay, one for each doc_id.
    """
    bounded_batches(spark)
    order = F.struct("text", F.xxhash64(*[c for c in docs.columns if c != "text"]))
    row = F.struct(*docs.columns).alias("__row")
    found = settle(jaccard_join.similar_documents(docs, classes_too=True), "similar")
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("__row")).select("__row.*")
    lone = jaccard_join.with_class(docs.where(F.col("doc_id").isNull()), "text", "__class")
    groups = found.where("class is not null").groupBy("class").agg(F.first("group").alias("__group"), F.first("component_id").alias("__owner"))
    lone = lone.join(groups.withColumnRenamed("class", "__class"), "__class", "left").where("__owner is null")
    copies = lone.where("__group is not null").groupBy("__group").agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return named.unionByName(copies).unionByName(lone.where("__group is null").select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold too much of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.decontaminate(docs, benchmark, clean_only=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the names of their kinds."""
    tagger = pii.train(docs.select("doc_id", "text"), "doc_id", "text")
    return pii.redact(docs, tagger, length="n_chars" if "n_chars" in docs.columns else None)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text; documents with their numbers of tokens and digests.

    With smaller caches than alone, and nothing kept from one partition to the next, as workers of the earlier stages are still there.
    """
    return bpe.bpe_encode_decode(docs, WORD_BPE, group_bytes=1 << 20, cache_words=40_000, keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", bpe_tokens),
]

#: The network of the PII stage and the encoder can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            drop_folder(spark, before)
        before = path
    return docs
