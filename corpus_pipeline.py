"""A corpus from raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import exact, mixing, near, packing, quality
from tabloom.llm.queries import MIXTURE, tokenizer_path, with_domain
from tabloom.llm.storage import ship_package, stored, whole_text


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labels that are not held out."""
    ship_package(spark)
    return quality.accepted(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: that with the largest id, once even if its row is repeated."""
    ship_package(spark)
    owners = stored(exact.exact_groups(docs, keep="largest").where("kept").select("doc_id", "text_sha256"), "pipeline-owners")
    named = docs.withColumn("_sha", F.sha2(whole_text(), 256))
    kept = named.join(
        owners.distinct().select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_sha")), "_sha"
    ).where(F.col("doc_id").eqNullSafe(F.col("_kept_id"))).drop("_kept_id")
    if not owners.groupBy("text_sha256").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_sha"])
    return kept.select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five words, similarity 0.8): that with the smallest id."""
    ship_package(spark)
    return near.near_kept(docs, near.NearSpec(k=5, num=80, den=100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mixture, once for each epoch in which they are read."""
    ship_package(spark)
    named = with_domain(docs)
    chosen = mixing.mixed_documents(named, MIXTURE, budget=1.0, max_epochs=4, with_key=True)
    return mixing.mixed_rows(named, chosen).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2,048 tokens."""
    ship_package(spark)
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality", classify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack),
]

#: The classifier, minhashes and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written to the shared folder, read by the next and
    removed when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
