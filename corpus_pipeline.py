"""A training-data pipeline over `documents`: quality, near duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, decontaminate, jaccard, quality, secret
from tracemill.llm.common import documents, materialize

#: What a secret becomes.
REDACTED = "[secret]"


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and its column's name. docs is a written table: read again, it gives the same rows the same numbers."""
    row = _free(docs, "row")
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go; the rules are learned from `labels` and this stage's input."""
    rules, verdict = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), _free(docs, "verdict")
    return quality.judge(docs, rules, name=verdict).where(F.col(verdict)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links join, one with the smallest doc_id stays, a null one last; rows without words all stay."""
    numbered, row = _numbered(docs)
    found = jaccard.jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text")).where("n_shingles > 0")
    found = materialize(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")))
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    several = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    grouped = materialize(found.join(several, "component").join(ids, "row"))
    keep = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    gone = materialize(grouped.join(keep, "row", "left_anti").select(F.col("row").alias(row)))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that is similar to a benchmark item go."""
    numbered, row = _numbered(docs)
    found = decontaminate.find_leaks(numbered.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = materialize(found.select(F.col("doc_id").alias(row)).distinct())
    return numbered.join(leaks, row, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan reports is replaced by REDACTED; overlapping spans are one. n_chars follows the text."""
    numbered, row = _numbered(docs)
    found = secret.find_secrets(numbered.select(F.col(row).alias("doc_id"), "text", "source", "lang"))
    found = materialize(found.where(F.size("marks") > 0).select(F.col("doc_id").alias("number"), "marks"))
    own = F.struct(*(numbered[c] for c in docs.columns)).alias("own")
    joined = numbered.select(F.col(row).alias("number"), own, F.col("text").cast("string").alias("text")).join(found, "number", "left")
    # (text so far, end of what is done) over the spans by start
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))

    def step(acc, mark):
        fresh = mark["start"] >= acc["done"]
        gap = F.substring(F.col("text"), (acc["done"] + 1).cast("int"), (mark["start"] - acc["done"]).cast("int"))
        return F.struct(F.when(fresh, F.concat(acc["out"], gap, F.lit(REDACTED))).otherwise(acc["out"]).alias("out"), F.greatest(acc["done"], mark["end"]).alias("done"))

    clean = F.aggregate("marks", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["done"] + 1).cast("int"), F.length("text"))))
    joined = joined.withColumn("clean", F.when(F.col("marks").isNull(), F.col("text")).otherwise(clean))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("marks").isNull(), F.col("own.n_chars")).otherwise(F.length("clean").cast("long"))} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return joined.select(*(new.get(c, F.col("own")[c]).alias(c) for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", token_ids),
]

#: SQL can express neither the learned rules nor the encoder; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
