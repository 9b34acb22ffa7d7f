"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm import decontaminate, langid, ngram_join, packing, secrets
from cellarium.llm.common import FILE_BYTES, in_files, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose language stays undecided, go."""
    return langid.keep_identified(docs, langid.fit_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id; of rows that share it, the one with the least hash
    of all columns. Rows without doc_id stay, as do texts without words. Columns may have any names."""
    joined = ngram_join.ngram_jaccard_join(docs)
    keep = joined.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(keep, docs["doc_id"] == F.col("_kept"), "left_semi")
    # rows of one id: the least hash stays, whatever the order they come in
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = rows.groupBy("doc_id").agg(F.min_by(whole, F.struct(F.xxhash64(whole), F.xxhash64(whole, F.lit(1)))).alias("_row"))
    kept = one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]).unionAll(docs.where("doc_id is null"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return in_files(kept, -(-size // FILE_BYTES))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; without documents or items nothing goes."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced, and n_chars counted anew where they were. Null and empty texts have none; no row goes."""
    return secrets.redact(docs, secrets.trained(docs))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, each in the proportions of the sources. A null or empty text is its end token; no documents,
    no sequences."""
    return packing.pack_mixture(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture_packing", mixture_packing),
]

ORACLE_SQL = None  # a trained model takes part; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
