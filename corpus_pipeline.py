"""The pipeline over documents: language ID, near duplicates, secrets, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes
each result as Parquet to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import bpe, jaccard_join, langid, mixing, secrets
from gavelflow.llm.common import WORD, Stage, forget

#: Texts that share next to nothing with any learned language's profile are in none of them.
MAX_DISTANCE = 0.97


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those far from every learned language; lang becomes the
    predicted one."""
    found = langid.identify(docs, langid.train(docs))
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("lang_distance") <= MAX_DISTANCE))
    return kept.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows: the one with the smallest doc_id, nulls last, and of several texts
    with that id the one whose hash is least; rows equal in both are one. Other groups' rows stay, whatever
    ids they share or lack, and so do all rows without words."""
    rows = jaccard_join.clusters(docs.select("doc_id", "text"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("_id"), F.col("t").alias("_k"))
    first = rows.where("cluster is not null").groupBy("cluster").agg(F.min(rank).alias("x")).select("x._id", "x._k")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no name can clash
    hashed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"))
    out = hashed.join(first, (F.col("t") == F.col("_k")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    out = out.dropDuplicates(["id", "t"]).unionByName(hashed.where(~F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))))
    return out.select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; no document goes."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, with repeats."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of the mix."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Profiles, the field, signatures and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Stage(spark) as stage:
        last = None
        for i, (_, apply) in enumerate(STAGES):
            out = stage.cut(apply(spark, docs, sf_dir), keep=i == len(STAGES) - 1)
            if last is not None:
                stage.drop(last)
            docs = last = out
    return docs
