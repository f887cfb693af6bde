"""Exact deduplication by skew-safe combining: local, salted and global merges, each comparing whole contents.

1. Local and salted: rows are grouped by (digest, salt, text). Spark's map-side combine merges the copies within each
   task first, so a hot group leaves a task as one row per salt, and the salt deals it out to many reducers.
2. Global: the winners of all salts are grouped by (digest, text), dealt by digest.
3. Rows get their class by digest; only ids and digests move, and adaptive execution splits a hot digest's
   rows over tasks. Two different texts of one SHA-256 digest, which step 2 would show, raise an error.

Defined cases: null text counts as empty; of equal texts the row with the largest id stays; a null id loses to
any other; repeated rows (same id, same text) are the same document and all carry the same answer; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage

SALTS = 32


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_digest"))
    salted = (
        rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    )
    classes = salted.repartition(F.col("_digest")).groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    # staged, as adaptive execution splits a hot digest only where both sides of the join are plain shuffles
    digests = stage(classes.groupBy("_digest").agg(F.count("*").alias("_texts"), F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size")), "dedup")
    return (
        rows.select("_id", "_digest")
        .join(digests, "_digest")
        .select(
            F.col("_id").alias(id_col),
            F.when(F.col("_texts") == 1, F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest"))).alias("keep_id"),
            "group_size",
            F.equal_null(F.col("_id"), F.col("keep_id")).alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )
    )
