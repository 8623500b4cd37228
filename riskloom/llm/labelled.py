"""Labelled rows for the text classifiers: folds by id and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.staging import stage

FOLDS = 5


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for ids whose crc32 as text leaves 0 modulo ``FOLDS``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, shards: int) -> DataFrame:
    """``text``, ``label``, ``shard`` of about ``max_rows`` labelled documents outside the held-out fold.

    All of them are taken while there are no more than that; of more, those whose id hashes
    under the matching share.  The sample's ids are the only thing broadcast, so the bound
    on it is ``max_rows`` too.  Labels other than 0 and 1 and missing ids are left out; of
    contradicting labels of an id the mean decides.
    """
    known = (labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(target) >= 0.5).cast("int").alias("label")))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = rows.join(F.broadcast(known), "doc_id").select(
        "text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    return stage(picked, "training-rows")
