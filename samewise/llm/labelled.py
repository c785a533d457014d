"""What the classifiers share: bounded samples of labelled documents, brought to the driver to fit a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.shared import small, written

#: A label's sample ends with the text that brings it to so many bytes.
LABEL_BYTES = 32 << 20


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % m, F.lit(-1))


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, share): up to ``per_class`` labelled documents of each label, the first by a hash of the id.

    ``labels`` has (doc_id, label); null labels are not used, and of several rows of an id the least label is.
    share is the label's number of documents over those sampled. Whole texts are taken, until a label has LABEL_BYTES of
    them. The bounds keep what the driver gets from growing.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label")).where(F.col(id_col).isNotNull())
    table = written(known, "labels")
    counts = written(table.groupBy("label").agg(F.count("*").alias("n")), "label_counts")
    hashed = F.xxhash64(F.lit(3), id_col)
    # so many of the least hashes hold the first per_class of them, but for a chance of 1e-9
    enough = (1.1 * per_class + 6 * per_class**0.5 + 10) / F.col("n")
    early = table.join(small(counts), "label").where((hashed / F.lit(2.0**64)) + 0.5 < enough)
    picks = early.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(hashed, id_col))).where(F.col("place") <= per_class)
    picks = written(picks.select(F.col(id_col).alias("_id"), "label", (F.col("n") / F.least(F.col("n"), F.lit(per_class))).alias("share")), "picks")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(small(picks), "_id")
    room = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(3), "_id"), "_id").rowsBetween(Window.unboundedPreceding, -1))
    return texts.withColumn("_before", room).where(F.coalesce("_before", F.lit(0)) < LABEL_BYTES).select("text", "label", "share")
