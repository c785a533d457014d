"""Weighted rendezvous sharding of stable record keys. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.operators.shared import ranked, written


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins ``key``: the least of -ln(u) / weight, u a hash of key and shard in (0, 1).

    Key and weights alone decide. A further shard wins some keys and leaves the others where they are; a
    shard wins keys in proportion to its weight, none with weight 0. A null key is a key as any other.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, and one of them more")

    def u(s: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))

    bids = [F.struct((-F.log(u(s)) / F.lit(float(w))).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*bids))["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot) for every row.

    size is the UTF-8 bytes of the text (null: none) plus 1; text_crc32 that of the UTF-8 bytes; slot the place in the
    shard by id, gapless from 0; grown_shard the shard under the weights ``grown`` (null without). Rows that
    repeat an id share its shard and have slots of their own. Only these narrow columns are shuffled, by
    ranges of shard and id, so a large shard is many tasks.
    """
    text, id_ = F.coalesce(docs[text_col].cast("string"), F.lit("")), docs[id_col]
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int"):
        id_ = id_.cast("long")  # a key's hash must not depend on how wide its column is
    narrow = docs.select(
        id_.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(id_, weights).alias("shard"),
        (rendezvous(id_, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    table = written(narrow, "shards")
    rows = ranked(table, ["shard", "doc_id", "text_crc32"], "_rank")
    counts = {r["shard"]: r["count"] for r in table.groupBy("shard").count().collect()}  # a row a shard
    first, total = [], 0
    for s in range(len(weights)):
        first.append(F.lit(total).cast("long"))
        total += counts.get(s, 0)
    return rows.withColumn("slot", F.col("_rank") - F.element_at(F.array(*first), F.col("shard") + 1)).drop("_rank")
