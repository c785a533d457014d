"""Exact dedup by progressive refinement: length, then a hash of the prefix, then a hash of the whole. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators.shared import fresh, small, written

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 64
#: Parts of a group's rows that are counted and joined apart, so a hot group is spread.
SALTS = 16


def normalised(text):
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _length(text):
    return F.length(normalised(text))


def _prefix(text):
    return F.xxhash64(F.substring(normalised(text), 1, PREFIX_CHARS))


def _suspects(docs: DataFrame, text_col: str) -> DataFrame:
    """The written table (n, prefix) of lengths and prefix hashes that two or more rows share.

    Rows are counted by both at once, so that no length is one task's; a length that one row has needs no look at its prefix.
    """
    text = docs[text_col]
    counts = written(docs.select(_length(text).alias("n"), _prefix(text).alias("prefix")).groupBy("n", "prefix").agg(F.count("*").alias("rows")), "counts")
    lengths = counts.groupBy("n").agg(F.sum("rows").alias("rows")).where("rows > 1").select("n")
    return written(counts.where("rows > 1").join(lengths, "n", "left_semi").select("n", "prefix"), "suspects")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Groups of two or more rows with equal normalised texts, (text_sha256, keep_id, group_size, at_keep), and the suspects (n, prefix).

    Both are written tables. keep_id is the smallest id (null only if all are null), at_keep the number of rows that have it. The
    whole text is hashed only for rows whose length and whose prefix hash another row shares. Counts are
    taken in salted parts first. An empty table gives no group.
    """
    suspects = _suspects(docs, text_col)
    keyed = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("norm"), _length(docs[text_col]).alias("n"), _prefix(docs[text_col]).alias("prefix"))
    full = keyed.join(small(suspects), ["n", "prefix"], "left_semi").select("id", F.sha2("norm", 256).alias("text_sha256"))
    salted = full.groupBy("text_sha256", "id").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("id").isNull().alias("z"), "id", F.col("rows").alias("at_keep")))
    part = salted.groupBy("text_sha256", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.sum("rows").alias("rows"), least.alias("least"))
    groups = part.groupBy("text_sha256").agg(F.sum("rows").alias("group_size"), F.min("least").alias("least")).where("group_size > 1")
    return written(groups.select("text_sha256", F.col("least.id").alias("keep_id"), "group_size", F.col("least.at_keep").alias("at_keep")), "groups"), suspects


def _with_groups(rows: DataFrame, groups: DataFrame, sha: str, id_col: str) -> DataFrame:
    """The rows with their group's keep_id, group_size and at_keep, null without a group."""
    groups_ = groups.withColumnRenamed("text_sha256", sha)
    if (hinted := small(groups_, groups)) is not groups_:
        return rows.join(hinted, sha, "left")
    salt = fresh(rows, "salt")  # copies of a hot text meet their group's row in SALTS places
    salts = groups_.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS))).join(salts, [sha, salt], "left").drop(salt)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with text_sha256, keep_id, group_size, at_keep and kept added.

    kept: the row's id is its group's smallest, or the text has no copy. Rows that repeat id and text are all
    kept (``survivors`` leaves one). Null texts count as empty, whole texts of any length are hashed, an empty table gives
    an empty result. Input columns with the added names are replaced.
    """
    added = ["text_sha256", "keep_id", "group_size", "at_keep", "kept"]
    groups, _ = copy_groups(docs, id_col, text_col)
    rows = docs.drop(*added).withColumn("text_sha256", F.sha2(normalised(F.col(text_col)), 256))
    joined = _with_groups(rows, groups, "text_sha256", id_col)
    alone = F.col("group_size").isNull()
    return joined.select(
        *[f"`{c}`" for c in docs.columns if c not in added],
        "text_sha256",
        F.when(alone, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("at_keep", F.lit(1)).alias("at_keep"),
        (alone | F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each group of copies, also where rows repeat an id.

    Only rows whose length and prefix another row shares are hashed as a whole; the others stay unread beyond that. Null
    texts count as empty, of rows with a null id only one stays if all copies have none, and an empty table stays empty.
    """
    groups, suspects = copy_groups(docs, id_col, text_col)
    names = {c: fresh(docs, c) for c in ("n", "prefix", "again", "sha", "keep_id", "group_size", "at_keep")}
    marked = suspects.select(F.col("n").alias(names["n"]), F.col("prefix").alias(names["prefix"]), F.lit(True).alias(names["again"]))
    rows = docs.withColumns({names["n"]: _length(F.col(text_col)), names["prefix"]: _prefix(F.col(text_col))}).join(small(marked, suspects), [names["n"], names["prefix"]], "left")
    rows = rows.withColumn(names["sha"], F.when(F.col(names["again"]), F.sha2(normalised(F.col(text_col)), 256)))
    renamed = groups.withColumnsRenamed({c: names[c] for c in ("keep_id", "group_size", "at_keep")})
    renamed._samewise_path = groups._samewise_path
    joined = _with_groups(rows, renamed, names["sha"], id_col)
    size, at_keep = F.col(names["group_size"]), F.col(names["at_keep"])
    kept = joined.where(size.isNull() | F.col(id_col).eqNullSafe(F.col(names["keep_id"])))
    columns = [f"`{c}`" for c in docs.columns]
    return kept.where(size.isNull() | (at_keep == 1)).select(*columns).unionByName(kept.where(at_keep > 1).dropDuplicates([names["sha"]]).select(*columns))
