"""Pairwise precision, recall, F1 and the adjusted Rand index of several methods in one grouped pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the methods in reports.
METHOD_NAMES = {"mst_or_sn": "MST_or_SN_Edit", "embedKNN": "Embed_kNN"}


def evaluate(df: DataFrame, gold: str = "cluster_id", prefix: str = "pred_", as_integer: bool = False) -> DataFrame:
    """(Method, ARI, Precision, Recall, F1) for each ``prefix`` column against ``gold``; rows without either label don't count.

    as_integer truncates labels to integers and ignores others. ARI is 1 if both have one cluster, null where 0/0.
    """
    methods = [c for c in df.columns if c.startswith(prefix)]
    number = "try_cast(try_cast({} as double) as int)" if as_integer else "cast({} as string)"
    pairs = ", ".join(f"'{METHOD_NAMES.get(c[len(prefix):], c[len(prefix):])}', {number.format(f'`{c}`')}" for c in methods)
    long = df.select(F.expr(f"stack({len(methods)}, {pairs}) as (Method, p)"), F.expr(number.format(f"`{gold}`")).alias("g")).where("p is not null and g is not null")
    cells = long.groupBy("Method", "p", "g").agg(F.count("*").alias("n"))
    twos = F.sum(F.col("n") * (F.col("n") - 1) / 2.0)
    both = cells.groupBy("Method").agg(twos.alias("s"), F.sum("n").alias("rows"))
    rows = cells.groupBy("Method", "p").agg(F.sum("n").alias("n")).groupBy("Method").agg(twos.alias("a"), F.count("*").alias("np"))
    cols = cells.groupBy("Method", "g").agg(F.sum("n").alias("n")).groupBy("Method").agg(twos.alias("b"), F.count("*").alias("ng"))
    t = both.join(rows, "Method").join(cols, "Method")
    t = t.withColumn("Precision", F.when(F.col("a") == 0, 0.0).otherwise(F.col("s") / F.col("a"))).withColumn("Recall", F.when(F.col("b") == 0, 0.0).otherwise(F.col("s") / F.col("b")))
    pr = F.col("Precision") + F.col("Recall")
    every = F.col("rows") * (F.col("rows") - 1) / 2.0
    chance = F.when(every > 0, F.col("a") * F.col("b") / every)
    spread = (F.col("a") + F.col("b")) / 2 - chance
    ari = F.when((F.col("np") == 1) & (F.col("ng") == 1), 1.0).when(spread != 0, (F.col("s") - chance) / spread)
    return t.select("Method", ari.alias("ARI"), "Precision", "Recall", F.when(pr == 0, 0.0).otherwise(2 * F.col("Precision") * F.col("Recall") / pr).alias("F1"))
