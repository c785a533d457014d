"""Term weights, truncated SVD, k-means and nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.functions.text import WORD
from samewise.operators.shared import small, written

#: Rows of a block in the neighbour search.
BLOCK = 1024
#: Terms of a vocabulary; more are an error, none is left out.
TERMS = 1 << 20


def terms(df: DataFrame, id_col: str = "rid", text_col: str = "text") -> DataFrame:
    """(rid, term, n): counts of lower-case words."""
    words = df.select(F.col(id_col).alias("rid"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0))).alias("term"))
    return words.groupBy("rid", "term").agg(F.count("*").alias("n"))


def tfidf(df: DataFrame, id_col: str = "rid", text_col: str = "text") -> DataFrame:
    """(rid, term, weight): a word's share of its text times ln((N + 1) / (df + 1)) (M-1, M-2)."""
    t = written(terms(df, id_col, text_col), "terms")
    n = df.count()
    sizes = t.groupBy("rid").agg(F.sum("n").alias("size"))
    often = t.groupBy("term").agg(F.count("*").alias("df"))
    return t.join(often, "term").join(sizes, "rid").select("rid", "term", (F.col("n") / F.col("size") * F.log((F.lit(n) + 1) / (F.col("df") + 1))).alias("weight"))


def svd_scores(df: DataFrame, dim: int = 100, id_col: str = "rid", text_col: str = "text") -> DataFrame:
    """(rid, vector): scores of the truncated SVD of the TF-IDF matrix, rank max(2, min(dim, min(shape) - 1)); an empty text is all zeros (M-3)."""
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD, gaps=False).transform(df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text")))
    counted = CountVectorizer(inputCol="words", outputCol="counts", vocabSize=TERMS + 1).fit(words)
    if len(counted.vocabulary) > TERMS:
        raise ValueError(f"more than {TERMS} distinct terms")
    share = Normalizer(inputCol="counts", outputCol="share", p=1.0).transform(counted.transform(words))
    weighed = written(IDF(inputCol="share", outputCol="weights").fit(share).transform(share).select("rid", "weights"), "weights").persist()
    n, m = weighed.count(), len(counted.vocabulary)
    k = min(max(2, min(dim, min(n, m) - 1)), n, m)
    v = RowMatrix(weighed.rdd.map(lambda r: Vectors.fromML(r.weights)), n, m).computeSVD(k).V.toArray()
    basis = df.sparkSession.sparkContext.broadcast(v)

    @F.udf("array<double>")
    def project(x):
        return (x.values @ basis.value[x.indices]).tolist() + [0.0] * (k - basis.value.shape[1]) if len(x.indices) else [0.0] * k

    out = written(weighed.select("rid", project("weights").alias("vector")), "scores")
    weighed.unpersist()
    return out


def kmeans(vectors: DataFrame, k: int = 10, seed: int = 123, starts: int = 20, col: str = "vector") -> DataFrame:
    """(rid, label): the best of several seeded runs; k is at most the number of distinct rows (M-4).

    Distinct vectors are clustered, each with the number of its rows as weight.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = written(vectors.select("rid", F.col(col).alias("v"), F.xxhash64(col).alias("k1"), F.xxhash64(F.lit(1), col).alias("k2")), "rows")
    kinds = written(rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.any_value("v").alias("v"), F.min("rid").alias("least")), "distinct")
    k = min(k, kinds.limit(k + 1).count())
    if k < 2:
        return vectors.select("rid", F.lit(1).alias("label"))
    x = kinds.orderBy("least").select("k1", "k2", F.col("n").cast("double").alias("n"), array_to_vector("v").alias("features")).persist()
    fits = [KMeans(k=k, seed=seed + i, maxIter=10, weightCol="n").fit(x) for i in range(starts)]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    labels = written(best.transform(x).select("k1", "k2", (F.col("prediction") + 1).alias("label")), "labels")
    x.unpersist()
    return written(rows.select("rid", "k1", "k2").join(small(labels), ["k1", "k2"]).select("rid", "label"), "labels")


def neighbour_lists(vectors: DataFrame, k: int, col: str = "vector", least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rid, rep, near) for each usable row and (rep, near) for each distinct vector, both with near as (place, other, orep, sim).

    rep numbers the distinct vectors. Rows of one vector have one list, the k + 1 rows of highest cosine, ties by id, and each row
    leaves itself out of it; so only distinct vectors are compared, in blocks, and of the rows of a vector the k + 1 of smallest id
    are all that a list can hold. Ids are taken to be unique.
    """
    from pyspark.sql import Window

    usable = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(col, lambda x: x != 0)
    rows = vectors.where(usable).select(F.col("rid").cast("long").alias("rid"), F.col(col).alias("v"))
    rows = written(rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")}), "rows")
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is not None:
        rows = rows.where(F.size("v") == usual.d)
    n = rows.count()
    k = max(1, min(k, n - 1))
    groups = rows.groupBy("k1", "k2").agg(F.min("rid").alias("least"), F.any_value("v").alias("v"))
    groups = written(groups.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    blocks = max(1, -(-groups.count() // BLOCK))
    laid = groups.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    laid = laid.select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep", "least", "v")

    def close(pdf):
        import pandas as pd

        i, j = pdf.i.iloc[0], pdf.j.iloc[0]
        a, b = (pdf[pdf.block == x].sort_values("least") for x in (i, j))
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "orep": [], "oleast": [], "sim": []})
        x, y = (np.stack(t.v.to_numpy()) for t in (a, b))
        s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        out = []
        for own, other, sims in ((a, b, s), (b, a, s.T))[: 1 if i == j else 2]:
            top = np.argsort(-sims, axis=1, kind="stable")[:, : k + 1]
            best = np.take_along_axis(sims, top, 1).ravel()
            ok = np.isfinite(best)
            at = top.ravel()[ok]
            out.append(pd.DataFrame({"rep": np.repeat(own.rep.to_numpy(), top.shape[1])[ok], "orep": other.rep.to_numpy()[at], "oleast": other.least.to_numpy()[at], "sim": best[ok]}))
        return pd.concat(out)

    def first(df, by, *order):
        return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k + 1)

    found = laid.groupBy("i", "j").applyInPandas(close, "rep long, orep long, oleast long, sim double")
    top = first(found, "rep", F.desc("sim"), "oleast").drop("place")
    numbered = rows.select("rid", "k1", "k2").join(small(groups.select("k1", "k2", "rep"), groups), ["k1", "k2"]).select("rid", "rep")
    copies = first(numbered, "rep", "rid").select(F.col("rep").alias("orep"), F.col("rid").alias("other"))
    lists = first(top.join(copies, "orep"), "rep", F.desc("sim"), "other")
    if least is not None:
        lists = lists.where(F.col("sim") >= least)
    lists = written(lists.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("place", "other", "orep", "sim"))).alias("near")), "near")
    own = F.slice(F.filter("near", lambda x: x.other != F.col("rid")), 1, k)
    return numbered.join(small(lists), "rep").select("rid", "rep", own.alias("near")), lists


def neighbours(vectors: DataFrame, k: int, col: str = "vector", least: float | None = None) -> DataFrame:
    """(rid, other, sim, place): the ``k`` rows of highest cosine for each row, itself excluded; ties by id.

    Exact, by blocks of distinct vectors: each task multiplies two blocks, once for both, and keeps k + 1 candidates a vector, so memory
    is bounded; work and what is shuffled grow with the square of the distinct vectors, not of the rows. Rows of another length than the
    commonest, with nulls, or without a finite norm above 0 take no part.
    """
    near = neighbour_lists(vectors, k, col, least)[0].select("rid", F.posexplode("near").alias("pos", "x"))
    return near.select("rid", F.col("x.other").alias("other"), F.col("x.sim").alias("sim"), (F.col("pos") + 1).alias("place"))
