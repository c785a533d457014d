"""The entity-resolution plan: load, build texts, cluster by every method, evaluate, write."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators import clusterers as C
from samewise.operators.evaluation import evaluate
from samewise.operators.records import EMBEDDING_NAMES, ID_NAMES, TEXT_NAMES, chosen_fields, filled_labels, first_present, parsed_embeddings, select_fields, truth_from_any
from samewise.operators.shared import ranked, written
from samewise.operators.vectors import svd_scores
from samewise.sources.load import load_input


#: Numbers and modes that a result's details repeat.
PARAMETERS = ["k_clusters", "knn_k", "mst_cut_ratio", "mst_k", "sn_window", "sn_method", "sn_thresh", "svd_dim", "louvain_min_sim", "cos_thresh", "eval_mode", "label_mode"]


@dataclass
class Result:
    performance: DataFrame | None
    predictions: DataFrame
    details: dict = field(default_factory=dict)


def unified_pipeline(spark: SparkSession, data, truth=None, sheet=None, id_col=None, fields=None, extra_fields=None, id_names=ID_NAMES, text_names=TEXT_NAMES, embed_col=None, embed_names=EMBEDDING_NAMES, k_clusters=10, knn_k=15, mst_cut_ratio=5, mst_k=None, sn_window=40, sn_method="jw", sn_thresh=0.12, svd_dim=100, louvain_min_sim=0.0, cos_thresh=0.88, eval_mode="labeled_only", write_csv=None, label_mode="string") -> Result:
    """All methods over one table; predictions have id, text_for_matching and a pred_ column a method (F15).

    label_mode: ``string`` compares gold labels as they are, ``as_integer`` truncates them and ignores those that aren't numbers.
    """
    given = locals()
    if eval_mode not in ("labeled_only", "singleton_fill"):
        raise ValueError(f"unknown eval_mode: {eval_mode}")
    if label_mode not in ("string", "as_integer"):
        raise ValueError(f"unknown label_mode: {label_mode}")
    raw = load_input(spark, data, sheet)
    ec = embed_col.lower() if embed_col else first_present([x.lower() for x in embed_names], raw.columns)
    ec = ec if ec in raw.columns else None
    texts = select_fields(raw, id_col, fields, extra_fields, id_names, text_names, keep=[ec] if ec else [])
    rows = written(ranked(texts.withColumn("_o", F.monotonically_increasing_id()), ["_o"], "rid").drop("_o"), "records")
    base = rows.select("rid", F.col("text_for_matching").alias("text"))
    scores = svd_scores(base, svd_dim)
    found = {
        "pred_kmeans": C.kmeans_clusters(base, k_clusters, svd_dim, scores=scores),
        "pred_mst_or_sn": C.edit_clusters(base, "auto", mst_cut_ratio, mst_k, "keep", sn_window, sn_method, sn_thresh),
        "pred_louvain": C.louvain_clusters(base, knn_k, louvain_min_sim, svd_dim, scores=scores),
    }
    if ec:
        found["pred_embedKNN"] = C.embedding_clusters(parsed_embeddings(rows, ec).select("rid", "vector"), knn_k, cos_thresh)
    out = rows.select("rid", "id", "text_for_matching")
    for name, labels in found.items():
        out = out.join(numbered(labels).select("rid", F.col("label").alias(name)), "rid", "left")
    out = written(out, "predictions")
    performance = None
    gold = truth_from_any(spark, truth)
    if gold is not None and not gold.isEmpty():
        out = out.join(gold, "id", "left")
        if eval_mode == "singleton_fill":
            out = filled_labels(out, "cluster_id", "rid")
        out = written(out, "predictions")
        if out.where("cluster_id is not null").limit(2).count() == 2:
            performance = evaluate(out.where("cluster_id is not null"), as_integer=label_mode == "as_integer")
    out = out.select("id", "text_for_matching", *found, *(["cluster_id"] if "cluster_id" in out.columns else []))
    if write_csv:
        write_predictions(out, write_csv)
    used = chosen_fields(raw.columns, fields, extra_fields, text_names)
    params = {k: given[k] for k in PARAMETERS}
    return Result(performance, out, {"n": rows.count(), "used_fields": used, "has_embeddings": bool(ec), "params": params})


def numbered(labels: DataFrame) -> DataFrame:
    """Labels as integers 1 to the number of clusters, by the order of the labels."""
    k = ranked(labels.select("label").distinct(), ["label"], "_k")
    return labels.join(k, "label").select("rid", (F.col("_k") + 1).cast("int").alias("label"))


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV in a directory, with a header and NA for nulls (K-1)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def run(spark: SparkSession, data, truth=None, **options) -> Result:
    """``unified_pipeline`` that prints its performance (F16)."""
    result = unified_pipeline(spark, data, truth, **options)
    if result.performance is not None:
        result.performance.show(truncate=False)
    return result
