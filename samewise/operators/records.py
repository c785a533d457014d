"""Roles of columns, the text of a record, truth in any shape, and embeddings from strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.text import normalised, parsed_numbers, rendered, squish
from samewise.operators.components import components
from samewise.operators.shared import ranked
from samewise.sources.load import load_truth, lowered

# Names of columns by role.
ID_NAMES = ["id", "affiliation_id", "record_id", "rec_id", "docid", "rowid", "paper_id"]
TEXT_NAMES = ["title", "name", "raw_title", "string", "text", "affiliation", "aggregate value", "clean ag.value"]
EMBEDDING_NAMES = ["embedded clean ag.value", "embedded ag.value", "emb", "embedding", "vector", "embedding_clean"]
TRUTH_ID_NAMES = ["id", "record_id", "rec_id", "docid", "rowid", "paper_id"]


def first_present(names: list[str], columns: list[str]) -> str | None:
    return next((c for c in names if c in columns), None)


def standardised(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns as squished lower-case strings; all by default (P-7). An unknown column is an error."""
    cols = df.columns if cols is None else cols
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumns({c: F.lower(squish(F.col(f"`{c}`").cast("string"))) for c in cols})


def chosen_fields(columns: list[str], fields: list[str] | None = None, extra_fields: list[str] | None = None, text_names: list[str] = TEXT_NAMES) -> list[str]:
    """The lower-case columns that a record's text is made of: the fields that are there, or the first of ``text_names``; then the extra ones (P-4)."""
    if not fields:
        if (main := first_present(text_names, columns)) is None:
            raise ValueError(f"no text field: give fields, or one of {text_names}")
        chosen = [main]
    elif not (chosen := [f.lower() for f in fields if f.lower() in columns]):
        raise ValueError("none of the fields is a column")
    if extra_fields:
        chosen = list(dict.fromkeys([*chosen, *(f.lower() for f in extra_fields if f.lower() in columns)]))
    return chosen


def select_fields(df: DataFrame, id_col: str | None = None, fields: list[str] | None = None, extra_fields: list[str] | None = None, id_names: list[str] = ID_NAMES, text_names: list[str] = TEXT_NAMES, normalize: bool = True, null_token: str | None = "NA", keep: list[str] = ()) -> DataFrame:
    """(id, text_for_matching) and the columns ``keep``: one text for each record (F6).

    The id is ``id_col``, or the first of ``id_names`` there is, or the row's number. Fields that aren't
    there are left out; none left is an error. A null field reads ``null_token`` (None: is skipped). An empty text is " "
    without normalisation and "" with it.
    """
    df = lowered(df)
    kinds = dict(df.dtypes)
    if id_col is not None:
        id_col = id_col.lower()
        if id_col not in kinds:
            raise ValueError(f"no column {id_col}")
    elif (id_col := first_present(id_names, df.columns)) is None:
        df = ranked(df.withColumn("_row", F.monotonically_increasing_id()), ["_row"], "_place").withColumn("id", (F.col("_place") + 1).cast("string"))
        id_col, kinds = "id", kinds | {"id": "string"}
    chosen = chosen_fields(list(kinds), fields, extra_fields, text_names)
    parts = [rendered(c, kinds[c]) for c in chosen]
    text = squish(F.concat_ws(" ", *([F.coalesce(p, F.lit(null_token)) for p in parts] if null_token is not None else parts)))
    text = F.when(text == "", " ").otherwise(text)
    return df.select(rendered(id_col, kinds[id_col]).alias("id"), (normalised(text) if normalize else text).alias("text_for_matching"), *[F.col(f"`{c}`") for c in keep])


def pairs_to_clusters(pairs: DataFrame, id1: str = "id1", id2: str = "id2") -> DataFrame:
    """(id, cluster_id) of the ids in the pairs: components, numbered from 1 by their smallest id (F2)."""
    a, b = F.col(f"`{id1}`").cast("string"), F.col(f"`{id2}`").cast("string")
    edges = pairs.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null and x <> '' and y <> '' and x <> y")
    edges = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    nodes = ranked(edges.select(F.col("x").alias("id")).union(edges.select("y")).distinct(), ["id"], "n")
    e = edges.join(nodes.select(F.col("id").alias("x"), F.col("n").alias("src")), "x").join(nodes.select(F.col("id").alias("y"), F.col("n").alias("dst")), "y")
    found = components(e.select("src", "dst"))
    roots = ranked(found.select("component").distinct(), ["component"], "k")
    return nodes.join(found, nodes.n == found.node).join(roots, "component").select("id", (F.col("k") + 1).cast("int").alias("cluster_id"))


def truth_from_any(spark: SparkSession, truth, sep: str = r"\|", id_names: list[str] = TRUTH_ID_NAMES) -> DataFrame | None:
    """(id, cluster_id) from None, a mapping, a path, one column of "a|b", columns id1 and id2, or (id, label) (F3).

    Of several rows of an id the first stays; mappings aren't deduplicated.
    """
    if truth is None:
        return None
    if isinstance(truth, dict):
        return spark.createDataFrame([(str(k), int(v)) for k, v in truth.items()], "id string, cluster_id int")
    if isinstance(truth, str):
        truth = load_truth(spark, truth)
    elif hasattr(truth, "iloc"):
        truth = spark.createDataFrame(truth)
    if not isinstance(truth, DataFrame):
        raise TypeError("unsupported truth: give pairs, an id and cluster table, a mapping or a path")
    truth = lowered(truth)
    if len(truth.columns) == 1:
        c = F.col(f"`{truth.columns[0]}`").cast("string")
        parts = F.split(c, sep)
        return pairs_to_clusters(truth.where(c.isNotNull() & (c != "")).select(F.get(parts, 0).alias("id1"), F.get(parts, 1).alias("id2")))
    if {"id1", "id2"} <= set(truth.columns):
        return pairs_to_clusters(truth)
    id_col = next((c for c in truth.columns if c in id_names), truth.columns[0])
    label = next(c for c in truth.columns if c != id_col)
    rows = truth.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{label}`").alias("cluster_id"), F.monotonically_increasing_id().alias("_row"))
    return rows.groupBy("id").agg(F.min_by(F.struct("cluster_id"), "_row").alias("s")).select("id", F.col("s.cluster_id").alias("cluster_id"))


def modal_length(vectors: DataFrame, col: str = "v") -> int:
    """The commonest size above 0; of several the least. An error if there is none."""
    r = vectors.select(F.size(col).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if r is None:
        raise ValueError("no numbers in the embedding column")
    return r.n


def parsed_embeddings(df: DataFrame, col: str, out: str = "vector") -> DataFrame:
    """``df`` with numeric vectors of the modal length: longer ones are cut, shorter ones filled with nulls (F7)."""
    kind = dict(df.dtypes)[col]
    v = F.col(f"`{col}`").cast("array<double>") if kind.startswith("array") else parsed_numbers(F.col(f"`{col}`"))
    v = F.coalesce(v, F.array().cast("array<double>"))
    d = modal_length(df.select(v.alias("v")))
    return df.withColumn(out, F.concat(F.slice(v, 1, d), F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), F.lit(d) - F.size(v)))))


def filled_labels(df: DataFrame, label: str = "cluster_id", order: str = "id") -> DataFrame:
    """Null labels become the largest integer label plus 1, 2, ... in ``order`` (E-2); ranks of the null rows are made range by range."""
    n = F.expr(f"try_cast(try_cast({label} as double) as int)")
    top = df.agg(F.coalesce(F.max(n), F.lit(0))).first()[0]
    kind = dict(df.dtypes)[label]
    missing = ranked(df.where(F.col(label).isNull()), [order], "_k")
    return df.where(F.col(label).isNotNull()).unionByName(missing.withColumn(label, (F.col("_k") + 1 + top).cast(kind)).drop("_k"))

