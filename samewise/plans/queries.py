"""Queries over the test tables, one or more for each operator, and their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.text import distance
from samewise.operators import clusterers as C
from samewise.operators.components import components
from samewise.operators.evaluation import evaluate
from samewise.operators.records import filled_labels, modal_length, pairs_to_clusters, parsed_embeddings, select_fields, standardised, truth_from_any
from samewise.operators.shared import shared_folder, written
from samewise.operators.vectors import neighbours, svd_scores, tfidf
from samewise.plans.resolve import unified_pipeline
from samewise.sources.load import load_input, register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("text"))


def text_build(spark, d):
    return select_fields(_t(spark, d, "part").withColumn("p_type", F.when(F.col("p_size") % 7 != 0, F.col("p_type"))), "p_partkey", ["P_Name", "p_type", "p_size", "p_retailprice", "nope"])


def prep(spark, d):
    return standardised(_t(spark, d, "customer"), ["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


def truth_pairs(spark, d):
    o = _t(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id1"), F.concat(F.lit("o"), "o_orderkey").alias("id2"))
    return truth_from_any(spark, o)


def truth_one_column(spark, d):
    return truth_from_any(spark, _t(spark, d, "supplier").select(F.concat_ws("|", F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit("x")).alias("pair")))


def truth_labels(spark, d):
    return truth_from_any(spark, _t(spark, d, "labels").select(F.col("toxic").alias("label"), F.col("doc_id").alias("docid"))).withColumnRenamed("cluster_id", "label")


def embedding_parse(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.concat_ws(", ", F.col("embedding").cast("array<string>")), F.lit("]")).alias("emb"))
    return parsed_embeddings(e, "emb").select("vec_id", F.size("vector").alias("d"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def embedding_neighbours(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), F.col("embedding").cast("array<double>").alias("vector"))
    return neighbours(e, 15).select("rid", "place", F.round("sim", 6).alias("sim"))


def embedding_components(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), F.col("embedding").cast("array<double>").alias("vector"))
    return C.embedding_clusters(e, 15, 0.5)


def term_weights(spark, d):
    t = tfidf(_t(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("rid"), F.col("text")).where("text is not null"))
    return t.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("weight"), 6).alias("weight"))


def edit_distances(spark, d):
    p = _parts(spark, d).groupBy("text").agg(F.min("rid").alias("rid"))
    return C.edit_pairs(p)


def edit_distances_whole(spark, d):
    return C.edit_pairs(_parts(spark, d))


def string_distances(spark, d):
    p = _t(spark, d, "part").select("p_name", "p_type").distinct()
    a, b = F.col("p_name"), F.lower("p_type")
    return p.select("p_name", "p_type", *[F.round(distance(a, b, m), 9).alias(m) for m in ("lv", "jaccard", "dl")])


def all_distances(spark, d):
    p = _t(spark, d, "part").select("p_name", "p_type").distinct()
    return p.select("p_name", "p_type", *[distance(F.col("p_name"), F.lower("p_type"), m).alias(m) for m in ("jw", "osa", "lcs", "soundex")])


def count_distances(spark, d):
    """Distances by counts of letters, over all pairs of nations."""
    n = _t(spark, d, "nation").select(F.lower("n_name").alias("a"))
    p = n.crossJoin(n.select(F.col("a").alias("b")))
    return p.select("a", "b", *[F.round(distance(F.col("a"), F.col("b"), m), 9).alias(m) for m in ("hamming", "qgram", "cosine")])


def delimited_files(spark, d):
    """The table of nations, written with each separator and read back with the separator found by its lines; NA reads as null."""
    n = _t(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("N_Region"))
    out = None
    for ext, sep in (("csv", ","), ("tsv", "\t"), ("psv", "|"), ("txt", ";")):
        path = f"{shared_folder(spark)}/samewise/nations-{uuid.uuid4().hex}.{ext}"
        n.write.csv(path, sep=sep, header=True, nullValue="NA")
        back = load_input(spark, path).select(F.lit(ext).alias("ext"), F.col("n_nationkey").cast("long"), "n_name", F.col("n_region").cast("long"))
        out = back if out is None else out.unionByName(back)
    return out


def truth_path(spark, d):
    """Pairs from a file of one column: a psv file is read with commas, and the bars split its values."""
    path = f"{shared_folder(spark)}/samewise/pairs-{uuid.uuid4().hex}.psv"
    _t(spark, d, "supplier").select(F.concat_ws("|", F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")).alias("id1|id2")).write.csv(path, header=True)
    return truth_from_any(spark, path)


def dataset_key(spark, d):
    """A registered dataset without an id column: ids are row numbers, the text is the first known text column."""
    register("nations", lambda s: _t(s, d, "nation").coalesce(1).orderBy("n_nationkey").select(F.col("n_name").alias("Name"), "n_regionkey"))
    return select_fields(load_input(spark, "NATIONS"), extra_fields=["n_regionkey", "nope"])


def gold_join(spark, d):
    """Records with and without labels, scored on labelled ones only (J-1, E-1)."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("pred_kmeans"), F.col("source").alias("pred_mst_or_sn"))
    gold = truth_from_any(spark, _t(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).withColumnRenamed("doc_id", "docid"))
    return evaluate(docs.join(gold, "id", "left").where("cluster_id is not null")).select("Method", *[F.round(c, 9).alias(c) for c in ("ARI", "Precision", "Recall", "F1")])


def evaluation_as_integer(spark, d):
    """Labels that are truncated to integers; those that aren't numbers don't count (T13)."""
    gold = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".7"))).otherwise("low")
    return evaluate(_t(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.ascii("o_orderstatus") / 2).alias("pred_kmeans"), gold.alias("cluster_id")), as_integer=True)


def sorted_neighbourhood(spark, d):
    return C.neighbourhood_links(_parts(spark, d))


def sorted_neighbourhood_clusters(spark, d):
    return C.neighbourhood_clusters(_parts(spark, d))


def spanning_tree_clusters(spark, d):
    rows = written(_parts(spark, d), "parts")
    p = rows.groupBy("text").agg(F.min("rid").alias("rid"))
    return rows.join(p.join(C.mst_clusters(p), "rid").select("text", "label"), "text").select("rid", "label")


def kmeans_text(spark, d):
    return C.kmeans_clusters(_parts(spark, d), 10, 20)


def louvain_text(spark, d):
    return C.louvain_clusters(_parts(spark, d))


def svd_text(spark, d):
    """The rank and the length of each row's scores: signs and turns within equal singular values are free, lengths aren't."""
    return svd_scores(_parts(spark, d), 20).select("rid", F.size("vector").alias("k"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("length"))


def evaluation(spark, d):
    return evaluate(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("pred_mst_or_sn"), F.col("o_orderstatus").alias("pred_kmeans"), F.year("o_orderdate").alias("cluster_id")))


def singleton_fill(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("int")).alias("cluster_id"))
    return filled_labels(o, "cluster_id", "o_orderkey")


def modal_size(spark, d):
    e = _t(spark, d, "documents").select(F.split("text", r"\. ").alias("v"))
    return spark.range(1).select(F.lit(modal_length(e)).cast("long").alias("d"))


def graph_components(spark, d):
    s = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).where("l_quantity >= 50 and l_discount >= 0.1")
    return components(s)


def graph_components_whole(spark, d):
    s = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))
    return components(s)


def resolve(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("label"))
    return unified_pipeline(spark, part.select("id", "name"), part.select("id", "label")).performance


def _closure(edges: str) -> str:
    return f"""WITH RECURSIVE e AS ({edges}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(node, other) AS (SELECT src, src FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON r.other = b.src)"""


NEAR = """n AS (SELECT p_partkey AS rid, p_name AS t, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part),
l AS (SELECT a.rid AS src, b.rid AS dst, a.t AS x, b.t AS y FROM n a JOIN n b ON b.place > a.place AND b.place <= a.place + 40 WHERE a.t = b.t OR 1 - jaro_similarity(a.t, b.t) <= 0.12 + 1e-12)"""


SCORES = """c AS (SELECT m, p, g, count(*)::DOUBLE AS n FROM t WHERE p IS NOT NULL AND g IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT m, sum(n * (n - 1) / 2) AS s, sum(n) AS r FROM c GROUP BY 1),
a AS (SELECT m, sum(n * (n - 1) / 2) AS a FROM (SELECT m, p, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT m, sum(n * (n - 1) / 2) AS b FROM (SELECT m, g, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT m AS "Method", (s - a * b / (r * (r - 1) / 2)) / ((a + b) / 2 - a * b / (r * (r - 1) / 2)) AS "ARI", s / a AS "Precision", s / b AS "Recall", 2 * (s / a) * (s / b) / (s / a + s / b) AS "F1" FROM s JOIN a USING (m) JOIN b USING (m))"""


ORACLE = {
    "embedding_components": """WITH RECURSIVE n AS (SELECT a.vec_id AS rid, b.vec_id AS o, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY sim DESC, o) AS place FROM n), e AS (SELECT rid AS src, o AS dst FROM k WHERE place <= 15 AND sim >= 0.5),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, b.dst FROM r JOIN b ON r.other = b.src) SELECT node AS rid, min(other) AS label FROM r GROUP BY 1""",
    "term_weights": r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS term FROM conversations WHERE text IS NOT NULL),
t AS (SELECT conv_id, turn, term, count(*) AS n FROM w GROUP BY 1, 2, 3), s AS (SELECT conv_id, turn, sum(n) AS size FROM t GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT term, any_value(df) AS df, round(sum(n / size * ln(((SELECT count(*) FROM conversations WHERE text IS NOT NULL) + 1) / (df + 1))), 6) AS weight FROM t JOIN s USING (conv_id, turn) JOIN f USING (term) GROUP BY 1""",
    "string_distances": """SELECT p_name, p_type, levenshtein(p_name, lower(p_type))::DOUBLE AS lv, round(1 - jaccard(p_name, lower(p_type)), 9) AS jaccard,
damerau_levenshtein(p_name, lower(p_type))::DOUBLE AS dl FROM (SELECT DISTINCT p_name, p_type FROM part)""",
    "count_distances": """WITH p AS (SELECT lower(x.n_name) AS a, lower(y.n_name) AS b FROM nation x, nation y), c AS (SELECT *, list_distinct(string_split(a || b, '')) AS l FROM p),
v AS (SELECT *, list_transform(l, lambda z: len(a) - len(replace(a, z, ''))) AS x, list_transform(l, lambda z: len(b) - len(replace(b, z, ''))) AS y FROM c)
SELECT a, b, CASE WHEN len(a) = len(b) THEN hamming(a, b)::DOUBLE ELSE 'inf'::DOUBLE END AS hamming, list_sum(list_transform(range(len(l)), lambda i: abs(x[i + 1] - y[i + 1])))::DOUBLE AS qgram,
CASE WHEN a = b THEN 0.0::DOUBLE ELSE round(1 - list_sum(list_transform(range(len(l)), lambda i: x[i + 1] * y[i + 1])) / sqrt(list_sum(list_transform(x, lambda i: i * i)) * list_sum(list_transform(y, lambda i: i * i))), 9) END AS cosine FROM v""",
    "sorted_neighbourhood": f"WITH {NEAR} SELECT src, dst FROM l",
    "sorted_neighbourhood_clusters": f"""WITH RECURSIVE {NEAR}, e AS (SELECT DISTINCT x, y FROM l UNION SELECT DISTINCT y, x FROM l), r(t, o) AS (SELECT DISTINCT t, t FROM n UNION SELECT r.t, e.y FROM r JOIN e ON r.o = e.x),
m AS (SELECT r.t, min(n.rid) AS label FROM r JOIN n ON n.t = r.o GROUP BY 1) SELECT n.rid, m.label FROM n JOIN m USING (t)""",
    "graph_components_whole": """WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT a.s, b.s AS t FROM l a JOIN l b USING (p)),
r(s, t) AS (SELECT s, s FROM l UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s), m AS (SELECT s, min(t) AS c FROM r GROUP BY 1)
SELECT s AS node, c AS component FROM m UNION ALL SELECT p + 1000000, min(c) FROM l JOIN m USING (s) GROUP BY 1""",
    "delimited_files": "SELECT ext, n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey::BIGINT END AS n_region FROM nation, (VALUES ('csv'), ('tsv'), ('psv'), ('txt')) v(ext)",
    "truth_path": """WITH c AS (SELECT 'n' || s_nationkey AS k, 's' || s_suppkey AS o FROM supplier), m AS (SELECT k AS id, k FROM c UNION SELECT o, k FROM c)
SELECT id, CAST(dense_rank() OVER (ORDER BY k) AS INTEGER) AS cluster_id FROM m""",
    "dataset_key": r"SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR) AS id, trim(regexp_replace(lower(n_name || ' ' || n_regionkey), '\s+', ' ', 'g')) AS text_for_matching FROM nation",
    "gold_join": f"""WITH d AS (SELECT doc_id, lang, source, min(quality) OVER (PARTITION BY doc_id) AS q FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
t AS (SELECT 'kmeans' AS m, lang AS p, q AS g FROM d UNION ALL SELECT 'MST_or_SN_Edit', source, q FROM d), {SCORES} SELECT "Method", round("ARI", 9) AS "ARI", round("Precision", 9) AS "Precision", round("Recall", 9) AS "Recall", round("F1", 9) AS "F1" FROM q""",
    "evaluation_as_integer": f"""WITH t AS (SELECT 'kmeans' AS m, CASE WHEN o_orderstatus <> 'P' THEN ascii(o_orderstatus) // 2 END AS p, CASE WHEN o_orderpriority <> '5-LOW' THEN substring(o_orderpriority, 1, 1)::INT END AS g FROM orders), {SCORES} SELECT * FROM q""",
    "text_build": r"""SELECT CAST(p_partkey AS VARCHAR) AS id, trim(regexp_replace(lower(p_name || ' ' || coalesce(CASE WHEN p_size % 7 <> 0 THEN p_type END, 'NA') || ' ' || p_size || ' ' ||
CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END), '\s+', ' ', 'g')) AS text_for_matching FROM part""",
    "prep": r"SELECT c_custkey, lower(trim(regexp_replace(c_name, '\s+', ' ', 'g'))) AS c_name, lower(trim(regexp_replace(c_mktsegment, '\s+', ' ', 'g'))) AS c_mktsegment FROM customer",
    "truth_pairs": """WITH c AS (SELECT 'c' || o_custkey AS k, 'o' || o_orderkey AS o FROM orders), m AS (SELECT k AS id, k FROM c UNION SELECT o, k FROM c)
SELECT id, CAST(dense_rank() OVER (ORDER BY k) AS INTEGER) AS cluster_id FROM m""",
    "truth_one_column": """WITH c AS (SELECT 'n' || s_nationkey AS k, 's' || s_suppkey AS o FROM supplier), m AS (SELECT k AS id, k FROM c UNION SELECT o, k FROM c)
SELECT id, CAST(dense_rank() OVER (ORDER BY k) AS INTEGER) AS cluster_id FROM m""",
    "truth_labels": "SELECT CAST(doc_id AS VARCHAR) AS id, toxic AS label FROM labels",
    "embedding_parse": "SELECT vec_id, 64 AS d, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS VARCHAR) AS DOUBLE))), 6) AS total FROM embeddings",
    "embedding_neighbours": """SELECT rid, place, round(sim, 6) AS sim FROM (SELECT a.vec_id AS rid, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim,
CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS INTEGER) AS place
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE place <= 15""",
    "edit_distances": "WITH p AS (SELECT p_name AS t, min(p_partkey) AS rid FROM part GROUP BY 1) SELECT a.rid AS lo, b.rid AS hi, CAST(levenshtein(a.t, b.t) AS INTEGER) AS w FROM p a JOIN p b ON a.rid < b.rid",
    "evaluation": """WITH t AS (SELECT 'MST_or_SN_Edit' AS m, o_orderpriority AS p, CAST(year(o_orderdate) AS VARCHAR) AS g FROM orders UNION ALL SELECT 'kmeans', o_orderstatus, CAST(year(o_orderdate) AS VARCHAR) FROM orders),
c AS (SELECT m, p, g, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2, 3),
s AS (SELECT m, sum(n * (n - 1) / 2) AS s, sum(n) AS r FROM c GROUP BY 1),
a AS (SELECT m, sum(n * (n - 1) / 2) AS a FROM (SELECT m, p, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT m, sum(n * (n - 1) / 2) AS b FROM (SELECT m, g, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT m AS "Method", (s - a * b / (r * (r - 1) / 2)) / ((a + b) / 2 - a * b / (r * (r - 1) / 2)) AS "ARI", s / a AS "Precision", s / b AS "Recall", 2 * (s / a) * (s / b) / (s / a + s / b) AS "F1" FROM s JOIN a USING (m) JOIN b USING (m)""",
    "singleton_fill": """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS INTEGER) END AS c FROM orders)
SELECT o_orderkey, CAST(coalesce(c, (SELECT max(c) FROM t) + row_number() OVER (PARTITION BY c IS NULL ORDER BY o_orderkey)) AS INTEGER) AS cluster_id FROM t""",
    "modal_size": "SELECT n AS d FROM (SELECT len(string_split(text, '. ')) AS n, count(*) AS c FROM documents GROUP BY 1) ORDER BY c DESC, n LIMIT 1",
    "graph_components": _closure("SELECT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1") + " SELECT node, min(other) AS component FROM r GROUP BY 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [delimited_files, truth_path, dataset_key, gold_join, evaluation_as_integer, count_distances, text_build, prep, truth_pairs, truth_one_column, truth_labels, embedding_parse, embedding_neighbours, embedding_components, term_weights, edit_distances, edit_distances_whole, string_distances, all_distances, sorted_neighbourhood, sorted_neighbourhood_clusters, spanning_tree_clusters, kmeans_text, louvain_text, svd_text, evaluation, singleton_fill, modal_size, graph_components, graph_components_whole, resolve]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
