import pytest

from samewise.functions.text import distance, normalised
from samewise.operators.clusterers import embedding_clusters, louvain, mst_clusters, neighbourhood_clusters
from samewise.operators.components import components
from samewise.operators.evaluation import evaluate
from samewise.operators.records import filled_labels, modal_length, pairs_to_clusters, parsed_embeddings, select_fields, truth_from_any
from pyspark.sql import functions as F


def groups(rows, key, label):
    out = {}
    for r in rows:
        out.setdefault(r[label], set()).add(r[key])
    return sorted(map(sorted, out.values()))


def test_text_of_a_record(spark):
    df = spark.createDataFrame([(1, " Foo  BAR ", None, "X")], "ID int, Title string, authors string, address string")
    assert select_fields(df, "ID", ["title", "authors", "address", "zzz"]).first()[:] == ("1", "foo bar na x")
    with pytest.raises(ValueError):
        select_fields(df, fields=["zzz"])
    empty = spark.createDataFrame([("a", "")], "id string, title string")
    assert select_fields(empty).first()[1] == "" and select_fields(empty, normalize=False).first()[1] == " "
    assert spark.createDataFrame([("Ａﬁ",)], "t string").select(normalised(F.col("t"))).first()[0] == "afi"


def test_pairs_to_clusters(spark):
    rows = [("b", "a"), ("a", "b"), ("b", "c"), ("d", "d"), ("e", None), ("", "f"), ("g", "h")]
    assert groups(pairs_to_clusters(spark.createDataFrame(rows, "id1 string, id2 string")).collect(), 0, 1) == [["a", "b", "c"], ["g", "h"]]
    one = spark.createDataFrame([("a|b",), ("b|c|x",), ("z",), ("",)], "p string")
    assert groups(truth_from_any(spark, one).collect(), 0, 1) == [["a", "b", "c"]]
    assert pairs_to_clusters(spark.createDataFrame([], "id1 string, id2 string")).count() == 0


def test_truth_shapes(spark):
    assert truth_from_any(spark, None) is None
    assert truth_from_any(spark, {"a": 1}).collect()[0][:] == ("a", 1)
    t = spark.createDataFrame([(1, 7, "A"), (1, 8, "B"), (2, 9, "C")], "docid int, id int, label string").coalesce(1)
    assert sorted(map(tuple, truth_from_any(spark, t).collect())) == [("1", 7), ("2", 9)]
    with pytest.raises(TypeError):
        truth_from_any(spark, 3)


def test_embeddings(spark):
    df = spark.createDataFrame([(0, "[1, 0]"), (1, "[0,1,9]"), (2, "0.6 0.8"), (3, ""), (4, "[1]"), (5, None)], "rid long, e string")
    got = {r.rid: r.vector for r in parsed_embeddings(df, "e").collect()}
    assert got == {0: [1, 0], 1: [0, 1], 2: [0.6, 0.8], 3: [None, None], 4: [1, None], 5: [None, None]}
    assert modal_length(spark.createDataFrame([([1, 2],), ([1, 2],), ([1, 2, 3],), ([1, 2, 3],)], "v array<int>")) == 2
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None)], "rid long, vector array<double>")
    assert groups(embedding_clusters(v).collect(), 0, 1) == [[1, 2], [3], [4]]


def test_edit_clusters(spark):
    same = spark.createDataFrame([(i, "ab") for i in range(3)], "rid long, text string")
    assert len(groups(mst_clusters(same, zero_edges="drop").collect(), 0, 1)) == 3
    assert len(groups(mst_clusters(same, zero_edges="keep").collect(), 0, 1)) == 2
    four = spark.createDataFrame(list(enumerate(["ab", "ab", "abc", "xyz"])), "rid long, text string")
    assert groups(mst_clusters(four).collect(), 0, 1) == [[0, 1, 2], [3]]
    jaro = spark.createDataFrame(list(enumerate(["martha", "marhta", "dixon", "dicksonx"])), "rid long, text string")
    assert groups(neighbourhood_clusters(jaro).collect(), 0, 1) == [[0, 1], [2], [3]]


def test_distances(spark):
    df = spark.createDataFrame([("ca", "abc"), ("", ""), ("ab", "ba")], "a string, b string")
    got = [[r[0] for r in df.select(distance(F.col("a"), F.col("b"), m)).collect()] for m in ("lv", "osa", "dl", "lcs", "qgram", "jaccard")]
    assert got == [[3, 0, 2], [3, 0, 1], [2, 0, 1], [3, 0, 2], [1, 0, 0], [pytest.approx(1 / 3), 0, 0]]
    assert df.select(distance(F.col("a"), F.col("b"), "hamming")).first()[0] == float("inf")


def test_metrics(spark):
    df = spark.createDataFrame(list(zip([1, 1, 2, 2, 3], [1, 1, 1, 2, 2])), "pred_x int, cluster_id int")
    r = evaluate(df).first()
    assert (r.Precision, r.Recall) == (0.5, 0.25) and r.F1 == pytest.approx(1 / 3) and r.ARI == pytest.approx(1 / 11)
    f = spark.createDataFrame([("a", 5), ("b", None), ("c", 2), ("d", None)], "id string, cluster_id int")
    assert [x.cluster_id for x in filled_labels(f).orderBy("id").collect()] == [5, 6, 2, 7]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_components_both_ways(spark, limit):
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (None, 3)] + [(20, i) for i in range(30, 60)] + [(i, i + 1) for i in range(100, 120)]
    got = components(spark.createDataFrame(e, "src long, dst long"), one_task_bytes=limit).collect()
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in [20, *range(30, 60)]} | {i: 100 for i in range(100, 121)}
    assert {r[0]: r[1] for r in got} == want and len(got) == len(want)


def test_louvain_separates_cliques(spark):
    e = [(i, j, 1.0) for c in (0, 10) for i in range(c, c + 5) for j in range(i + 1, c + 5)] + [(0, 10, 1.0)]
    assert groups(louvain(spark.createDataFrame(e, "src long, dst long, w double")).collect(), 0, 1) == [list(range(5)), list(range(10, 15))]
