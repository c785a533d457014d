"""Tables in which many rows are alike: what is compared and shuffled follows from the distinct rows."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from samewise.operators import clusterers as C
from samewise.operators.shared import written
from samewise.operators.vectors import neighbours


def shuffled_rows(spark):
    """Rows that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def copies(n=600, kinds=3, d=6):
    r = np.random.default_rng(8)
    v = r.standard_normal((kinds, d)).tolist()
    return [(i, v[i % kinds]) for i in range(n)]


def test_neighbours_of_copies(spark, monkeypatch):
    monkeypatch.setattr("samewise.operators.vectors.BLOCK", 4)
    rows = copies() + [(600, (np.array(copies()[0][1]) + 0.01).tolist())]
    before = shuffled_rows(spark)
    got = {}
    for x in neighbours(spark.createDataFrame(rows, "rid long, vector array<double>"), 5).collect():
        got.setdefault(x.rid, {})[x.place] = x.other
    assert shuffled_rows(spark) - before < 4 * len(rows)  # 150 blocks of all rows shuffled 90000
    want = {}
    for i, _ in rows[:-1]:
        want[i] = {p + 1: j for p, j in enumerate([j for j in range(i % 3, 600, 3) if j != i][:5])}
    want[600] = dict(enumerate([0, 3, 6, 9, 12], 1))
    assert got == want


def test_louvain_by_components_equals_the_whole(spark):
    r = random.Random(3)
    rows = copies(150, 5) + [(200 + i, [r.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(300, [0.0] * 6)]
    df = spark.createDataFrame(rows, "rid long, vector array<double>").withColumn("text", F.lit("x"))
    for k, least in ((4, 0.0), (3, 0.9)):
        near = neighbours(df, k, least=least).select(F.least("rid", "other").alias("src"), F.greatest("rid", "other").alias("dst")).distinct()
        want = {x: x for x, _ in rows} | {x.node: x.label for x in C.louvain(near.withColumn("w", F.lit(1.0))).collect()}
        assert {x.rid: x.label for x in C.louvain_clusters(df, k, least, scores=df).collect()} == want
    rounds = {x.rid: x.label for x in C.louvain_clusters(df, 3, 0.9, scores=df, component_links=60).collect()}
    assert sorted(rounds) == sorted(want) and rounds[300] == 300


def test_shuffle_files_go_with_the_write(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before = files()
    written(spark.range(5000).groupBy((F.col("id") % 977).alias("k")).count())
    for _ in range(50):
        left = [x for x in files() - before if x.startswith("shuffle")]
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_neighbourhood_of_copies(spark):
    names = [f"{a} {b}" for a in ("red", "blue", "green") for b in ("bolt", "nut", "rod")]
    df = spark.createDataFrame([(i, names[i * i % 7]) for i in range(400)], "rid long, text string")
    star, links = C.neighbourhood_links(df, spanning=True), C.neighbourhood_links(df)
    assert star.count() < 400 < 10 * 400 < links.count()
    assert {x.rid: x.label for x in C.neighbourhood_clusters(df).collect()} == {x.rid: x.label for x in C.labelled(df, links).collect()}


def test_roots():
    r = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 20), (50, 49), (300, 150)):
        i, j = r.integers(0, n, m), r.integers(0, n, m)
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert C.roots(n, i, j).tolist() == want.tolist()
