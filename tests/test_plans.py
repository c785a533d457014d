"""Readers, the whole plan, and the clusterers against plain versions of themselves."""

import http.server
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from samewise.functions import text as T
from samewise.operators import clusterers as C
from samewise.operators.records import select_fields, truth_from_any
from samewise.operators.vectors import kmeans, neighbours, svd_scores
from samewise.plans.resolve import unified_pipeline
from samewise.sources import load


def plain_jaro(a, b):
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken.add(j)
            mine.append(x)
    if not mine:
        return 0.0
    k, moved = len(mine), sum(x != b[j] for x, j in zip(mine, sorted(taken), strict=True)) / 2
    return (k / len(a) + k / len(b) + (k - moved) / k) / 3


def test_jaro_equals_the_plain_version(spark):
    r = random.Random(1)
    words = ["", "a", "martha", "marhta", "dixon", "dicksonx", "éè", "\U0001f600a"] + ["".join(r.choice("abcdé") for _ in range(r.randint(0, 30))) for _ in range(120)]
    pairs = [(r.choice(words), r.choice(words)) for _ in range(3000)]
    assert np.allclose(T.jaro_pairs([a for a, _ in pairs], [b for _, b in pairs]), [plain_jaro(a, b) for a, b in pairs], atol=1e-12)
    rows = spark.createDataFrame([("a", "a"), (None, "a"), ("a", None), ("", "")], "a string, b string")
    assert [x.s for x in rows.select(T.jaro_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, None, None, 1.0]


def test_normalised_texts(spark):
    rows = spark.createDataFrame([(" Straße  ﬁn ",), (None,), ("  A  b\t",), ("ＡＢ",)], "t string")
    assert [x.n for x in rows.select(T.normalised(F.col("t")).alias("n")).collect()] == ["straße fin", None, "a b", "ab"]


def test_blocks_of_the_neighbourhood_meet(spark, monkeypatch):
    r = random.Random(2)
    names = ["".join(r.choice("ab") for _ in range(8)) for _ in range(90)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(names)), "rid long, text string")
    whole = sorted(map(tuple, C.neighbourhood_links(df, 7).collect()))
    monkeypatch.setattr(C, "BLOCK_ROWS", 10)
    assert sorted(map(tuple, C.neighbourhood_links(df, 7).collect())) == whole
    order = sorted((t, i) for i, t in enumerate(names) if t is not None)
    want = [(i, j) for a, (x, i) in enumerate(order) for y, j in order[a + 1 : a + 8] if 1 - plain_jaro(x, y) <= 0.12 + 1e-12]
    assert whole == sorted(want)
    near = sorted(map(tuple, C.neighbourhood_links(df, 7, "lv", 1).collect()))
    assert near and all(sum(p != q for p, q in zip(names[i], names[j], strict=True)) <= 1 for i, j in near)


def test_neighbours_of_other_lengths_take_no_part(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(5).tolist()) for i in range(60)] + [(60, [1.0, 2.0]), (61, None), (62, []), (63, [0.0] * 5), (64, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "rid long, vector array<double>")
    for block in (1024, 16):
        monkeypatch.setattr("samewise.operators.vectors.BLOCK", block)
        got = {}
        for x in neighbours(df, 4).collect():
            got.setdefault(x.rid, {})[x.place] = x.other
        v = np.array([x[1] for x in rows[:60]])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        s = v @ v.T
        np.fill_diagonal(s, -2)
        assert got == {i: {p + 1: int(j) for p, j in enumerate(np.argsort(-s[i], kind="stable")[:4])} for i in range(60)}


def test_spanning_forest_equals_kruskal(spark):
    r = random.Random(4)
    edges = [(i, j, r.randint(1, 5)) for i in range(25) for j in range(i + 1, 25) if r.random() < 0.3]
    got = {(x.lo, x.hi, x.w) for x in C.spanning_forest(spark.createDataFrame(edges, "lo long, hi long, w int")).collect()}
    up = list(range(25))

    def root(x):
        return x if up[x] == x else root(up[x])

    want = set()
    for i, j, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if root(i) != root(j):
            up[root(i)] = root(j)
            want.add((i, j, w))
    assert got == want
    with pytest.raises(ValueError):
        C.mst_clusters(spark.createDataFrame([(i, "a") for i in range(4)], "rid long, text string"), most_rows=3)


def test_scores_of_the_decomposition(spark):
    texts = ["red bolt", "red nut", "blue nut nut", "blue washer", "green bolt", "", "red red washer"]
    got = {x.rid: np.array(x.vector) for x in svd_scores(spark.createDataFrame(list(enumerate(texts)), "rid long, text string"), 3).collect()}
    words = sorted({w for t in texts for w in t.split()})
    share = np.array([[t.split().count(w) / max(1, len(t.split())) for w in words] for t in texts])
    x = share * np.log((len(texts) + 1) / ((share > 0).sum(0) + 1))
    u, d, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :3] * d[:3]
    have = np.stack([got[i] for i in range(len(texts))])
    assert np.allclose(have @ have.T, want @ want.T, atol=1e-8)


def test_kmeans_finds_separate_groups(spark):
    rows = [(i, [float(10 * (i % 3)) + 0.01 * i, 0.0]) for i in range(30)]
    got = {x.rid: x.label for x in kmeans(spark.createDataFrame(rows, "rid long, vector array<double>"), 3).collect()}
    assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in got)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID;Name;x\n1;"a;b";NA\n2;c;3\n')
    rows = load.load_input(spark, f"file://{tmp_path}/a.csv")
    assert rows.columns == ["id", "name", "x"] and sorted(map(tuple, rows.collect())) == [(1, "a;b", None), (2, "c", 3)]
    for bad in (3, None):
        with pytest.raises(TypeError):
            load.load_input(spark, bad)
    with pytest.raises(ValueError):
        load.lowered(spark.createDataFrame([(1, 2)], "a int, A int"))
    (tmp_path / "pairs.psv").write_text("x|y\na|b\nb|c\nd|\n\n")
    assert sorted(map(tuple, truth_from_any(spark, f"file://{tmp_path}/pairs.psv").collect())) == [("a", 1), ("b", 1), ("c", 1)]
    (tmp_path / "truth.tsv").write_text("label\tdocid\nu\t1\nv\t2\nw\t2\n")
    assert sorted(map(tuple, truth_from_any(spark, f"file://{tmp_path}/truth.tsv").collect())) == [("1", "u"), ("2", "v")]
    with pytest.raises((RuntimeError, FileNotFoundError)):
        load.load_input(spark, "/nowhere/a.xlsx")

    class Serve(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"Id|Name\n1|a\n2|b,c\n")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Serve)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = load.load_input(spark, f"http://127.0.0.1:{server.server_port}/t.csv")
        assert got.columns == ["id", "name"] and sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b,c")]
    finally:
        server.shutdown()


def test_the_whole_plan(spark, tmp_path):
    names = ["red bolt", "red bolt", "red nutt", "red nut", None, "blue nut", "blue nut", "green washer", "green washers", ""]
    rows = [(f"r{i}", t, i, [1.0, 0.1 * (i // 2)] if i < 8 else None) for i, t in enumerate(names)]
    df = spark.createDataFrame(rows, "Rec_ID string, Title string, Extra int, Emb array<double>")
    gold = {f"r{i}": i // 2 for i in range(8)}
    out = unified_pipeline(spark, df, gold, fields=["TITLE", "none"], extra_fields=["Extra"], k_clusters=3, knn_k=2, svd_dim=5, write_csv=f"file://{tmp_path}/out")
    assert out.details["used_fields"] == ["title", "extra"] and out.details["n"] == 10 and out.details["has_embeddings"]
    assert out.details["params"]["k_clusters"] == 3 and out.details["params"]["eval_mode"] == "labeled_only"
    p = {x.id: x for x in out.predictions.collect()}
    assert len(p) == 10 and p["r4"].text_for_matching == "na 4" and p["r9"].cluster_id is None
    assert {x.Method for x in out.performance.collect()} == {"kmeans", "MST_or_SN_Edit", "louvain", "Embed_kNN"}
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).count() == 10
    filled = unified_pipeline(spark, df, gold, k_clusters=3, knn_k=2, svd_dim=5, eval_mode="singleton_fill").predictions
    assert sorted(x.cluster_id for x in filled.collect()) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 5]
    for bad in ({"eval_mode": "x"}, {"label_mode": "x"}, {"id_col": "zz"}, {"fields": ["zz"]}):
        with pytest.raises(ValueError):
            unified_pipeline(spark, df, gold, **bad)


def test_ids_are_row_numbers_without_an_id_column(spark):
    df = spark.createDataFrame([("b",), ("a",)], "name string").coalesce(1)
    assert sorted(map(tuple, select_fields(df).collect())) == [("1", "b"), ("2", "a")]
