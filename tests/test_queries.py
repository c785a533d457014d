from samewise.operators.clusterers import louvain
from samewise.operators.vectors import kmeans
from samewise.plans import queries as Q


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_repeated_records_are_kept(spark, tmp_path, monkeypatch):
    names = ["red bolt", "red bolt", "red nut", "blue nut", "blue nut", "green bolt", "green washer", "red bolt"]
    part = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(names)], "p_partkey long, p_name string, p_size int")
    d = folder(tmp_path, part=part)
    tree = {r.rid: r.label for r in Q.spanning_tree_clusters(spark, d).collect()}
    assert sorted(tree) == list(range(8)) and tree[0] == tree[1] == tree[7] and tree[3] == tree[4]
    pairs = {(r.lo, r.hi): r.w for r in Q.edit_distances_whole(spark, d).collect()}
    assert len(pairs) == 28 and pairs[0, 7] == 0 and pairs[0, 2] == 3 and pairs[2, 7] == 3
    assert sorted(r.rid for r in Q.louvain_text(spark, d).collect()) == list(range(8))
    seen = []
    whole = Q.unified_pipeline
    monkeypatch.setattr(Q, "unified_pipeline", lambda *a, **k: seen.append((a[1].count(), k)) or whole(*a, **k))
    assert {r.Method for r in Q.resolve(spark, d).collect()} >= {"kmeans", "louvain"} and seen == [(8, {})]


def test_components_of_all_edges(spark, tmp_path, monkeypatch):
    edges = [(i % 7, 10 * (i % 7) + i % 3) for i in range(60)] + [(20, 5), (20, 1), (21, 90), (None, 91)]
    line = spark.createDataFrame([(a, b, float(i % 50), 0.01) for i, (a, b) in enumerate(edges)], "l_suppkey long, l_partkey long, l_quantity double, l_discount double")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b + 1_000_000)
            up[max(x, y)] = min(x, y)
    want = {x: root(x) for x in up}
    d = folder(tmp_path, lineitem=line)
    assert {r.node: r.component for r in Q.graph_components_whole(spark, d).collect()} == want
    rounds = Q.components
    monkeypatch.setattr(Q, "components", lambda e: rounds(e, one_task_bytes=0))
    assert {r.node: r.component for r in Q.graph_components_whole(spark, d).collect()} == want


def test_louvain_runs_until_nothing_moves(spark):
    n = 120
    edges = [(min(i, (i + 1) % n), max(i, (i + 1) % n), 1.0) for i in range(n)]
    found = {r.node: r.label for r in louvain(spark.createDataFrame(edges, "src long, dst long, w double")).collect()}
    sizes = [sum(c == k for c in found.values()) for k in set(found.values())]
    inside = sum(found[a] == found[b] for a, b, _ in edges)
    assert len(found) == n and inside / n - sum((2 * k / (2 * n)) ** 2 for k in sizes) > 0.78


def test_kmeans_takes_the_best_of_twenty_runs(spark, monkeypatch):
    import pyspark.ml.clustering as ml

    seeds, fit = [], ml.KMeans.fit
    monkeypatch.setattr(ml.KMeans, "fit", lambda self, x: seeds.append(self.getSeed()) or fit(self, x))
    rows = spark.createDataFrame([(i, [float(i % 4), float(i // 4)]) for i in range(12)], "rid long, vector array<double>")
    assert kmeans(rows, 3).count() == 12 and len(set(seeds)) == 20
