import numpy as np

from samewise.llm import embedding_dedup


def test_vectors_that_lean_one_way(spark):
    r, n, pairs = np.random.default_rng(3), 3000, 600

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    x = unit(np.sqrt(0.85) * unit(r.standard_normal(64)) + np.sqrt(0.15) * unit(r.standard_normal((n, 64))))
    a = x[:pairs]
    off = r.standard_normal(a.shape)
    x[pairs : 2 * pairs] = 0.932 * a + np.sqrt(1 - 0.932**2) * unit(off - (off * a).sum(1, keepdims=True) * a)
    near = unit(x) @ unit(x).T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    up = np.arange(n)
    while True:  # the smallest id of the component, by spreading it over links
        low = np.minimum(up, np.where(near, up[None], n).min(1))
        if (low == up).all():
            break
        up = low
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    got = embedding_dedup.embedding_classes(df).orderBy("vec_id").collect()
    assert [g.n_links for g in got] == near.sum(1).tolist()
    assert [g.component_id for g in got] == up.tolist()


def test_leaning_labels_are_whole_at_any_size(spark, monkeypatch):
    r = np.random.default_rng(5)
    lean = np.sqrt(0.85) * r.standard_normal(64) / 8 + np.sqrt(0.15) * r.standard_normal((600, 64)) / 8
    plain = {"1": r.standard_normal((600, 64)), "2": r.standard_normal((60, 64))}
    labels = {"0": lean} | plain
    rows = [(1000 * int(k) + i, k, x.astype("<f8").tobytes()) for k, v in labels.items() for i, x in enumerate(v)]
    distinct = spark.createDataFrame(rows, "rep long, label string, vec binary")
    seen = []
    for block in (512, 1):  # the second as if the label had 512 times the rows: more blocks than passes
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        needs = embedding_dedup._needs(distinct, 0.93, 32, 1e-5, 5, "<f8").collect()
        seen.append({x.label: (x.whole, x.passes) for x in needs})
    assert seen[0] == seen[1] and [seen[0][k][0] for k in "012"] == [True, False, False]


def test_a_label_takes_passes_of_its_own(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i + 10000 * k, k, v.tolist()) for k, n in enumerate((1500, 60)) for i, v in enumerate(r.standard_normal((n, 16)))]
    seen, windows = [], embedding_dedup._windows
    monkeypatch.setattr(embedding_dedup, "_windows", lambda distinct, *a: seen.append({x.label: x.passes for x in distinct.select("label", "passes").distinct().collect()}) or windows(distinct, *a))
    got = {x.vec_id: x.n_links for x in embedding_dedup.embedding_classes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), threshold=0.8, miss=1e-3).collect()}
    assert seen[0]["1"] < seen[0]["0"]
    for k, n in enumerate((1500, 60)):
        v = np.array([x for _, lab, x in rows if lab == k])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        links = (v @ v.T >= 0.8).sum(1) - 1
        assert sum(got[i + 10000 * k] == links[i] for i in range(n)) >= 0.99 * n
