"""Repeated and null ids, clashing names, long texts, few rows: cases that the operators define."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from samewise.llm import embedding_dedup, exact_dedup, jaccard_join, language, mixing, packing, quality, sharding, toxicity
from test_operators import TOKENIZER, brute_classes

DOCS = "doc_id long, text string, source string, size string"


def filled(sizes, most=3.0):
    """Targets by plain water-filling: whoever is above its cap gets it, the rest share what is left, one after another."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        open_ -= full
        left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_meets_targets(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(1200):
        s = None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 23}"
        rows.append((i, "w " * (r.randint(1, 60) if r.random() < 0.9 else r.randint(500, 3000)), s, "x"))
    rows += [(2000 + i, "one two three", "tiny", "x") for i in range(3)] + [(3000, None, "none", "x"), (3001, "", "none", "x")]
    df = spark.createDataFrame(rows, DOCS)
    m = mixing.mix(df)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    got = {x.source: x for x in m.groupBy("source").agg(F.sum(F.expr("size * copies")).alias("taken"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()}
    for s, t in want.items():
        assert got[s].s == sizes[s] and got[s].t == pytest.approx(t, abs=1e-6)
        largest = max(len((x[1] or "").split()) for x in rows if x[2] == s)
        assert abs(got[s].taken - t) <= (max(3, 0.01 * t) if t > 20 * largest else 0.9 * largest), (s, got[s].taken, t)
    assert m.agg(F.max("copies")).first()[0] <= 3


def test_mixing_draws_are_fair():
    """Over all draws, each document gets its further copy as often as the rate's fraction says."""
    import pandas as pd

    r = np.random.default_rng(0)
    for sizes, part in (([1, 5, 7, 9, 20, 50, 300, 2000], 0.3), ([3, 4, 5, 6, 7, 8], 0.8), ([0, 1, 1000], 0.5)):
        pdf = pd.DataFrame({"source": "a", "cell": sizes, "source_size": sum(sizes), "target": (1 + part) * sum(sizes), "n": 2, "words": 2 * np.array(sizes)})
        pdf.source_size, pdf.target = 2 * pdf.source_size, 2 * pdf.target
        runs = [mixing._planned(pdf.assign(u=r.random(len(sizes)))).sort_values("cell").hits.to_numpy() for _ in range(3000)]
        assert np.abs(np.mean(runs, 0) / 2 - part).max() < 0.05


def test_embeddings_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [-1.0, 0.0], 0), (None, [1.0, 0.0], 0), (4, [-1.0, 0.0], 0)]
    got = sorted((tuple(x) for x in embedding_dedup.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True), (None, 0, None, True)], key=str)


def test_windows_cross_thin_partitions(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PARTITION_ROWS", 8)  # less than a window
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.standard_normal(4)], 0) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    v = np.array([x[1] for x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = (v @ v.T >= 0.93).sum(1) - 1
    got = {x.vec_id: x.n_links for x in embedding_dedup.embedding_classes(df, miss=0.5).collect()}
    assert [got[i] for i in range(120)] == links.tolist()


ODD = [(1, None, None, "x"), (2, "", "a", "x"), (3, "a  b\tc", "a", None), (4, "a b c", "b", "x"), (4, "a b c", "b", "x"), (None, "a b c", "b", "x"), (5, "long words " * 4000, "b", "x"), (None, None, None, None)]


def test_exact_dedup_of_hot_groups_and_clashing_names(spark, monkeypatch):
    rows = [(i, "same text  here" if i % 3 == 0 else f"text {i % 40}", "s", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _salt string, n long")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(" ".join(t.split()), []).append(i)
    want = {(i, min(g), len(g), i == min(g)) for g in groups.values() for i in g}
    for limit in (16 << 20, -1):  # with groups broadcast, and joined in salted parts
        monkeypatch.setattr("samewise.operators.shared.BROADCAST_BYTES", limit)
        got = exact_dedup.exact_dedup(df)
        assert got.columns[:4] == df.columns and {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()} == want
        kept = exact_dedup.survivors(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    odd = spark.createDataFrame(ODD, DOCS)
    assert sorted((r.doc_id for r in exact_dedup.survivors(odd).collect()), key=str) == [1, 3, 5]
    assert exact_dedup.survivors(odd.limit(0)).collect() == []


def plain_best_fit(lengths, room):
    import bisect

    free, opened = [], 0
    for k in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, k)
        opened += i == len(free)
        bisect.insort(free, (room if i == len(free) else free.pop(i)) - k)
    return opened


@pytest.mark.parametrize("stripe_rows", [1 << 16, 300, 40])
def test_packing_in_stripes(spark, stripe_rows):
    r = random.Random(7)
    lengths = [max(1, min(128, int(r.choice([r.gauss(40, 12), r.gauss(90, 20), r.randint(1, 30), 128])))) for _ in range(2500)]
    df = spark.createDataFrame([(i, n, "a", -1, i) for i, n in enumerate(lengths)], "_rank long, length int, offset string, sequence_id long, size long")
    out = packing.pack(df, 128, stripe_rows=stripe_rows)
    assert out.columns == ["_rank", "length", "size", "sequence_id", "offset"]
    rows, ends = out.orderBy("sequence_id", "offset").collect(), {}
    for x in rows:
        assert x.offset == ends.get(x.sequence_id, 0) and x.length == lengths[x._rank]
        ends[x.sequence_id] = x.offset + x.length
    assert len(rows) == 2500 and max(ends.values()) <= 128
    assert len(ends) <= 1.005 * plain_best_fit(lengths, 128) + (stripe_rows < 100)


def test_best_fit_places_every_document():
    r = random.Random(8)
    for shape in (lambda k: r.randint(0, 9), lambda k: 900 // k, lambda k: int(40 * 2.7 ** -(((k - 70) / 20) ** 2))):
        runs = [(k, 1000 * k, n) for k in range(1, 257) if (n := shape(k))]
        placed, left, _ = packing.best_fit(runs, [], 256, 0, True)
        assert not left and {k: sum(p[2] for p in placed if p[0] == k) for k, _, _ in runs} == {k: n for k, _, n in runs}
        used = {}
        for k, first, n, sequence, place in placed:
            for s in range(sequence, sequence + n):
                used.setdefault(s, []).append((place, k))
        for parts in used.values():
            at = 0
            for place, k in sorted(parts):
                assert place == at
                at += k
            assert at <= 256
        assert len(used) <= 1.005 * plain_best_fit([k for k, _, n in runs for _ in range(n)], 256)


def test_languages_without_letters(spark):
    rows = [(i, ("the river and the stone " if i % 2 else "der stein und nicht der fluss ") * 9, "en" if i % 2 else "de", "x") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, _found string")
    net = language.fit(d)
    odd = spark.createDataFrame([(1, "² ½ Ⅷ 12_", "a", "x"), (None, None, "b", "x"), (1, "", "c", "x"), (3, "the river and the stone " * 20000, "d", "x")], "doc_id long, text string, lang string, _found string")
    got = language.predict(odd, net)
    assert got.columns == [*odd.columns, "lang_pred", "score"]
    assert [(x.lang, x.lang_pred) for x in got.collect()] == [("a", "und"), ("b", "und"), ("c", "und"), ("d", "en")]


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("nice words here " if i % 2 else "stupid words here ") * 5, "s", "x") for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame(ODD, DOCS)
    model = toxicity.fit(docs, labels)
    assert [x.score > 0.5 for x in toxicity.score(spark.createDataFrame([(1, "you stupid thing", "s", "x"), (1, "nice thing " * 9000, "s", "x")], DOCS), model).collect()] == [True, False]
    assert toxicity.score(odd, model).count() == len(ODD) and all(0 <= x.score <= 1 for x in toxicity.score(odd, model).collect())
    described = quality.described(docs)
    fit = quality.fit(described, labels)
    assert all(0 <= x.score <= 1 for x in quality.score(quality.described(odd), fit).collect())


def test_shards_of_wide_and_narrow_ids(spark):
    rows = [(i, None if i % 9 == 0 else f"t{i}") for i in range(200)]
    wide, narrow = (spark.createDataFrame(rows, f"doc_id {kind}, text string") for kind in ("long", "int"))
    assert sorted(map(tuple, sharding.shard(wide, [1.0] * 8).collect()), key=str) == sorted(map(tuple, sharding.shard(narrow, [1.0] * 8).collect()), key=str)


def test_rendezvous_equals_the_least_bid(spark):
    """Each key's shard is the one with the least bid, computed one by one."""
    import math

    weights, df = [1.0, 0.0, 2.5], spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    hashes = df.select("doc_id", *[F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(s)), 12).alias(f"h{s}") for s in range(3)]).collect()
    got = {x.doc_id: x.s for x in df.select("doc_id", sharding.rendezvous(F.col("doc_id"), weights).alias("s")).collect()}
    for x in hashes:
        bids = {s: -math.log((x[f"h{s}"] + 0.5) / 2.0**52) / w for s, w in enumerate(weights) if w}
        assert got[x.doc_id] == min(bids, key=bids.get)


def test_one_of_each_leaves_clean_documents(spark):
    r = random.Random(9)
    base = [[f"w{r.randint(0, 500)}" for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(120):
        w = list(base[i % 8] if i % 2 else [f"v{i}x{k}" for k in range(40)])
        if i % 4 == 1:
            w[r.randrange(60)] = "changed"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(*x, None, "x") for x in rows] + [(500, None, None, "x"), (501, " ", None, "x")], DOCS)
    want = {i for i, (_, c) in brute_classes([*rows, (500, None), (501, " ")]).items() if c == i}
    assert {x.doc_id for x in jaccard_join.one_of_each(df).collect()} == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Each stage on nulls, empty and long texts, repeated rows and an empty table; clean documents stay."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(i, f"plain words about topic {i} and some more of them number {i * 7}", "en", f"s{i % 3}", 0) for i in range(40)]
    docs += [(100, None, None, None, None), (101, "", "en", "s1", 0), (None, "a text without any id at all", "en", "s1", 0), (7, docs[7][1], "en", "s1", 0), (102, "very long text " * 5000, "en", "s2", 0)]
    labels = [(i, 1, int(i >= 36)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    d = f"file://{tmp_path}"
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, spark.createDataFrame(docs, schema), d)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "exact_dedup":
            kept = out.collect()
            assert len(kept) == len(docs) - 2 and sum(x.doc_id == 7 for x in kept) == 1
        if name == "jaccard_join":
            assert {x.doc_id for x in out.collect()} >= {*range(40), 100, 101, 102}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), d).count() == 0, name
    packed = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(docs, schema), d)
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == {x[0] for x in docs}


def test_isotonic_equals_the_plain_formula():
    r = np.random.default_rng(5)
    for _ in range(30):
        rows = r.integers(1, 6, 12).astype(float)
        ones = np.array([r.integers(0, n + 1) for n in rows], float)
        want = [max(min(ones[a : b + 1].sum() / rows[a : b + 1].sum() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(quality.isotonic(ones, rows), want)


def test_ridge_equals_the_plain_solution(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice(["good", "Bad!!", "1234", "words,"]) for _ in range(r.randint(1, 60))), "s", "x") for i in range(120)]
    labels = [(i, int("1234" in t[:20])) for i, t, *_ in docs]
    described = quality.described(spark.createDataFrame(docs, DOCS).repartition(5))
    model = quality.fit(described, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = sorted((x.doc_id, np.frombuffer(x.stats)) for x in described.select("doc_id", "stats").collect())
    x, y = np.stack([s for _, s in rows]), np.array([z for _, z in sorted(labels)], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6), atol=1e-7)
    z = model.features(x)
    a, b = z.T @ z + quality.RIDGE * len(x) * np.eye(z.shape[1]) / quality.FEATURES, z.T @ y
    assert np.allclose(a @ model.weights, b, atol=1e-6)
    bins = model.bins(x)
    assert np.allclose(model.steps, quality.isotonic(np.bincount(bins, y, quality.BINS), np.bincount(bins, minlength=quality.BINS)))


def test_gradients_of_the_network():
    r = np.random.default_rng(7)
    net = language.Network(["a", "b", "c"])
    for p in net._params():
        p[...] += (r.standard_normal(p.shape) * 0.05).astype(np.float32)
    x, y = r.integers(0, 256, (6, language.LENGTH)).astype(np.uint8), r.integers(0, 3, 6)

    def loss():
        return -np.mean([net.log_probs(x, net.tables())[i, y[i]] for i in range(6)])

    for p, g in zip(net._params(), net._grads(x, y), strict=True):
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = p[place], 1e-2
        p[place] = old + h
        up = loss()
        p[place] = old - h
        down = loss()
        p[place] = old
        assert abs((up - down) / (2 * h) - g[place]) < 0.05 * abs(g[place]) + 2e-3


def test_toxic_scores_equal_the_plain_average():
    r = random.Random(8)
    words = ["nice", "day", "stupid", "stup1d", "tree", "house", "walk"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(60)]
    labels = np.array([int("stup" in t) for t in texts])
    model = toxicity.Model().fit(texts, labels, np.ones(60))
    score = model.scorer()
    pull = model.table @ (model.soft[:, 1] - model.soft[:, 0])
    for t in texts:
        w, best = t.split(), -np.inf
        begins = [0] if len(w) <= 12 else range(0, len(w) - 6, 6)
        for b in begins:
            seen = dict.fromkeys(w[b : b + 12])
            best = max(best, sum(np.mean(pull[toxicity.subwords(x)]) for x in seen) / 12 + model.bias[1] - model.bias[0])
        assert score(t) == pytest.approx(1 / (1 + np.exp(-(model.slope * best + model.shift))), abs=1e-5)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage's rows against a plain version of it on the rows that it got."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(10)
    words = [f"wo{k}" for k in range(300)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 40, 90, 700]))), "en", f"s{i % 4}", 0) for i in range(90)]
    docs += [(200 + i, docs[i][1].replace(" ", "  "), "en", "s1", 0) for i in range(0, 30, 2)]
    docs += [(300 + i, docs[i][1].replace("wo7 ", "wo8 ") + " end", "en", "s2", 0) for i in range(1, 30, 2)]
    docs = [(i, t + " stupid" if i % 9 == 0 else t, *rest) for i, t, *rest in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, 1, int(t.endswith("stupid"))) for i, t, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    now, d, seen = spark.createDataFrame(docs, schema), f"file://{tmp_path}", {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, now, d).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = sorted(map(tuple, now.collect()))
    rate = toxicity.fit(spark.createDataFrame(docs, schema), spark.read.parquet(f"{d}/labels.parquet")).scorer()
    assert {x[0] for x in seen["toxicity"]} == {i for i, t, *_ in docs if rate(t) < corpus_pipeline.TOXIC}
    assert {i for i, t, *_ in docs if not t.endswith("stupid")} <= {x[0] for x in seen["toxicity"]} and len(seen["toxicity"]) <= len(docs) - 10
    first = {}
    for i, t, *_ in seen["toxicity"]:
        first.setdefault(" ".join(t.split()), i)
    assert {x[0] for x in seen["exact_dedup"]} == set(first.values())
    assert {x[0] for x in seen["jaccard_join"]} == {i for i, (_, c) in brute_classes([(x[0], x[1]) for x in seen["exact_dedup"]]).items() if c == i}
    sizes, taken = {}, {}
    for x in seen["jaccard_join"]:
        sizes[x[3]] = sizes.get(x[3], 0) + len(x[1].split())
    for x in seen["mixing"]:
        taken[x[0]] = taken.get(x[0], 0) + 1
    goal = filled(sizes)
    for x in seen["jaccard_join"]:
        rate = goal[x[3]] / sizes[x[3]]
        assert int(rate + 1e-9) <= taken.get(x[0], 0) <= int(rate) + 1
    coder, pieces = Tokenizer.from_file(TOKENIZER), {}
    for x in seen["mixing"]:
        n = len(coder.encode(x[1], add_special_tokens=False).ids) + 1
        cuts = [n % 1024 or 1024] + [1024] * ((n - 1) // 1024)
        for k, size in enumerate(cuts):
            pieces[x[0], k, size] = pieces.get((x[0], k, size), 0) + 1
    got, ends = {}, {}
    for x in now.orderBy("sequence_id", "offset").collect():
        got[x.doc_id, x.piece, x.length] = got.get((x.doc_id, x.piece, x.length), 0) + 1
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert got == pieces and max(ends.values()) <= 1024
    assert len(ends) <= 1.005 * plain_best_fit([k[2] for k, n in pieces.items() for _ in range(n)], 1024) + 1


def test_sets_that_share_a_number_are_told_apart(spark, monkeypatch):
    from samewise.llm import shingles

    whole = shingles.halves
    monkeypatch.setattr(shingles, "halves", lambda h: (whole(h)[0] % 5, whole(h)[1]))
    monkeypatch.setattr(jaccard_join, "halves", shingles.halves)
    rows = [(i, " ".join(f"t{i // 2}w{k}" for k in range(30)) + (" end" if i % 2 else "")) for i in range(40)]
    df = spark.createDataFrame([(*x, None, "x") for x in rows], DOCS).coalesce(1)
    signed, taken = jaccard_join._told_apart(df.select("doc_id", "text"))
    assert taken and signed.select("sig").distinct().count() == 40
