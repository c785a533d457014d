import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from samewise.llm import embedding_dedup, exact_dedup, jaccard_join, language, mixing, packing, quality, sharding, simple8b, token_output, toxicity
from samewise.llm.jaccard_join import divide_skip
from samewise.llm.shingles import shingle_sets
from samewise.llm.tokens import encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string, size string"
ODD = [(1, None, None, "x"), (2, "", "a", "x"), (3, "a  b\tc", "a", None), (4, "a b c", "b", "x"), (4, "a b c", "b", "x"), (None, "a b c d e f", "b", "x"), (5, "word " * 3000, "b", "x")]


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        for v in [r.integers(0, 1 << b, n, dtype=np.uint64) for b in (1, 16, 63)] + [np.where(r.random(n) < 0.99, 0, 2**64 - 1).astype(np.uint64)]:
            w, o = simple8b.encode(v)
            assert (simple8b.decode(w, o, n) == v).all()


def test_encoder_equals_the_tokenizer():
    e, r = encoder(TOKENIZER), random.Random(1)
    texts = ["a  b", " x", "x ", "x\n y", "it's  they'll", "a<|endoftext|> b\n <|endoftext|>c", "\u00e9 \u00fc \u00f1 \u3000y"]
    texts += ["", None, "\n", "\n\n\nx", "x'\ny's\n", "\u00bdx \u00b2 y!'s", "\u0120a \u010a b", "x\t\t\ny \n z"]
    texts += ["".join(r.choice(" \n\tab,'s1\u00e9.\u0301\u00a0$") for _ in range(50)) for _ in range(300)]
    for _ in range(2):  # with the memo empty and full
        ids, many = e.batch(pa.array(texts), 7)
        at = np.cumsum(many) - many
        for t, i, n in zip(texts, at, many, strict=True):
            want = e.tokenizer.encode(t or "", add_special_tokens=False).ids
            assert ids[i : i + n].tolist() == [*want, 7] and e.ids(t).tolist() == want


def test_token_output(spark, tmp_path):
    df = spark.createDataFrame(ODD, DOCS)
    token_output.write_tokens(df, f"file://{tmp_path}/t", TOKENIZER, segment_ids=50)
    rows = token_output.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5]
    texts = {r[0]: r[1] for r in ODD}
    at = 0
    for r in rows:
        ids = [*encoder(TOKENIZER).tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.start == at
        at += len(ids)
    token_output.write_tokens(df.limit(0), f"file://{tmp_path}/e", TOKENIZER)
    assert token_output.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_packing(spark):
    df = spark.createDataFrame(ODD, DOCS)
    rows = packing.pack_documents(df, TOKENIZER, max_len=64).orderBy("sequence_id", "offset").collect()
    ends = {}
    for r in rows:
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64 and len(ends) <= -(-sum(r.length for r in rows) // 64) + 1
    ids = np.array([*encoder(TOKENIZER).tokenizer.encode(ODD[-1][1], add_special_tokens=False).ids, 2], "<u4")
    for r in rows:
        if r.doc_id == 5:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert packing.pack_documents(df.limit(0), TOKENIZER).count() == 0


def test_exact_dedup(spark):
    df = spark.createDataFrame(ODD, DOCS)
    rows = exact_dedup.exact_dedup(df).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows} == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (4, 3, 3, False), (None, None, 1, True), (5, 5, 1, True)}
    twice = spark.createDataFrame([(1, "a", "s", "z"), (1, "a", "s", "z"), (2, "a", "s", "z")], DOCS)
    assert exact_dedup.survivors(twice).collect() == [(1, "a", "s", "z")]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 30), None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}", "x") for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    m = mixing.mix(df)
    got = m.groupBy("source").agg(F.sum(F.expr("size * copies")).alias("taken"), F.first("target").alias("t"), F.first("source_size").alias("s"), F.max("copies").alias("c")).collect()
    total = sum(len(x[1].split()) for x in rows)
    assert sum(g.t for g in got) == pytest.approx(total) and all(g.t <= 3 * g.s + 1e-6 and g.c <= 3 for g in got)
    assert all(abs(g.taken - g.t) < 0.2 * g.t for g in got)
    assert sorted(m.select("doc_id", "copies").collect()) == sorted(mixing.mix(df.repartition(7)).select("doc_id", "copies").collect())
    assert mixing.emitted(m).count() == m.agg(F.sum("copies")).first()[0]
    odd = mixing.mix(spark.createDataFrame(ODD, DOCS))
    assert odd.count() == len(ODD) and mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_sharding(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", None, "x") for i in range(2000)] + [(None, None, None, None)], DOCS)
    rows = sharding.shard(df, [1.0] * 8, [1.0] * 9).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 8
    assert 0.06 < sum(r.grown_shard == 8 for r in rows) / 2001 < 0.17
    assert sharding.shard(df.limit(0), [1.0, 2.0]).count() == 0


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRED", 6)
    r = random.Random(3)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(20, 120))] for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A B"), (6, "a b c d e")]
    for i in range(7, 260):
        w = list(base[0] if i % 3 == 0 else r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"n{r.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_classes(spark.createDataFrame([(*x, None, "x") for x in rows], DOCS)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_classes(rows)
    assert jaccard_join.jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0
    assert len(jaccard_join.jaccard_classes(spark.createDataFrame(ODD, DOCS)).collect()) == len(ODD)


def test_divide_skip():
    r = np.random.default_rng(0)
    for _ in range(60):
        q = np.unique(r.integers(0, 90, 60)).astype(np.uint64)
        cs = [np.unique(np.where(r.random(len(q)) < p, q, r.integers(0, 200, len(q)))).astype(np.uint64) for p in (0.5, 0.8, 0.9, 0.95, 1.0)]
        want = [i for i, c in enumerate(cs) if 100 * len(np.intersect1d(q, c)) >= 75 * len(np.union1d(q, c))]
        assert sorted(divide_skip(q, cs)) == want


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(1)
    rows, centre = [], r.standard_normal((30, 16))
    for i in range(400):
        c = 0 if i % 3 == 0 else int(r.integers(30))
        rows.append((i, [float(x) for x in np.float32(centre[c] + r.standard_normal(16) * 0.12)], c % 3))
    rows += [(400, rows[0][1], 0), (401, None, 0), (402, [0.0] * 16, 0), (403, [None] * 16, 0), (404, [float("nan")] * 16, 0), (405, rows[0][1], None), (406, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in embedding_dedup.embedding_classes(df).collect()}
    v = {i: np.array(x, float) / np.linalg.norm(np.array(x, float)) for i, x, lab in rows[:401]}
    links = {i: [j for j in v if j != i and rows[i][2] == rows[j][2] and v[i] @ v[j] >= 0.93] for i in v}
    assert all(got[i].n_links == len(links[i]) for i in v)
    for i in v:
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(401, 407))
    assert embedding_dedup.embedding_classes(df.limit(0)).count() == 0


def test_classifiers(spark):
    r = random.Random(4)
    en, de = ["the", "and", "with", "river", "stone"], ["und", "der", "nicht", "schön", "straße"]
    docs, labels = [], []
    for i in range(400):
        lang, bad = ("en", i % 4 == 0) if i % 2 else ("de", i % 8 == 0)
        w = [r.choice(en if lang == "en" else de) for _ in range(r.randint(10, 90))]
        if bad:
            w[r.randrange(len(w))] = r.choice(["stupidest", "stupid", "stupidly"])
        docs.append((i, " ".join(w) if i % 5 else " ".join(w).upper() + "!!", lang, None))
        labels.append((i, int(bool(i % 5)), int(bad)))
    docs += [(1000, None, None, None), (1001, "", "en", None), (1002, "12 34", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, label string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tox = {x.doc_id: x.score for x in toxicity.score(d, toxicity.fit(d, lab)).collect()}
    assert sum((tox[i] >= 0.5) == bool(t) for i, _, t in labels) > 390 and all(0 <= s <= 1 for s in tox.values())
    found = {x.doc_id: x for x in language.predict(d, language.fit(d)).collect()}
    assert sum(found[i].lang_pred == docs[i][2] for i in range(400)) > 390
    assert found[1000].lang_pred == found[1001].lang_pred == found[1002].lang_pred == "und"
    described = quality.described(d)
    q = {x.doc_id: x.score for x in quality.score(described, quality.fit(described, lab)).collect()}
    assert sum((q[i] >= 0.5) == bool(z) for i, z, _ in labels) > 390 and len(q) == 403
    for model, score in ((toxicity.fit(d, lab.limit(0)), lambda m: toxicity.score(d.limit(0), m)), (quality.fit(described, lab.limit(0)), lambda m: quality.score(described.limit(0), m)), (language.fit(d.limit(0)), lambda m: language.predict(d.limit(0), m))):
        assert score(model).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    words = [f"wo{k}" for k in range(200)]
    docs = [(i, " ".join(r.choice(words) for _ in range(40)), "en", f"s{i % 3}", 0) for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "s1", 0) for i in range(20)]
    labels = [(i, 1, i % 2) for i in range(20)]
    docs = [(i, t + " stupid" if i < 20 and i % 2 else t, a, b, c) for i, t, a, b, c in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    ids = {x.doc_id for x in out}
    assert ids and not ids & {i for i in range(100, 120) if (i - 100) not in range(1, 20, 2)}
    assert not [i for i in ids if i < 20 and i % 2]
