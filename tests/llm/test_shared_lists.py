"""Near copies share many short lists: their pairs are counted in few places, and told from others before their sets are fetched."""

import random

import pyarrow as pa

from samewise.llm import jaccard_join
from samewise.llm.shingles import shingle_sets

DOCS = "doc_id long, text string"


def near_copies(groups, size, words=300, changed=1, seed=7):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(changed):
                own[r.randrange(words)] = f"x{r.randrange(10**6)}"
            out.append(" ".join(own))
    return out


def test_pairs_are_not_counted_in_every_bucket(spark, monkeypatch):
    rows = list(enumerate(near_copies(4, 20)))
    made, write = {}, jaccard_join.written

    def noted(df, name="table"):
        out = write(df, name)
        made.setdefault(name, out.count())
        return out

    monkeypatch.setattr(jaccard_join, "written", noted)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_classes(spark.createDataFrame(rows, DOCS)).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {i: i // 20 * 20 for i, _ in rows}
    pairs = 4 * 20 * 19 // 2
    assert made["found"] < 3 * pairs and pairs <= made.get("counted", pairs) < 3 * pairs


def test_members_far_apart_in_size(spark):
    """A list is cut where sizes leave a gap that no link spans, and nothing is lost on either side."""
    short, long = near_copies(1, 4, words=100), near_copies(1, 4, words=400, seed=8)
    rows = list(enumerate([*short, *(f"{x} {short[0]}" for x in long)]))
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i // 4 * 4 for i in range(8)}


def test_outlines_rule_out_no_link():
    sets = [list(shingle_sets(pa.array(near_copies(1, 30, words=n, changed=n // 40 + 1, seed=n)))) for n in (3, 7, 40, 300, 2000)]
    sets = [s for group in sets for s in group]
    far = ruled_out = 0
    for q in sets[::7]:
        # the index hands on pairs of like sizes only
        like = [s for s in sets if 100 * min(len(s), len(q)) >= 75 * max(len(s), len(q))]
        possible = {*jaccard_join.may_link(jaccard_join.outline(q), [jaccard_join.outline(s) for s in like])}
        for i, s in enumerate(like):
            both = len({*q.tolist()} & {*s.tolist()})
            union = len(q) + len(s) - both
            assert 100 * both < 75 * union or i in possible
            far += 100 * both < 60 * union
            ruled_out += 100 * both < 60 * union and i not in possible
    assert far > 100 and ruled_out > 0.8 * far


def test_near_copies_of_a_text_that_only_null_ids_have(spark):
    texts = near_copies(8, 2)
    rows = [(i if i % 2 else None, t) for i, t in enumerate(texts)]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, DOCS)).collect()
    assert {x.doc_id: x.component_id for x in got if x.doc_id is not None} == {i: i for i in range(1, 16, 2)} and len(got) == 16
