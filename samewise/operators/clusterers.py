"""The four record clusterers: k-means on text, edit distance, Louvain on text neighbours, embedding neighbours.

Each takes (rid long, text or vector) and gives (rid, label) with a label for every row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.functions.text import distance, jaro_pairs, normalised
from samewise.operators.components import ONE_TASK_BYTES, components
from samewise.operators.shared import dropped, ranked, small, table_bytes, written
from samewise.operators.vectors import kmeans, neighbour_lists, neighbours, svd_scores

#: Most rows for which all pairs are compared.
MST_ROWS = 3000
#: Rows of a block of the sorted neighbourhood.
BLOCK_ROWS = 8192
#: Links of a connected component, about, that one task holds to move its nodes one at a time.
COMPONENT_LINKS = 1 << 20


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rid, label): the smallest rid of the component, also for rows without an edge."""
    c = components(edges)
    return nodes.select("rid").join(c, nodes.rid == c.node, "left").select("rid", F.coalesce("component", "rid").alias("label"))


def edit_pairs(df: DataFrame) -> DataFrame:
    """(lo, hi, w): Levenshtein distances of all pairs of rows (J-2)."""
    a, b = df.select(F.col("rid").alias("lo"), F.col("text").alias("x")), df.select(F.col("rid").alias("hi"), F.col("text").alias("y"))
    return a.join(b, F.col("lo") < F.col("hi")).select("lo", "hi", F.levenshtein("x", "y").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of (lo, hi, w) in Boruvka's rounds, unique by the order (w, lo, hi) (M-6)."""
    edges = written(edges, "weights")
    kept = edges.limit(0)
    while True:
        if kept.isEmpty():
            e = edges.withColumns({"cl": F.col("lo"), "ch": F.col("hi")})
        else:
            e, c = edges, written(components(kept.select(F.col("lo").alias("src"), F.col("hi").alias("dst"))), "labels")
            for side, name in (("lo", "cl"), ("hi", "ch")):
                e = e.join(small(c.select(F.col("node").alias(side), F.col("component").alias(name)), c), side, "left").withColumn(name, F.coalesce(name, side))
        e = written(e.where("cl <> ch"), "weights")  # edges inside a tree are done with
        least = F.min(F.struct("w", "lo", "hi")).alias("e")
        new = e.groupBy(F.col("cl").alias("c")).agg(least).union(e.groupBy(F.col("ch").alias("c")).agg(least)).groupBy("c").agg(F.min("e").alias("e")).select("e.lo", "e.hi", "e.w").distinct()
        new = written(new, "forest")
        dropped(edges)
        edges = e.drop("cl", "ch")
        edges._samewise_path = e._samewise_path
        if new.isEmpty():
            return kept
        kept = written(kept.unionByName(new), "forest")


def mst_clusters(df: DataFrame, cut_ratio: int = 5, k: int | None = None, zero_edges: str = "keep", most_rows: int = MST_ROWS) -> DataFrame:
    """Cuts the min(k - 1, all) heaviest edges of the forest, k = max(2, n // cut_ratio) (M-7). zero_edges: keep or drop (T4).

    All pairs are compared, so more than ``most_rows`` rows are an error.
    """
    n = df.count()
    if n > most_rows:
        raise ValueError(f"{n} rows; a spanning tree over all pairs takes {most_rows} at most")
    if n < 2:
        return df.select("rid", F.lit(1).cast("long").alias("label"))
    pairs = edit_pairs(df)
    forest = spanning_forest(pairs.where("w > 0") if zero_edges == "drop" else pairs)
    k = max(2, n // cut_ratio) if k is None else k
    cut = forest.orderBy(F.desc("w"), F.desc("lo"), F.desc("hi")).limit(max(0, k - 1))
    rest = forest.join(cut, ["lo", "hi"], "left_anti")
    return labelled(df, rest.select(F.col("lo").alias("src"), F.col("hi").alias("dst")))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the edges (i, j) connect it with."""
    root = np.arange(n)
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def neighbourhood_links(df: DataFrame, window: int = 40, method: str = "jw", threshold: float = 0.12, spanning: bool = False) -> DataFrame:
    """(src, dst): rows within ``window`` places in the order of the normalised text, at a distance of ``threshold`` at most,
    give or take 1e-12 (J-3).

    The rows are range-sorted once; blocks of consecutive places, each with the ``window`` rows after it, are compared by
    themselves. spanning: with jw, a star for each set of rows that a block's links connect, in
    place of the links.
    """
    keyed = df.select("rid", "text", normalised(F.col("text")).alias("key"))
    placed = ranked(keyed, ["key", "rid"], "place").select("rid", "text", "place")
    rows = max(BLOCK_ROWS, window)
    block = F.floor(F.col("place") / rows)
    both = F.when((F.col("place") % rows < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    laid = placed.withColumn("block", F.explode(both))

    def pairs(pdf):
        """Places in the block of pairs, and the codes of their texts."""
        pdf = pdf.sort_values("place")
        code, texts = pd.factorize(pdf.text, use_na_sentinel=True)
        i = np.repeat(np.flatnonzero((pdf.place // rows == pdf.block.iloc[0]).to_numpy()), window)
        j = i + np.tile(np.arange(1, window + 1), len(i) // window)
        i, j = i[j < len(pdf)], j[j < len(pdf)]
        known = (code[i] >= 0) & (code[j] >= 0)
        i, j = i[known], j[known]
        return pdf.rid.to_numpy(), list(texts), i, j, code[i], code[j]

    def linked(rid, i, j):
        if spanning:
            to = roots(len(rid), i, j)
            i = np.flatnonzero(to != np.arange(len(to)))
            j = to[i]
        return pd.DataFrame({"src": rid[i], "dst": rid[j]})

    if method == "jw":

        def close(pdf):
            rid, texts, i, j, x, y = pairs(pdf)
            kinds, of = np.unique(x * np.int64(len(texts)) + y, return_inverse=True)
            p, q = kinds // max(1, len(texts)), kinds % max(1, len(texts))
            size = np.array([len(t) for t in texts] or [0])
            lo, hi = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
            far = np.ones(len(kinds))
            far[p == q] = 0.0
            may = np.flatnonzero((p != q) & ((2 + lo / np.maximum(1, hi)) / 3 >= 1 - threshold - 1e-12))
            far[may] = 1 - jaro_pairs([texts[k] for k in p[may]], [texts[k] for k in q[may]])
            near = (far <= threshold + 1e-12)[of]
            return linked(rid, i[near], j[near])

        return laid.groupBy("block").applyInPandas(close, "src long, dst long")

    def spread(pdf):
        rid, texts, i, j, x, y = pairs(pdf)
        return pd.DataFrame({"src": rid[i], "dst": rid[j], "x": [texts[k] for k in x], "y": [texts[k] for k in y]})

    found = laid.groupBy("block").applyInPandas(spread, "src long, dst long, x string, y string")
    d = distance(F.col("x"), F.col("y"), method)
    return found.withColumn("d", d).where(~F.isnan("d") & (F.col("d") <= threshold + 1e-12)).select("src", "dst")


def neighbourhood_clusters(df: DataFrame, window: int = 40, method: str = "jw", threshold: float = 0.12) -> DataFrame:
    return labelled(df, neighbourhood_links(df, window, method, threshold, spanning=True))


def edit_clusters(df: DataFrame, strategy: str = "auto", cut_ratio: int = 5, k: int | None = None, zero_edges: str = "keep", window: int = 40, method: str = "jw", threshold: float = 0.12) -> DataFrame:
    """Minimum spanning tree for up to MST_ROWS rows, sorted neighbourhood for more (M-5)."""
    if strategy == "mst" or strategy == "auto" and df.limit(MST_ROWS + 1).count() <= MST_ROWS:
        return mst_clusters(df, cut_ratio, k, zero_edges)
    return neighbourhood_clusters(df, window, method, threshold)


def kmeans_clusters(df: DataFrame, k: int = 10, dim: int = 100, seed: int = 123, scores: DataFrame | None = None) -> DataFrame:
    return kmeans(svd_scores(df, dim) if scores is None else scores, k, seed)


def modularity(edges: DataFrame, labels: DataFrame, m: float | None = None) -> float:
    """Of (src, dst, w), loops once, under (node, label); what the edges add to it in a graph of weight m."""
    m = edges.agg(F.sum("w")).first()[0] if m is None else m
    if not m:
        return 0.0
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    e = edges.join(a, "src").join(b, "dst")
    inside = e.where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    ends = e.select(F.col("a").alias("c"), "w").union(e.select("b", "w")).groupBy("c").agg(F.sum("w").alias("k"))
    return inside / m - ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (4 * m * m)


def _one_at_a_time(edges, twice: float | None = None) -> dict[int, int]:
    """node -> label of undirected edges (x, y, w), each once: sweeps until no node moves, levels until none has a move.

    twice: twice the weight of the whole graph, where the edges are some of its components; what they get is what the whole gives them.
    """
    links: dict[int, dict[int, float]] = {}
    for x, y, w in sorted(edges):
        for p, q in ((x, y), (y, x)):  # a loop counts twice
            at = links.setdefault(p, {})
            at[q] = at.get(q, 0.0) + w
    whole = {v: v for v in links}
    twice = sum(sum(at.values()) for at in links.values()) if twice is None else twice
    while links:
        degree = {v: sum(at.values()) for v, at in links.items()}
        label, total, moved, busy = {v: v for v in links}, dict(degree), False, True
        while busy:
            busy = False
            for v in sorted(links):
                own, k = label[v], degree[v]
                to = {own: 0.0}
                for o, w in links[v].items():
                    if o != v:
                        to[label[o]] = to.get(label[o], 0.0) + w
                total[own] -= k
                gain = {c: w - k * total[c] / twice for c, w in to.items()}
                best = max(gain, key=lambda c: (gain[c], -c))
                if gain[best] <= gain[own] + 1e-9:
                    best = own
                total[best] += k
                if best != own:
                    label[v], busy, moved = best, True, True
        if not moved:
            break
        whole = {v: label[c] for v, c in whole.items()}
        merged: dict[int, dict[int, float]] = {}
        for v, at in links.items():
            into = merged.setdefault(label[v], {})
            for o, w in at.items():
                into[label[o]] = into.get(label[o], 0.0) + w
        links = merged
    return whole


def _louvain_in_one_task(edges: DataFrame) -> DataFrame:
    """One node at a time, over a checked number of edges."""

    def merge(batches):
        import pyarrow as pa

        whole = _one_at_a_time(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int64()), pa.array(list(whole.values()), pa.int64())], ["node", "label"])

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), "w").coalesce(1).mapInArrow(merge, "node long, label long")


def louvain(edges: DataFrame, one_task_bytes: int = ONE_TASK_BYTES, weight: float | None = None) -> DataFrame:
    """(node, label) for the nodes of undirected (src, dst, w) edges: local moves, then merged communities, level by level (M-10).

    Graphs with a checked small edge table run in a single task, one move at a time. In larger ones moves are synchronous; in a sweep a node moves only up or only down in the order of labels, in turn, so
    two nodes don't trade places. A level ends when modularity grows in neither direction, the last level when nothing moves.
    weight: that of all edges of the graph, where those given are some of its components; rounds are taken then.
    """
    whole = None
    e = written(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("w").cast("double").alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "graph")
    if weight is None and table_bytes(e) <= one_task_bytes:
        return written(_louvain_in_one_task(e), "labels")
    m = e.agg(F.sum("w")).first()[0] if weight is None else weight
    while True:
        both = written(e.where("src <> dst").select("src", "dst", "w").union(e.where("src <> dst").select("dst", "src", "w")), "graph")
        ends = e.select(F.col("src").alias("node"), "w").union(e.select("dst", "w")).groupBy("node").agg(F.sum("w").alias("k"))
        degree = written(ends, "degrees")
        labels = written(degree.select("node", F.col("node").alias("label")), "labels")
        best, moved, sweep, idle = modularity(e, labels, m), False, 0, 0
        while idle < 2:
            total = labels.join(degree, "node").groupBy("label").agg(F.sum("k").alias("tot"))
            to = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("w").alias("links"))
            own = labels.select("node", F.col("label").alias("own")).join(degree, "node")
            options = to.join(own, "node").join(total, "label")
            gain = F.col("links") - F.col("k") * (F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)) / (2 * m)
            stay = own.join(total, own.own == total.label).select("node", "own", (-F.col("k") * (F.col("tot") - F.col("k")) / (2 * m)).alias("base"))
            picked = options.withColumn("gain", gain)
            here = picked.where("label = own").select("node", F.col("gain").alias("here"))
            way = F.col("label") < F.col("own") if sweep % 2 == 0 else F.col("label") > F.col("own")
            top = picked.where(way).groupBy("node").agg(F.max(F.struct("gain", (-F.col("label")).alias("l"))).alias("t"))
            moves = stay.join(here, "node", "left").join(top, "node", "left")
            after = moves.select("node", F.when(F.col("t.gain") > F.coalesce("here", "base") + 1e-12, -F.col("t.l")).otherwise(F.col("own")).alias("label"))
            after = written(after, "labels")
            q = modularity(e, after, m)
            if q > best + 1e-9:
                labels, best, moved, idle = after, q, True, 0
            else:
                idle += 1
            sweep += 1
        whole = labels if whole is None else written(whole.select("node", F.col("label").alias("mid")).join(labels.select(F.col("node").alias("mid"), "label"), "mid").select("node", "label"), "labels")
        if not moved:
            break
        a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        e = written(e.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w")), "graph")
    return whole


def louvain_clusters(df: DataFrame, k: int = 10, min_sim: float = 0.0, dim: int = 100, weighted: bool = False, scores: DataFrame | None = None, component_links: int = COMPONENT_LINKS) -> DataFrame:
    """Communities of the graph of each row's nearest rows by text scores (M-9, M-10). No edge at all: one cluster; a row without one is alone."""
    near, lists = neighbour_lists(svd_scores(df, dim) if scores is None else scores, k, least=min_sim)
    found = _louvain_of_lists(near, lists, weighted, component_links)
    if found is None:
        return df.select("rid", F.lit(1).cast("long").alias("label"))
    return df.select("rid").join(found, df.rid == found.node, "left").select("rid", F.coalesce("label", "rid").alias("label"))


def _louvain_of_lists(near: DataFrame, lists: DataFrame, weighted: bool, component_links: int) -> DataFrame | None:
    """(node, label) of the graph of ``neighbour_lists``, None without an edge.

    No node moves out of its connected component, so each component of at most ``component_links`` links goes to one task with the
    weight of the whole graph, one move at a time; larger ones go in rounds. All rows of one vector are linked with the head of
    its list, so components follow from the distinct vectors; the edges themselves are never written.
    """
    reached = written(components(lists.select("rep", F.explode("near.orep").alias("orep")), "rep", "orep"), "reached")
    held = near.where("size(near) > 0").join(small(reached), near.rep == reached.node, "left").select(F.coalesce("component", "rep").alias("part"), "rid", "near.other", "near.sim")
    held = written(held, "near")
    if held.isEmpty():
        return None
    # an edge is met twice only if both ends are in lists
    heads = written(lists.select(F.explode("near.other").alias("rid")).distinct(), "heads")
    twice = held.join(small(heads), "rid", "left_semi")
    once = held.join(small(heads), "rid", "left_anti")

    def edges(rows: DataFrame) -> DataFrame:
        flat = rows.select("rid", F.explode(F.arrays_zip("other", "sim")).alias("x"))
        w = F.col("x.sim") if weighted else F.lit(1.0)
        return flat.select(F.least("rid", "x.other").alias("src"), F.greatest("rid", "x.other").alias("dst"), w.alias("w"))

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("src", "dst").agg(F.max("w").alias("w"))

    weight = sum(x.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] for x in (edges(once), merged(edges(twice))))
    sizes = written(held.groupBy("part").agg(F.sum(F.size("other")).alias("links")), "sizes")
    big = written(sizes.where(F.col("links") > component_links).select("part"), "big")

    def settle(table):
        import pyarrow as pa

        table = table.combine_chunks()
        best: dict[tuple[int, int], float] = {}
        for x, others, sims in zip(*(table.column(c).to_pylist() for c in ("rid", "other", "sim")), strict=True):
            for y, sim in zip(others, sims, strict=True):
                key, w = (x, y) if x < y else (y, x), sim if weighted else 1.0
                best[key] = max(best.get(key, w), w)
        whole = _one_at_a_time(((x, y, w) for (x, y), w in best.items()), 2 * weight)
        return pa.table([pa.array(list(whole), pa.int64()), pa.array(list(whole.values()), pa.int64())], ["node", "label"])

    few = held.join(small(big), "part", "left_anti").groupBy("part").applyInArrow(settle, "node long, label long")
    if big.isEmpty():
        return written(few, "labels")
    rest = merged(edges(held.join(small(big), "part", "left_semi")))
    return written(few, "labels").unionByName(louvain(rest, weight=weight))


def embedding_clusters(df: DataFrame, k: int = 15, threshold: float = 0.88) -> DataFrame:
    """Components of the links to each row's k nearest rows with a cosine of ``threshold`` at least; others are alone (M-12)."""
    near = neighbours(df, k, least=threshold)
    return labelled(df, near.select(F.col("rid").alias("src"), F.col("other").alias("dst")))
