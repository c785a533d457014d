"""Connected components of an undirected graph given as edges (G-1), by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators.shared import dropped, table_bytes, written

#: A graph whose edge table has this many bytes at most is brought to one task of the cluster; both ways give the same labels.
ONE_TASK_BYTES = 4 << 20


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Union-find over a checked number of edges; the smallest node of a component is its root."""

    def merge(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y] if y in up else y
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])

    return edges.coalesce(1).mapInArrow(merge, "node long, component long")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task_bytes: int = ONE_TASK_BYTES) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node that has an edge.

    Node ids are longs. Null ends and loops are ignored (a node with nothing but loops gets no row);
    edges may repeat and point either way. An empty edge table gives an empty result. Graphs with a
    checked small edge table run in a single task. Larger ones run in rounds of two aggregations and
    joins by node; every round is written to the shared folder, and a round that changes nothing ends them.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(pairs, "edges")
    if table_bytes(now) <= one_task_bytes:
        return written(_in_one_task(now), "components")

    def weighed(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    seen = weighed(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = written(large, "edges")
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after = written(small, "edges")
        dropped(mid)
        dropped(now)
        now, last, seen = after, seen, weighed(after)
        if seen == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
