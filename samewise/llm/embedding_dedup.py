"""Near-duplicate embeddings by sorted projection passes.

Each pass hashes every vector with random hyperplanes of its own into a string of 63 signs and orders the
vectors of a label by it; neighbours within a bounded window of that order are compared exactly. Pairs
verified in any pass are united. The number of passes of a label follows from its size and from how
far a sample of it shares prefixes of keys, so that a pair at the threshold is missed by all of them with
a set probability; labels whose vectors lean one way or crowd so far that this takes many times the passes are compared whole, in
blocks, whatever their size. A window may miss links inside a large group, so the vectors of each component are then compared with each other in blocks, which only
emit counts; components are split into blocks of a fixed size, whatever their own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators.clusterers import roots
from samewise.operators.components import components
from samewise.operators.shared import small, written

THRESHOLD = 0.93
#: Neighbours on either side that a vector is compared with in a pass.
WINDOW = 32
#: Probability, about, that a pair at the threshold is in no window.
MISS = 1e-5
#: Signs of a sort key.
BITS = 63
#: Vectors of a block in the comparison within components.
BLOCK = 512
#: Vectors of a label, about, and passes over them from which its need of passes is measured.
SAMPLE, TRIALS = 2048, 16
#: Times the formula's passes; labels that need more are compared whole, in blocks of so many vectors.
LEAN, WHOLE_BLOCK = 2, 1024
#: Bytes, about, of hyperplanes that a task keeps.
PLANES_BYTES = 64 << 20
#: Rows of a sorted partition.
PARTITION_ROWS = 20_000


def passes_needed(n: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold, among n vectors, is missed with probability ``miss`` at most, about."""
    agree = 1 - math.acos(threshold) / math.pi
    near = agree ** max(1.0, math.log2(max(2.0, 2 * n / window)))
    return max(4, math.ceil(math.log(miss) / math.log(1 - near)))


def passes_measured(x: np.ndarray, n: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, seed: int = 5) -> int:
    """Passes that a label of n vectors needs, by how many of its sample ``x`` share each prefix of their keys."""
    m = len(x)
    room = window * m / n  # of the sample, other rows in a group of one prefix that fits a window
    steps = max(1, int(room))
    if m <= steps + 1:
        return 1
    stretch = max(1.0, math.log2(2 * n / window) / math.log2(2 * m)) if room < 1 else 1.0
    agree = 1 - math.acos(threshold) / math.pi
    signs = (x @ np.random.default_rng([seed, x.shape[1], 1]).standard_normal((x.shape[1], TRIALS * BITS))) > 0
    keys = signs.reshape(m, TRIALS, BITS) @ np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
    logs = np.zeros(m)
    for t in range(TRIALS):
        order = np.argsort(keys[:, t], kind="stable")
        k = keys[order, t]
        # signs that groups of more than steps + 1 rows share: frexp gives the place of the first sign that differs
        shared = BITS - np.frexp((k[:-steps - 1] ^ k[steps + 1 :]).astype(float))[1]
        least = np.zeros(m)
        for d in range(steps + 2):
            np.maximum(least[d : d + len(shared)], shared + 1, out=least[d : d + len(shared)])
        logs[order] += np.log1p(-np.minimum(agree ** (least * stretch), 1 - 1e-9)) / TRIALS
    low, high = 1, 1
    while np.exp(high * logs).mean() > miss:
        low, high = high, 2 * high
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if np.exp(mid * logs).mean() > miss else (low, mid)
    return high


class _Sets:
    """Union-find."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _kind(vectors: DataFrame, vector_col: str) -> str:
    """How components are kept: as the floats they are, or as doubles."""
    return "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"


def _unpacked(cell: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(cell, kind).astype("<f8", copy=False)


def _distinct(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, label, k1, k2, vec) for every row and, for each distinct usable vector of a label, (label, k1, k2, least, copies, vec, rep).

    least is the smallest vec_id that has the vector, rep a number of the vector's own: rows may repeat an id.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cells = []
            for x in b.column(2):
                x = x.as_py()
                ok = x is not None and len(x) > 0 and None not in x
                v = np.array(x, "<f8") + 0.0 if ok else None
                with np.errstate(over="ignore"):
                    size = np.linalg.norm(v) if ok else 0.0
                cells.append(v.astype(kind).tobytes() if ok and np.isfinite(size) and size > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.binary())], ["vec_id", "label", "vec"])

    rows = vectors.select(vectors[id_col].cast("long"), vectors[label_col].cast("string"), vectors[vector_col].cast("array<double>")).mapInArrow(run, "vec_id long, label string, vec binary")
    rows = written(rows.withColumn("vec", F.when(F.col("label").isNotNull(), F.col("vec"))).withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")}), "vectors")
    usable = rows.where("vec is not null and vec_id is not null")
    groups = usable.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"))
    return rows, written(groups.withColumn("rep", F.monotonically_increasing_id()), "distinct")


def _needs(distinct: DataFrame, threshold: float, window: int, miss: float, seed: int, kind: str) -> DataFrame:
    """(label, width, n, passes, whole): the passes each label's vectors of one length need; whole: they lean, at any size."""
    rows = distinct.select("label", (F.length("vec") / int(kind[2])).cast("int").alias("width"), "rep", "vec")
    sizes = written(rows.groupBy("label", "width").agg(F.count("*").alias("n")), "sizes")
    drawn = rows.join(small(sizes), ["label", "width"]).where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * SAMPLE / F.col("n"))

    def run(pdf):
        import pandas as pd

        n = int(pdf.n.iloc[0])
        x = np.stack([_unpacked(v, kind) for v in pdf.sort_values("rep").vec])
        plain = passes_needed(n, threshold, window, miss)
        passes = max(plain, passes_measured(x, n, threshold, window, miss, seed))
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "width": [pdf.width.iloc[0]], "n": [n], "passes": [passes], "whole": [passes > LEAN * plain]})

    return written(drawn.groupBy("label", "width").applyInPandas(run, "label string, width int, n long, passes int, whole boolean"), "needs")


def _wholly(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Edges (src, dst) that span all links among rows (label, width, n, rep, vec) of equal label and width, by blocks."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / WHOLE_BLOCK).cast("int")).withColumn("block", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", "width", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "vec")

    def run(pdf):
        import pandas as pd

        i, j = pdf.i.iloc[0], pdf.j.iloc[0]
        x = np.stack([_unpacked(v, kind) for v in pdf.vec])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        a, b = (np.flatnonzero(pdf.block == k) for k in (i, j))
        left, right = np.nonzero(x[a] @ x[b].T >= threshold)
        to, ids = roots(len(pdf), a[left], b[right]), pdf.rep.to_numpy()
        own = np.flatnonzero(to != np.arange(len(to)))
        return pd.DataFrame({"src": ids[own], "dst": ids[to[own]]})

    return rows.groupBy("label", "width", "i", "j").applyInPandas(run, "src long, dst long")


def _passes(distinct: DataFrame, threshold: float, window: int, miss: float, seed: int, kind: str) -> DataFrame:
    """Edges (src, dst) that span what the windows of each label's passes, or blocks of whole labels, link."""
    spark = distinct.sparkSession
    if distinct.isEmpty():
        return spark.createDataFrame([], "src long, dst long")
    needs = _needs(distinct, threshold, window, miss, seed, kind)
    width = (F.length("vec") / int(kind[2])).cast("int")
    # labels too large to be sure of a drawn row and without one have no needs
    passes = F.coalesce("passes", F.lit(passes_needed(SAMPLE, threshold, window, miss)))
    sized = distinct.withColumn("width", width).join(small(needs.select("label", "width", "n", "passes", "whole"), needs), ["label", "width"], "left").withColumn("passes", passes)
    whole = _wholly(sized.where("whole"), threshold, kind)
    sized = sized.where("not coalesce(whole, false)")
    top = written(sized.groupBy("passes").agg(F.count("*").alias("n")), "passes").agg(F.max("passes").alias("most"), F.sum(F.col("n") * F.col("passes")).alias("rows")).first()
    return whole.unionByName(_windows(sized, top.most or 1, top.rows or 0, threshold, window, seed, kind))


def _windows(distinct: DataFrame, most: int, rows: int, threshold: float, window: int, seed: int, kind: str) -> DataFrame:
    """Edges (src, dst) that span what windows link; each row has its number of passes, ``most`` at most and ``rows`` in all."""

    def keys(batches):
        import pyarrow as pa

        planes: dict[tuple[int, int], np.ndarray] = {}

        def drawn(d: int, at: int) -> np.ndarray:
            """The hyperplanes of TRIALS passes from ``at``, the same for every label and number of passes."""
            if (d, at) not in planes:
                if sum(x.nbytes for x in planes.values()) > PLANES_BYTES:
                    planes.clear()
                planes[d, at] = np.random.default_rng([seed, d, at]).standard_normal((TRIALS, d, BITS))
            return planes[d, at]

        weigh = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for b in batches:
            raw = [c.as_py() for c in b.column(2)]
            width, passes = (b.column(k).to_numpy() for k in (3, 4))
            key = [[] for _ in raw]
            for d in np.unique(width):  # vectors of other lengths are never alike
                for at in range(0, most, TRIALS):
                    own = np.flatnonzero((width == d) & (passes > at))
                    for some in np.array_split(own, -(-len(own) // SAMPLE)) if len(own) else []:
                        x = np.stack([_unpacked(raw[i], kind) for i in some])
                        for p in range(at, min(at + TRIALS, most)):
                            for i, k in zip(some.tolist(), (((x @ drawn(int(d), at)[p - at]) > 0) @ weigh).tolist(), strict=True):
                                if p < passes[i]:
                                    key[i].append(k)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(4)] + [pa.array(key, pa.list_(pa.int64()))], ["rep", "label", "vec", "width", "keys"])

    keyed = distinct.select("rep", "label", "vec", "width", "passes").mapInArrow(keys, "rep long, label string, vec binary, width int, keys array<long>")
    laid = keyed.select("rep", "label", "width", "vec", F.posexplode("keys").alias("pass", "key"))
    order = ["pass", "label", "width", "key", "rep"]
    laid = laid.repartitionByRange(max(1, rows // PARTITION_ROWS), *order).sortWithinPartitions(*order)

    def compare(rows: list[tuple], sets: _Sets, split: int | None = None) -> list[tuple[int, int]]:
        """Edges between neighbours; split: only between rows before and from there."""
        edges, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][:3] == rows[i][:3]:
                j += 1
            if j - i > 1:
                ids = [r[3] for r in rows[i:j]]
                x = np.stack([r[4] for r in rows[i:j]])
                for d in range(1, min(window, j - i - 1) + 1):
                    hit = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold)
                    if split is not None:
                        hit = hit[(hit + i < split) & (hit + d + i >= split)]
                    edges += [(ids[k], ids[k + d]) for k in hit.tolist() if sets.unite(ids[k], ids[k + d])]
            i = j
        return edges

    def linked(edges: list):
        import pyarrow as pa

        n = len(edges)
        cols = [pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], NAMES)

    def at_ends(rows: list):
        """(part, place, pass, label, width, rep, vector): the rows near a partition's ends; place -1 has its number of rows as rep."""
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64())] * 2 + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], NAMES)

    schema = "src long, dst long, part int, place long, pass int, label string, width int, rep long, vec binary"
    NAMES = [x.split()[0] for x in schema.split(", ")]

    def windows(batches):
        from pyspark import TaskContext

        part, sets, seen = TaskContext.get().partitionId(), _Sets(), 0
        tail: list[tuple] = []
        head: list[tuple] = []
        for b in batches:
            c = [b.column(b.schema.get_field_index(n)) for n in ("pass", "label", "width", "rep", "vec")]
            rows = []
            for p, lab, w, rep, v in zip(*(x.to_pylist() for x in c[:4]), c[4], strict=True):
                x = _unpacked(v.as_py(), kind)
                rows.append((p, lab, w, rep, x / np.linalg.norm(x)))
            if len(head) < window:
                head += rows[: window - len(head)]
            seen += len(rows)
            joined = tail + rows
            yield linked(compare(joined, sets))
            tail = joined[-window:]
        first = max(len(head), seen - len(tail))  # a thin partition's rows are its head, all of them
        ends = [(part, i, *r[:4], r[4].tobytes()) for i, r in enumerate(head)] + [(part, first + i, *r[:4], r[4].tobytes()) for i, r in enumerate(tail[len(tail) - (seen - first) :] if seen > first else [])]
        if seen:
            yield at_ends([*ends, (part, -1, None, None, None, seen, None)])

    found = written(laid.select(*order, "vec").mapInArrow(windows, schema), "windows")
    counts = dict(tuple(r) for r in found.where("place = -1").select("part", "rep").collect())  # a row a partition
    parts = sorted(counts)
    begins = np.cumsum([0, *(counts[p] for p in parts)])
    start, bounds = dict(zip(parts, begins.tolist(), strict=False)), begins[1:-1]

    def spread(batches):
        """Each row near an end, once for every border between partitions that is within a window of it."""
        import pyarrow as pa

        for b in batches:
            rank = np.array([start[p] for p in b.column(0).to_pylist()], np.int64) + b.column(1).to_numpy()
            lo, hi = np.searchsorted(bounds, rank - window, "right"), np.searchsorted(bounds, rank + window, "right")
            pick = np.repeat(np.arange(len(rank)), hi - lo)
            edge = bounds[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(pick))] if len(pick) else np.empty(0, np.int64)
            taken = pa.array(pick)
            yield pa.RecordBatch.from_arrays([pa.array(edge, pa.int64()), pa.array(rank[pick]), *(b.column(i).take(taken) for i in range(2, 7))], ["edge", "rank", "pass", "label", "width", "rep", "vec"])

    def seams(batches):
        """Neighbours on the two sides of a border."""
        now, held, sets = None, [], _Sets()

        def close():
            import pyarrow as pa

            edges = compare([x[1:] for x in held], sets, sum(1 for x in held if x[0] < now))
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["src", "dst"])

        for b in batches:
            for e, rank, p, lab, w, rep, v in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6), strict=True):
                if e != now and held:
                    yield close()
                    held = []
                now = e
                held.append((rank, p, lab, w, rep, np.frombuffer(v.as_py(), "<f8")))
        if held:
            yield close()

    near = found.where("place >= 0").select("part", "place", "pass", "label", "width", "rep", "vec")
    near = near.mapInArrow(spread, "edge long, rank long, pass int, label string, width int, rep long, vec binary")
    near = near.repartition("edge").sortWithinPartitions("edge", "rank")
    return found.where("src is not null").select("src", "dst").unionByName(near.mapInArrow(seams, "src long, dst long"))


def _within(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(rep, links): for each vector the copies of others in its component (component, size, rep, copies, vec) that it links with."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "vec")
    keys = ["component", "i", "j"]

    def run(batches):
        import pyarrow as pa

        now, held = None, []

        def close():
            block = np.array([h[0] for h in held])
            ids = np.array([h[1] for h in held])
            copies = np.array([h[2] for h in held], float)
            width = np.array([len(h[3]) for h in held])
            links = np.zeros(len(held), np.int64)
            for d in np.unique(width):
                x = np.flatnonzero((width == d) & (block == now[1]))
                y = np.flatnonzero((width == d) & (block == now[2]))
                v = {}
                for rows in (x, y):
                    m = np.stack([held[i][3] for i in rows]) if len(rows) else np.zeros((0, d))
                    v[id(rows)] = m / np.linalg.norm(m, axis=1, keepdims=True)
                near = v[id(x)] @ v[id(y)].T >= threshold
                if now[1] == now[2]:
                    np.fill_diagonal(near, False)
                    links[x] += (near @ copies[y]).astype(np.int64)
                else:
                    links[x] += (near @ copies[y]).astype(np.int64)
                    links[y] += (copies[x] @ near).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["rep", "links"])

        for b in batches:
            for *key, block, rep, copies, v in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6), strict=True):
                if key != now and held:
                    yield close()
                    held = []
                now = key
                held.append((block, rep, copies, _unpacked(v.as_py(), kind)))
        if held:
            yield close()

    laid = rows.repartition(*keys).sortWithinPartitions(*keys)
    return laid.mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def embedding_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Two vectors link when their labels are equal and not null and their cosine, in doubles, is at least
    ``threshold``; null and zero vectors, those with null or non-finite components or a norm that isn't finite, and those of
    other lengths link with nothing. n_links counts the other rows linked directly within the component; component_id is the
    smallest vec_id reachable; kept says whether it is the row's own. Rows that repeat an id and vector are
    copies of each other, rows that repeat an id with another vector are linked each by its own; a row with a null id links with
    nothing. An empty table gives an empty result. Other columns aren't read.
    """
    kind = _kind(vectors, vector_col)
    rows, distinct = _distinct(vectors, id_col, vector_col, label_col, kind)
    classes = written(components(_passes(distinct, threshold, window, miss, seed, kind)), "classes")
    placed = classes.join(distinct.select("rep", "least"), classes.node == distinct.rep).groupBy("component")
    sizes = written(placed.agg(F.count("*").alias("size"), F.min("least").alias("component_id")), "components")
    members = classes.join(small(sizes), "component").join(distinct.select("rep", "copies", "vec"), classes.node == distinct.rep)
    links = _within(members.select("component", "size", "rep", "copies", "vec"), threshold, kind)
    named = classes.join(small(sizes), "component").select("node", "component_id")
    marks = distinct.select("label", "k1", "k2", "rep", "least", "copies").join(named, distinct.rep == named.node, "left").join(links, "rep", "left")
    marks = marks.select("label", "k1", "k2", F.coalesce("component_id", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    table = written(marks.where("links > 0"), "marks")
    usable = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    joined = rows.select("vec_id", F.when(usable, F.col("label")).alias("label"), "k1", "k2").join(small(table), ["label", "k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
