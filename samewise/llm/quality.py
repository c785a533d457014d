"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text come from vectorised passes over its bytes. Random Fourier features of the scaled
statistics approximate a Gaussian kernel; every partition adds up its share of the normal equations, whose
size is fixed, and their sum is solved for ridge scores. A pool-adjacent-violators pass over a fixed
histogram of the labelled scores turns scores into probabilities. All labelled rows that may be seen count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.labelled import remainder
from samewise.operators.shared import arrow_rows, written

#: Random features, the kernel's width over the number of statistics, the ridge, and bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 0.35, 1e-3, 2048
RUN_BYTES = 1 << 20
_KINDS = ("letters", "capitals", "digits", "spaces", "lines", "stops", "marks", "above")


def _classes() -> np.ndarray:
    """The kinds of each byte, one column each."""
    b = np.arange(256)
    capital = (b >= 65) & (b <= 90)
    letter = capital | ((b >= 97) & (b <= 122)) | (b >= 128)
    digit = (b >= 48) & (b <= 57)
    space = np.isin(b, [9, 11, 12, 13, 32])
    line = b == 10
    stop = np.isin(b, [44, 46, 59, 58])
    mark = (b > 32) & (b < 127) & ~letter & ~digit & ~stop
    return np.stack([letter, capital, digit, space, line, stop, mark, b >= 128], 1)


_TABLE = _classes()
NAMES = [*_KINDS, "size", "word_length", "longest", "marks_doubled", "repeats", "distinct", "line_length", "word_spread"]


def _mean(sums: np.ndarray, over: np.ndarray) -> np.ndarray:
    return sums / np.maximum(1, over)


def _run(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    begins = np.concatenate([[0], ends[:-1]])
    n = ends - begins

    def total(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return c[ends] - c[begins]

    counts = [total(_TABLE[:, k][data]) for k in range(len(_KINDS))]
    white = (_TABLE[:, 3] | _TABLE[:, 4])[data]
    first = ~white
    first[1:] &= white[:-1]
    at = begins[begins < len(data)]
    first[at] = ~white[at]
    lo = np.flatnonzero(first)
    last = ~white
    last[:-1] &= white[1:] | first[1:]
    hi = np.flatnonzero(last) + 1
    stop = np.searchsorted(lo, ends)
    start = np.concatenate([[0], stop[:-1]])
    words = stop - start
    length = (hi - lo).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(length)])
    squares = np.concatenate([[0], np.cumsum(length * length)])
    longest = np.zeros(len(ends))
    some = np.flatnonzero(words)
    if len(some):
        longest[some] = np.maximum.reduceat(length, start[some])
    mean = _mean(sums[stop] - sums[start], words)
    spread = np.sqrt(np.maximum(0, _mean(squares[stop] - squares[start], words) - mean**2))
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & _TABLE[:, 6][data[1:]]
    # a word's value: its first and last bytes and its length; neighbours and whole texts that repeat them
    value = data[lo].astype(np.int64) | data[hi - 1].astype(np.int64) << 8 | data[(lo + hi) // 2].astype(np.int64) << 16 | np.minimum(length, 255) << 24 if len(lo) else np.empty(0, np.int64)
    same = np.zeros(len(lo), bool)
    same[1:] = value[1:] == value[:-1]
    same[start[some]] = False
    c = np.concatenate([[0], np.cumsum(same)])
    distinct = np.array([len(np.unique(value[i:j])) for i, j in zip(start.tolist(), stop.tolist(), strict=True)])
    share = [_mean(x, n) for x in counts]
    return np.stack([*share, np.log1p(n), mean, np.log1p(longest), _mean(total(twice), n), _mean(c[stop] - c[start], words), _mean(distinct, np.sqrt(np.maximum(1, words))), np.log1p(_mean(n, counts[4] + 1)), spread], 1)


def statistics(texts) -> np.ndarray:
    """One row of statistics (NAMES) for each text of an Arrow string array; null is as empty."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    out, i = [np.zeros((0, len(NAMES)))], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + RUN_BYTES, "right")) - 1)
        out.append(_run(raw[bounds[i] : bounds[j]], bounds[i + 1 : j + 1] - bounds[i]))
        i = j
    return np.concatenate(out)


class Model:
    """Scaling, random features, ridge weights and the calibration's steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 1):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.wave = r.standard_normal((len(mean), FEATURES)) * WIDTH
        self.phase = r.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps = np.full(BINS, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(x @ self.wave + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], 1)

    def bins(self, stats: np.ndarray) -> np.ndarray:
        return (np.clip(self.features(stats) @ self.weights * 0.5 + 0.25, 0, 1) * (BINS - 1)).round().astype(int)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.steps[self.bins(stats)]


def isotonic(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of ones, by pooling adjacent violators; bins without rows take those of their neighbours, interpolated."""
    blocks: list[list[float]] = []  # ones, rows, first bin, last bin
    for k in np.flatnonzero(all_).tolist():
        blocks.append([ones[k], all_[k], k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1][0] += a[0]
            blocks[-1][1] += a[1]
            blocks[-1][3] = a[3]
    if not blocks:
        return np.full(len(all_), 0.5)
    xs = [x for b in blocks for x in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.interp(np.arange(len(all_)), xs, ys)


def described(docs: DataFrame, text_col: str = "text", stats_col: str = "stats") -> DataFrame:
    """``docs`` without the texts, with their statistics as doubles in binary; all whole texts are read once."""
    arrow_rows(docs.sparkSession, 500)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pyarrow as pa

        for s in batches:
            yield pd.Series([x.tobytes() for x in statistics(pa.array(s, pa.large_string(), from_pandas=True))], dtype=object)

    return docs.withColumn(stats_col, run(F.col(text_col))).drop(text_col)


def _summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all rows of what ``make`` gives for arrays of statistics and labels, summed in each partition first."""

    def part(batches):
        import pyarrow as pa

        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = np.stack([np.frombuffer(c.as_py()) for c in b.column(0)])
                total += make(x, np.array(b.column(1).to_pylist(), float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "v"])

    out = np.zeros(size)
    sums = rows.select("stats", "label").mapInArrow(part, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    for r in sums.collect():  # a fixed number of rows
        out[r.k] = r.v
    return out


def fit(described_docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """A model of all rows of ``labels`` (0 or 1, null: not used) that a described document matches; without any it scores 0.5."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("double").alias("label"))
    rows = written(described_docs.select(id_col, "stats").join(known, id_col).select("stats", "label"), "learned")
    d = len(NAMES)
    s = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n = max(1.0, s[0])
    mean = s[1 : d + 1] / n
    model = Model(mean, np.sqrt(np.maximum(s[d + 1 :] / n - mean**2, 1e-12)))
    if not s[0]:
        return model
    f = FEATURES + 1

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    s = _summed(rows, normal, f * f + f)
    model.weights = np.linalg.solve(s[: f * f].reshape(f, f) + RIDGE * n * np.eye(f) / FEATURES, s[f * f :])
    s = _summed(rows, lambda x, y: np.concatenate([np.bincount(b := model.bins(x), y, BINS), np.bincount(b, minlength=BINS)]), 2 * BINS)
    model.steps = isotonic(s[:BINS], s[BINS:])
    return model


def score(described_docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """Described documents with a score from 0 to 1 in place of their statistics."""
    shared = described_docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack([np.frombuffer(c) for c in s]) if len(s) else np.zeros((0, len(NAMES)))
            yield pd.Series(shared.value.score(x))

    return described_docs.withColumn(score_col, run(F.col("stats"))).drop("stats")


def learnable(labels: DataFrame, id_col: str = "doc_id", m: int = 5, held: int = 0) -> DataFrame:
    """The labels a model may see: those not held out."""
    return labels.where(remainder(id_col, m) != held)
