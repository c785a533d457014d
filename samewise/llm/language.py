"""Language of texts by a byte convolutional network, trained in numpy.

Bytes have embeddings; filters of several widths run over windows of a fixed length; the largest answer of
each filter in a window goes to a softmax. A document's windows cover its whole text, and their log
probabilities are averaged. For application the products of embeddings and filters are tables: one
for each byte and place, or for a pair of bytes, so a convolution is a few look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.labelled import remainder, sampled
from samewise.operators.shared import arrow_rows, fresh

#: Documents of each language that the network is fitted on, at most, and windows of each.
PER_LANG, WINDOWS_PER_DOC = 1000, 4
LENGTH, DIM, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
STEPS, BATCH = 500, 128
#: Windows that are evaluated at once.
AT_ONCE = 128


def cut(data: bytes) -> np.ndarray:
    """All bytes of a text in windows of LENGTH, the last one filled up with zero bytes."""
    n = max(1, -(-len(data) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, LENGTH)


class Network:
    def __init__(self, langs: list[str], seed: int = 1):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.embed = (r.standard_normal((256, DIM)) * 0.5).astype(np.float32)
        self.filters = [(r.standard_normal((w * DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (r.standard_normal((len(WIDTHS) * FILTERS, max(1, len(langs)))) * 0.1).astype(np.float32)
        self.bias = np.zeros(max(1, len(langs)), np.float32)

    def _params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.shift, self.out, self.bias]

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 1) -> Network:
        """Adam on the cross entropy of windows (n x LENGTH bytes), as many of each language in a batch."""
        if len(self.langs) < 2:
            return self
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        m = [np.zeros_like(p) for p in self._params()]
        v = [np.zeros_like(p) for p in self._params()]
        for step in range(1, STEPS + 1):
            pick = np.concatenate([r.choice(b, max(1, BATCH // len(by))) for b in by])
            grads = self._grads(windows[pick], labels[pick])
            rate = 0.01 * (1 - step / (STEPS + 1))
            for p, g, a, b in zip(self._params(), grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def _grads(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        e = self.embed[x]
        pools, cols, tops = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.shift, strict=True):
            places = LENGTH - w + 1
            col = np.concatenate([e[:, i : i + places] for i in range(w)], 2)
            z = col.reshape(-1, w * DIM) @ f
            z = z.reshape(n, places, FILTERS) + b
            top = z.argmax(1)
            cols.append(col)
            tops.append(top)
            pools.append(np.take_along_axis(z, top[:, None], 1)[:, 0])
        pool = np.concatenate(pools, 1)
        hidden = np.maximum(pool, 0)
        z = hidden @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (pool > 0)
        g_embed, g_filters, g_shift = np.zeros_like(self.embed), [], []
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            seen = cols[k][rows, tops[k]]  # n x FILTERS x (w DIM)
            g_filters.append(np.einsum("nf,nfd->df", d, seen).astype(np.float32))
            g_shift.append(d.sum(0).astype(np.float32))
            to = (d[:, :, None] * self.filters[k].T[None]).reshape(n, FILTERS, w, DIM)
            for i in range(w):
                np.add.at(g_embed, x[rows, tops[k] + i], to[:, :, i])
        return [g_embed, *g_filters, *g_shift, hidden.T @ p, p.sum(0)]

    def tables(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each width, (place, bytes looked up at once, table)."""
        out = []
        for w, f, b in zip(WIDTHS, self.filters, self.shift, strict=True):
            single = [self.embed @ f[i * DIM : (i + 1) * DIM] for i in range(w)]
            single[0] = single[0] + b
            steps = []
            for i in range(0, w, 2):
                if i + 1 < w:
                    steps.append((i, 2, np.ascontiguousarray((single[i][:, None] + single[i + 1][None]).reshape(-1, FILTERS))))
                else:
                    steps.append((i, 1, single[i]))
            out.append(steps)
        return out

    def log_probs(self, windows: np.ndarray, tables) -> np.ndarray:
        x = windows.astype(np.int32)
        pairs = x[:, :-1] * 256 + x[:, 1:]
        pools = []
        for w, steps in zip(WIDTHS, tables, strict=True):
            places = LENGTH - w + 1
            z = None
            for i, many, table in steps:
                got = table.take(pairs[:, i : i + places] if many == 2 else x[:, i : i + places], axis=0)
                z = got if z is None else np.add(z, got, out=z)
            pools.append(z.max(1))
        z = np.maximum(np.concatenate(pools, 1), 0) @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, texts: list[str | None], tables) -> tuple[list[str], list[float]]:
        """The language of each whole text and its share of the probability; `und` for texts without a letter."""
        sums = np.zeros((len(texts), len(self.bias)))
        many = np.zeros(len(texts))
        held, owners, n = [], [], 0

        def flush():
            nonlocal held, owners, n
            if held:
                who = np.concatenate(owners)
                for k in range(0, n, AT_ONCE):
                    every = np.concatenate(held) if k == 0 else every
                    np.add.at(sums, who[k : k + AT_ONCE], self.log_probs(every[k : k + AT_ONCE], tables))
                np.add.at(many, who, 1)
            held, owners, n = [], [], 0

        known = [bool(self.langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
        for i, t in enumerate(texts):
            if known[i]:
                held.append(cut(t.encode("utf-8", "surrogatepass")))
                owners.append(np.full(len(held[-1]), i))
                n += len(held[-1])
                if n >= 16 * AT_ONCE:
                    flush()
        flush()
        z = sums / np.maximum(1, many)[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(p[i, b]) if known[i] else 0.0 for i, b in enumerate(best)]


def fit(docs: DataFrame, label_col: str = "lang", per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network for the non-null labels of up to ``per_lang`` documents each; of each, windows spread over the whole text."""
    rows = sampled(docs.where(F.length(text_col) > 0), docs, label_col, per_lang, id_col, text_col).orderBy("label", F.xxhash64("text")).collect()
    langs = sorted({r.label for r in rows})
    windows, labels = [], []
    for r in rows:
        w = cut(r.text.encode())
        w = w[np.unique(np.linspace(0, len(w) - 1, WINDOWS_PER_DOC).astype(int))]
        windows.append(w)
        labels.append(np.full(len(w), langs.index(r.label)))
    net = Network(langs)
    return net.fit(np.concatenate(windows), np.concatenate(labels)) if rows else net


def predict(docs: DataFrame, net: Network, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text (`und` where there is no letter, or nothing was learned) and a score from 0 to 1.

    Letters are characters of Unicode's categories L. Texts of any length are cut into windows, all of which count; null and
    empty texts are `und` with score 0; rows are scored one by one, so ids may be null or repeat; an empty table stays
    empty. Columns of the added names are replaced.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 500)
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf(f"{label_col} string, {score_col} double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        tables = own.tables()
        for s in batches:
            langs, scores = own.predict(s.tolist(), tables)
            yield pd.DataFrame({label_col: langs, score_col: scores})

    found = fresh(docs, "found")
    return docs.withColumn(found, run(F.col(text_col))).withColumns({label_col: F.col(found)[label_col], score_col: F.col(found)[score_col]}).drop(found)


def learnable(docs: DataFrame, id_col: str = "doc_id", m: int = 4, held: int = 2) -> DataFrame:
    """The documents a network may learn from: those not held out."""
    return docs.where(remainder(id_col, m) != held)
