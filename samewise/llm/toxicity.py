"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams and itself, each a row of one hashed table; so an unseen
misspelling shares most of its vectors with the word it disguises. A window of text is the average of its
words, missing and repeated ones counting as nothing; a linear softmax over it says how likely it is toxic. A document is as toxic as its worst window,
since a few words in a long text are enough. Documents, not windows, are labelled, so training alternates:
each toxic document is represented by the window the model likes best as such, each clean one by its worst
and some others.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.labelled import remainder, sampled
from samewise.operators.shared import arrow_rows

#: Documents of each label that the model is fitted on, at most.
PER_CLASS = 2000
BUCKETS, DIM, WINDOW = 1 << 16, 8, 12
ROUNDS, EPOCHS = 4, 2
#: Steps of a round at least: few labels are gone through more often.
STEPS = 200
_EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"
MEMO_ENTRIES = 400_000
#: Windows of a document that a round learns from, at most: of a toxic one, of a clean one.
TOXIC_WINDOWS, CLEAN_WINDOWS = 8, 3


def subwords(word: str) -> list[int]:
    """Table rows of a word: the word and its 3- to 5-grams, with marks at both ends."""
    w = f"<{word.strip(_EDGES).lower()}>"
    grams = {w} | {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


def windows(n: int, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of windows over n words, each overlapping the next by half; together they cover all words."""
    if n <= width:
        return np.zeros(1, np.int64), np.array([n], np.int64)
    begin = np.arange(0, n - width // 2, width // 2)
    return begin, np.minimum(begin + width, n)


def distance_back(ids: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """How many places before each word its last occurrence is; ``width`` if it is not among the ``width`` - 1 words before."""
    out = np.full(len(ids), width, np.int64)
    for d in range(min(width, len(ids)) - 1, 0, -1):
        out[d:][ids[d:] == ids[:-d]] = d
    return out


def bags(values: np.ndarray, back: np.ndarray, begin: np.ndarray, end: np.ndarray, fill) -> np.ndarray:
    """A row of WINDOW values for each window; ``fill`` past its end and for words that occur earlier in the same window."""
    place = np.arange(WINDOW)
    at = begin[:, None] + place
    inside = at < end[:, None]
    at = np.where(inside, at, 0)
    if not len(values):
        return np.full(at.shape, fill, values.dtype)
    return np.where(inside & (back[at] > place), values[at], fill)


class Model:
    """The table, the softmax and the calibration of a document's worst window."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.table = (r.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.soft = (r.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.slope, self.shift = 1.0, 0.0

    def fit(self, texts: list[str], labels: np.ndarray, shares: np.ndarray, seed: int = 1) -> Model:
        """labels: 1 for toxic. shares: how many documents of the corpus a document stands for."""
        r = np.random.default_rng(seed)
        words: dict[str, int] = {}
        docs = [np.array([words.setdefault(w, len(words)) for w in (t or "").split()], np.int32) for t in texts]
        rows, sizes = array("i"), array("i")  # packed: the bags of all words are the most that the driver holds here
        for w in words:
            bag = subwords(w)
            rows.extend(bag)
            sizes.append(len(bag))
        words.clear()
        flat, size = np.array(rows, np.int32), np.array(sizes if len(sizes) else [0], np.int64)
        del rows, sizes
        first = np.concatenate([[0], np.cumsum(size)])
        spans = [windows(len(d)) for d in docs]
        if labels.min(initial=1) == labels.max(initial=0):
            self.shift = 50.0 if len(labels) and labels[0] == 1 else -50.0
            self.slope = 0.0
            return self
        state = [np.full_like(self.table, 1e-4), np.full_like(self.soft, 1e-4), np.full_like(self.bias, 1e-4)]
        scores = None
        back = [distance_back(d).astype(np.int8) for d in docs]
        for turn in range(ROUNDS):
            chosen, want = [], []
            for i, d in enumerate(docs):
                b, e = spans[i]
                if not len(d):
                    continue
                most = TOXIC_WINDOWS if labels[i] else CLEAN_WINDOWS
                if scores is None:
                    take = r.permutation(len(b))[:most]
                elif labels[i]:
                    top = np.argsort(-scores[i], kind="stable")[:most]
                    take = top[scores[i][top] >= max(scores[i].max() - 0.5, min(2.0, scores[i].max()))]
                else:
                    take = {int(scores[i].argmax()), *r.integers(0, len(b), most - 1).tolist()}
                for k in take:
                    bag = d[b[k] : e[k]]
                    chosen.append(bag[back[i][b[k] : e[k]] > np.arange(len(bag))])
                    want.append(int(labels[i]))
            want = np.array(want)
            weigh = np.where(want == 1, 0.5 / max(1, want.sum()), 0.5 / max(1, (1 - want).sum())) * len(want)
            for _ in range(max(EPOCHS, -(-64 * STEPS // max(1, len(chosen))))):
                order = r.permutation(len(chosen))
                for k in range(0, len(order), 64):
                    self._step([chosen[i] for i in order[k : k + 64]], want[order[k : k + 64]], weigh[order[k : k + 64]], flat, first, size, state)
            per_word = self._word_scores(flat, first, size)
            scores = [self._windows(per_word[d], back[i], *spans[i]) for i, d in enumerate(docs)]
        top = np.array([s.max() for s in scores])
        self._calibrate(top, labels, shares)
        return self

    def _word_scores(self, flat, first, size) -> np.ndarray:
        pull = self.table @ (self.soft[:, 1] - self.soft[:, 0])
        return np.add.reduceat(pull[flat], first[:-1]) / size if len(flat) else np.empty(0)

    def _windows(self, word_scores: np.ndarray, back: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return bags(word_scores, back, begin, end, 0.0).sum(1, dtype=np.float64) / WINDOW + float(self.bias[1] - self.bias[0])

    def _step(self, bags, want, weigh, flat, first, size, state, rate: float = 0.15) -> None:
        word = np.concatenate(bags)
        counts = size[word]
        rows = flat[np.repeat(first[word] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        part = np.repeat((1.0 / WINDOW / counts).astype(np.float32), counts)
        in_bag = np.add.reduceat(counts, np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]))
        who = np.repeat(np.arange(len(bags)), in_bag)
        x = np.add.reduceat(self.table[rows] * part[:, None], np.concatenate([[0], np.cumsum(in_bag)[:-1]]))
        z = x @ self.soft + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(want)), want] -= 1
        p *= weigh[:, None]
        pull = p @ self.soft.T
        order = np.argsort(rows, kind="stable")
        kinds, at = np.unique(rows[order], return_index=True)
        g = np.add.reduceat(pull.astype(np.float32)[who[order]] * part[order][:, None], at)
        state[0][kinds] += g * g
        self.table[kinds] -= rate * g / np.sqrt(state[0][kinds])
        for j, (value, grad) in enumerate(((self.soft, (x.T @ p) / len(want)), (self.bias, p.mean(0)))):
            state[j + 1] += (grad * grad).astype(np.float32)
            value -= (rate * grad / np.sqrt(state[j + 1])).astype(np.float32)

    def _calibrate(self, top: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> None:
        """A logistic curve over the worst window's score, with each document weighed by its share; Newton's method."""
        x = np.stack([top, np.ones_like(top)], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (shares * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2
            w -= np.linalg.solve(h, x.T @ (shares * (p - labels)) + 1e-2 * w)
        self.slope, self.shift = float(w[0]), float(w[1])

    def scorer(self):
        """A function from a text to its score, with a memo of word scores."""
        pull = (self.table @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float64).tolist()
        memo: dict[str, int] = {}
        known = np.zeros(MEMO_ENTRIES)

        def score(text: str | None) -> float:
            nonlocal known
            words = (text or "").split()
            if missing := set(words).difference(memo):
                if len(memo) + len(missing) > MEMO_ENTRIES:
                    memo.clear()
                    missing = set(words)
                    known = np.zeros(max(MEMO_ENTRIES, len(missing)))
                for w in missing:
                    rows = subwords(w)
                    known[len(memo)] = sum([pull[k] for k in rows]) / len(rows)
                    memo[w] = len(memo)
            ids = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
            top = self._windows(known[ids], distance_back(ids), *windows(len(words))).max()
            return float(1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -50, 50))))

        return score


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labels (0 or 1) of up to ``per_class`` documents of either; with one label or none it scores all alike."""
    rows = sampled(docs, labels, label_col, per_class, id_col, text_col).orderBy("label", F.xxhash64("text")).collect()
    return Model().fit([r.text for r in rows], np.array([int(r.label) for r in rows], np.int64), np.array([r.share for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text; null is as empty. A column of that name is replaced.

    Texts of any length are read window by window and score as their worst one; rows are scored one by one, so ids may be
    null or repeat; an empty table stays empty.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 500)
    shared = spark.sparkContext.broadcast(model)  # 2 MB, whatever the input

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value.scorer()
        for s in batches:
            yield pd.Series([own(t) for t in s], dtype="float64")

    return docs.withColumn(score_col, run(F.col(text_col)))


def learnable(labels: DataFrame, id_col: str = "doc_id", m: int = 3, held: int = 1) -> DataFrame:
    """The labels a model may see: those not held out."""
    return labels.where(remainder(id_col, m) != held)
