"""Text building, normalisation and string distances as columns."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Fixed: the number pattern of embedding strings (C-5).
NUMBER = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
WORD = r"[\p{L}\p{N}_']+"
#: Letters of one side that are compared at once.
CELLS = 1 << 17


def squish(c: Column) -> Column:
    """Collapses white space, Unicode's too, and trims."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def rendered(name: str, kind: str) -> Column:
    """A column as text; integral doubles without ``.0`` (T15)."""
    c = F.col(f"`{name}`")
    text = c.cast("string")
    if kind in ("double", "float"):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(text)
    return text


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(c)


def normalised(c: Column) -> Column:
    """NFKC, lower case, collapsed and trimmed white space. Only texts beyond ASCII go to Python; others cross as nulls."""
    return squish(F.lower(F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)))


def jaro_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarities of pairs of strings, many at a time; two empty ones are equal."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.empty(len(a))
    order = np.argsort(n * 1024 + m, kind="stable")  # pairs of like lengths together
    at = 0
    while at < len(order):
        wide = max(1, int(n[order[at:]].max(initial=0)), int(m[order[at:]].max(initial=0)))
        pick = order[at : at + max(1, CELLS // wide)]
        out[pick] = _jaro([a[i] for i in pick], [b[i] for i in pick], n[pick], m[pick])
        at += len(pick)
    return out


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, dtype=f"<U{width}").view("<u4").reshape(len(texts), width)


def _jaro(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    wide_a, wide_b = max(1, int(n.max())), max(1, int(m.max()))
    x, y = _codes(a, wide_a), _codes(b, wide_b)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)[:, None]
    place = np.arange(wide_b)
    free, mine = place < m[:, None], np.zeros(x.shape, bool)
    for i in range(wide_a):  # each letter takes the first free equal one within reach
        may = (y == x[:, i : i + 1]) & free & (np.abs(place - i) <= reach) & (i < n)[:, None]
        j = may.argmax(1)
        hit = np.flatnonzero(may[np.arange(len(j)), j])
        mine[hit, i] = True
        free[hit, j[hit]] = False
    theirs = (place < m[:, None]) & ~free
    k = mine.sum(1)
    width = int(k.max(initial=0))
    left = np.take_along_axis(x, np.argsort(~mine, axis=1, kind="stable"), 1)[:, :width]
    right = np.take_along_axis(y, np.argsort(~theirs, axis=1, kind="stable"), 1)[:, :width]
    moved = ((left != right) & (np.arange(width) < k[:, None])).sum(1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.where(k > 0, (k / n + k / m + (k - moved) / k) / 3, 0.0)
    return np.where([p == q for p, q in zip(a, b, strict=True)], 1.0, sim)


def _edits(a: str, b: str, anywhere: bool) -> int:
    """Edits with transpositions: of neighbours once (osa), or with edits between them (dl)."""
    n, m = len(a), len(b)
    far = n + m
    d = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    last: dict[str, int] = {}
    for i in range(1, n + 1):
        match = 0
        for j in range(1, m + 1):
            same = a[i - 1] == b[j - 1]
            best = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1)
            if anywhere:
                k, q = last.get(b[j - 1], 0), match
                best = min(best, d[k][q] + (i - k - 1) + 1 + (j - q - 1))
            elif i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d[i - 1][j - 1] + 1)
            d[i + 1][j + 1] = best
            if same:
                match = j
        last[a[i - 1]] = i
    return d[n + 1][m + 1]


def _lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def _python(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(f(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def jaro_similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = pd.Series([None] * len(x), index=x.index, dtype="Float64")
        out[known] = jaro_pairs(x[known].tolist(), y[known].tolist())
        return out

    return run(a, b)


def jaro_possible(a: Column, b: Column, similarity: float) -> Column:
    """Whether the lengths allow a Jaro similarity of so much: a native filter ahead of the function."""
    lo, hi = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(hi == 0, True).otherwise((2 + lo / hi) / 3 >= similarity)


def _letters(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def _count(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y == x))


def distance(a: Column, b: Column, method: str) -> Column:
    """The distance ``method`` names: lv, jw (Jaro), osa, dl, lcs, hamming, qgram, cosine, jaccard (q = 1), soundex.

    Null if either side is null; Hamming of unequal lengths is infinite.
    """
    x, y = _letters(a), _letters(b)
    if method == "lv":
        return F.levenshtein(a, b).cast("double")
    if method == "jw":
        return 1 - jaro_similarity(a, b)
    if method in ("osa", "dl", "lcs"):
        return _python({"osa": lambda p, q: _edits(p, q, False), "dl": lambda p, q: _edits(p, q, True), "lcs": _lcs}[method])(a, b)
    if method == "hamming":
        return F.when(F.length(a) != F.length(b), F.lit(float("inf"))).otherwise(F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda z: z)).cast("double"))
    if method == "soundex":
        return (F.soundex(a) != F.soundex(b)).cast("double")
    if method == "jaccard":
        both = F.size(F.array_union(x, y))
        return F.when(both == 0, 0.0).otherwise(1 - F.size(F.array_intersect(x, y)) / both)
    every = F.array_union(x, y)
    if method == "qgram":
        return F.aggregate(every, F.lit(0), lambda s, g: s + F.abs(_count(x, g) - _count(y, g))).cast("double")
    if method == "cosine":
        def dot(p, q):
            return F.aggregate(every, F.lit(0.0), lambda s, g: s + _count(p, g) * _count(q, g))

        return F.when(a == b, 0.0).when((F.length(a) == 0) | (F.length(b) == 0), 1.0).otherwise(1 - dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)))
    raise ValueError(f"unknown distance: {method}")


def parsed_numbers(c: Column) -> Column:
    """The numbers in a string as doubles; null gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(c.cast("string"), F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


