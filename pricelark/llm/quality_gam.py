"""Quality classifier: a generalised additive model with pairwise interactions.

Features are ratios of counts of the text, cut into at most BINS bins. Boosting goes round the
features; each turn fits one shallow tree to the gradient and adds it to the feature's lookup
table. Then the pairs that explain most of what is left get tables of two features in the same
way. A score is the sum of table entries through the logistic function.

Training takes at most `sample` labelled rows, chosen by a hash of the id (of rows with an equal id
by their features; a label that is both 0 and 1 counts as 1); everything else runs over all documents. Null ids, rows without a label and labels of held-out rows are never
learned from. Without labelled rows every score is 0.5. Null and empty texts have features of
zero and a score like any other text. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.llm.quality_rules import base_columns
from pricelark.llm.text import saved

SAMPLE = 20_000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 6
RATE, RIDGE = 0.1, 5.0

# feature: SQL over the base columns
FEATURES = {
    "log_words": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "exclaim": "n_exclaim / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_length": "n_words / greatest(n_lines, 1)",
    "fresh_windows": "n_distinct / greatest(n_windows, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features, all numbers; one pass over the texts."""
    d = base_columns(docs)
    return d.select("doc_id", *[F.expr(f"CAST({x} AS DOUBLE)").alias(n) for n, x in FEATURES.items()])


def held_out(mod: int, rest: int) -> Column:
    """Whether crc32(id as text) leaves `rest`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod == rest


def least_hashes(d: DataFrame, rows: int, of: int, ties: list[str]) -> DataFrame:
    """The `rows` rows of least hash of their id, out of `of`, rows of one id by `ties`. Most others
    are left out by the hash alone, so that no task sends many rows to be sorted."""
    slots = 1 << 20
    near = min(slots, int(slots * (1.3 * rows + 1000) / max(of, 1)) + 1)
    h = F.xxhash64("doc_id")
    return d.filter(F.pmod(h, F.lit(slots)) < near).orderBy(F.pmod(h, F.lit(slots)), h, "doc_id", *ties).limit(rows)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values per bin of the greedy tree of so many leaves, from sums of gradients and weights."""
    parts = [(0, len(g))]

    def gain(a: int, b: int) -> tuple[float, int]:
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        if not len(left_g):
            return 0.0, a
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        better = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE)
        k = int(np.argmax(better))
        return float(better[k] - all_g**2 / (all_h + RIDGE)), a + k + 1

    while len(parts) < leaves:
        best = max(((*gain(a, b), i) for i, (a, b) in enumerate(parts)), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        a, b = parts[best[2]]
        parts[best[2] : best[2] + 1] = [(a, best[1]), (best[1], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of a tree that cuts the first feature once and each side once by the second; its gain."""
    best, value = -1.0, np.zeros_like(g)
    rows_g, rows_h = np.cumsum(g, 0), np.cumsum(h, 0)
    for k in range(g.shape[0] - 1):
        out, total = np.zeros_like(g), 0.0
        for part, pg, ph in (
            (slice(0, k + 1), rows_g[k], rows_h[k]),
            (slice(k + 1, None), rows_g[-1] - rows_g[k], rows_h[-1] - rows_h[k]),
        ):
            leaf = tree(pg, ph, 2)
            out[part] = leaf[None, :]
            total += float((2 * leaf * pg - leaf**2 * (ph + RIDGE / 2)).sum())
        if total > best:
            best, value = total, out
    return value, best


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """One column of bin numbers per feature."""
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Table entries added up, as a probability."""
        z = np.full(len(x), self.base)
        if self.tables:
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                z += t[b[:, j]]
            for (i, j), t in self.pairs.items():
                z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model from features and 0/1 labels; bounded rows, so in one place."""
    model = Model()
    if not len(y):
        return model
    rate = np.clip(y.mean(), 0.01, 0.99)
    model.base = float(np.log(rate / (1 - rate)))
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], cuts)) for j in range(x.shape[1])]
    b = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in size]
    z = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, s in enumerate(size):
            g, h = gradient()
            step = RATE * tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s))
            model.tables[j] += step
            z += step[b[:, j]]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradient()
        at, shape = b[:, i] * size[j] + b[:, j], (size[i], size[j])
        n = size[i] * size[j]
        return np.bincount(at, g, n).reshape(shape), np.bincount(at, h, n).reshape(shape)

    gains = {p: pair_tree(*cells(*p))[1] for p in combinations(range(len(size)), 2)}
    chosen = sorted(gains, key=lambda p: -gains[p])[:PAIRS]
    model.pairs = {p: np.zeros((size[p[0]], size[p[1]])) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            step = RATE * pair_tree(*cells(i, j))[0]
            model.pairs[i, j] += step
            z += step[b[:, i], b[:, j]]
    return model


def scored(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels: doc_id and quality."""
    d = saved(features(docs))
    names = list(FEATURES)
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("y IS NOT NULL")
    known = known.filter(~held_out(mod, rest)).groupBy("doc_id").agg(F.max("y").alias("y"))  # of clashing labels 1
    learnable = saved(d.join(known, "doc_id"))
    rows = least_hashes(learnable, sample, learnable.count(), names).select("y", *names).toPandas()
    model = fit(rows[names].to_numpy(float), rows["y"].to_numpy(float))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([c.to_numpy(float) for c in columns], 1)))

    d = d.select("doc_id", held_out(mod, rest).alias("held_out"), score(*names).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
