"""Toxicity by a linear-chain conditional random field.

Tokens are lower-cased words; each is clean or toxic, with features of the word and of its
first four letters, hashed into weight tables, and weights for going from one state to the
next. Labels are given per document, so training tokens are labelled from them: a token of a
toxic document is toxic if its word or beginning is far more frequent in toxic documents than
in others. Forward-backward gives each token its marginal; the greatest marginal and the
expected number of toxic tokens give the document's score, by weights fitted to the labels.
Tokens of marginal 1/2 or more are the offending spans.

Training takes at most `sample` documents labelled toxic and three times as many others,
chosen by a hash of the id, from rows that are not held out; all documents are scored, whole. A document is one chain.
Null and empty texts have no token and the least score. Without documents of both labels every
score is 0. Repeated rows give equal rows; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelark.llm.quality_gam import held_out
from pricelark.llm.text import saved, settled, small_batches, whole

SAMPLE = 1500  # toxic documents, and three times as many others
TOKENS = 20_000_000  # of all of them together: what the driver learns from
WORDS, STARTS = 1 << 22, 1 << 20  # sizes of the two weight tables
RATIO, LEAST = 20.0, 0.01  # how much more frequent, and in what share of the toxic documents at least
CHAIN = 1000  # tokens of a training chain; scoring does not cut texts
EPOCHS, RATE, RIDGE = 30, 0.5, 1e-4
BLOCK = 400_000  # tokens of the chains that training holds messages of at once


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, w and s: feature numbers of every token of the whole text."""
    d = docs.select(*keep, F.split(F.lower(whole()), r"[^\p{L}\p{M}\p{N}]+").alias("t"))
    d = settled(d.withColumn("t", F.filter("t", lambda x: x != "")))
    return d.select(
        *keep,
        F.transform("t", lambda x: F.hash(x).bitwiseAND(WORDS - 1)).alias("w"),
        F.transform("t", lambda x: F.hash(F.substring(x, 1, 4)).bitwiseAND(STARTS - 1)).alias("s"),
    )


@dataclass
class Model:
    words: np.ndarray  # weights of the toxic state by word; the clean state has none
    starts: np.ndarray
    bias: float
    moves: np.ndarray  # 2 x 2, from state to state
    scale: np.ndarray  # of 1, the greatest logit, log(1 + expected tokens)

    def emission(self, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        return self.words[w] + self.starts[s] + self.bias


def marginals(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic marginals of chains laid end to end, and expected counts of the moves.

    Two states, so forward and backward messages are one ratio each. All chains step together,
    the longest first, so that those still running are a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    m = np.exp(moves)
    s = np.exp(np.clip(e, -30, 30))
    top = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(top), "left")  # chains longer than t
    into = np.empty(len(e))  # forward ratio without the token's own emission
    ratio = np.ones(len(size))
    for t in range(top):
        n = active[t]
        at = start[:n] + t
        r = ratio[:n]
        step = (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r) if t else np.ones(n)
        into[at] = step
        ratio[:n] = np.clip(step * s[at], 1e-12, 1e12)
    back = np.ones(len(e))
    ratio = np.ones(len(size))
    for t in range(top - 2, -1, -1):
        n = active[t + 1]
        at = start[:n] + t
        q = s[at + 1] * back[at + 1]
        back[at] = (m[1, 0] + m[1, 1] * q) / (m[0, 0] + m[0, 1] * q)
    odds = np.clip(into * s * back, 1e-12, 1e12)
    p = odds / (1 + odds)
    last = np.zeros(len(e), bool)
    last[(start + size - 1)[size > 0]] = True
    i = np.flatnonzero(~last)
    f = into[i] * s[i]
    q = s[i + 1] * back[i + 1] if len(i) else np.empty(0)
    joint = np.stack([m[0, 0] + 0 * f, m[0, 1] * q, f * m[1, 0], f * m[1, 1] * q])
    joint /= joint.sum(0)
    return p, joint.sum(1).reshape(2, 2)


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """1, the greatest logit and log(1 + expected toxic tokens) of each chain."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    out[:, 1] = -8
    full = np.flatnonzero(lengths > 0)
    if len(full):
        first = (np.cumsum(lengths) - lengths)[full]
        most = np.clip(np.maximum.reduceat(p, first), 3e-4, 1 - 3e-4)
        out[full, 1] = np.log(most / (1 - most))
        out[full, 2] = np.log1p(np.add.reduceat(np.where(p >= 0.01, p, 0), first))
    return out


def blocks(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Runs of whole chains of about BLOCK tokens together: the chains and their tokens."""
    ends, i, at = np.cumsum(lengths), 0, 0
    while i < len(lengths):
        j = max(int(np.searchsorted(ends, at + BLOCK, "right")), i + 1)
        yield slice(i, j), slice(at, int(ends[j - 1]))
        i, at = j, int(ends[j - 1])


def numbered(f: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different features, and each token's place among them."""
    there = np.zeros(size, bool)
    there[f] = True
    place = np.cumsum(there, dtype=np.int32) - 1
    return np.flatnonzero(there), place[f]


def token_labels(f: np.ndarray, n: int, lengths: np.ndarray, toxic: np.ndarray, share: float, least: int) -> np.ndarray:
    """Which of n features are at least RATIO times as frequent in toxic documents as in others."""
    there, rest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for docs, at in blocks(lengths):
        size = lengths[docs]
        pair = np.unique(np.repeat(np.arange(len(size)), size) * n + f[at])
        bad = toxic[docs][pair // n]
        there += np.bincount(pair[bad] % n, minlength=n)
        rest += np.bincount(pair[~bad] % n, minlength=n)
    bad, good = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    return (there >= max(least, share * bad)) & (there / bad >= RATIO * (rest + 0.05) / good)


def moved(y: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each label follows each within a chain."""
    inner = np.ones(max(len(y) - 1, 0), bool)
    ends = np.cumsum(lengths) - 1
    inner[ends[(ends >= 0) & (ends < len(inner))]] = False
    step = 2 * y[:-1].astype(np.int8) + y[1:]
    return np.bincount(step[inner], minlength=4).reshape(2, 2).astype(float)


def fit(w: np.ndarray, s: np.ndarray, lengths: np.ndarray, toxic: np.ndarray) -> Model:
    """Gradient ascent on the likelihood of the token labels; bounded rows, so in one place, a block of chains at a time."""
    model = Model(np.zeros(WORDS, np.float32), np.zeros(STARTS, np.float32), -3.0, np.zeros((2, 2)), np.zeros(3))
    if not toxic.any() or toxic.all():
        model.scale[:] = (-30, 0, 0)
        return model
    words, wi = numbered(w, WORDS)
    starts, si = numbered(s, STARTS)
    y = token_labels(wi, len(words), lengths, toxic, LEAST, 4)[wi]
    y |= token_labels(si, len(starts), lengths, toxic, 2 * LEAST, 8)[si]
    y &= np.repeat(toxic, lengths)
    full = lengths
    lengths = chunks(lengths)
    a, b, bias, moves = np.zeros(len(words)), np.zeros(len(starts)), -3.0, np.zeros((2, 2))
    seen = moved(y, lengths)
    ga, gb, gc, gm = np.full(len(words), 1e-2), np.full(len(starts), 1e-2), 1e-2, np.full((2, 2), 1e-2)
    for _ in range(EPOCHS):  # adaptive steps, each weight by its own gradients
        da, db = -RIDGE * len(y) * 1e-2 * a, -RIDGE * len(y) * 1e-2 * b
        dc, dm = 0.0, seen.copy()
        for chains, at in blocks(lengths):
            p, expected = marginals(a[wi[at]] + b[si[at]] + bias, lengths[chains], moves)
            r = y[at] - p
            da += np.bincount(wi[at], r, minlength=len(a))
            db += np.bincount(si[at], r, minlength=len(b))
            dc, dm = dc + r.sum(), dm - expected
        ga, gb, gc, gm = ga + da**2, gb + db**2, gc + dc**2, gm + dm**2
        a, b = a + RATE * da / np.sqrt(ga), b + RATE * db / np.sqrt(gb)
        bias, moves = bias + RATE * dc / np.sqrt(gc), moves + RATE * dm / np.sqrt(gm)
    model.words[words], model.starts[starts] = a, b
    model.bias, model.moves = float(bias), moves
    x = np.concatenate(
        [
            summary(marginals(model.emission(w[at], s[at]).astype(float), full[docs], moves)[0], full[docs])
            for docs, at in blocks(full)
        ]
    )
    model.scale = logistic(x, toxic.astype(float))
    return model


def chunks(lengths: np.ndarray) -> np.ndarray:
    """Lengths of chains of at most CHAIN tokens that training cuts long texts into."""
    n = -(-lengths // CHAIN)
    last = np.cumsum(n)[n > 0] - 1
    out = np.full(int(n.sum()), CHAIN)
    out[last] = (lengths - (n - 1) * CHAIN)[n > 0]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    c = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c))
        c = c + np.linalg.solve(h, x.T @ (y - p) - ridge * c)
    return c


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the lengths."""
    offsets = np.asarray(lists.offsets)
    return np.asarray(lists.values)[offsets[0] : offsets[-1]], np.diff(offsets)


def runs(hit: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hits within each chain: chain, first and last place."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(hit)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    same = np.zeros(len(hit), bool)
    same[1:] = hit[1:] & hit[:-1] & (doc[1:] == doc[:-1])
    first = np.flatnonzero(hit & ~same)
    ends = np.ones(len(hit), bool)
    ends[:-1] = ~same[1:]
    last = np.flatnonzero(hit & ends)
    return doc[first], place[first], place[last]


def score_batches(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            w, lengths = flat(batch.column("w"))
            s, _ = flat(batch.column("s"))
            p, _ = marginals(model.emission(w, s).astype(float), lengths, model.moves)
            z = summary(p, lengths) @ model.scale
            doc, first, last = runs(p >= 0.5, lengths)
            spans = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["first", "last"])
            offsets = np.searchsorted(doc, np.arange(len(lengths) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
                ],
                ["doc_id", "score", "spans"],
            )

    return run


def training(docs: DataFrame, labels: DataFrame, mod: int, rest: int, sample: int) -> DataFrame:
    """doc_id, toxic, w, s of the documents to learn from."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    known = known.filter(~held_out(mod, rest)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of clashing labels 1
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in ((0, 3 * sample), (1, sample))]
    few = F.broadcast(chosen[0].union(chosen[1]))  # 4 * sample rows at most
    # copies would make their words look telling
    rows = docs.join(few, "doc_id").groupBy("text").agg(F.min(F.struct("doc_id", "toxic")).alias("m"))
    d = saved(tokens(rows.select("text", "m.*"), "doc_id", "toxic"))
    # whole texts in the order of a hash, as long as they fit
    place = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    sizes = d.select(place.alias("p"), F.size("w").alias("n")).orderBy("p").collect()  # 4 * sample rows at most
    room = np.cumsum([r["n"] for r in sizes]) <= TOKENS
    if room.all():
        return d
    last = sizes[int(room.sum())]["p"]
    return d.filter(place < F.struct(F.lit(last["h"]).alias("h"), F.lit(last["doc_id"]).cast("long").alias("doc_id")))


def scored(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (first and last token) for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = training(docs.select("doc_id", "text"), labels, mod, rest, sample).orderBy("doc_id").toArrow().combine_chunks()
    if rows.num_rows:
        w, lengths = flat(rows.column("w").chunk(0))
        s, _ = flat(rows.column("s").chunk(0))
        model = fit(w, s, lengths, rows.column("toxic").to_numpy() == 1)
    else:
        none = np.empty(0, int)
        model = fit(none, none, none, np.empty(0, bool))
    schema = "doc_id long, score double, spans array<struct<first:int,last:int>>"
    d = tokens(docs, "doc_id").mapInArrow(score_batches(spark.sparkContext.broadcast(model)), schema)
    return d.select(
        "doc_id",
        held_out(mod, rest).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
