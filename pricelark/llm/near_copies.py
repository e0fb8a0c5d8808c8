"""MinHash near-dedup by order MinHash (OMH).

Every text is its words; windows of SHINGLE words are labelled with how often they came before
in the text. In each of ROUNDS rounds the two windows of least hash are taken and hashed in the
order in which they stand in the text: two texts agree on a sketch only if they share windows
in the same order, so agreement follows edit similarity. Few windows of a short text outlive an
edit, so texts of at most SHORT words have SHORT_ROUNDS further sketches of two single words.

Equal texts are one first. Texts with an equal sketch form a bucket, and every member is compared
with the bucket's first text. Then they meet again by what they have and the first text lacks: by
the RESIDUES least of their sampled words (the SAMPLE of least hash), then, of those with one first
text, by one more word, until no bucket of two is left. So texts that share much with a whole bucket (a
common passage, boilerplate) part by the rest of their words, and no large bucket is compared pair by pair.
Once a level has few pairs, one task goes through all levels left. A text that has no sampled word
beyond a first text ends there; if that text's alignment then refuses it, it meets the others that it
refused by their sketches once more.

A comparison is exact in the end and cheap at first. Lengths and signatures (how many words fall
into each of 256 parts) bound the words that two texts can share from above; a pair that cannot
reach the limit goes no further. For the others words are read, and a banded word alignment,
widened while the limit is not decided, checks edit similarity >= `similarity`. Links give classes
by connected components.

Texts without words are in a class of their own each. Fewer words than a window are one window.
Repeated rows are copies of one another. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelark.llm.components import components
from pricelark.llm.text import WORD, bounded, digest, rows, saved, settled, small_batches, whole, words

SHINGLE = 2
ROUNDS = 24
SHORT = 32  # words up to which a text is sketched by single words as well
SHORT_ROUNDS = 12
SAMPLE = 64  # different words of a text, those of least hash
RESIDUES = 12  # of them, those that a refused text has beyond the first one
PARTS, PER_PART = 256, 2.5  # parts of a signature: twice as many while more words fall into one
FULL = 255  # a part's count is exact below
SIMILARITY = 0.8
PIECE = 500_000  # words sketched at once in a task
FEW = 200_000  # rows of ids that may be broadcast, counted first
FEW_PAIRS = 50_000  # the same of pairs
LAST_PAIRS = 10_000  # all pairs of a level's buckets are judged, if they are so few
LAST_ROWS = 20_000  # pairs of a level from which on one task goes through the levels left
BLOCK = 2_000  # pairs judged at once there
SMALL = 128  # texts of a bucket of which all pairs are judged, of texts that an alignment refused
CHUNK = 2_000_000  # cells of an alignment band at once

NONE = np.uint32(0xFFFFFFFF)
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(flat: np.ndarray, lengths: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled window hashes of texts laid end to end, and how many each text has."""
    docs = len(lengths)
    padded = np.zeros(len(flat) + docs * (width - 1), np.uint64)
    starts = np.cumsum(lengths) - lengths + np.arange(docs) * (width - 1)
    own = np.arange(len(flat)) + np.repeat(np.arange(docs) * (width - 1), lengths)
    padded[own] = mix(flat + M1)
    n = np.maximum(lengths - width + 1, 1)
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(starts - first, n)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * M1 + padded[at + k]
    h = mix(h)
    text = np.repeat(mix(np.arange(docs).astype(np.uint64) + M1), n)
    key = h ^ text
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    place = np.arange(len(key))
    seen = place - np.maximum.accumulate(np.where(same, 0, place))
    label = np.zeros(len(key), np.uint64)
    label[order] = seen.astype(np.uint64)
    return mix(h + label * M3), n


def sketches(flat: np.ndarray, lengths: np.ndarray, width: int = SHINGLE, rounds: range = range(ROUNDS)) -> np.ndarray:
    """A sketch per round for each text of one word or more."""
    h, n = shingles(flat, lengths, width)
    first = np.cumsum(n) - n
    out = np.empty((len(lengths), len(rounds)), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for r in rounds:
        seed = mix(np.array([r + 1], np.uint64) * M1)[0]
        g = (h ^ seed) * (seed | np.uint64(1))
        one = least(g, first, n)
        g[one] = top
        two = least(g, first, n)  # a text of one window has that one again
        a, b = np.minimum(one, two), np.maximum(one, two)
        out[:, r - rounds[0]] = mix(h[a] * M2 + mix(h[b] + np.uint64(r)))
    return out


def least(g: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of each text's least value, the first one of equals."""
    hit = np.flatnonzero(g == np.repeat(np.minimum.reduceat(g, first), n))
    if len(hit) > len(n):
        _, keep = np.unique(np.searchsorted(first, hit, "right"), return_index=True)
        hit = hit[keep]
    return hit


def signatures(flat: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """How many words of each text fall into each part, at most FULL. Parts are runs of hashes, so
    that neighbours added up are the parts of a shorter signature."""
    more = np.maximum(np.ceil(np.log2(np.maximum(lengths, 1) / (PARTS * PER_PART))), 0).astype(np.int64)
    sizes = PARTS << more
    begins = np.cumsum(sizes) - sizes
    shift = (64 - (PARTS.bit_length() - 1) - more).astype(np.uint64)
    at = np.repeat(begins, lengths) + (mix(flat) >> np.repeat(shift, lengths)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=sizes.sum()), FULL).astype(np.uint8)
    return [x.tobytes() for x in np.split(counts, begins[1:])]


def shared_at_most(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bounds from above, by signatures, of how many words pairs of texts share."""
    p, q = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.empty(len(a), np.int64)
    for u, v in np.unique(np.stack([p, q], 1), axis=0):
        rows = np.flatnonzero((p == u) & (q == v))
        least = min(u, v)
        x, y = (
            np.frombuffer(b"".join(s[i] for i in rows), np.uint8).reshape(len(rows), least, -1).astype(np.int64)
            for s in (a, b)
        )
        for z in (x, y):
            z[z == FULL] = 1 << 40  # two full parts may share any number of words
        out[rows] = np.minimum(x.sum(2), y.sum(2)).sum(1)
    return out


def samples(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The SAMPLE least hashes (32 bits) of each text's different words, rising; filled up with the greatest number."""
    docs = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    key = np.unique(docs << np.uint64(32) | mix(flat + M3) >> np.uint64(32))
    doc = (key >> np.uint64(32)).astype(np.int64)
    place = np.arange(len(key)) - np.searchsorted(doc, doc)
    out = np.full((len(lengths), SAMPLE), NONE, np.uint32)
    keep = place < SAMPLE
    out[doc[keep], place[keep]] = key[keep].astype(np.uint32)
    return out


SKETCHED = "text_digest string, n int, sketches array<long>, signature binary, sample binary"


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("h")
        offsets = np.asarray(lists.offsets)
        values = np.asarray(lists.values)[offsets[0] : offsets[-1]].view(np.uint64)
        offsets = offsets - offsets[0]
        lengths = np.diff(offsets)
        out, marks = np.empty((len(lengths), ROUNDS), np.uint64), []
        few_words = np.empty((len(lengths), SAMPLE), np.uint32)
        i = 0
        while i < len(lengths):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            own = values[offsets[i] : offsets[j]]
            out[i:j] = sketches(own, lengths[i:j])
            marks += signatures(own, lengths[i:j])
            few_words[i:j] = samples(own, lengths[i:j])
            i = j
        short = lengths <= SHORT
        sizes = np.where(short, ROUNDS + SHORT_ROUNDS, ROUNDS)
        ends = np.r_[0, np.cumsum(sizes)]
        flat = np.empty(ends[-1], np.uint64)
        flat[(ends[:-1, None] + np.arange(ROUNDS)).reshape(-1)] = out.reshape(-1)
        if short.any():
            few = sketches(values[np.repeat(short, lengths)], lengths[short], 1, range(ROUNDS, ROUNDS + SHORT_ROUNDS))
            flat[(ends[:-1][short, None] + ROUNDS + np.arange(SHORT_ROUNDS)).reshape(-1)] = few.reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
        marks, few_words = pa.array(marks, pa.binary()), pa.array([x.tobytes() for x in few_words], pa.binary())
        columns = [batch.column("text_digest"), pa.array(lengths.astype(np.int32)), lists, marks, few_words]
        yield pa.RecordBatch.from_arrays(columns, ["text_digest", "n", "sketches", "signature", "sample"])


JUDGED = "a long, b long, maybe boolean, residues array<long>"


def lacking(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which sampled words of each row of x are not in the row of y."""
    row = np.arange(len(x), dtype=np.uint64)[:, None] << np.uint64(32)
    return ~np.isin(row | x, row | y) & (x != NONE)


def possible(n: np.ndarray, m: np.ndarray, marks, similarity: float) -> np.ndarray:
    """Whether lengths and signatures let pairs be similar; marks(rows): the signatures of both texts of those rows."""
    size = np.maximum(n, m)
    limit = np.floor((1 - similarity) * size + 1e-9)
    maybe = np.abs(n - m) <= limit
    near = np.flatnonzero(maybe)
    maybe[near] = size[near] - shared_at_most(*marks(near)) <= limit[near]
    return maybe


def onward(n: np.ndarray, x: np.ndarray, y: np.ndarray, maybe: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """How many residues each pair has, and the residues end to end; see judge_batches."""
    left = lacking(x, y)
    if level:
        order = np.where(left, mix(x.astype(np.uint64) + np.uint64(level) * M1) >> np.uint64(1), np.uint64(1 << 63))
        chosen = np.arange(SAMPLE) == order.argmin(1)[:, None]
    else:
        chosen = left & (np.cumsum(left, 1) <= RESIDUES)
    # with nothing beyond b a text goes on, by its first word, only if it cannot be similar to b
    alone = ~left.any(1)
    chosen[alone] = False
    chosen[alone & ~maybe, 0] = True
    row, at = np.nonzero(chosen)
    word = x[row, at].astype(np.uint64)
    # similar texts are of similar length: those far from one another part as well
    shift = (mix(word + M2) >> np.uint64(40)).astype(float) / (1 << 24)
    span = np.floor(np.log2(n[row]) * 1.5 + shift).astype(np.uint64)
    return chosen.sum(1), mix((span << np.uint64(32)) + word * M1).view(np.int64)


def judge_batches(similarity: float, level: int):
    """Whether lengths and signatures let a pair be similar; where a may meet others without b: by
    its least words beyond b (level 0), or by one of them, another one at every level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (np.asarray(batch.column(c)).astype(np.int64) for c in ("na", "nb"))
            maybe = possible(
                n, m, lambda rows, of=batch: (of.column(c).take(pa.array(rows)).to_pylist() for c in ("sa", "sb")), similarity
            )
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SAMPLE) for c in ("wa", "wb"))
            counts, residues = onward(n, x, y, maybe, level)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(residues))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(maybe), lists], ["a", "b", "maybe", "residues"]
            )

    return run


def starred(text: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (text, b, x) in the order of their buckets (b, x) and texts, and where each bucket begins."""
    rows = np.unique(np.stack([b, x, text], 1), axis=0)
    starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]) if len(rows) else np.empty(0, np.int64)
    return rows[:, 2], starts


def finish_batches(similarity: float, level: int, small: int):
    """All levels from this one on, of rows (a, b, x, n, signature, sample): the pairs that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([x for x in batches if x.num_rows] or [pa.RecordBatch.from_pydict({"a": []})])
        if not held.num_rows:
            return
        ids, at = np.unique(np.asarray(held.column("a")), return_index=True)
        n = np.asarray(held.column("n")).astype(np.int64)[at]
        marks = held.column("signature").take(pa.array(at)).to_pylist()
        words = b"".join(held.column("sample").take(pa.array(at)).to_pylist())
        words = np.frombuffer(words, np.uint32).reshape(-1, SAMPLE)
        text = np.searchsorted(ids, np.asarray(held.column("a")))  # texts by their place: places rise with ids
        b, x = np.asarray(held.column("b")).astype(np.int64), np.asarray(held.column("x")).astype(np.int64)
        now = level
        while True:
            member, starts = starred(text, b, x)
            sizes = np.diff(np.r_[starts, len(member)])
            key = np.int64(len(ids))
            first = np.repeat(member[starts], sizes)
            stars = member != first
            pairs = np.unique(member[stars] * key + first[stars])
            if not len(pairs):
                return
            inside = sizes <= (len(ids) if (sizes * (sizes - 1) // 2).sum() <= LAST_PAIRS else small)
            ends = np.repeat(starts + sizes, sizes)[np.repeat(inside, sizes)]
            each = zip(np.flatnonzero(np.repeat(inside, sizes)), ends, strict=True)
            others = [member[i + 1 : end] * key + member[i] for i, end in each]
            others = np.setdiff1d(np.concatenate([pairs[:0], *others]), pairs)
            still = stars & ~np.repeat(inside, sizes)
            still = np.isin(pairs, member[still] * key + first[still])
            text, b, x = [], [], []
            for own, star in ((pairs, True), (others, False)):
                for i in range(0, len(own), BLOCK):
                    p, q = np.divmod(own[i : i + BLOCK], key)
                    maybe = possible(
                        n[p], n[q], lambda r, p=p, q=q: ([marks[k] for k in y[r]] for y in (p, q)), similarity
                    )
                    ended = maybe & False
                    if star:
                        counts, residues = onward(n[p], words[p], words[q], maybe, now)
                        text.append(np.repeat(p, counts))
                        b.append(ids[np.repeat(q, counts)])
                        x.append(residues)
                        ended = maybe & (counts == 0) & still[i : i + BLOCK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[p[maybe]]), pa.array(ids[q[maybe]]), pa.array(ended[maybe])], ["a", "b", "ended"]
                    )
            text, b, x = (np.concatenate(v) for v in (text, b, x))
            now += 1

    return run


def distances(a: list[np.ndarray], b: list[np.ndarray], half: int) -> np.ndarray:
    """Word edit distances of pairs, exact where at most `half`, else an upper bound or large."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, width = int(n.max()), 2 * half + 1
    far = np.int32(1 << 29)
    ap = np.full((len(a), rows), -1, np.int64)
    bp = np.full((len(a), rows + width + half), -2, np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        ap[i, : len(x)] = x
        keep = y[: bp.shape[1] - half]
        bp[i, half : half + len(keep)] = keep
    offset = np.arange(-half, half + 1)
    step = np.arange(width, dtype=np.int32)
    d = np.where(offset >= 0, offset, far).astype(np.int32)[None, :].repeat(len(a), 0)
    out = np.full(len(a), far, np.int32)
    reach = np.abs(m - n) <= half
    done = np.flatnonzero((n == 0) & reach)
    out[done] = m[done]
    for i in range(1, rows + 1):
        new = d + (bp[:, i - 1 : i - 1 + width] != ap[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        new[:, offset < -i] = far
        d = np.minimum.accumulate(new - step, axis=1) + step
        ended = np.flatnonzero((n == i) & reach)
        out[ended] = d[ended, (m - n)[ended] + half]
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the common multiset."""
    u, i = np.unique(x, return_counts=True)
    v, j = np.unique(y, return_counts=True)
    _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(i[p], j[q]).sum())


def similar(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each pair's edit distance is at most (1 - similarity) of the longer text."""
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    limit = np.floor((1 - similarity) * size + 1e-9).astype(int)
    out = np.zeros(len(a), bool)
    # what two texts do not share at all must be edited
    left = [i for i in range(len(a)) if size[i] - overlap(a[i], b[i]) <= limit[i]]
    half = 8
    while left:
        left.sort(key=lambda i: size[i])
        undecided = []
        while left:
            take = max(1, min(len(left), int(CHUNK // ((size[left[-1]] + 4 * half) + 40 * half))))
            part, left = left[-take:], left[:-take]
            d = distances([a[i] for i in part], [b[i] for i in part], half)
            for i, x in zip(part, d, strict=True):
                if x <= limit[i]:
                    out[i] = True
                elif half < limit[i]:
                    undecided.append(i)
        left, half = undecided, half * 4
    return out


def verify_batches(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = similar(list(p["wa"]), list(p["wb"]), similarity)
            yield p.loc[ok, ["a", "b"]]

    return run


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; texts: id and words."""
    left = texts.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "wa", "wb")
    return both.mapInPandas(verify_batches(similarity), "a long, b long")


def stars(buckets: DataFrame) -> DataFrame:
    """Members a of buckets of two texts or more, each with the bucket's first text b: a row a pair."""
    first = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("b")).filter("n > 1")
    pairs = buckets.join(first.select("key", "b"), "key").filter(F.col("a") != F.col("b"))
    return pairs.select("a", "b").distinct()


def judged(pairs: DataFrame, marks: DataFrame, similarity: float, level: int = 0) -> DataFrame:
    """The pairs with `maybe` and `residues`; marks: id, n, signature and sample of every text."""

    def side(x: str) -> DataFrame:
        names = {"id": x, "n": "n" + x, "signature": "s" + x, "sample": "w" + x}
        return marks.select(*[F.col(c).alias(to) for c, to in names.items()])

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.select("a", "b", "na", "nb", "sa", "sb", "wa", "wb")
    return saved(both.mapInArrow(judge_batches(similarity, level), JUDGED))


def among(marks: DataFrame, pairs: DataFrame, few: bool) -> DataFrame:
    """The marks of the texts in the pairs, saved: what later levels read gets less with their pairs."""
    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    return saved(marks.join(F.broadcast(ids) if few else ids, "id", "left_semi"))


def meetings(seen: DataFrame, marks: DataFrame, similarity: float, small: int = 0) -> DataFrame:
    """(a, b, ended) that may be similar: of the pairs already judged, and of those that meet as both have
    the same word beyond a first text. Texts with one first text part by that word, whatever buckets
    they met it in, so there is a row a pair, and no more pairs at a level than at the one before.
    All pairs of the buckets are judged if they are few, or of those of at most `small` texts. The levels
    go on until no bucket of two is left: texts of two buckets with one first text may meet later. Once
    a level's pairs are few, one task goes through the levels after it.

    `ended`: a goes no further from b, though it was not compared with the others of their bucket."""
    ended = (F.size("residues") == 0).alias("ended")
    out, level = [seen.filter("maybe").select("a", "b", ended)], 1
    rest = seen.select("a", "b", F.explode("residues").alias("x"))
    while True:
        buckets = rest.select("a", F.xxhash64("b", "x").alias("key"))
        first = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("b")).filter("n > 1")
        first = saved(first)
        of = first.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.sum(F.col("n") - 1).alias("rows")).first()
        if not of["rows"]:
            return reduce(DataFrame.union, out)
        few = of["rows"] <= FEW_PAIRS
        met = buckets.join(F.broadcast(first) if few else first, "key")
        stars = met.filter(F.col("a") != F.col("b"))
        found = stars.select("a", "b")
        inside = F.lit(True) if of["pairs"] <= LAST_PAIRS else F.col("n") <= small
        all_pairs = bool(small) or of["pairs"] <= LAST_PAIRS
        if all_pairs:
            one = met.filter(inside).select("a", "key")
            pairs = one.join(one.withColumnRenamed("a", "b"), "key").filter(F.col("a") > F.col("b"))
            found = found.union(pairs.select("a", "b"))
        found = saved(found.distinct())
        marks = among(marks, found, few)
        seen = judged(found, marks, similarity, level)
        if all_pairs:  # only from a bucket's first text its members go on
            way = stars.groupBy("a", "b").agg(F.bool_or(~inside).alias("open"))
            seen = seen.join(way, ["a", "b"], "left")
            out.append(seen.filter("maybe").select("a", "b", (ended & F.coalesce("open", F.lit(False))).alias("ended")))
            seen = seen.filter("open IS NOT NULL")
        else:
            out.append(seen.filter("maybe").select("a", "b", ended))
        rest = seen.select("a", "b", F.get("residues", F.lit(0)).alias("x")).filter("x IS NOT NULL")
        level += 1
        if of["rows"] <= LAST_ROWS:
            rows_left = rest.join(marks.withColumnRenamed("id", "a"), "a").select("a", "b", "x", "n", "signature", "sample")
            last = finish_batches(similarity, level, small)
            out.append(rows_left.repartition(1).mapInArrow(last, "a long, b long, ended boolean"))
            return reduce(DataFrame.union, out)


def linked(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Texts (id, text_digest, n, signature) and links (a, b): ids of texts verified as near copies,
    enough of them to connect each class."""
    small_batches(docs.sparkSession)
    d = docs.select(whole().alias("t"))
    d = settled(d.select("t", digest(F.col("t")).alias("text_digest"), words(F.col("t")).alias("w")))
    hashed = d.filter(F.size("w") > 0).select("text_digest", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    made = hashed.mapInArrow(sketch_batches, SKETCHED).groupBy("text_digest")
    made = made.agg(*[F.first(c).alias(c) for c in ("n", "sketches", "signature", "sample")])
    made = saved(made.withColumn("id", F.monotonically_increasing_id()))
    found = bounded(stars(made.select(F.col("id").alias("a"), F.explode("sketches").alias("key"))))
    marks = made.select("id", "n", "signature", "sample")
    first = judged(found, marks, similarity)
    # all meet by signatures alone; words are read once for the pairs that are left
    maybe = once(meetings(first, marks, similarity))
    ids = maybe.select("a").union(maybe.select("b")).distinct().withColumnRenamed("a", "id")
    needed = bounded(made.join(ids, "id").select("id", F.col("text_digest").alias("of")), FEW)
    # only these texts are cut into words again
    texts = settled(docs.select(whole().alias("t")).select("t", digest(F.col("t")).alias("text_digest")))
    texts = settled(texts.join(needed, F.col("text_digest") == F.col("of")).select("id", words(F.col("t")).alias("w")))
    texts = texts.select("id", F.transform("w", lambda x: F.hash(x)).alias("words"))
    texts = texts.groupBy("id").agg(F.first("words").alias("words"))
    texts = saved(texts)
    links = [saved(verified(maybe.select("a", "b"), texts, similarity))]
    while True:  # a text that ended with a first text which its alignment refuses was compared with no other
        refused = maybe.filter("ended").join(links[-1], ["a", "b"], "left_anti")
        refused = bounded(refused.select("a", "b"), FEW_PAIRS)
        if refused.isEmpty():
            return made, reduce(DataFrame.union, links)
        again = made.select(F.col("id").alias("a"), F.col("sketches").alias("residues")).join(refused, "a")
        again = again.select("a", "b", F.lit(False).alias("maybe"), "residues")
        maybe = once(meetings(again, among(marks, refused, False), similarity, SMALL))
        links.append(saved(verified(maybe.select("a", "b"), texts, similarity)))


def once(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b), a the greater id, once and saved; it is `ended` if it is anywhere."""
    return saved(pairs.groupBy("a", "b").agg(F.max("ended").alias("ended")))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_digest (null without words), class_id (least doc_id), class_size and whether it
    is the row that stays (`first`: least doc_id, then digest): a row a document."""
    made, links = linked(docs, similarity)
    label = made.select("id", F.col("text_digest").alias("node")).join(
        components(links).withColumnRenamed("node", "id"), "id"
    )
    label = label.select("node", F.col("label").cast("string").alias("label"))
    d = docs.select("doc_id", whole().alias("t"))
    d = settled(d.select("doc_id", F.when(F.col("t").rlike(WORD), digest(F.col("t"))).alias("text_digest")))
    texts = d.filter("text_digest IS NOT NULL").groupBy("text_digest").agg(
        F.min(F.struct("doc_id", "text_digest")).alias("low"), F.count("*").alias("n")
    )
    texts = texts.join(label, F.col("text_digest") == F.col("node"), "left").select(
        F.col("text_digest").alias("of"), F.coalesce("label", "text_digest").alias("class"), "low", "n"
    )
    texts = saved(texts)
    sizes = texts.groupBy(F.col("class").alias("c")).agg(F.min("low").alias("least"), F.sum("n").alias("class_size"))
    texts = texts.join(sizes, F.col("class") == F.col("c")).select("of", "least", "class_size")
    alone = F.col("text_digest").isNull()
    return d.join(texts, F.col("text_digest") == F.col("of"), "left").select(
        "doc_id",
        "text_digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | F.struct("doc_id", "text_digest").eqNullSafe(F.col("least"))).alias("first"),
    )


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs per class: that of the least doc_id, then digest, and of repeated rows one.

    What goes is a list of ids and digests, broadcast if it is counted to be short; only
    repeated rows are shuffled with their texts otherwise."""
    c = saved(classes(docs, similarity))
    key = ["doc_id", "text_digest"]
    names = [F.col("doc_id").alias("_id"), F.col("text_digest").alias("_of")]
    gone = bounded(c.filter("NOT first").select(*names).distinct(), FEW)
    twice = c.filter("first AND text_digest IS NOT NULL").groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
    twice = bounded(twice.select(*names), FEW)
    d = rows(docs).select("row", "doc_id", digest(whole()).alias("text_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_digest") == F.col("_of"))
    left = d.join(gone, same, "left_anti")
    once = left.join(twice, same, "left_anti")
    repeated = left.join(twice, same, "left_semi").dropDuplicates(key)
    return once.union(repeated).select("row.*")
