"""LM scoring by stupid backoff, as a join of n-gram counts to the n-grams of every document.

The model is the corpus itself, pairs backing off to single words. A word c after a word b
scores log((n(bc) - own) / n(b.)), where own are the document's own occurrences of the pair and
n(b.) is how often b is followed by a word; if no other occurrence is left it scores
log(BACKOFF * n(c) / N). A document's score is the sum over its words but the first.

Count tables and n-grams meet by hash. Words are 64-bit hashes. Single words are counted by a
plain grouping. Pairs are dealt by the hash of their first word into parts, packed per part and
batch of documents, where one pass counts them, looks the counts up for each document and sums
per document. A first word with more than one in HOT of all words would fill a part, so its
pairs are dealt by both words; its count comes from the table of single words. Counts of the
most frequent words (at most COMMON) go to every task; scores that back off to any other word
are dealt once more, by that word, and meet the rest of the table there.

The parts are as many as spark.sql.shuffle.partitions, and more if a part would hold above
PART_WORDS words otherwise.

Documents of fewer than two words (null and empty texts too) have a null score. Repeated rows
give equal rows, and count as one another's other occurrences do not: their own occurrences are
those of all of them. An empty table gives an empty result. Further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.llm.text import saved, settled, small_batches, whole, words

BACKOFF = 0.4
HOT = 2000
COMMON = 1 << 18
PART_WORDS = 4_000_000  # of a part on average, which a task holds in memory
HOT_BASE = 0xFFFF0000  # first numbers from here on stand for hot words
LOW40 = np.uint64((1 << 40) - 1)
PACKED = "p int, ids array<long>, sizes binary, b binary, c binary, k binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, key (id and text as one hash) and h, the hashes of the lower-cased words."""
    d = docs.select("doc_id", whole().alias("t"))
    d = settled(d.select("doc_id", F.xxhash64("doc_id", "t").alias("key"), words(F.lower("t")).alias("w")))
    return d.select("doc_id", "key", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def word_counts(d: DataFrame) -> DataFrame:
    """h, n (occurrences), f (occurrences that another word follows)."""
    last = F.size("h") - 1
    rows = d.select(F.posexplode("h").alias("i", "word"), last.alias("last"))
    rows = rows.select("word", (F.col("i") < F.col("last")).cast("long").alias("f"))
    return rows.groupBy(F.col("word").alias("h")).agg(F.count("*").alias("n"), F.sum("f").alias("f"))


def to5(c: np.ndarray) -> bytes:
    """The low 40 bits of each number."""
    return c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from5(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def packed(p: np.ndarray, key: np.ndarray, b: np.ndarray, c: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per part from entries sorted by part and document."""
    for part in np.unique(p):
        i, j = np.searchsorted(p, [part, part + 1])
        own = key[i:j]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[new, len(own)])
        row = [
            pa.array([int(part)], pa.int32()),
            pa.array([own[new].view(np.int64)], pa.list_(pa.int64())),
            *[
                pa.array([x], pa.binary())
                for x in (sizes.astype("<u4").tobytes(), b[i:j].astype("<u4").tobytes(), to5(c[i:j]), k[i:j].astype("<u4").tobytes())
            ],
        ]
        yield pa.RecordBatch.from_arrays(row, ["p", "ids", "sizes", "b", "c", "k"])


def pair_batches(parts: int, hot_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_of.value[0]
        for batch in batches:
            lists = batch.column("h")
            offsets = np.asarray(lists.offsets)
            h = np.asarray(lists.values)[offsets[0] : offsets[-1]].view(np.uint64)
            lengths = np.diff(offsets)
            if len(h) < 2:
                continue
            doc = np.repeat(np.arange(len(lengths)), lengths)
            inner = np.flatnonzero(doc[1:] == doc[:-1])
            if not len(inner):
                continue
            doc, b, c = doc[inner], h[inner], h[inner + 1]
            at = np.minimum(np.searchsorted(hot, b), max(len(hot) - 1, 0))
            busy = hot[at] == b if len(hot) else np.zeros(len(b), bool)
            p = (np.where(busy, mix(b ^ mix(c)), mix(b)) % np.uint64(parts)).astype(np.int64)
            number = np.where(busy, HOT_BASE + at, (b >> np.uint64(32)) % np.uint64(HOT_BASE)).astype(np.uint64)
            c = c & LOW40
            first = (p.astype(np.uint64) * np.uint64(len(lengths)) + doc.astype(np.uint64)) << np.uint64(32) | number
            order = np.lexsort((c, first))
            first, c = first[order], c[order]
            new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (c[1:] != c[:-1])])
            k = np.diff(np.r_[new, len(c)])
            keys = np.asarray(batch.column("key")).view(np.uint64)[doc[order][new]]
            yield from packed(p[order][new], keys, number[order][new], c[new], k)

    return run


def joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def sums(parts: int, keys: np.ndarray, doc: np.ndarray, score: np.ndarray, k: np.ndarray, seen: np.ndarray) -> list[pa.RecordBatch]:
    """Per document its sum of scores, the words scored and those of them by pairs; packed, one row
    per part that the documents' keys are dealt to, since each document is met in many parts."""
    ids, at = np.unique(keys, return_inverse=True)
    at = at[doc]
    n, m = np.bincount(at, k, len(ids)), np.bincount(at, k * seen, len(ids))
    s = np.bincount(at, score * k, len(ids))
    to = (mix(ids) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    order = order[n[order] > 0]
    to, ids, s, n, m = to[order], ids[order], s[order], n[order].astype("<u4"), m[order].astype("<u4")
    rows = []
    for part in np.unique(to):
        i, j = np.searchsorted(to, [part, part + 1])
        row = [
            pa.array([int(part)], pa.int32()),
            pa.array([SCORES], pa.int32()),
            pa.array([ids[i:j].view(np.int64)], pa.list_(pa.int64())),
            *[pa.array([x[i:j].tobytes()], pa.binary()) for x in (s, n, m)],
        ]
        rows.append(pa.RecordBatch.from_arrays(row, ["p", "kind", "ids", "b", "c", "k"]))
    return rows


def add_scores(t: pa.Table) -> pa.Table:
    """key, score, n, seen of every document whose key is dealt to this part."""
    keys = np.concatenate([np.asarray(x.values) for x in t.column("ids")])
    s, n, m = (np.frombuffer(joined(t.column(x)), kind) for x, kind in (("b", "<f8"), ("c", "<u4"), ("k", "<u4")))
    ids, at = np.unique(keys, return_inverse=True)
    add = [np.bincount(at, x, len(ids)) for x in (s, n, m)]
    return pa.table({"key": ids, "score": add[0], "n": add[1].astype(np.int64), "seen": add[2].astype(np.int64)})


def entries(t: pa.Table) -> tuple[np.ndarray, ...]:
    """keys of the documents in the rows, and per entry: place of its document, b, c, k."""
    keys = np.concatenate([np.asarray(x.values) for x in t.column("ids")]).view(np.uint64)
    sizes = np.frombuffer(joined(t.column("sizes")), "<u4")
    doc = np.repeat(np.arange(len(keys)), sizes)
    b = np.frombuffer(joined(t.column("b")), "<u4")
    return keys, doc, b, from5(joined(t.column("c"))), np.frombuffer(joined(t.column("k")), "<u4").astype(np.int64)


ENTRIES, COUNTS, SCORES = 0, 1, 2
OUT = "p int, kind int, ids array<long>, sizes binary, b binary, c binary, k binary"


def out_table(rows: list[pa.RecordBatch], kind: int | None = None) -> pa.Table:
    """Rows of one schema: entries that still have to meet a word's count, counts, or scores."""
    kinds = [("p", pa.int32()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64()))]
    kinds += [(x, pa.binary()) for x in ("sizes", "b", "c", "k")]
    schema = pa.schema(kinds)
    tables = []
    for r in rows:
        given = {x: r.column(x) for x in r.schema.names}
        given.setdefault("kind", pa.array([kind] * r.num_rows, pa.int32()))
        tables.append(pa.table([given.get(x, pa.nulls(r.num_rows, t)) for x, t in kinds], schema=schema))
    return pa.concat_tables(tables) if tables else schema.empty_table()


def lookup(table: np.ndarray, counts: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Counts of the words, 0 where the table has none."""
    if not len(table):
        return np.zeros(len(c), np.int64)
    at = np.minimum(np.searchsorted(table, c), len(table) - 1)
    return np.where(table[at] == c, counts[at], 0)


def score_pairs(parts: int, total: int, hot_of):
    def run(t: pa.Table) -> pa.Table:
        _, follows, common, counts = hot_of.value
        keys, doc, b, c, k = entries(t)
        pair = mix(c ^ mix(b.astype(np.uint64) + np.uint64(1)))
        # the same document may be here twice, as repeated rows: its own occurrences are together
        _, same = np.unique(keys, return_inverse=True)
        order = np.lexsort((same[doc], pair))
        a, d = pair[order], same[doc][order]
        new = np.r_[True, a[1:] != a[:-1]]
        newer = new | np.r_[True, d[1:] != d[:-1]]
        n = np.empty(len(k), np.int64)
        n[order] = np.add.reduceat(k[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        own = np.empty(len(k), np.int64)
        own[order] = np.add.reduceat(k[order], np.flatnonzero(newer))[np.cumsum(newer) - 1]
        first, at = np.unique(b, return_inverse=True)
        after = np.bincount(at, k).astype(np.int64)
        busy = first >= HOT_BASE
        after[busy] = follows[(first[busy] - HOT_BASE).astype(np.int64)]
        seen = n > own
        alone = lookup(common, counts, c)
        with np.errstate(divide="ignore"):
            score = np.where(seen, np.log((n - own) / after[at]), np.log(BACKOFF * alone / total))
        left = ~seen & (alone == 0)
        out = [out_table(sums(parts, keys, doc, np.where(left, 0, score), np.where(left, 0, k), seen))]
        if left.any():
            p = (mix(c[left]) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((doc[left], p))
            pick = lambda x: x[left][order]
            out.append(out_table(list(packed(p[order], keys[pick(doc)], pick(b) * 0, pick(c), pick(k))), ENTRIES))
        return pa.concat_tables(out)

    return run


def score_words(parts: int, total: int):
    def run(t: pa.Table) -> pa.Table:
        kind = np.asarray(t.column("kind"))
        rows, words = t.filter(pa.array(kind == ENTRIES)), t.filter(pa.array(kind == COUNTS))
        if not rows.num_rows:
            return out_table([])
        table = from5(joined(words.column("c"))) if words.num_rows else np.empty(0, np.uint64)
        counts = np.frombuffer(joined(words.column("k")), "<i8") if words.num_rows else np.empty(0, np.int64)
        order = np.argsort(table, kind="stable")
        table, first = np.unique(table[order], return_index=True)
        counts = np.add.reduceat(counts[order], first) if len(first) else counts
        keys, doc, _, c, k = entries(rows)
        score = np.log(BACKOFF * np.maximum(lookup(table, counts, c), 1) / total)
        return out_table(sums(parts, keys, doc, score, k, np.zeros(len(k))))

    return run


def word_batches(parts: int):
    """Counts of single words as rows that meet the entries of their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.asarray(batch.column("h")).view(np.uint64) & LOW40
            n = np.asarray(batch.column("n")).astype("<i8")
            p = (mix(c) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            p, c, n = p[order], c[order], n[order]
            for part in np.unique(p):
                i, j = np.searchsorted(p, [part, part + 1])
                row = pa.RecordBatch.from_arrays(
                    [pa.array([int(part)], pa.int32()), pa.array([to5(c[i:j])], pa.binary()), pa.array([n[i:j].tobytes()], pa.binary())],
                    ["p", "c", "k"],
                )
                yield from out_table([row], COUNTS).to_batches()

    return run


def frequent(counts: DataFrame, total: int) -> tuple[np.ndarray, ...]:
    """Hot words (sorted) with how often they are followed, and the common words (40 bits, sorted)
    with their counts: at most HOT and COMMON rows reach the driver."""
    digits = counts.groupBy(F.length(F.bin("n")).alias("d")).count().orderBy(F.col("d").desc()).collect()  # <= 64 rows
    least, room = 1 << 62, COMMON
    for r in digits:
        if r["count"] > room:
            break
        least, room = 1 << (r["d"] - 1), room - r["count"]
    top = counts.filter(F.col("n") >= least).select((F.col("h")).alias("h"), "n").toArrow()
    h, n = np.asarray(top.column("h").combine_chunks()).view(np.uint64), np.asarray(top.column("n").combine_chunks())
    common, first = np.unique(h & LOW40, return_index=True)
    hot = counts.filter(F.col("n") * HOT > total).select("h", "f").toArrow()
    b = np.asarray(hot.column("h").combine_chunks()).view(np.uint64)
    order = np.argsort(b)
    follows = np.asarray(hot.column("f").combine_chunks())
    return b[order], follows[order], common, n[first] if len(first) else n


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_by_pair (words scored by a pair), sum_log and mean_log: a row a document."""
    spark = docs.sparkSession
    small_batches(spark)
    d = hashed(docs)
    counts = saved(word_counts(d))
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_WORDS + 1)
    base = d.select("doc_id", "key", F.size("h").cast("long").alias("n_words"))
    model = spark.sparkContext.broadcast(frequent(counts, max(total, 1)))
    pairs = d.filter(F.size("h") > 1).select("key", "h").mapInArrow(pair_batches(parts, model), PACKED)
    first = saved(pairs.groupBy("p").applyInArrow(score_pairs(parts, max(total, 1), model), OUT))
    least = int(model.value[3].min()) if len(model.value[3]) else 1 << 62
    rare = counts.filter(F.col("n") < least).select("h", "n").mapInArrow(word_batches(parts), OUT)
    open_ = first.filter(F.col("kind") == ENTRIES).unionByName(rare)
    rest = open_.groupBy("p").applyInArrow(score_words(parts, max(total, 1)), OUT)
    got = first.filter(F.col("kind") == SCORES).unionByName(rest).groupBy("p")
    got = got.applyInArrow(add_scores, "key long, score double, n long, seen long")
    got = got.withColumnRenamed("key", "_key")
    share = (F.col("n_words") - 1) / F.col("n")  # below 1 for repeated rows, whose sums are together
    return base.join(got, F.col("key") == F.col("_key"), "left").select(
        "doc_id",
        "n_words",
        F.round(F.coalesce(F.col("seen") * share, F.lit(0.0))).cast("long").alias("n_by_pair"),
        (F.col("score") * share).alias("sum_log"),
        (F.col("score") / F.col("n")).alias("mean_log"),
    )
