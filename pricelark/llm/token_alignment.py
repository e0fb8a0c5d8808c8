"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers' tokens are runs of bytes of the same text. A cut is a byte offset where a token of
either ends; cuts divide the tokens into groups. They are found by divide and conquer: an interval
looks for the common end nearest its middle, going from there to the right and then to the left by
bisecting one tokenizer's ends for the other's, and is halved at it; a half that is known to have no
common end is a leaf group. What was passed over without a cut is not searched again, so every end is
met once. All intervals of a block of texts are halved together.

Two tokens are linked where their byte ranges share a group. The corpus statistics count, for every
pair of ids, the documents that hold it linked, and tell which pairs are the most frequent of their
first id (ties included). They are a grouped count over all documents; back to the documents they come by
a join that broadcasts at most HOT_PAIRS rows, the most frequent pairs, and shuffles only the rare
rest, so that no key of the shuffle is hot.

A text that is null or empty, or whose tokens do not spell it out (the pieces normalise it), has no
tokens: counts of zero. Every row counts as a document, repeated rows too; ids may be null. An empty
table gives an empty result. A long text is one task's work; memory grows with that text. Columns of
the input are in the struct `row`, so that their names cannot clash.

Vocabulary files are read on the driver and broadcast as they are (a few MB, whatever the corpus).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelark.llm.arrow import blocks, utf8
from pricelark.llm.text import rows, saved, written
from pricelark.llm.word_bpe import MARKS, Merges, byte_characters, shipped, spelled_out

#: Bytes of text aligned together, and tokens of one side times the other up to which a group is written out.
BLOCK, SMALL_GROUP = 1 << 21, 1 << 10
#: Pairs whose counts are broadcast.
HOT_PAIRS = 200_000
#: Chunks of text kept with their tokens per worker and tokenizer, and the longest one kept.
KEPT_CHUNKS, LONG_CHUNK = 200_000, 64
#: Fixed value: how byte-level BPE cuts a text before it merges.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|[\s]+(?![^\s])|[\s]+"


def before(stops: np.ndarray) -> np.ndarray:
    """Where each run begins, from where the runs stop."""
    return np.concatenate([np.zeros(1, np.int64), stops])[:-1]


class Side:
    """One tokenizer: ids of texts, and the bytes of every id.

    Neither tokenizer joins bytes across the chunks that ``chunk`` finds in space+text, so a chunk
    is encoded once and then looked up; texts with characters from MARKS on go whole to the library.
    """

    def __init__(self, pieces: list[bytes], chunk: str):
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in pieces])])
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.diff(self.offsets)
        self.chunk, self.marked = re.compile(chunk), re.compile(f"[^\0-{chr(ord(MARKS) - 1)}]")
        self.known: dict[str, bytes] = {}

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens in a row."""
        n = self.size[ids]
        return self.blob[np.repeat(self.offsets[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def chunks(self, text: str) -> list[str]:
        """The chunks of space+text."""
        return self.chunk.findall(" " + text)

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of every space+text by the library."""
        raise NotImplementedError

    def learned(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, packed."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all space+texts in a row, and where each stops; a text that is empty has none."""
        plain = [not self.marked.search(t) for t in texts]
        chunks = [self.chunks(t) if ok and t else [] for t, ok in zip(texts, plain, strict=True)]
        new = list(set().union(*chunks) - self.known.keys())
        self.known.update(zip(new, self.learned(new), strict=True))
        others = iter(self.whole([t for t, ok in zip(texts, plain, strict=True) if not ok]))
        got = [
            b"".join(map(self.known.__getitem__, c)) if ok else packed(next(others))
            for c, ok in zip(chunks, plain, strict=True)
        ]
        full = len(self.known) > KEPT_CHUNKS  # the frequent ones came early
        for c in new:
            if full or len(c) > LONG_CHUNK:
                del self.known[c]
        stops = np.cumsum(np.fromiter(map(len, got), np.int64, len(got))) // 4
        return np.frombuffer(b"".join(got), np.int32).astype(np.int64), stops


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class ByteLevel(Side):
    """Byte-level BPE of a JSON file; strings of special tokens are plain text."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        self.merges = Merges(json.loads(data)["model"])
        own, vocab = byte_characters(), self.tokenizer.get_vocab(with_added_tokens=False)
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(own[c] for c in token)
        super().__init__(pieces, spelled_out(CUT))

    def whole(self, texts: list[str]) -> list[list[int]]:
        spaced = [" " + t for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]

    def learned(self, chunks: list[str]) -> list[bytes]:
        return list(map(self.merges.packed, chunks))


class Pieces(Side):
    """A piece model, which puts a space before a text itself."""

    def __init__(self, data: bytes):
        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=data)
        said = m.id_to_piece(list(range(m.get_piece_size())))
        # spaces stand only at the beginning of pieces, so a run of spaces with what follows it is a chunk
        closed = all("\u2581" not in p.lstrip("\u2581") for p in said)
        super().__init__(
            [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(said)],
            " *[^ ]+| +" if closed else r"(?s).+",
        )
        self.closed = closed

    def chunks(self, text: str) -> list[str]:
        """The chunks without their first space."""
        if self.closed and "  " not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        return [c[1:] for c in super().chunks(text)]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def learned(self, chunks: list[str]) -> list[bytes]:
        alone = [self.model.piece_to_id("\u2581")]  # the model makes nothing of a space before nothing
        return [packed(ids if c else alone) for c, ids in zip(chunks, self.whole(chunks), strict=True)]


@lru_cache(maxsize=4)
def side(kind: str, data: bytes) -> Side:
    """One tokenizer per worker and file."""
    return ByteLevel(data) if kind == "bytes" else Pieces(data)


def common_ends(a: np.ndarray, b: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Indices in `a` of the ends that stand in `b` too, within intervals of `a` from begins to stops - 1.

    `a` and `b` rise; an interval's last end is common and not searched.
    """
    s, e = begins, stops - 1
    found = [e[e >= s]]
    while True:
        more = s < e
        s, e = s[more], e[more]
        if not len(s):
            return np.sort(np.concatenate(found))
        middle = (s + e) // 2
        cut = nearest(a, b, middle, e, 1)
        right = cut < e
        other = np.flatnonzero(~right)
        cut[other] = nearest(a, b, middle[other] - 1, s[other], -1)
        hit = right | (cut >= s)
        found.append(cut[hit])
        # to the left of a cut only what lies before the middle is left, to its right what lies behind the cut;
        # without a common end on the right of the middle nothing is left there
        left_e, right_s = np.where(right, middle, cut), np.where(right, cut + 1, e)
        s, e = np.stack([s, right_s], 1)[hit].ravel(), np.stack([left_e, e], 1)[hit].ravel()


def nearest(a: np.ndarray, b: np.ndarray, at: np.ndarray, bound: np.ndarray, way: int) -> np.ndarray:
    """The first index from `at` on, to the right (way 1) or left (-1), whose end in `a` stands in `b`.

    To the right `bound` is returned where there is none before it; to the left an index below `bound`.
    """
    at = at.copy()
    open_ = np.flatnonzero(at < bound if way > 0 else at >= bound)
    while len(open_):
        x = a[at[open_]]
        if way > 0:
            y = b[np.minimum(np.searchsorted(b, x), len(b) - 1)]
            nxt = np.minimum(np.searchsorted(a, y), bound[open_])
            go = (y != x) & (nxt < bound[open_])
        else:
            k = np.searchsorted(b, x, "right") - 1
            y = np.where(k >= 0, b[k], -1)
            nxt = np.maximum(np.searchsorted(a, y, "right") - 1, bound[open_] - 1)
            go = (y != x) & (nxt >= bound[open_])
        at[open_] = np.where(y != x, nxt, at[open_])
        open_ = open_[go]
    return at


@dataclass
class Block:
    """Aligned texts: token ids of all in a row, where texts stop in them, and where groups stop."""

    a: np.ndarray
    b: np.ndarray
    a_texts: np.ndarray
    b_texts: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray

    @property
    def group_stops(self) -> np.ndarray:
        """Where the groups of every text stop."""
        return np.searchsorted(self.a_groups, self.a_texts, "right")

    def said(self) -> Iterator[bytes]:
        """`a1,a2|b1;a3|b2,b3` of every text: ids in order, groups apart by semicolons."""
        g_a, g_b = self.a_groups, self.b_groups
        begin_a, begin_b = before(g_a), before(g_b)
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[np.arange(len(self.a)) + np.repeat(begin_b, g_a - begin_a)] = self.a
        ids[np.arange(len(self.b)) + np.repeat(g_a, g_b - begin_b)] = self.b
        mark[g_a + begin_b - 1] = ord("|")
        mark[g_a + g_b - 1] = ord(";")
        digits, width = decimals(max(int(ids.max()) if n else 0, 1 << 16))
        shown, wide = digits[ids], width[ids]
        shown[np.arange(n), wide] = mark
        flat = shown[np.arange(shown.shape[1]) <= wide[:, None]].tobytes()
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(wide + 1)])
        stops, held, at = ends[self.a_texts + self.b_texts], memoryview(flat), 0
        for stop in stops:
            yield bytes(held[at : max(stop - 1, at)])
            at = int(stop)

    def links(self, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text and linked id pair: index of the text, a * base + b, how many links; sorted."""
        begin_a, begin_b = before(self.a_groups), before(self.b_groups)
        n_a, n_b = self.a_groups - begin_a, self.b_groups - begin_b
        text = np.searchsorted(self.a_texts, self.a_groups)
        room = np.int64(1) << 31 if base < 1 << 15 else np.int64(1) << 40
        product = n_a * n_b
        small = np.flatnonzero(product <= SMALL_GROUP)
        g = np.repeat(small, product[small])
        r = np.arange(len(g)) - np.repeat(np.cumsum(product[small]) - product[small], product[small])
        key = text[g] * room + self.a[begin_a[g] + r // n_b[g]] * base + self.b[begin_b[g] + r % n_b[g]]
        key, n = np.unique(key, return_counts=True)
        large = np.flatnonzero(product > SMALL_GROUP)
        if len(large):  # ids that come again are counted first, so that only different pairs are written out
            keys, counts = [key], [n]
            for i in large:
                x, n_x = np.unique(self.a[begin_a[i] : self.a_groups[i]], return_counts=True)
                y, n_y = np.unique(self.b[begin_b[i] : self.b_groups[i]], return_counts=True)
                keys.append((text[i] * room + x[:, None] * base + y[None, :]).ravel())
                counts.append((n_x[:, None] * n_y[None, :]).ravel())
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        return key // room, key % room, n


@lru_cache(maxsize=1)
def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers up to `most`, a row each with room for a mark, and their widths."""
    said = [str(i).encode() for i in range(most + 1)]
    wide = len(said[-1]) + 1
    table = np.frombuffer(b"".join(s.ljust(wide) for s in said), np.uint8).reshape(-1, wide)
    return table, np.fromiter(map(len, said), np.int64, len(said))


def aligned_block(texts: list[str], one: Side, two: Side) -> Block:
    """The groups of some texts; those that the tokens do not spell out have none."""
    wanted = [b" " + t.encode() if t else b"" for t in texts]
    size = np.fromiter(map(len, wanted), np.int64, len(wanted))
    good = size > 0
    tokens = []
    for s in (one, two):
        flat, stops = s.encode(texts)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(s.size[flat])])
        good &= np.diff(ends[stops], prepend=0) == size
        tokens.append((flat, stops))
    spelled = b"".join(wanted[i] for i in np.flatnonzero(good))
    for s, (flat, stops) in zip((one, two), tokens, strict=True):
        if s.spelled(kept(flat, stops, good)[0]).tobytes() != spelled:  # of equal lengths, but not all of equal bytes
            for i in np.flatnonzero(good):
                good[i] = s.spelled(flat[stops[i - 1] if i else 0 : stops[i]]).tobytes() == wanted[i]
    (a, a_texts), (b, b_texts) = (kept(*t, good) for t in tokens)
    a_ends, b_ends = np.cumsum(one.size[a]), np.cumsum(two.size[b])
    begins = before(a_texts)
    cuts = common_ends(a_ends, b_ends, begins, a_texts)
    b_cuts = np.searchsorted(b_ends, a_ends[cuts]) + 1
    return Block(a, b, a_texts, b_texts, cuts + 1, b_cuts)


def kept(flat: np.ndarray, stops: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the good texts; the others keep their places without any."""
    if good.all():
        return flat, stops
    n = np.diff(stops, prepend=0)
    return flat[np.repeat(good, n)], np.cumsum(np.where(good, n, 0))


SUMMARY = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long"}
TOKENS = {"a_ids": "array<int>", "b_ids": "array<int>", "a_stops": "array<int>", "b_stops": "array<int>"}


def ragged(values: np.ndarray, stops: np.ndarray, kind: pa.DataType) -> pa.Array:
    places = pa.array(np.concatenate([np.zeros(1, np.int64), stops]), pa.int32())
    return pa.ListArray.from_arrays(places, pa.array(values, kind))


def aligned(docs: DataFrame, a_path: str, b_path: str, outputs: tuple[str, ...] = tuple(TOKENS)) -> DataFrame:
    """row, n_a, n_b, n_groups, n_links and the outputs asked for: a row a document.

    Outputs: a_ids and b_ids (tokens); a_stops and b_stops (the tokens up to the end of each group);
    groups (text as `a1,a2|b1;a3|b2,b3`) and groups_sha256 (its hash; empty without tokens);
    pairs (a * size of the second vocabulary + b, different ones) and pair_links (links of each).
    `a_path` is a byte-level BPE file, `b_path` a piece model, both on the driver.
    """
    spark = docs.sparkSession
    one, two = shipped(spark, a_path), shipped(spark, b_path)
    base = len(side("pieces", two.value).size)
    narrow = len(side("bytes", one.value).size) * base < 1 << 31
    pair = "int" if narrow else "long"
    kinds = TOKENS | {"groups": "string", "groups_sha256": "string", "pairs": f"array<{pair}>", "pair_links": "array<long>"}
    schema = ", ".join(f"{k} {v}" for k, v in {**SUMMARY, **{o: kinds[o] for o in outputs}}.items())

    @F.arrow_udf(schema)
    def align(text: pa.Array) -> pa.Array:
        parts = []
        for run in blocks(text, BLOCK):
            block = aligned_block([t or "" for t in run.to_pylist()], side("bytes", one.value), side("pieces", two.value))
            a0, b0 = (before(x) for x in (block.a_texts, block.b_texts))
            stops = block.group_stops
            groups = np.diff(np.concatenate([np.zeros(1, np.int64), stops]))
            owner, which, links = block.links(base)
            link_stops = np.searchsorted(owner, np.arange(len(run)), "right")
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(links)])
            n_links = np.diff(sums[np.concatenate([np.zeros(1, np.int64), link_stops])])
            group_text = np.repeat(np.arange(len(run)), groups)
            made = {
                "n_a": lambda: pa.array(block.a_texts - a0),
                "n_b": lambda: pa.array(block.b_texts - b0),
                "n_groups": lambda: pa.array(groups),
                "n_links": lambda: pa.array(n_links),
                "a_ids": lambda: ragged(block.a, block.a_texts, pa.int32()),
                "b_ids": lambda: ragged(block.b, block.b_texts, pa.int32()),
                "a_stops": lambda: ragged(block.a_groups - a0[group_text], stops, pa.int32()),
                "b_stops": lambda: ragged(block.b_groups - b0[group_text], stops, pa.int32()),
                "groups": lambda: pa.array([s.decode() for s in block.said()], pa.string()),
                "groups_sha256": lambda: pa.array(
                    [hashlib.sha256(s).hexdigest() if s else "" for s in block.said()], pa.string()
                ),
                "pairs": lambda: ragged(which, link_stops, pa.int32() if narrow else pa.int64()),
                "pair_links": lambda: ragged(links, link_stops, pa.int64()),
            }
            names = [*SUMMARY, *outputs]
            parts.append(pa.StructArray.from_arrays([made[x]() for x in names], names))
        return pa.concat_arrays(parts)

    return rows(docs).select("row", align(F.col("text")).alias("aligned")).select("row", "aligned.*")


def pair_base(b_path: str) -> int:
    """What `pairs` multiplies the first id by."""
    with open(b_path, "rb") as f:
        return len(side("pieces", f.read()).size)


def pair_counts(aligned_docs: DataFrame, base: int) -> DataFrame:
    """pair, n (documents that hold it) and top (whether no pair of its first id has more)."""
    pairs = aligned_docs.select(F.explode("pairs").alias("pair"))
    n = saved(pairs.groupBy("pair").agg(F.count("*").alias("n")))
    first = (F.col("pair").cast("long") / base).cast("long").alias("first")
    most = n.groupBy(first).agg(F.max("n").alias("most"))  # one row a token: bounded by the vocabulary
    return n.select("pair", "n", first).join(F.broadcast(most), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))


def scored(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row's doc_id, the counts of `aligned`, groups_sha256, n_best (links that are their first id's
    most frequent) and count_sum (documents of every link's pair, added up): a row a document."""
    spark: SparkSession = docs.sparkSession
    held = aligned(docs, a_path, b_path, ("groups_sha256", "pairs", "pair_links"))
    d = written(held.select("row.doc_id", F.monotonically_increasing_id().alias("key"), *held.columns[1:]))
    counts = saved(pair_counts(d, pair_base(b_path)))
    sizes = counts.groupBy(F.length(F.bin("n")).alias("d")).count().orderBy(F.col("d").desc()).collect()  # <= 64 rows
    least, room = 1 << 62, HOT_PAIRS
    for r in sizes:
        if r["count"] > room:
            break
        least, room = 1 << (r["d"] - 1), room - r["count"]
    hot, rare = F.broadcast(counts.filter(F.col("n") >= least)), counts.filter(F.col("n") < least)
    links = d.select("key", F.inline(F.arrays_zip("pairs", "pair_links"))).withColumnRenamed("pairs", "pair")
    x = F.col("pair_links")
    sums = [F.sum(F.when(F.col("top"), x)).alias("n_best"), F.sum(F.col("n") * x).alias("count_sum")]
    common = links.join(hot, "pair").groupBy("key").agg(*sums)
    rest = links.join(hot, "pair", "left_anti").join(rare, "pair").groupBy("key").agg(*sums)
    both = common.unionByName(rest).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    d = d.drop("pairs", "pair_links").join(both, "key", "left")
    return d.select(
        "doc_id", *SUMMARY, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
