"""Byte-pair encoding of words by backtracking, and decoding.

Exact merges without merging: an Aho-Corasick automaton finds the longest token at every place of a
word; tokens are then taken from the left, the longest first. A token may follow another only if the
merges would not have joined parts of the two earlier, which a table of pairs answers (filled as pairs
come up, by undoing the later merge of the two again and again). If no token fits behind the last one,
that one is given up for a shorter token, and its end is marked, so that no place is tried twice: time
is linear in the length of the word. This holds where every token's own text encodes to that token;
`Vocabulary` leaves out tokens for which it does not.

Texts are brought to their normal form and cut into words by the tokenizer's own rules, special tokens
first. Null texts count as empty and have no tokens; so have texts of white space only. Repeated rows
give equal rows, an empty table an empty result. A long text is one task's work, in linear time. The
columns of the input are in the struct `row`, so that their names cannot clash.

The vocabulary file is read on the driver and broadcast as it is (a few MB, whatever the corpus).
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelark.llm.arrow import strings
from pricelark.llm.text import rows

#: Words kept with their tokens, and pairs kept with their verdict, per worker.
KEPT_WORDS, KEPT_PAIRS, LONG_WORD = 250_000, 500_000, 64
#: Tokens decoded at once.
AT_ONCE = 1 << 18
#: Below the first combining mark every text is in normal form, and classes of characters are settled.
MARKS = "\u0300"
END = 0x100


def byte_characters() -> dict[str, int]:
    """Byte of every character of byte-level token strings: printable bytes stand for themselves,
    the others for 256 and on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def spelled_out(pattern: str) -> str:
    """A pattern with its classes of letters, numbers and spaces, all inside brackets, written out
    for characters below MARKS."""
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        members = "".join(c for c in map(chr, range(ord(MARKS))) if regex.fullmatch(kind, c))
        pattern = pattern.replace(kind, re.escape(members))
    return pattern


class Merges:
    """The tokens of a byte-pair encoding, numbered in the order in which merges make them: single
    bytes first. Texts are strings of one character a byte; where words carry their end, the last
    byte of a word is moved up by END.
    """

    def __init__(self, model: dict):
        own = byte_characters()
        self.suffix = model["end_of_word_suffix"] or ""
        ids = model["vocab"]

        def text(token: str) -> str:
            end = self.suffix and token.endswith(self.suffix) and token != self.suffix
            b = [own[c] for c in (token[: -len(self.suffix)] if end else token)]
            if end:
                b[-1] += END
            return "".join(map(chr, b))

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        single = [t for t in ids if t not in made]
        tokens = [*single, *(a + b for a, b in merges)]
        number = {t: k for k, t in enumerate(tokens)}
        self.ids = [ids[t] for t in tokens]
        self.texts = [text(t) for t in tokens]
        self.size = [len(t) for t in self.texts]
        self.left = [-1] * len(single) + [number[a] for a, _ in merges]
        self.right = [-1] * len(single) + [number[b] for _, b in merges]
        self.merged = {(a, b): k for k, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a >= 0}
        self.pairs: dict[int, bool] = {}
        stays: list[bool] = []
        for k, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            stays.append(a < 0 or (stays[a] and stays[b] and self.apart(a, b, k)))
        at = {t: k for k, t in enumerate(self.texts) if stays[k]}
        self.shorter = [next((at[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in at), -1) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for t, k in at.items():
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()

    def apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge earlier than `limit` joins the end of token a with the beginning of token b."""
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                if self.left[a] < 0:
                    return True
                limit, a = a, self.right[a]
            else:
                if self.left[b] < 0:
                    return True
                limit, b = b + 1, self.left[b]  # of equal merges the left one comes first

    def learn_pair(self, a: int, b: int) -> bool:
        """Whether token b can stand behind token a; kept in the table of pairs."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        good = self.pairs[a * len(self.ids) + b] = self.apart(a, b, len(self.ids))
        return good

    def tokens(self, text: str) -> list[int]:
        """Token numbers of a word: the longest token at every place that may follow, taken back where none may."""
        longest, size, shorter, pairs, base = self.automaton.iter_long, self.size, self.shorter, self.pairs, len(self.ids)
        n, k = len(text), next(longest(text))[1]
        closed, out, at, last = set(), [], 0, -1
        while True:
            while k >= 0:
                if at + size[k] not in closed:
                    good = last < 0 or pairs.get(last * base + k)
                    if good or (good is None and self.learn_pair(last, k)):
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                last, at = k, at + size[k]
                if at == n:
                    return out
                k = next(longest(text, at))[1]
            else:
                closed.add(at)
                k = out.pop()  # its end is closed now, so a shorter one is tried
                at -= size[k]
                last = out[-1] if out else -1

    def packed(self, word: str, end: bool = False) -> bytes:
        """Ids of a word as packed 32-bit numbers."""
        text = word if word.isascii() else word.encode().decode("latin-1")
        if end:
            text = text[:-1] + chr(ord(text[-1]) + END)
        ids = self.ids
        return array("i", [ids[k] for k in self.tokens(text)]).tobytes()


class Vocabulary(Merges):
    """A word tokenizer: the rules that make words of a text, special tokens, and decoding."""

    def __init__(self, data: bytes):
        said = json.loads(data)
        super().__init__(said["model"])
        self.words: dict[str, bytes] = {}

        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        whole = Tokenizer.from_str(data.decode())
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        # on texts without marks the rules only lower letters and turn white space into spaces, which no word holds
        rules = said["normalizer"]["normalizers"]
        self.simple = [r["type"] for r in rules] == ["NFC", "Replace", "Lowercase"] and rules[1]["content"] == " "
        small = [c for c in map(chr, range(ord(MARKS))) if all(x < MARKS for x in c.lower())]
        self.marked = re.compile("[^" + re.escape("".join(small)) + "]")
        pattern = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = re.compile(spelled_out(pattern))

        shown = {**{i: t for t, i in said["model"]["vocab"].items()}, **{i: t for t, i in self.special.items()}}
        pieces = [(shown.get(i, "") + " ").encode() for i in range(max(shown) + 1)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in pieces])])

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.simple and not self.marked.search(text):
            return self.word.findall(text.lower())
        text = self.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit numbers."""
        parts, out = self.special_pattern.split(text) if self.special_pattern else [text], []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part:
                words = self.split(part)
                got = list(map(self.words.get, words))
                if None in got:
                    for j, word in enumerate(words):
                        if got[j] is None:
                            got[j] = self.words.get(word) or self.learn(word)
                out += got
        return b"".join(out)

    def learn(self, word: str) -> bytes:
        got = self.packed(word, bool(self.suffix))
        if len(self.words) < KEPT_WORDS and len(word) <= LONG_WORD:  # the frequent ones come early
            self.words[word] = got
        return got

    def decode(self, ids: np.ndarray, stops: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Texts of runs of ids in a row, run i ending before stops[i]: their bytes and places.

        Tokens lie in one blob, each with a space behind it; the offset table says where.
        """
        size = self.offsets[ids + 1] - self.offsets[ids]
        begins = np.concatenate([np.zeros(1, np.int64), stops])[:-1]
        size[stops[stops > begins] - 1] -= 1  # no space behind the last token
        parts = []
        for i in range(0, len(ids), AT_ONCE):
            n = size[i : i + AT_ONCE]
            start = self.offsets[ids[i : i + AT_ONCE]]
            parts.append(self.blob[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        return b"".join(parts), np.concatenate([np.zeros(1, np.int64), ends[stops]])


@lru_cache(maxsize=2)
def vocabulary(data: bytes) -> Vocabulary:
    """One vocabulary per worker and file."""
    return Vocabulary(data)


def shipped(spark: SparkSession, path: str):
    """The bytes of a vocabulary file, for every worker."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """row and ids (array of int), a row a document; `path` is the vocabulary file on the driver."""
    held = shipped(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        v = vocabulary(held.value)
        got = [v.encode(t) if t else b"" for t in text.to_pylist()]
        stops = np.cumsum([0, *map(len, got)]) // 4
        flat = np.frombuffer(b"".join(got), np.int32)
        return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat, pa.int32()))

    return rows(docs).select("row", ids(F.col("text")).alias("ids"))


def decoded(encoded_docs: DataFrame, path: str) -> DataFrame:
    """The same rows with `decoded`: their tokens as the vocabulary writes them, a space between two."""
    held = shipped(encoded_docs.sparkSession, path)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        flat = np.asarray(ids.flatten()).astype(np.int64)
        size = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
        return strings(*vocabulary(held.value).decode(flat, np.cumsum(size)))

    return encoded_docs.withColumn("decoded", text(F.col("ids")))
