"""Fill-in-middle transformation: texts cut in three, rearranged so that the middle comes last.

A text is cut at two places drawn from a hash of the seed and the id. Places are code points, while
texts are UTF-8: a sparse index records only the multibyte characters, each with its position and the
bytes that it takes beyond one. A search in that index turns code points into bytes and back; between
two recorded characters bytes and code points go on alike, so ASCII costs nothing but the scan.

Forms: `plain` (the text as it is), `psm` (prefix, suffix, middle) and `spm` (suffix, prefix, middle),
each part behind its sentinel. A null text counts as empty; an empty text, and one that holds a
sentinel, stays plain. A null id counts as the empty text, so rows of equal id are cut at equal draws.
Repeated rows give equal rows; an empty table gives an empty result. The columns of the input are in
the struct `row`, so that their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.llm.arrow import strings, utf8
from pricelark.llm.text import rows

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """Marks before the parts; each must begin with a character that it does not hold again."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def encoded(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


class CutIndex:
    """The multibyte characters of a run of UTF-8 bytes: where they are and what they take beyond one byte."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.point = self.byte - self.excess[:-1]

    def to_byte(self, points: np.ndarray) -> np.ndarray:
        return points + self.excess[np.searchsorted(self.point, points)]

    def to_point(self, places: np.ndarray) -> np.ndarray:
        return places - self.excess[np.searchsorted(self.byte, places)]


def draws(seed: str, doc_id: Column) -> list[Column]:
    """The first four groups of eight hex digits of sha256("seed:id"), as numbers."""
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(said, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _cutter(sentinels: Sentinels, cut_percent: int, spm_percent: int):
    marks = (sentinels.prefix, sentinels.suffix, sentinels.middle)
    p, s, m = sentinels.encoded()

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        data, places = utf8(text)
        index = CutIndex(data)
        first = index.to_point(places)
        n = np.diff(first)
        d1, d2, d3, d4 = (np.asarray(h, np.int64) for h in (h1, h2, h3, h4))
        one, two = d1 % (n + 1), d2 % (n + 1)
        left, right = np.minimum(one, two), np.maximum(one, two)
        plain = (n == 0) | (d3 % 100 >= cut_percent)
        for mark in marks:
            plain |= np.asarray(pc.fill_null(pc.match_substring(text, mark), False))
        spm = d4 % 100 < spm_percent
        to = index.to_byte(first[:-1] + left), index.to_byte(first[:-1] + right)
        held, out = memoryview(data), []
        for i in range(len(n)):
            a, b, c, e = int(places[i]), int(to[0][i]), int(to[1][i]), int(places[i + 1])
            if plain[i]:
                out.append(bytes(held[a:e]))
            elif spm[i]:
                out.append(b"".join((s, held[c:e], p, held[a:b], m, held[b:c])))
            else:
                out.append(b"".join((p, held[a:b], s, held[c:e], m, held[b:c])))
        form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
        return pa.StructArray.from_arrays(
            [
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(left, pa.int64(), mask=plain),
                pa.array(right - left, pa.int64(), mask=plain),
                pa.array(out, pa.binary()).cast(pa.string()),
            ],
            ["n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return cut


def transformed(
    docs: DataFrame,
    seed: str = "1",
    sentinels: Sentinels = Sentinels(),
    cut_percent: int = 90,
    spm_percent: int = 20,
) -> DataFrame:
    """row, n (code points), form, prefix_chars and middle_chars (null if plain), output: a row a document.

    `cut_percent` of the texts are cut at all, `spm_percent` of those come suffix first.
    """
    cut = _cutter(sentinels, cut_percent, spm_percent)
    d = rows(docs).select("row", cut(F.col("text"), *draws(seed, F.col("doc_id"))).alias("fim"))
    return d.select("row", "fim.*")


def _restorer(sentinels: Sentinels):
    p, s, m = sentinels.encoded()

    @F.arrow_udf("text string, prefix_chars long, middle_chars long")
    def restore(output: pa.Array, form: pa.Array) -> pa.Array:
        data, places = utf8(output)
        held, said = data.tobytes(), form.to_pylist()
        out, cuts = [], np.zeros((2, len(said)), np.int64)
        plain = np.array([f not in (PSM, SPM) for f in said], bool)
        for i, f in enumerate(said):
            a, e = int(places[i]), int(places[i + 1])
            if plain[i]:
                out.append(held[a:e])
                continue
            lead, inner = (p, s) if f == PSM else (s, p)
            a += len(lead)
            x = held.index(inner, a, e)
            y = held.index(m, x + len(inner), e)
            one, two, middle = held[a:x], held[x + len(inner) : y], held[y + len(m) : e]
            prefix, suffix = (one, two) if f == PSM else (two, one)
            out.append(prefix + middle + suffix)
            cuts[:, i] = len(prefix), len(prefix) + len(middle)
        size = np.fromiter(map(len, out), np.int64, len(out))
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        whole = b"".join(out)
        index = CutIndex(np.frombuffer(whole, np.uint8))
        first, left, right = (index.to_point(x) for x in (begin[:-1], begin[:-1] + cuts[0], begin[:-1] + cuts[1]))
        return pa.StructArray.from_arrays(
            [
                strings(whole, begin),
                pa.array(left - first, pa.int64(), mask=plain),
                pa.array(right - left, pa.int64(), mask=plain),
            ],
            ["text", "prefix_chars", "middle_chars"],
        )

    return restore


def restored(transformed_docs: DataFrame, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """The same rows with the struct `restored`: text, prefix_chars and middle_chars, from output and form alone."""
    back = _restorer(sentinels)
    return transformed_docs.withColumn("restored", back(F.col("output"), F.col("form")))
