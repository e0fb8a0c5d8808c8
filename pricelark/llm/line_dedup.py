"""Line dedup by a deletion-neighbourhood join.

Lines are compared as their words. Two lines are near if one of them follows from the other by
changing, inserting or dropping one word; lines of fewer than MIN_WORDS words are never near. A
line goes if its words stood earlier (by doc_id, then line number), or if a line that it is near
to stood earlier than it first did. Lines without words stay.

All variants of a line with one word deleted are as many as it has words, so they are made in
two steps that lose no pair. First a line is cut into BLOCKS runs of words and gives one hashed
variant per deleted run: the edit lies within some run, so near lines share a variant. Only
lines that share one with another line then give, for the deleted run, its own variants with
one word deleted, hashed with the place. Equal keys are joined through the earliest line of
each key, never pair by pair, so a key of any size costs as many rows as it has lines. Each
line that would go is verified by comparing its words with those of that earlier line.

Null and empty texts have no lines. Lines of equal doc_id and number are not earlier than one
another, so repeated rows stay equal. An empty table gives an empty result. Further columns are
carried untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelark.llm.near_copies import mix
from pricelark.llm.text import bounded, rows, saved, settled, small_batches, whole, words, written

ODD = np.uint64(0x9E3779B97F4A7C15)
MIN_WORDS = 8
BLOCKS = 2
FEW = 200_000  # documents whose keys (two numbers) may be broadcast, counted first
GAPS = "array<struct<start:int,length:int>>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tk (a hash of the text) and t."""
    return settled(docs.select("doc_id", whole().alias("t")).withColumn("tk", F.xxhash64("t")))


def lines(d: DataFrame, wanted: str | None = None) -> DataFrame:
    """One row per line with a word: doc_id, tk, line (from 0) and its words w; only the numbers in
    the array column `wanted`, if given."""
    if wanted:
        d = settled(d.select("doc_id", "tk", wanted, F.split("t", "\n").alias("parts")))
        each = F.transform(wanted, lambda i: F.struct(i.alias("line"), F.get("parts", i).alias("x")))
    else:
        each = F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    d = d.select("doc_id", "tk", F.inline(each))
    return settled(d.select("doc_id", "tk", "line", words(F.col("x")).alias("w"))).filter(F.size("w") > 0)


def identity(w: Column) -> Column:
    """128 bits that stand for the words of a line."""
    return F.unhex(F.md5(F.array_join(w, " ")))


def gaps(w: Column) -> Column:
    """(start, length) of the deleted runs: those of the line as the shorter or an equal one of a
    pair, then as the longer one, cut like a line one word shorter and holding one word more."""
    n = F.size(w)

    def runs(m: Column, more: int) -> Column:
        step = F.ceil(m / BLOCKS).cast("int")
        return F.array(
            *[F.struct((step * j).alias("start"), (F.least(step, m - step * j) + more).alias("length")) for j in range(BLOCKS)]
        ).cast(GAPS)

    none = F.array().cast(GAPS)
    return F.concat(
        F.when(n >= MIN_WORDS, runs(n, 0)).otherwise(none), F.when(n > MIN_WORDS, runs(n - 1, 1)).otherwise(none)
    )


def variant(w: Column, g: Column) -> Column:
    """Hash of the words before and after a gap."""
    return F.xxhash64(F.slice(w, 1, g["start"]), F.lit("|"), F.slice(w, g["start"] + g["length"] + 1, F.size(w)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def fine_variants(runs: pd.Series) -> pd.Series:
    """Hash of each run of word hashes, then its hashes without the first word, the second and so
    on: sums of a hash per word and place, so all of them take time in proportion to the run."""

    lengths = runs.map(len).to_numpy(np.int64)
    if not len(lengths):
        return runs
    ends = np.r_[0, np.cumsum(lengths)]
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)
    w, place = np.concatenate(list(runs)).astype(np.int64).view(np.uint64), at.astype(np.uint64)
    here = mix(w ^ mix(place + ODD))
    moved = mix(w ^ mix(place - np.uint64(1) + ODD))  # one place further to the front
    # sums up to each word over all runs end to end; differences of them are those of one run
    h, m = (np.r_[np.uint64(0), np.cumsum(x)] for x in (here, moved))
    less = (h[:-1] - np.repeat(h[ends[:-1]], lengths)) + (np.repeat(m[ends[1:]], lengths) - m[1:])
    out = np.empty(ends[-1] + len(lengths), np.uint64)
    first = ends[:-1] + np.arange(len(lengths))
    out[first] = h[ends[1:]] - h[ends[:-1]]
    out[np.repeat(first, lengths) + 1 + at] = less
    return pd.Series(np.split(out.view(np.int64), first[1:]), index=runs.index)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one edit apart: behind the first difference they agree."""
    short = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), short - 1), lambda i: F.get(a, i) != F.get(b, i))
    first = F.coalesce(F.get(differ, F.lit(0)), short)

    def rest(x: Column, skip: int) -> Column:
        return F.slice(x, first + 1 + skip, F.size(x))

    return (
        F.when(F.size(a) == F.size(b), rest(a, 1) == rest(b, 1))
        .when(F.abs(F.size(a) - F.size(b)) > 1, False)
        .when(F.size(a) > F.size(b), rest(a, 1) == rest(b, 0))
        .otherwise(rest(a, 0) == rest(b, 1))
    )


def near_earlier(found: DataFrame) -> DataFrame:
    """(id, other) of lines and an earlier line with an equal key; found: id, at, v, f (fine variants)."""
    d = saved(found.select("id", "at", "v", F.posexplode("f").alias("place", "k")))
    whole_run, less = d.filter("place = 0"), d.filter("place > 0")
    first = F.min(F.struct("at", "id")).alias("m")
    # one row a key on the right, so what meets it is streamed past a hash table, not sorted
    twice = less.groupBy("v", "k", "place").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    hits = [
        less.join(twice.hint("shuffle_hash"), ["v", "k", "place"]),  # a word changed
        less.join(whole_run.groupBy("v", "k").agg(first).hint("shuffle_hash"), ["v", "k"]),  # a word more than the earlier line
        whole_run.join(less.groupBy("v", "k").agg(first), ["v", "k"]),  # a word less
    ]
    a, b, c = (h.filter(F.col("m.at") < F.col("at")).select("id", F.col("m.id").alias("other")) for h in hits)
    return a.union(b).union(c).distinct()


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, tk, line, exact, near: one row per line with a word, and one per document with line
    -1 and the rest null. `exact`: its words stood earlier; `near`: near to an earlier line."""
    d = keyed(docs)
    every = lines(d).select(
        "doc_id",
        "tk",
        "line",
        identity(F.col("w")).alias("id"),
        F.transform(gaps(F.col("w")), lambda g: variant(F.col("w"), g)).alias("vs"),
    )
    every = written(every, hashes=True)  # the narrow twin of the texts; they are read again only for lines that may be near
    at = F.struct("doc_id", "line", "tk")
    first = every.groupBy("id").agg(F.min(at).alias("at"), F.first("vs").alias("vs"), F.count("*").alias("n"))
    first = written(first.withColumn("number", F.monotonically_increasing_id()), hashes=True)
    # variants go with the number of their line only
    keys = first.select("number", F.explode(F.array_distinct("vs")).alias("v"))
    shared = keys.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v")
    met = keys.join(shared.hint("shuffle_hash"), "v").groupBy("number").agg(F.collect_set("v").alias("vs"))  # 2 * BLOCKS at most
    met = saved(first.select("number", "id", "at").join(bounded(met, FEW), "number").drop("number"))
    # the words of these lines, from the documents where they stand first
    who = met.groupBy(F.col("at.doc_id").alias("who"), F.col("at.tk").alias("of")).agg(
        F.collect_set("at.line").alias("wanted")
    )
    same = F.col("doc_id").eqNullSafe(F.col("who")) & (F.col("tk") == F.col("of"))
    there = d.join(bounded(who, FEW), same).drop("who", "of")
    texts = lines(there, "wanted").select(identity(F.col("w")).alias("own"), "w")
    texts = met.join(texts, F.col("id") == F.col("own"))
    texts = saved(texts.groupBy("id").agg(F.first("at").alias("at"), F.first("w").alias("w"), F.first("vs").alias("vs")))
    found = settled(texts.select("id", "at", "w", "vs", F.explode(F.array_distinct(gaps(F.col("w")))).alias("g")))
    found = settled(found.withColumn("v", variant(F.col("w"), F.col("g")))).filter(F.array_contains("vs", F.col("v")))
    run = F.transform(F.slice("w", F.col("g.start") + 1, F.col("g.length")), lambda x: F.xxhash64(x))
    small_batches(docs.sparkSession)
    found = found.select("id", "at", "v", fine_variants(run).alias("f"))
    pairs = near_earlier(found)
    pairs = pairs.join(texts.select("id", F.col("w").alias("a")), "id")
    pairs = pairs.join(texts.select(F.col("id").alias("other"), F.col("w").alias("b")), "other")
    close = settled(pairs.select("id", one_edit(F.col("a"), F.col("b")).alias("ok"))).filter("ok").select("id").distinct()
    # lines that stand once and are near to none have nothing to be told
    marks = first.select(F.col("id").alias("of"), F.col("at").alias("first_at"), "n").join(
        close.withColumnRenamed("id", "close"), F.col("of") == F.col("close"), "left"
    )
    marks = bounded(marks.filter("n > 1 OR close IS NOT NULL").select("of", "first_at", "close"), FEW)
    each = every.select("doc_id", "tk", "line", "id").join(marks, F.col("id") == F.col("of"), "left")
    earlier = F.struct("first_at.doc_id", "first_at.line") < F.struct("doc_id", "line")
    exact = F.when(F.col("of").isNull(), False).otherwise(earlier)
    each = each.select("doc_id", "tk", "line", exact.alias("exact"), F.col("close").isNotNull().alias("near"))
    null = F.lit(None).cast("boolean")
    return each.union(d.select("doc_id", "tk", F.lit(-1), null, null))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with words), n_exact, n_near (not exact as well), n_kept: a row a document."""
    d = verdicts(docs).groupBy("doc_id", "tk").agg(
        F.count(F.when(F.col("line") < 0, 1)).alias("rows"),  # how often the document is in the table
        F.count("exact").alias("n_lines"),
        F.count(F.when(F.col("exact"), 1)).alias("n_exact"),
        F.count(F.when(~F.col("exact") & F.col("near"), 1)).alias("n_near"),
    )
    names = ["n_lines", "n_exact", "n_near"]
    d = d.select("doc_id", F.explode(F.sequence(F.lit(1), "rows")), *[F.expr(f"{n} div rows").alias(n) for n in names])
    return d.select("doc_id", *names, (F.col("n_lines") - F.col("n_exact") - F.col("n_near")).alias("n_kept"))


def deduped(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go; one that is left without a word goes as a whole.
    n_chars, if there, follows the text."""
    gone = verdicts(docs).filter("exact OR near").groupBy("doc_id", "tk").agg(F.collect_set("line").alias("_gone"))
    gone = gone.withColumnRenamed("doc_id", "_id").withColumnRenamed("tk", "_tk")
    d = rows(docs).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(whole()) == F.col("_tk")), "left"
    )
    # by number, in time linear in the lines
    some = F.col("_gone").isNotNull()
    d = settled(d.select("row", "_gone", "text", F.when(some, F.split("text", "\n")).alias("parts")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "_gone")
    left = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)
    d = settled(d.select("row", "_gone", text.alias("new")))
    d = d.filter(F.col("_gone").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    follow = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        follow["n_chars"] = F.when(F.col("_gone").isNull(), F.col("row.n_chars")).otherwise(F.length("new"))
    return d.select(*[follow[c].alias(c) if c in follow else F.col(f"row.`{c}`") for c in docs.columns])
