"""Benchmark decontamination by templates.

Texts and benchmark items become template tokens: lower-cased words, where numbers, units after
numbers and capitalised words within a sentence are typed placeholders that keep their value
aside. Windows of WINDOW template tokens are hash-joined: by template if at least LITERAL of
them are words, and with their values if not. Items of LITERAL to WINDOW - 1 tokens are one
window of their own length, joined to the documents' windows of that length. An
item leaks into a document when windows matched cover at least `share` of the item's windows,
where only occurrences count whose slots are consistent: equal values of the item stand for
equal values of the document. An occurrence is what matched at one distance between the place
in the document and that in the item, so other variants of the item in the same document do
not matter. So a question with other numbers or names is found too.

Before the join, each document keeps only windows whose first and last pair of tokens occur in
the benchmark, by a table of FLAGS bits: that loses no match and leaves few rows to explode.

Items of fewer than LITERAL tokens match only texts that consist of them. Null and empty texts
match nothing; repeated rows each give their own result; empty tables give an empty result.
Rows are known by doc_id and a digest of the text. Further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.llm.text import bounded, digest, rows, settled, whole

WINDOW = 8
LITERAL = 4
SHARE = 0.3
FLAGS = 1 << 16

NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"  # private-use characters
UNITS = (
    "km|cm|mm|kg|mg|ml|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|inch(?:es)?|meters?|metres?"
    "|kilometers?|grams?|kilograms?|liters?|litres?|pounds?|dollars?|euros?|cents?|percent|degrees?"
)
# (pattern, replacement, only in texts with a digit); a value follows its placeholder
STEPS = [
    (r"([\p{Ll},] )(\p{Lu}\p{L}+)", rf"$1{NAME}$2", False),
    (r"([0-9]) ?(%|€|£|\$)", rf"$1 {UNIT}$2 ", True),
    (rf"([0-9]) ?((?i:{UNITS}))([^\p{{L}}\p{{N}}]|$)", rf"$1 {UNIT}$2$3", True),
    (r"(\$|€|£)([0-9])", rf" {UNIT}$1 $2", True),
    (r"([0-9]+)(?:[.,]([0-9]+))?(?:[.,]([0-9]+))?", rf" {NUMBER}$1_$2_$3 ", True),
]
BREAK = rf"[^\p{{L}}\p{{M}}\p{{N}}_%€£$ {NUMBER}-{NAME}]+| +"


def tagged(text: Column) -> Column:
    """The lower-cased tokens of a text; slots are their placeholder followed by the value."""
    digits = text.rlike("[0-9]")
    for pattern, into, numeric in STEPS:
        done = F.regexp_replace(text, pattern, into)
        text = F.when(digits, done).otherwise(text) if numeric else done
    return F.filter(F.split(F.lower(text), rf"(?:{BREAK})+"), lambda x: x != "")


def template(tokens: Column) -> Column:
    """The tokens without the values."""
    first = lambda x: F.substring(x, 1, 1)
    slot = lambda x: first(x).isin(NUMBER, UNIT, NAME)
    return F.transform(tokens, lambda x: F.when(slot(x), first(x)).otherwise(x))


def tokens(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """w: tagged tokens, padded to a window if shorter but not empty; v: their template; n: how many tokens."""
    df = df.withColumn("w", tagged(text)).withColumn("n", F.size("w"))
    short = (F.size("w") > 0) & (F.size("w") < WINDOW)
    df = df.withColumn("w", F.when(short, F.concat("w", F.array_repeat(F.lit(""), WINDOW))).otherwise(F.col("w")))
    df = df.withColumn("w", F.when(F.get("w", F.lit(WINDOW - 1)) == "", F.slice("w", 1, WINDOW)).otherwise(F.col("w")))
    slots = F.exists("w", lambda x: F.substring(x, 1, 1).isin(NUMBER, UNIT, NAME))
    return settled(df.select(*keep, "w", "n")).withColumn("v", F.when(slots, template(F.col("w"))).otherwise(F.col("w")))


def windows(df: DataFrame, places: Column, *keep: str) -> DataFrame:
    """One row per place (pos, length): the hash of the window, its slots with their values and
    whether it is joined by template (`loose`)."""

    def one(x: Column) -> Column:
        i, n = x["pos"], x["length"]
        own = F.slice("w", i + 1, n)
        slots = F.filter(own, lambda x: F.substring(x, 1, 1).isin(NUMBER, UNIT, NAME))
        loose = F.size(slots) <= n - LITERAL
        h = F.when(loose, F.xxhash64(F.slice("v", i + 1, n))).otherwise(F.xxhash64(own))
        return F.struct(i.alias("pos"), n.alias("length"), h.alias("h"), slots.alias("slots"), loose.alias("loose"))

    return df.select(*keep, F.explode(F.transform(places, one)).alias("x")).select(*keep, "x.*")


def place(i: Column, length: Column) -> Column:
    return F.struct(i.cast("int").alias("pos"), length.cast("int").alias("length"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n_windows, n_loose, pos, length, h, slots, loose, ends: the windows of every item."""
    d = tokens(benchmark.select("item_id", whole().alias("t")), F.col("t"), "item_id")
    length = F.when((F.col("n") >= LITERAL) & (F.col("n") < WINDOW), F.col("n")).otherwise(F.lit(WINDOW))
    last = F.size("v") - WINDOW  # 0 for a shorter item, which is padded
    some = F.transform(F.sequence(F.lit(0), last), lambda i: place(i, length))
    none = F.array().cast("array<struct<pos:int,length:int>>")
    d = d.withColumn("places", F.when(last >= 0, some).otherwise(none))
    w = windows(d, F.col("places"), "item_id", "v")
    ends = F.array(pair(F.col("v"), F.col("pos")), pair(F.col("v"), F.col("pos") + F.col("length") - 2))
    w = w.select("item_id", "pos", "length", "h", "slots", "loose", ends.alias("ends"))
    n = w.groupBy(F.col("item_id").alias("id")).agg(
        F.countDistinct("h").alias("n_windows"), F.countDistinct(F.when(F.col("loose"), F.col("h"))).alias("n_loose")
    )
    return w.join(n, F.col("item_id").eqNullSafe(F.col("id"))).drop("id")


def pair(v: Column, i: Column) -> Column:
    return F.xxhash64(F.get(v, i), F.get(v, i + 1))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_digest, item_id, n_windows, n_loose, pos, h, loose and the slot values of both sides."""
    b = bounded(benchmark_windows(benchmark))
    seen = b.select(F.explode("ends").alias("e")).select(F.pmod("e", F.lit(FLAGS)).alias("e")).distinct().collect()
    lengths = sorted(r["length"] for r in b.select("length").distinct().collect())  # LITERAL to WINDOW at most
    flags = ["0"] * FLAGS  # at most FLAGS rows, and from the benchmark only
    for r in seen:
        flags[r["e"]] = "1"
    table = F.split(F.lit(",".join(flags)), ",").cast("array<boolean>")
    d = docs.select("doc_id", whole().alias("t"))
    d = d.withColumn("text_digest", digest(F.col("t")))
    d = tokens(d, F.col("t"), "doc_id", "text_digest")
    flagged = F.transform("v", lambda x, i: F.get(table, F.pmod(F.xxhash64(x, F.get("v", i + 1)), F.lit(FLAGS)).cast("int")))
    d = d.withColumn("f", flagged)

    def flagged_places(n: int) -> Column:
        here = F.transform("f", lambda x, i: F.when(x & F.get("f", i + n - 2), place(i, F.lit(n))))
        return F.filter(here, lambda x: x.isNotNull())

    places = F.concat(F.array().cast("array<struct<pos:int,length:int>>"), *[flagged_places(n) for n in lengths])
    d = windows(d.withColumn("places", places), F.col("places"), "doc_id", "text_digest").withColumnRenamed("pos", "at")
    d = d.withColumnRenamed("slots", "values")
    return d.join(b.drop("ends"), ["h", "length", "loose"])


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, text_digest, item_id, n_matched, n_windows, verbatim, first_token: one row a leak."""
    m = matches(docs, benchmark)
    key = ["doc_id", "text_digest", "item_id"]
    links = F.zip_with("slots", "values", lambda a, b: F.concat_ws("\x1f", a, b))
    side = lambda x, i: F.get(F.split(x, "\x1f"), F.lit(i))
    same = F.forall("links", lambda x: side(x, 0) == side(x, 1))
    consistent = F.size(F.array_distinct(F.transform("links", lambda x: side(x, 0)))) == F.size("links")
    each = m.groupBy(*key, (F.col("at") - F.col("pos")).alias("offset")).agg(
        F.collect_set(F.struct("h", "loose")).alias("hs"),  # as many as the item has windows, at most
        F.first("n_windows").alias("n_windows"),
        F.first("n_loose").alias("n_loose"),
        F.min("at").cast("long").alias("at"),
        # as many values as the item has tokens, at most
        F.array_distinct(F.flatten(F.collect_set(links))).alias("links"),
    )
    each = each.withColumn("copy", same & (F.size("links") > 0))
    # as many windows and values as the document has tokens, at most
    found = each.filter(consistent).groupBy(*key).agg(
        F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"),
        F.first("n_windows").alias("n_windows"),
        F.first("n_loose").alias("n_loose"),
        F.min("at").alias("first_token"),
        F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"),
        F.max("copy").alias("copy"),
    )
    # of several variants, one with the item's own values will do
    verbatim = same | (~consistent & F.col("copy"))
    found = found.withColumn("n_matched", F.size("hs").cast("long"))
    n_loose = F.size(F.filter("hs", lambda x: x["loose"]))
    # other values leave only the windows joined by template
    loose = (n_loose > 0) & (n_loose >= share * F.col("n_loose"))
    return found.filter(loose | (F.col("n_matched") >= share * F.col("n_windows"))).select(
        *key, "n_matched", "n_windows", verbatim.alias("verbatim"), "first_token"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item leaks into, all columns as they were."""
    bad = bounded(leaks(docs, benchmark).select(F.col("text_digest").alias("_bad")).distinct())
    return rows(docs).join(bad, digest(whole()) == F.col("_bad"), "left_anti").select("row.*")
