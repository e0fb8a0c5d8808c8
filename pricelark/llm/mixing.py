"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources, in order of their name, null last, weigh 3, 1, 2, repeating, and share
150 % of all words; a target stops at twice its source's words and the excess is shared again
by weight among the rest (water-filling, solved in closed form over one row per source).

Copies: with r = target / words of the source, every document gets floor(r) certain whole
copies. Of the rest, strata (source, size class) each draw a fixed number of documents, so
that the running number over the classes, largest first, follows the fraction r - floor(r).
Within a stratum, documents are ranked by random odds over inclusion odds, where inclusion is
inversely proportional to size, and the first ones get one more copy.

No stratum is ranked in one task: ranks come from counts per bucket of the ranking value
(about BUCKET rows each), and only the one bucket that the cut falls into is sorted.

The random number of a row is a hash of its id and text, so reruns agree, and repeated rows
are taken together or not at all. Null texts have size 0 and are
never taken. An empty table gives an empty result. Further columns are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelark.llm.text import saved, whole, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BUCKET = 1000
SMALL = 50_000  # strata that may be broadcast, counted first
LATE = 0.999999  # the largest inclusion probability that a rank is computed with


def size_class(size: Column) -> Column:
    """Number of binary digits and the two after the first: classes a quarter apart at most."""
    digits = F.bin(size)
    return (F.length(digits) * 8 + F.conv(F.rpad(F.substring(digits, 1, 3), 3, "0"), 2, 10).cast("int")).cast("int")


def uniform(*cols: Column) -> Column:
    """A number strictly between 0 and 1 from the values, 48 bits of their MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 12), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> the same with target; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    d = sizes.withColumn("rank", F.row_number().over(order))
    d = d.withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")))
    d = d.withColumns(
        {"cap": (F.col("source_size") * CAP).cast("double"), "all": F.sum("source_size").over(Window.partitionBy())}
    )
    # sources reach their cap in order of cap / weight; the level is what a unit of weight gets
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    d = d.withColumn("level", (F.col("all") * SHARE - spent) / F.sum("weight").over(after))
    d = d.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    d = d.withColumn("at", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(Window.partitionBy()))
    target = F.least(F.col("cap"), F.col("at.level") * F.col("weight"))
    return d.select("source", "source_size", F.coalesce(target, "cap").alias("target"))


def quotas(strata: DataFrame) -> DataFrame:
    """source, size_class, n_docs, sum_size -> with targets, certain copies and fixed sample sizes.

    One row per source and size class, a few hundred a source at most."""
    goal = targets(strata.groupBy("source").agg(F.sum("sum_size").alias("source_size")))
    d = strata.withColumnRenamed("source", "of").join(goal, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    d = d.withColumn("certain", F.floor(ratio)).withColumn("part", ratio - F.col("certain"))
    upto = Window.partitionBy("source").orderBy(F.col("size_class").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum("n_docs").over(upto)
    return d.withColumn(
        "n_more",
        (F.floor(F.col("part") * seen + 0.5) - F.floor(F.col("part") * (seen - F.col("n_docs")) + 0.5)).cast("long"),
    )


def ranking(size: Column, u: Column) -> Column:
    """Random odds over inclusion odds, brought into (0, 1) without changing the order."""
    p = F.least(
        F.lit(LATE),
        F.col("n_more") * F.col("sum_size").cast("double") / (F.col("n_docs").cast("double") * F.col("n_docs") * size),
    )
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def keyed(docs: DataFrame, seed: str) -> DataFrame:
    """The columns of docs as struct `row`, with source, size, size class and random number."""
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source"),
        F.size(words(whole())).cast("long").alias("size"),
        uniform(F.lit(seed), F.col("doc_id"), whole()).alias("u"),
    )
    return d.withColumn("size_class", F.when(F.col("size") > 0, size_class(F.col("size"))).otherwise(0))


def placed(d: DataFrame, strata: DataFrame) -> DataFrame:
    """Rows with what their stratum says, and their ranking value where the stratum is drawn from."""
    q = strata.withColumnRenamed("source", "of").withColumnRenamed("size_class", "class")
    if q.count() <= SMALL:  # else a shuffle on both sides
        q = F.broadcast(q)
    d = d.join(q, F.col("source").eqNullSafe(F.col("of")) & (F.col("size_class") == F.col("class"))).drop("of", "class")
    drawn = (F.col("n_more") > 0) & (F.col("n_more") < F.col("n_docs")) & (F.col("size") > 0)
    return d.withColumn("v", F.when(drawn, ranking(F.col("size"), F.col("u"))))


def cuts(narrow: DataFrame) -> DataFrame:
    """The strata with `last`: the greatest (v, doc_id, size) that is taken, null if not drawn from."""
    strata = saved(
        quotas(narrow.groupBy("source", "size_class").agg(F.count("*").alias("n_docs"), F.sum("size").alias("sum_size")))
    )
    d = placed(narrow, strata).filter("v IS NOT NULL")
    d = d.withColumn("bucket", F.floor(F.col("v") * F.ceil(F.col("n_docs") / BUCKET)))
    counts = d.groupBy("source", "size_class", "bucket").agg(F.count("*").alias("n"), F.first("n_more").alias("wanted"))
    w = Window.partitionBy("source", "size_class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("left", F.col("wanted") - F.coalesce(F.sum("n").over(w), F.lit(0)))
    edges = counts.filter("left > 0 AND left <= n").select(
        F.col("source").alias("of"), F.col("size_class").alias("class"), F.col("bucket").alias("edge"), "left"
    )
    same = (
        F.col("source").eqNullSafe(F.col("of"))
        & (F.col("size_class") == F.col("class"))
        & (F.col("bucket") == F.col("edge"))
    )
    place = F.struct("v", "doc_id", "size")
    nth = F.row_number().over(Window.partitionBy("of", "class").orderBy(place))
    last = d.join(edges, same).withColumn("nth", nth).filter("nth = left").select("of", "class", place.alias("last"))
    return strata.join(
        last, F.col("source").eqNullSafe(F.col("of")) & (F.col("size_class") == F.col("class")), "left"
    ).drop("of", "class")


def mixed(docs: DataFrame, seed: str = "mix", texts: bool = True) -> DataFrame:
    """Every row of docs as struct `row`, with size, source_size, target and copies.

    The texts are read once for a narrow table that all counts come from and, if `texts`, once
    more for the result; they are never shuffled. Without, `row` has only doc_id.
    """
    narrow = saved(keyed(docs, seed).select(F.struct("row.doc_id").alias("row"), "row.doc_id", "source", "size", "size_class", "u"))
    strata = saved(cuts(narrow))
    d = placed(keyed(docs, seed) if texts else narrow.drop("doc_id"), strata)
    more = F.when(F.col("v").isNull(), F.col("n_more") >= F.col("n_docs")).otherwise(
        F.struct("v", F.col("row.doc_id").alias("doc_id"), "size") <= F.col("last")
    )
    copies = F.when(F.col("size") > 0, F.col("certain") + more.cast("int")).otherwise(0).cast("int")
    return d.select("row", "source", "size", "source_size", "target", copies.alias("copies"))


def sample(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it was taken."""
    d = mixed(docs, seed).filter("copies > 0")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
