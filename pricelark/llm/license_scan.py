"""License scan by ordered signature rules.

Texts are lower-cased (A-Z) and cut into words. A text with none of a few stems is done; in
the others, each rule whose keyword occurs is run, and its places are kept as word intervals.
A detection inside another one of a higher priority, or of the same priority and longer (or
equal and of an earlier rule), is suppressed. All of it happens within the row: no shuffle.

Null and empty texts have no words, no labels and score 0. Repeated rows give equal rows; an
empty table an empty result. Further columns are never read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.llm.license_rules import STEMS, rules
from pricelark.llm.text import settled, whole

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
CONFIDENCE = [0.3, 0.6, 0.85, 0.95]  # by priority
BASE_CONFIDENCE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """Words with a space before, between and after them; a text without words is one space."""
    # only these two letters turn into ASCII ones in lower()
    odd = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K"))
    low = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    one = F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(one), F.when(F.trim(one) == "", "").otherwise(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_columns(d: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word and base_labels from t, the spaced words."""
    d = d.withColumn("n_words", (spaces(F.col("t")) - 1).cast("long"))
    first, last, places, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        there = F.contains("t", F.lit(f" {phrase} "))
        before = F.substring(F.col("t"), F.lit(1), F.instr("t", f" {phrase} "))
        backwards = F.reverse("t")
        after = F.substring(backwards, F.lit(1), F.instr(backwards, f" {phrase[::-1]} "))
        n = len(phrase.split())
        first.append(F.when(there, spaces(before) - 1))
        last.append(F.when(there, F.col("n_words") - (spaces(after) - 1) - n))
        places.append(F.when(there, F.regexp_count("t", F.lit(f" {phrase}(?= )"))).otherwise(0))
        labels.append(F.when(there, F.lit(label)))
    return d.withColumns(
        {
            "n_base": sum(places[1:], places[0]).cast("long"),
            "first_word": F.least(*first).cast("long"),
            "last_word": F.greatest(*last).cast("long"),
            "base_list": F.filter(F.array(*labels), lambda x: x.isNotNull()),
        }
    )


def widened(pattern: str) -> str:
    """The pattern over words that each carry a space on both sides; an optional space stays one."""
    return " " + "(?:  )?".join(x.replace(" ", "  ") for x in pattern.split(" ?")) + " "


def rule_table() -> Column:
    """The rules as one constant array; patterns over words that each carry a space on both sides."""
    table = [
        {"id": i, "label": label, "priority": p, "keyword": k, "pattern": widened(x)}
        for i, (label, p, k, x) in enumerate(rules())
    ]
    kind = "array<struct<id:int,label:string,priority:int,keyword:string,pattern:string>>"
    return F.from_json(F.lit(json.dumps(table)), kind)


def spans(wide: Column, rule: Column) -> Column:
    """Where the rule's pattern stands, as structs with first and last word."""
    hits = F.regexp_extract_all(wide, rule["pattern"], F.lit(0))
    pieces = F.split(wide, rule["pattern"], -1)
    count = lambda x: F.floor(spaces(x) / 2).cast("int")
    both = F.zip_with(pieces, hits, lambda p, h: F.struct(count(p).alias("a"), count(h).alias("b")))
    real = F.filter(both, lambda x: x["b"].isNotNull())
    kind = "array<struct<id:int,label:string,priority:int,first:int,last:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["a"]
        found = F.struct(
            rule["id"].alias("id"),
            rule["label"].alias("label"),
            rule["priority"].alias("priority"),
            first.alias("first"),
            (first + x["b"] - 1).alias("last"),
        )
        return F.struct((first + x["b"]).alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    return F.aggregate(real, start, step, lambda acc: acc["out"])


def covers(y: Column, x: Column) -> Column:
    """Whether detection y suppresses x."""
    inside = (y["first"] <= x["first"]) & (y["last"] >= x["last"])
    longer = y["last"] - y["first"] > x["last"] - x["first"]
    same = (y["last"] - y["first"] == x["last"] - x["first"]) & (y["id"] < x["id"])
    return inside & ((y["priority"] > x["priority"]) | ((y["priority"] == x["priority"]) & (longer | same)))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, `detections` that survive, labels and score: one row a document."""
    d = settled(docs.select("doc_id", spaced(whole()).alias("t")))
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains("t", F.lit(stem))
    # two spaces between words, so that neighbouring matches never share one
    wide = F.concat(F.lit(""), F.replace("t", F.lit(" "), F.lit("  ")))
    d = base_columns(d).withColumn("gate", gate)
    d = d.withColumn("wide", F.when(F.col("gate"), F.substring(wide, F.lit(2), F.length(wide) - 2)))
    d = d.withColumn(
        "live", F.when(F.col("gate"), F.filter(rule_table(), lambda r: F.contains(F.col("t"), r["keyword"])))
    ).drop("t")
    d = settled(d)
    none = F.array().cast("array<struct<id:int,label:string,priority:int,first:int,last:int>>")
    found = F.flatten(F.transform("live", lambda r: spans(F.col("wide"), r)))
    d = d.withColumn("found", F.when(F.size("live") > 0, found).otherwise(none)).drop("wide", "live")
    kept = F.filter("found", lambda x: ~F.exists("found", lambda y: covers(y, x)))
    d = settled(d).withColumn("detections", kept).drop("found", "gate")
    own = F.transform("detections", lambda x: x["label"])
    top = F.array_max(F.transform("detections", lambda x: x["priority"]))
    sure = F.when(F.size("detections") > 0, F.get(F.array(*[F.lit(c) for c in CONFIDENCE]), top))
    base = F.when(F.size("base_list") > 0, F.lit(BASE_CONFIDENCE))
    return settled(
        d.withColumns(
            {
                "base_labels": F.array_join(F.array_sort("base_list"), ","),
                "labels": F.array_join(F.array_sort(F.array_distinct(F.concat("base_list", own))), ","),
                "score": F.coalesce(F.greatest(sure, base), F.lit(0.0)),
            }
        ).drop("base_list")
    )
