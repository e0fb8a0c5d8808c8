"""Hard rows for every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricelark.llm import (
    backoff_scores,
    decontaminate,
    license_rules,
    license_scan,
    line_dedup,
    mixing,
    near_copies,
    pseudonyms,
    quality_gam,
    quality_rules,
    toxic_crf,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, _gone int, w int"
PROSE = "the quick brown fox jumps over the lazy dog while eleven grey wolves watch from afar"
LONG = " ".join(f"word{i % 977} more{i % 31} text{i}" for i in range(30_000))
ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, PROSE),
    (5, PROSE + " again"),
    (5, PROSE + " again"),
    (6, PROSE),
    (None, None),
    (None, PROSE + " and one that has no id at all but some more words"),
    (7, LONG),
    (8, LONG.replace("word5 ", "changed ", 1)),
    (9, "é" * 40),
    (10, "short"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", None if t is None else len(t), 7, "x", 1, 2) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i == 4)) for i in range(1, 11)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, "")], "item_id long, text string")


def operators(labels, items):
    return {
        "quality_rules": quality_rules.verdicts,
        "line_dedup": line_dedup.counts,
        "near_copies": near_copies.classes,
        "mixing": mixing.mixed,
        "license_scan": license_scan.scanned,
        "pseudonyms": pseudonyms.masked,
        "backoff_scores": backoff_scores.scores,
        "quality_gam": lambda d: quality_gam.scored(d, labels),
        "toxic_crf": lambda d: toxic_crf.scored(d, labels),
    }


NAMES = [
    "quality_rules", "line_dedup", "near_copies", "mixing", "license_scan", "pseudonyms", "backoff_scores",
    "quality_gam", "toxic_crf",
]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_document(name, docs, labels, items):
    out = operators(labels, items)[name](docs)
    got = out.select("row.doc_id" if name == "mixing" else "doc_id").collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, none, labels, items):
    assert operators(labels, items)[name](none).collect() == []


def test_repeated_rows_agree(docs, labels, items):
    for name in ("quality_rules", "line_dedup", "near_copies", "license_scan", "pseudonyms", "backoff_scores", "quality_gam"):
        got = operators(labels, items)[name](docs).filter("doc_id = 5").collect()
        assert len(got) == 2 and got[0] == got[1], name


def test_empty_labels_and_benchmark(docs, labels, items):
    got = quality_gam.scored(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in got] == [0.5]
    assert all(r.predicted == 0 for r in toxic_crf.scored(docs, labels.limit(0)).collect())
    assert decontaminate.leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.leaks(docs.limit(0), items).collect() == []


def test_leaks(docs, items):
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(4, 1, True), (5, 1, True), (6, 1, True), (None, 1, True)}
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "3", "None", "7", "8", "9", "10"])


def test_reparameterised_question(spark):
    item = "Alice bought 12 apples for 3 dollars each and paid 12 coins to Bob near the old stone bridge"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [
        (1, item.replace("12", "40").replace("3", "7").replace("Bob", "Carl")),
        (2, item.replace("12", "40", 1)),  # the second 12 stays: slots disagree
        (3, "nothing of the kind is to be found in these few words of mine"),
    ]
    got = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.verbatim) for r in got] == [(1, False)]


def test_variants_beside_one_another(spark):
    item = "Alice bought 12 apples for 3 dollars each and paid 12 coins to Bob near the old stone bridge"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other, third = item.replace("12", "40"), item.replace("12", "55").replace("3", "8")
    texts = [
        (1, f"{item}. And then once more. {other}"),
        (2, f"{other} some words between both of them {third}"),
        (3, item.replace("12", "7").replace("3", "7")),  # two new values that happen to be equal
        (4, f"{item} and {item.replace('12', '40', 1)}"),  # a copy beside one whose slots disagree
        (5, item.replace("12", "40", 1)),
    ]
    got = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.verbatim) for r in got) == [(1, True), (2, False), (3, False), (4, True)]


def test_short_and_slot_heavy_items(spark):
    table = "12 km 5 kg 30 % 7 cm 9 mm 44 miles 3 feet 8 hours 21 days 6 weeks"
    items = [(1, "What is the capital of France?"), (2, table), (3, "Paris"), (4, "How many legs have 3 cats?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        (1, "Some quiz says: what is the capital of France? Nobody knew the answer to that one."),
        (2, f"The sheet reads {table} and that is all of it"),
        (3, "The sheet reads " + table.replace("12", "13").replace("30", "31").replace("3 feet", "4 feet").replace("9", "2")),
        (4, "They went to Paris in the spring and stayed for a week or two"),
        (5, "Paris"),
        (6, "Tell me, how many legs have 5 cats? I do not know at all."),
        (7, "what is the capital"),
        (8, "What is the capital of France?"),
    ]
    got = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    found = sorted((r.doc_id, r.item_id, r.verbatim, r.n_matched, r.n_windows) for r in got)
    assert [x[:3] for x in found] == [(1, 1, True), (2, 2, True), (5, 3, True), (6, 4, False), (8, 1, True)]
    assert all(n == m for *_, n, m in found)


def test_stages(spark, docs, none, tmp_path, items):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, none):
        d = start
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, str(tmp_path))
            if name != "mixing":
                assert d.columns == docs.columns, name
            d = d.cache()
            d.count()
        assert d.columns == [*docs.columns, "copies"]
        assert start is docs or d.count() == 0


def test_quality_keeps_prose_and_drops_junk(spark):
    junk = " ".join(f"thing{i}***" for i in range(40))
    shout = " ".join(f"WORD{i}!!" for i in range(40)).replace("1", "I")
    rows = [(i, f"{PROSE} number {i} and so on.") for i in range(30)] + [(100, junk), (101, shout), (102, "a b " * 50)]
    got = {r.doc_id: r.kept for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(30)) and not any(got[i] for i in (100, 101, 102))


def test_near_copies_one_stays(spark, docs):
    got = near_copies.representatives(docs)
    assert got.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in got.collect())
    assert ids == sorted(["1", "2", "3", "4", "None", "7", "9", "10", "None"])


def test_lines_go(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, line + "\n\nshort line"), (2, line.replace("five", "FIVE") + "\nnew words in here"), (3, line), (4, "short lane")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduped(d).collect()}
    assert got == {1: line + "\n\nshort line", 2: "new words in here", 4: "short lane"}
    more = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.n_kept) for r in line_dedup.counts(d).collect()}
    assert more == {1: (2, 0, 0, 2), 2: (2, 0, 1, 1), 3: (1, 1, 0, 0), 4: (1, 0, 0, 1)}


def test_lines_of_a_long_document(spark):
    """A document of 120,000 lines, half of which go: by number, not by searching a list per line."""
    text = "\n".join(f"line {i} of this very long document has some words" if i % 2 else "the same line again" for i in range(120_000))
    d = spark.createDataFrame([(1, text), (2, "the same line again\nand one more")], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in line_dedup.counts(d).collect()}
    left = {r.doc_id: r.text.count("\n") + 1 for r in line_dedup.deduped(d).collect()}
    assert got[1][0] == 120_000 and got[1][1] == 59_999 and got[2] == (2, 1, 0)
    assert left == {1: 120_000 - 59_999 - got[1][2], 2: 1} and time.time() - start < 60


def test_license_suppression(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0; see the Apache License."), (2, "All rights reserved, cc by cc by")]
    got = {r.doc_id: r for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x["label"], x["first"], x["last"]) for x in got[1].detections] == [("apache-2.0", 0, 7), ("apache", 10, 11)]
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 0, 5, "cc-by,reserved")


def spellings(pattern, joined):
    """Plain texts of a rule's pattern: optional parts kept or left out, first or last alternative."""
    pattern = pattern.replace(" ?", "" if joined else " ")
    for first in (0, -1):
        for keep in (True, False):
            text = re.sub(r"\.\{\d+,\d+\}", "some ", pattern).replace("[cs]", "c").replace("[0-9]", "4")
            while "(?:" in text:
                text = re.sub(
                    r"\(\?:([^()]*)\)(\??)", lambda m: m[1].split("|")[first] if keep or not m[2] else "", text, count=1
                )
            text = re.sub(r"(\w)\?", r"\1" if keep else "", text)
            yield " ".join(text.split())


def test_every_rule_fires(spark):
    rules = license_rules.rules()
    cases = [(i, t) for i, (*_, x) in enumerate(rules) for joined in (True, False) for t in spellings(x, joined)]
    fired = set()
    for i, t in cases:
        _, _, keyword, pattern = rules[i]
        wide = "".join(f" {w} " for w in t.split())
        if keyword in f" {t} " and any(s in f" {t} " for s in license_rules.STEMS):
            if re.search(license_scan.widened(pattern), wide):
                fired.add(i)
    left = [rules[i] for i in range(len(rules)) if i not in fired]
    assert all(x.startswith("asl") and k == "apache" for *_, k, x in left), left  # asl counts beside the word apache
    plain = {
        "Code under GPLv2 here": "gpl-2.0",
        "Code under GPL v2 here": "gpl-2.0",
        "Code under GPL-v3 here": "gpl-3.0",
        "Code under LGPLv2.1 here": "lgpl-2.1",
        "Code under AGPLv3 here": "agpl-3.0",
        "For noncommercial use only": "noncommercial",
        "For non-commercial use only": "noncommercial",
        "The beerware license": "beerware",
        "The BigScience OpenRAIL-M license": "openrail",
        "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0",
        "Creative Commons Attribution-NonCommercial": "cc-by-nc",
        "Creative Commons Attribution NoDerivatives 4.0 International": "cc-by-nd-4.0",
    }
    rows = list(enumerate(plain))
    got = {r.doc_id: r.labels for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == plain


def test_mix_near_target(spark):
    rows = [(i, "w " * (1 + i * 37 % 211), f"s{i % 4}") for i in range(4000)]
    d = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = d.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"))
    for r in got.collect():
        assert abs(r.taken / r.target - 1) < 0.02 and r.most <= 2
