"""Operators that SQL cannot say, against plain versions over the smallest tables."""

import glob
import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricelark.llm import backoff_scores, components, line_dedup, near_copies, pseudonyms, quality_gam, toxic_crf
from pricelark.llm.text import saved

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rnd, a):
    b = list(a)
    for _ in range(rnd.randrange(0, 9)):
        k = rnd.randrange(3)
        if k == 0 and b:
            b[rnd.randrange(len(b))] = rnd.randrange(6)
        elif k == 1 and b:
            del b[rnd.randrange(len(b))]
        else:
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(6))
    return b


def test_alignment():
    rnd = random.Random(1)
    a = [[rnd.randrange(6) for _ in range(rnd.randrange(0, 40))] for _ in range(200)]
    b = [edited(rnd, x) for x in a]
    true = np.array([distance(x, y) for x, y in zip(a, b, strict=True)])
    a, b = [np.array(x, np.int64) for x in a], [np.array(x, np.int64) for x in b]
    for half in (3, 8, 40):
        got = near_copies.distances(a, b, half)
        assert (got[true <= half] == true[true <= half]).all() and (got >= true).all()
    limit = [math.floor(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    assert (near_copies.similar(a, b, 0.8) == (true <= limit)).all()


def test_near_copies_recall(docs, texts):
    """Every pair of five-word similarity 0.8 is in one class; classes hold texts linked by alignment."""
    got = {r.doc_id: r.class_id for r in near_copies.classes(docs).collect()}
    words = {i: WORDS.findall(t) for i, t in texts.items()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in words.items() if w}
    ids = sorted(grams)
    pairs = [
        (i, j)
        for n, i in enumerate(ids)
        for j in ids[n + 1 :]
        if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])
    ]
    assert pairs and all(got[i] == got[j] for i, j in pairs)
    for i in ids:
        j = got[i]
        if i != j:  # whoever is in a class shares much with a member of it
            others = [k for k in ids if got[k] == j and k != i]
            assert any(len(grams[i] & grams[k]) > 0.2 * min(len(grams[i]), len(grams[k])) for k in others)


def test_near_copies_scattered_edits(spark):
    """Pairs of edit similarity 0.8 and 0.9 whose edits are scattered, short texts included."""
    rnd = random.Random(5)
    rows, kinds = [], {}
    for n in (5, 10, 20, 50, 300):
        for similarity in (0.8, 0.9):
            for _ in range(40):
                a = [f"w{rnd.randrange(20_000)}" for _ in range(n)]
                b = list(a)
                for place in rnd.sample(range(n), int((1 - similarity) * n + 1e-9)):
                    b[place] = f"x{rnd.randrange(1 << 40)}"
                kinds.setdefault((n, similarity), []).append(len(rows))
                rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {r.doc_id: r.class_id for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {k: sum(got[i] == got[i + 1] for i in ids) / len(ids) for k, ids in kinds.items()}
    assert min(recall.values()) >= 0.95 and sum(recall.values()) / len(recall) >= 0.985, recall
    assert all(got[i] in (i, i - 1) for i in got)  # no class beyond the pair


def test_refused_members_meet(spark):
    """Texts that the first one of their bucket refuses are compared with one another."""
    tails = [" ".join(f"t{k}v{i}" for i in range(60)) for k in range(40)]
    rows = [(k, "same few words here " * 3 + t) for k, t in enumerate(tails)]
    rows += [(100 + k, t.replace("v30", "changed")) for k, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.class_id for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == got[100 + k] == k for k in range(40))


def test_boilerplate_hides_no_partner(spark):
    """300 pairs of similarity 0.81 among texts that all share 75 of their 100 words."""
    rnd = random.Random(8)
    shared = [f"b{i}" for i in range(75)]
    rows = []
    for _ in range(300):
        own = [f"w{rnd.randrange(20_000)}" for _ in range(25)]
        other = list(own)
        for place in rnd.sample(range(25), 19):
            other[place] = f"w{rnd.randrange(20_000)}"
        rows += [(len(rows) + k, " ".join(shared + x)) for k, x in enumerate((own, other))]
    got = {r.doc_id: r.class_id for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 600, 2)) >= 0.9 * 300
    assert all(got[i] in (i, i - 1) for i in got)  # the words of one pair do not link it to another


def test_texts_that_share_buckets_are_one_pair(spark):
    """Two texts that meet in many buckets are judged once, so rows grow with pairs, not with buckets."""
    buckets = spark.createDataFrame([(a, key) for key in range(9) for a in (1, 2, 3)], "a long, key long")
    assert sorted(map(tuple, near_copies.stars(buckets).collect())) == [(2, 1), (3, 1)]


def test_signatures_refuse_no_similar_pair():
    rnd = random.Random(9)
    a = [[rnd.randrange(50) for _ in range(rnd.randrange(1, 300))] for _ in range(400)]
    b = [edited(rnd, x) or [1] for x in a]
    a, b = a + [[7] * 2000, [7] * 2000], b + [[7] * 1900, [8] * 2000]
    long = [rnd.randrange(5000) for _ in range(3000)]
    a, b = a + [long, long, long], b + [long[:2500], long[400:] + [7] * 300, [rnd.randrange(5000, 9999) for _ in range(3000)]]
    sizes = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flat = [np.concatenate([np.array(x, np.uint64) for x in y]) for y in (a, b)]
    marks = [near_copies.signatures(f, n) for f, n in zip(flat, sizes, strict=True)]
    few = [near_copies.samples(f, n) for f, n in zip(flat, sizes, strict=True)]
    batch = pa.RecordBatch.from_pydict(
        {"a": range(len(a)), "b": range(len(a)), "na": sizes[0], "nb": sizes[1],
         "sa": marks[0], "sb": marks[1],
         "wa": [m.tobytes() for m in few[0]], "wb": [m.tobytes() for m in few[1]]}
    )
    got = next(near_copies.judge_batches(0.8, 0)(iter([batch])))
    maybe = np.asarray(got.column("maybe"))
    true = near_copies.similar([np.array(x) for x in a], [np.array(x) for x in b], 0.8)
    assert (maybe | ~true).all() and maybe[-5:].tolist() == [True, False, True, True, False]


@pytest.mark.parametrize("common", [1 << 18, 50])
def test_backoff(docs, texts, common, monkeypatch):
    monkeypatch.setattr(backoff_scores, "COMMON", common)
    words = {i: WORDS.findall(t.lower()) for i, t in texts.items()}
    n, follow, pairs = Counter(), Counter(), Counter()
    for w in words.values():
        n.update(w)
        follow.update(w[:-1])
        pairs.update(zip(w, w[1:], strict=False))
    total = sum(n.values())
    got = {r.doc_id: r for r in backoff_scores.scores(docs).collect()}
    for i, w in words.items():
        own, score, seen = Counter(zip(w, w[1:], strict=False)), 0.0, 0
        for b, c in zip(w, w[1:], strict=False):
            rest = pairs[b, c] - own[b, c]
            seen += rest > 0
            score += math.log(rest / follow[b]) if rest > 0 else math.log(0.4 * n[c] / total)
        assert (got[i].n_words, got[i].n_by_pair) == (len(w), seen)
        assert got[i].sum_log is None if len(w) < 2 else abs(got[i].sum_log - score) <= 1e-9 * abs(score) + 1e-9


def feistel(values, bases, key, kind):
    half = len(values) // 2
    a, b, m, n = values[:half], values[half:], bases[:half], bases[half:]
    for r in range(1, 5):
        said = "|".join([key, kind, str(r), ",".join(map(str, b))])
        stream = hashlib.sha256(said.encode()).hexdigest()
        new = [(v + int(stream[i % 16 * 4 : i % 16 * 4 + 4], 16)) % m[i] for i, v in enumerate(a)]
        a, b, m, n = b, new, n, m
    return a + b


def permuted(text, key, kind):
    size = lambda c: 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1
    zero = lambda c: 48 if c <= "9" else 65 if c <= "Z" else 97
    loose = [c for c in text if size(c) > 1]
    new = iter(feistel([ord(c) - zero(c) for c in loose], [size(c) for c in loose], key, kind))
    return "".join(chr(next(new) + zero(c)) if size(c) > 1 else c for c in text)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark, docs, texts):
    out = {r.doc_id: r for r in pseudonyms.masked(docs, "secret").collect()}
    seen = {}
    for i, r in out.items():
        text = texts[i]
        at = 0
        for f in r.found:
            kind, old, new = f["kind"], f["original"], f["pseudonym"]
            assert old != new and len(old) == len(new) or kind == "ip"
            assert seen.setdefault((kind, old), new) == new
            at = text.index(old, at)
            if kind == "card":
                assert luhn(re.sub(r"\D", "", old)) and luhn(re.sub(r"\D", "", new))
                assert new[:-1] == permuted(old[:-1], "secret", "card")
            elif kind == "ip":
                assert new == ".".join(map(str, feistel([int(x) for x in old.split(".")], [256] * 4, "secret", "ip")))
            elif kind == "email":
                assert new == permuted(old.split("@")[0], "secret", "email") + "@" + old.split("@")[1]
            elif kind == "secret":
                assert new == permuted(old, "secret", "secret")
        assert not r.found and r.text == text or r.found and r.text != text
    assert len({(k, v) for (k, _), v in seen.items()}) == len(seen) > 0


def test_pseudonym_cases(spark):
    text = (
        "card 4111 1111 1111 1111, bad 4111111111111112, ip 10.0.0.255, bad 300.1.1.1, 2024-02-29, bad 2023-02-30, "
        "+1 (988) 555-2485, 212-555-0199, 123-45-6789, a.b@mail.example.com"
    )
    r = pseudonyms.masked(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [f["kind"] for f in r.found] == ["card", "ip", "date", "phone", "phone", "social", "email"]
    for bad in ("4111111111111112", "300.1.1.1", "2023-02-30", "+1 (", "@mail.example.com"):
        assert bad in r.text
    for gone in ("4111 1111 1111 1111", "10.0.0.255", "2024-02-29", "555-2485", "212-555-0199", "123-45-6789", "a.b@"):
        assert gone not in r.text


def test_values_side_by_side(spark):
    text = "4451718024887799 27.65.93.188 4111 1111 1111 1111 123, 3782-822463-10005"
    r = pseudonyms.masked(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(f["kind"], f["original"]) for f in r.found] == [
        ("card", "4451718024887799"),
        ("ip", "27.65.93.188"),
        ("card", "4111 1111 1111 1111"),
        ("card", "3782-822463-10005"),
    ]


def test_chain_marginals():
    """Forward-backward against all paths."""
    rng = np.random.default_rng(0)
    lengths = np.array([4, 0, 1, 6])
    e, moves = rng.normal(size=11), rng.normal(size=(2, 2))
    got, counts = toxic_crf.marginals(e, lengths, moves)
    want, want_counts, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        part, at = e[at : at + n], at + n
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        weight = [
            math.exp(sum(x for x, y in zip(part, p, strict=True) if y) + sum(moves[i, j] for i, j in zip(p, p[1:], strict=False)))
            for p in paths
        ]
        z = sum(weight)
        want += [sum(w for w, p in zip(weight, paths, strict=True) if p[i]) / z for i in range(n)]
        for w, p in zip(weight, paths, strict=True):
            for i, j in zip(p, p[1:], strict=False):
                want_counts[i, j] += w / z
    assert np.allclose(got, want) and np.allclose(counts, want_counts)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for out, label, least in (
        (quality_gam.scored(docs, labels), "quality", 0.9),
        (toxic_crf.scored(docs, labels), "toxic", 0.9),
    ):
        rows = out.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
        assert sum(r.predicted == r[label] for r in rows) >= least * len(rows)
        assert out.count() == docs.count()


def test_training_texts_are_bounded_and_whole(spark, monkeypatch):
    texts = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id, ' '), 10 + id)").alias("text"))
    twice = texts.union(texts.withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.range(1200).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    clash = labels.union(labels.filter("doc_id = 7").withColumn("toxic", F.lit(1)))
    every = toxic_crf.training(twice, clash, 5, 0, 1500).collect()
    assert len({tuple(r.w) for r in every}) == len(every)  # copies once
    assert {r.toxic for r in every if r.doc_id == 7} <= {1}
    monkeypatch.setattr(toxic_crf, "TOKENS", 5_000)
    few = toxic_crf.training(twice, clash, 5, 0, 1500).collect()
    assert 4_700 < sum(len(r.w) for r in few) <= 5_000
    whole = {r.doc_id: list(r.w) for r in every}
    assert all(list(r.w) == whole[r.doc_id] for r in few)


def test_sample_is_as_large_as_it_says(spark):
    """The bound counts documents that have a label, not labels that have no document."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.rand(1).alias("x"))
    for n in (100, 1000, 2900, 5000):
        got = quality_gam.least_hashes(docs, n, docs.count(), ["x"])
        assert got.count() == min(n, 3000) == got.distinct().count()
    used = []
    real = quality_gam.fit
    texts = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"))
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    try:
        quality_gam.fit = lambda x, y: used.append(len(y)) or real(x, y)
        quality_gam.scored(texts, labels, sample=300).count()
    finally:
        quality_gam.fit = real
    assert used == [300]


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and (0, 1) in model.pairs


def test_near_copies_later_levels_read_less(spark, monkeypatch):
    """Of a later level's pairs only their own texts are read, and shuffle files go once a table is stored."""
    rng = np.random.default_rng(3)
    same = [f"s{i}" for i in range(70)]
    texts = [" ".join([*same, *(f"o{i}" for i in rng.choice(60, 30, replace=False))]) for _ in range(120)]
    texts += [" ".join(f"x{i}" for i in rng.choice(5000, 60)) for _ in range(200)]
    read, judged = [], near_copies.judged

    def counted(pairs, marks, similarity, level=0):
        if level:
            ids = pairs.select("a").union(pairs.select("b")).distinct()
            read.append((marks.count(), ids.count()))
        return judged(pairs, marks, similarity, level)

    monkeypatch.setattr(near_copies, "judged", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, _ = near_copies.linked(docs)
    assert made.count() == 320 and read and all(n == m < 200 for n, m in read)


def test_saved_drops_shuffle_files(spark):
    """The shuffle files of a stored table are gone, and the session's own setting is as before."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}

    before = files()
    got = saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before and got.count() == 7


def test_toxic_training_holds_a_block(monkeypatch):
    """Training holds messages of a block of chains, not of all tokens, and blocks change nothing."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 2400, 1000)
    toxic = rng.random(len(lengths)) < 0.3
    w = rng.integers(0, 50_000, lengths.sum()).astype(np.int32)
    hit = np.repeat(toxic, lengths) & (rng.random(len(w)) < 0.01)
    w[hit] = rng.integers(50_000, 50_010, hit.sum())
    s = w // 10
    monkeypatch.setattr(toxic_crf, "EPOCHS", 3)
    tracemalloc.start()
    one = toxic_crf.fit(w, s, lengths, toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(toxic_crf, "BLOCK", 1 << 40)
    two = toxic_crf.fit(w, s, lengths, toxic)
    assert peak < 200e6 and one.words[50_005] > 0
    for x in ("words", "starts", "bias", "moves", "scale"):
        assert np.allclose(getattr(one, x), getattr(two, x), rtol=1e-4, atol=1e-6)


def test_fine_variants_are_those_of_each_run():
    """Runs of a batch are hashed together, with the values that each one has alone."""
    rng = np.random.default_rng(2)
    runs = pd.Series([rng.integers(-(1 << 62), 1 << 62, n) for n in (3, 0, 1, 40, 3)])
    runs[4] = runs[0]
    got = line_dedup.fine_variants.func(runs)
    assert [len(x) for x in got] == [4, 1, 2, 41, 4] and list(got[0]) == list(got[4])
    for i, run in enumerate(runs):
        for j in range(len(run)):  # without word j it is the whole of the shorter run
            short = line_dedup.fine_variants.func(pd.Series([np.delete(run, j)]))[0]
            assert got[i][j + 1] == short[0]


def test_line_dedup_streams_past_hash_tables(spark, monkeypatch):
    """The joins with one row a key do not sort the lines' variants."""
    plans, near_earlier = [], line_dedup.near_earlier

    def seen(found):
        pairs = near_earlier(found)
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return pairs

    monkeypatch.setattr(line_dedup, "near_earlier", seen)
    text = "\n".join(f"one two three four five six seven eight nine ten {i}" for i in range(20))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = line_dedup.counts(docs).first()
    assert (got.n_lines, got.n_near) == (20, 19) and any("ShuffledHashJoin" in p for p in plans)


def marks_of(spark, texts):
    """What near_copies keeps of texts {id: words as numbers}."""
    flat = np.concatenate([np.array(x, np.uint64) for x in texts.values()])
    n = np.array([len(x) for x in texts.values()])
    held = zip(texts, n.tolist(), near_copies.signatures(flat, n), near_copies.samples(flat, n), strict=True)
    rows = [(i, k, bytearray(mark), bytearray(few.tobytes())) for i, k, mark, few in held]
    return spark.createDataFrame(rows, "id long, n int, signature binary, sample binary")


def test_texts_of_two_buckets_meet_later(spark):
    """Two texts that met one first text in different buckets are compared, few as the pairs are."""
    texts = {1: range(1000, 1060), 10: range(60), 11: [*range(59), 99]}
    seen = [(1, 0, False, [5, 6]), (10, 0, False, [5]), (11, 0, False, [6])]
    seen = spark.createDataFrame(seen, "a long, b long, maybe boolean, residues array<long>")
    got = near_copies.meetings(seen, marks_of(spark, texts), 0.8).collect()
    assert {(r.a, r.b) for r in got} == {(11, 10)}


def test_levels_in_one_task_find_the_same(spark, monkeypatch):
    """The levels that one task goes through lose no pair that levels over all tasks find."""
    rnd = random.Random(4)
    texts = {}
    for k in range(60):
        own = [*range(40), *rnd.sample(range(1000, 1200), 20)]
        texts[2 * k], texts[2 * k + 1] = own, [*own[:-1], 5000 + k]
    marks = marks_of(spark, texts)
    seen = [(i, 0, False, rnd.sample(range(4), 2)) for i in texts if i]
    seen = spark.createDataFrame(seen, "a long, b long, maybe boolean, residues array<long>")
    found = {}
    for pairs in (0, 10_000):
        monkeypatch.setattr(near_copies, "LAST_PAIRS", pairs)
        for rows in (-1, 20_000):
            monkeypatch.setattr(near_copies, "LAST_ROWS", rows)
            found[pairs, rows] = {(r.a, r.b) for r in near_copies.meetings(seen, marks, 0.8).collect()}
    assert found[0, -1] == found[0, 20_000] and found[10_000, -1] == found[10_000, 20_000] >= found[0, -1]
    assert len({(2 * k + 1, 2 * k) for k in range(1, 60)} & found[10_000, 20_000]) >= 30


def test_texts_of_the_same_words_in_another_order(spark):
    """Pairs among texts that hold the same words: a first text's signature lets all through, its alignment none."""
    rnd = random.Random(12)
    blocks = [[f"w{b}x{i}" for i in range(60)] for b in range(5)]
    rows = []
    for k, order in enumerate(rnd.sample(list(itertools.permutations(range(5))), 60)):
        text = [w for b in order for w in blocks[b]]
        at = rnd.randrange(299)
        rows += [(k, " ".join(text)), (100 + k, " ".join([*text[:at], text[at + 1], text[at], *text[at + 2 :]]))]
    got = {r.doc_id: r.class_id for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == got[100 + k] for k in range(60))


def test_components_in_one_task(spark, monkeypatch):
    rnd = random.Random(6)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 999 + i) for i in range(60)]
    links = spark.createDataFrame(links, "a long, b long")
    one = {tuple(r) for r in components.components(links).collect()}
    monkeypatch.setattr(components, "FEW_LINKS", -1)
    assert one == {tuple(r) for r in components.components(links).collect()} and max(n for n, _ in one) == 1059
