"""Cutting texts and encoding them: against plain versions and the tokenizers' own results."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pricelark.llm import fill_in_middle, token_alignment, word_bpe
from pricelark.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, n long, form string, output string, ids string, key long, pair int, aligned int"
HARD = [
    None, "", " ", " \n\t ", "a", "é", "中文字 🙂🙃 ok", "x" * 3000, "é🙂" * 900, "a <P> b", "<S><M>", "<P", "S><P", "<<P>>"[:2],
    "same words again", "same words again", "İstanbul ΣΑΣ ﬁn ǅ", "<|startoftext|>Hi<|endoftext|> <|endoftext|>", "é क़ \x00\x1c\x85",
    "it's we'll I'D 12345 ½ ٣", "▁ piece", "<s>hi</s> <0x0A>", "  two   spaces\n\n\nlines ", "֘ ࢏ ౜ Ω K", "=" * 700 + " " * 300 + "\t" * 99,
    "word " * 5000,
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(None if i == 4 else i, t, "r", 1, "f", "o", "i", 2, 3, 4) for i, t in enumerate(HARD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def random_text(rnd, letters, most):
    return "".join(rnd.choice(letters) for _ in range(rnd.randrange(most)))


def test_cut_index():
    rnd = random.Random(2)
    for _ in range(200):
        text = random_text(rnd, "ab é中🙂ß\n", 40)
        index = fill_in_middle.CutIndex(np.frombuffer(text.encode(), np.uint8))
        points = np.arange(len(text) + 1)
        places = np.array([len(text[:i].encode()) for i in points])
        assert (index.to_byte(points) == places).all() and (index.to_point(places) == points).all()


def cut(doc_id, text, seed="1", cut_percent=90, spm_percent=20):
    t = text or ""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(said[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut_percent:
        return len(t), "plain", None, None, t
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if h4 % 100 < spm_percent:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.mark.parametrize("options", [{}, {"seed": "x", "cut_percent": 100, "spm_percent": 50}])
def test_fill_in_middle(spark, hard, options):
    docs = [*spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), *hard.select("doc_id", "text").collect()]
    d = fill_in_middle.restored(fill_in_middle.transformed(spark.createDataFrame(docs, "doc_id long, text string"), **options))
    got = [
        (r.row.doc_id, r.row.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored.text, r.restored.prefix_chars, r.restored.middle_chars)
        for r in d.collect()
    ]
    want = [(r.doc_id, r.text, *(c := cut(r.doc_id, r.text, **options)), r.text or "", c[2], c[3]) for r in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_clashing_names_and_empty_tables(hard, none):
    word, a, b = (tokenizer(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    for apply in (
        lambda d: fill_in_middle.restored(fill_in_middle.transformed(d)),
        lambda d: word_bpe.decoded(word_bpe.encoded(d, word), word),
        lambda d: token_alignment.aligned(d, a, b),
    ):
        assert apply(none).collect() == []
        out = apply(hard)
        assert out.select("row.*").columns == hard.columns
        assert sorted(r.row.text or "" for r in out.collect()) == sorted(t or "" for t in HARD)
    assert token_alignment.scored(none, a, b).collect() == []


def test_word_bpe_is_the_tokenizers_own(spark, hard):
    path = tokenizer("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rnd = random.Random(3)
    extra = [random_text(rnd, "ab'sthe  in1!é<|>endoftextÀ́ΣİIﬁ中\x00 🙂", 40) for _ in range(3000)]
    docs = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts = [*docs, *(t for (t,) in hard.select("text").collect()), *extra]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in word_bpe.decoded(word_bpe.encoded(d, path), path).collect():
        want = own.encode(r.row.text or "", add_special_tokens=False).ids
        assert r.ids == want, r.row.text
        assert r.decoded == own.decode(want, skip_special_tokens=False)


def test_words_are_cut_alike():
    """Every character of texts that are not given to the tokenizer's own rules, alone and beside others."""
    v = word_bpe.vocabulary(open(tokenizer("word_bpe_49k.json"), "rb").read())
    points = [chr(c) for c in range(ord(word_bpe.MARKS))]
    texts = [" ".join(f"a{c}b1{c}!{c}{c}" for c in points), *(f"{a}{b}" for a in points[60:260] for b in points[60:260])]
    for text in texts:
        n = v.normalizer.normalize_str(text)
        assert v.split(text) == [n[a:b] for _, (a, b) in v.pre_tokenizer.pre_tokenize_str(n)]
    # only characters whose small letters are further on are left to the tokenizer
    assert v.simple and [c for c in points if v.marked.search(c)] == ["İ", "Ⱥ", "Ⱦ"] and v.marked.search(word_bpe.MARKS)


def test_every_token_stays_whole():
    v = word_bpe.vocabulary(open(tokenizer("word_bpe_49k.json"), "rb").read())
    assert all(v.tokens(t) == [k] for k, t in enumerate(v.texts))


def test_long_words_take_linear_time():
    v = word_bpe.vocabulary(open(tokenizer("word_bpe_49k.json"), "rb").read())
    own = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rnd = random.Random(4)
    for text in ("a" * 300_000, random_text(rnd, "aeint", 300_000)):
        assert np.frombuffer(v.encode(text), np.int32).tolist() == own.encode(text, add_special_tokens=False).ids
    assert all(len(w) <= word_bpe.LONG_WORD for w in v.words)


def plain_groups(one, two, text):
    """Groups by walking both token lists."""
    if not text:
        return []
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    own = word_bpe.byte_characters()
    pieces = [[bytes(own[c] for c in one.id_to_token(i)) for i in a]]
    said = [(two.is_byte(i), two.id_to_piece(i)) for i in b]
    pieces.append([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for byte, p in said])
    if any(b"".join(p) != (" " + text).encode() for p in pieces):
        return []
    groups, i, j, x, y = [], 0, 0, 0, 0
    while i < len(a):
        left, right = [a[i]], [b[j]]
        x, y, i, j = x + len(pieces[0][i]), y + len(pieces[1][j]), i + 1, j + 1
        while x != y:
            if x < y:
                left.append(a[i])
                x, i = x + len(pieces[0][i]), i + 1
            else:
                right.append(b[j])
                y, j = y + len(pieces[1][j]), j + 1
        groups.append((left, right))
    return groups


def written_out(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


@pytest.mark.parametrize("hot, small", [(200_000, 1 << 10), (50, 2), (0, 1 << 10)])
def test_alignment_of_tokens(spark, hard, monkeypatch, hot, small):
    monkeypatch.setattr(token_alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(token_alignment, "SMALL_GROUP", small)  # before workers start: they see it where they fork anew
    a, b = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    one, two = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
    one.encode_special_tokens = True
    texts = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(120).collect()]
    texts += [t for (t,) in hard.select("text").collect()]
    groups = [plain_groups(one, two, t) for t in texts]
    links = [Counter((x, y) for g in gs for x in g[0] for y in g[1]) for gs in groups]
    counts = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in token_alignment.scored(d, a, b).collect()}
    assert len(got) == len(texts)
    for i, (gs, c) in enumerate(zip(groups, links, strict=True)):
        r, said = got[i], written_out(gs)
        assert (r.n_a, r.n_b, r.n_groups) == (sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs))
        assert r.n_links == sum(c.values()) and r.count_sum == sum(counts[p] * n for p, n in c.items())
        assert r.n_best == sum(n for p, n in c.items() if counts[p] == most[p[0]])
        assert r.groups_sha256 == (hashlib.sha256(said.encode()).hexdigest() if said else "")
    if hot == 200_000:
        for r in token_alignment.aligned(d, a, b, (*token_alignment.TOKENS, "groups")).collect():
            gs, x, y = groups[r.row.doc_id], 0, 0
            assert r.groups == written_out(gs)
            for (left, right), p, q in zip(gs, r.a_stops, r.b_stops, strict=True):
                assert (r.a_ids[x:p], r.b_ids[y:q]) == (left, right)
                x, y = p, q


def test_chunks_are_encoded_as_in_their_texts():
    """Lookups of chunks against the libraries on whole texts, with every character that goes that way."""
    rnd = random.Random(6)
    points = [chr(c) for c in range(ord(word_bpe.MARKS))]
    texts = [" ".join(f"a{c}b1{c} {c}!{c}{c}" for c in points), *(f"{a}{b}" for a in points[:200] for b in points[25:130])]
    texts += [random_text(rnd, "ab c  \n\t1.=é'sreßÀ\xa0\x85", 60) for _ in range(3000)] + HARD
    texts = [t for t in texts if t]
    for side in (
        token_alignment.ByteLevel(open(tokenizer("byte_bpe_50k.json"), "rb").read()),
        token_alignment.Pieces(open(tokenizer("piece_bpe_32k.model"), "rb").read()),
    ):
        flat, stops = side.encode(texts)
        want = side.whole(texts)
        assert [x.tolist() for x in np.split(flat, stops[:-1])] == want
        assert all(len(c) <= token_alignment.LONG_CHUNK for c in side.known) and len(side.known) > 100


def test_blocks_without_tokens(spark):
    a, b, word = (tokenizer(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
    rows = [(1, None), (2, ""), (3, "\u2581 piece")]
    for i in range(1, 4):
        d = spark.createDataFrame(rows[:i], "doc_id long, text string").coalesce(1)
        assert [(r.n_a, r.n_links, r.groups_sha256) for r in token_alignment.scored(d, a, b).collect()] == [(0, 0, "")] * i
        got = word_bpe.decoded(word_bpe.encoded(d, word), word).collect()
        assert [r.decoded == "" and r.ids == [] for r in got[:2]] == [True] * min(i, 2)


def test_large_groups():
    """Groups of many tokens give the links that writing them out gives."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 260)
    block = token_alignment.Block(a, b, *(np.array(x) for x in ([120, 120, 300], [100, 100, 260], [2, 120, 300], [99, 100, 260])))
    want = defaultdict(Counter)
    for text, (i, j, k, m) in zip((0, 0, 2), ((0, 2, 0, 99), (2, 120, 99, 100), (120, 300, 100, 260)), strict=True):
        for x in a[i:j]:
            for y in b[k:m]:
                want[text][int(x) * 10 + int(y)] += 1
    got = defaultdict(dict)
    for text, pair, n in zip(*block.links(10), strict=True):
        got[int(text)][int(pair)] = int(n)
    assert got == want


def test_common_ends():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (np.sort(rng.choice(60, rng.integers(1, 40), replace=False)) for _ in "ab")
        a, b = np.union1d(a, [25, 60]), np.union1d(b, [25, 60])
        begins = np.array([0, np.searchsorted(a, 25) + 1])
        got = token_alignment.common_ends(a, b, begins, np.array([begins[1], len(a)]))
        assert (a[got] == np.intersect1d(a, b)).all()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_word_bpe", "op13_token_alignment"])
def test_queries_agree_with_the_operators(spark, name):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    own = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for r in rows:
        text = docs[r.doc_id]
        if name == "op11_fill_in_middle":
            n, form, prefix, middle, output = cut(r.doc_id, text)
            assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
            assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(text))
        elif name == "op12_word_bpe":
            ids = own.encode(text, add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
            assert r.decoded_sha256 == sha(own.decode(ids, skip_special_tokens=False))
        else:
            assert r.n_groups <= min(r.n_a, r.n_b) <= r.n_links or not text
