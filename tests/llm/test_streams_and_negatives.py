"""Token transducer, periodic runs and hard negatives against the library, brute force and on edge cases."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from conftest import DOCS, EDGE

from starloom.llm import bpe, gnat, periods
from starloom.llm.queries import tokenizer_path, word_tokenizer_path

SIGNS = "abcdehinorstuABΣİß'’!?.,-12³½ \n\t\x0b\x1c\x85\xa0　éé́̈漢字かなガ한국한Жя\U0001d518\U0001f600<|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer_path())
    t.no_truncation()
    t.no_padding()

    def both(text):
        ids = t.encode(text, add_special_tokens=False).ids
        return ids, t.decode(ids, skip_special_tokens=False)

    return both


@pytest.fixture(scope="module")
def machines():
    return bpe.Encoder(word_tokenizer_path()), bpe.Decoder(word_tokenizer_path())


def through(machines, text):
    encoder, decoder = machines
    parts = [np.frombuffer(p, "<u4").tolist() for p in encoder.encode(text.encode())]
    return sum(parts, []), "".join(map(decoder.feed, parts)) + decoder.close()


def test_texts_of_many_scripts_equal_the_library(machines, library):
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(SIGNS) for _ in range(r.randint(0, 40)))
        if r.random() < 0.1:
            t = t[:5] + "<|endoftext|>" + t[5:] + "<|startoftext|>"
        assert through(machines, t) == library(t), repr(t)


def test_words_read_in_pieces_equal_the_library(machines, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 20)
    monkeypatch.setattr(bpe, "PIECE", 16)
    monkeypatch.setattr(bpe, "SLICE", 64)
    r = random.Random(2)
    for _ in range(2500):
        signs = r.choice(["".join(SIGNS.split()), "abth", "aeinrst", "'asrevldm!1", "ab́", SIGNS])
        t = "".join(r.choice(signs) for _ in range(r.randint(0, 200)))
        assert through(machines, t) == library(t), repr(t)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ab" * 50_000 + " x " + "漢" * 50_000, "'s" * 30_000, "é" * 99_999])
def test_very_long_words(machines, library, text):
    assert through(machines, text) == library(text)


@pytest.mark.parametrize("path", [word_tokenizer_path(), tokenizer_path()])
def test_tokens_are_stable_at_the_lookahead(path):
    """However a word is cut, and with the least window that the lookahead allows, its tokens are those of the whole word."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges, r = bpe.Merges(model), random.Random(3)
    words = [w for w in model["vocab"] if w.isascii() and w.isalpha()]
    for _ in range(400):
        word = "".join(r.choice(words) for _ in range(r.randint(100, 500))).encode()
        one, out, at = bpe.Transducer(merges), [], 0
        one.most = merges.lookahead + 16
        while at < len(word):
            n = r.randint(1, 400)
            out += one.feed(word[at : at + n])
            assert len(one.kept) <= one.most
            at += n
        out += one.close()
        assert out == merges.group([*(merges.symbols[b] for b in word[:-1]), merges.lasts[word[-1]]])[0]


def test_sufficient_lookahead_of_a_small_list():
    """Every string over two letters: what lies further from its end than the lookahead keeps its tokens, whatever follows."""
    from itertools import product

    vocab = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    pairs = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "b")]
    for a, b in pairs:
        vocab[a + b] = len(vocab)
    merges = bpe.Merges({"vocab": vocab, "merges": pairs})
    cuts = lambda w: np.cumsum(merges.group([merges.symbols[ord(c)] for c in w])[1]).tolist()
    for w in map("".join, product("ab", repeat=9)):
        for n in range(1, 9):
            stable = [c for c in cuts(w[:n]) if c <= n - merges.lookahead]
            assert stable == [c for c in cuts(w) if c <= n - merges.lookahead]
    with pytest.raises(ValueError):
        bpe.Merges({"vocab": vocab, "merges": [("ab", "a"), ("a", "b")]})


def test_decoder_of_bytes_is_incremental():
    from tokenizers import Tokenizer

    library, decoder, r = Tokenizer.from_file(tokenizer_path()), bpe.Decoder(tokenizer_path()), random.Random(4)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 30))]  # broken characters among them
        assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows_and_edges(spark, documents, library):
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digest(bpe.encode_and_decode(documents(EDGE), word_tokenizer_path())).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in EDGE:
        ids, text = library(t or "")
        want.append((i is not None, i or 0, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(text.encode())))
    assert got == sorted(want)
    assert bpe.encode_and_decode(spark.createDataFrame([], DOCS), word_tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        bpe.Encoder(tokenizer_path())


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, n = i - q, j - i + q
            if j > i and n >= max(24, 3 * q):
                part = words[start : start + n]
                if not any(all(part[x] == part[x - d] for x in range(d, n)) for d in range(1, q)):
                    out.append((start, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_brute_force():
    r, seen = random.Random(3), 0
    for _ in range(250):
        texts = []
        for _ in range(4):
            t = []
            while len(t) < r.choice([0, 20, 60, 150, 300]):
                kind = r.random()
                if kind < 0.3:
                    t += [r.choice("ab").encode() for _ in range(r.randint(1, 12))]
                elif kind < 0.9:
                    unit = [r.choice("abc").encode() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 9, 15, 16, 17, 20, 33]))]
                    t += (unit * r.randint(3, 6))[: r.randint(2, 6) * len(unit)]
                    t = t * r.randint(1, 4) if r.random() < 0.3 else t  # runs of runs
                else:
                    t += [b"w%d" % r.randint(0, 99) for _ in range(r.randint(1, 20))]
            texts.append(t[:700])
        for t, (runs, text) in zip(texts, periods._solve(texts), strict=True):
            want = brute_runs(t)
            assert runs == want and text == collapsed(t, want)
            seen += len(want)
    assert seen > 500


def test_longest_texts_stay_cheap():
    """Words, pairs and Fibonacci strings that recur everywhere open few diagonals."""
    x, y = [b"a"], [b"a", b"b"]
    while len(y) < 50_000:
        x, y = y, y + x
    counts = [len(runs) for runs, _ in periods._solve([[b"w"] * 200_000, ([b"a"] * 100 + [b"b"]) * 500, y])]
    assert counts[0] == 1 and counts[1] == 501 and 0 < counts[2] < len(y)


def test_repeated_documents_and_edges(spark, documents):
    for i in range(200):
        h, w = zlib.crc32(str(i).encode()), [b"%d" % k for k in range(i)]
        got = periods.repeated(w, i)
        if h % 10 or not w:
            assert got == w
        else:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got == [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    rows = [*EDGE, (8, "x y z " * 8), (9, ("a b " * 12 + "c ") * 3 + "\x1c\xa0d")]
    got = sorted(tuple((c is None, c) if c is None else (False, c) for c in x) for x in periods.digest(periods.find_runs(documents(rows), altered=periods.repeated)).collect())
    want, sha = [], lambda b: hashlib.sha256(b).hexdigest()
    for i, t in rows:
        w = (t or "").encode().split()
        w = w if i is None else periods.repeated(w, i)
        runs = [(0, len(w), 1)] if len(w) > 5000 and len(set(w)) == 1 else brute_runs(w)
        best = min(runs, key=lambda q: (-q[1] / q[2], q[0], q[2])) if runs else (None,) * 3
        row = (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(collapsed(w, runs)))
        want.append(tuple((c is None, c) for c in row))
    assert got == sorted(want) and any(x[1][1] for x in want)
    assert periods.digest(periods.find_runs(spark.createDataFrame([], DOCS))).count() == 0


def brute_negatives(rows):
    out = []
    for k, (a_id, a_label, a) in enumerate(rows):
        if a_id % 100:
            continue
        scored = [(-int(np.dot(a, v)), i, label) for j, (i, label, v) in enumerate(rows) if j != k and len(v) == len(a)]
        near = sorted((s, i) for s, i, label in scored if label == a_label)[:5]
        for s, p in near:
            ok = sorted((t, i) for t, i, label in scored if label != a_label and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(a_id, p, rank, i, -s, -t) for rank, (t, i) in enumerate(ok, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["sphere", "clusters", "ties", "hot", "lonely"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(gnat, "DATA_BLOCK", 64)
    monkeypatch.setattr(gnat, "ANCHOR_BLOCK", 3)
    g, n, d = np.random.default_rng(5), 700, 6
    x = g.normal(size=(n, d))
    if kind == "clusters":
        x = g.normal(size=(9, d))[g.integers(0, 9, n)] * 40 + x
    if kind == "ties":
        x = np.round(x)
    if kind == "hot":
        x[: n // 2] = x[0]
    labels = np.zeros(n, int) if kind == "lonely" else g.integers(0, 4, n)
    ids = np.arange(n) * 20 + (0 if kind == "lonely" else np.arange(n) % 3 * 20)  # some vec_ids twice
    rows = [(int(i), int(c), np.floor(v * 16).tolist()) for i, c, v in zip(ids, labels, x, strict=True)]
    rows += [(100, 1, [1.0, 2.0]), (200, 1, [3.0, 2.0]), (201, 2, [1.0, 1.0])]  # another dimension
    table = spark.createDataFrame(rows, "vec_id long, label long, v array<double>")
    got = sorted(tuple(r) for r in gnat.hard_negatives(table.selectExpr("*", "1 AS leaf", "2 AS part"), sample=200, fanout=5).collect())
    assert got == brute_negatives(rows)
    assert kind == "lonely" or got


def test_siblings_are_eliminated_by_their_ranges():
    g = np.random.default_rng(6)
    x = np.floor((g.normal(size=(16, 8)) * 60)[g.integers(0, 16, 4000)] + g.normal(size=(4000, 8)))
    tree = gnat.Tree(x[:300], float((x * x).sum(1).max()), 5, 2)
    leaf, passed = tree.descend(x)
    ranges = {}
    for node, j, d in passed:
        ranges[node, j] = (d.min(0), d.max(0))
    a = x[:50]
    score = a @ x.T
    high = np.sort(score, 1)[:, -5]
    low = high - 50
    visited = {(i, j) for j, mine in tree.wanted(a, low, high, ranges) for i in mine}
    needed = {(i, int(leaf[k])) for i, k in zip(*np.nonzero((score >= low[:, None]) & (score <= high[:, None])), strict=True)}
    assert needed <= visited and len(visited) < 0.5 * 50 * tree.leaves


def test_rows_without_label_vector_or_finite_parts(spark):
    rows = [(7, 9, [1.0, 2.0]), (14, 3, [0.5, -0.001]), (None, 1, [1.0]), (1, None, [1.0]), (2, 1, None), (3, 1, [None, 1.0]), (4, 1, [float("nan")]), (5, 1, [float("inf")]), (6, 1, [])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(tuple(r) for r in gnat.prepared(table).collect()) == [(7, 0, [256.0, 512.0]), (14, 4, [128.0, -1.0])]
    assert gnat.hard_negatives(gnat.prepared(table)).count() == 0 == gnat.hard_negatives(gnat.prepared(table.limit(0))).count()
