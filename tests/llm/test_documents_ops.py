"""Operators over documents against brute force, and on edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from conftest import EDGE
from tokenizers import Tokenizer

from starloom.functions.tables import table
from starloom.llm import decontam, licenses, mixing, neardup, sharding, shingles, skew, tokens, toxicity
from starloom.llm.components import connected_components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def prose(r, n, words=None):
    return " ".join(r.choice(words) if words else "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


# --- op1 -------------------------------------------------------------------------------------------


def test_mixing_hits_the_weights_and_repeats(spark, documents):
    r = random.Random(1)
    rows = [(i, prose(r, r.randint(5, 15))) for i in range(4000)]
    docs = documents(rows, source=lambda i: "hot" if i % 3 else f"s{i % 4}")
    targets = spark.createDataFrame([("hot", 1.0), ("s0", 2.0), ("s1", 1.0)], "source string, weight double")
    mixed = mixing.mix(docs, targets)
    got = {x.source: x["sum(b)"] for x in mixed.selectExpr("source", "octet_length(text) + 1 AS b").groupBy("source").sum("b").collect()}
    total = sum(got.values())
    assert set(got) == {"hot", "s0", "s1"}
    for s, w in (("hot", 0.25), ("s0", 0.5), ("s1", 0.25)):
        assert got[s] / total == pytest.approx(w, abs=0.06)
    key = lambda d: sorted(map(tuple, d.select("doc_id", "copy_no", "shuffle_key").collect()))
    assert key(mixed) == key(mixing.mix(docs.repartition(5), targets))


def test_poisson_tables_are_the_distribution(spark):
    rates = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 3.5), ("c", 1, 900.0)], "source string, size long, rate double")
    t = {x.source: x.cdf for x in mixing.poisson_tables(rates).collect()}
    assert set(t["a"]) == {1.0} and t["c"][-1] == pytest.approx(1) and all(a <= b for a, b in zip(t["c"], t["c"][1:]))
    p, want = np.exp(-3.5), []
    for k in range(6):
        want.append((want[-1] if want else 0) + p)
        p *= 3.5 / (k + 1)
    assert t["b"][:6] == pytest.approx(want)


def test_mixing_salted_join_is_the_same(spark, documents, monkeypatch):
    docs = documents([(i, "text " * (i % 7)) for i in range(300)], source=lambda i: f"s{i % 5}")
    key = lambda d: sorted(map(tuple, d.select("doc_id", "copy_no").collect()))
    plain = key(mixing.mix(docs))
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", 0)
    assert key(mixing.mix(docs)) == plain


# --- op2 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_unit_steps(dims, bits):
    side = 1 << bits
    cells = np.array(np.meshgrid(*[range(side)] * dims)).reshape(dims, -1)
    index = sharding.hilbert(list(cells), bits)
    assert sorted(index) == list(range(side**dims))
    walk = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_shards_are_even_gapless_and_follow_the_curve(spark, documents):
    r = random.Random(2)
    docs = documents([(i, "x" * r.randint(0, 500)) for i in range(1003)] + [(1, None), (1, None)], source=lambda i: "hot" if i % 3 else f"s{i % 9}")
    rows = sharding.shard_digest(docs, 40).collect()
    n = Counter(x.shard for x in rows)
    assert len(n) == 40 and max(n.values()) - min(n.values()) <= 1 and len(rows) == 1005
    for s in n:
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(n[s]))
    ordered = sorted(rows, key=lambda x: (x.shard, x.slot))
    assert [x.curve for x in ordered] == sorted(x.curve for x in ordered)
    null = next(x for x in rows if x.size == 16)
    assert null.text_crc32 == 0


def test_written_shards_prune(spark, documents):
    docs = documents([(i, "y" * (i % 300)) for i in range(800)], source=lambda i: f"s{i % 8}", extra=False)
    path, bounds = sharding.write_shards(docs, shards=8)
    assert spark.read.parquet(path).count() == 800
    assert bounds.count() == 8 and bounds.where("max_source < 's4'").count() >= 1


def test_values_with_a_common_beginning_prune_too(spark, documents):
    docs = documents([(i, "y") for i in range(900)], source=lambda i: f"https://common-crawl.example/segment-{i % 3}/" + "x" * 50 + str(i % 3), extra=False)
    _, bounds = sharding.write_shards(docs, shards=9, dimensions=["source", "lang"])
    assert bounds.where("min_source = max_source").count() >= 7
    assert len(set(sharding.text_cuts(docs, "source", 64))) == 3 and sharding.text_cuts(docs.where("doc_id < 0"), "source", 64) == []


def test_cuts_of_text_are_its_quantiles(spark, documents):
    r = random.Random(21)
    values = [f"v{min(int(r.expovariate(0.02)), 300):04d}" for _ in range(3000)]
    docs = documents([(i, "y") for i in range(3000)] + [(3000, None)], source=lambda i: values[i] if i < 3000 else None)
    order = sorted(values)
    assert sharding.text_cuts(docs, "source", 16) == [order[math.ceil(3000 * k / 16) - 1] for k in range(1, 16)]


def test_names_of_working_columns_may_be_taken(spark, documents):
    docs = documents([(i, "text " * (i % 5)) for i in range(200)], source=lambda i: f"s{i % 3}")
    odd = docs.selectExpr("*", "1 AS _source", "2 AS _n", "3 AS _u", "4 AS _cdf", "5 AS _salt", "6 AS _part", "7 AS _place", "8 AS _start", "9 AS _SALT2")
    for made in (mixing.mix(odd), sharding.hilbert_shards(odd, 7)):
        assert set(odd.columns) - {"shard", "rank"} <= set(made.columns) and made.selectExpr("sum(_source)", "max(_start)").first()[1] == 8
    assert mixing.mix(odd).count() == mixing.mix(docs).count()


# --- op3 -------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def test_decontamination_finds_exactly_the_planted_items(spark, documents, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = {b.item_id: " " + " ".join(words(b.text)) + " " for b in bench.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if t in " " + " ".join(words(d.text)) + " "}
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()} == want and want


def test_paraphrases_need_their_answer(spark, documents):
    r = random.Random(3)
    pool = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 7))) for _ in range(3000)]
    item = prose(r, 40, pool).split()
    near, far = list(item), list(item)
    for k in range(0, 40, 4):
        near[k] = "changed"
    for k in range(0, 40, 2):
        far[k] = "changed"
    rows = [(i, prose(r, 300, pool)) for i in range(60)] + [(100, prose(r, 90, pool) + " " + " ".join(near) + " " + prose(r, 50, pool)), (101, " ".join(far)), (102, " ".join(item).upper() + ".")]
    bench = spark.createDataFrame([(1, " ".join(item), item[1])], "item_id long, text string, answer string")
    got = {x.doc_id: x for x in decontam.contaminated(documents(rows), bench).collect()}
    assert set(got) == {100, 102} and got[100].lcs_words == 30 and got[102].lcs_share == 1.0
    other = spark.createDataFrame([(1, " ".join(item), "elsewhere entirely")], "item_id long, text string, answer string")
    assert {x.doc_id for x in decontam.contaminated(documents(rows), other).collect()} == {102}


def test_items_of_any_length_and_number_of_copies_are_found(spark, documents):
    r = random.Random(11)
    foreign = ["".join(r.choice("nopqrstuvw") for _ in range(r.randint(3, 7))) for _ in range(3000)]
    pool = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 7))) for _ in range(3000)]
    shared = pool[:40]  # words of many items, and of the documents
    hot, long, short = prose(r, 18, pool[100:400]), prose(r, 300, pool[400:900]), prose(r, 5, pool[900:])
    others = [(10 + i, prose(r, 30, shared)) for i in range(20)]
    rows, want = [], set()
    for i in range(300):
        text = [prose(r, r.randint(20, 90), foreign), prose(r, 10, shared), prose(r, r.randint(20, 90), foreign)]
        for item, one, here in ((1, hot, i % 3 == 0), (2, long, i % 50 == 7), (3, short, i % 5 == 1)):
            if here:
                text.insert(r.randrange(len(text) + 1), one)
                want.add((i, item))
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame([(1, hot), (2, long), (3, short), *others], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(documents(rows), bench).collect()}
    assert want <= got and {x for x in got if x[1] <= 3} == want


def test_case_and_typographic_marks_hide_no_copy(spark, documents):
    item = "Élan vital über große Straßen und Ωμέγα Ёлка seven eight nine ten"
    rows = [(1, "before “" + item.upper().replace("SS", "ß") + "” after"), (2, "x «" + item.lower() + "» y"), (3, item.replace(" ", "\u2009")), (4, "other words stand here and there")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {x.doc_id for x in decontam.contaminated(documents(rows), bench).collect()} == {1, 2, 3}


def test_recall_of_paraphrases_against_all_pairs(spark, documents):
    """Items with three of ten words replaced, held against the rule tried on every pair."""
    r = random.Random(15)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7))) for _ in range(4000)]
    items = [prose(r, r.randint(12, 90), pool).split() for _ in range(80)]
    rows = []
    for i in range(240):
        w = [x if r.random() > 0.3 else r.choice(pool) for x in items[i % 80]] if i % 3 else []
        rows.append((i, " ".join([prose(r, r.randint(5, 80), pool), *w, prose(r, r.randint(5, 80), pool)])))
    bench = spark.createDataFrame([(k, " ".join(w), " ".join(w[:2])) for k, w in enumerate(items)], "item_id long, text string, answer string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(documents(rows), bench).collect()}
    want = set()
    for i, t in rows:
        text = t.split()
        for k, w in enumerate(items):
            masks = {}
            for at, x in enumerate(w):
                masks[x] = masks.get(x, 0) | 1 << at
            for lo in range(0, len(text), 16):
                region = text[max(0, lo - len(w)) : lo + 32 + len(w)]
                n = decontam.common_subsequence(masks, len(w), region)
                if n >= 0.8 * len(w) or (n >= 0.6 * len(w) and {*w[:2]} <= set(region)):
                    want.add((i, k))
    assert want and len(got & want) >= 0.9 * len(want) and got <= want


@pytest.mark.parametrize("n_items", [80, 600])
def test_latent_candidates_carry_the_paraphrases(spark, documents, monkeypatch, n_items):
    """Without the net for copies: recall against the rule tried on every pair, and no pair that the rule refuses."""
    monkeypatch.setattr(decontam, "telling_words", lambda items, df, sure: (np.zeros(len(df) + 1, np.int64), np.empty(0, np.int64)))
    r = random.Random(16)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7))) for _ in range(4000)]
    items = [prose(r, r.randint(14, 60), pool).split() for _ in range(n_items)]
    rows, want = [], set()
    for i in range(3 * n_items):
        k = i % n_items
        w = [x if r.random() > 0.3 else r.choice(pool) for x in items[k]] if i < 2 * n_items else []
        rows.append((i, " ".join([prose(r, r.randint(5, 80), pool), *w, prose(r, r.randint(5, 80), pool)])))
        if w:  # chance alone brings no words of another item into a stretch
            masks = {}
            for at, x in enumerate(items[k]):
                masks[x] = masks.get(x, 0) | 1 << at
            n = decontam.common_subsequence(masks, len(items[k]), w)
            if n >= 0.8 * len(items[k]) or (n >= 0.6 * len(items[k]) and {*items[k][:2]} <= set(w)):
                want.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(w), " ".join(w[:2])) for k, w in enumerate(items)], "item_id long, text string, answer string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(documents(rows), bench).collect()}
    assert len(want) > n_items / 2 and len(got & want) >= 0.9 * len(want)
    assert all(i < 2 * n_items and k == i % n_items for i, k in got)


def test_scattered_words_are_no_copy(spark, documents):
    city = "what is the name of the city"
    scattered = "In the middle of what we saw there is a garden and the man by the name of Tom who came from the small old city"
    long = [f"w{i}" for i in range(20)]
    apart = " ".join(x + " " + " ".join(f"f{i}{x}" for i in range(2)) for x in long)
    rows = [(1, scattered), (2, "They asked: What is the name of the city? Nobody knew."), (3, "well yes of course"), (4, "Yes!"), (5, apart), (6, "some " + " ".join(long) + " more"), (7, "the city of the name is what"), (None, city)]
    bench = spark.createDataFrame([(1, city), (2, "yes"), (3, " ".join(long))], "item_id long, text string")
    docs = documents(rows).selectExpr("*", "1 AS _hit")
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()} == {(2, 1), (4, 2), (6, 3), (None, 1)}
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == {1, 3, 5, 7}


def test_spanned_subsequence_equals_all_stretches():
    r = random.Random(5)
    for _ in range(300):
        n, m = r.randint(1, 9), r.randint(0, 30)
        item, words = [r.randrange(6) for _ in range(n)], [r.randrange(8) for _ in range(m)]
        masks = {}
        for at, x in enumerate(item):
            masks[x] = masks.get(x, 0) | 1 << at
        span, least = r.randint(1, 14), r.randint(1, n)
        best = max([decontam.common_subsequence(masks, n, words[i : i + span]) for i in range(m)], default=0)
        assert decontam.spanned_subsequence(masks, n, words, least, span) == (best if best >= least else 0)


def test_longest_common_subsequence():
    r = random.Random(4)
    for _ in range(200):
        a, b = [r.randint(0, 6) for _ in range(r.randint(1, 12))], [r.randint(0, 6) for _ in range(r.randint(0, 20))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontam.common_subsequence(masks, len(a), b) == t[-1][-1]


# --- op5 -------------------------------------------------------------------------------------------


def test_license_scan(spark, documents):
    mit = licenses.TEMPLATES["MIT"][1].split()
    rows = [
        (1, "Some prose.\nLicensed under CC BY-NC 4.0.\nMore."),
        (2, "Licensed under CC BY 4.0."),
        (3, "Copyright is a word, and a license to drive is another."),
        (4, " ".join(mit[:20]) + "\n" + " ".join(mit[20:45]) + "\n" + " ".join(mit[45:])),
        (5, "This work is licensed under the GNU General Public License, version 2."),
        (6, "Licensed under the Apache License, Version 1.1."),
        (7, "This work is licenced under a GNU General Public License, version 3."),
    ]
    got = {x.doc_id: x for x in licenses.scan_licenses(documents(rows)).collect()}
    assert {k: v.license for k, v in got.items()} == {1: "CC-BY-NC-4.0", 2: "CC-BY-4.0", 4: "MIT", 5: "GPL-2.0"} | ({7: "GPL-3.0"} if 7 in got else {})
    assert got[1].block_no == 1 and got[4].difference == 0.0
    assert licenses.license_summary(licenses.scan_licenses(documents(rows))).count() == len({v.license for v in got.values()})


def test_licenses_inside_long_lines_and_wrapped_notices(spark, documents):
    r = random.Random(12)
    mit = licenses.TEMPLATES["MIT"][1].split()
    rows = [
        (1, prose(r, 400) + ". Licensed under CC BY 4.0. " + prose(r, 400)),
        (2, prose(r, 30) + "\n" + "\n".join(" ".join(mit[i : i + 4]) for i in range(0, len(mit), 4)) + "\n" + prose(r, 30)),
        (3, "Text: Licensed under CC BY-SA 4.0. " + prose(r, 60) + " Code: Released under the MIT License. " + prose(r, 60)),
        (4, prose(r, 300) + ". Licensed under the Apache License, Version 1.1. " + prose(r, 300)),
        (5, prose(r, 300) + " a license to drive, and copyright is a word " + prose(r, 300)),
    ]
    got = Counter((x.doc_id, x.license) for x in licenses.scan_licenses(documents(rows)).collect())
    assert got == Counter([(1, "CC-BY-4.0"), (2, "MIT"), (3, "CC-BY-SA-4.0"), (3, "MIT")])
    near = {f"L{i}": [f"You may use this work freely under license terms of the {x} foundation as published there in full."] for i, x in enumerate("amber birch cedar delta ebony fjord grove".split())}
    line = near["L6"][0]
    assert [(x.license, x.difference) for x in licenses.scan_licenses(documents([(1, line)]), near).collect()] == [("L6", 0.0)]


def test_every_notice_line_is_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = {line for wordings in licenses.TEMPLATES.values() for line in wordings}
    want = Counter((d.doc_id, i) for d in docs.collect() for i, x in enumerate((d.text or "").split("\n")) if x in lines)
    got = Counter((x.doc_id, x.block_no) for x in licenses.scan_licenses(docs).collect())
    assert got == want and want


def test_licenses_wrapped_commented_changed_and_tagged(spark, documents):
    mit, bsd, isc = (licenses.TEMPLATES[k][-1] for k in ("MIT", "BSD-2-Clause", "ISC"))
    wrap = lambda t, n, prefix: "\n".join(prefix + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [
        (1, "/*\n" + wrap(mit, 6, " * ") + "\n */\nint main;"),
        (2, "# Copyright (c) 2020 Someone\n" + wrap(bsd, 2, "# ") + "\nimport os"),
        (3, wrap(isc, 9, "// ")),
        (4, "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode"),
        (5, wrap(mit.replace("Software", "Program"), 8, "")),  # other words in many places: over the difference allowed
        (6, wrap(bsd.replace("COPYRIGHT HOLDERS", "REGENTS"), 8, "")),
        (7, "All rights reserved. Copyright by the authors, no copies without permission."),
        (8, "See https://creativecommons.org/licenses/by-nc-sa/4.0/ for terms."),
        (9, "Licensed under the European Union Public Licence, version 1.1."),
    ]
    got = sorted((x.doc_id, x.license, x.block_no) for x in licenses.scan_licenses(documents(rows)).collect())
    assert got == [(1, "MIT", 1), (2, "BSD-2-Clause", 1), (3, "ISC", 0), (4, "Apache-2.0", 0), (4, "MIT", 0), (5, "MIT", 0), (6, "BSD-2-Clause", 0), (8, "CC-BY-NC-SA-4.0", 0)]


def test_every_wording_is_its_own_license(spark, documents):
    """Wordings that several licenses open with go to the one that is listed for them."""
    every = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
    rows = [(i, f"Some words before.\n{text}\nSome words after.") for i, (_, text) in enumerate(every)]
    got = {x.doc_id: x.license for x in licenses.scan_licenses(documents(rows)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(every)}


# --- op6 -------------------------------------------------------------------------------------------


def encoded(rows):
    t = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = [(20, "a  b"), (21, " a"), (22, "a "), (23, "a \n b"), (24, "a\n\nb c"), (25, "it's a\tb c"), (26, "x <|endoftext|> y"), (27, "don't, won't: 'tis   end"), (28, "\n"), (29, "ab,cd ef-gh 12a 3.5")]


def test_tokens_round_trip(spark, documents):
    rows = EDGE + ODD + [(100 + i, f"document {i} of many, with some words.") for i in range(300)]
    got = sorted(map(tuple, tokens.token_output(documents(rows), VOCABULARY).collect()), key=lambda x: x[1])
    assert got == encoded(rows)


def test_tasks_write_shards_of_bounded_size(spark, documents):
    rows = EDGE + [(100 + i, f"document {i} of many, with some words.") for i in range(300)]
    for most in ({"shard_bytes": 2000}, {"shard_docs": 7}):
        manifest, dictionary = tokens.write_tokens(documents(rows), VOCABULARY, partitions=2, **most)
        assert len(manifest) > 4 and sum(n for _, _, n, _ in manifest) == len(rows)
        got = sorted(map(tuple, tokens.read_tokens(spark, manifest, dictionary).collect()), key=lambda x: x[1])
        assert got == encoded(rows)


def test_frames_are_read_in_runs_of_bounded_bytes():
    r = random.Random(1)
    sizes = np.array([r.choice([0, 5, 900, 5000]) for _ in range(5000)])
    runs = list(tokens._runs(sizes, 2000))
    assert [lo for lo, _ in runs] == [0] + [hi for _, hi in runs[:-1]] and runs[-1][1] == len(sizes)
    assert all(sizes[lo:hi].sum() <= 2000 or hi == lo + 1 for lo, hi in runs)
    assert list(tokens._runs(sizes[:0], 2000)) == []


def test_one_document_by_the_index(spark, documents):
    rows = [(i, f"short text number {i}") for i in range(400)]
    manifest, dictionary = tokens.write_tokens(documents(rows), VOCABULARY, partitions=3)
    ids = tokens.read_document(manifest[0][1], dictionary, 5)
    assert ids.tolist() == Tokenizer.from_file(VOCABULARY).encode("short text number 5", add_special_tokens=False).ids + [2]
    with pytest.raises(ValueError):
        tokens.read_document(manifest[0][1], (dictionary[0], "0" * 64), 5)


def test_other_vocabularies_go_whole_through_the_tokenizer(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, f"Document {i}, with  some words.") for i in range(40)]
    t, want, start = Tokenizer.from_file(path), [], 0
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [7]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.token_output(documents(rows), path, end_id=7).collect())) == want


def test_pieces_that_end_texts_and_a_small_memory(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MEMO_BYTES", 2000)
    monkeypatch.setattr(tokens, "SLICE", 3000)
    r = random.Random(14)
    texts = [" ".join(r.choice(["one", "two,", "three.\nFour", "é", "12", "x-y", "'s", "end\n", ""]) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["a\n", "a ", "\n", " ", "a b\n", "a \n"]
    encoder, t = tokens.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_known_pieces_are_looked_up_once_a_slice(monkeypatch):
    """A look-up hashes all that is known, so a slice has one; what is known needs no tokenizer."""
    import pyarrow as pa

    encoder, calls, index_in = tokens.Encoder(VOCABULARY), [], tokens.pc.index_in
    monkeypatch.setattr(tokens.pc, "index_in", lambda *a, **k: calls.append(1) or index_in(*a, **k))
    texts = pa.array([f"one two{i} three" for i in range(50)])
    first = [x.tolist() for x in encoder.encode(texts)]
    monkeypatch.setattr(encoder, "_learn", lambda new: pytest.fail("learnt again"))
    assert first == [x.tolist() for x in encoder.encode(texts)] and len(calls) == 2


# --- op7 -------------------------------------------------------------------------------------------


def brute_components(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, len(s), find(i), i == find(i)) for i, s in sets.items()}


def near_copies(seed, n=40, group=60):
    r = random.Random(seed)
    rows, base, passage = [], prose(r, 150).split(), prose(r, 60)
    for i in range(group):  # copies with more and more words changed
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(n):  # documents that share a passage, some little else
        rows.append((1000 + i, passage + " " + prose(r, r.choice([2, 8, 20, 60, 200]))))
    for i in range(n):
        rows.append((2000 + i, prose(r, r.choice([1, 3, 5, 6, 50]))))
    rows += [(3000 + i, rows[i % 50][1]) for i in range(50)] + [(4000, ""), (4001, None), (4002, " \t "), (4003, "One Two"), (4004, "one two"), (4005, "x " * 40000)]
    return rows


@pytest.mark.parametrize("short", [16, 2])
def test_near_duplicates_equal_brute_force(spark, documents, monkeypatch, short):
    monkeypatch.setattr(neardup, "SHORT", short)
    rows = near_copies(5)
    got = {tuple(x) for x in neardup.near_duplicates(documents(rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_with_every_large_key_split(spark, documents, monkeypatch):
    for module in (neardup, skew):
        monkeypatch.setattr(module, "LEAST", 3)
    monkeypatch.setattr(neardup, "PART", 3)
    rows = near_copies(6, n=15, group=25)
    assert {tuple(x) for x in neardup.near_duplicates(documents(rows)).collect()} == brute_components(rows)


def test_near_duplicates_of_the_small_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {tuple(x) for x in neardup.near_duplicates(docs).collect()}
    assert got == brute_components([(d.doc_id, d.text) for d in docs.collect()])


def test_keep_one_keeps_columns_and_rows_without_id(spark, documents):
    docs = documents(EDGE)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or 0) for x in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]


def test_near_duplicates_without_chance(spark, documents):
    rows = near_copies(7, n=20, group=30)
    assert {tuple(x) for x in neardup.near_duplicates(documents(rows), exact=True).collect()} == brute_components(rows)


def test_rows_that_repeat_a_doc_id_have_their_own_links(spark, documents):
    """Each doc_id has two texts; a smaller doc_id has a near copy of the second, or of the first, or of none."""
    r = random.Random(21)
    rows = []
    for i in range(60):
        one, two = prose(r, 60), prose(r, 60)
        rows += [(1000 + i, one), (1000 + i, two)]
        if i % 3 < 2:
            rows.append((i, (two, one)[i % 3] + " and a little more"))
    rows += [(2000, ""), (2000, None), (2000, rows[0][1]), (3000, rows[3][1]), (3000, rows[3][1] + " too"), (3000, rows[3][1])]
    nodes = brute_components(list(enumerate(t for _, t in rows)))  # over row numbers
    first = {}
    for k, _, c, _ in nodes:
        first[c] = min(first.get(c, 10**9), rows[k][0])
    want = sorted((rows[k][0], n, first[c], rows[k][0] == first[c]) for k, n, c, _ in nodes)
    assert sorted(map(tuple, neardup.near_duplicates(documents(rows)).collect())) == want
    # One row of every group is left, and all rows without a set.
    left = [(x.doc_id, x.text) for x in neardup.keep_one(documents(rows).selectExpr("*", "1 AS print", "2 AS label")).collect()]
    group = {rows[k]: c for k, n, c, _ in nodes if n}
    assert sorted(group[x] for x in left if x[1]) == sorted(set(group.values()))
    assert all(x[0] == first[group[x]] for x in left if x[1]) and sum(not x[1] for x in left) == 2


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 90)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {(v, find(v)) for a, b in edges if a != b for v in (a, b)}
    got = {tuple(x) for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_word_hashes_equal_words():
    import pyarrow as pa

    texts = ["One two  two", "", "two ONE", " ", "é one", "one"]
    data, offsets = shingles.text_bytes(pa.array(texts, pa.large_string()))
    h, owner = shingles.word_hashes(data, offsets[:-1])
    flat = [(i, w.lower()) for i, t in enumerate(texts) for w in t.split()]
    assert owner.tolist() == [i for i, _ in flat]
    by = {}
    for (_, w), x in zip(flat, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


# --- op8 -------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    s = toxicity.score_documents(docs, labels).select("doc_id", "score", toxicity.held_out().alias("h")).join(labels.select("doc_id", "toxic"), "doc_id").where("h").collect()
    p, t = np.array([x.score >= 0.7 for x in s]), np.array([x.toxic == 1 for x in s])
    assert (p & t).sum() / t.sum() >= 0.9 and (p & t).sum() / max(p.sum(), 1) >= 0.95


def test_nnpu_separates_and_stays_non_negative():
    r = np.random.default_rng(0)
    x = [np.array([0, 2]) if i % 2 else r.integers(3, 40, 3) for i in range(400)]
    u = [np.array([0, 2]) if i % 10 == 0 else r.integers(3, 40, 3) for i in range(2000)]
    w = toxicity.fit_nnpu([*[v for i, v in enumerate(x) if i % 2], *u], np.array([True] * 200 + [False] * 2000), 40, 0.1)
    score = lambda v: 1 / (1 + np.exp(-(w[v].sum() + w[-1])))
    assert score(np.array([0, 2])) > 0.7 and score(np.array([5, 6, 7])) < 0.3


def test_toxicity_without_labels_scores_the_prior(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(documents(EDGE), none).collect()
    assert len(rows) == len(EDGE) and {round(x.score, 6) for x in rows} == {0.01}
    assert toxicity.reject_toxic(documents(EDGE), none).columns == documents(EDGE).columns


# --- edge cases of all -----------------------------------------------------------------------------


def test_edge_rows_pass_through_every_operator(spark, documents, sf_dir):
    docs, n = documents(EDGE), len(EDGE)
    assert mixing.mix(docs, epochs=3.0).count() >= 0
    assert sharding.shard_digest(docs).count() == n
    assert tokens.token_output(docs, VOCABULARY).count() == n
    assert neardup.near_duplicates(docs).count() == n
    assert licenses.scan_licenses(docs).count() == 0
    bench = table(spark, sf_dir, "benchmark")
    assert decontam.contaminated(docs, bench).count() == 0
    assert decontam.decontaminate(docs, bench).count() == n


def test_stages_keep_columns_of_any_name(spark, documents):
    rows = [(i, f"plain words of document number {i} stand here") for i in range(30)] + [(30, "something else entirely is written in this one here")]
    names = ["score", "rate", "copy_no", "shuffle_key", "_hit", "print", "label", "n", "id", "first"]
    docs = documents(rows, extra=False).selectExpr("*", *(f"concat('{n}', doc_id) AS {n}" for n in names))
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "something else entirely is written in this one here"), (2, "no document says this one at all")], "item_id long, text string")
    for out in (toxicity.reject_toxic(docs, labels, threshold=1.1), neardup.keep_one(docs), decontam.decontaminate(docs, bench), mixing.replicate(docs, epochs=3.0)):
        assert out.columns == docs.columns
        left = out.collect()
        assert left and all(x[n] == f"{n}{x.doc_id}" for x in left for n in names)


def test_empty_tables(spark, documents, sf_dir):
    docs = documents([])
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    assert mixing.mix(docs).count() == sharding.shard_digest(docs).count() == tokens.token_output(docs, VOCABULARY).count() == 0
    assert neardup.near_duplicates(docs).count() == licenses.scan_licenses(docs).count() == toxicity.score_documents(docs, labels).count() == 0
    assert decontam.contaminated(docs, bench).count() == decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).count() == 0
    assert decontam.contaminated(documents(EDGE), bench).count() == 0


def test_decontamination_hands_texts_over_in_small_batches(spark, documents, monkeypatch):
    from starloom.llm import workers

    size, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, durable = spark.conf.get(size), decontam.durable
    monkeypatch.setattr(decontam, "durable", lambda df, name: seen.append((name, spark.conf.get(size))) or durable(df, name))
    item = " ".join(f"word{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontam.decontaminate(documents([(0, "nothing of it"), (1, f"so {item} then")]), bench)
    assert [r.doc_id for r in kept.collect()] == [0] and spark.conf.get(size) == before
    assert len(seen) >= 3 and {s for _, s in seen} == {str(workers.BATCH_BYTES)}


def test_words_of_texts_are_held_in_small_slices(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    r = random.Random(5)
    texts = pa.array([prose(r, 400) for _ in range(1200)])  # over 2 MB
    monkeypatch.setattr(shingles, "_powers", {})
    tracemalloc.start()
    try:
        vocabulary = np.unique(next(h for _, h, *_ in decontam._passage_words(texts, np.zeros(1, np.uint64)))[:1000])
        n = sum(len(h) for _, h, *_ in decontam._passage_words(texts, vocabulary))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 400 * 1200 and peak < 24 << 20, peak
