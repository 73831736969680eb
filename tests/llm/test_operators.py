"""Operators against brute force on small tables with nulls, empty, long and repeated rows, ties and extra columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from markspark.llm import (bpe, decontaminate, licenses, line_dedup, near_dup, quality, queries, shards, token_rollup, topk, toxicity,
                           words)
from markspark.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def docs(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "k") for i, t, s in rows], DOC)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["th" + x + y for x in "abcdefg" for y in "hijklmn"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 80))) for _ in range(n)]
    for i in range(n // 3):  # near copies of text 0, at all distances
        w = texts[0].split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [texts[1], texts[1], "", None, "one", "one two", "A\nB\tc"]
    return [(i, t, f"s{i % 12}") for i, t in enumerate(texts)] + [(None, texts[2], None), (None, None, None), (3, texts[3], "s3")]


# --- words ---

def test_word_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    import pyarrow as pa
    texts = ["Ab cd", None, "", "cd ab" * 3, "x" * 100, "ab  CD\n" * 50, "é ab"]
    whole = [(f, o.tolist(), h.tolist()) for f, o, h in words.row_words(pa.array(texts), words.NOT_SPACE)]
    flat = [h for _, _, hs in whole for h in hs]
    expect = [w for t in texts for w in (t or "").lower().split()]
    assert len(flat) == len(expect)
    assert len(set(flat)) == len(set(expect)) == len(set(zip(flat, expect, strict=True)))
    monkeypatch.setattr(words, "PIECE", 16)
    monkeypatch.setattr(words, "pieces", lambda off, size=16: words.__dict__["_p"](off, size))
    words._p = lambda off, size: ((i, i + 1) for i in range(len(off) - 1))
    again = [h for _, _, hs in words.row_words(pa.array(texts), words.NOT_SPACE) for h in hs]
    assert again == flat


# --- 1 ---

def test_toxicity_learns_and_scores_rows_alone(spark):
    rng = random.Random(1)
    clean = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(500):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 90))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "vequ" + rng.choice(clean)
        rows.append((i, " ".join(w), i % 3 == 0))
    net = toxicity.train([t for _, t, _ in rows[:400]], np.array([int(y) for *_, y in rows[:400]]))
    d = docs(spark, [(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (902, "... !", "s"), (None, "vequ", None)])
    got = {r.doc_id: r.score for r in toxicity.scores(d, net).collect()}
    held = [(got[i], y) for i, _, y in rows[400:]]
    assert sum((s >= 0.5) == y for s, y in held) >= 95
    assert got[900] == got[901] == got[902] == 0.0 and all(0 <= s <= 1 for s in got.values())
    one = toxicity.scores(d.filter("doc_id = 401").repartition(1), net).first().score
    assert one == pytest.approx(got[401], abs=2e-5)


def test_toxicity_fast_and_training_forward_agree():
    net = toxicity.Network()
    raw = np.frombuffer(("alpha beta " * 40 + "gamma").encode(), np.uint8)
    w = toxicity.Words(raw, np.array([len(raw)]))
    row, places = toxicity._window_places(w)
    x = net.inputs(w)
    assert np.allclose(net.logits(x, places(0, len(row))), net.forward(x, places(0, len(row))), atol=1e-5)
    assert len(row) == math.ceil((81 - toxicity.SPAN) / toxicity.STRIDE) + 1


def test_toxicity_gradient():
    net = toxicity.Network()
    raw = np.frombuffer(b"some words here and some more", np.uint8)
    w = toxicity.Words(raw, np.array([len(raw)]))
    _, places = toxicity._window_places(w)
    p = places(0, 1)
    for v in net.p:
        net.p[v] = net.p[v].astype(np.float64)
    x = net.inputs(w).astype(np.float64)
    _, cache = net.forward(x, p, keep=True)
    g = net.backward(w, x, p, cache, np.ones(1))
    for name, at in (("rec_f", (1, 2)), ("in_b", (3, 17)), ("att", (2, 3)), ("out", (4,))):
        old, out = net.p[name][at], []
        for eps in (1e-4, -1e-4):
            net.p[name][at] = old + eps
            out.append(float(net.forward(x, p)[0]))
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((out[0] - out[1]) / 2e-4, rel=0.05, abs=1e-4)


def test_every_passage_lies_in_a_window():
    long = toxicity.SPAN - toxicity.STRIDE + 1
    for n in range(1, 200):
        _, first = toxicity.windows(np.array([n]))
        for at in range(max(n - long, 0) + 1):
            assert any(f <= at and min(at + long, n) <= f + toxicity.SPAN for f in first.tolist()), (n, at)


def test_training_sample_has_one_text_an_id(spark):
    d = docs(spark, [(7, f"copy {i % 3}", "s") for i in range(50)] + [(8, "other", "s"), (8, None, "s"), (None, "x", "s")])
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 1), (8, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    texts, y = toxicity.training_sample(d, labels)
    assert (texts, y.tolist()) == (["copy 0", "other"], [1, 0])


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "a", "s")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.scores(d, toxicity.fit(d, labels)).collect()] == [0.01]
    assert toxicity.scores(d.limit(0), 0.5).count() == 0


# --- 2 ---

def brute_lines(rows, min_sites):
    sites, first = {}, {}
    key = lambda r: (r[0] is None, r[0] or 0)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(r[2])
                first[x.strip(" ")] = min(first.get(x.strip(" "), key(r)), key(r))
    bad = {x for x, s in sites.items() if len(s - {None}) >= min_sites}
    return [(r[0], None if r[1] is None else "\n".join(
        x for x in r[1].split("\n") if x.strip(" ") not in bad or first[x.strip(" ")] == key(r))) for r in rows]


def test_line_dedup(spark):
    rows = [(i, f"hot line\nown {i}\n  \nnear {i % 9}\n small {i % 2} ", f"s{i % 20}") for i in range(200)]
    rows += [(1000, None, "s1"), (1001, "", "s1"), (None, "hot line\nx", None), (1002, "hot line", "s2"), (1002, "hot line", "s2")]
    for least in (3, 10, 20, 21):
        out = line_dedup.dedup_lines(docs(spark, rows), "source", least)
        assert sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, brute_lines(rows, least)))
    assert line_dedup.dedup_lines(docs(spark, rows).limit(0), "source", 2).count() == 0


def test_line_dedup_exact_band_overrules_the_sketch(spark):
    rows = [(i, "line", f"site{i}") for i in range(990)]
    for least in (980, 990, 991, 1000):
        n = line_dedup.dedup_lines(docs(spark, rows), "source", least).filter("__removed > 0").count()
        assert n == (989 if least <= 990 else 0)


def test_op2_removes_passages_of_a_skewed_corpus(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{passage}\nown {i}\nhot {i % 12}", "hot" if i < 14 else f"s{i}") for i in range(20)]  # 20 copies, 14 of them on one site
    rows += [(100 + i, f"few\nown {100 + i}", f"s{i % 4}") for i in range(20)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert [i for i, t in got.items() if passage in t] == [0]
    assert all(got[100 + i].startswith("few\n") for i in range(20))


# --- 3 ---

def word_list(t):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(text, items, window):
    w, hit, found = word_list(text), set(), set()
    for i, t in items:
        iw = word_list(t)
        n = min(window, len(iw))
        if not n or i is None:
            continue
        grams = {tuple(iw[a:a + n]) for a in range(len(iw) - n + 1)}
        for a in range(len(w) - n + 1):
            if tuple(w[a:a + n]) in grams:
                hit.update(range(a, a + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [50_000, 3])
def test_contamination(spark, block):
    rng = random.Random(5)
    vocab = ["aa", "bb", "cc", "É", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 6, 12, 25, 0, 12])]
    items += [(7, items[4][1]), (8, None), (None, "aa"), (9, items[5][1])]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))), "s") for i in range(40)]
    rows += [(50, items[5][1].upper().replace(" ", "-"), "s"), (51, None, "s"), (51, None, "s"), (None, "x y " + items[4][1], "s"),
             (52, "z " * 3000 + items[5][1] + " q" * 3000, "s")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    out = decontaminate.contamination(docs(spark, rows), bench, window=10, pairs_per_block=block)
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out.select("*", decontaminate.covered().alias("n_hit")).collect()]
    want = [(i, *brute_hits(t, items, 10)) for i, t, _ in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = decontaminate.remove_contaminated(docs(spark, rows), bench, window=10, min_words=1, pairs_per_block=block)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, n, _ in want if not n)


def test_contamination_below_one(spark):
    item = " ".join(f"w{i}" for i in range(30))
    edited = item.split()
    edited[15] = "other"
    d = docs(spark, [(1, "p q " + " ".join(edited) + " r", "s"), (2, item[:60], "s"), (3, "p " * 50, "s")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    share = 23 / 28  # of the item's 3-word shingles, of which the other word breaks three: 25 of 28 remain
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(d, bench, window=10_000, threshold=share).collect()}
    assert got == {1: ["1"], 2: [], 3: []}


def test_contamination_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    d = docs(spark, [(1, "a b", "s")])
    assert [(r.n_words, r["items"]) for r in decontaminate.contamination(d, empty).collect()] == [(2, [])]
    assert decontaminate.contamination(d.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# --- 4 ---

def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8)) * rng.gamma(1, size=(300, 1))
    rows = [(i, x.astype(np.float32).tolist(), 1) for i, x in enumerate(v)]
    rows += [(300, rows[50][1], 1), (301, rows[50][1], 1), (301, rows[50][1], 1), (302, None, 1), (303, [1.0] * 7, 1), (304, [float("nan")] * 8, 1),
             (305, [None] + [1.0] * 7, 1), (306, [0.0] * 8, 1), (None, [1.0] * 8, 1), (350, [-x for x in rows[7][1]], 1), (400, [], 1)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), "vec_id % 50 = 0")
    ok = {i: np.floor(256 * np.array(x, np.float64)).astype(np.int64) for i, x, _ in rows
          if i is not None and x and len(x) == 8 and all(a is not None and math.isfinite(a) for a in x)}
    want = []
    for q in (q for q in ok if q % 50 == 0):
        best = sorted(((-int(ok[q] @ x), i) for i, x in ok.items() if i != q))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == sorted(want)


def test_top_k_of_few(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], kind)
    assert [tuple(r) for r in topk.top_k(few, "vec_id = 0").collect()] == [(0, 1, 1, 3 * 256 * 256)]
    assert topk.top_k(few.limit(0), "vec_id = 0").count() == 0


# --- 5 ---

def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark):
    rows = corpus() + [(7, "same", "s")] * 40 + [(None, None, None)] * 5
    d = docs(spark, rows)
    got = shards.shard_rows(d, "doc_id", "text", 12, salts=4).collect()
    assert len(got) == len(rows)
    h = {r.k: r.h % (1 << 64) for r in d.selectExpr("doc_id k", "xxhash64(coalesce(cast(doc_id as string), '\\0null')) h").collect()}
    for n in range(12):
        slots = sorted(r.slot for r in got if r.shard == n)
        assert slots == list(range(len(slots)))
    assert sorted(((r.doc_id or -1), r.size, r.text_crc32) for r in got) == sorted(
        ((i or -1), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for r in got:
        assert r.shard == jump(h[r.doc_id], 12) and r.grown_shard == jump(h[r.doc_id], 13)
        assert r.grown_shard in (r.shard, 12)
    many = spark.range(300).selectExpr("id", "xxhash64(cast(id as string)) h").select("h", shards.jump_pair(shards.F.col("id"), 700).alias("p"))
    assert all(r.p.shard == jump(r.h % (1 << 64), 700) for r in many.collect())


# --- 6 ---

def test_licences(spark):
    rows = [("a/LICENSE", "x\nLicensed under the Apache License, Version 2.0."), ("a/b/c.txt", "words only"), ("a/b/d/e", None),
            ("a/b/d/e", None), ("q/z", "All rights reserved."), ("q/y", "the rights of all"), ("top", "t"), (None, "released under the mit license"),
            ("COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("a/b/COPYING", "Released under the MIT License")]
    d = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, licence string")
    got = sorted((str(r.path), r.licence, r.own, r.from_folder) for r in licenses.scan(d).collect())
    assert got == sorted([("a/LICENSE", "Apache-2.0", True, None), ("a/b/c.txt", "MIT", False, "a/b"), ("a/b/d/e", "MIT", False, "a/b"),
                          ("a/b/d/e", "MIT", False, "a/b"), ("q/z", "Proprietary", True, None), ("q/y", "GPL-3.0", False, ""),
                          ("top", "GPL-3.0", False, ""), ("None", "MIT", True, None), ("COPYING.txt", "GPL-3.0", True, None),
                          ("a/b/COPYING", "MIT", True, None)])
    assert licenses.scan(d.limit(0)).count() == 0


def test_heavy_terms_are_necessary():
    unit, idf, other = licenses.weights(licenses.TEMPLATES)
    heavy = set(licenses.heavy_terms(unit, 0.75))
    rng = random.Random(2)
    vocab = sorted(idf) + ["zz"]
    for _ in range(3000):
        line = [rng.choice(vocab) for _ in range(rng.randint(1, 8))]
        w = {t: line.count(t) * idf.get(t, other) for t in line}
        size = math.sqrt(sum(x * x for x in w.values()))
        best = max(sum(w.get(t, 0) * u for t, u in x.items()) / size for x in unit.values())
        assert best < 0.75 or heavy & set(line)


def test_licence_cosine_against_brute_force(spark):
    unit, idf, other = licenses.weights(licenses.TEMPLATES)
    rng = random.Random(4)
    vocab = sorted(idf) + ["zz", "yy"]

    def line():
        start = licenses.terms(rng.choice(list(licenses.TEMPLATES.values())))
        return " ".join(start + [rng.choice(vocab) for _ in range(rng.randint(0, 5))]).upper()

    texts = ["\n".join(line() for _ in range(rng.randint(1, 4))) for _ in range(200)] + ["", None, "license " * 30_000]

    def brute(text):
        found = []
        for x in (text or "").split("\n"):
            t = licenses.terms(x)
            size = math.sqrt(sum((t.count(a) * idf.get(a, other)) ** 2 for a in set(t)))
            found += [(-round(sum(t.count(a) * idf[a] * u for a, u in w.items()) / size, 6), n) for n, w in unit.items() if size]
        c, n = min(found, default=(0, None))
        return (None, None) if c > -0.75 else (n, -c)

    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("path", licenses.F.lit("p"))
    got = {r.doc_id: (r.licence, r.cosine) for r in licenses.scan(d, carry=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        name, c = brute(t)
        assert got[i][0] == name and (c is None or abs(got[i][1] - c) < 2e-6), (i, t, got[i])


def test_licence_titles_headers_and_files(spark):
    """What op6 found before its least cosine was raised, and notices that no single line holds."""
    wrapped = ("# Copyright 2020 Foo\n#\n# This file is part of Foo, a tool for bars.\n#\n# Permission is hereby granted, free of charge, to any\n# person obtaining a\n"
               "# copy of this software and associated\n# documentation files (the \"Software\"), to deal in the\n# Software without restriction, including\n"
               "# without limitation the rights to use, copy,\n# modify, merge, publish, distribute,\n# sublicense, and/or sell copies of the Software, and\n"
               "# to permit persons to whom the Software\n# is furnished to do so, subject to the following\n# conditions:\nimport os\n")
    gnu = licenses._GNU.split()
    header = "\n".join(" * " + " ".join(gnu[i:i + 5]) for i in range(0, len(gnu), 5))
    rows = [("MIT License", "MIT"), ("The MIT License (MIT)", "MIT"), ("GNU GENERAL PUBLIC LICENSE", "GPL-3.0"),
            ("Copyright 2020 Foo. All rights reserved.", "Proprietary"), ("the rights of all", None),
            ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "BSD-3-Clause"),
            (wrapped, "MIT"), (header.format("", "2"), "GPL-2.0"), (header.format("", "3"), "GPL-3.0"), (header.format("Lesser ", "3"), "LGPL-3.0"),
            ("/* Use of this source code is\ngoverned by a BSD-style\nlicense that can be found in\nthe LICENSE file. */", "BSD-3-Clause"),
            ("It is not the use of the software in the copy of a file but the name of the person, and you may see it.", None), ("", None), (None, None)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string").selectExpr("doc_id", "text", "concat('p', doc_id) path")
    got = {r.doc_id: r.licence for r in licenses.scan(d, least=0.6, carry=("doc_id",)).collect()}
    assert [got[i] for i in range(len(rows))] == [x for _, x in rows]


def test_fewest_terms_are_necessary():
    unit, idf, other = licenses.whole_weights(licenses.WHOLE)
    rng = random.Random(6)
    for u in unit.values():
        rare, k = licenses.fewest(u, 0.6)
        assert k >= 1
        for _ in range(200):
            line = {*rng.choices([*rare, "zz"], k=rng.randint(1, 12)), *rng.choices(sorted(licenses.EVERYDAY & set(idf)), k=rng.randint(0, 40))}
            size = math.sqrt(sum(idf.get(t, other) ** 2 for t in line))
            assert sum(idf[t] * v for t, v in u.items() if t in line) / size < 0.6 or len(set(rare) & line) >= k


def test_licence_notices_anywhere_in_a_text(spark, monkeypatch):
    """Notices wrapped over lines at any place of short and long texts, against the same stretches made in Python."""
    monkeypatch.setattr(licenses, "PIECE", 3_000)
    monkeypatch.setattr(licenses, "OVERLAP", 2_500)
    unit, idf, other = licenses.whole_weights(licenses.WHOLE)
    rng = random.Random(8)
    plain = [a + b for a in ("ba", "ko", "mi", "zu") for b in ("la", "ne", "ri", "so")] + ["the", "of", "use", "software", "copy", "terms"]

    def wrap(w):
        return "\n".join("# " + " ".join(w[i:i + 6]) for i in range(0, len(w), 6))

    def brute(text):
        found = []
        for at in range(0, max(len(text), 1), licenses.PIECE):
            t = licenses.terms(text[at:at + licenses.PIECE + (licenses.OVERLAP if len(text) > licenses.PIECE else 0)])
            for i, (name, x) in enumerate(licenses.WHOLE):
                n = len(licenses.terms(x))
                for a in range(len(t)):
                    w = set(t[a:a + n])
                    c = sum(idf[y] * v for y, v in unit[str(i)].items() if y in w) / math.sqrt(sum(idf.get(y, other) ** 2 for y in w))
                    found.append((-round(c, 6), name))
        c, name = min(found, default=(0, None))
        return (name, -c) if c <= -0.6 else (None, None)

    texts, planted = [], []
    for i in range(28):
        name, x = licenses.WHOLE[i % len(licenses.WHOLE)]
        before, after = ([rng.choice(plain) for _ in range(rng.choice((3, 250, 2_000)))] for _ in range(2))
        texts.append(wrap(before + x.split() + after))
        planted.append({name} | ({"BSD-2-Clause", "BSD-3-Clause"} if "BSD" in name else set()))
    texts += [wrap([rng.choice(plain) for _ in range(3_000)]), "x" * 20_000, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    best = licenses.stretch_licence(licenses.F.col("text"), licenses.WHOLE, 0.6)
    got = {r.doc_id: r.best for r in d.select("doc_id", best.alias("best")).collect()}
    for i, t in enumerate(texts):
        name, c = brute(t)
        assert (got[i] and got[i].licence) == name and (c is None or abs(got[i].c + c) < 2e-6), (i, got[i], name, c)
        assert i >= len(planted) or name in planted[i]


def test_op6_has_the_lower_least(spark, tmp_path):
    docs(spark, [(1, "words\nMIT License", "s"), (2, "words", "t")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.licence for r in queries.op6_licenses(spark, str(tmp_path)).collect()} == {1: "MIT", 2: None}


# --- 7 ---

def brute_groups(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    sets = [shingles(t) for _, t, _ in rows]
    f = near_dup.Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                f.join(i, j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[f.root(i)] = min(d, least.get(f.root(i), d))
    return [(d, len(s), least.get(f.root(i)) if s else d) for i, ((d, *_), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 256), (5, 80, 4)])
def test_near_duplicates(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(near_dup, "BLOCK_SETS", block)
    rows = corpus(7)
    got = near_dup.near_duplicates(docs(spark, rows), k, percent).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute_groups(rows, k, percent)))
    kept = near_dup.keep_one(docs(spark, rows), k, percent).collect()
    groups = {c for _, n, c in brute_groups(rows, k, percent) if n}
    assert sorted(r.doc_id for r in kept if (r.text or "").strip()) == sorted(groups)
    assert len([r for r in kept if not (r.text or "").strip()]) == len([1 for _, n, _ in brute_groups(rows, k, percent) if not n])


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(docs(spark, [(1, "a", "s")]).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)]
    f = near_dup.Forest()
    for a, b in links:
        f.join(a, b)
    got = {r.u: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(5), "long").collect()}
    assert got == {x: f.root(x) for x in {y for p in links for y in p} if f.root(x) != x}


# --- 8 ---

def test_token_rollup(spark, tmp_path):
    rows = [(1, "the cat", "en", "a"), (2, "the cat", "en", "b"), (3, "der Hund", "de", "a"), (4, None, None, None), (5, "x y", "de", "a"),
            (6, "der Hund", "de", "a"), (None, "the cat", "en", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    first, second = queries.vocabulary(), queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    counts = token_rollup.token_counts(d, first, second, ["de"])
    n1 = lambda t: len(bpe._codec(first).tok.encode(t or "", add_special_tokens=False).ids)
    n2 = lambda t: len(token_rollup._ranks(second).encode_ordinary(t))
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    token_rollup.maintain(rollup, counts, "v1", "v2")
    want = {("a", "en", "v1"): (1, n1("the cat")), (None, None, "v1"): (1, 0), ("a", "de", "v2"): (2, n2("der Hund") + n2("x y"))}
    assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()} == want
    before = sorted(map(str, rollup.totals().collect()))
    rollup.commit(1, token_rollup.signed(counts, "v1", "n_first", 1))
    assert sorted(map(str, rollup.totals().collect())) == before


def test_token_rollup_commits_are_idempotent(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    changes = lambda rows: spark.createDataFrame(rows, "source string, lang string, version string, docs long, tokens long")
    totals = lambda r: sorted((x.source, x.lang, x.version, x.docs, x.tokens) for x in r.totals().collect())
    assert totals(rollup) == []
    rollup.commit(1, changes([("a", "en", "v", 1, 5), ("a", "en", "v", 1, 2)]))
    rollup.commit(2, changes([("b", "de", "v", 1, 3)]))
    rollup.commit(1, changes([("a", "en", "v", 1, 5)]))
    assert totals(rollup) == [("a", "en", "v", 1, 5), ("b", "de", "v", 1, 3)]
    rollup.commit(1, changes([]))  # corrected to nothing
    again = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert totals(again) == [("b", "de", "v", 1, 3)]
    broken = changes([("c", "en", "v", 1, 1)]).withColumn("tokens", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        again.commit(2, broken)
    assert totals(again) == [("b", "de", "v", 1, 3)]


def test_op8_counts_all_documents_under_both_versions(spark, tmp_path):
    rows = [(1, "the cat", "en", "a"), (2, "the cat", "en", "a"), (3, "der Hund", "de", "a"), (4, None, None, None), (5, None, None, None),
            (6, "der Hund", "de", "a"), (None, "the cat", "en", "b"), (6, "der Hund", "de", "a")]
    rows += [(100 + i, "le chat noir", "fr", "c") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    v = {"word_bpe_49k": lambda t: len(bpe._codec(queries.vocabulary()).tok.encode(t, add_special_tokens=False).ids),
         "byte_bpe_multi_50k": lambda t: len(token_rollup._ranks(queries.vocabulary("byte_bpe_multi_50k.tiktoken")).encode_ordinary(t))}
    want = {}
    for _, t, lang, source in rows:
        for name, n in v.items():
            d, k = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = (d + 1, k + n(t or ""))
    got = queries.op8_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in got} == want


# --- 9 ---

def test_quality_prefers_text_like_the_target(spark):
    rng = random.Random(9)
    vocab = [a + b for a in ("lo", "ra", "mi", "te") for b in ("na", "so", "ke", "pu")]
    good = [(i, " ".join(rng.choice(vocab) for _ in range(40)), "s") for i in range(200)]
    bad = [(1000 + i, "$$ ## " * 30 + " ".join(["spam"] * 20), "s") for i in range(50)]
    rows = good + bad + [(2000, None, "s"), (2001, "", "s"), (0, good[0][1], "s"), (None, good[1][1], "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(1000 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = quality.select_quality(docs(spark, rows), labels, share=0.75).collect()
    assert len(out) == len(rows)
    chosen = {r.doc_id for r in out if r["__selected"]}
    assert not chosen & set(range(1000, 1050))
    assert len(chosen & set(range(200))) > 150
    assert {r["__key"] for r in out if r.doc_id == 0}.__len__() == 1
    assert all(r["__log_weight"] == 0 for r in out if r.doc_id in (2000, 2001))


def test_quality_share_follows_the_input_not_the_labels(spark):
    rng = random.Random(9)
    vocab = [a + b for a in ("lo", "ra", "mi", "te") for b in ("na", "so", "ke", "pu")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(1000 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    for n_good, n_bad in ((300, 60), (60, 300)):
        rows = [(i, " ".join(rng.choice(vocab) for _ in range(40)), "s") for i in range(n_good)]
        rows += [(1000 + i, f"$$ ## {i} " * 30 + " ".join(["spam"] * 20), "s") for i in range(n_bad)]
        chosen = {r.doc_id for r in quality.select_quality(docs(spark, rows), labels).collect() if r["__selected"]}
        assert len(chosen & set(range(300))) >= 0.97 * n_good and len(chosen - set(range(300))) <= 0.03 * n_bad


def test_best_cut(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(2, 1), True) for _ in range(400)] + [(rng.gauss(-2, 1), False) for _ in range(300)] + [(-1e6, False), (1e6, True)]
    cut = quality.best_cut(spark.createDataFrame(rows, "v double, good boolean"))
    errors = lambda c: sum((v >= c) != g for v, g in rows)
    assert errors(cut) == min(errors(c) for c, _ in rows)
    assert quality.best_cut(spark.createDataFrame(rows[:400], "v double, good boolean")) is None


def test_kth_largest(spark):
    rng = random.Random(1)
    v = [rng.gauss(0, 100) for _ in range(30_000)] + [5.0] * 12_000
    d = spark.createDataFrame([(x,) for x in v], "v double")
    for k in (1, 17, 15_000, 20_000, len(v)):
        assert quality.kth_largest(d, k) == sorted(v, reverse=True)[k - 1]


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select_quality(docs(spark, [(1, "a", "s")]), labels).first()["__selected"]
    assert quality.select_quality(docs(spark, [(1, "a", "s")]).limit(0), labels).count() == 0


# --- 10 ---

def pieces_of(codec, text, piece):
    parts = []
    for p, special, goes_on, plain in bpe._cut(text, codec, piece):
        ids, first, last = bpe._encode_piece(codec, p, special, goes_on, plain)
        parts.append((ids, first, last, 0 if plain or special else p.count(" ") + 1, goes_on))
    return bpe._tree(codec, parts)


def test_tree_concatenation_equals_the_library():
    codec, rng = bpe.Codec(queries.vocabulary()), random.Random(1)
    letters = ["ab", "the", "an", "é", "ß", "ing", "0", "'s", "'re", "!", "日本", "😀", "é", "İ", "<|endoftext|>", " ", " "]
    for _ in range(800):
        text = "".join(rng.choice(letters[:rng.randint(2, len(letters))]) for _ in range(rng.randint(0, 60)))
        want = codec.tok.encode(text, add_special_tokens=False).ids
        assert pieces_of(codec, text, rng.randint(3, 12)) == want
        assert np.frombuffer(codec.encode([text])[0][0], "<u4").tolist() == want
        assert codec.decode(want) == codec.tok.decode(want, skip_special_tokens=False)
    for _ in range(60):
        word = "".join(rng.choice("thean") for _ in range(rng.randint(1, 3000)))
        assert codec.encode_word(codec.symbols(word), True, rng.randint(2, 40)) == codec.tok.encode(word, add_special_tokens=False).ids


def test_encode(spark):
    rows = corpus() + [(70, "long " * 400 + "x" * 900 + "<|endoftext|>" + "é" * 500, "s")] * 2 + [(71, "tail　<|startoftext|> İ", "s")]
    codec = bpe.Codec(queries.vocabulary())
    out = bpe.encode(docs(spark, rows), queries.vocabulary(), piece=100).collect()
    want = []
    for i, t, _ in rows:
        ids = codec.tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), codec.tok.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, ((r.doc_id, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in out))) == sorted(map(str, want))
    assert bpe.encode(docs(spark, rows).limit(0), queries.vocabulary()).count() == 0
