"""Operators 11 to 13 against brute force."""

import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from scripts.check_oracle import rows as table_rows

from markspark.llm import common, filter_audit, fm_index, queries, spelling, suffix_tree

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts(n=160, seed=4):
    rng = random.Random(seed)
    vocab = ["w" + c for c in "abcdefghijkl"]
    out, last = [], vocab[0]
    for _ in range(n):
        words = []
        for _ in range(rng.randint(1, 60)):
            # a chain: some words are nearly always followed by the next one, and "wa wb" by "wz"
            last = "wz" if words[-2:] == ["wa", "wb"] else vocab[(vocab.index(last) + 1) % 12] if last in vocab[:4] and rng.random() < 0.9 \
                else rng.choice(vocab)
            words.append(last if rng.random() < 0.97 else f"rare{rng.randint(0, 400)}")
        out.append(" ".join(words).upper() if rng.random() < 0.3 else "\t".join(words))
    return out


def _documents(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 1.0, "k") for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None), (3, texts[3 % len(texts)], "en", "s0", 1, 1.0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string")


# --- 11 ---

def _tokens(t):
    return [*WORD.findall((t or "").translate(LOW)), None]


def _model(training, depth):
    """Independent suffix tree over symbol tuples: {context: (total, rest, {symbol: n})} and P(symbol | history)."""
    seqs = [["<s>", *t] for t in training]
    c = Counter(x for s in seqs for x in s)
    begin = c.pop("<s>", 0)
    n, v = sum(c.values()), len(c)
    least = max(suffix_tree.LEAST_CONTEXT, math.ceil(math.sqrt(n) / suffix_tree.ROOT_SHARE))
    few = math.ceil(least / suffix_tree.COUNT_SHARE)
    seen = defaultdict(Counter)
    for s in seqs:
        for i in range(1, len(s)):
            for k in range(1, depth + 1):
                if i - k >= 0:
                    seen[tuple(s[i - k:i])][s[i]] += 1
    states = {}

    def p(symbol, history):
        for k in range(min(depth, len(history)), 0, -1):
            s = tuple(history[-k:])
            if s in states:
                total, rest, nxt = states[s]
                return (nxt.get(symbol, 0) + rest * p(symbol, list(s[1:]))) / (total + suffix_tree.MASS)
        return (c[symbol] + 1) / (n + v + 1)

    for k in range(1, depth + 1):
        new = {}
        for s, nxt in seen.items():
            total = (begin if s == ("<s>",) else c[s[0]]) if k == 1 else seen.get(s[:-1], {}).get(s[-1], 0)
            if len(s) != k or total < least:
                continue
            if k > 1 and (s[1:] not in states or s[:-1] not in states or states[s[:-1]][2].get(s[-1], 0) < least):
                continue
            kept = {x: m for x, m in nxt.items() if m >= few and (k == 1 and c[x] >= few or k > 1 and x in states[s[1:]][2])}
            if not kept:
                continue
            q = {x: p(x, list(s[1:])) for x in kept}
            other = total - sum(kept.values())
            gain = sum(m * math.log(m / total / q[x]) for x, m in kept.items())
            if other:
                gain += other * math.log(other / total / max(1 - sum(q.values()), 1e-12))
            if gain >= suffix_tree.GAIN * (len(kept) + 1):
                new[s] = (total, other + suffix_tree.MASS, kept)
        states |= new
    return states, p, c, n, v


@pytest.mark.parametrize("head", [1 << 21, 40, 0])
def test_scores_equal_an_independent_tree(spark, monkeypatch, head):
    monkeypatch.setattr(suffix_tree, "_SCORED", 64)
    texts = [*_texts(), "", None, "unseen words only", "wa wb wc", "wa wb wc"]
    docs = _documents(spark, texts).withColumn("learn", F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False)))
    tree = suffix_tree.fit(docs.filter("learn").select(F.coalesce("text", F.lit("")).alias("text")))
    out = suffix_tree.score(docs, tree, head=head).collect()
    rows = docs.select("doc_id", "text", "learn").collect()
    states, p, c, n, v = _model([_tokens(r.text) for r in rows if r.learn], suffix_tree.DEPTH)
    assert any(len(s) == 1 for s in states) and any(len(s) > 1 for s in states)
    assert len(out) == len(rows) and tree.tokens == n
    want = Counter()
    for r in rows:
        t = _tokens(r.text)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)
        score = sum(math.log10(p(x, ["<s>", *t[:i]])) for i, x in enumerate(t))
        want[(r.doc_id, len(t), sum(c[x] > 0 for x in t), round(base, 6), round(score, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in out) == want
    # every state's probabilities add to one, one unknown symbol included
    for s in list(states)[:20]:
        assert sum(p(x, list(s)) for x in [*c, "nowhere"]) == pytest.approx(1)


def test_score_of_empty_tables_and_without_training(spark):
    docs = _documents(spark, ["a b", None])
    none = suffix_tree.fit(docs.select("text").limit(0))
    out = suffix_tree.score(docs.withColumn("learn", F.lit(False)), none).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in out] == [(0, 0, 0.0, 0.0)] * 4
    assert sorted(r.n_tokens for r in out) == [1, 1, 3, 3]
    tree = suffix_tree.fit(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    assert suffix_tree.score(docs.withColumn("learn", F.lit(True)).limit(0), tree).count() == 0


def test_states_do_not_depend_on_the_size_of_the_corpus(spark):
    """Sixteen times are often enough for a context beside 40 and beside 4,400,000 other words."""
    pairs = spark.range(16).select(F.lit("ab cd").alias("text"))
    doc = spark.createDataFrame([(1, "ab cd", False)], "doc_id long, text string, learn boolean")
    for n in (10, 1_100_000):
        tree = suffix_tree.fit(pairs.union(spark.range(4).select(F.repeat(F.lit("x "), n))))
        assert tree.tokens == 16 * 3 + 4 * (n + 1)
        word = next(suffix_tree.row_words(pa.array(["ab"]), suffix_tree.NOT_SPACE))[2]
        state = int((word ^ suffix_tree._STATE).astype(np.int64)[0])
        assert [r.n for r in tree.terms.filter(F.col("key") == state).collect()] == [16]
        r = suffix_tree.score(doc, tree).first()
        assert r.score > r.base_score


def test_table_and_filter_find_all_keys(spark):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    other = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t = suffix_tree.Table(keys)
    assert (t.find(keys[::-1]) == np.arange(len(keys))[::-1]).all() and (t.find(other) == -1).all()
    f = suffix_tree.Filter(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"), bits=18)
    assert f(keys).all() and f(other).mean() < 0.01


def test_filter_grows_with_its_keys():
    """One size for any number of keys let one in seven of all other keys through beside 16 million."""
    assert suffix_tree.Filter.bits_for(0) == suffix_tree.Filter.bits_for(4_000_000) == suffix_tree.FILTER_BITS
    for n in (6_000_000, 16_000_000):
        assert (2 * n / 2 ** suffix_tree.Filter.bits_for(n)) ** 2 < 0.03
    assert suffix_tree.Filter.bits_for(10 ** 12) == suffix_tree.FILTER_MOST


@pytest.mark.parametrize("k, buckets", [(1, 1), (2, 7)])
def test_packed_counts_are_small_and_merge_to_the_exact_counts(k, buckets):
    rng = np.random.default_rng(5)
    words = np.append(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1), suffix_tree.END)
    want, rows, entries = Counter(), [], 0
    for _ in range(5):
        ctx, symbol = (words[(len(words) * rng.random(40_000) ** 3).astype(int)] for _ in range(2))
        symbol[::50] = suffix_tree.END
        suffix = suffix_tree.mix(ctx)
        want.update(zip(ctx.tolist(), symbol.tolist(), strict=True))
        key, where, n = np.unique(suffix_tree.join(ctx, symbol), return_index=True, return_counts=True)
        assert (suffix_tree.last(ctx[where], key) == symbol[where]).all()
        entries += len(key)
        rows += suffix_tree._packed(key, n, ctx[where], suffix[where], buckets)
    packed = pa.Table.from_batches(rows)
    if k == 1:  # by far the largest level; before, an entry's row held context, symbol and count: 18 bytes of each were shuffled
        size = sum(len(pa.compress(v.as_py(), "lz4", asbytes=True)) for c in packed.column_names[1:-1] for v in packed.column(c))
        assert size < 14 * entries
    got = {}
    for b in range(buckets):
        out = suffix_tree._merged(packed.filter(pc.equal(packed.column("bucket"), b)), k, 2).to_pydict()
        for c, key, parent, n, ends in zip(*out.values(), strict=True):
            c, key, parent = (np.array([x]).view(np.uint64) for x in (c, key, parent))
            x = suffix_tree.last(c, key)
            assert parent == (x if k == 1 else suffix_tree.join(suffix_tree.mix(c), x)) and ends == (x[0] == suffix_tree.END)
            assert (int(c[0]), int(x[0])) not in got
            got[int(c[0]), int(x[0])] = n
    assert got == {g: n for g, n in want.items() if n >= 2}


def test_training_and_look_ups_leave_no_shuffle_and_no_passing_table(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}

    docs = _documents(spark, _texts()).withColumn("learn", F.lit(True))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files, tables = spark.conf.get(setting), shuffled(), len(common._WRITTEN)
    tree = suffix_tree.fit(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    suffix_tree.score(docs, tree)
    assert spark.conf.get(setting) == before
    for _ in range(100):  # Spark deletes them on the side
        if not shuffled() - files:
            break
        time.sleep(0.1)
    assert not shuffled() - files
    passing = [p for _, p in common._WRITTEN[tables:] if "-next-" in p]
    assert passing and not any(os.path.exists(p.removeprefix("file:")) for p in passing)


def test_op11_query_on_held_out_documents(spark):
    out = queries.queries()["op11_lm_score"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rest = {i: zlib.crc32(str(i).encode()) % 7 for i in docs}
    c = Counter(x for i, t in docs.items() if rest[i] != 2 for x in _tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(out) == len(docs)
    for r in out:
        t = _tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest[r.doc_id] == 2, len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), abs=1e-6)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# --- 12 ---

def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("letters, size", [("abé", (1, 9)), ("ab", (2, 12)), ("abcdefgh", (6, 7)), ("a", (1, 20))])
def test_index_finds_all_words_at_one_error(letters, size):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(*size))) for _ in range(250)})
    asked = [*words, "abz", "zzzzzz", "q"]
    index = fm_index.Index(words)
    got = [(q, words[w]) for q, w in index.search(asked, True)]
    got += [(q, words[w]) for q, w in index.search(asked, False) if not words[w].startswith(q[:len(q) // 2])]
    assert sorted(got) == sorted((q, w) for q in asked for w in words if _near(q, w))


def _variants(counts):
    near = {w: sorted(x for x in counts if _near(w, x)) for w in counts}
    form = {}
    for w, ws in near.items():
        if ws:
            best = min(ws, key=lambda x: (-counts[x], x))
            if counts[best] >= 5 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


@pytest.mark.parametrize("per_block", [7, 40, 20_000])
def test_variants_equal_brute_force(spark, per_block):
    rng = random.Random(8)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(200)}
    words |= {"x" * 300, "x" * 299, "x" * 298 + "y", "abcdefghij" * 9, "abcdefghij" * 8 + "abcdefghi"}
    counts = {w: rng.choice([5, 6, 7, 30, 31, 200, 1000, 5000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, per_block).collect()}
    assert got == _variants(counts)
    assert any(v[0] is not None and v[0] != v[1] for v in got.values())  # forms that have forms


def _vocabulary(rows, every=199):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{i}:{w}".encode())
            c[w if i is None or h % every else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    return {w: n for w, n in c.items() if n >= 5 and len(w) >= 6}


def test_vocabulary_counts_runs(spark, monkeypatch):
    rng = random.Random(1)
    vocab = ["straße", "ÉTUDIANT", "abcdefg", "hijklmno", "Ünïcödé", "short", "aaaaaaa"]
    rows = [(i, " 1,".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(None, "abcdefg " * 7), (5, None), (6, ""), (7, "a" * 50), (8, "nolatin дом"), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for held, long in ((400_000, 1 << 20), (3, 10)):
        monkeypatch.setattr(spelling, "_HELD", held)
        monkeypatch.setattr(spelling, "_LONG", long)
        got = {r.word: r.n for r in spelling.vocabulary(df, every=7).collect()}
        assert got == _vocabulary(rows, 7)
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_op12_query_equals_brute_force(spark):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.queries()["op12_spelling"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == _variants(_vocabulary([(r.doc_id, r.text) for r in docs]))


# --- 13 ---

def test_audit_equals_running_the_filters(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(120):
        t = " ".join(rng.choice(words[: rng.choice([5, 300])]) for _ in range(rng.choice([3, 150, 201, 260])))
        texts.append((t.upper() if rng.random() < 0.2 else t) + ("#" if rng.random() < 0.3 else ""))
    texts += [texts[0], texts[0], texts[7], "", None, "", "x" * 100_000]
    rows = [(i, t, [None, "", "a", "b"][i % 4], i) for i, t in enumerate(texts)] + [(None, texts[0], "a", 0), (2, texts[2], "b", 0),
                                                                                  (2, texts[2], "b", 0), (2, texts[0], "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask int")
    marks = [(i, int(i % 2), int(i % 5 == 0)) for i in range(0, 100, 3)] + [(0, 1, 0), (3, None, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in
           filter_audit.audit(docs, labels, filter_audit.text_failures(F.col("__text"))).collect()}
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    first = {}
    for i, t, _, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))

    def fails(i, t):
        t = t or ""
        w = WORD.findall(t)
        return {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            re.search("[#$%&*|]", t) is not None, i is not None and i > first[t]), strict=True) if bad}

    failing = [(i, s or "", fails(i, t)) for i, t, s, _ in rows]
    want, removed_by = {}, Counter()
    for part in {"", "a", "b"}:
        mine = [(i, f) for i, s, f in failing if s == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed_by[part, x] += len(gone)
                want[part, "".join(order), step] = (len(left), len(gone), sum(x in f for _, f in mine) - len(gone),
                                                    sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone),
                                                    sum(i in toxic for i, _ in gone))
    want = {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert len(got) == 3 * 600 and got == want


def test_audit_without_repeats_and_on_empty_tables(spark):
    docs = spark.createDataFrame([(1, "#", "s"), (2, "#", "s"), (3, "ok", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    only = {"D": filter_audit.text_failures(F.col("__text"))["D"]}
    assert [tuple(r) for r in filter_audit.audit(docs, labels, only, None).collect()] == [("s", "D", 1, 1, 2, 0, 2, 0, 0, 2)]
    assert filter_audit.audit(docs.limit(0), labels, only).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {str(i): F.lit(True) for i in range(6)})


def test_op13_query_equals_duckdb(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op13_filter_audit"]).to_arrow_table()
    got = queries.queries()["op13_filter_audit"](spark, SF).toArrow()
    assert got.num_rows == want.num_rows > 0 and table_rows(got, 6) == table_rows(want, 6)
