"""Operator 1: toxicity by a bidirectional gated recurrent network in numpy.

A word's input is a hashed word vector beside the mean of the vectors of its
character 4-grams (with the word's start marked), so unseen forms of a known
stem still score. Two gated recurrent layers read a window forwards and
backwards, attention pools their states to one logit. A document is scored on
all windows of ``SPAN`` words that start every ``STRIDE`` words, so that every
passage of ``SPAN - STRIDE + 1`` words lies whole in one, and its score is that
of its most toxic window.

Training runs on the driver over a bounded sample: at most ``TOXIC_DOCS`` and
``CLEAN_DOCS`` labelled texts of up to ``TRAIN_CHARS`` characters, the first
in the order of a hash, one text for each id (the smallest, where an id
repeats). Labels name documents, not windows, so training
learns from the windows that score highest in their documents. Scoring reads
whole texts and runs in the scan; words are looked up per distinct word.

Defined results: a null text, or one without words, scores 0.0. Scores depend
on the text alone, not on the rows around it. With only one label value in the
sample every score is that value's share, cut to [0.01, 0.99].
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.words import ALNUM, LOWER, PIECE, column_bytes, mix, pieces, span_hashes, word_spans

SPAN, STRIDE = 32, 16
TOXIC_DOCS, CLEAN_DOCS, TRAIN_CHARS = 800, 1200, 12_000
STEPS, BATCH, RATE = 360, 32, 0.01
#: Steps in which any window stands for its document, before the highest ones do.
BLIND = 40
WORD_BITS, CHAR_BITS, DIM, HIDDEN = 15, 14, 16, 8
_GROUP = 4096


def _lower(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters to lower case in UTF-8 bytes."""
    low = LOWER[raw]
    if len(low) > 1:
        at = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)) + 1
        low[at] += 0x20
    return low


class Words:
    """The distinct words of a piece of text: word buckets, character gram buckets, and each word's place."""

    def __init__(self, raw: np.ndarray, row_ends: np.ndarray):
        low = _lower(raw)
        start, end = word_spans(low, row_ends, ALNUM)
        self.row_at = np.searchsorted(start, np.concatenate([[0], row_ends]))
        if not len(start):
            self.word, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.gram, self.gram_at = np.zeros(0, np.int64), np.zeros(1, np.int64)
            return
        h = span_hashes(low, start, end)
        h, first, self.place = np.unique(h, return_index=True, return_inverse=True)
        self.word = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        s, e = start[first], end[first]
        n = np.maximum(e - s - 2, 1)
        self.gram_at = np.concatenate([[0], np.cumsum(n)])
        own = np.repeat(np.arange(len(n)), n)
        pos = s[own] - 1 + (np.arange(len(own)) - self.gram_at[own])
        code = np.zeros(len(own), np.uint64)
        for i in range(4):
            at = pos + i
            inside = (at >= s[own]) & (at < e[own])
            code = code << np.uint64(8) | np.where(inside, low[np.clip(at, 0, len(low) - 1)], 0).astype(np.uint64)
        self.gram = (mix(code) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of every window of rows with ``n_words`` words; rows without words have none."""
    n = np.where(n_words > 0, np.maximum(-(-(n_words - SPAN) // STRIDE), 0) + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters in ``p``; inputs are distinct words, windows are rows of word places (-1: none)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def normal(*shape, by):
            return (rng.standard_normal(shape) * by).astype(np.float32)

        self.p = {"word": normal(1 << WORD_BITS, DIM, by=0.03), "char": normal(1 << CHAR_BITS, DIM, by=0.03),
                  "att": normal(2 * HIDDEN, HIDDEN, by=0.3), "att_v": normal(HIDDEN, by=0.3),
                  "out": normal(2 * HIDDEN, by=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"in_{d}"] = normal(2 * DIM, 3 * HIDDEN, by=0.3)
            self.p[f"b_{d}"] = np.zeros(3 * HIDDEN, np.float32)
            self.p[f"rec_{d}"] = normal(HIDDEN, 3 * HIDDEN, by=0.3)

    def inputs(self, w: Words) -> np.ndarray:
        x = np.zeros((len(w.word), 2 * DIM), np.float32)
        if len(w.word):
            x[:, :DIM] = self.p["word"][w.word]
            x[:, DIM:] = np.add.reduceat(self.p["char"][w.gram], w.gram_at[:-1]) / np.diff(w.gram_at)[:, None]
        return x

    def forward(self, x: np.ndarray, places: np.ndarray, keep: bool = False):
        """Logit of every window (and what the backward pass needs)."""
        n, t_max = places.shape
        there = (places >= 0).astype(np.float32)
        states = np.zeros((n, t_max, 2 * HIDDEN), np.float32)
        saved = {}
        for d in "fb":
            given = x @ self.p[f"in_{d}"] + self.p[f"b_{d}"]
            by_step = np.ascontiguousarray(places.T)
            rec, h = self.p[f"rec_{d}"], np.zeros((n, HIDDEN), np.float32)
            steps = range(t_max) if d == "f" else range(t_max - 1, -1, -1)
            at = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            saved[d] = {}
            for t in steps:
                g, u = given[by_step[t]], h @ rec
                zr = _sigmoid(g[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                un = u[:, 2 * HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN:] + r * un)
                new = h + there[:, t, None] * (1 - z) * (c - h)
                if keep:
                    saved[d][t] = h, z, r, c, un
                h = new
                states[:, t, at] = h
        hid = np.tanh(states @ self.p["att"])
        e = hid @ self.p["att_v"] + (there - 1) * 1e9
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", a, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (there, states, hid, a, pooled, saved)) if keep else logit

    def backward(self, w: Words, x: np.ndarray, places: np.ndarray, cache, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        there, states, hid, a, pooled, saved = cache
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = pooled.T @ d_logit
        g["bias"][0] = d_logit.sum()
        d_pooled = d_logit[:, None] * self.p["out"]
        d_states = a[:, :, None] * d_pooled[:, None]
        d_a = np.einsum("nk,ntk->nt", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["att_v"] = np.einsum("nt,ntk->k", d_e, hid)
        d_hid = d_e[:, :, None] * self.p["att_v"] * (1 - hid ** 2)
        g["att"] = np.einsum("ntk,ntj->kj", states, d_hid)
        d_states += d_hid @ self.p["att"].T
        d_x = np.zeros_like(x)
        t_max = places.shape[1]
        for d in "fb":
            rec = self.p[f"rec_{d}"]
            at = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            d_given = np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(places), HIDDEN), np.float32)
            for t in (range(t_max - 1, -1, -1) if d == "f" else range(t_max)):
                h, z, r, c, un = saved[d][t]
                d_h = d_h + d_states[:, t, at]
                m = there[:, t, None]
                d_c = d_h * m * (1 - z) * (1 - c ** 2)
                d_z = -d_h * m * (c - h) * z * (1 - z)
                d_r = d_c * un * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_c * r], 1)
                d_g = np.concatenate([d_z, d_r, d_c], 1)
                g[f"rec_{d}"] += h.T @ d_u
                np.add.at(d_given, places[:, t], d_g * m)
                d_h = d_h * (1 - m * (1 - z)) + d_u @ rec.T
            g[f"in_{d}"] = x.T @ d_given
            g[f"b_{d}"] = d_given.sum(0)
            d_x += d_given @ self.p[f"in_{d}"].T
        np.add.at(g["word"], w.word, d_x[:, :DIM])
        n = np.diff(w.gram_at)
        np.add.at(g["char"], w.gram, np.repeat(d_x[:, DIM:] / n[:, None], n, axis=0))
        return g

    def logits(self, x: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What :meth:`forward` gives, with the windows along the last axis and without new arrays in its loop."""
        n, t_max = places.shape
        there = np.ascontiguousarray((places >= 0).T.astype(np.float32))
        at = np.ascontiguousarray(places.T)
        states = np.empty((t_max, 2 * HIDDEN, n), np.float32)
        g, u = np.empty((3 * HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32)
        step, two = np.empty((HIDDEN, n), np.float32), 2 * HIDDEN
        half = np.concatenate([np.full(two, 0.5), np.ones(HIDDEN)]).astype(np.float32)  # sigmoid(x) = (tanh(x / 2) + 1) / 2
        for d in "fb":
            given = np.ascontiguousarray(((x @ self.p[f"in_{d}"] + self.p[f"b_{d}"]) * half).T)
            rec = np.ascontiguousarray((self.p[f"rec_{d}"] * half).T)
            h = np.zeros((HIDDEN, n), np.float32)
            own = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, two)
            for t in (range(t_max) if d == "f" else range(t_max - 1, -1, -1)):
                np.take(given, at[t], axis=1, out=g, mode="wrap")
                np.matmul(rec, h, out=u)
                zr = np.add(g[:two], u[:two], out=g[:two])
                np.tanh(zr, out=zr)
                c, un = g[two:], u[two:]
                zr[HIDDEN:] += 1
                un *= zr[HIDDEN:]
                un *= 0.5
                c += un
                np.tanh(c, out=c)
                np.subtract(1, zr[:HIDDEN], out=step)
                step *= 0.5 * there[t]
                c -= h
                step *= c
                h += step
                states[t, own] = h
        hid = np.matmul(self.p["att"].T, states)
        np.tanh(hid, out=hid)
        e = np.einsum("k,tkn->tn", self.p["att_v"], hid) + (there - 1) * 1e9
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        return np.einsum("k,tkn,tn->n", self.p["out"], states, a, optimize=["einsum_path", (0, 1), (0, 1)]) + self.p["bias"][0]

    def document_logits(self, raw: np.ndarray, row_ends: np.ndarray) -> np.ndarray:
        """Highest window logit of every row (-inf without words)."""
        w = Words(raw, row_ends)
        best = np.full(len(row_ends), -np.inf)
        row, places = _window_places(w)
        x = self.inputs(w)
        for a in range(0, len(row), _GROUP):
            np.maximum.at(best, row[a:a + _GROUP], self.logits(x, places(a, a + _GROUP)))
        return best


def _window_places(w: Words):
    """Row of every window, and a function giving the word places of windows [a, b)."""
    row, first = windows(np.diff(w.row_at))
    begin, end = w.row_at[row] + first, w.row_at[row + 1]

    def places(a, b):
        at = begin[a:b, None] + np.arange(SPAN)[None]
        ok = at < end[a:b, None]
        return np.where(ok, w.place[np.minimum(at, len(w.place) - 1)], -1)

    return row, places


def train(texts: list[str], labels: np.ndarray, seed: int = 3) -> Network:
    """A network fitted on labelled texts."""
    net, rng = Network(seed), np.random.default_rng(seed)
    col = pa.array(texts, pa.large_string())
    data, off = column_bytes(col)
    docs = [Words(data[off[i]:off[i + 1]], np.array([off[i + 1] - off[i]])) for i in range(len(texts))]
    usable = [i for i, w in enumerate(docs) if len(w.word)]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    pos, neg = [i for i in usable if labels[i]], [i for i in usable if not labels[i]]
    order = np.zeros(0, np.int64)
    while step < STEPS:
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(pos + neg)])
        batch, order = order[:BATCH], order[BATCH:]
        w = _join([docs[i] for i in batch.tolist()])
        x = net.inputs(w)
        row, places = _window_places(w)
        places = places(0, len(row))
        y = labels[batch][row].astype(np.float32)
        # before anything is known any window may stand for its document
        rank_by = rng.random(len(row)) if step < BLIND else np.concatenate(
            [net.logits(x, places[a:a + _GROUP]) for a in range(0, len(row), _GROUP)])
        order_in = np.lexsort((-rank_by, row))
        place_in = np.empty(len(row), np.int64)
        place_in[order_in] = np.arange(len(row)) - np.searchsorted(row, row)[order_in]
        take = np.flatnonzero(place_in < np.where(step < BLIND, 4, np.where(y == 1, 1, 3)))
        places, y = places[take], y[take]
        wt = (1 / np.bincount(row[take], minlength=len(batch)))[row[take]] if len(take) else np.zeros(0)
        logit, cache = net.forward(x, places, keep=True)
        grad = net.backward(w, x, places, cache, ((_sigmoid(logit) - y) * wt / len(batch)).astype(np.float32))
        step += 1
        rate = RATE * min(1, 2 * (1 - (step - 1) / STEPS)) / (1 - 0.9 ** step)
        for k, gk in grad.items():
            at = {"word": w.word, "char": w.gram}.get(k)
            at = slice(None) if at is None else np.unique(at)  # rows of a table that the batch uses
            m[k][at] += 0.1 * (gk[at] - m[k][at])
            v[k][at] += 0.001 * (gk[at] ** 2 - v[k][at])
            net.p[k][at] -= rate * m[k][at] / (np.sqrt(v[k][at] / (1 - 0.999 ** step)) + 1e-8)
    return net


def _join(parts: list[Words]) -> Words:
    """Several texts' words as one table, one row a text."""
    w = Words.__new__(Words)
    shift = np.cumsum([0, *(len(p.word) for p in parts)])
    grams = np.cumsum([0, *(len(p.gram) for p in parts)])
    rows = np.cumsum([0, *(len(p.place) for p in parts)])
    w.word, w.gram = np.concatenate([p.word for p in parts]), np.concatenate([p.gram for p in parts])
    w.gram_at = np.concatenate([p.gram_at[:-1] + g for p, g in zip(parts, grams[:-1], strict=True)] + [grams[-1:]])
    w.place = np.concatenate([p.place + s for p, s in zip(parts, shift[:-1], strict=True)])
    w.row_at = rows
    return w


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled texts: the first of each label in the order of a hash of the id."""
    order = F.xxhash64("doc_id")
    ids = None
    for y, n in ((1, TOXIC_DOCS), (0, CLEAN_DOCS)):
        own = (labels.filter(F.col("toxic") == y).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(y).alias("y")).distinct()
               .filter("doc_id is not null").orderBy(order, "doc_id").limit(n))
        ids = own if ids is None else ids.unionByName(own)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
            .filter(F.length("text") <= TRAIN_CHARS)
            .groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect())  # bounded by the two numbers and TRAIN_CHARS
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], np.array([r.y for r in rows], np.int64)


def scores(docs: DataFrame, net: Network | float) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text)``."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            s = np.zeros(batch.num_rows)
            for a, b in pieces(off, PIECE):
                if isinstance(model, float):
                    s[a:b] = model
                else:
                    s[a:b] = _row_scores(model, data, off, a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def _row_scores(net: Network, data, off, a: int, b: int) -> np.ndarray:
    """Scores of rows [a, b), which are at most a piece long, or of one longer row."""
    if b > a + 1 or off[b] - off[a] <= 4 * PIECE:
        logit = net.document_logits(data[off[a]:off[b]], off[a + 1:b + 1] - off[a])
    else:  # a very long text: parts that share SPAN words or more at their seams
        at, best = int(off[a]), -np.inf
        while at < off[b]:
            to = min(at + PIECE, int(off[b]))
            best = max(best, float(net.document_logits(data[at:to], np.array([to - at]))[0]))
            at = to if to == off[b] else to - 8192
        logit = np.array([best])
    return np.where(np.isfinite(logit), np.round(_sigmoid(np.where(np.isfinite(logit), logit, 0.0)), 6), 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Network | float:
    """The network for labelled documents (a constant where the sample has only one label value)."""
    texts, y = training_sample(docs, labels)
    if len(set(y.tolist())) < 2:
        return float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    return train(texts, y)
