"""Operator 11: language-model scoring with a probabilistic suffix tree.

A text's symbols are its words and one end. The tree's states are contexts of
1 to ``DEPTH`` preceding symbols (a begin mark stands before the first word).

Training goes level by level, each level one scan and one aggregation:

* Candidates of level 1 are the words (and the begin mark) seen ``LEAST_CONTEXT``
  times or more (the same count for a corpus of any size), those of level k the
  contexts seen as often that are a state without their oldest and without their newest
  symbol. What follows a candidate is counted; what follows it often enough
  (an eighth of that count) is one of its explicit next symbols.
* Divergence test: with n of a context's N next symbols explicit, each symbol's
  share is compared with its probability at the parent (the context without its
  oldest symbol), all other symbols being one class. The context is retained as
  a state if N times this Kullback-Leibler divergence (a lower bound of the
  full one) is ``GAIN`` nats or more for each class.
* Smoothing: P(x | s) = (n(s, x) + (N - N' + MASS) P(x | parent)) / (N + MASS)
  with N' the explicit symbols' total; at the root P(x) = (c(x) + 1) / (N + V + 1),
  one unknown symbol included. All probabilities of a state add to one.

Scoring: a position's probability is that of its longest suffix that is a
state. Its logarithm is a sum of terms of single keys - of the word, of each
state on the path to the longest one, of each state's explicit next symbol -
so a text's score is a sum of looked-up terms. The ``HEAD`` keys seen most often
(a table of bounded size, and with them every hot key) are looked up in the
scan; all others are joined: in the same scan a Bloom filter of the remaining
keys picks the occurrences, which are shuffled by key. Nothing is left out at any size; larger
corpora only join a larger part.

Words are 64-bit hashes. Nothing but the head, the filters (bounded) and a few
totals passes through the driver.

Defined results: a null text is an empty one and has one token, its end; rows
that repeat are scored one by one; a row with a null id is held out of
training only if the caller's ``learn`` column says so (null: not learned
from); without any training row every token has probability 1 / 1 of the one
unknown symbol, so every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import delete_path, give_back, giving_back, hashed_blocks, scratch_path, shuffles_deleted, stored
from markspark.llm.words import NOT_SPACE, mix, row_words

DEPTH = 3
#: A candidate was seen LEAST_CONTEXT times, a context's explicit symbol COUNT_SHARE times less often.
LEAST_CONTEXT, COUNT_SHARE = 16, 8
#: sqrt(training tokens) / ROOT_SHARE, the least count that grew with the corpus, is none: the model has one rule at every size.
ROOT_SHARE = inf
GAIN = 2.0
MASS = 16.0
#: Keys in the broadcast table (20 bytes each).
HEAD = 1 << 21
#: Bits of each filter, doubled up to so many until a key has KEY_BITS; a fuller filter lets more through to the exact joins.
FILTER_BITS, FILTER_MOST, KEY_BITS = 26, 28, 12
#: Symbols that a task counts, and scores, at a time.
_CHUNK, _SCORED = 1 << 21, 1 << 17
#: Training tokens for which one group of counts is merged.
_BUCKET = 1 << 21
#: Shares of the documents scored one after the other; the files of one's join are deleted before the next.
_SHARES = 3

BEGIN, END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Inverses of mix's factors modulo 2^64.
_BACK = [np.uint64(pow(f, -1, 1 << 64)) for f in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]
#: What a key is for: the word itself, a state, or a state's next symbol.
_WORD, _STATE, _NEXT = np.uint64(0), np.uint64(0x510E527FADE682D1), np.uint64(0x9B05688C2B3E6C1F)


def join(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Key of a context followed by a symbol."""
    return mix(context * _STEP + symbol)


def last(context: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The symbol of ``key = join(context, symbol)``."""
    h = (key ^ (key >> np.uint64(32))) * _BACK[0]
    h = (h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))) * _BACK[1]
    return (h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))) - context * _STEP


def symbols(col, size: int = _CHUNK):
    """(first row, rows' starts, symbols) for runs of rows of a text column: each row's begin mark, words and end."""
    def out():
        return first, np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.concatenate(parts)

    lengths, parts, first, held = [], [], 0, 0
    for a, off, h in row_words(col, NOT_SPACE):
        n = np.diff(off) + 2
        ends = np.cumsum(n)
        part, word = np.empty(ends[-1], np.uint64), np.ones(ends[-1], bool)
        word[ends - n] = word[ends - 1] = False
        part[word], part[ends - n], part[ends - 1] = h[off[0]:off[-1]], BEGIN, END
        lengths.append(n)
        parts.append(part)
        held += len(part)
        if held >= size:
            yield out()
            lengths, parts, first, held = [], [], a + len(n), 0
    if parts:
        yield out()


def paths(starts: np.ndarray, s: np.ndarray, depth: int):
    """The scored positions (all but the begin marks) and, for k = 1 to depth, (which positions have k symbols before
    them, key of these, key of these with the position's symbol)."""
    at = np.ones(len(s), bool)
    at[starts[:-1]] = False
    at = np.flatnonzero(at)
    begin = np.repeat(starts[:-1], np.diff(starts) - 1)
    levels, context, whole = [], s, s
    for k in range(1, depth + 1):
        whole = np.concatenate([whole[:1], join(whole[:-1], s[1:])])  # keys of k + 1 symbols, right from k + 1 symbols on
        has = np.flatnonzero(at - begin >= k)
        p = at[has]
        levels.append((has, context[p - 1], whole[p]))
        context = whole
    return at, levels


class Filter:
    """Bloom filter of 64-bit keys with two bits a key, made by a distributed aggregation."""

    def __init__(self, keys: DataFrame, bits: int | None = None, n: int | None = None):
        """``bits``: of the filter, or else as ``n`` keys need (counted if not given)."""
        bits = bits or self.bits_for(keys.count() if n is None else n)
        self.mask = np.uint64((1 << bits) - 1)
        mask, part = self.mask, min(1 << bits, 1 << 19) // 64  # words of a part: each is merged on its own

        def run(batches):
            words = np.zeros(1 << bits - 6, np.uint64)
            for b in batches:
                for by in (5, 33):
                    at = _unsigned(b.column(0)) >> np.uint64(by) & mask
                    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            words = words.reshape(-1, part)
            some = np.flatnonzero(words.any(1))
            for at in np.split(some, range(32, len(some), 32)):  # 2 MB at a time
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([words[i].tobytes() for i in at], pa.binary())],
                                                 names=["part", "words"])

        def merge(table: pa.Table) -> pa.Table:
            words = np.bitwise_or.reduce([np.frombuffer(w.as_py(), np.uint64) for w in table.column("words")])
            return pa.Table.from_arrays([table.column("part").slice(0, 1), pa.array([words.tobytes()], pa.binary())], names=["part", "words"])

        kind = "part int, words binary"
        found = keys.select("key").mapInArrow(giving_back(run), kind).groupBy("part").applyInArrow(merge, kind).toArrow()  # 2^bits / 8 bytes at most
        self.words = np.zeros(1 << bits - 6, np.uint64)
        for i, words in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            self.words[i * part:(i + 1) * part] = np.frombuffer(words, np.uint64)

    @staticmethod
    def bits_for(n: int) -> int:
        return min(max(FILTER_BITS, (KEY_BITS * n).bit_length()), FILTER_MOST)

    def _bit(self, keys: np.ndarray, by: int) -> np.ndarray:
        b = keys >> np.uint64(by) & self.mask
        return (self.words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = self._bit(keys, 5)
        some = np.flatnonzero(out)
        out[some] = self._bit(keys[some], 33)
        return out


class Table:
    """Sorted 64-bit keys, found by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(keys)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        out = np.full(len(keys), -1, np.int32)
        lead = (keys >> self.shift).astype(np.int64)
        at, end, left = self.first[lead], self.first[lead + 1], np.arange(len(keys))
        while len(left):
            go = at < end
            at, end, left = at[go], end[go], left[go]
            hit = self.keys[at] == keys[left]
            out[left[hit]] = at[hit]
            at, end, left = at[~hit] + 1, end[~hit], left[~hit]
        return out


def _longs(*columns: np.ndarray) -> list:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def _unsigned(col) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).view(np.uint64)


def _gathered(batches, chunk: int):
    """A task's rows as symbol runs of about ``chunk`` symbols."""
    starts, held, size = [np.zeros(1, np.int64)], [], 0
    for batch in batches:
        for _, o, s in symbols(batch.column(0)):
            starts.append(o[1:] + size)
            held.append(s)
            size += len(s)
            if size >= chunk:
                yield np.concatenate(starts), np.concatenate(held)
                starts, held, size = [np.zeros(1, np.int64)], [], 0
    if held:
        yield np.concatenate(starts), np.concatenate(held)


def count_symbols(texts: DataFrame, chunk: int = _CHUNK) -> DataFrame:
    """(key, n) of every symbol of ``texts(text)``, begin marks included."""
    def run(batches):
        for _, s in _gathered(batches, chunk):
            yield pa.RecordBatch.from_arrays(_longs(*np.unique(s, return_counts=True)), names=["key", "n"])

    return texts.mapInArrow(giving_back(run), "key long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


def _planes(x: np.ndarray) -> bytes:
    """A column's bytes, the first of every number before the second of any: small and sorted numbers then compress well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplaned(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Ascending numbers as their differences."""
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(data), dtype=np.uint64)


#: A task's counts that go to one bucket: ascending keys, their numbers, their contexts' places among the contexts held, these
#: and their suffixes.
_PACKED = "bucket int, keys binary, n binary, place binary, contexts binary, suffixes binary"


def _packed(key: np.ndarray, n: np.ndarray, ctx: np.ndarray, suffix: np.ndarray, buckets: int):
    """Record batches of ``_PACKED`` for ascending keys, dealt to the buckets by their leading bits."""
    cut = np.searchsorted(((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    rows, held = [], 0
    for b in np.flatnonzero(np.diff(cut)):
        at = slice(cut[b], cut[b + 1])
        contexts, where, place = np.unique(ctx[at], return_index=True, return_inverse=True)
        rows.append((int(b), _steps(key[at]), _planes(n[at].astype(np.uint64)), _planes(place.astype(np.uint32)), _steps(contexts),
                     _planes(suffix[at][where])))
        held += cut[b + 1] - cut[b]
        if held >= 1 << 18 or cut[b + 1] == len(key):
            kinds = [pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["bucket", "keys", "n", "place", "contexts", "suffixes"])
            rows, held = [], 0


def _merged(table: pa.Table, k: int, least: int) -> pa.Table:
    """One bucket's (ctx, key, parent, n, ends) of the keys counted ``least`` times or more."""
    keys, n, ctx, suffix = [], [], [], []
    for r in range(table.num_rows):
        row = [table.column(c)[r].as_py() for c in ("keys", "n", "place", "contexts", "suffixes")]
        place = _unplaned(row[2], np.uint32)
        keys.append(_unstepped(row[0]))
        n.append(_unplaned(row[1]))
        ctx.append(_unstepped(row[3])[place])
        suffix.append(_unplaned(row[4])[place])
    keys, n, ctx, suffix = (np.concatenate(x) for x in (keys, n, ctx, suffix))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.add.reduceat(n[order], first)
    often = np.flatnonzero(n >= least)
    key, where = keys[first[often]], order[first[often]]
    symbol = last(ctx[where], key)
    parent = symbol if k == 1 else join(suffix[where], symbol)
    return pa.Table.from_arrays([*_longs(ctx[where], key, parent, n[often]), pa.array(symbol == END)],
                                names=["ctx", "key", "parent", "n", "ends"])


def count_level(texts: DataFrame, k: int, contexts, parents, least: int, buckets: int = 1, chunk: int = _CHUNK) -> DataFrame:
    """(ctx, key, parent, n, ends) of the symbols seen ``least`` times or more after contexts of k symbols: the keys of the
    context and of its parent with the symbol, whether that is an end. ``contexts`` has the contexts' broadcast filter and
    ``parents`` that of the parents' explicit symbols; each of the ``buckets`` is merged as one group, so their number
    follows the corpus."""
    def run(batches):
        for starts, s in _gathered(batches, chunk):
            at, levels = paths(starts, s, k)
            has, ctx, key = levels[-1]
            ok = np.flatnonzero(contexts.value(ctx))
            if k == 1:
                suffix, parent = np.zeros(len(has), np.uint64), s[at[has]]
            else:
                longer = np.zeros(len(at), bool)
                longer[has] = True
                longer = np.flatnonzero(longer[levels[-2][0]])
                suffix, parent = levels[-2][1][longer], levels[-2][2][longer]
            ok = ok[parents.value(parent[ok])]
            key, where, n = np.unique(key[ok], return_index=True, return_counts=True)
            ctx, suffix = ctx[ok[where]], suffix[ok[where]]
            del at, levels, has, parent, ok, where
            yield from _packed(key, n, ctx, suffix, buckets)

    def merge(table: pa.Table) -> pa.Table:
        out = _merged(table, k, least)
        give_back()
        return out

    # a task's counts are summed already: they are dealt at once, a bucket's share of them as one row
    return texts.mapInArrow(giving_back(run), _PACKED).groupBy("bucket").applyInArrow(
        merge, "ctx long, key long, parent long, n long, ends boolean")


def _grow(grams: DataFrame, candidates: DataFrame, parents: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """States (ctx, suffix, total, rest) among ``candidates(ctx, suffix, total)``, and their explicit symbols
    (key, parent, n, ends, add, p) with the term and the smoothed probability of each."""
    spark = grams.sparkSession
    path = scratch_path(spark, f"{name}-next")
    known = grams.join(parents.select(F.col("key").alias("parent"), F.col("p").alias("p_parent")), "parent")
    known.write.parquet(path)
    known = spark.read.schema(known.schema).parquet(path)
    n, total, p = F.col("n"), F.col("total"), F.col("p_parent")
    # the sum of n log(n / total / p): a context's total is joined to its sums only
    sums = known.groupBy("ctx").agg(F.sum("n").alias("explicit"), F.count(F.lit(1)).alias("classes"), F.sum(n * F.log(n / p)).alias("nlogn"),
                                    F.sum("p_parent").alias("mass")).join(candidates, "ctx")
    other = F.col("total") - F.col("explicit")
    gain = F.col("nlogn") - F.col("explicit") * F.log(total)
    gain += F.when(other > 0, other * F.log(other / F.col("total") / F.greatest(1 - F.col("mass"), F.lit(1e-12)))).otherwise(0.0)
    states = stored(sums.filter(gain >= GAIN * (F.col("classes") + 1))
                    .select("ctx", "suffix", "total", (other + F.lit(MASS)).alias("rest")), f"{name}-states")
    smooth = (n + F.col("rest") * p) / (total + F.lit(MASS))
    explicit = stored(known.join(states.select("ctx", "total", "rest"), "ctx").select(
        "key", "parent", "n", "ends", F.log10(1 + n / (F.col("rest") * p)).alias("add"), smooth.alias("p")), f"{name}-explicit")
    delete_path(spark, path)
    return states, explicit


class Tree:
    """A trained tree: ``terms(key, n, add, known)``, the term of every word (known), state and explicit symbol, over stored
    tables; the training tokens and the root's normaliser."""

    def __init__(self, terms: DataFrame, tokens: int, norm: int):
        self.terms, self.tokens, self.norm = terms, tokens, norm


def _tagged(col: str, tag: np.uint64) -> Column:
    return F.col(col).bitwiseXOR(F.lit(int(tag.astype(np.int64))))


def fit(texts: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree of ``texts(text)``."""
    with shuffles_deleted(texts.sparkSession):
        return _fit(texts, depth)


def _fit(texts: DataFrame, depth: int) -> Tree:
    share = texts.sparkSession.sparkContext.broadcast
    begin, end = int(BEGIN.astype(np.int64)), int(END.astype(np.int64))
    seen = stored(count_symbols(texts), "symbols")
    tokens, types = seen.filter(F.col("key") != begin).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    norm = tokens + types + 1
    root = seen.filter(F.col("key") != begin).select("key", "n", ((F.col("n") + 1) / F.lit(float(norm))).alias("p"))
    least, few = LEAST_CONTEXT, ceil(LEAST_CONTEXT / COUNT_SHARE)
    terms = root.select(_tagged("key", _WORD).alias("key"), "n", F.log10(F.col("n") + 1.0).alias("add"), F.lit(True).alias("known"))
    candidates = seen.filter((F.col("n") >= least) & (F.col("key") != end)).select(
        F.col("key").alias("ctx"), F.lit(None).cast("long").alias("suffix"), F.col("n").alias("total"))
    parents = root.filter(F.col("n") >= few)
    for k in range(1, depth + 1):
        filters = [share(Filter(candidates.select(F.col("ctx").alias("key")))), share(Filter(parents.select("key")))]
        grams = count_level(texts, k, *filters, few, hashed_blocks(tokens, _BUCKET))
        states, explicit = _grow(grams, candidates, parents, f"level{k}")
        for f in filters:
            f.destroy()
        terms = terms.unionByName(states.select(
            _tagged("ctx", _STATE).alias("key"), F.col("total").alias("n"),
            F.log10(F.col("rest") / (F.col("total") + F.lit(MASS))).alias("add"), F.lit(False).alias("known")))
        terms = terms.unionByName(explicit.select(_tagged("key", _NEXT).alias("key"), "n", "add", F.lit(False).alias("known")))
        if k == depth or not states.limit(1).count():
            break
        # a longer context ends in a state: it is an explicit symbol of a state, and without its oldest symbol one too
        longer = explicit.filter((F.col("n") >= least) & ~F.col("ends"))
        candidates = stored(longer.join(states.select(F.col("ctx").alias("parent")), "parent", "left_semi").select(
            F.col("key").alias("ctx"), F.col("parent").alias("suffix"), F.col("n").alias("total")), f"level{k}-longer")
        parents = explicit.select("key", "p")
    return Tree(terms, tokens, norm)


class Head:
    """The terms of the keys seen most often. No state or explicit symbol is seen more often than the context that it
    extends, so if it is here, so is that."""

    def __init__(self, terms: DataFrame, size: int = HEAD):
        bin_ = F.floor(F.log2(F.col("n") + 0.0) * 16)
        counts = sorted(terms.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)  # 1,024 rows at most
        least, held = None, 0
        for r in counts:
            held += r.n
            if held > size:
                break
            least = r.b
        #: How many keys are outside.
        self.left = sum(r.n for r in counts) - sum(r.n for r in counts if least is not None and r.b >= least)
        self.inside = bin_ >= least if least is not None else F.lit(False)
        found = terms.filter(self.inside).select("key", "add").toArrow()
        key = found.column(0).to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.table, self.add = Table(key[order]), found.column(1).to_numpy()[order]


def _looked_up(starts: np.ndarray, s: np.ndarray, depth: int, table: Table, rest=None):
    """(kind, row of each key, key, its place in ``table`` or -1, whether ``rest`` may have it) for every key that may have a
    term: words, contexts as long as they are states, states with their symbol."""
    at, levels = paths(starts, s, depth)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts) - 1)

    def look(tag, row, keys):
        place = table.find(keys)
        maybe = np.zeros(len(keys), bool)
        if rest is not None:
            left = np.flatnonzero(place < 0)
            maybe[left] = rest(keys[left])
        return tag, row, keys, place, maybe

    yield look(_WORD, row, s[at] ^ _WORD)
    state = np.ones(len(at), bool)
    for has, ctx, key in levels:
        go = np.flatnonzero(state[has])
        has, ctx, key = has[go], ctx[go], key[go]
        found = look(_STATE, row[has], ctx ^ _STATE)
        yield found
        go = np.flatnonzero((found[3] >= 0) | found[4])
        state[:] = False
        state[has[go]] = True
        yield look(_NEXT, row[has[go]], key[go] ^ _NEXT)


def score(docs: DataFrame, tree: Tree, depth: int = DEPTH, head: int = HEAD) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs(doc_id, text, learn)``."""
    spark = docs.sparkSession
    with shuffles_deleted(spark):
        top = Head(tree.terms, head)
        rest = tree.terms.filter(~top.inside).select("key", F.col("add").alias("term"), F.col("known").alias("is_word"))
        shared = spark.sparkContext.broadcast((top.table, top.add, Filter(rest.select("key"), n=top.left)))
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "learn", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text", "learn").alias("id"))

    def scan(batches):
        """A row for every document, with its terms in the head, and one for every other key that it may have a term of."""
        table, add, rest_ = shared.value
        for b in batches:
            for first, starts, s in symbols(b.column(2), _SCORED):
                n = len(starts) - 1
                total, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
                rows, others = [], []
                for tag, row, keys, place, maybe in _looked_up(starts, s, depth, table, rest_):
                    hit = np.flatnonzero(place >= 0)
                    at, terms = row[hit], add[place[hit]]
                    total += np.bincount(at, terms, n)
                    if tag == _WORD:
                        base += np.bincount(at, terms, n)
                        known += np.bincount(at, minlength=n)
                    rows.append(row[maybe])
                    others.append(keys[maybe])
                row, key = np.concatenate(rows), np.concatenate(others)
                _, where, times = np.unique(join(row.astype(np.uint64), key), return_index=True, return_counts=True)
                where, times = (x[np.argsort(row[where], kind="stable")] for x in (where, times))
                part = b.slice(first, n)
                ids = part.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
                # a document's own row has a key that no term has, another one for each copy
                own = _longs(join(ids, np.arange(first, first + n, dtype=np.uint64)))[0]
                none = pa.nulls(len(where), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), own, pa.nulls(n, pa.int64()), pa.array(np.diff(starts) - 1),
                     pa.array(known), pa.array(base), pa.array(total)], names=names)
                at = pa.array(row[where])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in (0, 1, 3)), *_longs(key[where], times), none, none,
                     *[pa.nulls(len(where), pa.float64())] * 2], names=names)

    names = ["doc_id", "learn", "id", "key", "n", "tokens", "known", "base", "add"]
    columns = f"doc_id {kind}, learn boolean, id long, key long, n long, tokens long, known long, base double, add double"
    n, term, word = F.col("n"), F.col("term"), F.col("is_word")
    found = F.when(n.isNotNull(), n * term)
    parts = []
    with shuffles_deleted(spark):
        for share in range(_SHARES):  # rows that repeat share an id, and so are in one share, and each has sent its occurrences
            scanned = docs.filter(F.pmod("id", F.lit(_SHARES)) == share).mapInArrow(giving_back(scan), columns)
            parts.append(stored(scanned.join(rest, "key", "left").groupBy("id", "doc_id", "learn").agg(
                F.count("tokens").alias("copies"), F.max("tokens").alias("n_tokens"),
                F.sum(F.coalesce("known", F.when(word, n), F.lit(0))).alias("n_known"),
                F.sum(F.coalesce("base", F.when(word, found), F.lit(0.0))).alias("base"),
                F.sum(F.coalesce("add", found, F.lit(0.0))).alias("add")), "scored"))
    shared.destroy()  # the parts are stored: workers need not hold the table and the filter any longer
    whole = reduce(DataFrame.unionByName, parts)
    lost = F.col("n_tokens") * F.lit(float(np.log10(tree.norm)))
    out = whole.select(
        "doc_id", "learn", "n_tokens", F.expr("n_known div copies").alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") - lost).alias("base_score"), (F.col("add") / F.col("copies") - lost).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")
