"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to ORDER bytes (escape method C, symbol exclusion, uniform
bottom). A text starts from a context of ORDER bytes 0xFF, which no text holds, and ends with one.
Pretrained: all contexts of the training texts are counted, and every text is scored by the finished
trie. Adaptive: each text is scored by a trie that starts empty and learns as it goes (`Trie`).

With a finished trie the symbols excluded at a level are those of the next longer context, so a level's
denominator belongs to that context: one table look-up a byte, and a few more for escapes.

The trie is sent to the tasks in parts of at most PART contexts-with-symbol; contexts of one part are
scored in one pass over the texts, so no task holds more, at any size. A context is a number whose highest byte is the one
next to the symbol, and a part is a range of the two highest: so it holds the shorter contexts of its own too, down to two
bytes, and only those of one byte are sent with every part. The unigram base uses counts of
all tokens: those with at least 1/HEAD of all occurrences (at most HEAD of them) are sent along, the others are joined.

Nulls: a null text is empty (it has its end only); null ids count as empty ones. Repeated rows give
repeated rows. Without training texts every byte has probability 1/256. Empty tables: no rows. Extra columns stay, but for the
text and those of the names that are added (score, n_tokens, head_log, head_known, tail, n_known, train_tokens, base_score, _row).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import drop_stashes, extended, shared_dir, small_batches, stash, table

ORDER = 5  #: at most 6: contexts and their symbol are one 64-bit number
END = 255
PART = 3_000_000  #: about 250 MB in a task, 200 MB on the driver
HEAD = 1 << 21
HELD = 8_000_000  #: symbols counted at once
SLOTS = 22  #: log2 of the slots of the quick look-up table
END_TOKEN = 0x0E4D0E4D


class Trie:
    """The plain form: a dict of contexts. Scores texts one byte at a time."""

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, {}

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            node = self.nodes.setdefault(context[len(context) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def log10(self, context: bytes, symbol: int) -> float:
        out, barred = 0.0, frozenset()
        for k in range(min(self.order, len(context)), -1, -1):
            node = self.nodes.get(context[len(context) - k :])
            if not node:
                continue
            left = {s: c for s, c in node.items() if s not in barred}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / total)
            if left:
                out += math.log10(len(left) / total)
            barred = frozenset(node)
        return out - math.log10(256 - len(barred))

    def score(self, text: str | None, adapt: bool) -> float:
        context, out = bytes([END]) * self.order, 0.0
        for s in (text or "").encode() + bytes([END]):
            out += self.log10(context, s)
            if adapt:
                self.learn(context, s)
            context = (context + bytes([s]))[1:]
        return out

    def train(self, text: str | None) -> None:
        context = bytes([END]) * self.order
        for s in (text or "").encode() + bytes([END]):
            self.learn(context, s)
            context = (context + bytes([s]))[1:]


def keys_of(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol (bytes and ends): its context bytes, the nearest first, and itself as one number; texts' offsets."""
    n, step = len(offs) - 1, order + 1
    wide = offs + step * np.arange(n + 1)
    x = np.full(int(wide[-1]), END, np.uint64)
    at = np.arange(len(data)) + np.repeat(step * np.arange(n) + order, np.diff(offs))
    x[at] = data
    key = x.copy()
    for j in range(1, step):
        key[order:] |= x[order - j : len(x) - j] << np.uint64(8 * (step - j))
    keep = np.ones(len(x), bool)
    for j in range(order):
        keep[wide[:-1] + j] = False
    return key[keep], offs + np.arange(n + 1)


def shorter(keys: np.ndarray, by: int) -> np.ndarray:
    """The keys with their `by` farthest context bytes left out."""
    return (keys >> np.uint64(8 * (by + 1))) << np.uint64(8) | keys & np.uint64(255)


def _count(kind: int, held: list[np.ndarray]) -> pa.RecordBatch:
    """Counts of the keys; empties the list, so that they are there once and are sorted in place."""
    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    at = np.flatnonzero(np.concatenate(([len(keys) > 0], keys[1:] != keys[:-1]))[: len(keys)])
    n = np.diff(np.append(at, len(keys)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), pa.array(keys[at].view(np.int64)), pa.array(n)], ["kind", "key", "n"])


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, of = K.tokens(data, offs, K.NOT_SPACE)
    return K.hashes(K.FOLD[data], s, e), of


def _counts(order: int):
    def run(batches):
        grams, words, size = [], [], 0
        texts = 0
        for p in K.pieces(batches, "text"):
            data, offs = K.view(p.column(0))
            grams.append(keys_of(data, offs, order)[0])
            words.append(word_hashes(data, offs)[0])
            texts += len(offs) - 1
            size += len(grams[-1])
            if size >= HELD:
                yield _count(0, grams)
                yield _count(1, words)
                size = 0
        if grams:
            yield _count(0, grams)
            yield _count(1, words)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0]), pa.array([texts])], ["kind", "key", "n"])

    return run


class _Level:
    """Contexts of k bytes: their symbols' keys and counts, and the sums that scoring needs."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        ctx = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(keys) else np.zeros(0, int)
        self.ctx, self.first = ctx[first], first
        self.total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        self.kinds = np.diff(np.append(first, len(keys)))

    def at(self, table_: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table_):
            return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
        i = np.minimum(np.searchsorted(table_, want), len(table_) - 1)
        return i, table_[i] == want


class Frozen:
    """A finished trie as sorted arrays; `lo` to `hi` are the keys of this part's longest contexts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, lower: np.ndarray, lower_n: np.ndarray, lo: int, hi: int, order: int = ORDER):
        """keys, n: symbols in contexts of `order` bytes; lower, lower_n: in contexts of 1 (all of them)."""
        self.lo, self.hi, self.order = lo, hi, order
        levels = [None, _Level(lower, lower_n), *[None] * (order - 2), _Level(keys, n)]
        for k in (*range(order - 1, 1, -1), 0):
            u, back = np.unique(shorter(levels[k + 1].keys, 1), return_inverse=True)
            levels[k] = _Level(u, np.bincount(back, levels[k + 1].n, len(u)).astype(np.int64))
        self.levels = levels
        for k in range(order, 0, -1):  # of each context of k bytes: what its symbols leave of the next shorter context
            a, b = levels[k], levels[k - 1]
            if not len(a.keys):
                a.left_n = a.left_t = np.zeros(0, np.int64)
                continue
            i, _ = b.at(b.keys, shorter(a.keys, 1))
            barred = np.add.reduceat(b.n[i], a.first)
            j, _ = b.at(b.ctx, a.ctx >> np.uint64(8))
            a.left_n, a.left_t = b.total[j] - barred, b.kinds[j] - a.kinds
        top = levels[order]
        per = np.repeat(top.total + top.kinds, top.kinds)
        self.quick_keys = np.full(1 << SLOTS, 0, np.uint64)
        self.quick = np.full(1 << SLOTS, np.nan, np.float32)
        slot = self._slot(top.keys)
        self.log_top = np.log10(top.n / per) if len(per) else np.zeros(0)
        self.quick_keys[slot], self.quick[slot] = top.keys, self.log_top

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability; 0 where its context is another part's."""
        slot = self._slot(keys)
        out = self.quick[slot].astype(np.float64)
        rest = np.flatnonzero((self.quick_keys[slot] != keys) | np.isnan(out))
        if self.lo > 0 or self.hi < 1 << 8 * (self.order + 1):
            mine = (keys[rest] >= np.uint64(self.lo)) & (keys[rest] < np.uint64(self.hi))
            out[rest[~mine]] = 0
            rest = rest[mine]
        left = keys[rest]
        top = self.levels[self.order]
        i, ok = top.at(top.keys, left)
        out[rest[ok]] = self.log_top[i[ok]]
        rest, left = rest[~ok], left[~ok]
        acc = np.zeros(len(rest))
        i, known = top.at(top.ctx, left >> np.uint64(8))
        if len(top.ctx):
            acc[known] = np.log10(top.kinds[i[known]] / (top.total[i[known]] + top.kinds[i[known]]))
        for k in range(self.order - 1, -1, -1):
            lv, up = self.levels[k], self.levels[k + 1]
            key = shorter(left, self.order - k)
            g, hit = lv.at(lv.keys, key)
            c, there = lv.at(lv.ctx, key >> np.uint64(8))
            if not len(lv.keys):
                continue
            left_n = np.where(known, up.left_n[i] if len(up.ctx) else 0, lv.total[c])
            left_t = np.where(known, up.left_t[i] if len(up.ctx) else 0, lv.kinds[c])
            hit &= there
            whole = np.maximum(left_n + left_t, 1)
            acc[hit] += np.log10(lv.n[g[hit]] / whole[hit])
            out[rest[hit]] = acc[hit]
            go = ~hit
            escape = go & there & (left_t > 0)
            acc[escape] += np.log10(left_t[escape] / whole[escape])
            rest, left, acc, i, known = rest[go], left[go], acc[go], c[go], there[go]
        out[rest] = acc - math.log10(256 - (len(self.levels[0].keys)))
        return out


def _part_scores(model, texts: pa.Array) -> np.ndarray:
    data, offs = K.view(texts)
    keys, at = keys_of(data, offs, model.order)
    c = np.concatenate(([0.0], np.cumsum(model.score(keys))))
    return c[at[1:]] - c[at[:-1]]


def _more(sent):
    """(_row, more): what a further part of the trie adds to each row's score."""

    def run(batches):
        for p in K.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(_part_scores(sent.value, p.column(1)))], ["_row", "more"])

    return run


def _scored(sent, head):
    def run(batches):
        for p in K.pieces(batches, "text"):
            texts = p.column(p.schema.get_field_index("text"))
            score = _part_scores(sent.value, texts)
            data, offs = K.view(texts)
            rest = [i for i, name in enumerate(p.schema.names) if name != "text"]
            known, logs, end_log, end_known = head.value
            h, of = word_hashes(data, offs)
            i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            ok = known[i] == h if len(known) else np.zeros(len(h), bool)
            s = np.concatenate(([0.0], np.cumsum(np.where(ok, logs[i], 0.0)) if len(known) else np.zeros(len(h))))
            m = np.concatenate(([0], np.cumsum(ok)))
            tail = np.concatenate(([0], np.cumsum(~ok))).astype(np.int32)[of]
            yield pa.RecordBatch.from_arrays(
                [*(p.column(i) for i in rest), pa.array(score), pa.array(np.diff(of) + 1), pa.array(s[of[1:]] - s[of[:-1]] + end_log), pa.array(m[of[1:]] - m[of[:-1]] + end_known), pa.ListArray.from_arrays(pa.array(tail), pa.array(h[~ok].view(np.int64)))],
                [*(p.schema.names[i] for i in rest), "score", "n_tokens", "head_log", "head_known", "tail"])

    return run


def score_texts(docs: DataFrame, training: DataFrame, part: int = PART, head: int = HEAD, order: int = ORDER) -> DataFrame:
    """docs (id, text) plus n_tokens, n_known, train_tokens, base_score and score (log10 of the text's
    probability), learnt from training (text). The order is 2 to 6."""
    spark = docs.sparkSession
    docs = docs.drop("score", "n_tokens", "head_log", "head_known", "tail", "n_known", "train_tokens", "base_score", "_row")
    shared_dir(spark)
    small_batches(spark)
    counts = training.select("text").mapInArrow(_counts(order), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = stash(counts)
    grams, words = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    ends = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    least = total // head + 1
    often = words.where(F.col("n") >= least).toArrow()
    hk = often.column(0).to_numpy().view(np.uint64)
    by = np.argsort(hk)
    sent_head = spark.sparkContext.broadcast((hk[by], np.log10(often.column(1).to_numpy()[by] + 0.5), math.log10(ends + 0.5), int(ends > 0)))

    one = F.shiftleft(F.shiftright("key", 8 * order), 8).bitwiseOR(F.col("key").bitwiseAND(255))
    low = grams.groupBy(one.alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 2**16 rows
    number = lambda t, kind: (t.column(0).to_numpy().astype(kind), t.column(1).to_numpy())

    def ordered(t):
        k, n = number(t, np.uint64)
        o = np.argsort(k)
        return k[o], n[o]

    lk, ln = ordered(low)
    cuts, low_bits = [0], 8 * (order - 1)
    if (distinct := grams.count()) > part:  # ranges of the nearest two context bytes
        held = 0
        for r in grams.groupBy(F.shiftright("key", low_bits).alias("b")).count().orderBy("b").toLocalIterator():
            if held and held + r["count"] > part:
                cuts.append(r["b"] << low_bits)
                held = 0
            held += r["count"]
    cuts.append(1 << 8 * (order + 1))
    # with several parts the rows are numbered and written once; a part then gives one number a row, and these are summed
    every, many = docs.withColumn("_row", F.monotonically_increasing_id()), len(cuts) > 2
    if many:
        every = stash(every, "zstd")
    d, further = None, []
    for lo, hi in zip(cuts, cuts[1:]):
        k, n = ordered((grams if distinct <= part else grams.where((F.col("key") >= lo) & (F.col("key") < hi))).toArrow())
        sent = spark.sparkContext.broadcast(Frozen(k, n, lk, ln, lo, hi, order))
        if d is None:
            schema = T.StructType([f for f in extended(every.schema, "score double, n_tokens long, head_log double, head_known long, tail array<long>").fields if f.name != "text"])
            d = stash(every.mapInArrow(_scored(sent, sent_head), schema))
        else:
            further.append(stash(every.select("_row", "text").mapInArrow(_more(sent), "_row long, more double")))
        sent.destroy()
    if many:
        drop_stashes(every)
        more = reduce(DataFrame.union, further).groupBy("_row").agg(F.sum("more").alias("more"))
        d = d.join(more, "_row").withColumn("score", F.col("score") + F.col("more")).drop("more")
    rare = d.select("_row", F.explode("tail").alias("key")).join(words, "key", "left")
    rare = rare.groupBy("_row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.count("n").alias("rare_known"))
    per = math.log10(total + 0.5 * (kinds + 1))
    return d.join(rare, "_row", "left").select(
        *[c for c in docs.columns if c != "text"], "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(per)).alias("base_score"), "score")


def score_adaptive(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """docs plus score, in place of a column of that name: each text coded by a trie that starts empty. Byte by byte, in Python;
    a task holds one text's trie, whose size the text bounds."""
    docs = docs.drop("score")

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([Trie(order).score(t, True) for t in texts], pa.float64())], [*b.schema.names, "score"])

    return docs.mapInArrow(run, extended(docs.schema, "score double"))


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score_texts(docs.select("doc_id", out.alias("held_out"), "text"), docs.where(~out))


QUERIES = {"op5_ppm_scores": op5_ppm_scores}
SQL: dict[str, str] = {}
