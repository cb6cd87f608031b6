"""Benchmark decontamination with a distributed positional inverted index.

Index: each piece of the training texts is one segment, a row of a stored table: its documents, and
for every term (64-bit hash) the sorted positions in the segment. Segments are bounded, so a frequent
term or a large source spreads over many rows. All terms are stored; the index serves any test set.

Search: a test item's windows are looked up per segment, from the term that is rarest in the segment on;
position lists shifted by the term's offset are intersected, so what is left are exact occurrences. With
slop above 0 the other terms may lie in any order within the window's length plus slop words. The test
set is sent to the tasks in parts of at most PART characters; several parts are merged by document.

Nulls: a null text has no words (no hits), a null item text no windows; null ids pass through (a null
item_id is not listed). Repeated rows give repeated rows. Empty tables: no rows, or no hits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import shared_dir, small_batches, stash, table

WINDOW = 10
PART = 8_000_000
SEGMENT = 2 << 20  #: bytes of text in a segment (one longer text stands alone)
INDEX = "ids array<long>, starts array<int>, terms binary, offsets binary, positions binary"


def _segments(batches):
    for p in K.pieces(batches, "text", SEGMENT, 1 << 16):
        data, offs = K.view(p.column(1))
        starts, ends, of = K.tokens(data, offs, K.ALNUM)
        h = K.hashes(K.FOLD[data], starts, ends)
        del data, starts, ends
        # sort by (term, position): number the terms first, so that one plain sort of 64 bits does it
        terms = np.unique(h)
        key = (np.searchsorted(terms, h).astype(np.uint64) << K.U(32)) | np.arange(len(h), dtype=np.uint64)
        key.sort()
        first = np.searchsorted(key, np.arange(len(terms) + 1, dtype=np.uint64) << K.U(32)).astype(np.int32)
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        ids = pa.ListArray.from_arrays(pa.array([0, p.num_rows], pa.int32()), p.column(0).cast(pa.int64()))
        begins = pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), pa.array(of.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([ids, begins, one(terms), one(first), one((key & K.U(0xFFFFFFFF)).astype(np.int32))], ["ids", "starts", "terms", "offsets", "positions"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of the texts: one row a segment."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stash(d.mapInArrow(_segments, INDEX), "zstd")


def windows_of(items: list[tuple], size: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct windows as rows of term hashes: lengths, rows (padded by 0), and the items of each."""
    found: dict[tuple, set] = {}
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        s, e, _ = K.tokens(data, np.array([0, len(data)]), K.ALNUM)
        h = K.hashes(K.FOLD[data], s, e)
        for i in range(max(len(h) - size, 0) + 1 if len(h) else 0):
            found.setdefault(tuple(h[i : i + size]), set()).add(item)
    rows = np.zeros((len(found), size), np.uint64)
    for i, w in enumerate(found):
        rows[i, : len(w)] = w
    return np.array([len(w) for w in found], np.int64), rows, [sorted(x for x in s if x is not None) for s in found.values()]


class Segment:
    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.starts = np.asarray(row["starts"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.first = np.frombuffer(row["offsets"], np.int32)
        self.positions = np.frombuffer(row["positions"], np.int32)

    def find(self, lens: np.ndarray, rows: np.ndarray, slop: int):
        """(window, first position, end position) of every occurrence."""
        if not len(self.terms) or not len(rows):
            return
        at = np.minimum(np.searchsorted(self.terms, rows), len(self.terms) - 1)
        inside = np.arange(rows.shape[1])[None, :] < lens[:, None]
        there = (self.terms[at] == rows) | ~inside
        df = np.where(inside, self.first[at + 1] - self.first[at], np.iinfo(np.int32).max)
        for w in np.flatnonzero(there.all(1)):
            n = int(lens[w])
            order = np.argsort(df[w, :n], kind="stable")
            lists = [self.positions[self.first[x] : self.first[x + 1]] for x in at[w, order]]
            if slop:
                yield from self._near(w, rows[w, order], lists, n + slop)
                continue
            hit = lists[0] - order[0]
            for o, other in zip(order[1:], lists[1:]):
                want = hit + o
                i = np.minimum(np.searchsorted(other, want), len(other) - 1)
                hit = hit[other[i] == want]
                if not len(hit):
                    break
            if len(hit):
                doc = np.searchsorted(self.starts, hit, "right") - 1
                for p in hit[(hit >= 0) & (hit + n <= self.starts[np.minimum(doc + 1, len(self.starts) - 1)])]:
                    yield w, int(p), int(p) + n

    def _near(self, w, terms, lists, span):
        """Spans of at most `span` words around the rarest term's postings that hold every term often enough."""
        need: dict[int, int] = {}
        for t in terms:
            need[int(t)] = need.get(int(t), 0) + 1
        by = {int(t): x for t, x in zip(terms, lists)}
        last = -1
        for p in lists[0]:
            doc = int(np.searchsorted(self.starts, p, "right")) - 1
            lo, hi = max(int(self.starts[doc]), int(p) - span + 1), min(int(self.starts[doc + 1]), int(p) + span)
            near = {t: x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for t, x in by.items()}
            if any(len(near[t]) < c for t, c in need.items()):
                continue
            for s in np.unique(np.concatenate(list(near.values()))):
                if s > p or s <= last:
                    continue
                ends = [x[np.searchsorted(x, s) + need[t] - 1] if np.searchsorted(x, s) + need[t] <= len(x) else None for t, x in near.items()]
                if None not in ends and max(ends) - s < span and p <= max(ends):
                    last = int(s)
                    yield w, int(s), int(max(ends)) + 1


def _searched(sent, slop: int):
    def run(batches):
        lens, rows, items = sent.value
        for b in batches:
            for row in b.to_pylist():
                seg = Segment(row)
                n = np.diff(seg.starts)
                covered = np.zeros(int(seg.starts[-1]) + 1, np.int32)
                of: list[set] = [set() for _ in n]
                for w, a, e in seg.find(lens, rows, slop):
                    covered[a] += 1
                    covered[e] -= 1
                    of[int(np.searchsorted(seg.starts, a, "right")) - 1].update(items[w])
                hit = np.concatenate(([False], np.cumsum(covered)[:-1] > 0, [False]))
                edge = hit[1:] != hit[:-1]
                ends = np.flatnonzero(edge)
                # spans end where a document does, too
                spans: list[list] = [[] for _ in n]
                for a, e in zip(ends[::2], ends[1::2]):
                    while a < e:
                        d = int(np.searchsorted(seg.starts, a, "right")) - 1
                        z = min(int(e), int(seg.starts[d + 1]))
                        spans[d].append({"start": int(a - seg.starts[d]), "end": int(z - seg.starts[d])})
                        a = z
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.ids, pa.int64()), pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(x) for x in of], pa.list_(pa.int64()))],
                    ["id", "row", "n_words", "spans", "items"])

    return run


def _parts(bench: DataFrame, item_col: str, text_col: str):
    """The test set in parts of bounded size."""
    part, size = [], 0
    for r in bench.select(F.col(item_col).cast("long"), text_col).toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= PART:
            yield part
            part, size = [], 0
    yield part


def search_index(index: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = 0, item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """(id, n_words, spans, items) of every indexed text: word spans inside an occurrence of a test
    window, and the items with occurring windows."""
    spark = index.sparkSession
    schema = "id long, row int, n_words long, spans array<struct<start:int,end:int>>, items array<long>"
    parts = _parts(bench, item_col, bench_text)
    first, second = next(parts), next(parts, None)
    if second is None:
        sent = spark.sparkContext.broadcast(windows_of(first, window))
        return index.mapInArrow(_searched(sent, slop), schema).drop("row")
    # several parts: the same texts come once a part; segments are told apart by their stored order
    marked = stash(index.withColumn("seg", F.monotonically_increasing_id()))
    every = None
    for part in _parts(bench, item_col, bench_text):
        sent = spark.sparkContext.broadcast(windows_of(part, window))
        x = marked.mapInArrow(_with_segment(sent, slop), "seg long, " + schema)
        every = x if every is None else every.unionByName(x)
    g = every.groupBy("seg", "row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = """aggregate(s, CAST(array() AS array<struct<start:int,end:int>>), (o, x) -> IF(size(o) > 0 AND o[size(o) - 1].end >= x.start,
        concat(slice(o, 1, size(o) - 1), array(named_struct('start', o[size(o) - 1].start, 'end', greatest(o[size(o) - 1].end, x.end)))), concat(o, array(x))))"""
    return g.select("id", "n_words", F.expr(merged).alias("spans"), "items")


def _with_segment(sent, slop: int):
    inner = _searched(sent, slop)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                for out in inner([one.select([c for c in one.schema.names if c != "seg"])]):
                    seg = pa.array([one.column(one.schema.get_field_index("seg"))[0].as_py()] * out.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([seg, *out.columns], ["seg", *out.schema.names])

    return run


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, spans, items) for (doc_id, text) and the test set (item_id, text)."""
    return search_index(build_index(docs), bench, window, slop).withColumnRenamed("id", "doc_id")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    d = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("CAST(aggregate(spans, 0, (a, x) -> a + x.end - x.start) AS BIGINT)")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return d.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES = {"op1_decontamination": op1_decontamination}
_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_L = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {"op1_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(regexp_extract_all({_L.format('text')}, '{_W}'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_L.format('text')}, '{_W}'), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
gram AS (SELECT i, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - k + 2)) t(p)),
hit AS (SELECT i, p, win.k, item_id FROM gram JOIN win ON gram.k = win.k AND gram.g = win.g),
words AS (SELECT i, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + k)) t(q) GROUP BY i),
its AS (SELECT i, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY i)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (i) LEFT JOIN its USING (i)
"""}
