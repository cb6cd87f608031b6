"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit a dimension, set where the value is above 0. A code of 64 bits is four
segments of 16, each with its own index. Search grows the segment radius: after radius r has been
probed in the first j segments, every code within 4 * r + j - 1 has been seen, so a query is done when
its kth verified distance is no larger. No bucket is capped; equal codes are one entry with their ids in order.

The rows are dealt in turn to blocks of about BLOCK codes, each to one block only. A block's index is built once, in one task,
and all queries stream past it in batches; the k best of each block are merged by query. No pair of rows becomes a row of Spark's.

Rows whose vector or id is null, or with a null in the vector or another number of dimensions than `dims`, have no code and are
left out, as rows and as queries. A query does not find rows of its own id. Repeated rows are found as
often as they are there. Ties go to the least id. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, table

SEGMENTS, WIDTH = 4, 16
BLOCK = 1 << 20
QUERIES_A_BLOCK = 512
PACK = 4096  #: codes dealt together


class MultiIndex:
    """Four hash indexes over the 16-bit segments of 64-bit codes."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, codes))
        codes, self.ids = codes[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, int)
        self.codes, self.at = codes[first], np.append(first, len(codes))
        self.rows, self.start = [], []
        for j in range(SEGMENTS):
            v = (self.codes >> np.uint64(WIDTH * j)).astype(np.uint16)
            self.rows.append(np.argsort(v, kind="stable").astype(np.int32))
            self.start.append(np.concatenate(([0], np.cumsum(np.bincount(v, minlength=1 << WIDTH)))))
        self.masks = {}

    def mask(self, r: int) -> np.ndarray:
        """All values of r set bits."""
        if r not in self.masks:
            self.masks[r] = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)], np.uint16)
        return self.masks[r]

    def search(self, code: int, own: int, k: int) -> list[tuple[int, int]]:
        """(distance, id) of the k nearest codes' rows, without those of id own."""
        code = np.uint64(code)
        seen = np.zeros(0, np.int32)
        dist = np.zeros(0, np.int64)
        counts = np.diff(self.at)
        for r in range(WIDTH + 1):
            for j in range(SEGMENTS):
                value = np.uint16((int(code) >> (WIDTH * j)) & 0xFFFF)
                probe = (self.mask(r) ^ value).astype(np.int64)
                a, b = self.start[j][probe], self.start[j][probe + 1]
                full = b > a
                if full.any():
                    a, b = a[full], b[full]
                    n = b - a
                    idx = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    new = np.setdiff1d(self.rows[j][idx], seen)
                    seen = np.concatenate((seen, new))
                    dist = np.concatenate((dist, np.bitwise_count(self.codes[new] ^ code).astype(np.int64)))
                covered = SEGMENTS * r + j
                near = dist <= covered
                if counts[seen[near]].sum() >= k + 1 and self._others(seen[near], own, k):
                    return self._best(seen[near], dist[near], own, k)
            if len(seen) == len(self.codes):
                break
        return self._best(seen, dist, own, k)

    def _others(self, rows: np.ndarray, own: int, k: int) -> bool:
        n = 0
        for x in rows:
            n += int((self.ids[self.at[x] : self.at[x + 1]] != own).sum())
            if n >= k:
                return True
        return False

    def _best(self, rows: np.ndarray, dist: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for d in np.unique(dist):
            got = []
            for x in rows[dist == d]:
                ids = self.ids[self.at[x] : self.at[x + 1]]
                got.extend(ids[ids != own][:k])
            out.extend((int(d), int(i)) for i in sorted(got)[: k - len(out)])
            if len(out) >= k:
                break
        return out


ROWS = "b int, query boolean, ids binary, codes binary"


def _packed(blocks: int, query: bool, size: int):
    """Rows to packed batches, dealt to the blocks in turn; a batch of queries goes to all of them."""

    def run(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                one = batch.slice(at, size)
                ids, codes = (one.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes() for i in (0, 1))
                to = range(blocks) if query else [n % blocks]
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([query] * len(to)), pa.array([ids] * len(to), pa.binary()), pa.array([codes] * len(to), pa.binary())], ["b", "query", "ids", "codes"])

    return run


def _search(k: int):
    """Rows sorted by block, a block's codes before its queries: its index is built once and serves them all."""

    def run(batches):
        block, held, index = None, [], None
        for batch in batches:
            for b, query, ids, codes in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    block, held, index = b, [], None
                if not query:
                    held.append((ids, codes))
                    continue
                if index is None:
                    index = MultiIndex(np.frombuffer(b"".join(c for _, c in held), np.uint64), np.frombuffer(b"".join(i for i, _ in held), np.int64))
                    held = []
                own = np.frombuffer(ids, np.int64)
                best = [index.search(int(c), int(i), k) if len(index.codes) else [] for c, i in zip(np.frombuffer(codes, np.uint64), own)]
                flat = [y for x in best for y in x]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, [len(x) for x in best])), pa.array([y[1] for y in flat], pa.int64()), pa.array([y[0] for y in flat], pa.int32())], ["query_id", "id", "distance"])

    return run


def codes_of(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    bits = F.aggregate(F.col(vec_col), F.struct(F.lit(0).cast("long").alias("code"), F.lit(0).alias("i")), lambda s, x: F.struct((s["code"] + F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), s["i"])).otherwise(F.lit(0).cast("long"))).alias("code"), (s["i"] + 1).alias("i")))["code"]
    ok = F.col(id_col).isNotNull() & (F.size(vec_col) == dims) & ~F.exists(vec_col, lambda x: x.isNull())
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), bits.alias("code"))


def hamming_topk(vectors: DataFrame, k: int = 10, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, block: int = BLOCK, queries_a_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each row whose id is divisible by `every`."""
    if dims > SEGMENTS * WIDTH:
        raise ValueError("at most 64 dimensions")
    c = stash(codes_of(vectors, id_col, vec_col, dims))
    total = c.count()
    asked = c.where(F.col("id") % every == 0)
    nb = max(1, -(-total // block))
    rows = c.mapInArrow(_packed(nb, False, min(PACK, block)), ROWS)
    ask = asked.dropDuplicates(["id", "code"]).mapInArrow(_packed(nb, True, queries_a_block), ROWS)
    dealt = rows.union(ask).repartition(nb, "b").sortWithinPartitions("b", "query")
    near = dealt.mapInArrow(_search(k), "query_id long, id long, distance int")
    best = W.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_hamming_topk": op6_hamming_topk}
SQL = {"op6_hamming_topk": """
WITH c AS (SELECT vec_id AS id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END))::HUGEINT AS code FROM embeddings),
p AS (SELECT q.id AS query_id, r.id, bit_count(xor(q.code, r.code))::INT AS distance FROM c q JOIN c r ON q.id != r.id WHERE q.id % 20 = 0)
SELECT query_id, rank::INT AS rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 10
"""}
