"""N-gram Jaccard join: grouped prefix join over word-shingle sets.

Texts with equal sets form one class. Each class keeps the rarest part of its set, the prefix: with
Jaccard similarity t two linked sets must share a prefix member. Classes with identical prefix and
size collapse into one group; only groups are posted under prefix members, a posting list of one
group is dropped, and the lists left are expanded to the groups' classes, filtered by size and by a
parity bitmap (its Hamming distance never exceeds the symmetric difference), and verified exactly.

Rarity comes from counts of all shingles in fixed hash cells. Any order gives the same links; this
one keeps common passages out of the prefixes. Posting lists above TILE rows are cut into tiles of
pairs of slices, so one task holds at most two slices. Copies are never expanded into pairs: round
one verifies only a spanning forest of the filtered pairs in each list. Every linked pair is connected
by such pairs, true or not, so components that refuted pairs join into a cluster may still be linked.
Round two brings the sets of a cluster together (tiled like a list) and compares there what is still in
different components; only links that join two components leave a tile, fewer than it has rows.
So the components are exact, and no link between different components is lost.

Nulls, empty texts: empty set, linked with nothing. A null doc_id takes part but never names a
component (its component_id is null if it stands alone). Repeated rows fall into one class. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded, connected_components, drop_stashes, extended, shared_dir, small_batches, stash, table

BITS = 51  #: width of a shingle hash
CELLS = 21  #: log2 of the count cells; one byte each is sent to the executors: 2 MB at any input size
TILE = 2048  #: rows in a slice of a long posting list or of a large cluster
MEMBERS = 1_000_000  #: members of the sets in a slice of a cluster, on average
HOT = 16 * TILE  #: a list whose member occurs more often (and 64 times as often as a cell's mean) skips the filters by neighbours
SENT = 2_000_000  #: class keys that may be sent to all executors (16 bytes each); beyond it they are joined
PARITY = 512  #: least bits of a parity bitmap; larger sets have the power of two from half their size on


def _parity(keys: np.ndarray) -> bytes:
    """Bitmap of the parity of the members in each bucket. Halves folded by xor give the smaller bitmap."""
    bits = PARITY
    while bits < len(keys) // 2:
        bits *= 2
    return np.packbits(np.bincount((keys % K.U(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _fold(raw: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def least_overlap(n, m, t: int):
    """Least overlap of linked sets of sizes n and m: 100 * i >= t * (n + m - i)."""
    return -((-t * (n + m)) // (100 + t))


def prefix_size(n: int, t: int) -> int:
    """Members of a set of n of which a *different* linked set shares at least one; 0 if there is none."""
    least = -((-t * n) // 100)  # overlap with any linked set
    # a different linked set has n - 1, n or n + 1 members or more; the best case is a subset or a superset
    if 100 * (n - 1) < t * n and 100 * n < t * (n + 1):
        return 0
    return n - least + 1


def _local_counts(k: int):
    def run(batches):
        held, size = [], 0

        def out():
            x = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            n = np.diff(np.append(at, len(x)))
            cell = (x[at][n > 1] >> K.U(BITS - CELLS)).astype(np.int32)
            cells, back = np.unique(cell, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(back, n[n > 1], len(cells)).astype(np.int64))], ["cell", "n"])

        for piece in K.pieces(batches, "text"):
            keys, _ = _sets(piece, k)
            held.append(keys)
            size += len(keys)
            if size >= 1_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _sets(piece: pa.RecordBatch, k: int):
    data, offs = K.view(piece.column(piece.schema.get_field_index("text")))
    return K.shingle_sets(K.FOLD[data], offs, K.NOT_SPACE, k, BITS)


def _sigs(keys: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-byte keys of sets, alike for equal sets, and their sizes."""
    n = np.diff(offs)
    s = np.zeros((len(n), 2), np.uint64)
    for j, salt in enumerate((0x1234567, 0x89ABCDEF)):
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(keys + K.U(salt << 20)), dtype=np.uint64)))
        s[:, j] = K.mix(c[offs[1:]] - c[offs[:-1]] + n.astype(np.uint64))
    return s, n


def _fixed(a: np.ndarray) -> pa.Array:
    """Rows of a 2-D array as a binary column."""
    a = np.ascontiguousarray(a)
    w = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, (len(a) + 1) * w, w, dtype=np.int32)), pa.py_buffer(a.tobytes())])


def _profiles(k: int, t: int, order):
    """Size, key, prefix and bitmap of each text's set."""

    def run(batches):
        rank = np.frombuffer(order.value, np.uint8)
        for piece in K.pieces(batches, "text"):
            keys, offs = _sets(piece, k)
            sig, n = _sigs(keys, offs)
            ranked = (rank[(keys >> K.U(BITS - CELLS)).astype(np.int64)].astype(np.uint64) << K.U(BITS)) | keys
            lists = []
            for i, size in enumerate(n):
                p = prefix_size(int(size), t)
                x = ranked[offs[i] : offs[i + 1]]
                lists.append(np.sort(np.partition(x, p - 1)[:p] if 0 < p < size else x[:p]))
            flat = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
            at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            rest = [piece.column(i) for i, f in enumerate(piece.schema.names) if f != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(n.astype(np.int64)), _fixed(sig), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array([_parity(keys[offs[i] : offs[i + 1]]) for i in range(len(n))], pa.binary())],
                [*[f for f in piece.schema.names if f != "text"], "n", "sig", "prefix", "bits"],
            )

    return run


class _Lists:
    """Sizes and bitmaps of rows; `same` tells which pairs pass both filters."""

    def __init__(self, ns: np.ndarray, raw: list[bytes], t: int):
        self.ns, self.raw, self.t = ns, raw, t
        self.wide = np.array([len(x) for x in raw])
        self.bits = np.stack([_fold(x, PARITY // 8) for x in raw]) if raw else np.zeros((0, PARITY // 64), np.uint64)

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.ns[i], self.ns[j]
        ok = 100 * np.minimum(a, b) >= self.t * np.maximum(a, b)
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        most = a + b - 2 * least_overlap(a, b, self.t)
        near = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(-1, dtype=np.int64) <= most
        size = np.minimum(self.wide[i], self.wide[j])
        for x in np.flatnonzero(near & (size > PARITY // 8)):
            d = _fold(self.raw[i[x]], size[x]) ^ _fold(self.raw[j[x]], size[x])
            near[x] = int(np.bitwise_count(d).sum(dtype=np.int64)) <= most[x]
        ok[ok] = near
        return ok


def _list_pairs(rows: _Lists, at: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the filtered pairs of one posting list."""
    found_i, found_j = [], []
    root = np.arange(m)
    for first in range(1, m, 64):
        js = np.arange(first, min(first + 64, m))
        jj, ii = np.meshgrid(js, np.arange(js[-1]), indexing="ij")
        keep = ii < jj
        ii, jj = ii[keep], jj[keep]
        ok = rows.same(ii + at, jj + at)
        ii, jj = ii[ok], jj[ok]
        while len(ii):
            alive = root[ii] != root[jj]
            ii, jj = ii[alive], jj[alive]
            if len(ii):
                _, pick = np.unique(jj[::-1], return_index=True)  # of each j, its nearest earlier neighbour
                for x in len(jj) - 1 - pick:
                    a, b = root[ii[x]], root[jj[x]]
                    if a != b:
                        root[root == max(a, b)] = min(a, b)
                        found_i.append(ii[x])
                        found_j.append(jj[x])
    return np.array(found_i, np.int64), np.array(found_j, np.int64)


def _blocks(batches):
    """Tables of whole tiles out of rows sorted by tile."""
    held = None
    for b in batches:
        x = pa.Table.from_batches([b])
        x = x if held is None else pa.concat_tables([held, x])
        tile = x.column("tile").to_numpy()
        last = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
        if last:
            yield x.slice(0, last)
        held = x.slice(last)
    if held is not None and held.num_rows:
        yield held


def _edges(t: int):
    """Pairs of class keys out of rows sorted by their list."""

    def run(batches):
        for x in _blocks(batches):
            x = x.combine_chunks()
            tile = x.column("tile").to_numpy()
            ns = x.column("n").to_numpy()
            sig = x.column("sig").combine_chunks()
            rows = _Lists(ns, x.column("bits").to_pylist(), t)
            at = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
            size = np.diff(np.append(at, len(tile)))
            a, b = [], []
            small = size <= 8
            # short lists all at once, by distance
            pos = np.arange(len(tile))
            end = np.repeat(np.where(small, at + size, 0), size)
            for d in range(1, 8):
                i = pos[pos + d < end]
                j = i + d
                ok = rows.same(i, j)
                a.append(i[ok])
                b.append(j[ok])
            for s, n in zip(at[~small], size[~small]):
                i, j = _list_pairs(rows, s, n)
                a.append(i + s)
                b.append(j + s)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([sig.take(pa.array(a)), sig.take(pa.array(b))], ["x", "y"])
        K.release()

    return run


def _wanted_sets(k: int, wanted):
    """The sets (8-byte members) of the texts whose class is wanted (all, if None)."""

    def run(batches):
        want = None if wanted is None else np.sort(np.frombuffer(wanted.value, np.uint64).reshape(-1, 2)[:, 0])
        for piece in K.pieces(batches, "text"):
            keys, offs = _sets(piece, k)
            sig, n = _sigs(keys, offs)
            if want is None:
                rows = np.flatnonzero(n > 0)
            else:
                at = np.minimum(np.searchsorted(want, sig[:, 0]), max(len(want) - 1, 0))
                rows = np.flatnonzero((n > 0) & (want[at] == sig[:, 0])) if len(want) else np.zeros(0, int)
            _, once = np.unique(sig[rows], axis=0, return_index=True)
            rows = rows[once]
            yield pa.RecordBatch.from_arrays([_fixed(sig[rows]), pa.array([keys[offs[i] : offs[i + 1]].tobytes() for i in rows], pa.binary())], ["sig", "members"])

    return run


def _similar(p: np.ndarray, q: np.ndarray, t: int) -> bool:
    both = np.concatenate((p, q))
    both.sort()
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= t * (len(p) + len(q) - i)


def _linked(t: int):
    def run(batches):
        for b in batches:
            keep = [_similar(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), t) for p, q in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cluster_links(sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Linked rows of a tile that join two components; root, the rows' components, is changed."""
    rows = _Lists(np.array([len(x) for x in sets], np.int64), [_parity(x) for x in sets], t)
    found = []
    for first in range(1, len(sets), 64):
        js = np.arange(first, min(first + 64, len(sets)))
        jj, ii = np.meshgrid(js, np.arange(js[-1]), indexing="ij")
        keep = (ii < jj) & (root[ii] != root[jj]) & (side[ii] * side[jj] <= 0)
        ii, jj = ii[keep], jj[keep]
        ok = rows.same(ii, jj)
        for a, b in zip(ii[ok], jj[ok]):
            x, y = root[a], root[b]
            if x != y and _similar(sets[a], sets[b], t):
                root[root == max(x, y)] = min(x, y)
                found.append((a, b))
    return found


def _crossing(t: int):
    """Pairs of components with linked sets out of rows sorted by their cluster: in each tile a spanning forest of them."""

    def run(batches):
        for x in _blocks(batches):
            x = x.combine_chunks()
            tile, side = x.column("tile").to_numpy(), x.column("side").to_numpy()
            comp = x.column("comp").combine_chunks()
            root = comp.dictionary_encode().indices.to_numpy(zero_copy_only=False).copy()
            at = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
            found = []
            for s, e in zip(at, np.append(at[1:], len(tile))):
                sets = [np.frombuffer(v, np.uint64) for v in x.column("members").slice(s, e - s).to_pylist()]
                found += [(s + a, s + b) for a, b in _cluster_links(sets, side[s:e], root[s:e], t)]
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([comp.take(pa.array(a)), comp.take(pa.array(b))], ["x", "y"])
        K.release()

    return run


def _verified(docs: DataFrame, edges: DataFrame, k: int, t: int) -> tuple[DataFrame, DataFrame]:
    """The edges whose sets really have the similarity, and the sets of all ends."""
    spark = docs.sparkSession
    keys = edges.select(F.col("a").alias("sig")).union(edges.select(F.col("b").alias("sig"))).distinct()
    keys = stash(keys)
    wanted = None
    if (count := keys.count()) <= SENT:
        wanted = spark.sparkContext.broadcast(b"".join(r[0] for r in keys.toLocalIterator()) if count else b"")
    sets = docs.select("text").mapInArrow(_wanted_sets(k, wanted), "sig binary, members binary")
    if wanted is None:
        sets = sets.join(keys, "sig", "left_semi")
    sets = stash(sets.groupBy("sig").agg(F.min("members").alias("members")).withColumn("n", (F.length("members") / 8).cast("long")))
    pairs = edges.join(sets.select(F.col("sig").alias("a"), F.col("members").alias("p")), "a").join(sets.select(F.col("sig").alias("b"), F.col("members").alias("q")), "b")
    out = stash(pairs.select("a", "b", "p", "q").mapInArrow(_linked(t), "a binary, b binary"))
    drop_stashes(keys)
    return out, sets


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows of a list dealt to tiles: short lists are one tile, long ones all pairs of their slices. In a tile of two slices
    side is -1 or 1, by slice; in a tile of one it is 0."""
    k = F.ceil(F.col("size") / TILE).cast("int")
    s = F.pmod(F.xxhash64("sig"), k.cast("long")).cast("int")
    rows = rows.withColumn("k", k).withColumn("s", s)
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tile = F.when(F.col("k") == 1, F.col("list")).otherwise(F.xxhash64("list", F.least("s", "o"), F.greatest("s", "o")))
    return rows.withColumn("tile", tile).withColumn("side", F.signum(F.col("s") - F.col("o")).cast("int")).drop("k", "s", "o", "size", "list")


def _joined(sets: DataFrame, first: DataFrame, linked: DataFrame, comps: DataFrame, t: int) -> DataFrame:
    """Round two: (v, comp) of the components that further links join; first are all filtered pairs of round one, linked the true ones."""
    ends = stash(sets.select("sig", "n").join(comps.withColumnRenamed("v", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig")))
    at = lambda end, name: ends.select(F.col("sig").alias(end), F.col("comp").alias(name))
    refuted = first.join(linked, ["a", "b"], "left_anti").join(at("a", "x"), "a").join(at("b", "y"), "b").where("x != y")
    clusters = connected_components(refuted, "x", "y").select(F.col("v").alias("comp"), F.xxhash64("comp").alias("list"))
    inside = stash(ends.join(clusters, "comp").select("list", "sig", "n", "comp"))
    sizes = inside.groupBy("list").agg(F.greatest(F.count("*"), F.ceil(F.sum("n") * TILE / MEMBERS)).alias("size"))
    tiles = _tiled(inside.join(sizes, "list")).join(sets.select("sig", "members"), "sig")
    tiles = tiles.select("tile", "side", "n", "sig", "comp", "members").repartition("tile").sortWithinPartitions("tile", "n", "sig")
    more = stash(tiles.select("tile", "side", "comp", "members").mapInArrow(_crossing(t), "x binary, y binary"))
    out = connected_components(more, "x", "y")
    drop_stashes(ends, inside, more)
    return out


def jaccard_components(docs: DataFrame, k: int = 5, t: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, sig, comp, component_id): components of the texts whose k-word shingle sets have a
    Jaccard similarity of t percent or more. sig is the key of the text's set, comp that of its component
    (null for an empty set), component_id the component's least id. One row per row of docs."""
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    counts = docs.select("text").mapInArrow(_local_counts(k), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rank = np.zeros(1 << CELLS, np.uint8)
    got = counts.select("cell", F.ceil(F.log2(F.col("n").cast("double")) * 4).cast("int").alias("r"), "n").toArrow()  # at most one row a cell
    rank[got.column(0).to_numpy()] = np.minimum(got.column(1).to_numpy(), 255)
    order = spark.sparkContext.broadcast(rank.tobytes())

    kind = docs.schema["doc_id"].dataType.simpleString()
    meta = stash(docs.mapInArrow(_profiles(k, t, order), f"doc_id {kind}, n long, sig binary, prefix array<long>, bits binary"))
    ranked = meta.withColumn("g", F.xxhash64("n", "prefix"))
    classes = stash(ranked.where("n > 0").groupBy("sig").agg(F.min("n").alias("n"), F.min("g").alias("g"), F.min("doc_id").alias("least_id"), F.min("bits").alias("bits")))
    groups = stash(classes.groupBy("g").agg(F.count("*").alias("members")))

    # Postings of the groups. A group without another one of fitting size in the list leaves it; what
    # is left of groups with several members also needs the pairs within the group.
    # Two groups alone in a list must also fit by position: what follows their first common member bounds
    # the overlap, and every linked pair passes in the list of its first common member.
    posted = ranked.where("n > 0 and size(prefix) > 0").select("g", "n", F.posexplode("prefix").alias("pos", "list")).select("list", "g", (F.col("n") * (1 << 32) + F.col("pos")).alias("at"))
    # The rank in a list's number tells how common its member is. Lists of very common ones, if there are any, are dealt by
    # group as well: they take no part in the windows below, whose filters only save work.
    mean = int(got.column(2).to_numpy().sum()) / (1 << CELLS)
    hot = int(np.ceil(np.log2(max(HOT, 64 * mean)) * 4))
    whole = None
    if int(rank.max()) >= hot:
        whole = posted.where(F.shiftright("list", BITS) >= hot).select("list", "g").distinct()
        posted = posted.where(F.shiftright("list", BITS) < hot)
    posted = posted.repartition("list").dropDuplicates(["list", "g"])
    by_size = W.partitionBy("list").orderBy("at", "g")
    posted = posted.withColumn("before", F.lag("at").over(by_size)).withColumn("after", F.lead("at").over(by_size)).withColumn("lists", F.count("*").over(W.partitionBy("list")))
    n_of, pos_of = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF))

    def fit(low, high):
        size = n_of(high) * t <= n_of(low) * 100
        most = F.least(n_of(low) - pos_of(low), n_of(high) - pos_of(high))
        return size & ((F.col("lists") > 2) | (most * (100 + t) >= (n_of(low) + n_of(high)) * t))

    fits = F.coalesce(fit("before", "at"), F.lit(False)) | F.coalesce(fit("at", "after"), F.lit(False))
    within = groups.where("members > 1").select(F.xxhash64("g", F.lit("within")).alias("list"), "g")
    shared = posted.withColumn("fits", fits).where("fits").select("list", "g").union(within)
    shared = stash(shared if whole is None else shared.union(whole))
    rows = shared.join(classes.select("g", "sig", "n", "bits"), "g").drop("g")
    sizes = stash(shared.join(groups, "g").groupBy("list").agg(F.sum("members").alias("size")))

    tiles = _tiled(rows.join(sizes, "list")).select("tile", "n", "sig", "bits")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "n", "sig")
    pairs = tiles.mapInArrow(_edges(t), "x binary, y binary")
    first = stash(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a != b").distinct())
    drop_stashes(groups, shared, sizes)
    linked, sets = _verified(docs, first, k, t)
    comps = connected_components(linked)
    joined = _joined(sets, first, linked, comps, t).select(F.col("v").alias("comp"), F.col("comp").alias("whole"))
    named = classes.select("sig", "least_id").join(comps.withColumnRenamed("v", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    named = named.join(joined, "comp", "left").select("sig", "least_id", F.coalesce("whole", "comp").alias("comp"))
    unnamed = stash(named)
    least = stash(unnamed.groupBy("comp").agg(F.min("least_id").alias("component_id")))
    named = stash(unnamed.join(least, "comp").select("sig", "comp", "component_id"))
    drop_stashes(classes, first, linked, sets, unnamed, least)
    out = meta.select("doc_id", "n", "sig").join(named, "sig", "left")
    out = out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "sig", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))
    out.rests_on = (meta, named)
    return out


def keep_one(docs: DataFrame, k: int = 5, t: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, one of the least id. Texts without words all stay.
    Rows whose id is null or not unique are told apart by their sets."""
    linked = jaccard_components(docs, k, t, id_col, text_col)
    found = stash(linked)
    drop_stashes(*linked.rests_on)
    stays = (F.col("n_shingles") == 0) | F.col(id_col).eqNullSafe(F.col("component_id"))
    gone = found.where(~stays & F.col(id_col).isNotNull()).select(id_col).distinct()
    shared = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    plain = docs.where(F.col(id_col).isNotNull()).join(bounded(stash(gone.union(shared).distinct())), id_col, "left_anti")
    if not found.where(F.col(id_col).isNull()).limit(1).count() and not shared.limit(1).count():
        return plain.select(docs.columns)
    odd = docs.where(F.col(id_col).isNull()).unionByName(docs.join(shared, id_col, "left_semi").select(docs.columns))

    def keyed(batches):
        for p in K.pieces(batches, text_col):
            data, offs = K.view(p.column(p.schema.get_field_index(text_col)))
            sig, n = _sigs(*K.shingle_sets(K.FOLD[data], offs, K.NOT_SPACE, k, BITS))
            yield pa.RecordBatch.from_arrays([*p.columns, _fixed(sig), pa.array(n.astype(np.int64))], [*p.schema.names, "_sig", "_n"])

    odd = odd.mapInArrow(keyed, extended(docs.schema, "_sig binary, _n long"))
    named = found.where("n_shingles > 0").groupBy(F.col("sig").alias("_sig")).agg(F.min("comp").alias("_comp"), F.min("component_id").alias("_least"))
    odd = odd.join(named, "_sig", "left")
    one = odd.where((F.col("_n") > 0) & F.col(id_col).eqNullSafe(F.col("_least"))).dropDuplicates(["_comp"])
    return plain.select(docs.columns).unionByName(one.select(docs.columns)).unionByName(odd.where("_n = 0").select(docs.columns))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words, similarity of 90 percent, every document."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, t=90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
#: Equal sets are one class here, too; the pairs of classes are all counted.
SQL = {"op8_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p : p + 2], ' ')) END)) AS g FROM d),
c AS (SELECT row_number() OVER () AS c, g, len(g) AS n, min(doc_id) AS least FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT c, n, unnest(g) AS x FROM c),
e AS (SELECT a.c AS a, b.c AS b FROM u a JOIN u b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(c, r) AS (SELECT c, c FROM c UNION SELECT both_.b, reach.r FROM reach JOIN both_ ON both_.a = reach.c),
named AS (SELECT reach.c, min(c.least) AS component_id FROM reach JOIN c ON c.c = reach.r GROUP BY reach.c)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(named.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN named ON named.c = c.c
"""}
