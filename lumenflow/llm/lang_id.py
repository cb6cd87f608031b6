"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased code points; all but letters count as one separator. Grams of 1 to 3
characters hash to 2**BITS features. A feature's value is its share among a text's grams of that length times
log((1 + documents) / (1 + document frequency)); frequencies cover every training text. Weights are learnt by
follow-the-regularised-leader with elastic-net penalties (l1, l2) from a sample of at most SAMPLE labelled
texts, spread evenly over the languages; a fifth of it sets the temperature of the softmax.
Prediction streams over whole texts: each gram adds its row of the weight table (fixed size, 2**BITS floats a language).

Nulls: texts that are null or have no letter are `und` with score 0; a null label is no training row; a null id
counts as an empty one. Without training rows all is `und`. Repeated rows count as often as they
are there in the frequencies, and once in the sample (rows of one id, text and label are one). Empty tables give no rows.
Extra columns stay, but for those of the names that `predict` adds.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import extended, small_batches, table

BITS, GRAMS = 16, 3
SAMPLE = 3000  #: labelled texts the weights are fitted on, at most
EPOCHS, ALPHA, BETA, L1, L2 = 6, 1.0, 1.0, 0.002, 0.001
UND = "und"
_tables: list[np.ndarray] = []


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, and its symbol (lower case; 32 for all but letters and marks)."""
    if not _tables:
        letter, low = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))[0]
            letter[i] = kind == "L"
            if kind not in "LM":
                low[i] = 32
            elif len(x := chr(i).lower()) == 1:
                low[i] = ord(x)
        _tables.extend((letter, low))
    return _tables[0], _tables[1]


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the texts' offsets in them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[lead].astype(np.uint32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        d = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
        at, b = lead[wide], cp[wide]
        b1, b2, b3 = d[at + 1] & 0x3F, d[at + 2] & 0x3F, d[at + 3] & 0x3F
        v = np.where(b < 0xE0, (b & 0x1F) << 6 | b1, np.where(b < 0xF0, (b & 0xF) << 12 | b1 << 6 | b2, (b & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        cp[wide] = np.minimum(v, 0x10FFFF)
    return cp, np.searchsorted(lead, offs)


def features(cp: np.ndarray, n: int) -> np.ndarray:
    """Feature of the n-gram that starts at each position (the last n - 1 are missing)."""
    m = max(len(cp) - n + 1, 0)
    h = np.full(m, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for j in range(n):
        h = (h ^ cp[j : j + m]) * K.U(0xD6E8FEB86659FD93)
        h ^= h >> K.U(32)
    return (h * K.U(0x9E3779B97F4A7C15) >> K.U(64 - BITS)).astype(np.int32)


def _grams(cp: np.ndarray, n: int, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, and where each text's begin and end."""
    f = features(cp, n)
    return f, np.minimum(offs[:-1], len(f)), np.clip(offs[1:] - n + 1, np.minimum(offs[:-1], len(f)), len(f))


def _frequencies(batches):
    df = np.zeros(1 << BITS, np.int64)
    flag = np.zeros(1 << BITS, bool)
    _, low = char_tables()
    for p in K.pieces(batches, "text"):
        cp, offs = code_points(*K.view(p.column(0)))
        cp = low[cp]
        all_f = [_grams(cp, n, offs) for n in range(1, GRAMS + 1)]
        for i in range(len(offs) - 1):
            for f, a, b in all_f:
                flag[f[a[i] : b[i]]] = True
            for f, a, b in all_f:  # work by the text's length, not by the table's
                one = f[a[i] : b[i]]
                one = one[flag[one]]
                flag[one] = False
                df[np.unique(one)] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["feature", "n"])


def _sparse(batches):
    _, low = char_tables()
    for p in K.pieces(batches, "text"):
        cp, offs = code_points(*K.view(p.column(0)))
        cp = low[cp]
        all_f = [_grams(cp, n, offs) for n in range(1, GRAMS + 1)]
        fs, vs = [], []
        for i in range(len(offs) - 1):
            v = np.zeros(1 << BITS)
            for f, a, b in all_f:
                if b[i] > a[i]:
                    v += np.bincount(f[a[i] : b[i]], minlength=1 << BITS) / (b[i] - a[i])
            at = np.flatnonzero(v)
            fs.append(at.astype(np.uint16).tobytes())
            vs.append(v[at].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([p.column(1), p.column(2), pa.array(fs, pa.binary()), pa.array(vs, pa.binary())], ["label", "h", "f", "v"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from (features, values, class) rows."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA * 1e-3 + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            f, v, y = rows[r]
            at = np.append(f.astype(np.int64), 1 << BITS)
            x = np.append(v, 0.05)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1], w[-1] * 0.05


class Model:
    def __init__(self, labels: list[str], table_: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.table, self.bias, self.temperature = labels, table_, bias, temperature

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        letter, low = char_tables()
        cp, offs = code_points(*K.view(column))
        has = np.concatenate(([0], np.cumsum(letter[cp])))
        has = has[offs[1:]] > has[offs[:-1]]
        cp = low[cp]
        logit = np.tile(self.bias.astype(float), (len(offs) - 1, 1))
        for n in range(1, GRAMS + 1):
            f, a, b = _grams(cp, n, offs)
            for k in range(len(self.labels)):
                c = np.concatenate(([0.0], np.cumsum(self.table[k][f], dtype=np.float64)))
                logit[:, k] += (c[b] - c[a]) / np.maximum(b - a, 1)
        if not self.labels:
            return [UND] * len(has), np.zeros(len(has))
        p = softmax(logit / self.temperature)
        best = p.argmax(1)
        return [self.labels[x] if ok else UND for x, ok in zip(best, has)], np.where(has, p.max(1), 0.0)


def train(labelled: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from all rows of labelled: counts cover them all, the fit at most `sample` of them."""
    small_batches(labelled.sparkSession)
    d = labelled.where(F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")), F.lit("lang")).alias("h"))
    counts = {r["label"]: r["n"] for r in d.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0)
    got = d.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(1 << BITS)
    df[got.column(0).to_numpy()] = got.column(1).to_numpy()
    idf = np.log((1 + sum(counts.values())) / (1 + df))
    share = max(1, sample // len(labels))
    rate = F.create_map(*[F.lit(x) for k in labels for x in (k, int(min(1.0, 0.9 * share / counts[k]) * (1 << 30)))])
    picked = d.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < rate[F.col("label")])
    # rows alike count once here, and no more than the sample leaves the executors, whatever the ids are
    picked = picked.groupBy("label", "h").agg(F.min("text").alias("text")).orderBy("h", "label").limit(sample)
    rows = [(r["label"], r["h"], np.frombuffer(r["f"], np.uint16), np.frombuffer(r["v"], np.float32)) for r in picked.select("text", "label", "h").mapInArrow(_sparse, "label string, h long, f binary, v binary").toLocalIterator()]
    rows = sorted(rows, key=lambda r: (r[1], r[0], r[2].tobytes()))[:sample]
    data = [(f, v * idf[f], labels.index(y)) for y, _, f, v in rows]
    fit, rest = [x for i, x in enumerate(data) if i % 5], data[::5]
    w, bias = ftrl(fit, len(labels))
    held = np.array([v @ w[f] + bias for f, v, _ in rest]) if rest else np.zeros((0, len(labels)))
    y = np.array([c for _, _, c in rest], int)
    grid = np.geomspace(0.02, 20, 91)
    loss = [-np.log(np.maximum(softmax(held / t)[np.arange(len(y)), y], 1e-12)).sum() for t in grid]
    return Model(labels, np.ascontiguousarray((w * idf[:, None]).T.astype(np.float32)), bias, float(grid[int(np.argmin(loss))]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs plus lang_pred and score, in place of columns of these names."""
    docs = docs.drop(pred_col, score_col)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for p in K.pieces(batches, text_col):
            names, score = sent.value.predict(p.column(p.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*p.columns, pa.array(names, pa.string()), pa.array(score)], [*p.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, extended(docs.schema, f"`{pred_col}` string, `{score_col}` double"))


def held_out(id_col: str = "doc_id", mod: int = 4, rest: int = 2):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
