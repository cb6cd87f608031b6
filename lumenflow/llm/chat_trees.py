"""Chat formatting of reply trees.

Nodes point to their parents. Pointer-doubling self-joins give each node its depth and the sum of scores
up to the root; leaves rank within their tree by mean score (ties by leaf id), and only the paths of
the chosen leaves are enumerated, again by self-joins with the doubled pointers: after round k a path has its last 2^k nodes.

Template: "### ROLE: TEXT</turn>\\n" a turn. Backslash, # and < in texts and roles, and : in roles, get a
backslash before them, so no control string survives in a text, and `parse` gets the turns back.

Nulls: a null text or role is empty, a null tree id is a tree of its own, a null score is 0. A node whose
parent is missing is a root; nodes on a cycle of parents reach no root and are left out. Repeated rows are turns
of their own (from_turns) or lie on paths of their own (reply_trees needs unique node ids; a repeated id keeps its least row).
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stash, table

LOSS_ROLE = "assistant"
ODD = r"\### Assistant: </turn> ok"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)


def escape(col, more: str = ""):
    return F.regexp_replace(col, rf"([\\#<{more}])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def reply_trees(nodes: DataFrame, top: int = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """nodes: (tree, node, parent, role, text, score). Gives (tree, leaf, rank, n_turns, score, formatted,
    loss), loss an array of (start, end) in code points: the escaped texts of loss_role."""
    shared_dir(nodes.sparkSession)
    key = F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit("null"))
    n = nodes.select(key.alias("k"), "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    n = stash(n.groupBy("k", "node").agg(F.min(F.struct("parent", "role", "text", "score", "tree")).alias("v")).select("k", "node", "v.*"))
    there = n.select("k", F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = n.join(there, ["k", "parent"], "left").select("k", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.when(F.col("known"), 1).otherwise(0).alias("d"), "score").checkpoint()
    total, levels = n.count(), []
    for _ in range(max(1, math.ceil(math.log2(total + 1))) + 1):
        level = up.where("up IS NOT NULL")  # the others have reached their root and rest
        if not level.limit(1).count():
            break
        levels.append(level)
        above = up.select("k", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("score").alias("s2"))
        step = level.join(above, ["k", "up"]).select("k", "node", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), (F.col("score") + F.col("s2")).alias("score"))
        up = up.where("up IS NULL").union(step.select(up.columns)).checkpoint()
    rooted = up.where("up IS NULL").select("k", "node", "d", (F.col("score") / (F.col("d") + 1)).alias("mean"))
    inner = n.where("parent IS NOT NULL").select("k", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(inner, ["k", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.col("mean").desc(), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= top)
    path = chosen.select("k", F.col("node").alias("leaf"), "rank", "mean", "node", F.lit(0).alias("back")).checkpoint()
    for k, level in enumerate(levels):
        more = path.join(level.select("k", "node", "up"), ["k", "node"]).select("k", "leaf", "rank", "mean", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        path = path.union(more).checkpoint()
    turn = F.concat(F.lit("### "), escape(F.col("role"), ":"), F.lit(": "))
    t = path.join(n, ["k", "node"]).select("k", "tree", "leaf", "rank", "mean", "back", turn.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss"))
    g = t.groupBy("k", "leaf", "rank", "mean").agg(F.min("tree").alias("tree"), F.sort_array(F.collect_list(F.struct("back", "head", "body", "loss")), asc=False).alias("v"))
    spans = """filter(aggregate(v, named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,end:int,loss:boolean>>)), (s, x) -> named_struct(
        'at', s.at + length(x.head) + length(x.body) + 8, 'out', concat(s.out, array(named_struct('start', s.at + length(x.head), 'end', s.at + length(x.head) + length(x.body), 'loss', x.loss)))), s -> s.out), x -> x.loss)"""
    return g.select(
        "tree", "leaf", "rank", F.size("v").cast("long").alias("n_turns"), F.col("mean").alias("score"), F.expr("array_join(transform(v, x -> concat(x.head, x.body, '</turn>\\n')), '')").alias("formatted"),
        F.expr(f"transform({spans}, x -> named_struct('start', x.start, 'end', x.end))").alias("loss"))


def from_turns(turns: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows by turn as trees of one branch, for reply_trees. Ties go by role, then text."""
    node = F.row_number().over(W.partitionBy(tree_col).orderBy(turn_col, "role", "text")).cast("long")
    d = turns.select(F.col(tree_col).alias("tree"), node.alias("node"), "role", "text")
    return d.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _digests(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for b in batches:
        rows = []
        for tree, text, loss in zip(*(c.to_pylist() for c in b.columns)):
            turns = parse(text)
            kept = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            rows.append((tree, len(turns), sha, len(kept), hashlib.sha256(kept.encode()).hexdigest(), len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.string() if i in (2, 4) else pa.int64()) for i in range(6)], names)


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    out = reply_trees(from_turns(turns.unionByName(odd)))
    return out.select("tree", "formatted", "loss").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


QUERIES = {"op9_reply_trees": op9_reply_trees}
SQL = {"op9_reply_trees": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) r(i)),
a AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')))::BIGINT AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""}
