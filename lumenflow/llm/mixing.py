"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. A document's expected copies are the source's rate times its
preference, at most `most`; the rate is such that they come to the target. Whole copies are certain; the words still missing come from a
fixed-size sample: documents rank by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)),
and are taken in this order until the next one would lead further from the target than it helps.

No source is sorted as a whole: words are summed per source and cell of the rank first, and only the
cell that holds the cut, about 2**-24 of a source, is ordered. Rows of one id rank alike, so a source that is mostly one
repeated id is ordered in one task as far as they hold the cut. Only DataFrame functions are used.

Nulls: a null text has no words, a null source is a source of its own (last in order), a null id
ranks as an empty one. Repeated rows rank alike and count as rows of their own. Empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, stash, table

WORDS = r"[^\x20\x09-\x0D]+"
CELLS, DEPTH = 256, 3
LEVELS = 100  #: preferences there may be
SEED = "mix-1"


def _targets(sizes: DataFrame, weights, share: float, most: float) -> DataFrame:
    """source, source_size, target. One row a source; the windows below see sources, not documents."""
    every = W.partitionBy()
    by_name = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("total", F.sum("source_size").over(every) * float(share))
    # sources reach their cap in the order of cap / weight; what is left goes to the others by weight
    fill = W.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    onward = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    s = s.withColumn("full", F.col("cap") <= level * F.col("w"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    rest = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("w") / rest)).select("source", "source_size", "target")


def _rates(levels: DataFrame, most: int) -> DataFrame:
    """(source, prefer, hope): expected copies of each preference, in proportion to it but at most `most`, so that they come to
    the source's target. levels: (source, prefer, words, target), at most LEVELS rows a source."""
    down = W.partitionBy("source").orderBy(F.col("prefer").desc())
    before = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * float(most)
    liked = F.sum(F.col("words") * F.col("prefer")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    x = levels.withColumn("rest", F.col("target") - before).withColumn("liked", liked)
    x = x.withColumn("full", F.col("rest") * F.col("prefer") >= F.col("liked") * float(most))
    # the first level that is not full sets the rate of all after it
    first = F.first(F.when(~F.col("full"), F.struct("rest", "liked")), True).over(down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    x = x.withColumn("r", first)
    hope = F.when(F.col("full"), float(most)).otherwise(F.least(F.col("r.rest") / F.when(F.col("r.liked") > 0, F.col("r.liked")) * F.col("prefer"), F.lit(float(most))))
    return x.select("source", "prefer", F.coalesce(hope, F.lit(0.0)).alias("hope"))


def pareto_mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefer: Column | None = None, seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of each row of docs.

    weights repeat over the sources by code point; share: total words over the words there are; most:
    copies of a document, and words of a source over its own, at most; prefer: a whole number from 1 to LEVELS, of docs'
    columns or of `size`, the row's words, that scales the expected copies within a source (null: 1; others are cut to the range)."""
    hexed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    counted = docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long"))
    level = F.lit(1) if prefer is None else F.least(F.greatest(F.coalesce(prefer.cast("long"), F.lit(1)), F.lit(1)), F.lit(LEVELS))
    light = stash(counted.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), "size",
        ((F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)).alias("u"), level.cast("long").alias("prefer"),
    ))
    sums = stash(light.groupBy("source", "prefer").agg(F.sum("size").alias("words")))
    targets = _targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    levels = sums.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rates = _rates(levels.select("source", "prefer", "words", "target"), most).select(F.col("source").alias("s"), F.col("prefer").alias("v"), "hope")
    plan = stash(rates.join(targets.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"))
    x = light.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("prefer") == F.col("v"))).drop("s", "v")
    x = x.withColumn("whole", F.floor("hope")).withColumn("p", F.col("hope") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    x = x.withColumn("rank", F.when(F.col("p") > 0, odds))  # rows of whole copies only take no part in the order
    place = F.col("rank") / (1 + F.col("rank"))
    # Words are summed per source and cell of the rank; the cell that holds the cut is cut into cells again, and what is in the
    # last one, a source's 2**-24, is ordered row by row. Rows before the cut's cell are in, those after it are out.
    sure = stash(x.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("sure")))
    edge = sure.select(F.col("source").alias("s"), (F.col("target") - F.col("sure")).alias("missing"), F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("start"))
    for depth in range(DEPTH):
        cell = F.floor(place * float(CELLS ** (depth + 1)))
        inside = x.where("rank IS NOT NULL").join(bounded(edge), F.col("source").eqNullSafe(F.col("s"))).withColumn("cell", cell)
        inside = inside.where(F.floor(F.col("cell") / CELLS) == F.col("edge"))
        cells = inside.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.max("missing").alias("missing"), F.max("start").alias("start"))
        up_to = W.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("upto", F.col("start") + F.sum("words").over(up_to)).withColumn("start", F.col("upto") - F.col("words"))
        cut = cells.where(F.col("upto") > F.col("missing")).groupBy(F.col("source").alias("s")).agg(F.min(F.struct("cell", "start", "missing")).alias("c"))
        edge = stash(cut.select("s", F.col("c.missing").alias("missing"), F.col("c.cell").alias("edge"), F.col("c.start").alias("start")))
    x = x.withColumn("cell", F.floor(place * float(CELLS**DEPTH))).join(bounded(edge), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    order = W.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    at_edge = x.where("cell = edge").withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    at_edge = at_edge.withColumn("extra", (F.col("before") + F.col("size") / 2 <= F.col("missing")).cast("long")).drop("before")
    others = x.where("cell IS NULL OR edge IS NULL OR cell != edge").withColumn("extra", F.coalesce((F.col("rank").isNotNull() & (F.col("edge").isNull() | (F.col("cell") < F.col("edge")))), F.lit(False)).cast("long"))
    out = others.unionByName(at_edge).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: The query's preference: a step for each hundred words, up to four. Longer documents are likelier to be taken.
STEP, STEPS = 100, 4


def by_length() -> Column:
    return 1 + F.least(F.floor(F.col("size") / STEP), F.lit(STEPS - 1))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents"), prefer=by_length()).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_pareto_mixing": op7_pareto_mixing}
#: `from_` is the table of documents.
MIX_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM {from_}),
light AS (SELECT *, 1 + least(size // 100, 3) AS prefer FROM counted),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM light GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM sums),
f AS (SELECT *, cap <= (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * w AS full_ FROM w),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE
        (total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT full_ THEN w END) OVER () END AS target FROM f),
v AS (SELECT source, prefer, sum(size)::BIGINT AS words FROM light GROUP BY ALL),
k AS (SELECT v.*, t.target, t.target - coalesce(sum(words) OVER (PARTITION BY v.source ORDER BY prefer DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE AS rest,
             (sum(words * prefer) OVER (PARTITION BY v.source ORDER BY prefer DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS liked
      FROM v JOIN t ON v.source IS NOT DISTINCT FROM t.source),
j AS (SELECT *, rest * prefer >= liked * 2.0::DOUBLE AS full_ FROM k),
i AS (SELECT *, arg_max(struct_pack(rest := rest, liked := liked), prefer) FILTER (NOT full_) OVER (PARTITION BY source) AS r FROM j),
e AS (SELECT source, prefer, CASE WHEN full_ THEN 2.0::DOUBLE ELSE coalesce(least(r.rest / nullif(r.liked, 0) * prefer, 2.0::DOUBLE), 0) END AS hope FROM i),
h AS (SELECT l.*, t.source_size, t.target, e.hope
      FROM light l JOIN t ON l.source IS NOT DISTINCT FROM t.source JOIN e ON l.source IS NOT DISTINCT FROM e.source AND l.prefer = e.prefer),
p AS (SELECT *, floor(hope)::BIGINT AS whole, hope - floor(hope) AS p FROM h),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank, target - sum(whole * size) OVER (PARTITION BY source) AS missing FROM p),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rank IS NOT NULL AND before + size / 2.0::DOUBLE <= missing THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
SQL = {"op7_pareto_mixing": MIX_SQL.format(from_="documents")}
