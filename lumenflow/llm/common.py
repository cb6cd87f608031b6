"""Shared helpers of the training-data operators: table access, the shared folder, stashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import drop_stashes, shared_dir, stash  # noqa: F401

#: ASCII upper case to lower case; the operators fold no other letters unless they say so.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of an Arrow batch, so that very long texts do not pile up in a Python worker. It is a setting of the
    session, as results are run later, by the caller; one that the caller has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, size)


def bounded(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df marked to be sent to all executors if it has at most `most` (narrow) rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def extended(schema, more: str):
    """A schema with further columns, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp): the least vertex that each vertex of the undirected edges can reach.

    Each round hooks a vertex to its least neighbour, jumps pointers to the chain's end, and contracts the edges;
    edges within a component vanish, so later rounds see less and less. The rounds grow with the
    logarithm of a component's size. Each is checkpointed in the shared folder. Null or equal ends are ignored.
    """
    shared_dir(edges.sparkSession)
    e = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct().checkpoint()
    ends = e.select("u").union(e.select("v")).distinct()
    comp = ends.select(F.col("u").alias("v"), F.col("u").alias("comp")).checkpoint()
    while e.limit(1).count():
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("low"))
        low = low.checkpoint()
        while True:  # to the end of the chain: even a path of rising ids is one vertex after this
            end = low.join(low.select(F.col("u").alias("low"), F.col("low").alias("lower")), "low").select("u", "low", "lower").checkpoint()
            moved = end.where("low != lower").limit(1).count()
            low = end.select("u", F.col("lower").alias("low"))
            if not moved:
                break
        comp = comp.join(low.withColumnRenamed("u", "comp"), "comp", "left").select("v", F.coalesce("low", "comp").alias("comp")).checkpoint()
        x = e.join(low.withColumnRenamed("low", "x"), "u").select("v", "x").join(low.select(F.col("u").alias("v"), F.col("low").alias("y")), "v")
        e = x.where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct().checkpoint()
    return comp
