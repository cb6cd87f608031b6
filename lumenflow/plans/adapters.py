"""The driver's tables as signal streams, points, rasters and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, frame, v): one value a frame, a stream per user."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("stream"), n.cast("long").alias("frame"), F.col("value").alias("v"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, vs): the ordered values of each stream."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return e.select(F.col("user_id").alias("stream"), F.col("s.value").alias("vs"))


def points(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(stream, frame, i, x, y): events as points, a stream per type, a frame per day."""
    e = read(spark, sf_dir, "events")
    d = e.select(F.col("event_type").alias("stream"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("frame"), F.col("event_id").alias("i"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), *more)
    return d


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, frame, y, x, g): each vector an 8 x 8 frame, a stream per label."""
    v = read(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    g = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 0.35) * 360))).cast("int")
    return v.select(F.col("label").alias("stream"), F.col("vec_id").alias("frame"), F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), g.alias("g"))


SIGNALS = "sig AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS v FROM events)"
SERIES = "ser AS (SELECT user_id AS stream, list(value ORDER BY ts, event_id) AS vs FROM events GROUP BY user_id)"
POINTS = "pts AS (SELECT event_type AS stream, date_diff('day', DATE '1970-01-01', ts::DATE) AS frame, event_id AS i, value AS x, json_extract_string(props, '$.k')::DOUBLE AS y FROM events)"
PIXELS = "px AS (SELECT label AS stream, vec_id AS frame, (i // 8)::INT AS y, (i % 8)::INT AS x, greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 0.35::DOUBLE) * 360)))::INT AS g FROM embeddings, unnest(range(64)) t(i))"
