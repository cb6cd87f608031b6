"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, also set as the checkpoint folder. Where it is unset: a temporary folder if driver and executors
    are one process, an error on a cluster, whose executors would not see each other's files."""
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    unset = sc._jsc.sc().getCheckpointDir().isEmpty()
    if own:
        if unset:
            sc.setCheckpointDir(own)
        return own
    if unset:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenflow-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stash(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def drop_stashes(*dfs: DataFrame) -> None:
    """Delete what stash() wrote for these DataFrames; nothing that is still to be read may depend on them."""
    for df in dfs:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(conf).delete(path, True)
