"""Clip plans from annotated time ranges."""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of clips with a header, all cells text. A file that is missing or has no header is a ValueError."""
    try:
        meta = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException as e:
        raise ValueError(f"no metadata: {path}") from e
    if not meta.columns:
        raise ValueError(f"no header: {path}")
    return meta


def clips_command(spark: SparkSession, path: str, videos: DataFrame, padding: float = 0.0) -> tuple[int, DataFrame | None]:
    """(exit code, plan): 2 without metadata or a header, else 0, whatever becomes of single rows. Columns that name no range
    and unparsable numbers are errors, the latter when the plan is run."""
    try:
        meta = read_metadata(spark, path)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2, None
    return 0, clip_plan(meta, videos, padding)


def clip_outcome(copied: Column, written: Column, decodable: Column, reencoded: Column, decodable_again: Column) -> Column:
    """What became of a planned clip. copied: the copy succeeded (if not, what it left stays); written: there is a file;
    decodable: of the copy; reencoded: the second try succeeded; decodable_again: of its file. Null counts as no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (F.when(~yes(copied), "copy_failed").when(~yes(written), "removed_no_frames").when(yes(decodable), "copied")
            .when(~yes(reencoded), "removed_reencode_failed").when(yes(decodable_again), "reencoded").otherwise("removed_no_frames"))


def range_columns(names: list[str]) -> tuple[str, str]:
    """The start and end column: the second pair if there are two or more."""
    low = {n: n.strip().lower() for n in names}
    starts = [n for n in names if low[n].startswith(("begin", "start")) or low[n].endswith(("begin_s", "start_s"))]
    ends = [n for n in names if low[n].startswith(("end", "stop")) or low[n].endswith(("end_s", "stop_s"))]
    pairs = list(zip(starts, ends))
    if not pairs:
        raise ValueError("no start and end columns")
    return pairs[1] if len(pairs) > 1 else pairs[0]


def clip_plan(meta: DataFrame, videos: DataFrame, padding: float = 0.0, file_col: str | None = None) -> DataFrame:
    """(file, start_s, end_s, clip_name, status). videos: (file, duration_s); a video that is not there is missing, an
    unknown duration does not clamp. Rows with an empty cell are skipped; an unparsable number stops the query."""
    names = meta.columns
    file_col = file_col or ("file" if "file" in names else names[0])
    a, b = range_columns(names)
    cell = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    number = lambda c: F.coalesce(F.expr(f"try_cast(trim(CAST(`{c}` AS STRING)) AS DOUBLE)"), F.raise_error(F.concat(F.lit(f"{c}: not a number: "), F.col(c).cast("string"))).cast("double"))
    m = meta.where(cell(file_col).isNotNull() & cell(a).isNotNull() & cell(b).isNotNull())
    m = m.select(F.col(file_col).alias("file"), F.greatest(F.lit(0.0), number(a) - padding).alias("s"), (number(b) + padding).alias("e"))
    m = m.join(videos.select("file", "duration_s", F.lit(True).alias("there")), "file", "left")
    end = F.least("e", "duration_s")  # least ignores nulls
    status = (F.when(F.col("e") <= F.col("s"), "empty_range").when(F.col("there").isNull(), "missing_video")
              .when(F.col("s") >= F.col("duration_s"), "start_after_end_of_video").when(end <= F.col("s"), "empty_after_clamp").otherwise("ok"))
    suffix = F.regexp_extract("file", r"(\.[^./]+)$", 1)
    stem = F.regexp_extract("file", r"([^/]*?)(\.[^./]+)?$", 1)
    name = F.format_string("%s_clip_%.3f_%.3f%s", stem, F.col("s"), end, F.when(suffix == "", ".mkv").otherwise(suffix))
    return m.select("file", F.col("s").alias("start_s"), end.alias("end_s"), F.when(status == "ok", name).alias("clip_name"), status.alias("status"))
