"""Written intermediate tables, and joins that broadcast only what has been measured.

A staged table lives under `spark.checkpoint.dir`, the folder that all executors share. It cuts the
lineage, survives the loss of executors, and gives the planner true sizes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its written size, as counted, is below this many bytes in memory.
BROADCAST_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, a temporary one of this machine, on local masters only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lakmoes-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession | None = None) -> None:
    """Delete the staged tables written so far; results that still read them must have been written."""
    global _written
    kept = []
    for s, path in _written:
        if spark is not None and s is not spark:
            kept.append((s, path))
            continue
        try:
            jvm = s.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; nothing to tidy
            pass
    _written = kept


atexit.register(drop_stages)


def _bytes(name: str, kind: str) -> Column:
    """The bytes of a value in memory: texts and lists by their length, structs and maps by 64 for each part."""
    width = {"int": 4, "bigint": 8, "double": 8, "smallint": 2, "boolean": 1, "tinyint": 1, "date": 4, "timestamp": 8}
    c = F.col(f"`{name}`")
    if kind in width:
        return F.lit(width[kind]).cast("bigint")
    if kind in ("string", "binary"):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    if kind.startswith(("array", "map")):
        each = width.get(kind[6:-1], 64) if kind.startswith("array") else 128
        return 16 + F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint") * each
    return F.lit(64 * (1 + kind.count(","))).cast("bigint")


def measured_bytes(df: DataFrame) -> int:
    """The bytes of all rows in memory, counted over df."""
    each = sum((_bytes(n, t) for n, t in df.dtypes), F.lit(16).cast("bigint"))
    return int(df.agg(F.sum(each)).first()[0] or 0)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured size is below the limit, else unchanged.

    df must be cheap to read: a staged table or a table of fixed size.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores by key, if it comes in fewer than half as many parts; else as it is.

    For scans before work on whole texts: a small file is one part, however much text it holds. df must be a
    scan with at most filters and projections.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, key)
