"""Scanning a landing folder as a stream: each document once, across restarts, with late copies of known ones left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakmoes.operators.detectors import scan_documents


def documents(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scan_stream(docs: DataFrame, keys: list[str], out: str, checkpoint: str, arrived: str | None = None, late: str = "7 days", own_domains: tuple[str, ...] = (), enabled: dict[str, bool] | None = None, **cols) -> StreamingQuery:
    """Scan what has landed and stop: masked findings under `out`, progress under `checkpoint`.

    The file sink and the checkpoint make a restarted run go on where the last one committed. Documents with
    equal keys are scanned once: without a time column for as long as the state is kept, with one within `late`.
    """
    once = docs.withWatermark(arrived, late).dropDuplicatesWithinWatermark(keys) if arrived else docs.dropDuplicates(keys)
    found = scan_documents(once, keys, own_domains, enabled, **cols)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
