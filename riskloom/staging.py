"""Hand-over tables between the passes of one job.

Several operators read their input more than once (edges, totals, final pass).
``stage`` writes that input once as Parquet into the folder the cluster shares,
so later passes scan a narrow columnar table instead of repeating the joins,
and a lost executor costs a re-read, not a re-run of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a fresh shared table and return a scan of it.

    With ``partition_by`` a later filter on those columns reads only its folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riskloom/{name}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
