"""Tables in the folder that driver and executors share.

Executors may be lost at any time, so nothing here lives in one executor's
memory or local disk: an intermediate result is a parquet table below
``spark.checkpoint.dir``.  Only where that setting is absent and Spark runs in
one process (tests) a local folder is made; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Small rows for one task and file.
ROWS_EACH = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marketlake-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marketlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    Where ``rows`` says about how many there are, the last stage has a task for
    each ROWS_EACH of them instead of one for each shuffle partition.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(rows // ROWS_EACH + 1)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
