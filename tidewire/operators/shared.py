"""Tables written under the cluster's shared folder, to cut lineage where a job reads its own result several times."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def _remove_made() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be removed any more
            pass


atexit.register(_remove_made)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run in ``spark.checkpoint.dir`` (a temporary one in a local session without it); it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame) -> DataFrame:
    """The table written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
