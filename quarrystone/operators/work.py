"""Work tables that cut lineage in loops: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; without the setting, a temporary one for a local master, else one of the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = tempfile.gettempdir() + "/quarrystone-work" if local else spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    path = f"{root.rstrip('/')}/qs-{uuid.uuid4().hex}"
    # The tables go with the session, which may read them until then.
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def few(df: DataFrame, most: int = 10_000) -> list:
    """Rows of a table that must be small, for plans that hold them as literals; more than ``most`` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def written(df: DataFrame, path: str, name: str, codec: str = "snappy") -> DataFrame:
    df.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
