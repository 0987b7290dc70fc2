"""Tables written between the steps of a long plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _qualified(spark: SparkSession, base: str) -> str:
    """A bare path belongs to the cluster's default file system; file:/ becomes file:///."""
    if "://" in base:
        return base
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri if "://" in uri else uri.replace("file:/", "file:///", 1)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``, which executors and driver share.

    Where the setting is absent a session in local mode gets a temporary folder; a cluster has none that all
    see, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_veritab_shared", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        base = spark._veritab_shared = "file://" + tempfile.mkdtemp(prefix="veritab-")
    return f"{_qualified(spark, base).rstrip('/')}/veritab-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again.

    Later steps start from a short plan, and a lost executor replays none of the work before.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
