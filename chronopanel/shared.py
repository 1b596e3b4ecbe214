"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder is set for a local master; on a cluster, where executors
    would write to their own disks, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that stored() wrote, in order.
_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors. The table stays
    until release() takes it away."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    _WRITTEN.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def mark() -> int:
    """A point in time for release()."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Remove the tables that stored() wrote after the mark ``since``, but the last ``keep``; how many went. Call it when
    what was made from them is written: frames that still read them fail afterwards."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    for at in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since : len(_WRITTEN) - keep]
    return len(gone)
