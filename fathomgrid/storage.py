"""Tables in the folder that driver and executors share, in place of cached or locally checkpointed data."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_ending: set[str] = set()


def _hadoop(spark: SparkSession, path: str):
    """The path for Hadoop and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which goes when the application ends.

    Where that is unset, a temporary folder does for one machine; on a cluster it is an error, since executors would
    not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="fathomgrid-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        named = _own[0]
    folder = f"{named.rstrip('/')}/fathomgrid-{spark.sparkContext.applicationId}"
    if folder not in _ending:
        path, fs = _hadoop(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ending.add(folder)
    return folder


def shared_table(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Deletes a table that shared_table made, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path, fs = _hadoop(table.sparkSession, folder)
        fs.delete(path, True)
