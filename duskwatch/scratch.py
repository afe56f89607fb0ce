"""Tables written half-way through a job, in the folder all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Application id -> folder of this machine, for local sessions that name no folder.
_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name under the shared folder the session names.

    Only a session that runs on this machine alone may name none; its tables are removed
    when the program ends. On a cluster the folder is the caller's to clean, best by the
    life time rule of its store: tables in it may be read as long as the session lives.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"Set {CHECKPOINT_DIR} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.TemporaryDirectory(prefix="duskwatch-", ignore_cleanup_errors=True)
        base = _local_folders[app].name
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as parquet and read it back: a lineage cut that outlives executors."""
    path = path or scratch_folder(df.sparkSession)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
