"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "casewright", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings every operator assumes.

    Cluster sizing (executors, memory, shuffle partitions) is left to the
    submitter; AQE coalesces or splits shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _temporary_folder(application_id: str) -> tempfile.TemporaryDirectory:
    """Removed when the driver process ends."""
    return tempfile.TemporaryDirectory(prefix=f"casewright-{application_id}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share for intermediate tables: the one the cluster
    names in ``spark.checkpoint.dir``. Only where that is unset and everything runs
    in one process (tests, local runs) a temporary one is used."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return _temporary_folder(spark.sparkContext.applicationId).name


_OWN_FOLDERS: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, for tables that no one needs
    after it: deleted when the application ends."""
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/{context.applicationId}"
    if path not in _OWN_FOLDERS:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
        _OWN_FOLDERS.add(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps then survive lost executors without recomputing ``df``, read only
    the columns they need, and Spark knows the table's true size when it chooses
    between a broadcast and a shuffle join.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
