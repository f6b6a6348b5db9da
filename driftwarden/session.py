"""Session defaults, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "driftwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned with.

    Shuffle partitions are left to the cluster: adaptive execution merges small
    ones, and a fixed number would be wrong at either end of the size range.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder for checkpoints and scratch tables.

    Taken from ``spark.checkpoint.dir``. Where it is unset, local sessions get a
    temporary folder; clusters get none, since a machine-local folder is not
    visible to other machines.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        if configured is None and context.master.startswith("local"):
            configured = tempfile.mkdtemp(prefix="driftwarden-")
        if configured is None:
            return None
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return configured or current


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once; later passes read the stored rows.

    Used for per-user frames that several statistics passes share, so that the logs behind
    them are scanned once. They are Parquet in the shared folder: a pass reads the columns
    it needs, and stored rows survive lost executors. They are deleted when the session's
    process ends, or by ``release``. On a cluster that names no shared folder the frame is
    persisted instead and lost blocks are recomputed from lineage.
    """
    spark = df.sparkSession
    if shared_folder(spark) is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = scratch_path(spark, "rows")
    _own(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_owned: list[tuple] = []  # Hadoop file systems and paths


def _own(spark: SparkSession, path: str) -> None:
    if not _owned:
        atexit.unregister(release)
        # After Spark's own handlers, hence before them at the end: the JVM still answers.
        atexit.register(release)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _owned.append((place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place))


def release() -> None:
    """Delete the tables that ``materialize`` stored; frames that read them are void."""
    while _owned:
        files, place = _owned.pop()
        try:
            files.delete(place, True)
        except (Py4JError, OSError):
            pass  # the JVM is gone; the folder's owner clears what it left


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
