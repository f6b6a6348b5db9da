"""Several tables published as one version (SNK-6, SRC-4).

Each version has a folder of its own. Its row in the manifest, one file that Spark's
committer puts in place by a single rename, is written last and says which tables belong to
it and how many rows they have. Readers start from the manifest, so they see a version
whole or not at all, and a writer that breaks off leaves the version before it in force.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

_MANIFEST = "version long, folder string, parts map<string, long>"


def publish(spark: SparkSession, path: str, tables: Mapping[str, DataFrame]) -> str:
    """Write ``tables``, then the manifest row that makes them the newest version."""
    newest = _newest(spark, path)
    version = newest.version + 1 if newest else 1
    folder = f"v{version:06d}-{uuid.uuid4().hex}"
    parts = {}
    for name, table in tables.items():
        part = f"{path}/{folder}/{name}"
        table.write.parquet(part)
        parts[name] = spark.read.parquet(part).count()
    row = spark.createDataFrame([(version, folder, parts)], _MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return f"{path}/{folder}"


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest version. Two writers at once may publish the same number;
    the folder's name then decides, alike for all readers."""
    newest = _newest(spark, path)
    if newest is None:
        raise ValueError(f"nothing is published under {path}")
    found = {}
    for name, rows in newest.parts.items():
        found[name] = spark.read.parquet(f"{path}/{newest.folder}/{name}")
        if found[name].count() != rows:
            raise ValueError(f"{name} of {newest.folder} does not have the {rows} rows it was published with")
    return found


def _newest(spark: SparkSession, path: str) -> Row | None:
    try:
        manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return manifest.orderBy("version", "folder", ascending=False).first()
