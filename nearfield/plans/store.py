"""Intermediate tables in the folder all executors share, and saved indexes."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[tuple[str, str], str] = {}


def workdir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the JVM deletes when it ends.

    Only a session on one machine may leave that unset; it gets a temporary folder.
    """
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if (app, root or "") not in _folders:
        own = f"{root or 'file://' + tempfile.gettempdir()}/nearfield-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[app, root or ""] = own
    return f"{_folders[app, root or '']}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it back: computed once, lineage ends here, and any executor can be lost."""
    path = workdir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(tables: dict[str, DataFrame], meta: dict, path: str) -> None:
    """One Parquet table for each component and a row of JSON for the parameters; replaces what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = df.sparkSession
    spark.createDataFrame([(json.dumps(meta | {"tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}, meta
