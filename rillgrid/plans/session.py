"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "rillgrid", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive plans, UTC and Arrow; conf names use __ for dots. An existing session keeps its own master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in given.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="rillgrid-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, reread: its lineage ends there and later passes read its columns alone. It stays until the folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/grid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

