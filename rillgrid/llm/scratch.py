"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` of the session names the folder. Where it is unset a
local session gets a temporary one; a cluster without it is refused, since its
executors would not see each other's files.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

_TABLES: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; set for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="rillgrid-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends, statistics are known, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/rillgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 6 << 20
KEYS_BYTES = 24 << 20  # for keys that pick whole texts: a shuffle would move the texts


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table, marked for a broadcast if its rows take at most so many bytes; beyond that joins shuffle it."""
    return F.broadcast(df) if room(df) <= most else df


def room(df: DataFrame) -> int:
    """The bytes that the rows of df take in memory, about; 0 without rows."""
    fixed = 64 + 8 * len(df.columns)  # the row, and its place in a hash table that is at most half full
    long = [F.coalesce(F.octet_length(F.col(c).cast("string") if k != "binary" else F.col(c)), F.lit(0)) for c, k in df.dtypes if k in ("string", "binary")] + [F.coalesce(8 * F.size(c), F.lit(0)) for c, k in df.dtypes if k.startswith("array")]
    return df.agg((F.count("*") * fixed + (F.coalesce(sum((F.sum(x) for x in long[1:]), F.sum(long[0])), F.lit(0)) if long else F.lit(0))).alias("b")).first().b


BATCH_ROWS, _ROWS = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator(docs, ...), whose own jobs pass Arrow batches of at most BATCH_ROWS rows: whole sets and texts would make large ones. The session's setting is back afterwards."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(_ROWS)
        conf.set(_ROWS, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
        try:
            return operator(docs, *args, **options)
        finally:
            conf.set(_ROWS, before)

    return run


@contextlib.contextmanager
def scope() -> Iterator[list]:
    """Collects the tables written inside, for release() once results that read them are themselves written."""
    begin, held = len(_TABLES), []
    try:
        yield held
    finally:
        held += _TABLES[begin:]


def release(tables: list | None = None) -> None:
    """Deletes some of the tables, or at the end of the program all of them."""
    drop = list(_TABLES if tables is None else tables)
    _TABLES[:] = [x for x in _TABLES if x not in drop]
    for spark, path in drop:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is temporary either way
            pass


atexit.register(release)
