"""Lineage cuts that survive lost executors.

Tables are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir`` and read back, so that no later stage depends on an executor's
local disk. Only where that setting is missing (tests, notebooks) a local folder is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []
#: Names in the catalog of staged tables that are dealt into buckets, by path.
_named: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="relsat-shared-")
    return _own_dir


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/relsat/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, tag: str = "stage", codec: str = "lz4") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it (same columns)."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, tag: str, n: int, by: str, into: str | None = None) -> str:
    """Write ``df`` as a table in ``n`` buckets of ``by``, or append it to such a table, and return the
    table's name: what asks for these buckets later needs no exchange. ``df`` should come dealt out
    like that (``repartition(n, by)``), so that a bucket gets one file."""
    name = into
    if name is None:
        path = new_path(df.sparkSession, tag)
        name = _named[path] = f"relsat_{uuid.uuid4().hex}"
    path = next(p for p, x in _named.items() if x == name)
    df.write.mode("append").bucketBy(n, by).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    return name


def remove(spark: SparkSession, path: str) -> None:
    if path in _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop(path)}")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Remove the staged tables that ``df`` reads; nothing may use them afterwards."""
    read = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for spark, path in list(_written):
        if path.rsplit("/", 1)[-1] in read:
            _written.remove((spark, path))
            remove(spark, path)


def mark() -> int:
    """A point in time, for ``sweep``."""
    return len(_written)


def sweep(since: int, *used: DataFrame) -> None:
    """Remove what was staged after ``since`` and is read by none of ``used``."""
    read = {f.rsplit("/", 2)[-2] for df in used for f in df.inputFiles()}
    for spark, path in _written[since:]:
        if path.rsplit("/", 1)[-1] not in read:
            remove(spark, path)
    _written[since:] = [x for x in _written[since:] if x[1].rsplit("/", 1)[-1] in read]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session may be gone; its folder goes with it
            return
