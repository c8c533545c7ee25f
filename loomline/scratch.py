"""Shared working storage: lineage is cut by tables written where every executor can read them.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is absent
(unit tests on a local master) does :func:`shared_dir` choose a folder of its own.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Folders of the tables that this process wrote and still holds.
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Tables written since each :func:`tidy` block that is open began.
_OPEN: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; a temporary one only on a local master without the setting."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="loomline-")
        sc.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path + "/t")
    table = spark.read.schema(df.schema).parquet(path + "/t")
    _TABLES[table] = path
    if _OPEN:
        _OPEN[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` returned, once nothing unwritten depends on them; other frames are left alone."""
    for t in tables:
        path = _TABLES.pop(t, None)
        if path is not None:
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def tidy() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops the tables that are written inside the block when it ends, but for those passed to the function that it yields."""
    mine: list[DataFrame] = []
    _OPEN.append(mine)

    def keep(table: DataFrame) -> DataFrame:
        mine[:] = [t for t in mine if t is not table]
        if len(_OPEN) > 1 and _OPEN[-1] is mine:
            _OPEN[-2].append(table)
        return table

    try:
        yield keep
    finally:
        _OPEN.pop()
        discard(*mine)
