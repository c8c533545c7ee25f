"""Helpers for the Arrow-batched operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handled at a time inside a Python worker. Bounds its memory; results do not depend on it.
BLOCK_CHARS = 1 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker, in the pipeline. Bounds the buffers of both sides; results do not depend on it.
BATCH_BYTES = 4 << 20


def release() -> None:
    """Give memory freed at a task's end back to the system: workers live on, side by side with the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries trim by themselves
        ctypes.CDLL(None).malloc_trim(0)


_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batch_limit(spark: SparkSession) -> Iterator[None]:
    """Puts the session's limit of an Arrow batch back at the end of the block."""
    before = spark.conf.get(_LIMIT)
    try:
        yield
    finally:
        spark.conf.set(_LIMIT, before)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to ``BATCH_BYTES``; a lower one is kept. It stays so, unless :func:`batch_limit` is around it."""
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_LIMIT))
    if limit <= 0 or limit > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def blocks(texts: list, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Split ``texts`` into runs of at most ``limit`` characters (a longer text is a run of its own)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def per_text(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[list], dict]], limit: int = BLOCK_CHARS) -> DataFrame:
    """Apply a function of whole texts, block by block, keeping the id.

    ``limit`` bounds the characters of a block. ``make`` runs once a task on the executor and returns ``f(texts) -> {column: list or Arrow array}``;
    null texts reach it as ``None``. Only the two columns named are read, so other columns of ``df``,
    whatever they are called, neither travel nor clash. The task's rows stay in order.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    out = f"{id_col} {id_type}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for s, e in blocks(["" if t is None else t for t in texts], limit):
                cols = f(texts[s:e])
                arrays = [ids.slice(s, e - s)] + [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in cols.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *cols])
            del b, ids, texts
        if hasattr(f, "close"):
            f.close()
        release()

    return src.mapInArrow(run, out)
