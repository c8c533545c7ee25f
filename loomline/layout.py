"""Partitioning of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes per core below which a table is dealt out anew.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores if it is small, by the optimiser's estimate of its size.

    A small file holds one row group, which one task reads however the file is cut. Larger tables pass
    unchanged: their files and row groups keep all cores busy, and their bytes do not move.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(n) if int(str(size)) <= n * SMALL else df


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle and sort, for tables that grow with the corpus: none of them passes through the driver, however small Spark takes it for.

    The optimiser's estimate does not see what ``explode`` adds, so that millions of rows look like a table to broadcast.
    """
    return df.hint("merge")
