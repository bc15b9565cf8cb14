"""Parallelism that follows the input, whatever row groups its files have."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input (as Catalyst estimates it, from file sizes) for a task, and tasks at most.
TASK_BYTES = 2 << 20
MOST_TASKS = 20_000
#: Estimates from here on say that Catalyst knows no size.
UNKNOWN_BYTES = 1 << 50


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deals the rows out by the hash of their columns, or of those of `by`, for work that costs much more than moving its rows: a task for each TASK_BYTES, at least two a core.

    A file may be one row group whatever its size, which one task would read and work on. An input of that many files stays as
    its scan splits it, and so does one of unknown size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(2 * cores, min(MOST_TASKS, -(-size // TASK_BYTES)))
    return df if size >= UNKNOWN_BYTES or len(df.inputFiles()) >= tasks else df.repartition(tasks, *(by or df.columns))
