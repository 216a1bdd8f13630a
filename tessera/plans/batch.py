"""Several statements as one: their results in order; writes are kept together or not at all."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.query import Query

#: Queries that run at once; Spark shares its executors among their jobs.
AT_ONCE = 4


def batch(db, statements: Sequence[Query | DataFrame | Callable[[], Any]]) -> list[Any]:
    """Queries give rows; callables are writes, run in a transaction. Each sees the writes before it in the given order and
    none behind it: a query's tables are snapshots, taken at its turn."""
    out: list[Any] = [None] * len(statements)
    frames: dict[int, DataFrame] = {}
    with db.transaction():
        for i, s in enumerate(statements):
            if callable(s):
                out[i] = s()
            else:
                frames[i] = s.frame() if isinstance(s, Query) else s
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for i, rows in zip(frames, pool.map(lambda df: df.collect(), frames.values()), strict=True):
            out[i] = rows
    return out


def counts(queries: dict[str, Query]) -> DataFrame:
    """One row for each query: its name and count; one plan."""
    return reduce(DataFrame.unionByName, [q.count_frame("n").select(F.lit(name).alias("name"), "n") for name, q in queries.items()])
