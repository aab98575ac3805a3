"""Shared pieces: row keys, Arrow batches and folds; the shared folder and components come from the library's own plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import components, drop_path, drop_since, fresh_path, materialise, prepare, shared_dir, written

__all__ = ["arrow_map", "components", "drop_path", "drop_since", "free_name", "fresh_path", "join_hot", "materialise", "must_be_free", "prepare", "remainder", "shared_dir", "text_bytes", "worker_held", "written"]


def remainder(column: str, n: int) -> Column:
    """crc32 of a column's text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


_held: dict = {}


def worker_held(key, make: Callable):
    """What a Python worker keeps between tasks: one model at a time, so that a worker that serves many stages doesn't hold them all."""
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def must_be_free(df: DataFrame, names) -> None:
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the table has columns of these names already: {sorted(taken)}")


def join_hot(rows: DataFrame, table: DataFrame, key: str, parts: int = 512) -> DataFrame:
    """A left join with a table of one row a key.  Keys with over 1 / ``parts`` of all rows, fewer than ``parts`` of them, are
    joined by broadcast, so that no task gets all rows of one; rows should be a stored table, as they are read again."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    least = max(1000, rows.count() // parts)
    hot = [r[0] for r in counts.where(F.col("count") > least).select(key).collect()]
    if not hot:
        return rows.join(table, key, "left")
    is_hot = F.col(key).isin(hot)
    near = rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, "left")
    return near.unionByName(rows.where(~F.coalesce(is_hot, F.lit(False))).join(table.where(~is_hot), key, "left"))


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            out = function(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)
