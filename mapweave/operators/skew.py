"""Joins whose heavy keys don't fill one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one in so many rows is heavy, so that there are no more heavy keys than this.
HEAVY = 2000
#: Rows of one key that a task takes in any case.
FEW = 1000


def join_by_key(rows: DataFrame, keyed: DataFrame, on: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a key and in ``count`` how many rows have it.

    Heavy keys are broadcast, of which there are ``HEAVY`` at most by their share of the rows;
    the others shuffle, at any size, so that what is written grows as the rows do. ``keyed`` is
    read several times: give a written table. Null keys match nothing.
    """
    top = keyed.agg(F.sum(count).alias("all"), F.max(count).alias("most")).first()
    least = max((top["all"] or 0) / HEAVY, FEW)
    if (top["most"] or 0) <= least:
        return rows.join(keyed.hint("merge"), on)
    heavy, light = F.col(count) > least, F.col(count) <= least
    names = keyed.where(heavy).select(*on)
    by_heavy = rows.join(F.broadcast(keyed.where(heavy)), on)
    by_light = rows.join(F.broadcast(names), on, "left_anti").join(keyed.where(light).hint("merge"), on)
    return by_heavy.unionByName(by_light)
