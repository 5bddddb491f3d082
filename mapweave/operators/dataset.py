"""Verbs over whole tables: a DataFrame as an unordered collection of records.

Order, where it matters, comes from a column that the caller names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import truthy


def where(df: DataFrame, p: Column) -> DataFrame:
    return df.where(truthy(p))


def iterate(df: DataFrame, **outs: Column) -> DataFrame:
    """A record of ``outs`` from each record; records that are null in all of them go."""
    made = df.select(*[c.alias(n) for n, c in outs.items()])
    return made.dropna(how="all")


def group_by(df: DataFrame, key: Column, element: Column, order: Column | None = None) -> DataFrame:
    """(key, elements): elements in the order of ``order``. Prefer ``fold`` where the elements are only reduced."""
    item = F.struct(order.alias("o"), element.alias("e")) if order is not None else F.struct(element.alias("e"))
    grouped = df.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("key", F.transform("items", lambda x: x["e"]).alias("elements"))


def fold(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Grouped reductions as native aggregates, partial before the shuffle."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def unique_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first record of each key by ``order``; a partial aggregate, no window over hot keys."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*key, "r.*").select(*df.columns)


def last_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    final = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return final.select(*key, "r.*").select(*df.columns)


def ranked(df: DataFrame, key: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Each record's place in its group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Greedy one-to-one full outer join on equal keys: the nth of a key meets the nth of that key.

    Columns of the sides come back as structs ``left`` and ``right``; null keys match each other.
    """

    def side(df: DataFrame, order: list[str], name: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return df.select(F.col(key).alias(f"{name}_key"), at.alias(f"{name}_at"), F.struct("*").alias(name))

    a, b = side(left, left_order, "left"), side(right, right_order, "right")
    return a.join(b, F.col("left_key").eqNullSafe(F.col("right_key")) & (F.col("left_at") == F.col("right_at")), "full_outer").select(F.coalesce("left_key", "right_key").alias("key"), F.coalesce("left_at", "right_at").alias("at"), "left", "right")

