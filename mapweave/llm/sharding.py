"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A topology is a list of regions, a region a list of racks, a rack a list of (shard, weight).
A row descends region, rack and shard; at each level every child makes a hash draw
``-ln(u) / weight`` from the row's key and the child's name, and the least draw wins. A
child's draws don't depend on its siblings, so changed weights move rows only into or out of
the subtrees whose weights changed; a shard that is added as a region of its own takes rows
only into itself and moves no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, row_salt, table

SHARDS, RACK, REGION = 24, 4, 3

Topology = list[list[list[tuple[int, float]]]]


def topology(shards: int = SHARDS, rack: int = RACK, region: int = REGION) -> Topology:
    """``SHARDS`` equal shards in racks and regions; each later shard stands in a region of its own."""
    base = list(range(min(shards, SHARDS)))
    racks = [[(s, 1.0) for s in base[i : i + rack]] for i in range(0, len(base), rack)]
    tree = [racks[i : i + region] for i in range(0, len(racks), region)]
    return tree + [[[(s, 1.0)]] for s in range(SHARDS, shards)]


def _weight(node) -> float:
    return float(node[1]) if isinstance(node, tuple) else sum(map(_weight, node))


def _name(node) -> str:
    """A subtree is named by its smallest shard, which stays when weights change or shards come."""
    return str(node[0]) if isinstance(node, tuple) else _name(min(node, key=lambda x: int(_name(x))))


def _descend(nodes: list, key: list[Column], level: int) -> Column:
    if isinstance(nodes, tuple):
        return F.lit(nodes[0])
    live = [x for x in nodes if _weight(x) > 0]
    if not live:
        raise ValueError("a subtree has no shard of positive weight")
    if len(live) == 1:
        return _descend(live[0], key, level + 1)

    def draw(x) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{level}/{_name(x)}"), *key), 11)
        return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(_weight(x))

    best = F.array_min(F.array(*[F.struct(draw(x).alias("draw"), F.lit(i).alias("at")) for i, x in enumerate(live)]))["at"]
    chosen = F.lit(None).cast("int")
    for i, x in reversed(list(enumerate(live))):
        chosen = F.when(best == i, _descend(x, key, level + 1)).otherwise(chosen)
    return chosen


def shard_of(tree: Topology, *key: Column) -> Column:
    """The shard of a key. Null keys are a key as any other."""
    return _descend(tree, [F.coalesce(k.cast("string"), F.lit("\x00null")) for k in key], 0)


def assign(df: DataFrame, key: str, tree: Topology, shard: str = "shard", slot: str | None = "slot") -> DataFrame:
    """``df`` with its shard and its slot, gapless from 0 in each shard.

    Equal keys, repeated rows included, share a shard; each row has a slot of its own, and rows
    that differ in any column keep theirs in every run. An empty table gives no rows; null keys
    go to one shard. Columns named as the outputs are replaced, others stay whatever their names.
    """
    put = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (shard, slot)]).withColumn(shard, shard_of(tree, F.col(f"`{key}`")).cast("int"))
    if slot is None:
        return put
    salt = F.xxhash64(F.lit("slot"), row_salt(put))
    return gapless_rank(put, [shard], [F.col(f"`{key}`").asc_nulls_first(), row_salt(put)], salt, slot)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = assign(rows, "doc_id", topology(SHARDS))
    return placed.withColumn("grown_shard", shard_of(topology(SHARDS + 1), F.col("doc_id")).cast("int"))
