"""Steps that several corpus operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.skew import join_by_key  # noqa: F401
from ..session import discard, settle, settle_last  # noqa: F401

#: Buckets that each group is dealt into before its rows are numbered.
RANK_BUCKETS = 1024
#: Rows of a few numbers each that are broadcast at most (some 8 MB).
BROADCAST_ROWS = 200_000
#: Entries that a task's word cache holds before it starts anew.
WORD_CACHE = 100_000

U64 = np.uint64
#: Odd 64-bit multipliers of the hash mixes (fixed values).
MIX_1, MIX_2, MIX_3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, run, more: list[T.StructField]) -> DataFrame:
    """``df.mapInArrow`` to the columns of ``df`` and ``more``, whose names may hold dots."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType([*plain.schema, *more])
    return plain.mapInArrow(run, schema).toDF(*df.columns, *[f.name for f in more])


def numbered(docs: DataFrame, by: str, out: str) -> DataFrame:
    """``docs`` as a written table with ``out``, a long of its own for each row, in the order of ``by``, nulls last.

    Rows of one ``by`` (or of none) stand apart too, so that no task gets all of them.
    """
    at = docs.withColumn("__at", F.monotonically_increasing_id())
    return settle(at.orderBy(F.col(f"`{by}`").asc_nulls_last(), "__at").drop("__at").withColumn(out, F.monotonically_increasing_id()))


def join_by_size(large: DataFrame, small: DataFrame, on, how: str = "inner", cells: Column | None = None) -> DataFrame:
    """Joins a written table ``small``: broadcast if it is counted to be small, else by shuffling both.

    ``cells``: numbers that a row of ``small`` holds beside its first few, where that is not constant.
    """
    held = small.agg(F.sum(F.lit(1).cast("long") if cells is None else 1 + cells.cast("long")).alias("n")).first()["n"] or 0
    return large.join(F.broadcast(small) if held <= BROADCAST_ROWS else small, on, how)


def row_salt(df: DataFrame) -> Column:
    """A hash of all columns of a row but maps and variants, so that rows that share a key are dealt apart if they differ there."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])


def gapless_rank(df: DataFrame, by: list[str], order: list[Column], salt: Column, out: str, buckets: int = RANK_BUCKETS, about: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: each row's number in its group ``by``, 0, 1, ... without gaps.

    A group is dealt into ``buckets`` buckets by ``salt`` (a hash of the row), so that
    no task orders a whole group; bucket sizes are counted and added up in bucket order. Rows
    of a group stand by bucket and then by ``order``. Null group values form a group.
    ``about``: a table of one row a group, whose other columns follow; it meets the buckets, not the rows.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    dealt = df.withColumn("__bucket", F.pmod(salt, F.lit(buckets)).cast("int")).withColumns({k: F.col(f"`{c}`") for k, c in zip(keys, by)})
    sizes = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"{k}s") for k in keys], F.col("__bucket").alias("__bs"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    more = [] if about is None else [c for c in about.columns if c not in by]
    if about is not None:
        same = F.lit(True)
        for k, c in zip(keys, by):
            same = same & F.col(f"{k}s").eqNullSafe(F.col(f"{k}a"))
        starts = starts.join(about.select(*[F.col(c).alias(f"{k}a") for k, c in zip(keys, by)], *more), same).drop(*[f"{k}a" for k in keys])
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    ranked = dealt.withColumn("__at", F.row_number().over(within) - 1)
    on = F.col("__bucket") == F.col("__bs")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}s"))
    return ranked.join(starts, on).withColumn(out, (F.col("__start") + F.col("__at")).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], out, *more)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable by the edges, for every id on an edge.

    Alternates large-star and small-star contraction; each round is a table in the shared
    folder, and the one before it goes. Minima are aggregated map-side and joined back with
    nodes of very many edges broadcast.
    """
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = join_by_key(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.withColumnRenamed("m", "v"))
        before, now = now, settle(small.distinct())
        for done in (before, least):
            discard(done)
        was, state = state, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == was:
            break
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    ids = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ids)


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U64(30))) * MIX_2
    x = (x ^ (x >> U64(27))) * MIX_3
    return x ^ (x >> U64(31))


#: Bytes of a word that are hashed eight at a time; longer words go through xxHash.
WORD_BYTES = 64
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``raw[start:end]``; at least 7 bytes follow the last word in ``raw``."""
    size = end - start
    eight = np.ndarray(max(len(raw) - 7, 0), "<u8", raw, strides=(1,))
    out = mixed(size.astype(U64) * MIX_1)
    now = np.arange(len(size))
    for i in range(0, WORD_BYTES, 8):
        if i:
            now = now[size[now] > i]
        if not len(now):
            break
        out[now] = mixed(out[now] + (eight[start[now] + i] & _FIRST_BYTES[np.minimum(size[now] - i, 8)]))
    for i in np.flatnonzero(size > WORD_BYTES):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return out


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, U64) * MIX_1
    for i in range(k):
        total = mixed(total + words[i : i + n] * MIX_1)
    return np.unique(total)
