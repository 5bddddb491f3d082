"""Near-duplicate embeddings by lattice hashing.

Unit vectors are put through random projections into blocks of eight dimensions; each block
is decoded to the nearest point of the lattice E8, shifted at random, and the points of a
table's blocks together are its cell. Every vector stands in its own cell of each table and
probes the neighbouring cell whose border is nearest. Vectors that meet in a cell pass a
comparison of sign bits before their cosine is computed in double precision.

Meetings serve to find components only. The members of crowded cells are first compared with a
few of them, and all others of a cell only where they are not in one component yet. Linked
vectors lie in one component, so each vector's links are then counted inside its component by
matrix products of bounded blocks, and no row is made for a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_1, U64, components, join_by_key, join_by_size, mixed, settle, table

COSINE = 0.9
PROBES = 1
#: Lattice units to the unit of length, and far vectors that one meets in all its cells, about.
SCALE, FAR = 0.8, 500
#: Sign bits that may differ, of 128: six standard deviations over those of a pair at the threshold.
SIGN_BITS, MOST_DIFFERENT = 128, 44
#: Members from which a cell is crowded, members that it is compared with at first, and vectors of a block of products.
CROWDED, PIVOTS, BLOCK = 256, 8, 2000
SEED = 5


def e8_decode(y: np.ndarray) -> np.ndarray:
    """Twice the nearest point of E8 (integers) to each row of eight numbers."""

    def d8(x: np.ndarray) -> np.ndarray:
        near = np.rint(x)
        gap = x - near
        worst = np.abs(gap).argmax(-1)[..., None]
        step = np.where(np.take_along_axis(gap, worst, -1) >= 0, 1.0, -1.0)
        odd = (near.sum(-1) % 2 != 0)[..., None]
        np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + np.where(odd, step, 0.0), -1)
        return near

    whole, half = d8(y), d8(y - 0.5) + 0.5
    nearer = (((y - whole) ** 2).sum(-1) <= ((y - half) ** 2).sum(-1))[..., None]
    return np.rint(2 * np.where(nearer, whole, half)).astype(np.int64)


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: all (+-1, +-1, 0 ...) and all halves with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        if bin(signs).count("1") % 2 == 0:
            out.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


ROOTS = e8_roots()


def tables_for(n_blocks: int) -> int:
    """Tables so that a pair at the threshold, which meets in one with some 0.34 for three blocks and half as much for each more, is missed by 4 in 100 at most."""
    return max(8, math.ceil(3.2 / (0.336 * 0.524 ** (n_blocks - 3))))


def blocks_for(rows: int) -> int:
    """Lattice blocks of a table, so that a vector meets ``FAR`` far ones in all."""
    far = lambda n: rows * 2 * tables_for(n) * 0.45 * 0.097**n
    return next((n for n in range(2, 8) if far(n) <= FAR), 8)


def projections(dim: int, n_blocks: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    lattice = rng.standard_normal((dim, tables * n_blocks * 8)) * SCALE / math.sqrt(8)
    return lattice, rng.random((tables * n_blocks, 8)) * 2, rng.standard_normal((dim, SIGN_BITS))


def cells(x: np.ndarray, n_blocks: int, probes: int = PROBES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(n, tables, 1 + probes) cell keys of unit vectors, the own cell first, and (n, 2) sign bits."""
    tables = tables_for(n_blocks)
    lattice, shift, signs = projections(x.shape[1], n_blocks, tables, seed)
    y = (x @ lattice).reshape(len(x), tables * n_blocks, 8) + shift
    point = e8_decode(y)
    rest = y - point / 2
    border = rest @ ROOTS.T
    root = border.argmax(-1)
    edge = np.take_along_axis(border, root[..., None], -1)[..., 0].reshape(len(x), tables, n_blocks)
    beside = point + np.rint(2 * ROOTS[root]).astype(np.int64)

    def hashed(p: np.ndarray) -> np.ndarray:
        h = np.full(p.shape[:-1], 7, U64)
        for i in range(8):
            h = mixed(h + p[..., i].astype(U64) * MIX_1)
        return h

    place = np.arange(tables * n_blocks, dtype=U64) * MIX_1
    own, other = (mixed(hashed(p) + place).reshape(len(x), tables, n_blocks) for p in (point, beside))
    keys = [own.sum(-1, dtype=U64)]
    order = np.argsort(-edge, -1)
    for p in range(min(probes, n_blocks)):
        at = order[..., p : p + 1]
        keys.append(keys[0] + (np.take_along_axis(other, at, -1) - np.take_along_axis(own, at, -1))[..., 0])
    bits = np.packbits(x @ signs >= 0, axis=1).view("<i8")
    return mixed(np.stack(keys, -1)).view(np.int64), bits


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The valid vectors of a batch as (positions, list of vectors) of unit length, in double precision."""
    good, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.array(v, float)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                good.append(i)
                rows.append(x / np.sqrt((x * x).sum()))
    return good, rows


def meetings(vectors: DataFrame, n_blocks: int) -> DataFrame:
    """(cell, own, id, s1, s2) of every row of ``vectors`` (id, v); own: its own cell, not a probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                good, rows = unit(part.column(1))
                ids = part.column(0).to_numpy()
                for dim in sorted({len(r) for r in rows}):
                    at = [k for k, r in enumerate(rows) if len(r) == dim]
                    keys, bits = cells(np.array([rows[k] for k in at]), n_blocks)
                    keys = mixed(keys.view(U64) + np.full(1, dim, U64) * MIX_1).view(np.int64)
                    n, each = len(at), keys.shape[1] * keys.shape[2]
                    own = np.tile(np.arange(keys.shape[2]) == 0, n * keys.shape[1])
                    who = np.repeat(ids[[good[k] for k in at]], each)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(own), pa.array(who), pa.array(np.repeat(bits[:, 0], each)), pa.array(np.repeat(bits[:, 1], each))], names=["cell", "own", "id", "s1", "s2"])

    return vectors.mapInArrow(run, "cell long, own boolean, id long, s1 long, s2 long")


def linked(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether vectors in the same places of two arrays reach the threshold, in double precision."""
    v, w = (z / np.abs(z).max(1, keepdims=True) for z in (v, w))
    return (v * w).sum(1) / np.sqrt((v * v).sum(1) * (w * w).sum(1)) >= COSINE


def cosines(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows of ``pairs`` (a, b, va, vb) whose cosine reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                x, y = (part.column(i).to_pylist() for i in (2, 3))
                good = np.zeros(part.num_rows, bool)
                for dim in {len(v) for v in x}:
                    at = [i for i in range(len(x)) if len(x[i]) == len(y[i]) == dim]
                    if at:
                        good[at] = linked(*(np.array([z[i] for i in at], float) for z in (x, y)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good))

    return pairs.mapInArrow(run, "a long, b long")


def degrees(rows: DataFrame) -> DataFrame:
    """(id, links) of ``rows`` (component, id, n, m, v): the vectors, ``n`` times each, that each one links with.

    Small components share groups; one of many members is cut into ``m`` parts, and every two
    parts meet in a group of their own.
    """
    many = rows.agg(F.count("*").alias("n")).first()["n"] // BLOCK + 1
    dealt = rows.withColumn("p", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    low, high = F.least("p", "q"), F.greatest("p", "q")
    dealt = dealt.withColumn("g", F.when(F.col("m") == 1, F.pmod(F.xxhash64("component"), F.lit(many))).otherwise(F.xxhash64("component", low, high)))

    def run(group: pa.Table) -> pa.Table:
        ids, comp, n, part, place = (group.column(k).to_numpy() for k in ("id", "component", "n", "p", "q"))
        _, vectors = unit(group.column("v").combine_chunks())
        links = np.zeros(len(ids), np.int64)
        order = np.argsort(comp, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            x = np.array([vectors[k] for k in at])
            cos = x @ x.T
            near = cos >= COSINE
            close = np.argwhere(np.abs(cos - COSINE) < 1e-9)
            for i in range(0, len(close), 4096):
                a, b = close[i : i + 4096].T
                near[a, b] = linked(x[a], x[b])
            np.fill_diagonal(near, False)
            if part[at].min() < part[at].max():  # two parts: pairs inside a part are counted where it meets itself
                near &= part[at][:, None] != part[at][None, :]
            elif place[at].min() < place[at].max() or (place[at] != part[at]).any():
                near[:] = False
            links[at] = near @ n[at]
        return pa.table({"id": pa.array(ids), "links": pa.array(links)})

    counted = dealt.select("g", "id", "component", "n", "p", "q", "v").groupBy("g").applyInArrow(run, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def _close(met: DataFrame) -> DataFrame:
    """The rows (id, s1, s2, b, t1, t2) of two vectors that differ in few sign bits, with ``differ``."""
    differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    return met.withColumn("differ", differ).where((F.col("id") != F.col("b")) & (F.col("differ") <= MOST_DIFFERENT))


def _pairs(close: DataFrame) -> DataFrame:
    """(a, b), once each."""
    return close.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing; vectors of different dimensions don't link; equal vectors are one class, whose
    members all link with each other. Rows with equal keys are vectors of their own. Rows
    without a key link as all others; component_id is the smallest key reachable, null if no
    row there has one; kept is whether key and component_id are the same, both null too. An
    empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)), F.transform("v", lambda x: x + 0.0)))
    valid = rows.where("v is not null").select("key", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"), "v")
    grouped = valid.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("key").alias("top"), F.count("*").alias("n"))
    classes = settle(grouped.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "v", "top", "n"))
    met = settle(meetings(classes.select("id", "v"), blocks_for(classes.count())))
    vectors = classes.select("id", "v")

    def confirmed(pairs: DataFrame) -> DataFrame:
        made = settle(pairs)
        asked = made.groupBy("a").agg(F.count("*").alias("n"))
        va = settle(asked.join(vectors.withColumnsRenamed({"id": "a", "v": "va"}), "a"))
        both = join_by_key(made, va, ["a"], "n").join(vectors.withColumnsRenamed({"id": "b", "v": "vb"}), "b")
        return settle(cosines(both.select("a", "b", "va", "vb")))

    # crowded cells: every member with the likeliest of a few that are drawn by hash
    drawn = F.struct(F.xxhash64("cell", "id").alias("draw"), "id", "s1", "s2")
    sizes = met.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= CROWDED)
    crowded = settle(sizes)
    in_crowd = settle(join_by_key(met, crowded, ["cell"], "n"))
    split = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(PIVOTS))
    drawn = in_crowd.where("own").groupBy("cell", split.alias("k")).agg(F.min(drawn).alias("d")).groupBy("cell").agg(F.collect_list("d").alias("pivots"))
    pivots = settle(crowded.join(drawn, "cell"))
    stars = join_by_key(in_crowd.drop("n"), pivots, ["cell"], "n").select("id", "s1", "s2", F.explode("pivots").alias("d"))
    close = _close(stars.select("id", "s1", "s2", F.col("d.id").alias("b"), F.col("d.s1").alias("t1"), F.col("d.s2").alias("t2")))
    links = confirmed(_pairs(close.groupBy("id").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))))
    found = settle(components(links))

    # the rest of a cell's pairs, of vectors that are not in one component yet
    placed = join_by_size(met, found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mine = placed.where("own").select("cell", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    once = ~F.col("own") | (F.col("id") < F.col("b"))
    rest = placed.join(mine, "cell").where(once & (F.col("c") != F.col("cb")))
    links = settle(links.unionByName(confirmed(_pairs(_close(rest)))))
    found = settle(components(links))

    sized = settle(found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"), F.count("*").alias("members")))
    inside = settle(join_by_key(found, sized, ["component"], "members").drop("members").join(classes.select("id", "n", "v", "top"), "id"))
    tops = settle(inside.groupBy("component").agg(F.min("top").alias("least"), F.count("*").alias("members")))
    named = join_by_key(inside.select("component", "id"), tops, ["component"], "members").select("id", "least")
    counted = degrees(inside.drop("top"))
    known = classes.join(counted, "id", "left").join(named, "id", "left")
    known = settle(known.select("h1", "h2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("links").isNull(), F.col("top")).otherwise(F.col("least")).alias("component_id")))
    done = join_by_key(valid.drop("v"), known, ["h1", "h2"], "n").select("key", "n_links", "component_id")
    alone = rows.where("v is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return done.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
