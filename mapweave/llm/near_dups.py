"""b-bit MinHash near-duplicates of whole texts.

Each text becomes the set of its distinct word shingles. Bands of MinHash minima give
candidate buckets; the low bits of the minima, packed in bit planes, give an estimate of the
similarity by bit counts, corrected for chance agreement; links are confirmed on the full sets.

Equal sets are one class from the start. A bucket first offers its members its smallest and
its largest one only, and each text is confirmed with the likeliest earlier one. Where a bucket
still spans several components after that, its members of different components are compared in
blocks, bounded by their shingles and members, which give back links only, not their candidate
pairs. Components are exact on the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_1, U64, WordHashes, components, join_by_key, join_by_size, mixed, settle, shingles, table

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
MINIMA, ROWS, BITS = 128, 4, 4
#: Estimates below this are not confirmed: five standard deviations under the threshold.
ESTIMATE = 0.55
#: Members of a bucket with several components, and shingles in their sets, that are compared in one group, about.
BLOCK, BLOCK_SHINGLES = 2000, 1 << 21

_rng = np.random.Generator(np.random.PCG64(11))
MULTIPLY = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * U64(2) + U64(1)
ADD = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
CHUNK = 256


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode().lower().split()


def minima(values: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, U64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(values), CHUNK):
        np.minimum(least, (values[i : i + CHUNK, None] * MULTIPLY + ADD).min(0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of the minima as bit planes of ``MINIMA`` bits each."""
    low = mixed(least) & U64((1 << BITS) - 1)
    planes = (low[None, :] >> np.arange(BITS, dtype=U64)[:, None] & U64(1)).astype(np.uint8)
    return np.packbits(planes, axis=1).view("<i8").reshape(-1)


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` minima."""
    rows = least.reshape(-1, ROWS)
    key = np.arange(len(rows), dtype=U64) * MIX_1
    for i in range(ROWS):
        key = mixed(key + rows[:, i])
    return key.view(np.int64)


def estimate(x: Column, y: Column) -> Column:
    """Similarity by bit counts of two packed signatures, corrected for minima that agree by chance."""
    lanes = MINIMA // 64
    agree = F.lit(MINIMA)
    for lane in range(lanes):
        differ = None
        for plane in range(BITS):
            d = x[plane * lanes + lane].bitwiseXOR(y[plane * lanes + lane])
            differ = d if differ is None else differ.bitwiseOR(d)
        agree = agree - F.bit_count(differ)
    chance = 1 / (1 << BITS)
    return (agree / F.lit(MINIMA) - chance) / (1 - chance)


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, n_shingles, f1, f2, sig, bands); f1, f2: fingerprint of the set, th: hash of the text."""
    schema = "id long, th long, n_shingles long, f1 long, f2 long, sig array<long>, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, prints, sigs, keys = [], [], [], []
            for body in batch.column(2):
                values = shingles(hashes.of(words_of(body.as_py())), SHINGLE)
                n.append(len(values))
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64))
                least = minima(values) if len(values) else None
                sigs.append(packed(least) if len(values) else None)
                keys.append(bands(least) if len(values) else None)
            f = np.array(prints, np.int64).reshape(-1, 2)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(sigs, longs), pa.array(keys, longs)], names=["id", "th", "n_shingles", "f1", "f2", "sig", "bands"])

    return texts_of(docs, key, text).mapInArrow(run, schema)


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, text)."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))


def with_sets(docs: DataFrame) -> DataFrame:
    """``docs`` (ids..., text) with the set of each text in place of the text."""
    names = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sets = [shingles(hashes.of(words_of(t.as_py())), SHINGLE).view(np.int64) for t in part.column(len(names))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], names=[*names, "set"])

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", set array<long>")


def sets_of(classes: DataFrame, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(cls, set) of the classes in the written table ``wanted`` (cls), each from one of its texts.

    A class names a text by its key, which may be null or stand on several rows, and its hash;
    rows that share both are read as one.
    """
    named = settle(classes.join(wanted, "cls").select("cls", F.col("id").alias("c_id"), F.col("th").alias("c_th")))
    met = join_by_size(texts, named, texts["id"].eqNullSafe(named["c_id"]) & (texts["th"] == named["c_th"]))
    return with_sets(met.select("cls", "text")).dropDuplicates(["cls"])


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of the written table ``pairs`` (a, b) of classes, one for each a, whose full sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    sets = settle(sets_of(classes, settle(ends.distinct()), texts))
    asked = pairs.groupBy("b").agg(F.count("*").alias("n"))
    other = settle(asked.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b"))
    met = join_by_key(pairs.join(sets.withColumnRenamed("cls", "a"), "a"), other, ["b"], "n")
    both = F.size(F.array_intersect("set", "sb"))
    union = F.size("set") + F.size("sb") - both
    return met.where(F.lit(DENOMINATOR) * both >= F.lit(NUMERATOR) * union).select("a", "b")


def cross_links(rows: DataFrame) -> DataFrame:
    """(a, b): confirmed links between different components of a bucket.

    ``rows``: (band, rep, c, m, sig, bands, set). A bucket of much is cut into ``m``
    parts, and every two parts meet in a group of their own. Two texts are compared in the
    least band that they share; of two components of a group one link is enough.
    """
    part = F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")
    dealt = rows.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.withColumn("g", F.least("p", "q") * F.col("m") + F.greatest("p", "q")).drop("m", "q")
    most, chance = (1 - ESTIMATE) * (1 - 1 / (1 << BITS)) * MINIMA, MINIMA // 64

    def run(group: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        ids, comp, part_of = (group.column(k).to_numpy() for k in ("rep", "c", "p"))
        if len(np.unique(comp)) > 1:
            band = group.column("band")[0].as_py()
            whole = group.combine_chunks()
            sig, keys = (np.array(whole.column(k).chunk(0).flatten()).reshape(len(ids), -1) if whole.column(k).num_chunks else None for k in ("sig", "bands"))
            sig, keys = sig.view(U64), np.sort(keys, 1)  # unsigned: numpy counts the bits of magnitudes
            sets = [np.array(x.values) for x in whole.column("set").chunk(0)]
            size = np.array([len(x) for x in sets])
            split = len(np.unique(part_of)) > 1
            comp = comp.copy()
            for i in np.argsort(ids):
                planes = (sig ^ sig[i]).reshape(len(ids), BITS, chance)
                differ = np.bitwise_count(np.bitwise_or.reduce(planes, 1)).sum(1)
                fit = (comp != comp[i]) & (ids > ids[i]) & (differ <= most)
                fit &= (DENOMINATOR * size >= NUMERATOR * size[i]) & (DENOMINATOR * size[i] >= NUMERATOR * size)
                if split:
                    fit &= part_of != part_of[i]
                at = np.flatnonzero(fit)
                for j in at[np.argsort(differ[at], kind="stable")]:
                    if comp[j] == comp[i] or np.intersect1d(keys[i], keys[j], assume_unique=False)[0] != band:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if DENOMINATOR * both >= NUMERATOR * (size[i] + size[j] - both):
                        out.append((int(ids[i]), int(ids[j])))
                        comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("band", "g").applyInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Null and empty texts have an empty set and link with nothing; equal sets are one class. Rows
    with equal keys are documents of their own, each in its own component. Rows without a key
    link as all others; component_id is the smallest key reachable, null if no row there has
    one; kept is whether key and component_id are the same, both null too. An empty table gives
    no rows; other columns are left out, whatever their names.
    """
    texts = texts_of(docs, key, text)
    sketches = settle(sketch(docs, key, text))
    # classes have ids of their own; the smallest key comes first, null last
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "sig", "bands"))
    grouped = sketches.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(head.alias("r"), F.count("*").alias("n"))
    classes = settle(grouped.select(F.monotonically_increasing_id().alias("cls"), "f1", "f2", "n_shingles", "n", "r.id", "r.th", "r.sig", "r.bands"))
    members = classes.select(F.col("cls").alias("rep"), "sig", "bands", "n_shingles")
    banded = members.select("rep", "n_shingles", F.explode("bands").alias("band"))
    ends = settle(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("n > 1"))
    placed = settle(join_by_key(banded, ends, ["band"], "n"))
    stars = placed.select("rep", F.explode(F.array("lo", "hi")).alias("other")).where("rep <> other")
    stars = settle(stars.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct())
    sigs = members.select("rep", "sig")
    near = stars.join(sigs.withColumnsRenamed({"rep": "a", "sig": "xa"}), "a")
    asked = settle(stars.groupBy("b").agg(F.count("*").alias("n")).join(sigs.withColumnsRenamed({"rep": "b", "sig": "xb"}), "b"))
    near = join_by_key(near, asked, ["b"], "n").withColumn("e", estimate(F.col("xa"), F.col("xb"))).where(F.col("e") >= ESTIMATE)
    near = near.groupBy("a").agg(F.max_by("b", F.struct("e", -F.col("b"))).alias("b"))
    links = settle(confirmed(settle(near), classes, texts))
    found = settle(components(links))

    # members by band and component; sets and signatures follow for those left over
    named = placed.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", "n_shingles", F.coalesce("component", "rep").alias("c"))
    named = settle(named)
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    spans = settle(named.groupBy("band").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), parts.alias("m")).where("lo <> hi").drop("lo", "hi"))
    rest = settle(join_by_key(named, spans, ["band"], "n").select("band", "rep", "c", "m"))
    if not rest.isEmpty():
        reps = settle(rest.select(F.col("rep").alias("cls")).distinct())
        about = members.drop("n_shingles").join(sets_of(classes, reps, texts).withColumnRenamed("cls", "rep"), "rep")
        found = settle(components(links.unionByName(settle(cross_links(rest.join(about, "rep"))))))

    of = classes.join(found.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "f1", "f2", "n_shingles", "n", "id", F.coalesce("component", "cls").alias("component"))
    of = settle(of)
    tops = of.groupBy("component").agg(F.min("id").alias("top"), F.count("*").alias("members"))
    known = settle(join_by_key(of, settle(tops), ["component"], "members").select("f1", "f2", "n_shingles", "n", "top"))
    full = sketches.where("n_shingles > 0").select("id", "n_shingles", "f1", "f2")
    linked = join_by_key(full, known, ["f1", "f2", "n_shingles"], "n").select("id", "n_shingles", F.col("top").alias("component_id"))
    alone = sketches.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
