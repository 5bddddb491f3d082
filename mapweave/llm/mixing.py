"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words. A source's target is met by whole copies of
all its documents and, for the rest of the budget, by a number of documents of each length:
the same share of every length, then long ones, then a bounded knapsack over the last words of
the budget, a wider stretch of them as long as it leaves a gap. Which documents of a length are
taken follows a seeded hash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gapless_rank, row_salt, settle, table

#: Weights of the sources in code-point order, repeating, and the mix's size against all words.
WEIGHTS, TOTAL_SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2.0
#: The last words of a budget that the knapsack fills at first, by how much more it takes while a gap is left, and
#: where it stops to do so: budgets up to that are fitted exactly, beyond it a gap is shorter than any document left.
FIRST_WORDS, WIDER, MOST_WORDS = 4096, 8, 1 << 24
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_TIMES) -> dict[str | None, float]:
    """``source_targets`` of a few sources in hand."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, got = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        total = sum(weight[s] for s in names if s in open_)
        given = {s: left * weight[s] / total for s in names if s in open_}
        full = {s for s in open_ if given[s] > most * sizes[s]}
        if not full:
            got |= given
            break
        for s in names:
            if s in full:
                got[s] = most * sizes[s]
                left -= got[s]
        open_ -= full
    return got


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_TIMES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: words by weight, at most ``most`` times its size, the excess shared anew.

    Sources may be very many: they are numbered by a range sort, and each round of sharing is
    an aggregate. Only two numbers a round reach the driver.
    """
    at = settle(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition of the sort
    starts = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    placed = at.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("__at", F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    weighed = settle(placed.select("source", "source_size", weight.alias("__weight")))
    limit = most * F.col("source_size")
    words = weighed.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    full, filled = F.lit(False), -1
    while True:
        sums = weighed.agg(F.sum(F.when(~full, F.col("__weight"))).alias("w"), F.sum(F.when(full, F.col("source_size"))).alias("f"), F.count_if(full).alias("n")).first()
        if sums["n"] == filled or not sums["w"]:
            break
        # words for each unit of weight of the sources that are not full
        filled, level = sums["n"], (share * words - most * (sums["f"] or 0)) / sums["w"]
        full = full | (F.lit(level) * F.col("__weight") > limit)
    given = F.when(full, limit).otherwise(F.lit(level) * F.col("__weight")) if filled >= 0 else limit
    return weighed.select("source", "source_size", given.cast("double").alias("target"))


def knapsack(budget: int, have: list[tuple[int, int]]) -> dict[int, int]:
    """How many of each length to take so that the sum comes as near to ``budget`` from below as can be.

    Reachable sums are the bits of an integer; each length enters in power-of-two lots. The
    way back is found stretch by stretch, so that few of these integers are held at a time.
    """
    lots = []
    for length, count in sorted(have):
        left, lot = min(count, budget // length) if length > 0 else 0, 1
        while left:
            lot = min(lot, left)
            lots.append((length, lot))
            left -= lot
            lot *= 2
    mask, reach, stretch = (1 << (budget + 1)) - 1, 1, max(1, math.isqrt(len(lots)))
    kept, used = [], 0
    for i, (length, lot) in enumerate(lots):
        if reach >> budget & 1:
            break
        if i % stretch == 0:
            kept.append((i, reach))
        reach |= reach << (length * lot) & mask
        used = i + 1
    at, took = reach.bit_length() - 1, {}
    for first, reach in reversed(kept):
        part, befores = lots[first : min(first + stretch, used)], []
        for length, lot in part:
            befores.append(reach)
            reach |= reach << (length * lot) & mask
        for (length, lot), before in zip(reversed(part), reversed(befores)):
            if not before >> at & 1:
                at -= length * lot
                took[length] = took.get(length, 0) + lot
    return took


def fit(lengths: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """(copies of every document, documents of each length besides) for a source's target, never beyond it."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if total <= 0 or target <= 0:
        return 0, [0] * len(lengths)
    copies = int(target // total)
    budget = int(math.floor(target - copies * total))
    longest_first = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])
    best, gap, words = [0] * len(lengths), budget, FIRST_WORDS
    while gap and budget:
        some = max(budget - words, 0)
        extra = [c * some // total if n else 0 for n, c in zip(lengths, counts)]
        left = budget - sum(n * e for n, e in zip(lengths, extra))
        for i in longest_first:
            if left > words:
                more = min(counts[i] - extra[i], (left - words) // lengths[i])
                extra[i] += more
                left -= more * lengths[i]
        took = knapsack(left, [(n, c - e) for n, c, e in zip(lengths, counts, extra) if n and c > e])
        left -= sum(n * k for n, k in took.items())
        if left < gap:
            best, gap = [e + took.get(n, 0) for n, e in zip(lengths, extra)], left
        if words >= min(budget, MOST_WORDS):
            break
        words *= WIDER
    return copies, best


def mix(docs: DataFrame, key: str, source: str, size: str, seed: int = SEED, weights=WEIGHTS, share: float = TOTAL_SHARE, chosen_by: str | None = None) -> DataFrame:
    """``key``, ``source`` and ``size`` of each row with source_size, target, copies, taken.

    ``copies``: how often the mix holds the document (at most twice by default). Null sources
    are a source, the last one; null sizes are 0; empty documents are never needed and get 0
    copies beyond those of all; null and repeated keys stand for rows of their own, equal rows
    are taken in any order; an empty table gives no rows; other columns are left out, whatever
    their names. ``chosen_by``: column whose hash makes the choice, the key where it is null or
    not given. A source's histogram (a row for each length) goes to one task.
    """
    rows = settle(docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{chosen_by or key}`").cast("string"), F.col(f"`{key}`").cast("string")).alias("by"), F.col(f"`{source}`").alias("source"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0).cast("long")).alias("size")))
    hist = settle(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    aimed = hist.join(goal.withColumnRenamed("source", "goal"), F.col("source").eqNullSafe(F.col("goal"))).drop("goal")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        pdf["all"], pdf["extra"] = fit(pdf["size"].tolist(), pdf["n"].tolist(), float(pdf["target"].iloc[0]))
        return pdf[["source", "size", "source_size", "target", "all", "extra"]]

    plans = settle(aimed.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, all int, extra long"))
    seeded = F.xxhash64(F.lit(seed), F.col("by"))
    dealt = F.xxhash64(F.lit(seed), row_salt(rows))
    ranked = gapless_rank(rows, ["source", "size"], [seeded, F.col("key")], dealt, "rank", about=plans)
    copies = F.col("all") + (F.col("rank") < F.col("extra")).cast("int")
    return ranked.select(F.col("key").alias(key), F.col("source").alias(source), F.col("size").alias(size), "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs, "doc_id", "source", "size")
