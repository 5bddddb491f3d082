"""Quality by weak labels.

Overlapping heuristics vote good, bad or nothing on each text. Expectation-maximisation over
the counts of vote patterns estimates each heuristic's accuracy on good and on bad texts, and
from them each pattern's posterior. A hashed linear scorer is then trained on a bounded sample
with those posteriors and scores every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: Rows that the scorer is trained on, at most, by a hash of the key.
SAMPLE = 4000
BUCKETS, ROUNDS, EPOCHS, RIDGE = 1 << 12, 60, 150, 1e-3
PRIOR = 0.8
GOOD, BAD, NONE = 1, 0, -1
WS = r"[\x20\x09-\x0D]+"


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE).cast("byte")


def votes(text: Column) -> dict[str, Column]:
    """The heuristics, as columns over a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.split(F.trim(F.regexp_replace(t, WS, " ")), " ")
    n = F.size(words)
    share = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / chars
    symbols, capitals, ends = share(r"[#$%&*|<>{}\\^~=@_+/]+"), share(r"[A-Z]+"), F.length(t) - F.length(F.regexp_replace(t, r"[.?]", ""))
    distinct = F.size(F.array_distinct(words)) / n
    # characters of words that say the one before them again
    again = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.when(a == b, F.length(b) + 1).otherwise(0))
    repeats = F.aggregate(again, F.lit(0), lambda acc, x: acc + x) / chars
    mean = chars / n
    shouts = (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) / n
    return {
        "symbols": _vote(symbols > 0.02, symbols < 0.005),
        "capitals": _vote(capitals > 0.3, (capitals < 0.1) & (n >= 5)),
        "sentences": _vote((n >= 20) & (ends / n < 0.015), (ends / n >= 0.03) & (ends / n <= 0.5)),
        "repeats": _vote(repeats > 0.2, (repeats < 0.03) & (n >= 20)),
        "distinct": _vote((n >= 30) & (distinct < 0.2), (n >= 30) & (distinct > 0.35)),
        "word_length": _vote((mean > 14) | (mean < 2.5), (mean >= 4) & (mean <= 9)),
        "shouts": _vote(shouts > 0.2, (shouts < 0.02) & (n >= 20)),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, accuracies as (class, heuristic, vote), share of good).

    ``patterns``: (n, heuristics) votes. Starts from heuristics that are right 3 times of 4.
    """
    n, m = patterns.shape
    seen = np.stack([patterns == v for v in (BAD, GOOD, NONE)], 2).astype(float)
    rate = np.empty((2, m, 3))
    rate[0], rate[1] = (0.6, 0.2, 0.2), (0.2, 0.6, 0.2)
    post = np.full(n, prior)
    for _ in range(ROUNDS):
        like = np.einsum("nmv,cmv->cn", seen, np.log(rate))
        lean = np.clip(like[0] - like[1] + math.log((1 - prior) / prior), -50, 50)
        post = 1 / (1 + np.exp(lean))
        for c, w in ((0, (1 - post) * counts), (1, post * counts)):
            rate[c] = (np.einsum("n,nmv->mv", w, seen) + 1.0) / (w.sum() + 3.0)
        prior = min(max((post * counts).sum() / max(counts.sum(), 1), 0.01), 0.99)
    return post, rate, prior


class Buckets(dict):
    """Feature buckets of words: the word's shape and its ending, hashed."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 100_000:
            self.clear()
        shape = "".join(dict.fromkeys("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
        got = self[word] = tuple(xxhash.xxh32_intdigest(x) % (BUCKETS - 4) for x in ("s" + shape[:8], "e" + word[-3:]))
        return got


def hashed(text: str, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a whole text: frequencies of shapes and endings, and how words repeat."""
    words = text.split()
    if not words:
        return np.array([BUCKETS - 1]), np.array([1.0])
    ids = np.fromiter((b for w in words for b in buckets[w]), np.int64, 2 * len(words))
    at, n = np.unique(ids, return_counts=True)
    same = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    distinct = len(set(words)) / len(words)
    return np.append(at, [BUCKETS - 4, BUCKETS - 3, BUCKETS - 2]), np.append(np.sqrt(n / len(words)), [3 * same, distinct, math.log1p(len(words)) / 10])


def train(rows: list[tuple[str, float]]) -> np.ndarray:
    """Weights of a logistic scorer, the constant last, by gradient descent with momentum on soft labels."""
    weights, speed = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    buckets = Buckets()
    got = [hashed(t, buckets) for t, _ in rows]
    row = np.repeat(np.arange(len(got)), [len(a) for a, _ in got])
    at, value = np.concatenate([a for a, _ in got]), np.concatenate([v for _, v in got])
    y = np.array([p for _, p in rows])
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at] * value, len(got)) + weights[-1], -30, 30)))
        slope = np.append(np.bincount(at, (p - y)[row] * value, BUCKETS), (p - y).sum()) / len(got) + RIDGE * weights
        speed = 0.9 * speed - 0.5 * slope
        weights = weights + speed
    return weights


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, votes..., posterior, score, kept) of every row; kept: score of 0.5 or more.

    Null texts count as empty; rows with equal or null keys are texts of their own, equal rows
    give equal results; an empty table gives no rows; other columns are left out, whatever
    their names. The counts of vote patterns (at most 3 ** 7) and the training sample, a number
    of whole texts, reach the driver.
    """
    body = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    names = list(votes(F.col("text")))
    voted = settle(body.select("key", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), *[v.alias(k) for k, v in votes(F.col("text")).items()]))
    seen = voted.groupBy(*names).count().orderBy(*names).collect()
    patterns = np.array([[r[k] for k in names] for r in seen], int).reshape(-1, len(names))
    post, _, _ = estimate(patterns, np.array([r["count"] for r in seen], float))
    code = reduce(lambda a, b: a * 3 + b, [F.col(k) + 1 for k in names])
    codes = [int(reduce(lambda a, b: a * 3 + b, [int(v) + 1 for v in p])) for p in patterns]
    known = docs.sparkSession.createDataFrame(list(zip(codes, map(float, post))), "code int, posterior double")
    labelled = voted.withColumn("code", code.cast("int")).join(F.broadcast(known), "code").drop("code")

    picked = labelled.orderBy(F.xxhash64("key", "h"), "key").limit(SAMPLE).select("key", "h", "posterior")
    sample = body.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).join(F.broadcast(picked.withColumnsRenamed({"key": "p_key", "h": "p_h"})), F.col("key").eqNullSafe(F.col("p_key")) & (F.col("h") == F.col("p_h"))).dropDuplicates(["key", "h"]).select("key", F.coalesce("text", F.lit("")).alias("text"), "posterior").collect()
    weights = train([(r["text"], r["posterior"]) for r in sorted(sample, key=lambda r: (str(r["key"]), r["text"]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            got = [hashed(t.as_py() or "", buckets) for t in batch.column(1)]
            linear = np.array([weights[a] @ v for a, v in got]) + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(linear, -30, 30))), pa.float64()), batch.column(2)], names=["key", "score", "h"])

    kind = dict(body.dtypes)["key"]
    scored = body.select("key", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).mapInArrow(run, f"key {kind}, score double, h long")
    votes_of = labelled.dropDuplicates(["key", "h"])
    return scored.join(votes_of, scored["key"].eqNullSafe(votes_of["key"]) & (scored["h"] == votes_of["h"])).select(scored["key"].alias(key), *names, "posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
