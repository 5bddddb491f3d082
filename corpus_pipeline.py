"""A training corpus from ``documents``: clean, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``,
others beside them too, whatever their names. In every stage rows are documents of their own,
also if their doc_id is null or stands on several rows; "earlier" is by doc_id, nulls last, and
then in the order of reading; null texts count as empty; long texts are read whole; an empty
table gives no rows. What a stage returns reads at most two tables that it has written, the rows
under numbers of their own and what happens to these numbers; all others are gone by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import lines, mixing, near_dups, packing, toxicity
from mapweave.llm.common import numbered, settle, settle_last, table, unused
from mapweave.session import discard, ship


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Equal texts go or stay together; null and empty texts have the score of a text without
    words. Without labels of both classes every document has the share of label 1 as its score.
    """
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = docs.withColumnRenamed("score", unused(docs, "__score")) if "score" in docs.columns else docs
    scored = toxicity.score(held, model).where("score < 0.5").drop("score")
    return scored.toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which nothing is left. Others keep their text as it is.

    Null and empty texts lose nothing and stay.
    """
    ship(spark)
    done = lines.dedup(docs)
    left = (F.col("n_lines_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("n_lines_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.where(left).withColumn("n_chars", n_chars).select(*_all(docs))


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the earliest; so do all without words."""
    ship(spark)
    row = unused(docs, "__row")
    rows = numbered(docs, "doc_id", row)
    gone = settle_last(lambda: near_dups.link(rows, row).where("not kept").select(row))
    return rows.join(gone.hint("merge"), row, "left_anti").select(*_all(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none more than twice; null is a source of its own, the last.

    Documents without words stay as often as all of their source do.
    """
    ship(spark)
    row, n = unused(docs, "__row"), unused(docs, "__copies")
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    sized = rows.select(row, "doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    copies = settle_last(lambda: mixing.mix(sized, row, "source", "size", chosen_by="doc_id").where("copies > 0").select(row, F.col("copies").alias(n)))
    met = rows.join(copies.hint("merge"), row).withColumn(row, F.explode(F.sequence(F.lit(1), F.col(n))))
    return met.select(*_all(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a document without words is one piece, its final id."""
    ship(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dups", drop_near_dups),
    ("source_mix", mix_sources),
    ("packing", pack_tokens),
]

#: Trained scores, hashes and seeded choices can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle_last(lambda: stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
