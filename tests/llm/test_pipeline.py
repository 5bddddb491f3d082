"""The stages of the corpus pipeline, each against its predecessor's rows."""

import os
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from mapweave.llm import packing
from mapweave.llm.common import settle
from mapweave.session import settle_last, shared_dir

from .test_corpus_ops import check_packing
from .test_similarity import brute_lines, brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in P.STAGES[:-1]:
        docs = settle(stage(spark, docs, SF))
        assert docs.columns == columns
        kept.append(docs)
    rows = [sorted(d.collect()) for d in kept]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in rows[0]} - {r["doc_id"] for r in rows[1]}
    assert len(gone - toxic) < 0.1 * len(rows[0])

    lines = brute_lines([r["text"] for r in rows[1]])
    texts = {r["doc_id"]: "\n".join(x for j, x in enumerate(r["text"].split("\n")) if (i, j) not in lines) for i, r in enumerate(rows[1])}
    assert {r["doc_id"]: r["text"] for r in rows[2]} == {k: t for k, t in texts.items() if t.split()}

    _, want = brute_near([r["text"] for r in rows[2]])
    assert [r["doc_id"] for r in rows[3]] == [r["doc_id"] for i, r in enumerate(rows[2]) if want[i] == i]

    copies = Counter(r["doc_id"] for r in rows[4])
    assert set(copies) <= {r["doc_id"] for r in rows[3]} and set(copies.values()) <= {1, 2} and 2 in copies.values()

    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert len(packed) == packing.pieces(docs).count() and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    once = [r for r in packing.pack(packing.pieces(docs.dropDuplicates(["doc_id"]))).collect()]
    check_packing(once, {r["doc_id"]: r["text"] for r in rows[4]})


def test_run(spark):
    assert P.run(spark, SF).count() > 0 and [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "minhash_near_dups", "source_mix", "packing"]


def test_null_and_repeated_keys(spark):
    """Each stage takes rows as documents of their own, whatever their doc_id."""
    body = lambda i, n=40: " ".join(f"w{i}x{j}" for j in range(n))
    some = [(None, body(1)), (None, body(2)), (None, body(1)), (5, body(3)), (5, body(3)), (5, body(4)), (7, body(5) + "\n" + body(4)), (8, body(6)), (9, body(6) + " more"), (None, body(6))]
    docs = settle(spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in some], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert rows(P.drop_toxic(spark, docs, SF)) == Counter(some)
    alone = [(None, body(1)), (None, body(2)), (5, body(3)), (5, body(4)), (7, body(5)), (8, body(6))]
    assert rows(P.dedup_lines(spark, docs, SF)) == Counter(alone)
    apart = [(None, body(1)), (None, body(2)), (5, body(3)), (5, body(4)), (7, body(5) + "\n" + body(4)), (8, body(6))]
    assert rows(P.drop_near_dups(spark, docs, SF)) == Counter(apart)

    mixed = rows(P.mix_sources(spark, docs, SF))
    have, size = Counter(some), sum(len(t.split()) for _, t in some)
    assert all(have[k] <= n <= 2 * have[k] for k, n in mixed.items()) and set(mixed) == set(have)
    assert abs(sum(len(t.split()) * n for (_, t), n in mixed.items()) - 1.5 * size) <= 60

    packed = P.pack_tokens(spark, docs, SF).collect()
    assert len(packed) == len(some) and Counter(r["doc_id"] for r in packed) == Counter(k for k, _ in some)


def test_awkward_rows(spark):
    """Null, empty and repeated rows, a long text and clashing names through every stage."""
    long = " ".join(f"w{i % 4000}x{i % 11}" for i in range(60_000))
    some = [(None, None, None), (1, None, "a"), (2, "", None), (3, " \n", "a"), (4, "a line of text\na line of text", "b"), (4, "a line of text\na line of text", "b"), (5, long, "b"), (6, long + " end", None), (None, "alone without a key", "a")]
    clash = ["__row", "copy", "copies", "score", "n_lines_gone_", "__lines", "size", "row", "a.b"]
    docs = settle(spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in some], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)]))
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    have = Counter((k, t) for k, t, _ in some)
    for f in (P.drop_toxic, P.dedup_lines, P.drop_near_dups, P.mix_sources):
        done = f(spark, docs, SF)
        assert done.columns == docs.columns and f(spark, docs.limit(0), SF).count() == 0
        assert done.select(*[f"`{c}`" for c in clash if c != "a.b"]).distinct().collect() == [tuple(i for i, c in enumerate(clash) if c != "a.b")]
    assert rows(P.drop_toxic(spark, docs, SF)) == have
    lines_left = have - Counter({(4, "a line of text\na line of text"): 2, (6, long + " end"): 1}) + Counter({(4, "a line of text"): 1})
    assert rows(P.dedup_lines(spark, docs, SF)) == lines_left
    assert rows(P.drop_near_dups(spark, docs, SF)) == have - Counter({(4, "a line of text\na line of text"): 1, (6, long + " end"): 1})
    mixed = rows(P.mix_sources(spark, docs, SF))
    assert all(n <= 2 * have[k] for k, n in mixed.items())
    assert P.pack_tokens(spark, docs, SF).where("start = 0").count() == len(some) and P.pack_tokens(spark, docs.limit(0), SF).count() == 0


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_tables_left(spark):
    """A stage leaves two tables at most, the rows and what happens to them, a run those that its result reads."""
    docs = settle(spark.read.parquet(f"{SF}/documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        before = tables(spark)
        done = stage(spark, docs, SF)
        assert len(tables(spark) - before) <= 2, name
        docs = settle(done)
    before = tables(spark)
    packed = P.run(spark, SF)
    assert len(tables(spark) - before) <= 2 and packed.count() == P.STAGES[-1][1](spark, docs, SF).count()


def test_settle_last(spark):
    """Tables on the way go, those of inner calls with them; others stay."""
    mine, before = settle(spark.range(3)), tables(spark)

    def made():
        inner = settle_last(lambda: settle(mine).where("id > 0"))
        assert len(tables(spark) - before) == 1
        return settle(inner.unionByName(mine))

    last = settle_last(made)
    assert len(tables(spark) - before) == 1 and tables(spark) >= before
    assert sorted(r["id"] for r in last.collect()) == [0, 1, 1, 2, 2]
    try:
        settle_last(lambda: settle(spark.range(1)).select("none"))
    except Exception:
        pass
    kept = settle(spark.range(5))
    assert kept.count() == 5 and mine.count() == 3 and last.count() == 5
