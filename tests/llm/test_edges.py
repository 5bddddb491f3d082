"""One table of awkward rows through every operator: null, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mapweave.llm import embeddings, licenses, lines, media, mixing, near_dups, packing, quality, sharding, toxicity

LONG = " ".join(f"w{i % 5000}x{i % 7}" for i in range(150_000))
ROWS = [(None, None), (None, ""), (None, "no key, one text"), (None, "no key, one text"), (1, None), (2, ""), (3, " \n\t\n"), (4, "same words here\nsame words here"), (5, "same words here\nsame words here"), (5, "same words here\nsame words here"), (5, "other text of key five"), (7, LONG), (8, LONG + " more"), (9, "\n".join(["x"] * 300)), (10, "Released under the MIT License")]
CLASHES = ["__row", "__doc", "__lines", "rep", "band", "cls", "component", "id", "th", "size", "key", "rank", "score", "a.b", "source"]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string")
    return made.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def keys(rows):
    return Counter(r["doc_id"] for r in rows)


WANT = Counter(k for k, _ in ROWS)


def kept_columns(df, *replaced):
    return all(c in df.columns for c in CLASHES) and df.select(*[f"`{c}`" for c in CLASHES if c not in replaced]).distinct().count() == 1


def test_sharding(docs):
    done = sharding.assign(docs, "doc_id", sharding.topology())
    first, again = (sorted(((r["doc_id"] is None, r["doc_id"], str(r["text"]), r["shard"], r["slot"]) for r in done.collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(ROWS) and len({x[3:] for x in first}) == len(ROWS) and kept_columns(done)
    assert all(len({x[3] for x in first if x[1] == k}) == 1 for k in WANT)


def test_licenses(docs):
    done = licenses.scan(docs)
    rows = done.collect()
    assert keys(rows) == WANT and kept_columns(done, "score")
    assert {r["labels"] for r in rows if r["doc_id"] != 10} == {""} and next(r for r in rows if r["doc_id"] == 10)["base_labels"] == "mit"
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0} and next(r for r in rows if r["doc_id"] == 7)["n_words"] == 150_000


def test_lines(docs):
    done = lines.dedup(docs)
    rows = done.collect()
    assert keys(rows) == WANT and kept_columns(done)
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    # the first by key stays; rows without a key are the last
    assert got[4, "same words here"] == 1 and got[5, ""] == 2 and got[5, "other text of key five"] == 1
    assert got[None, "no key, one text"] == 1 and got[None, ""] == 2 and got[None, None] == 1 and got[1, None] == 1
    assert got[9, "x"] == 1 and got[7, LONG] == 1 and got[8, ""] == 1 and got[3, " \n\t\n"] == 1


def test_mixing(docs):
    sized = docs.withColumn("size", mixing.n_words(F.col("text"))).withColumn("source", F.when(F.col("doc_id") > 5, "s"))
    rows = mixing.mix(sized, "doc_id", "source", "size").collect()
    assert keys(rows) == WANT and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 150_001 for r in rows)


def test_media(docs):
    stored = media.store(docs)
    more = stored.withColumn("a.b", F.lit(1)).withColumn("pcm", F.lit("old"))
    rows = media.decode(more).collect()
    assert keys(rows) == WANT and all(r["a.b"] == 1 for r in rows)
    for r in rows:
        codec, rate, payload = media.parse_wave(r["media"])
        kind, out_rate, pcm = media.parse_wave(r["pcm"])
        assert payload == r["payload"] and (kind, rate, out_rate) == ("pcm", media.RATE, media.OUT_RATE)
        assert pcm == media.resample(media.samples_of(codec, payload)).tobytes() and r["feature"] == plain_feature(codec, pcm)
    assert Counter(r["payload"].rstrip(b"\0") for r in rows) == Counter((t or "").encode() for _, t in ROWS)


def plain_feature(codec, pcm):
    import numpy as np

    x = np.frombuffer(pcm, "<i2").astype(np.int64)
    turns = sum((x[1:] >= 0) != (x[:-1] >= 0))
    return f"{codec};n={len(x)};rms={int((x * x).sum() // max(1, len(x))) ** 0.5:.2f};peak={abs(x).max()};turns={turns};crc={zlib.crc32(pcm)}"


def test_media_query_columns(spark, tmp_path):
    texts = spark.createDataFrame([(1, None), (2, "é" * 100), (3, LONG)], "doc_id long, text string")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    for r in media.op5(spark, str(tmp_path)).collect():
        raw = {1: b"", 2: ("é" * 100).encode(), 3: LONG.encode()}[r["doc_id"]]
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        codec = media.CODECS[zlib.crc32(payload) % 3]
        file = media.wave(codec, payload)
        pcm = media.resample(media.samples_of(codec, payload)).tobytes()
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(file), hashlib.sha256(file).hexdigest(), plain_feature(codec, pcm))
        assert r["pcm_sha256"] == hashlib.sha256(media.wave("pcm", pcm, media.OUT_RATE)).hexdigest()


def test_near_dups(docs):
    rows = near_dups.link(docs).collect()
    assert keys(rows) == WANT
    by = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows)
    assert by[5, 4, False] == 2 and by[5, 5, True] == 1 and by[8, 7, False] == 1 and by[None, None, True] == 4
    assert by[1, 1, True] == by[2, 2, True] == by[3, 3, True] == 1


def test_embeddings(spark):
    vectors = [None, [], [0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [float("nan"), 1.0]]
    df = spark.createDataFrame([(None if i % 2 else 3, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    assert sorted((r["n_links"], str(r["vec_id"])) for r in embeddings.link(df).collect()) == [(0, "3"), (0, "3"), (0, "None"), (0, "None"), (1, "3"), (1, "None")]
    assert embeddings.link(df.limit(0)).count() == 0


def test_toxicity(docs):
    model = toxicity.train([("you idiot " + "word " * i, 1) for i in range(20)] + [("calm words " * (i + 1), 0) for i in range(20)], 0.5)
    done = toxicity.score(docs.where("doc_id is null or doc_id <> 8"), model)
    rows = done.collect()
    assert len(rows) == len(ROWS) - 1 and kept_columns(done, "score") and all(0 <= r["score"] <= 1 for r in rows)
    assert all(len({r["score"] for r in rows if (r["text"] or "") == t}) == 1 for t in {(r["text"] or "") for r in rows})


def test_quality(docs):
    rows = quality.classify(docs).collect()
    assert keys(rows) == WANT and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in rows)


def test_packing(docs):
    cut = packing.pieces(docs)
    rows = packing.pack(cut).collect()
    assert len(rows) == cut.count() and set(keys(rows)) == set(WANT)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == WANT


def test_votes_see_long_repeated_words(spark):
    word = "abc" * 40
    texts = [f"{word} \t {word}\n{word}", "calm words of many kinds that stand here only once in this long enough line of text for votes and no more", word]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    votes = {r["doc_id"]: r["v"] for r in df.select("doc_id", quality.votes(F.col("text"))["repeats"].alias("v")).collect()}
    assert votes == {0: quality.BAD, 1: quality.GOOD, 2: quality.NONE}
