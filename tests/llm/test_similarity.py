"""Near-duplicate operators against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from mapweave.llm import embeddings, lines, near_dups
from mapweave.llm.common import components


def union(n, edges):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    for n, m in ((40, 30), (200, 160), (50, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(n // 2)] if m else [])
        want = union(n, edges)
        got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert {i: got.get(i, i) for i in range(n)} == dict(enumerate(want))


def near_texts(rng, n):
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randrange(12, 90))] for _ in range(n // 8)]
    texts = [None, "", " \n\t", "One", "one", "two words", "Two  Words", "a b c d e", "a b c d e f"]
    while len(texts) < n:
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(rng.choice([" ", "\n"]).join(w))
    return texts


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(texts):
    sets = [shingle_set(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return sets, union(len(sets), edges)


@pytest.mark.parametrize("block", [2000, 7])
def test_minhash_links(spark, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    texts = near_texts(random.Random(block), 300)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, component string, n_shingles int")
    got = {r["doc_id"]: r for r in near_dups.link(docs).collect()}
    sets, want = brute_near(texts)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i), texts[i]


def test_minhash_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r["component_id"] for r in near_dups.link(docs).collect()}
    _, want = brute_near([r["text"] for r in rows])
    assert got == {rows[i]["doc_id"]: rows[c]["doc_id"] for i, c in enumerate(want)}


def test_minhash_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_dups.link(spark.createDataFrame([], schema)).count() == 0
    got = near_dups.link(spark.createDataFrame([(4, "a b"), (4, "a b"), (2, "A  b")], schema)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (4, 2), (4, 2)]


def test_estimate_is_unbiased(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows = []
    for common in (100, 300, 450):
        for _ in range(20):
            base = rng.integers(0, 2**63, 900, dtype=np.uint64)
            a, b = base[:500], np.concatenate([base[:common], base[500 : 1000 - common]])
            rows.append((common / (1000 - common), *[near_dups.packed(near_dups.minima(x)).tolist() for x in (a, b)]))
    got = spark.createDataFrame(rows, "j double, x array<long>, y array<long>").groupBy("j").agg(F.avg(near_dups.estimate(F.col("x"), F.col("y"))).alias("e")).collect()
    assert all(abs(r["e"] - r["j"]) < 0.04 for r in got)


def brute_lines(texts):
    """(doc, line) that go."""
    seen, gone = [], set()
    for d, t in enumerate(texts):
        for i, x in enumerate((t or "").encode().split(b"\n")):
            w = x.split()
            if not w:
                continue
            for v in seen:
                if v == w or lines.near_lines(v, w):
                    gone.add((d, i))
                    break
            seen.append(w)
    return gone


def test_one_edit():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(prev, i, x, b):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        return cur

    rng = random.Random(0)
    for _ in range(3000):
        a, b = ([rng.choice([b"x", b"y"]) for _ in range(rng.randrange(6))] for _ in range(2))
        assert lines.near(a, b) == (distance(a, b) <= 1)


def test_line_dedup(spark):
    rng = random.Random(7)
    base = [[f"v{rng.randrange(60)}" for _ in range(rng.randrange(3, 16))] for _ in range(25)]
    texts = [None, "", "\n\n", "x\nx\n\nx", " a  b \na b"]
    for _ in range(120):
        out = []
        for _ in range(rng.randrange(1, 5)):
            w = list(rng.choice(base))
            kind = rng.randrange(5)
            at = rng.randrange(len(w))
            if kind == 0:
                w[at] = "new"
            elif kind == 1:
                w.insert(at, rng.choice(w))
            elif kind == 2 and len(w) > 1:
                del w[at]
            out.append(" ".join(w))
        texts.append("\n".join(out))
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, lines array<int>")
    gone = brute_lines(texts)
    got = {r["doc"]: r["lines"] for r in lines.repeated(docs).collect()}
    assert {(d, i) for d, v in got.items() for i in v} == gone
    done = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    for d, t in enumerate(texts):
        want = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        assert done[d]["text"] == want and done[d]["lines"] == [1]
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_e8_points():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 2
    p = embeddings.e8_decode(y) / 2
    assert ((p % 1 == 0).all(1) | (p % 1 == 0.5).all(1)).all() and (p.sum(1) % 2 == 0).all()
    best = ((y - p) ** 2).sum(1)
    assert all((((y - (p + r)) ** 2).sum(1) >= best - 1e-9).all() for r in embeddings.ROOTS)
    assert len(embeddings.ROOTS) == 240 and np.allclose((embeddings.ROOTS**2).sum(1), 2)


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    vectors = [None, [0.0] * 16, [1.0, float("nan")] + [0.0] * 14, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    for _ in range(60):
        c = rng.normal(size=16)
        vectors += [list(map(float, np.float32(c + rng.normal(size=16) * s))) for s in (0, 0, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.link(df).collect()}
    valid = [v is not None and None not in v and all(map(np.isfinite, v)) and any(v) for v in vectors]
    want = []
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if valid[i] and valid[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    want.append((i, j))
    found = sum(r["n_links"] for r in got.values()) / 2
    assert len(got) == len(vectors) and 0.97 * len(want) <= found <= len(want)
    assert got[0]["n_links"] == got[1]["n_links"] == got[2]["n_links"] == 0 and got[5]["n_links"] == 1
    assert embeddings.link(df.limit(0)).count() == 0


def test_embedding_recall_at_threshold():
    """Pairs at a cosine of just 0.9 meet in a cell."""
    rng = np.random.default_rng(2)
    for rows in (1_000, 50_000, 1_000_000):
        a = rng.normal(size=(400, 64))
        a /= np.linalg.norm(a, axis=1)[:, None]
        o = rng.normal(size=a.shape)
        o -= (o * a).sum(1)[:, None] * a
        o /= np.linalg.norm(o, axis=1)[:, None]
        b = 0.901 * a + np.sqrt(1 - 0.901**2) * o
        n = embeddings.blocks_for(rows)
        (ka, sa), (kb, sb) = embeddings.cells(a, n), embeddings.cells(b, n)
        own = (ka[:, :, :1] == kb).any((1, 2)) | (kb[:, :, :1] == ka).any((1, 2))
        close = np.bitwise_count((sa ^ sb).view(np.uint64)).sum(1) <= embeddings.MOST_DIFFERENT
        assert (own & close).mean() >= 0.9, (rows, n, own.mean(), close.mean())


def test_components_of_too_few_rounds_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        components(chain, most_rounds=2)


def brute_vectors(vectors):
    """(links of each, component of each) of (key, vector) rows by double-precision cosines."""
    valid = [v is not None and len(v) > 0 and None not in v and all(map(np.isfinite, v)) and any(v) for _, v in vectors]
    edges = []
    for i, (_, a) in enumerate(vectors):
        for j in range(i):
            b = vectors[j][1]
            if valid[i] and valid[j] and len(a) == len(b):
                x, y = (np.array(v, float) / np.abs(v).max() for v in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    edges.append((i, j))
    links = [0] * len(vectors)
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    return links, union(len(vectors), edges)


@pytest.mark.parametrize("block, crowded", [(2000, 256), (7, 12)])
def test_embedding_components_end_to_end(spark, monkeypatch, block, crowded):
    """Groups around cosines of 0.9 to 0.95, and one large near-equal group, against brute force."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "CROWDED", crowded)
    rng = np.random.default_rng(block)
    rows = []
    for _ in range(40):
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        for cos in rng.uniform(0.93, 0.99, rng.integers(1, 6)):
            o = rng.normal(size=64)
            o -= (o @ c) * c
            rows.append(list(map(float, np.float32(cos * c + np.sqrt(1 - cos * cos) * o / np.linalg.norm(o)))))
    c = rng.normal(size=64)
    rows += [list(map(float, np.float32(c + 0.02 * rng.normal(size=64)))) for _ in range(90)]
    rows += [rows[0], rows[0], [1e300] * 64, [2e300] * 64, [1e-300] * 64, [], None, [0.0] * 64]
    rng.shuffle(rows)
    vectors = [(int(k), v) for k, v in zip(rng.permutation(len(rows)) * 3, rows)]
    vectors.sort(key=lambda r: r[0])
    df = spark.createDataFrame([(k, v, k, 0) for k, v in vectors], "vec_id long, embedding array<double>, id long, component int")
    got = {r["vec_id"]: r for r in embeddings.link(df).collect()}
    links, comp = brute_vectors(vectors)
    assert len(got) == len(vectors)
    same = sum(got[k]["component_id"] == vectors[comp[i]][0] for i, (k, _) in enumerate(vectors)) / len(vectors)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(links) and same >= 0.97, same
    for i, (k, _) in enumerate(vectors):
        r = got[k]
        assert r["n_links"] <= links[i] and r["kept"] == (r["component_id"] == k) and r["component_id"] <= k


def test_embedding_keys(spark):
    """Rows without a key, and rows that share one, are vectors of their own."""
    a, b, c = [1.0, 0.0], [0.0, 1.0], [-1.0, 0.5]
    df = spark.createDataFrame([(None, a), (None, a), (3, a), (3, b), (None, b), (None, c), (None, None), (8, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, embeddings.link(df).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (None, 2, 3, False), (3, 2, 3, True), (3, 1, 3, True), (None, 1, 3, False), (None, 0, None, True), (None, 0, None, True), (8, 0, 8, True)], key=str)


def line_rows(texts):
    """The rows of ``lines.line_keys`` over ``texts``, without Spark, and the CPU seconds they took."""

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    number = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([number, number, pa.array(texts, pa.string())], names=["o", "doc", "text"])
    began = time.process_time()
    made = list(lines.line_keys(Frame())(iter([batch])))
    return pa.Table.from_batches(made).to_pylist(), time.process_time() - began


def test_line_keys_odd_bytes():
    """Every line with words, whatever its bytes; equal ones, and only those, share a hash."""
    rng = random.Random(9)
    words = ["ab", "é𝄞", "\x00", "\x00\x00", "\x1c", "\x85x", "twelve-bytes", "twelve-bytez", "y" * 64, "z" * 65, "z" * 66, "u" * 300]
    texts = [None, "", "\n", " \t\n\v\f\r", "a", "\na\nb b\n\na", *("".join(rng.choice([*words, " ", "  ", "\n", "\t"]) for _ in range(rng.randrange(120))) for _ in range(400))]
    want, seen = [], set()
    for d, t in enumerate(texts):
        for i, x in enumerate((t or "").encode().split(b"\n")):
            if w := tuple(x.split()):
                want.append((d, i, len(w), w, (d, w) in seen))
                seen.add((d, w))
    got, _ = line_rows(texts)
    assert [(r["doc"], r["line"], r["n"], r["again"]) for r in got] == [(d, i, n, again) for d, i, n, _, again in want]
    pairs = {(w, (r["h"], r["n"])) for (*_, w, _), r in zip(want, got)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_line_keys_cpu():
    """Rare words cost no Python call each: keys take a few times the CPU of splitting the text."""
    rng = random.Random(2)
    texts = ["\n".join(" ".join(f"{rng.getrandbits(40):x}" for _ in range(40)) for _ in range(10)) for _ in range(1000)]
    line_rows(texts[:10])
    took = min(line_rows(texts)[1] for _ in range(3))
    split = []
    for _ in range(3):
        began = time.process_time()
        [x.split() for t in texts for x in t.encode().split(b"\n")]
        split.append(time.process_time() - began)
    assert took < 6 * min(split), (took, split)
