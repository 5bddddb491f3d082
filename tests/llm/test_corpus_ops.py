"""The other corpus operators against brute force, round trips and held-out labels."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.llm import licenses, media, mixing, packing, quality, sharding, toxicity

MID = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "same"), (5, "same"), (5, "same"), (None, "no key"), (7, "long " * 30000)]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect()}


def edge_docs(spark, more=()):
    return spark.createDataFrame([(k, t, "x", 1.5) for k, t in [*EDGES, *more]], "doc_id long, text string, rank string, size double")


# Sharding


def test_shards_of_table(spark, texts):
    rows = sharding.op1(spark, MID).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        assert r["grown_shard"] in (r["shard"], sharding.SHARDS)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_changed_weights_move_rows_within_their_subtrees_only(spark):
    tree = sharding.topology()
    rows = spark.range(20000)
    heavier = [[list(rack) for rack in region] for region in tree]
    heavier[0][1][2] = (6, 2.0)
    more = sharding.topology(26)
    got = rows.select(*[sharding.shard_of(t, F.col("id")).alias(n) for n, t in (("a", tree), ("b", heavier), ("c", sharding.topology(25)), ("d", more))]).collect()
    sizes = Counter(r["a"] for r in got)
    assert len(sizes) == 24 and max(sizes.values()) < 1.25 * min(sizes.values())
    assert all(r["b"] // 4 == 1 or r["b"] // 12 == 0 for r in got if r["a"] != r["b"])
    assert all(r["c"] == 24 for r in got if r["a"] != r["c"]) and all(r["d"] == 25 for r in got if r["c"] != r["d"])
    assert 0.8 < Counter(r["c"] for r in got)[24] / 800 < 1.2


def test_sharding_edges(spark):
    rows = sharding.assign(edge_docs(spark).withColumn("shard", F.lit("old")), "doc_id", sharding.topology()).collect()
    assert len(rows) == len(EDGES) and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert sharding.assign(edge_docs(spark).limit(0), "doc_id", sharding.topology()).count() == 0


# Licenses


def brute_scan(text):
    low = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words = find(low)
    at, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        base |= {label} if hits else set()
    labels = base | brute_blocks(text)[0]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


LICENSE_TEXTS = ["MIT License mit license", "the Apache\nLicense, a CC-BY x", "summit license", "admİt License", "mité license", *licenses.TEMPLATES.values(), "x " + licenses.TEMPLATES["bsd"].upper() + " y", "GNU general public-license gnu general PUBLIC license"]


def test_license_scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*[t for _, t in EDGES], *LICENSE_TEXTS, *texts.values()])], "doc_id long, text string, labels string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) == brute_scan(r["text"]), r["text"]
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["base_labels"])
    assert licenses.scan(docs.limit(0)).count() == 0
    bare = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs, templates={}).collect() if r["doc_id"] is not None}
    assert all(bare[r["doc_id"]] == (r["base_labels"], float(bool(r["base_labels"]))) for r in rows if r["doc_id"] is not None)


def brute_blocks(text):
    """Labels, and the largest share of a template that reaches the threshold, over all runs of words."""
    low = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    shares = {}
    for k, t in licenses.template_words(licenses.TEMPLATES).items():
        n, t = licenses.run_length(licenses.TEMPLATES[k]), set(t)
        held = len(t & set(words))  # no run holds more
        if held >= licenses.CONTAINMENT * len(t) - 1e-9:
            held = max(len(t & set(words[i : i + n])) for i in range(max(1, len(words) - n + 1)))
            if held >= licenses.CONTAINMENT * len(t) - 1e-9:
                shares[k] = held / len(t)
    return set(shares), max(shares.values(), default=0.0)


def test_license_headers_wrapped(spark, texts):
    wrapped = {}
    for k, t in licenses.TEMPLATES.items():
        w = t.split()
        for cut in (3, len(w) // 2):
            wrapped[" * some words before " + " ".join(w[:cut]) + "\r\n * " + " ".join(w[cut:]) + "\n\nand after"] = k
        wrapped["\n# ".join(["/*", *w, "*/"])] = k
    bodies = [*wrapped, "filler words\n" * 50 + next(iter(wrapped)), "the word is free\nand of\nuse", *list(texts.values())[:150]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(bodies)], "doc_id long, text string")
    rows = sorted(licenses.scan(docs).collect(), key=lambda r: r["doc_id"])
    for r in rows:
        labels, share = brute_blocks(r["text"])
        got = set(filter(None, r["labels"].split(",")))
        assert got == labels | set(filter(None, r["base_labels"].split(","))), r["text"]
        assert r["text"] not in wrapped or wrapped[r["text"]] in got
        assert abs(r["score"] - (1 if r["base_labels"] else share)) < 1e-9, r["text"]


# Mixing


def test_knapsack_against_search():
    rng = np.random.default_rng(0)
    for _ in range(200):
        have = [(int(n), int(c)) for n, c in zip(rng.integers(1, 30, 4), rng.integers(1, 4, 4))]
        have = list(dict(have).items())
        budget = int(rng.integers(0, 90))
        sums = {0}
        for n, c in have:
            sums = {s + n * k for s in sums for k in range(c + 1)}
        took = mixing.knapsack(budget, have)
        assert sum(n * k for n, k in took.items()) == max(s for s in sums if s <= budget)
        assert all(k <= dict(have)[n] for n, k in took.items())


def test_fit_of_very_long_documents():
    assert mixing.fit([97000, 98000], [1, 1], 100000.0) == (0, [0, 1])
    assert mixing.fit([10, 97000, 98000], [0, 1, 1], 96999.0) == (0, [0, 0, 0])
    assert mixing.fit([70000, 90000], [3, 2], 72000.0) == (0, [1, 0])


def test_targets():
    got = mixing.targets({"a": 10, "b": 1000, "c": 200, None: 90})
    assert got["a"] == 20 and abs(sum(got.values()) - 1950) < 1e-6
    assert all(got[s] <= 2 * n + 1e-9 for s, n in {"a": 10, "b": 1000, "c": 200, None: 90}.items())
    assert mixing.targets({}) == {}


def test_mix_of_table(spark, texts):
    first, again = (sorted(map(tuple, mixing.op4(spark, MID).collect())) for _ in range(2))
    assert first == again and len(first) == len(texts)
    rows = mixing.op4(spark, MID).collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    taken, target = Counter(), {}
    for r in rows:
        assert r["size"] == len(word.findall(texts[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= max(2, 0.001 * t) for s, t in target.items())


def test_mix_edges(spark):
    rows = [(1, None, 5), (2, None, 5), (2, None, 5), (3, "a", 0), (4, "b", 7), (None, "b", 9), (5, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df, "doc_id", "source", "size").collect()
    assert len(got) == len(rows) and all((r["taken"] or 0) <= 2 * (r["size"] or 0) for r in got)
    assert mixing.mix(df.limit(0), "doc_id", "source", "size").count() == 0


# Media


def test_audio_of_table(spark, texts):
    for r in media.op5(spark, MID).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_audio_round_trip_and_edges(spark):
    docs = edge_docs(spark, [(9, "x" * 64), (10, "x" * 65)]).withColumn("feature", F.lit(0))
    rows = media.decode(media.store(docs)).collect()
    want = Counter((t or "").encode() for _, t in [*EDGES, (9, "x" * 64), (10, "x" * 65)])
    assert Counter(r["payload"].rstrip(b"\0") for r in rows) == Counter(k.rstrip(b"\0") for k in want.elements())
    assert {len(r["payload"]) for r in rows if r["doc_id"] in (1, 2, 9)} == {64} and all(media.parse_wave(r["media"])[2] == r["payload"] for r in rows)
    assert media.decode(media.store(docs.limit(0))).count() == 0


def test_codecs():
    """Decoders against plain loops over the formats' definitions."""
    assert media.MULAW[0xFF] == 0 and media.MULAW[0] == -32124 and media.MULAW[0x80] == 32124
    assert media.ALAW[0xD5] == 8 and media.ALAW[0x2A] == -32256 and media.ALAW[0xAA] == 32256
    blocks = np.random.default_rng(1).integers(0, 256, (40, media.BLOCK)).astype(np.uint8)
    got = media.decode_ima(blocks)
    for b, out in zip(blocks, got):
        value, index = struct.unpack("<h", b[:2].tobytes())[0], min(int(b[2]), 88)
        want = [value]
        for byte in b[4:].tolist():
            for nib in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                add = (step >> 3) + (step if nib & 4 else 0) + (step >> 1 if nib & 2 else 0) + (step >> 2 if nib & 1 else 0)
                value = max(-32768, min(32767, value - add if nib & 8 else value + add))
                index = max(0, min(88, index + int(media.INDEX[nib & 7])))
                want.append(value)
        assert out.tolist() == want
    pcm = np.array([0, 10, -10], np.int16)
    assert media.resample(pcm).tolist() == [0, 5, 10, 0, -10, -10] and len(media.resample(pcm, 8000, 12000)) == 4


# Toxicity and quality


def test_toxicity_on_held_out(spark):
    rows = {r["doc_id"]: r for r in toxicity.op8(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(rows[x["doc_id"]], x["toxic"]) for x in labels if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    right = sum(r["predicted"] == y for r, y in held) / len(held)
    hit = sum(r["predicted"] for r, y in held if y) / max(1, sum(y for _, y in held))
    assert right > 0.95 and hit > 0.7, (right, hit)


def test_toxicity_edges(spark):
    docs = edge_docs(spark).withColumn("score", F.lit("old"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    model = toxicity.train([("you idiot " + "word " * i, 1) for i in range(20)] + [("calm words " * (i + 1), 0) for i in range(20)], 0.5)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect()) and toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_keeps_rare_vocabulary():
    """Toxic words of few documents count although others have far more evidence."""
    rng = np.random.default_rng(5)
    calm = [f"calm{i}" for i in range(300)]
    text = lambda *more: " ".join(rng.permutation([*rng.choice(calm, 30), *more]))
    samples = [(text("grobak", "grobak"), 1) for _ in range(300)] + [(text("zelpuwi", "zelpuwi"), 1) for _ in range(30)] + [(text(), 0) for _ in range(700)]
    model = toxicity.train(samples, 330 / 1030)
    assert b" grobak" in model.toxic and b" zelpuwi" in model.toxic
    made = toxicity.compressors(model)
    x = np.array([toxicity.features(toxicity.words(t), *made) for t in [*(text("zelpuwi", "zelpuwi") for _ in range(40)), *(text() for _ in range(40))]])
    found = ((x - model.mean) / model.sd) @ model.weights[:-1] + model.weights[-1] >= 0
    assert found[:40].mean() > 0.9 and found[40:].mean() < 0.05, found


def plain_features(text_words, *made):
    """The features of one text, window by window."""
    size = lambda how, w: len(how.compress(w))
    out = []
    plain = [toxicity.windows(text_words, toxicity.PLAIN_WINDOW), made[:3], toxicity.PLAIN_SHARES, toxicity.PLAIN_STEPS, toxicity.PLAIN_LOSS]
    wide = [[toxicity.widened(w) + toxicity.END for w in toxicity.windows(text_words, toxicity.WIDE_WINDOW)], made[3:], toxicity.WIDE_SHARES, toxicity.WIDE_STEPS, toxicity.WIDE_LOSS]
    for found, (strong, toxic, ordinary), shares, steps, loss in (plain, wide):
        full = [size(ordinary, w) - size(toxic, w) for w in found]
        for saved in ([size(ordinary, w) - size(strong, w) if x > 0 else x for w, x in zip(found, full)], full):
            top = np.sort(np.maximum(saved, loss))[::-1]
            out += [top[0], top[:3].mean(), top[:8].mean(), top.mean(), *((top >= x).mean() for x in shares), *(np.log1p((top >= x).sum()) for x in steps), np.log(len(top))]
    return out


def test_toxicity_windows_of_many_texts_in_one_call():
    """Each text's features are those of its windows one by one, and no window costs a Python call of its own."""
    rng = np.random.default_rng(8)
    calm = ["née", *(f"calm{i}" for i in range(300))]
    text = lambda n, *more: " ".join(rng.permutation([*rng.choice(calm, n), *more]))
    model = toxicity.train([(text(30, "grobak", "grobak"), 1) for _ in range(60)] + [(text(30), 0) for _ in range(90)], 0.4)
    made = toxicity.compressors(model)
    texts = ["", " \n", "a", "㊊㊊ \x8a", *(text(int(n), *["grobak"] * int(n % 4)) for n in rng.integers(0, 90, 2 * toxicity.TEXTS)), text(5000, "grobak")]
    got = toxicity.all_features([toxicity.words(t) for t in texts], *made)
    assert np.allclose(got, [plain_features(toxicity.words(t), *made) for t in texts], rtol=1e-12) and toxicity.all_features([], *made).shape == (0, toxicity.N_FEATURES)


def test_toxicity_segments_are_cut_once(monkeypatch):
    """Training doesn't cut each fold's documents into segments again."""
    cut, whole = [], toxicity.segments
    monkeypatch.setattr(toxicity, "segments", lambda w: cut.append(len(w)) or whole(w))
    samples = [(f"calm words number{i} of a text " * 3 + "grobak " * (i % 2), i % 2) for i in range(200)]
    assert b" grobak" in toxicity.train(samples, 0.5).toxic
    assert sum(cut) <= 3 * sum(len(toxicity.words(t)) for t, _ in samples)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20000) < 0.7
    accuracy = [0.95, 0.9, 0.8, 0.6]
    votes = np.stack([np.where(rng.random(len(good)) < 0.2, -1, np.where(rng.random(len(good)) < a, good, ~good)) for a in accuracy], 1).astype(int)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rate, share = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.03 and ((post[at.reshape(-1)] >= 0.5) == good).mean() > 0.93
    assert all(abs(rate[1, i, 1] / (rate[1, i, 0] + rate[1, i, 1]) - a) < 0.04 for i, a in enumerate(accuracy))


def test_quality_against_labels(spark):
    rows = {r["doc_id"]: r for r in quality.op9(spark, MID).collect()}
    labels = spark.read.parquet(f"{MID}/labels.parquet").collect()
    assert len(rows) == 1000
    right = sum(rows[x["doc_id"]]["kept"] == (x["quality"] == 1) for x in labels) / len(labels)
    clean = [x for x in labels if x["quality"] == 1]
    assert right > 0.9 and sum(rows[x["doc_id"]]["kept"] for x in clean) > 0.97 * len(clean), right


def test_quality_edges(spark):
    docs = edge_docs(spark)
    assert quality.classify(docs).count() == len(EDGES) and quality.classify(docs.limit(0)).count() == 0


# Packing


def test_plain_texts_have_the_tokenizer_files_ids():
    encode = packing.encoder()
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    plain = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and packing.PLAIN.fullmatch(chr(c))]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(plain, 60)) for _ in range(2000)] + ["".join(rng.choice(plain[:128], 200)) for _ in range(500)]
    texts += [f"a{c} {c}b  {c}" for c in plain[:1200]] + ["<|endoftext|> a", "x" * 5000, " " * 3000, "ಅ​\U0001f600 ok", "it's WE'LL 3.14"]
    for text in texts:
        assert encode(text) == full.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, texts):
    encode = packing.encoder()
    ids = {k: [*encode(t or ""), 0] for k, t in texts.items()}
    whole, places = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        whole[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, cut in whole.items():
        at = 0
        for start, n in sorted(cut):
            assert start == at
            at += n
        assert at == len(ids[k])
    used = 0
    for put in places.values():
        at = 0
        for offset, n in sorted(put):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
        used += at
    assert set(whole) == set(ids) and sorted(places) == list(range(len(places)))
    return used / (len(places) * packing.LENGTH)


def test_packing_of_table(spark, texts):
    assert check_packing(packing.op10(spark, MID).collect(), texts) > 0.98


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "word " * 5000, 1)], "doc_id long, text string, start int")
    check_packing(packing.pack(packing.pieces(docs)).collect(), {1: None, 2: "", 3: "word " * 5000})
    twice = packing.pack(packing.pieces(docs.unionByName(docs))).collect()
    assert len(twice) == 2 * packing.pieces(docs).count() and len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_patterns_place_every_length():
    rng = np.random.default_rng(3)
    for _ in range(20):
        histogram = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 30), rng.integers(1, 500, 30))}
        found = packing.patterns(histogram, 64)
        assert Counter({n: sum(p.count(n) * c for p, c in found) for n in histogram}) == Counter(histogram)
        assert all(sum(p) <= 64 for p, _ in found)


# Mixing without caps


def best_sum(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
    return max(sums)


def test_fit_reaches_the_best_sum():
    assert mixing.fit([70000, 70001], [1, 1], 70001) == (0, [0, 1])
    assert mixing.fit([5, 100000], [3, 1], 100003) == (0, [0, 1])
    assert mixing.fit([3000, 70000], [1, 1], 72000) == (0, [0, 1])
    rng = np.random.default_rng(8)
    for _ in range(60):
        most = int(rng.choice([50, 3000, 200_000]))
        lengths = sorted({int(n) for n in rng.integers(1, most, 4)})
        counts = [int(c) for c in rng.integers(1, 4, len(lengths))]
        total = sum(n * c for n, c in zip(lengths, counts))
        target = float(rng.uniform(0, 2.2) * total)
        copies, extra = mixing.fit(lengths, counts, target)
        rest = int(target - copies * total)
        assert copies == int(target // total) and all(0 <= e <= c for e, c in zip(extra, counts))
        assert sum(n * e for n, e in zip(lengths, extra)) == best_sum(lengths, counts, rest), (lengths, counts, target)


def test_source_targets_of_tables(spark):
    rng = np.random.default_rng(3)
    for n in (1, 5, 40):
        sizes = {f"s{int(i)}": int(x) for i, x in zip(rng.permutation(n), rng.integers(0, 10_000, n) ** 2)}
        sizes |= {None: 77, "": 5}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = mixing.targets(sizes)
        assert len(got) == len(want) and all(abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]]) for r in got)
    assert mixing.source_targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_ids_of_a_whole_table_by_the_tokenizer_file(spark):
    """All documents of sf0.1: the ids that the operator uses are those of the tokenizer file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    full, encode = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), packing.encoder()
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    for i in range(0, len(texts), 500):
        want = [e.ids for e in full.encode_batch(texts[i : i + 500], add_special_tokens=False)]
        assert [encode(t) for t in texts[i : i + 500]] == want
