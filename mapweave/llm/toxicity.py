"""Toxicity by compression distance.

Three zstandard dictionaries are made, two from toxic and one from ordinary text. All hold the
same frequent words at the same distances; around them stand, in the toxic ones, the character
segments (word beginnings and words) that toxic documents use more often than chance allows
and, in the ordinary one, as much of further ordinary words. One toxic dictionary holds all
such segments, the other only those of strong evidence, so that weak ones (of languages with
few toxic documents) count by what they are worth; it is asked only about windows that the full
one shortens. A window that a dictionary knows compresses to fewer bytes with it, and the
differences over a document's windows, put through a logistic calibration, give its score. That
is done with the bytes as they
are, and in shorter windows with each byte written twice, once with its top bit flipped, so
that a known word saves well more than a match costs. The calibration sees each labelled
document through dictionaries that were made without it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table

#: Labelled documents that the model is fitted on, at most.
SAMPLE = {1: 1500, 0: 3000}
BASE_WORDS = 500
#: Segments that may enter by chance, among all that are looked at.
BY_CHANCE = 0.01
#: Share of the strongest segment's evidence from which others stand in both toxic dictionaries, not just in the full one.
EVIDENCE_SHARE = 0.2
#: Parts of the labelled documents, each of which is measured with dictionaries made from the others.
FOLDS = 5
#: Words in a window as it is and in one of bytes written twice.
PLAIN_WINDOW, WIDE_WINDOW = 8, 6
#: Windows are counted that save at least so many bytes, and none counts for fewer than the loss.
PLAIN_SHARES, PLAIN_STEPS, PLAIN_LOSS = (3, 5), (4, 6), -2
WIDE_SHARES, WIDE_STEPS, WIDE_LOSS = (), (4, 7, 10, 13), -4
N_FEATURES = 36
#: Texts whose windows are compressed in one call.
TEXTS = 64
#: Ends a dictionary, whose last bytes zstandard doesn't index, and a wide window, in whose last it starts no match.
END = b"\n" * 16
FLIPPED = bytes(i ^ 128 for i in range(256))
STRIP = b".,;:!?\"'()"


@dataclass
class Model:
    strong: bytes
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    constant: float | None = None


def words(text: str) -> list[bytes]:
    return [w for w in (x.strip(STRIP) for x in text.lower().encode().split()) if w]


def segments(text_words: list[bytes]) -> set[bytes]:
    out: set[bytes] = set()
    for w in set(text_words):
        w = b" " + w + b" "
        out.update([w[:k] for k in range(4, min(len(w), 12) + 1)])
        out.add(w)
    return out


def evidence(mine: Counter, other: Counter, n_mine: int, n_other: int, looked_at: int) -> list[tuple[float, int, bytes]]:
    """(log-likelihood gain of a rate of its own in each class, length, segment), strongest first.

    Only segments that are more frequent in mine than chance lets any of those looked at be.
    """
    share, found, least = n_mine / max(n_mine + n_other, 1), [], math.log(max(looked_at, 1) / BY_CHANCE)
    for s, x in mine.items():
        y = other[s]
        n = x + y
        gain = x * math.log(x / (n * share)) + (y * math.log(y / (n * (1 - share))) if y else 0.0)
        if x / n > share and gain >= least:
            found.append((gain, len(s), s))
    return sorted(found, reverse=True)


def distinctive(scored: list[tuple[float, int, bytes]]) -> tuple[list[bytes], list[bytes]]:
    """(strong, weak) segments, strongest first, none the beginning of another."""
    strong: list[bytes] = []
    weak: list[bytes] = []
    for gain, _, s in scored:
        if not any(s.startswith(c) or c.startswith(s) for c in (*strong, *weak)):
            (strong if gain >= EVIDENCE_SHARE * scored[0][0] else weak).append(s)
    return strong, weak


def widened(content: bytes) -> bytes:
    out = bytearray(2 * len(content))
    out[::2], out[1::2] = content, content.translate(FLIPPED)
    return bytes(out)


def windows(text_words: list[bytes], width: int) -> list[bytes]:
    starts = range(0, max(len(text_words), 1), width)
    return [b" " + b" ".join(text_words[i : i + width]) + b" " for i in starts]


def compressors(model: Model) -> list:
    """Strong, toxic and ordinary for plain windows, then for wide ones."""
    made = []
    for form, log, least in ((bytes, 12, 4), (widened, 13, 6)):
        for content in (model.strong, model.toxic, model.ordinary):
            content = form(content)
            size = len(content).bit_length()
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=least, window_log=max(14, size + 1), chain_log=max(log, size), hash_log=max(log, size), search_log=4, target_length=8, write_content_size=False, write_checksum=False, write_dict_id=False)
            dictionary.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how))
    return made


def sizes(how: zstandard.ZstdCompressor, found: list[bytes]) -> np.ndarray:
    """Bytes to which each window compresses."""
    if not found:
        return np.zeros(0, np.int64)
    done = how.multi_compress_to_buffer(found, threads=1)
    return np.fromiter((len(done[i]) for i in range(len(done))), np.int64, len(found))


def savings(saved: np.ndarray, n: np.ndarray, shares: tuple, steps: tuple, loss: int) -> np.ndarray:
    """A row of features for each document; ``saved``: by each window, ``n`` of them a document."""
    saved = np.maximum(saved, loss)
    first = np.cumsum(n) - n
    top = saved[np.lexsort((-saved, np.repeat(np.arange(len(n)), n)))]
    total = np.concatenate([[0], np.cumsum(top)])
    mean = lambda most: (total[first + np.minimum(n, most)] - total[first]) / np.minimum(n, most)
    reach = lambda x: np.add.reduceat(saved >= x, first, dtype=np.int64)
    part = [reach(x) / n for x in shares]
    reached = [np.log1p(reach(x)) for x in steps]
    return np.stack([top[first], mean(3), mean(8), mean(len(saved)), *part, *reached, np.log(n)], 1)


def all_features(texts: Iterable[list[bytes]], *made) -> np.ndarray:
    """(texts, N_FEATURES) savings by ``compressors``: plain by strong segments and by all, then wide by the same.

    The windows of up to ``TEXTS`` texts are compressed in one call.
    """
    out, texts = [np.zeros((0, N_FEATURES))], iter(texts)
    while some := [*islice(texts, TEXTS)]:
        row: list[np.ndarray] = []
        for width, (strong, toxic, ordinary), how in ((PLAIN_WINDOW, made[:3], (PLAIN_SHARES, PLAIN_STEPS, PLAIN_LOSS)), (WIDE_WINDOW, made[3:], (WIDE_SHARES, WIDE_STEPS, WIDE_LOSS))):
            cut = [windows(w, width) for w in some]
            n = np.array([len(x) for x in cut])
            found = [w for x in cut for w in x]
            if width == WIDE_WINDOW:
                whole, end = widened(b"".join(found)), 2 * np.cumsum([len(w) for w in found])
                found = [whole[i:j] + END for i, j in pairwise([0, *end.tolist()])]
            size = sizes(ordinary, found)
            full = size - sizes(toxic, found)
            sure = full.copy()
            asked = np.flatnonzero(full > 0)
            sure[asked] = size[asked] - sizes(strong, [found[i] for i in asked])
            row += [savings(sure, n, *how), savings(full, n, *how)]
        out.append(np.concatenate(row, 1))
    return np.concatenate(out)


def features(text_words: list[bytes], *made) -> list[float]:
    """The features of one text."""
    return all_features([text_words], *made)[0].tolist()


@dataclass
class Counts:
    """Of some labelled documents: how many there are by label, and how many have a segment or word."""

    labels: Counter
    toxic: Counter
    ordinary: Counter
    words: Counter
    toxic_texts: list[list[bytes]]


def counted(split: list[tuple[list[bytes], int]], often: dict[bytes, bytes]) -> Counts:
    """Counts of (words, label) pairs; of segments, those in ``often``."""
    c = Counts(Counter(y for _, y in split), Counter(), Counter(), Counter(), [w for w, y in split if y])
    for w, y in split:
        (c.toxic if y else c.ordinary).update([often[s] for s in segments(w) if s in often])
        c.words.update(set(w))
    return c


def frequent_segments(texts: list[list[bytes]]) -> dict[bytes, bytes]:
    """Segments of three texts or more, each with itself."""
    seen: Counter = Counter()
    for w in texts:
        seen.update(segments(w))
    return {s: s for s, c in seen.items() if c >= 3}


def added(counters: list[Counter]) -> Counter:
    out: Counter = Counter()
    for c in counters:
        out.update(c)
    return out


def by_frequency(counts: Counter) -> Iterator[bytes]:
    """Words with a space on each side, by falling counts; rare ones are sorted only if they are reached."""
    for rare in (False, True):
        found = sorted(((-c, x + b" ") for x, c in counts.items() if (c < 3) == rare))
        yield from (b" " + x for _, x in found)


def dictionaries(parts: list[Counts], inside: dict[bytes, list[bytes]]) -> Model:
    """An uncalibrated model of the documents counted in ``parts``; ``inside``: frequent segments of each toxic word."""
    n = added([c.labels for c in parts])
    seen = Counter({s: x for s, x in added([c.toxic for c in parts]).items() if x >= 3})
    other_seen, frequent = added([c.ordinary for c in parts]), added([c.words for c in parts])
    likely = {s for _, _, s in evidence(seen, other_seen, n[1], n[0], len(seen))}
    held: dict[bytes, list[bytes]] = {}  # likely segments of each word
    beside = set()
    for w in (w for c in parts for w in c.toxic_texts):
        for x, after in zip(w, [*w[1:], b""]):
            if (found := held.get(x)) is None:
                found = held[x] = [s for s in inside[x] if s in likely]
            for s in found:
                beside.add((s, after))
    # copies of a text say a word again with the same word after it, which is no more evidence
    apart = Counter(s for s, _ in beside)
    strong, weak = distinctive(evidence(Counter({s: min(seen[s], apart[s]) for s in likely}), other_seen, n[1], n[0], len(seen)))
    toxic = (*strong, *weak)
    far, near = b"".join(weak[::-1]), b"".join(strong[::-1])
    common = (w for w in by_frequency(frequent) if not w.startswith(toxic))
    base, rest = b"".join([*islice(common, BASE_WORDS)][::-1]), b""
    # ordinary words at the places of the toxic segments
    while len(rest) < len(far) + len(near) and (more := b"".join(islice(common, 100))):
        rest += more
    rest += b" " * (len(far) + len(near))
    other_near, other_far = rest[: len(near)], rest[len(near) : len(near) + len(far)]
    zero = np.zeros(N_FEATURES)
    return Model(other_far + base + near + END, far + base + near + END, other_far + base + other_near + END, zero, np.ones(N_FEATURES), np.zeros(N_FEATURES + 1))


def measured(model: Model, split: list[tuple[list[bytes], int]]) -> np.ndarray:
    return all_features([w for w, _ in split], *compressors(model))


def train(samples: list[tuple[str, int]], prior: float) -> Model:
    """A model of (text, label) pairs; ``prior``: share of label 1 among all rows to learn from."""
    held: dict[bytes, bytes] = {}  # each word once, however many texts have it
    split = [([held.setdefault(w, w) for w in words(t)], y) for t, y in samples]
    n = Counter(y for _, y in split)
    if not n[0] or not n[1]:
        return Model(b"", b"", b"", np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), min(max(prior, 0.0), 1.0))
    # equal texts are in one part
    part = np.array([zlib.crc32(t.encode()) % FOLDS for t, _ in samples])
    x = np.zeros((len(split), N_FEATURES))
    often = frequent_segments([w for w, y in split if y])
    inside = {x: [often[s] for s in segments([x]) if s in often] for x in {x for w, y in split if y for x in w}}
    in_part = {k: [s for s, p in zip(split, part) if p == k] for k in np.unique(part)}
    counts = {k: counted(of, often) for k, of in in_part.items()}
    for k, of in in_part.items():
        x[part == k] = measured(dictionaries([c for j, c in counts.items() if j != k], inside), of)
    model = dictionaries([*counts.values()], inside)
    y = np.array([y for _, y in split], float)
    model.mean, model.sd = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - model.mean) / model.sd, np.ones(len(x))]
    beta = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(beta))
        beta -= np.linalg.solve(hessian, z.T @ (p - y) + 1e-2 * beta)
    odds = lambda q: math.log(q / (1 - q))
    beta[-1] += odds(min(max(prior, 1e-4), 1 - 1e-4)) - odds(n[1] / (n[0] + n[1]))
    model.weights = beta
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from labelled documents whose crc32 of the key as text, mod 5, is not 0.

    At most ``SAMPLE`` documents a class, by a hash of the key, reach the driver, whole; null
    labels and keys, and null texts, are left out, and a key that is labelled both ways counts
    for both. Without documents of both classes the model gives the share of label 1.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~held_out("k"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t is not null")
    parts = []
    for y, most in SAMPLE.items():
        ids = known.where(F.col("y") == y).select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(most)
        parts.append(texts.join(F.broadcast(ids), "k").select("k", "t", F.lit(y).alias("y")))
    rows = sorted(parts[0].unionByName(parts[1]).collect(), key=lambda r: (r["k"], r["y"], r["t"]))
    total = sum(counts.values())
    return train([(r["t"], r["y"]) for r in rows], counts.get(1, 0) / total if total else 0.0)


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the likelihood of label 1 of each whole text, null as empty.

    Equal texts have equal scores, whatever their keys, and repeated rows stay; an empty table
    gives no rows. A column of that name is replaced; others stay, whatever their names.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model) if model.constant is None else None
        for batch in batches:
            if pair:
                x = all_features((words(t.as_py() or "") for t in batch.column(at)), *pair)
                linear = ((x - model.mean) / model.sd) @ model.weights[:-1] + model.weights[-1]
                p = 1 / (1 + np.exp(-np.clip(linear, -30, 30)))
            else:
                p = np.full(batch.num_rows, model.constant)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    return map_batches(kept, run, [T.StructField("score", T.DoubleType())])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
