"""Packing token sequences: shortest-pack-first over the length histogram.

Texts become token ids; a document is cut into full pieces of ``LENGTH`` ids and a rest.
Lengths are placed longest first, each into the shortest pack that has room, by counts of
equal packs (patterns); pieces then take their places by their rank among those of equal
length. Only the histogram and the patterns, both bounded by ``LENGTH``, reach the driver.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, row_salt, settle, table

LENGTH = 1024
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Code points whose classes the tokenizers' two regex engines hold alike.
PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞Ѐ-ҁぁ-ゖァ-ヺ一-龥가-힣]*")
SPECIAL = "<|endoftext|>"


def encoder(path: str | None = None, ranks: str | None = None):
    """A function from a text to its ids by the tokenizer file at ``path``.

    Texts of plain code points go through the same vocabulary in ``ranks``, several times
    faster and with equal ids; all others, and those that hold the special token's string,
    through the tokenizer file itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
    if path and not ranks:
        return lambda text: full.encode(text, add_special_tokens=False).ids
    with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})

    def ids(text: str) -> list[int]:
        if PLAIN.fullmatch(text) and SPECIAL not in text:
            return fast.encode_ordinary(text)
        return full.encode(text, add_special_tokens=False).ids

    return ids


_ENCODERS: dict = {}


def _encoder(path, ranks):
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = encoder(path, ranks)
    return _ENCODERS[path, ranks]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece.

    A document's ids end with id 0; a null or empty text is that id alone. Repeated rows, and
    rows without a key, give pieces of their own. Other columns are left out, whatever their
    names; an empty table gives no rows.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, ranks)
        for batch in batches:
            out: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(body.as_py() or ""), 0], "<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    out.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)) + ((part.astype(np.int32),) if keep_ids else ()))
            cols = list(zip(*out)) or [()] * (5 + keep_ids)
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(list(c), pa.list_(pa.int32())) for c in cols[5:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs), longest lengths placed first into the shortest pack."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    shortest: list[int] = []

    def put(used: int, pattern: tuple[int, ...], count: int) -> None:
        if used not in open_:
            open_[used] = []
            heapq.heappush(shortest, used)
        open_[used].append((pattern, count))

    for n in sorted(histogram, reverse=True):
        left, moved = histogram[n], []
        while left:
            if not shortest or shortest[0] + n > length:
                moved.append((n, (n,), left))
                break
            used = shortest[0]
            pattern, count = open_[used].pop()
            take = min(left, count)
            moved.append((used + n, (*pattern, n), take))
            if count > take:
                open_[used].append((pattern, count - take))
            if not open_[used]:
                del open_[heapq.heappop(shortest)]
            left -= take
        for x in moved:  # after the length is through, so that its packs take one of it at a time
            put(*x)
    return [x for used in sorted(open_) for x in open_[used]]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first rank, offset) of every place."""
    out, taken, base = [], {}, 0
    for pattern, count in found:
        offset = 0
        for n in pattern:
            first = taken.get(n, 0)
            out.append((n, first, first + count, base, offset))
            taken[n], offset = first + count, offset + n
        base += count
    return out


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut`` (doc_id, start, length, ...) with sequence_id and offset; both gapless from 0.

    An empty table gives no rows; ties of length are ordered by a hash of document and start.
    """
    rows = settle(cut)
    spark = rows.sparkSession
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    places = spark.createDataFrame(slots(patterns(histogram, length)), "p_length long, first long, after long, base long, offset long")
    ranked = gapless_rank(rows, ["length"], [F.col("doc_id"), F.col("start"), row_salt(rows)], row_salt(rows), "__rank")
    on = (F.col("length") == F.col("p_length")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("after"))
    met = ranked.join(F.broadcast(places), on)  # some places for each of at most `length` lengths
    return met.select(*cut.columns, (F.col("base") + F.col("__rank") - F.col("first")).alias("sequence_id"), "offset")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
