"""Line dedup by a deletion-neighbourhood join.

A line is the sequence of its words between ASCII white space; lines without words are no
lines. The edit bound is one: lines of ``LEAST_WORDS`` words or more are near if one word is
replaced, put in or left out; shorter lines, joined by single spaces to ``LEAST_CHARS``
characters or more, if one character is; all others only if they are equal. A line goes if an
earlier one, by document and line number, is near.

Of each distinct line every variant with one unit (word or character) deleted becomes a hashed
key, beside the key of the whole line; lines that share a variant with the same place deleted,
or whose variant is another's whole, are near, which is then verified. One edit leaves the
first or the last half of a line as it is. Lines that share neither with another distinct line
can't be near one and emit no variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_1, U64, WordHashes, hashed, join_by_key, join_by_size, mixed, settle, settle_last, table, unused

LEAST_WORDS, LEAST_CHARS = 8, 16
WHOLE = -1
#: Whether a byte is ASCII white space.
SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))

#: Base of the rolling hash of unit sequences, odd, and its inverse modulo 2**64.
BASE = U64(0xD6E8FEB86659FD93)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64."""
    return np.concatenate([np.ones(1, U64), np.cumprod(np.full(max(n - 1, 0), base))])[:n]


def near(a, b) -> bool:
    """At most one edit apart, as sequences of words or as texts."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long_ = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(short, long_)) if x != y), len(short))
    return short[i + (len(a) == len(b)) :] == long_[i + 1 :]


def near_lines(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two lines, as words, are within the edit bound."""
    if len(a) >= LEAST_WORDS and len(b) >= LEAST_WORDS:
        return near(a, b)
    if len(a) < LEAST_WORDS and len(b) < LEAST_WORDS:
        x, y = (b" ".join(w).decode() for w in (a, b))
        return a == b or min(len(x), len(y)) >= LEAST_CHARS and near(x, y)
    return False


def _lines(text: str | None) -> list[list[bytes]]:
    return [x.split() for x in (text or "").encode().split(b"\n")]


def _split(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """(bytes, starts of words, their ends, lines, text, line) of UTF-8 texts.

    Line i, the ``line``-th of the ``text``-th, has the words from ``lines[i]`` to before
    ``lines[i + 1]``; lines without words are left out.
    """
    body = [x or b"" for x in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(body) + b"\n" * 8, np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[raw].view(np.int8))) + 1
    start, end = edge[::2], edge[1::2]
    # each text begins after a line break of its own, at the end of the text before or at the front
    begin = np.cumsum([1, *(len(x) + 1 for x in body)])
    breaks = np.flatnonzero(raw[: begin[-1]] == ord("\n"))
    lines = np.searchsorted(start, breaks)
    first = np.searchsorted(breaks, begin - 1)
    text = np.repeat(np.arange(len(body)), np.diff(first))
    line = np.arange(len(text)) - first[text]
    some = np.diff(lines) > 0
    return raw, start, end, np.append(lines[:-1][some], lines[-1]), text[some], line[some]


def _points(line: bytes) -> np.ndarray:
    """The characters of lines as hashes."""
    return mixed(np.frombuffer(line.decode().encode("utf-32-le"), "<u4").astype(U64) * MIX_1)


class _Runs:
    """Hashes of runs in a long sequence of unit hashes."""

    def __init__(self, units: np.ndarray):
        place = powers(len(units) + 1, BASE)
        self.back = powers(len(units) + 1, INVERSE)
        self.total = np.concatenate([np.zeros(1, U64), np.cumsum(units * place[:-1])])

    def of(self, i: np.ndarray, j: np.ndarray, salt) -> np.ndarray:
        return mixed((self.total[j] - self.total[i]) * self.back[i] + np.asarray(salt).astype(U64) * MIX_1)


def _parts(runs: _Runs, n: np.ndarray, kind: int) -> np.ndarray:
    """(lines, 4) keys of the first and the last half of each line, as the shorter line of a pair and as the longer one."""
    end = np.cumsum(n)
    begin, out = end - n, []
    for c in (n, n - 1):  # units of the shorter line of the pair
        half = np.maximum(c, 0) // 2
        salt = 4 * c + 2 * kind
        out += [runs.of(begin, begin + half, salt), runs.of(end - (np.maximum(c, 0) - half), end, salt + 1)]
    return np.stack(out, 1).view(np.int64) if len(n) else np.empty((0, 4), np.int64)


def line_keys(docs: DataFrame) -> DataFrame:
    """(o, doc, line, n, h, again, parts) of every line of ``docs`` (o, doc, text) that has words.

    h: hash of the line; again: an equal line stands before it in the document; parts: keys of
    its halves, none of lines that only an equal one is near to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                raw, start, end, lines, doc, line = _split(part.column(2).cast(pa.large_binary()).to_pylist())
                n = np.diff(lines)
                by_words = _Runs(hashed(raw, start, end))
                h = by_words.of(lines[:-1], lines[1:], n).view(np.int64)
                keys = _parts(by_words, n, 0)
                short = n < LEAST_WORDS
                whole = [b" ".join(raw[start[i] : end[j - 1]].tobytes().split()) for i, j in zip(lines[:-1][short], lines[1:][short])]
                size = np.array([len(w.decode()) for w in whole], np.int64)
                keys[short] = _parts(_Runs(_points(b"".join(whole))), size, 1)
                alone = np.zeros(len(n), bool)
                alone[short] = size < LEAST_CHARS
                by = np.lexsort((n, h, doc))
                same = (doc[by][1:] == doc[by][:-1]) & (h[by][1:] == h[by][:-1]) & (n[by][1:] == n[by][:-1])
                again = np.zeros(len(n), bool)
                again[by[1:][same]] = True
                none = alone | again
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(none, 0, 4))]), pa.int32()), pa.array(keys[~none].reshape(-1)))
                row = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(line.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h), pa.array(again), lists], names=["o", "doc", "line", "n", "h", "again", "parts"])

    return docs.mapInArrow(run, "o long, doc long, line int, n int, h long, again boolean, parts array<long>")


def neighbourhoods(docs: DataFrame) -> DataFrame:
    """(o, doc, line, words, keys) of the lines in ``wanted``; docs: (o, doc, text, wanted array<int>).

    keys: hash of each variant with one unit deleted, by its place, then of the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                out: list[list] = [[], [], [], [], []]
                for o, d, body, wanted in zip(*(part.column(i).to_pylist() for i in (0, 1)), part.column(2), part.column(3).to_pylist()):
                    split = _lines(body.as_py())
                    for i in wanted:
                        w = split[i]
                        whole, kind = b" ".join(w), int(len(w) < LEAST_WORDS)
                        units = _points(whole) if kind else hashes.of(w)
                        place = powers(len(units) + 1, BASE)
                        total = np.concatenate([np.zeros(1, U64), np.cumsum(units * place[:-1])])
                        # what follows the deleted unit moves one place down
                        sizes = np.array([2 * len(units) - 2 + kind, 2 * len(units) + kind], U64) * MIX_1
                        gone = mixed(total[:-1] + (total[-1] - total[1:]) * INVERSE + sizes[0])
                        key = np.concatenate([gone, mixed(total[-1:] + sizes[1])]).view(np.int64)
                        for column, value in zip(out, (o, d, i, whole, key)):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["o", "doc", "line", "words", "keys"])

    return docs.mapInArrow(run, "o long, doc long, line int, words binary, keys array<long>")


def _verified(pairs: DataFrame) -> DataFrame:
    """(doc, line, good) of ``pairs`` (doc, line, words, other words): whether the words are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = pa.array([near_lines(x.split(), y.split()) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), good], names=["doc", "line", "good"])

    return pairs.mapInArrow(run, "doc long, line int, good boolean")


def _with_words(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, line, words, other) of ``pairs`` (here, f); a line that many others meet is broadcast."""
    met = settle(pairs.select("here.doc", "here.line", F.col("f.doc").alias("d2"), F.col("f.line").alias("l2")).join(words, ["doc", "line"]))
    asked = met.groupBy("d2", "l2").agg(F.count("*").alias("n"))
    other = settle(asked.join(words.select(F.col("doc").alias("d2"), F.col("line").alias("l2"), F.col("words").alias("other")), ["d2", "l2"]))
    return join_by_key(met, other, ["d2", "l2"], "n").select("doc", "line", "words", "other")


def _near_ones(lines: DataFrame) -> DataFrame:
    """(doc, line) of the written ``lines`` (o, doc, line, words, keys) to which an earlier one is near."""
    keys = lines.select("o", "doc", "line", F.size("keys").alias("n"), F.posexplode("keys").alias("at", "key"))
    keys = keys.select("key", F.when(F.col("at") == F.col("n") - 1, WHOLE).otherwise(F.col("at")).alias("at"), F.struct("o", "doc", "line").alias("here"))
    shared = settle(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = settle(join_by_key(keys, shared, ["key"], "n").drop("n"))
    whole, cut = (F.min(F.when(c, F.col("here"))) for c in (F.col("at") == WHOLE, F.col("at") != WHOLE))
    by_key = settle(rows.groupBy("key").agg(whole.alias("whole"), cut.alias("cut"), F.count("*").alias("n")))
    by_place = settle(rows.groupBy("key", "at").agg(F.min("here").alias("same"), F.count("*").alias("n")))
    met = join_by_key(join_by_key(rows, by_key, ["key"], "n").drop("n"), by_place, ["key", "at"], "n")
    met = met.select("here", F.when(F.col("at") == WHOLE, F.col("cut")).otherwise(F.least("same", "whole")).alias("f"))
    pairs = met.where("f < here").groupBy("here").agg(F.min("f").alias("f"))
    words = lines.select("doc", "line", "words")
    checked = settle(_verified(_with_words(pairs, words)))
    found = checked.where("good").select("doc", "line")
    if checked.where("not good").isEmpty():
        return found
    # keys of lines that aren't near were equal by chance: all other earlier lines of their keys are looked at
    again = checked.where("not good").select("doc", "line")
    mine = rows.select("key", "at", "here", "here.doc", "here.line").join(again, ["doc", "line"]).select("key", "at", "here")
    roles = (F.col("at") == F.col("at2")) & (F.col("at") != WHOLE) | (F.col("at") == WHOLE) != (F.col("at2") == WHOLE)
    others = rows.select("key", F.col("at").alias("at2"), F.col("here").alias("f"))
    more = mine.join(others, "key").where(roles & (F.col("f") < F.col("here"))).select("here", "f").distinct()
    return found.unionByName(_verified(_with_words(more, words)).where("good").select("doc", "line"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """(doc, lines): the numbers of the lines that go, for each document that loses any.

    ``key``: a long of its own for each row (``dedup`` makes one). Documents are earlier by
    ``order``, a long, nulls last together with the largest one, and then by ``key``. Null and
    empty texts have no lines; ties in a document's lines are kept by line number.
    """
    first = F.coalesce(F.col(f"`{order or key}`").cast("long"), F.lit((1 << 63) - 1))
    body = docs.select(first.alias("o"), F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    rows = settle(line_keys(body))
    new = rows.where(~F.col("again"))
    first = new.groupBy("h", "n").agg(F.min(F.struct("o", "doc", "line", "parts")).alias("f"), F.count("*").alias("c"))
    first = settle(first.select("h", "n", "c", "f.o", "f.doc", "f.line", F.array_distinct("f.parts").alias("parts")))
    repeats = first.where("c > 1").select("h", "n", "c", F.struct("o", "doc").alias("d"))
    copies = join_by_key(new.select("o", "doc", "line", "h", "n"), repeats, ["h", "n"], "c").where(F.struct("o", "doc") > F.col("d")).select("doc", "line")
    copies = copies.unionByName(rows.where("again").select("doc", "line"))

    parts = first.select("doc", "line", F.explode("parts").alias("part"))
    shared = settle(parts.groupBy("part").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = settle(join_by_key(parts, shared, ["part"], "n").groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("wanted")))
    lines = settle(neighbourhoods(join_by_size(body, wanted, "doc", cells=F.size("wanted")).select("o", "doc", "text", "wanted")))
    both = copies.unionByName(_near_ones(lines)).distinct()
    return both.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines_gone`` (replaced if there is one).

    Documents are earlier by ``key``, nulls last; rows with equal or null keys are documents of
    their own, in the order in which they are read. A document that loses all its lines stays,
    with an empty text; a null text stays null; an empty table gives no rows. Other columns
    stay, whatever their names.
    """
    kept = [c for c in docs.columns if c != "n_lines_gone"]
    row, out = unused(docs, "__row"), unused(docs, "__lines")
    own = settle(docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(row)))
    gone = settle_last(lambda: repeated(own, row, text, key).select(F.col("doc").alias(row), F.col("lines").alias(out)))
    met = own.join(gone.hint("merge"), row, "left")
    split = F.split(F.col(f"`{text}`"), "\n", -1)
    left = F.array_join(F.filter(F.transform(split, lambda x, i: F.when(~F.array_contains(out, i), x)), lambda x: x.isNotNull()), "\n")
    new = F.when(F.col(out).isNull(), F.col(f"`{text}`")).otherwise(left).alias(text)
    return met.select(*[new if c == text else F.col(f"`{c}`") for c in kept], F.when(F.col(out).isNull(), 0).otherwise(F.size(out)).alias("n_lines_gone"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return done.select("doc_id", F.col("n_lines_gone").cast("long").alias("n_lines_gone"), kept.cast("long").alias("n_lines_kept"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
