"""Telephony audio: 8-bit companded samples and ADPCM blocks in WAVE files, decoded and resampled.

mu-law and A-law codes expand through tables of 256 values, built from their formulas. IMA
ADPCM blocks of ``BLOCK`` bytes decode with numpy across all blocks of a batch at once. The
decoded PCM is resampled from 8 to 16 kHz and stored as a WAVE file of its own. Long payloads are
decoded, resampled and measured piece by piece.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table

RATE, OUT_RATE, BLOCK = 8000, 16000, 64
#: WAVE format tags (fixed values).
TAGS = {"mulaw": 7, "alaw": 6, "ima": 0x11, "pcm": 1}
CODECS = ("mulaw", "alaw", "ima")
#: Bytes of stored media that one output batch holds, about, and samples or blocks that are worked on at a time.
BATCH_BYTES = 4 << 20
PIECE = 1 << 18

#: IMA ADPCM step sizes and index changes (fixed values of the format).
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, seg = (code & 15) << 4, (code >> 4) & 7
    size = np.where(seg == 0, low + 8, (low + 264) << np.maximum(seg - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a nibble adds at each step index, and the index after it; both at ``16 * index + nibble``."""
    step, nib = np.repeat(STEPS, 16), np.tile(np.arange(16), len(STEPS))
    size = (step >> 3) + step * (nib >> 2 & 1) + (step >> 1) * (nib >> 1 & 1) + (step >> 2) * (nib & 1)
    after = np.clip(np.repeat(np.arange(len(STEPS)), 16) + INDEX[nib & 7], 0, len(STEPS) - 1)
    return np.where(nib & 8, -size, size).astype(np.int32), (after * 16).astype(np.int32)


MULAW, ALAW = mulaw_table(), alaw_table()
IMA_ADD, IMA_NEXT = _ima_tables()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(n, BLOCK) bytes to (n, 1 + 2 * (BLOCK - 4)) samples; an index beyond the table counts as its last."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1).T)
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for i, nib in enumerate(codes, 1):
        at += nib
        value += IMA_ADD[at]
        np.clip(value, -32768, 32767, out=value)
        at = IMA_NEXT[at]
        out[i] = value
    return np.ascontiguousarray(out.T)


def wave(codec: str, payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file that holds ``payload`` unchanged."""
    align, bits = (BLOCK, 4) if codec == "ima" else (2, 16) if codec == "pcm" else (1, 8)
    per_block = 1 + 2 * (BLOCK - 4)
    speed = rate * BLOCK // per_block if codec == "ima" else rate * align
    extra = struct.pack("<HH", 2, per_block) if codec == "ima" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, speed, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, payload) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data" and fmt:
            codec = next((k for k, v in TAGS.items() if v == fmt[0]), None)
            if codec is None:
                raise ValueError(f"format {fmt[0]} is not telephony audio")
            return codec, fmt[2], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def resample(pcm: np.ndarray, rate: int = RATE, out_rate: int = OUT_RATE) -> np.ndarray:
    """Linear interpolation to ``out_rate``; doubling the rate stays in integers."""
    if not len(pcm) or rate == out_rate:
        return pcm
    if out_rate == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[-1] = pcm[-1]
        for i in range(0, len(pcm) - 1, PIECE):
            j = min(i + PIECE, len(pcm) - 1)
            out[2 * i + 1 : 2 * j : 2] = (pcm[i:j].astype(np.int32) + pcm[i + 1 : j + 1]) >> 1
        return out
    at = np.arange(len(pcm) * out_rate // rate) * (rate / out_rate)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, root mean square, peak and sign changes of PCM."""
    power = peak = turns = crc = 0
    for i in range(0, len(pcm), PIECE):
        wide = pcm[i : i + PIECE].astype(np.int64)
        power += int((wide * wide).sum())
        peak = max(peak, int(np.abs(wide).max()))
        up = pcm[max(i - 1, 0) : i + PIECE] >= 0
        turns += int(np.count_nonzero(up[1:] != up[:-1]))
        crc = zlib.crc32(pcm[i : i + PIECE].tobytes(), crc)
    return f"{codec};n={len(pcm)};rms={(power // max(1, len(pcm))) ** 0.5:.2f};peak={peak};turns={turns};crc={crc}"


def samples_of(codec: str, payload: bytes) -> np.ndarray:
    """The 16-bit samples of a payload."""
    if codec == "pcm":
        return np.frombuffer(payload, "<i2")
    if codec != "ima":
        return (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(payload, np.uint8)]
    blocks = np.frombuffer(payload, np.uint8)[: len(payload) // BLOCK * BLOCK].reshape(-1, BLOCK)
    out = np.empty((len(blocks), 1 + 2 * (BLOCK - 4)), np.int16)
    for i in range(0, len(blocks), PIECE // BLOCK):
        out[i : i + PIECE // BLOCK] = decode_ima(blocks[i : i + PIECE // BLOCK])
    return out.reshape(-1)


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, padded with zeros to whole blocks, as a WAVE file.

    A null text is empty and one block of zeros. The codec follows the payload, so equal texts
    give equal files; repeated rows are stored again, rows without a key too; an empty table
    gives no rows; other columns are left out, whatever their names.
    """
    names = CODECS
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (body.as_py() or "").encode()
                payload = raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))
                out.append((k, len(raw), wave(names[zlib.crc32(payload) % len(names)], payload)))
                held += len(payload)
                if held >= BATCH_BYTES:
                    yield _emit(out, schema)
                    out, held = [], 0
            yield _emit(out, schema)

    chosen = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return chosen.mapInArrow(write, "key long, n_bytes long, media binary").withColumnRenamed("key", key)


def decode(stored: DataFrame, media: str = "media") -> DataFrame:
    """``stored`` with payload, pcm (a WAVE file of 16-bit samples at ``OUT_RATE``) and feature of each file in ``media``.

    Null media give nulls. Columns of these names are replaced; others stay, whatever their
    names. A file and its PCM are held whole, some 20 bytes for each byte of the longest.
    """
    kept = stored.select(*[F.col(f"`{c}`") for c in stored.columns if c not in ("payload", "pcm", "feature")])
    at = kept.columns.index(media)
    more = [T.StructField("payload", T.BinaryType()), T.StructField("pcm", T.BinaryType()), T.StructField("feature", T.StringType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held = 0, 0
            for i, v in enumerate(batch.column(at)):
                held += v.as_buffer().size if v.is_valid else 0
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield decoded(batch.slice(first, i + 1 - first))
                    first, held = i + 1, 0

    def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = [parse_wave(x) if x is not None else None for x in batch.column(at).to_pylist()]
        # all blocks of the batch at once
        whole = samples_of("ima", b"".join(p[2][: len(p[2]) // BLOCK * BLOCK] for p in parsed if p and p[0] == "ima"))
        used, out = 0, []
        for p in parsed:
            if p is None:
                out.append((None, None, None))
                continue
            codec, rate, payload = p
            if codec == "ima":
                n = len(payload) // BLOCK * (1 + 2 * (BLOCK - 4))
                samples, used = whole[used : used + n], used + n
            else:
                samples = samples_of(codec, payload)
            pcm = resample(samples, rate)
            out.append((payload, wave("pcm", pcm.tobytes(), OUT_RATE), feature(codec, pcm)))
        extra = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.binary(), pa.binary(), pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "payload", "pcm", "feature"])

    return map_batches(kept, read, more)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(table(spark, sf_dir, "documents"))
    read = decode(stored)
    n = F.octet_length("payload")
    return read.select("doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr(f"substring(payload, -{BLOCK}, {BLOCK})")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))
