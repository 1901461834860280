"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM, decoded and resampled to PCM.

The 8-bit laws are expanded by lookup tables. ADPCM is decoded one sample position at a time for all
blocks of a batch together, as blocks don't depend on each other. Work is cut into slices of bounded
size, so that memory depends on neither the number nor the length of recordings, except that one
recording and its samples have to fit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteops.llm.common import beside, slices, table

PCM, A_LAW, MU_LAW, IMA = 1, 6, 7, 17
RATE = 8000
#: Bytes of an ADPCM block, and of a slice of recordings that are decoded together.
BLOCK = 192
SLICE = 1 << 20
#: Payloads of stored texts are padded with spaces to a multiple of this.
UNIT = 192

# The quantiser steps of IMA ADPCM, and how a code moves the step index.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73,
    80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mu_law_table() -> np.ndarray:
    """Linear 16-bit samples of the 256 mu-law bytes."""
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """Linear 16-bit samples of the 256 A-law bytes."""
    a = np.arange(256) ^ 0x55
    part, low = (a >> 4) & 7, (a & 15) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + code: the change of the sample, and the next step index."""
    step = np.array(STEPS)[:, None]
    code = np.arange(16)[None, :]
    size = (step >> 3) + (code >> 2 & 1) * step + (code >> 1 & 1) * (step >> 1) + (code & 1) * (step >> 2)
    change = np.where(code & 8, -size, size)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.array(MOVES)[code & 7], 0, len(STEPS) - 1)
    return change.astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


def ima_blocks(blocks: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Samples of mono ADPCM blocks, uint8 (n, bytes) to int16 (n, 2 * bytes - 7).

    A block starts with its first sample, a step index (kept in range) and a byte without meaning.
    """
    change, after = tables
    n, size = blocks.shape
    out = np.empty((2 * size - 7, n), np.int16)
    now = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8) << 16 >> 16
    state = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = now
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(size - 4):
        for k, code in enumerate((codes[i] & 15, codes[i] >> 4)):
            at = state + code
            now = np.clip(now + change[at], -32768, 32767)
            state = after[at]
            out[1 + 2 * i + k] = now
    return out.T


def wav(kind: int, data: bytes, rate: int = RATE, block: int = 1, bits: int = 8, samples: int | None = None) -> bytes:
    """A mono WAV file."""
    per_second = rate * bits // 8
    extra = b""
    if kind == IMA:
        bits, extra = 4, struct.pack("<H", 2 * block - 7)
        per_second = rate * block // (2 * block - 7)
    form = struct.pack("<HHIIHHH", kind, 1, rate, per_second, block, bits, len(extra)) + extra
    count = struct.pack("<I", len(data) if samples is None else samples)
    odd = b"\0" * (len(data) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact\4\0\0\0" + count
    body += b"data" + struct.pack("<I", len(data)) + data + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """Kind, rate, block size and data of a mono WAV file; None for anything else."""
    if media is None or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            wanted = {PCM: 16, A_LAW: 8, MU_LAW: 8, IMA: 4}.get(kind)
            form = (kind, rate, block) if channels == 1 and rate and bits == wanted else None
        if name == b"data":
            if form is None or form[0] == IMA and form[2] < 5:
                return None
            return *form, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return None


def resample(pcm: np.ndarray, rate: int, to: int, step: int = 1 << 20) -> np.ndarray:
    """Linear interpolation in integers, rounded down. The last sample holds to the end."""
    if rate == to or not len(pcm):
        return pcm
    out = np.empty(len(pcm) * to // rate, np.int16)
    for a in range(0, len(out), step):
        at = np.arange(a, min(a + step, len(out)), dtype=np.int64) * rate
        i, part = np.divmod(at, to)
        left, right = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
        out[a : a + len(at)] = (left * (to - part) + right * part) // to
    return out


def ima_pcm(parts: list[bytes], block: int, tables) -> list[np.ndarray]:
    """Samples of each list of whole blocks. A shorter block at an end is left out."""
    whole = [np.frombuffer(x, np.uint8)[: len(x) // block * block].reshape(-1, block) for x in parts]
    out: list[np.ndarray] = []
    for a, b in slices([x.size for x in whole], SLICE):
        joined = np.concatenate(whole[a:b])
        rows = SLICE // block
        done = [ima_blocks(joined[i : i + rows], tables) for i in range(0, len(joined), rows)]
        samples = np.concatenate(done) if done else np.empty((0, 2 * block - 7), np.int16)
        ends = np.cumsum([0, *(len(x) for x in whole[a:b])])
        out += [samples[s:e].ravel() for s, e in zip(ends, ends[1:])]
    return out


def decode(media: list[bytes | None], to: int, tables) -> list[np.ndarray | None]:
    """PCM samples at the rate `to` of each recording; None where it can't be read."""
    law = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}
    found = [parse_wav(m) for m in media]
    pcm: list[np.ndarray | None] = [None] * len(media)
    ima: dict[int, list[int]] = {}
    for i, form in enumerate(found):
        if form is None:
            continue
        kind, _, block, data = form
        if kind == IMA:
            ima.setdefault(block, []).append(i)
        elif kind == PCM:
            pcm[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
        else:
            pcm[i] = law[kind][np.frombuffer(data, np.uint8)]
    for block, places in ima.items():
        for i, x in zip(places, ima_pcm([found[i][3] for i in places], block, tables)):
            pcm[i] = x
    return [None if x is None else resample(x, f[1], to) for x, f in zip(pcm, found)]


def to_pcm(df: DataFrame, media: str = "media", rate: int = 16000, out: str = "pcm") -> DataFrame:
    """Adds the recordings of the column `media` as 16-bit mono WAV files of one rate, in `out`.

    Null and unreadable recordings give null, recordings without samples a file without samples. All
    other columns stay as they are; `out` replaces a column of that name.
    """
    rows, kept, schema, place = beside(df, media, None, {out: F.lit(None).cast("binary")})

    def run(batches):
        tables = ima_tables()
        for batch in batches:
            files = batch.column(place).to_pylist()
            for a, b in slices([len(f or b"") for f in files], SLICE):
                done = decode(files[a:b], rate, tables)
                made = [None if x is None else wav(PCM, x.tobytes(), rate, 2, 16, len(x)) for x in done]
                part = batch.slice(a, b - a)
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def store_texts(
    df: DataFrame, text: str = "text", out: str = "media", keep: list[str] | None = None
) -> DataFrame:
    """Adds each whole text as a mu-law recording whose samples are its UTF-8 bytes.

    The bytes are padded with spaces to a positive multiple of 192, so nothing is lost by the law. Null
    is stored like an empty text. `n_bytes` is the length before padding. The columns `keep` stay, or all
    others.
    """
    rows, kept, schema, place = beside(df, text, keep, {"n_bytes": F.lit(0).cast("long"), out: F.lit(b"")})

    def run(batches):
        for batch in batches:
            raw = [x or b"" for x in batch.column(place).cast(pa.binary()).to_pylist()]
            for a, b in slices([len(x) for x in raw], SLICE):
                part, data = batch.slice(a, b - a), raw[a:b]
                files = [wav(MU_LAW, x + b" " * (-len(x) % UNIT if x else UNIT)) for x in data]
                size = pa.array([len(x) for x in data], pa.int64())
                columns = [*(part.column(i) for i in range(len(kept))), size, pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def described(pcm: np.ndarray) -> str:
    """Loudness, peak, zero crossings and checksum of samples."""
    if not len(pcm):
        return "0/0/0/0"
    size = np.abs(pcm.astype(np.int32))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{int(size.sum())}/{int(size.max())}/{turns}/{zlib.crc32(pcm.tobytes())}"


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """What reading stored mu-law recordings back gives: payload, checksums and features.

    Features describe the samples of the file, resampled to 16 kHz, and those that its bytes stand for
    as A-law and as ADPCM blocks of 192 bytes.
    """
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )

    def run(batches):
        ima, a_law = ima_tables(), a_law_table()
        for batch in batches:
            ids, sizes, files = (batch.column(i) for i in range(3))
            files = files.to_pylist()
            for a, b in slices([len(f) for f in files], SLICE):
                part = files[a:b]
                data = [parse_wav(f)[3] for f in part]
                mu = decode(part, 2 * RATE, ima)
                blocks = ima_pcm(data, BLOCK, ima)
                text = [
                    f"mu={described(m)};a={described(a_law[np.frombuffer(d, np.uint8)])};ima={described(x)}"
                    for m, d, x in zip(mu, data, blocks)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        sizes.slice(a, b - a),
                        pa.array([len(d) for d in data], pa.int64()),
                        pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                        pa.array([zlib.crc32(d[-16:]) for d in data], pa.int64()),
                        pa.array([len(f) for f in part], pa.int64()),
                        pa.array([hashlib.sha256(f).hexdigest() for f in part]),
                        pa.array(text),
                    ],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    return df.select("doc_id", "n_bytes", F.col(media)).mapInArrow(run, schema)


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a mu-law recording, read back and described.

    "tail_crc32" is that of the last 16 payload bytes.
    """
    return features(store_texts(table(spark, sf_dir, "documents"), keep=["doc_id"]))
