"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM in WAV files, decoded with numpy.

``store_payload`` wraps bytes as a WAV file of one of the three codecs; the bytes are the file's samples (for ADPCM
its blocks of 192 bytes), so nothing is lost. ``decode_media`` parses such files again, expands mu-law and A-law
by lookup tables, decodes ADPCM step by step across all blocks of a batch at once, doubles the rate to 16 kHz with
a four-tap filter in integers and returns PCM and features of it.

Nulls: a null text is an empty one, which is stored as one block of spaces; a null media value gives nulls. Long
texts make a batch of their own. Equal rows give equal values; a null key is a key like any other, and rows that repeat
one keep a row each. An empty table gives an empty result. Only the named columns are read, so other columns may have
any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import bounded_batches, table

BLOCK = 192  # bytes of an ADPCM block: 4 of header, 188 of two samples each
RATE = 8000
FORMATS = {"alaw": 6, "mulaw": 7, "ima": 17}  # WAV format tags
CODECS = ("mulaw", "alaw", "ima")
BATCH_BYTES = 1 << 20

# Fixed values of the IMA ADPCM format: step sizes and index changes.
IMA_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
        107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
        4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
        24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law byte (G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law byte (G.711)."""
    code = np.arange(256) ^ 0x55
    exponent, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file with the payload as its data."""
    if codec == "ima":
        samples = len(payload) // BLOCK * (1 + 2 * (BLOCK - 4))
        fmt = struct.pack("<HHIIHHHH", FORMATS[codec], 1, RATE, RATE * BLOCK // (1 + 2 * (BLOCK - 4)), BLOCK, 4, 2, 1 + 2 * (BLOCK - 4))
    else:
        samples = len(payload)
        fmt = struct.pack("<HHIIHHH", FORMATS[codec], 1, RATE, RATE, 1, 8, 0)
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next((k for k, v in FORMATS.items() if v == tag), None)
        elif name == b"data":
            if codec is None:
                raise ValueError("unknown WAV format")
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("WAV file without data")


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text in bytes, and its payload: bytes 32 appended up to a positive multiple of BLOCK."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (BLOCK - len(data) % BLOCK if len(data) % BLOCK or not data else 0)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks (n, 192) as (n, 377): one step at a time, across all blocks."""
    columns = np.ascontiguousarray(blocks.T)
    out = np.empty((1 + 2 * (BLOCK - 4), len(blocks)), dtype=np.int16)
    value = (columns[0].astype(np.uint16) | (columns[1].astype(np.uint16) << 8)).view(np.int16).astype(np.int32)
    index = np.minimum(columns[2], 88).astype(np.int32)
    out[0] = value
    at = 1
    for column in columns[4:]:
        for code in (column & 15, column >> 4):
            step = IMA_STEPS[index]
            diff = step >> 3
            diff += np.where(code & 4, step, 0)
            diff += np.where(code & 2, step >> 1, 0)
            diff += np.where(code & 1, step >> 2, 0)
            value += np.where(code & 8, -diff, diff)
            np.clip(value, -32768, 32767, out=value)
            index += IMA_INDEX[code]
            np.clip(index, 0, 88, out=index)
            out[at] = value
            at += 1
    return np.ascontiguousarray(out.T)


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: between two samples comes (-a + 9b + 9c - d) / 16 of the four nearest; ends are repeated."""
    wide = np.concatenate((pcm[:1], pcm, pcm[-1:], pcm[-1:])).astype(np.int32)
    middle = (9 * (wide[1:-2] + wide[2:-1]) - wide[:-3] - wide[3:] + 8) >> 4
    out = np.empty(2 * len(pcm), dtype="<i2")
    out[0::2] = pcm
    out[1::2] = np.clip(middle, -32768, 32767)
    return out


def decode_batch(media: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """Codec, payload and 8 kHz samples of some files; their ADPCM blocks are decoded together."""
    parsed = [parse_wav(m) for m in media]
    whole = [p[: len(p) // BLOCK * BLOCK] for c, p in parsed if c == "ima"]
    ima = decode_ima(np.frombuffer(b"".join(whole), dtype=np.uint8).reshape(-1, BLOCK)) if whole else None
    out, at = [], 0
    for codec, payload in parsed:
        if codec == "ima":
            n = len(payload) // BLOCK
            out.append((codec, payload, ima[at : at + n].reshape(-1)))
            at += n
        else:
            out.append((codec, payload, TABLES[codec][np.frombuffer(payload, dtype=np.uint8)]))
    return out


def features(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, mean square, peak, sign changes and checksum of 16 kHz PCM."""
    if not len(pcm):
        return f"{codec};0;0;0;0;0"
    wide = pcm.astype(np.int64)
    flips = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};{len(pcm)};{int((wide * wide).sum()) // len(pcm)};{int(np.abs(wide).max())};{flips};{zlib.crc32(pcm.tobytes())}"


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > BATCH_BYTES:
            yield begin, i
            begin, total = i, 0
        total += size
    if sizes:
        yield begin, len(sizes)


def store_payload(df: DataFrame, key: str, text: str, codec: str | None = None) -> DataFrame:
    """key, n_bytes and media: each text as a WAV file. Without a codec, the payload's checksum picks one of three."""

    bounded_batches(df)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = [0 if n is None else n for n in pc.binary_length(texts).to_pylist()]
            for a, b in _slices(sizes):
                rows = [padded(t) for t in texts[a:b].to_pylist()]
                files = [wav(p, codec or CODECS[zlib.crc32(p) % len(CODECS)]) for _, p in rows]
                yield pa.RecordBatch.from_arrays([keys[a:b], pa.array([n for n, _ in rows], pa.int64()), pa.array(files, pa.binary())], names=[key, "n_bytes", "media"])

    rows = df.select(key, text)
    return rows.mapInArrow(store, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_bytes bigint, media binary")


def decode_media(df: DataFrame, keep: list[str], media: str = "media", with_pcm: bool = True) -> DataFrame:
    """The kept columns, then codec, payload digests, features and (unless left out) 16 kHz PCM, little-endian."""

    bounded_batches(df)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(len(keep))
            sizes = [0 if n is None else n for n in pc.binary_length(files).to_pylist()]
            for a, b in _slices(sizes):
                some = files[a:b].to_pylist()
                done = iter(decode_batch([m for m in some if m is not None]))
                rows = []
                for m in some:
                    if m is None:
                        rows.append((None,) * 6)
                        continue
                    codec, payload, low = next(done)
                    pcm = resampled(low)
                    rows.append((codec, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), features(codec, pcm), pcm.tobytes() if with_pcm else None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 6 if with_pcm else 5]
                names = ["codec", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "pcm"][: len(arrays)]
                yield pa.RecordBatch.from_arrays([batch.column(i)[a:b] for i in range(len(keep) + 1)] + arrays, names=[*keep, "media", *names])

    rows = df.select(*keep, F.col(media).alias("media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    more = "codec string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"
    return rows.mapInArrow(decode, f"{schema}, {more}" + ", pcm binary" * with_pcm)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_payload(table(spark, sf_dir, "documents"), "doc_id", "text")
    read = decode_media(stored, ["doc_id", "n_bytes"])
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
    )
