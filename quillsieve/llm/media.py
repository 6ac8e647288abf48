"""Media columns: payloads kept as 8-bit WAV, with spectral-peak pair fingerprints.

``store_wav`` encodes each payload as a mono 8-bit WAV file in a binary column;
``read_wav`` opens the stored bytes with the wave module, computes short-time
Fourier transforms and pairs spectral peaks into a time-coded fingerprint.

Defined results: a null text is an empty text; an empty text is 64 zero bytes;
one row out for each row in, whatever its id (null and repeated ids included);
equal payloads get equal stored bytes and fingerprints.  Whole frames of one
value have no peaks, so their fingerprint is an empty array.  Texts of any
length are transformed in blocks of frames, so memory is bounded by the payload
itself.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, pick

UNIT = 64  #: payloads are padded to a positive multiple of so many bytes
RATE = 8000  #: samples a second in the stored header
FRAME = 512  #: samples in a frame
HOP = 256  #: samples between frames
BANDS = (1, 12, 32, 80, 257)  #: first bins of the bands, each of which yields a peak at most in a frame
FAN = 3  #: later peaks with which a peak is paired
REACH = 63  #: frames between paired peaks at most
BLOCK = 2048  #: frames transformed at once

_WINDOW = np.hanning(FRAME).astype(np.float32)
_LOUD = np.float32(1.0)  # a peak's least magnitude, in sample units


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def encode_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_maxima(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band, the loudest bin and its magnitude."""
    raw = np.frombuffer(samples, np.uint8)
    frames = 1 + max(0, -(-(len(raw) - FRAME) // HOP))
    x = np.full((frames - 1) * HOP + FRAME, 128, np.uint8)
    x[: len(raw)] = raw
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins = np.empty((frames, len(BANDS) - 1), np.int64)
    loud = np.empty((frames, len(BANDS) - 1), np.float32)
    for a in range(0, frames, BLOCK):
        block = view[a : a + BLOCK].astype(np.float32)
        block -= block.mean(axis=1, keepdims=True)
        block *= _WINDOW
        spec = np.fft.rfft(block, axis=1)
        power = spec.real**2 + spec.imag**2
        for k, (lo, hi) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            at = power[:, lo:hi].argmax(axis=1)
            bins[a : a + BLOCK, k] = at + lo
            loud[a : a + BLOCK, k] = power[np.arange(len(at)), at + lo]
    return bins, np.sqrt(loud)


def fingerprint(samples: bytes) -> tuple[int, int, np.ndarray]:
    """Frames, peaks and the time-coded pairs: frame << 22 | bin << 14 | bin << 6 | distance.

    A band's loudest bin is a peak where no neighbouring frame is louder in that
    band; each peak is paired with the next few in order of time and frequency.
    """
    bins, loud = band_maxima(samples)
    before, after = np.zeros_like(loud), np.zeros_like(loud)
    before[1:], after[:-1] = loud[:-1], loud[1:]
    t, k = np.nonzero((loud > before) & (loud >= after) & (loud > _LOUD))
    f = np.minimum(bins[t, k], 255)
    pairs = []
    for step in range(1, FAN + 1):
        gap = t[step:] - t[:-step]
        near = gap <= REACH
        pairs.append(((t[:-step] << 22) | (f[:-step] << 14) | (f[step:] << 6) | gap)[near])
    return len(bins), len(t), np.sort(np.concatenate(pairs).astype(np.int64))


def store_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as a WAV file of its padded UTF-8 bytes."""
    bound_arrow(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text").cast(pa.large_binary())]
            media = [encode_wav(padded(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return rows.mapInArrow(encode, f"id {kind.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_wav(media: DataFrame, id_col: str = "doc_id", keep_pairs: bool = True) -> DataFrame:
    """Features of stored WAV files, all of them derived from the bytes read back.

    ``keep_pairs`` False leaves the fingerprint array out; its digest stays.
    """
    bound_arrow(media.sparkSession)
    rows = pick(media, id=id_col, n_bytes="n_bytes", media="media")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_peaks long, n_pairs long, feature string" + ", pairs array<long>" * keep_pairs
    names = [x.split()[0] for x in schema.split(", ")]

    def features(media: bytes) -> tuple:
        payload = decode_wav(media)
        frames, peaks, pairs = fingerprint(payload)
        digest = hashlib.blake2b(pairs.astype("<i8").tobytes(), digest_size=16).hexdigest()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), frames, peaks, len(pairs), f"{frames}:{peaks}:{len(pairs)}:{digest}", pairs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*[features(x.as_buffer().to_pybytes()) for x in b.column("media")], strict=True)) or [()] * 10
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            made = [pa.array(list(x), k) for x, k in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *made][: len(names)], names)

    return rows.mapInArrow(read, schema).withColumnRenamed("id", id_col)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a WAV file, read it back and return digests and features."""
    return read_wav(store_wav(docs, id_col, text_col), id_col, keep_pairs=False)


def fingerprint_matches(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Long form of the fingerprints: (id, code, frame), for equality joins on the code."""
    code = F.explode("pairs").alias("p")
    return read_wav(media, id_col).select(id_col, code).select(id_col, (F.col("p").bitwiseAND(F.lit((1 << 22) - 1))).alias("code"), F.shiftright("p", 22).alias("frame"))
