"""Media columns: bytes as WAV sound, read back and fingerprinted.

A payload becomes the 8-bit samples of a mono WAV file in a binary column.
Reading goes through the wave module: short-time Fourier transforms give the
loudest frequencies over time, and pairs of such peaks (two frequencies and
the time between them, of one band or of two) with the time of the first are the
fingerprint. Where nothing sounds there is no peak. A payload that fits one
frame is transformed in short frames instead, whose peaks also stand with their
loudness, as a few letters differ in little else.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import map_text, table

UNIT = 64
RATE = 8_000
WINDOW, HOP = 512, 256
#: The loudest bin of each band of frequencies in a frame is a peak, if it is this loud.
LEAST = 1.0
BANDS = ((4, 64), (64, 257))
#: The same for payloads of at most WINDOW bytes.
SHORT_WINDOW, SHORT_HOP = 16, 8
SHORT_BANDS = ((1, 4), (4, 9))
#: Loudness is counted in such parts; it stays below 16 bits.
LOUDNESS = 1 / 8
#: A peak is paired with the peaks of higher bands in its frame, and with all of so many frames after it.
AHEAD = 2
#: Frames transformed at a time.
FRAMES = 4_096

MEDIA = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("media", BinaryType())])
READ = StructType([
    StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()),
    StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()),
    StructField("times", ArrayType(IntegerType())), StructField("codes", ArrayType(IntegerType())),
])


def payload_of(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of UNIT."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("not a mono file of 8-bit samples")
        return file.readframes(file.getnframes())


_shape = np.hanning(WINDOW)


def peaks_of(samples: bytes) -> np.ndarray:
    """The loudest bin for each frame (row) and band (column), the lowest of equals; -1 where nothing sounds.

    A frame's mean is taken off first, so that a constant level is silence.
    """
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    padded = np.full(WINDOW + (n - 1) * HOP, 128, np.uint8)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    found = np.empty((n, len(BANDS)), np.int32)
    for i in range(0, n, FRAMES):
        part = frames[i : i + FRAMES].astype(np.float64)
        # rounded, so that noise in the last bits of a transform can't turn a tie
        power = np.round(np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _shape)), 3)
        found[i : i + FRAMES] = _loudest(power, BANDS)
    return found


def _loudest(power: np.ndarray, bands: tuple) -> np.ndarray:
    found = np.stack([low + power[:, low:high].argmax(axis=1) for low, high in bands], axis=1)
    return np.where(np.take_along_axis(power, found, axis=1) >= LEAST, found, -1).astype(np.int32)


_short_shape = np.hanning(SHORT_WINDOW + 2)[1:-1]


def short_peaks_of(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The loudest bin for each short frame and band, and how loud it is; frames begin before the first sample."""
    x = np.frombuffer(samples, np.uint8)
    before = SHORT_WINDOW - SHORT_HOP
    n = -(-(before + len(x)) // SHORT_HOP)
    padded = np.full(SHORT_WINDOW + (n - 1) * SHORT_HOP, 128, np.uint8)
    padded[before : before + len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, SHORT_WINDOW)[::SHORT_HOP]
    power = np.round(np.abs(np.fft.rfft((frames.astype(np.float64) - 128) * _short_shape)), 3)
    found = _loudest(power, SHORT_BANDS)
    loud = np.round(np.take_along_axis(power, np.maximum(found, 0), axis=1) / LOUDNESS).astype(np.int32)
    return found, loud


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): for each pair of peaks the first one's frame, and both bins with the frames between.

    Bands don't overlap, so the bins tell of which band each peak is.

    For at most WINDOW samples, those of short frames, and for each peak its
    bin with its loudness and no frames between. Zeros alone, the payload of an
    empty text, have neither.
    """
    times, codes = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    if len(samples) > WINDOW:
        peaks = peaks_of(samples)
    elif any(samples):
        peaks, loud = short_peaks_of(samples)
        for b in range(len(SHORT_BANDS)):
            at = np.flatnonzero(peaks[:, b] >= 0).astype(np.int32)
            times.append(at)
            codes.append((peaks[at, b] << 20) | (loud[at, b] << 4))
    else:
        return times[0], codes[0]
    n = len(peaks)
    for ahead in range(min(AHEAD, n - 1) + 1):
        for one, other in product(range(peaks.shape[1]), repeat=2):
            if not ahead and one >= other:
                continue
            at = np.flatnonzero((peaks[: n - ahead, one] >= 0) & (peaks[ahead:, other] >= 0)).astype(np.int32)
            times.append(at)
            codes.append((peaks[at, one] << 14) | (peaks[at + ahead, other] << 4) | ahead)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def _store(ids: list, texts: list) -> dict[str, list]:
    data = [(t or "").encode() for t in texts]
    return {"doc_id": ids, "n_bytes": [len(x) for x in data], "media": [to_wav(payload_of(x)) for x in data]}


def _read(ids: list, n_bytes: list, media: list) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in READ.names}
    out["doc_id"], out["n_bytes"] = ids, n_bytes
    for file in media:
        try:
            payload = from_wav(file)
        except (TypeError, ValueError, EOFError, wave.Error):
            # nothing is known of what isn't such a file
            for column in out.values():
                if column is not ids and column is not n_bytes:
                    column.append(None)
            continue
        times, codes = fingerprint(payload)
        out["payload_bytes"].append(len(payload))
        out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
        out["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
        out["media_bytes"].append(len(file))
        out["media_sha256"].append(hashlib.sha256(file).hexdigest())
        out["times"].append(times)
        out["codes"].append(codes)
    return out


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media (a WAV file of its padded bytes).

    A null text counts as empty: one unit of zeros. A null doc_id stays null,
    repeated rows repeat, other columns of docs are ignored, no rows, none.
    Bytes that aren't UTF-8 are read as U+FFFD.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_text(docs, _store, ["doc_id", "text"], MEDIA)


def read_media(files: DataFrame) -> DataFrame:
    """Sizes and digests of each file (doc_id, n_bytes, media) and its fingerprint (times, codes).

    Files are mono WAV of 8-bit samples; of a null or any other file all of
    that is null. A file of one level throughout has an empty fingerprint.
    Repeated rows repeat, a null doc_id stays null, other columns are ignored;
    no rows, none.
    """
    return map_text(files, _read, MEDIA.names, READ, text="media")


def op7_wav_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_media(table(spark, sf_dir, "documents")))
    # the fingerprint itself, so that two texts' can be compared
    feature = F.concat_ws(";", F.array_join("times", ","), F.array_join("codes", ","))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
