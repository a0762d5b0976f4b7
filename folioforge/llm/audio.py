"""Audio features of media columns: lossless 8-bit media, resampling, log-mel frames, active spans.

A payload is kept as an 8-bit PCM WAV file and read back from it. Its samples go through
a polyphase resampler (12 to 8 kHz), overlapped log-mel frames and an energy
segmentation with hysteresis. The frames are stored as fixed-shape Arrow tensors, each
with its time span, in Arrow IPC streams of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import enter_worker

UNIT, PAD = 576, 255
RATE, UP, DOWN = 12_000, 2, 3
OUT_RATE = RATE * UP // DOWN
TAPS, WINDOW, HOP, MELS = 25, 256, 128, 24
FRAMES = 64
#: Output samples of one resampling block, frames of one transform, tensors of one stream.
BLOCK, AT_ONCE, TENSORS = 64, 4096, 256
ON_DB, OFF_DB = 1.0, -1.0
STEP = 1 / 256
TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))


def payload_of(data: bytes) -> bytes:
    """``data`` and then bytes 255 up to a positive multiple of 576."""
    return data + bytes([PAD]) * (UNIT - len(data) if not data else -len(data) % UNIT)


def encode_media(payload: bytes) -> bytes:
    """A mono WAV file with one unsigned 8-bit sample for each byte."""
    odd = len(payload) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * odd


def decode_media(media: bytes) -> bytes:
    """The samples of a WAV file made by encode_media; other layouts raise ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, bits = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            if not bits:
                raise ValueError("data before format")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@cache
def _filter() -> tuple[np.ndarray, int]:
    """A block's polyphase filter as a band matrix: inputs of a block by its BLOCK outputs."""
    half = TAPS // 2
    k = np.arange(-half * UP, half * UP + 1)
    cut = min(1 / UP, 1 / DOWN)
    h = np.sinc(k * cut) * cut * UP * np.hamming(len(k))
    inputs = BLOCK * DOWN // UP
    band = np.zeros((inputs + 2 * half, BLOCK))
    for m in range(BLOCK):
        for i in range(len(band)):
            lag = m * DOWN - (i - half) * UP  # in steps of the rate both share
            if abs(lag) <= half * UP:
                band[i, m] = h[lag + half * UP]
    return band, half


def resample(samples: np.ndarray) -> np.ndarray:
    """``samples`` at UP / DOWN of their rate, edges padded with zero."""
    band, half = _filter()
    step = BLOCK * DOWN // UP
    blocks = -(-len(samples) // step)
    padded = np.zeros(blocks * step + 2 * half)
    padded[half : half + len(samples)] = samples
    rows = np.lib.stride_tricks.as_strided(padded, (blocks, len(band)), (padded.strides[0] * step, padded.strides[0]))
    return (rows @ band).ravel()[: -(-len(samples) * UP // DOWN)]


@cache
def _mel_bank() -> tuple[np.ndarray, np.ndarray]:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / OUT_RATE)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    bank = np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))
    return bank, np.hanning(WINDOW + 1)[:-1]


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(frames, MELS): natural logs of mel energies of frames that overlap by half.

    Worked out in double precision and rounded to STEP, so that the last bits in which
    machines differ don't show."""
    bank, window = _mel_bank()
    n = max(1, 1 + (len(samples) - WINDOW) // HOP)
    if len(samples) < WINDOW:
        samples = np.pad(samples, (0, WINDOW - len(samples)))
    frames = np.lib.stride_tricks.as_strided(samples, (n, WINDOW), (samples.strides[0] * HOP, samples.strides[0]))
    out = np.empty((n, MELS), np.float32)
    for at in range(0, n, AT_ONCE):
        spectrum = np.fft.rfft(frames[at : at + AT_ONCE] * window, axis=1)
        out[at : at + AT_ONCE] = np.rint(np.log((spectrum.real**2 + spectrum.imag**2) @ bank + 1e-6) / STEP) * STEP
    return out


def active_spans(mel: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds that begin ON_DB over the median energy and end OFF_DB below it."""
    level = mel.astype(np.float64).mean(axis=1) * (10 / np.log(10))
    level -= np.median(level)
    mark = np.where(level >= ON_DB, 1, np.where(level <= OFF_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.r_[False, np.where(last >= 0, mark[last], -1) > 0, False].astype(np.int8)
    edge = np.diff(on)
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    return [(s * HOP / OUT_RATE, ((e - 1) * HOP + WINDOW) / OUT_RATE) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def tensors_of(mel: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Fixed-shape tensors of FRAMES frames (the last filled up with zeros) and their spans."""
    for at in range(0, len(mel), FRAMES * TENSORS):
        part = mel[at : at + FRAMES * TENSORS]
        n = -(-len(part) // FRAMES)
        full = np.zeros((n * FRAMES, MELS), np.float32)
        full[: len(part)] = part
        first = at + FRAMES * np.arange(n)
        last = np.minimum(first + FRAMES, len(mel)) - 1
        tensor = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), FRAMES * MELS))
        yield pa.RecordBatch.from_arrays([pa.array(first * HOP / OUT_RATE), pa.array((last * HOP + WINDOW) / OUT_RATE), pa.array(last - first + 1), tensor], ["start_s", "end_s", "frames", "tensor"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(stored).read_next_batch()


_DIGESTS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_tensors", pa.int64()), ("tensor_bytes", pa.int64()), ("span_starts", pa.list_(pa.float64())), ("span_ends", pa.list_(pa.float64()))]
_STORED = [("media", pa.binary()), ("tensors", pa.list_(pa.binary()))]


def _features(data: bytes, store: bool) -> tuple:
    media = encode_media(payload_of(data))
    back = decode_media(media)
    mel = log_mel(resample((np.frombuffer(back, np.uint8).astype(np.float64) - 128) / 128))
    spans = active_spans(mel)
    crc, kept, total = 0, [to_ipc(batch) for batch in tensors_of(mel)], 0
    for stored in kept:  # the digest is of what is stored, read back
        batch = read_tensors(stored)
        values = batch.column(3).storage.flatten().to_numpy(zero_copy_only=False)
        crc = zlib.crc32(np.rint(values / STEP).astype("<i2").tobytes(), crc)
        total += batch.num_rows
    active = sum(e - s for s, e in spans)
    feature = f"frames={len(mel)};mels={MELS};spans={len(spans)};active={active:.3f};mel={crc:08x}"
    digests = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, total, sum(map(len, kept)))
    return digests + ([s for s, _ in spans], [e for _, e in spans]) + ((media, kept) if store else ())


def audio_features(df: DataFrame, id_col: str = "doc_id", data_col: str = "text", store: bool = True) -> DataFrame:
    """For each row: lossless media, log-mel tensors with spans, active spans, and digests of them.

    Text is taken as UTF-8, null as empty. A row depends on its own bytes alone, so
    equal data has equal values, and no row meets another; repeated rows stay, and an empty
    table gives an empty table. A text takes some 60 bytes of a worker's memory for each of its
    own, in one piece. Media and tensors are always made and read back for the digests;
    ``store=False`` doesn't return them. Only ``id_col`` and the made columns are returned, so
    no name can clash.
    """
    made = _DIGESTS + _STORED * store
    kind = df.schema[id_col].dataType.simpleString()
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.float64()): "array<double>"}
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} {names[t]}" for n, t in made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_worker("audio")
        for batch in batches:
            data = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                rows = [_features(x.as_py() or b"", store) for x in data.slice(at, 256)]
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), made, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), *columns], [id_col, *(n for n, _ in made)])

    return df.select(id_col, data_col).mapInArrow(run, schema)


def op1_audio_features(spark, sf_dir: str) -> DataFrame:
    """All documents with the digests of their stored media and tensors, and their active spans."""
    return audio_features(spark.read.parquet(f"{sf_dir}/documents.parquet"), store=False)
