"""Audio columns: a lossless store of samples, and features of them as tensors of one fixed shape.

A payload of bytes becomes 8-bit mono samples in a WAV file. Features: polyphase
resampling to the analysis rate, a log-mel filterbank over overlapping frames,
hysteresis segmentation of frame energy, and for each active segment a tensor
of BINS x MELS means with its time span. Every text, of any length, is processed
whole and alone, so equal texts give equal bytes and features whatever stands
beside them. Sums are of 64 bits and rounded to STEP, so that features don't
depend on a machine's kernels. Null and empty texts give the shortest payload.
Very long texts are read whole, spectra in blocks. Repeated rows and ties give
equal rows each; an empty table gives an empty result. Columns other than key
and text are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import beside

#: Samples a second, and the analysis rate by it: UP / DOWN, so resampling has UP phases.
RATE, UP, DOWN = 16_000, 5, 8
TAPS = 25
FRAME, HOP, MELS, BINS = 256, 128, 16, 8
#: Energy in dB over the quietest tenth of frames: a segment begins above the first and ends below the second.
BEGIN_DB, END_DB, LEAST_FRAMES = 2.5, 1.5, 4
#: Frames that are transformed at once; the unit of features.
BLOCK, STEP = 4096, 1 / 256
#: Columns that `store` gives beside the key.
STORED = ("n_bytes", "media", "spans", "tensors")


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(64, -len(raw) % 64 + len(raw)) - len(raw))


def wav_of(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF container; an odd number of samples gets the container's pad byte."""
    size = len(samples)
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", size)
    body = b"WAVE" + head + samples + b"\0" * (size % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(wav: bytes) -> tuple[bytes, int]:
    """The samples and the rate that a container of `wav_of` holds; raises ValueError on any other file."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return wav[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def polyphase_filters(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """One row of taps for each output phase of a windowed-sinc low-pass filter."""
    half = taps // 2
    n = np.arange(taps * up) - half * up
    cut = 1 / max(up, down)
    window = np.where(np.abs(n) <= half * up, 0.54 + 0.46 * np.cos(np.pi * n / (half * up + 1)), 0)
    low = cut * np.sinc(cut * n) * window
    low *= up / low.sum()
    return np.stack([low[phase::up][::-1] for phase in range(up)])


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """ceil(len * up / down) samples at up/down times the rate."""
    filters = polyphase_filters(up, down, taps)
    total = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2), x, np.zeros(taps + down)])
    out = np.empty(total)
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for phase in range(up):  # of the outputs whose place times `down` leaves this phase
        first = next((k for k in range(up) if (k * down) % up == phase), None)
        if first is None:
            continue
        at = np.arange(first, total, up)
        # strided, not gathered: the windows of one phase lie evenly apart
        begin, step = first * down // up, down
        out[at] = windows[begin : begin + step * (len(at) - 1) + 1 : step] @ filters[phase] if len(at) else 0
    return out


def mel_filters(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, frequencies x mels."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, frame // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames x MELS: log power in mel bands of half-overlapping Hann frames; at least one frame."""
    frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    padded = np.concatenate([x, np.zeros(FRAME + HOP)])
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[: (frames - 1) * HOP + 1 : HOP]
    window, bank = np.hanning(FRAME), mel_filters(rate)
    out = np.empty((frames, MELS))
    for k in range(0, frames, BLOCK):
        spectrum = np.fft.rfft(view[k : k + BLOCK] * window)
        power = spectrum.real**2 + spectrum.imag**2
        out[k : k + BLOCK] = np.log(power @ bank + 1e-6)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that rise above the upper and last until they fall below the lower threshold (hysteresis).

    Neighbours that touch are one; segments of fewer than LEAST_FRAMES frames are left out.
    """
    floor = np.partition(energy, len(energy) // 10)[len(energy) // 10]
    state = np.where(energy > floor + BEGIN_DB, 1, np.where(energy < floor + END_DB, 0, -1))
    state[0] = max(state[0], 0)
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), 0))
    on = np.concatenate([[0], state[known], [0]])
    change = np.flatnonzero(np.diff(on))
    return [(int(a), int(b)) for a, b in zip(change[::2], change[1::2], strict=True) if b - a >= LEAST_FRAMES]


def pooled(mel: np.ndarray, a: int, b: int) -> np.ndarray:
    """BINS x MELS means of frames a to b in equal parts (frames repeat where there are fewer than BINS)."""
    edges = a + np.arange(BINS + 1) * (b - a) / BINS
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel[a:b], axis=0, dtype=np.float64)])
    lo = np.minimum(edges[:-1].astype(int), b - 1)
    hi = np.maximum(np.ceil(edges[1:]).astype(int), lo + 1)
    return (np.rint((sums[hi - a] - sums[lo - a]) / (hi - lo)[:, None] / STEP) * STEP).astype(np.float32)


def features(samples: bytes, rate: int) -> tuple[list[tuple[float, float]], np.ndarray]:
    """Time spans in seconds, and one BINS x MELS tensor each: of the whole recording first, then of each segment."""
    x = np.frombuffer(samples, np.uint8) / 128 - 1
    mel = log_mel(resample(x), rate * UP // DOWN)
    energy = 10 / np.log(10) * np.log(np.exp(mel).sum(axis=1))
    found = [(0, len(mel)), *segments(energy)]
    second = HOP / (rate * UP / DOWN)
    return [(a * second, b * second) for a, b in found], np.stack([pooled(mel, a, b) for a, b in found])


def tensor_array(tensors: np.ndarray) -> pa.FixedShapeTensorArray:
    """Tensors as Arrow's fixed-shape tensor type."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))


def tensor_bytes(tensors: np.ndarray) -> bytes:
    """An Arrow stream of one column `tensor` of fixed-shape tensors."""
    out = tensor_array(tensors)
    batch = pa.record_batch([out], names=["tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors_of(stream: bytes) -> np.ndarray:
    """What tensor_bytes has stored."""
    with pa.ipc.open_stream(stream) as reader:
        return np.concatenate([c.to_numpy_ndarray() for c in reader.read_all().column("tensor").chunks])


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, `media` (WAV bytes) and, as arrays of equal length, time spans and an Arrow stream of tensors.

    Columns: key, n_bytes, media, spans array<struct<start_s, end_s>>, tensors binary (see tensors_of); one that the key's name
    is gets an underscore before it.
    """
    n_bytes, media, spans, tensors = beside(key, *STORED)
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField(n_bytes, T.LongType()),
            T.StructField(media, T.BinaryType()),
            T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))),
            T.StructField(tensors, T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.bpe import pieces

        kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary()]
        for batch in batches:
            for piece in pieces(batch, text):
                rows = []
                for x in piece.column(text).to_pylist():
                    wav = wav_of(payload_of(x))
                    times, tensors = features(*samples_of(wav))
                    rows.append((len((x or "").encode()), wav, [{"start_s": a, "end_s": b} for a, b in times], tensor_bytes(tensors)))
                yield pa.RecordBatch.from_arrays([piece.column(key), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=schema.fieldNames())

    return docs.select(key, F.col(text).alias(text)).mapInArrow(run, schema)


def digest(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the stored media back: sizes, sums, and a printable feature (segments, SHA-256 of the tensors and spans)."""
    schema = T.StructType(
        [T.StructField(key, stored.schema[key].dataType)]
        + [T.StructField(*beside(key, n), k) for n, k in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for wav, times, stream in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                wav = wav.as_py()
                payload, _ = samples_of(wav)
                tensors = tensors_of(stream.as_py())
                flat = np.array([[t["start_s"], t["end_s"]] for t in times], "<f8").tobytes() + tensors.astype("<f4").tobytes()
                got = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), f"{len(times) - 1}:{hashlib.sha256(flat).hexdigest()}")
                for column, value in zip(columns, got, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.fieldNames())

    return stored.select(key, *beside(key, *STORED)).mapInArrow(run, schema)
