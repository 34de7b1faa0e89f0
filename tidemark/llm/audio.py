"""Audio columns: texts kept losslessly as 8-bit sound, and features read from the sound.

:func:`store` turns each text into a WAV file (:data:`RATE` Hz, mono, unsigned 8-bit samples,
the text's UTF-8 bytes filled up with spaces). :func:`features` reads such files:

* polyphase resampling by ``UP / DOWN`` with a windowed-sinc filter, only the phases that
  yield an output sample are computed;
* log-mel filterbanks of overlapping Hann windows;
* segments of high energy with hysteresis: a segment opens at a frame of the upper
  threshold or more and closes before the first frame below the lower one.

The features are a column of Arrow IPC streams: rows of a fixed-shape tensor of
``TENSOR_FRAMES`` frames by ``BANDS`` bands (the last one filled up with the floor), with the
frames that hold sound and the time span of each; :func:`read_tensors` opens one,
:func:`tensor_rows` gives the same as rows of a DataFrame. Sound is worked on in blocks of
``BLOCK_FRAMES`` frames, so memory beyond the row itself does not grow with its length.

A null text is empty: a file of spaces. A null or unreadable file has null features. Each
row is worked on by itself, so equal texts give equal bytes and features; repeated rows are
repeated. An empty table gives an empty result. Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textarrays import portions

#: Samples a second in the file; the file's data are a multiple of UNIT bytes, which is a whole number of output samples.
RATE, UNIT = 24_000, 192
UP, DOWN = 2, 3
#: Filter taps on each side, in input samples.
REACH = 12
WINDOW, HOP, FFT, BANDS = 400, 160, 512, 40
TENSOR_FRAMES, BLOCK_FRAMES = 100, 2_000
FLOOR = 1e-6
#: A segment opens so many decibels above the row's mean energy, and closes so many below it.
OPENS, CLOSES = 0.5, 0.5
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def padded(text: bytes) -> bytes:
    """Filled up with spaces to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT))


def to_wav(samples: bytes) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples."""
    n = len(samples)
    return HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def from_wav(file: bytes) -> bytes:
    """The samples of a mono 8-bit RIFF file, whatever other chunks it has; ValueError for anything else."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while at + 8 <= len(file):
        name, size = struct.unpack_from("<4sI", file, at)
        if name == b"fmt " and at + 24 <= len(file):
            kind = struct.unpack_from("<HHIIHH", file, at + 8)
        elif name == b"data":
            if kind is None or kind[0] != 1 or kind[1] != 1 or kind[2] != RATE or kind[5] != 8:
                raise ValueError("not 8-bit mono PCM at the expected rate")
            if at + 8 + size > len(file):
                raise ValueError("the file ends early")
            return file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


@functools.cache
def phases() -> list[tuple[int, np.ndarray]]:
    """For each of UP output phases: the first input sample (from the block's start) and its taps, in order of input."""
    half = REACH * UP
    at = np.arange(-half, half + 1)
    cut = 1.0 / max(UP, DOWN)
    taps = UP * cut * np.sinc(at * cut) * (0.5 + 0.5 * np.cos(np.pi * at / (half + 1)))
    out = []
    for phase in range(UP):
        place = phase * DOWN  # on the grid of UP points for each input sample
        first = -(-(place - half) // UP)
        inputs = np.arange(first, (place + half) // UP + 1)
        out.append((first, taps[place - inputs * UP + half]))
    return out


def resample(samples: np.ndarray) -> np.ndarray:
    """UP outputs for every DOWN inputs; ``samples`` has REACH further ones on both sides of a multiple of DOWN."""
    n = (len(samples) - 2 * REACH) // DOWN
    out = np.empty((n, UP), np.float32)
    for phase, (first, taps) in enumerate(phases()):
        windows = np.lib.stride_tricks.sliding_window_view(samples[REACH + first :], len(taps))[::DOWN][:n]
        out[:, phase] = windows @ taps.astype(np.float32)
    return out.reshape(-1)


@functools.cache
def filterbank() -> np.ndarray:
    """Triangles, FFT // 2 + 1 by BANDS, evenly spaced on the mel scale up to half the new rate."""
    rate = RATE * UP / DOWN
    mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, mel(rate / 2), BANDS + 2) / 2595.0) - 1.0)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall)).astype(np.float32)


@functools.cache
def hann() -> np.ndarray:
    return (0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(WINDOW) / WINDOW)).astype(np.float32)


def n_frames(n: int) -> int:
    """Windows for ``n`` samples of the new rate: each sample lies in one at least, the last is filled up with silence."""
    return 1 + max(0, -(-(n - WINDOW) // HOP))


def frame_blocks(payload: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(log-mel frames, energies in decibels), BLOCK_FRAMES frames at a time."""
    raw = np.frombuffer(payload, np.uint8)
    total = len(raw) * UP // DOWN
    frames = n_frames(total)
    for lo in range(0, frames, BLOCK_FRAMES):
        hi = min(lo + BLOCK_FRAMES, frames)
        # New samples [begin, end) and the old ones around them; silence beyond both ends.
        begin, end = lo * HOP, (hi - 1) * HOP + WINDOW
        first, last = begin * DOWN // UP - REACH, -(-end // UP) * DOWN + REACH
        some = np.zeros(last - first, np.float32)
        held = raw[max(first, 0) : max(min(last, len(raw)), 0)]
        some[max(-first, 0) : max(-first, 0) + len(held)] = (held.astype(np.float32) - 128.0) / 128.0
        sound = resample(some)[: end - begin]
        sound[max(total - begin, 0) :] = 0.0
        windows = np.lib.stride_tricks.sliding_window_view(sound, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(windows * hann(), FFT, axis=1)) ** 2 / FFT
        energy = 10.0 * np.log10(np.einsum("ij,ij->i", windows, windows, dtype=np.float64) / WINDOW + FLOOR)
        yield np.log(power.astype(np.float32) @ filterbank() + np.float32(FLOOR)), energy


def segments(energy: np.ndarray) -> np.ndarray:
    """Rows (first frame, frame behind the last) of the stretches that open and close with hysteresis."""
    level = energy.mean()
    says = np.where(energy >= level + OPENS, 1, np.where(energy < level - CLOSES, 0, -1))
    decided = np.maximum.accumulate(np.where(says >= 0, np.arange(len(says)), -1))
    on = np.where(decided >= 0, says[decided], 0)
    edges = np.diff(np.r_[0, on, 0])
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def spans_ms(frames: np.ndarray) -> np.ndarray:
    """Milliseconds in which frames [first, behind) lie."""
    rate = RATE * UP // DOWN
    return np.stack([frames[:, 0] * HOP * 1000 // rate, ((frames[:, 1] - 1) * HOP + WINDOW) * 1000 // rate], axis=1)


TENSOR = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, BANDS], dim_names=["frame", "band"])
TENSORS = pa.schema([("logmel", TENSOR), ("n_frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])


def _packed(payload: bytes) -> tuple[bytes, np.ndarray, int, float]:
    """The Arrow stream of a payload's tensors, its segments in milliseconds, the number of frames, the mean of all log-mel values."""
    sink, energies, total, number = pa.BufferOutputStream(), [], 0.0, 0
    with pa.ipc.new_stream(sink, TENSORS) as writer:
        for mel, energy in frame_blocks(payload):
            at = np.arange(0, len(mel), TENSOR_FRAMES)
            sizes = np.minimum(TENSOR_FRAMES, len(mel) - at)
            full = np.full((len(at) * TENSOR_FRAMES, BANDS), np.log(np.float32(FLOOR)), np.float32)
            full[: len(mel)] = mel
            span = spans_ms(np.stack([number + at, number + at + sizes], axis=1))
            storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TENSOR_FRAMES * BANDS)
            tensor = pa.ExtensionArray.from_storage(TENSOR, storage)
            writer.write_batch(pa.RecordBatch.from_arrays([tensor, pa.array(sizes, pa.int32()), pa.array(span[:, 0]), pa.array(span[:, 1])], schema=TENSORS))
            energies.append(energy)
            total += float(mel.sum(dtype=np.float64))
            number += len(mel)
    return sink.getvalue().to_pybytes(), spans_ms(segments(np.concatenate(energies))), number, total / (number * BANDS)


def read_tensors(stream: bytes) -> pa.Table:
    """logmel (fixed-shape tensors), n_frames, start_ms, end_ms."""
    return pa.ipc.open_stream(stream).read_all()


def _store(batches):
    for batch in portions(batches):
        text = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        media = pa.array((to_wav(padded(t.as_py())) for t in text), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes of the text, media: a WAV file of its bytes)."""
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_SPANS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
#: Columns that :func:`features` adds, with their types in Arrow and in Spark.
FEATURES = {
    "payload": (pa.binary(), "binary"), "n_frames": (pa.int64(), "long"), "logmel_mean": (pa.float64(), "double"),
    "segments": (_SPANS, "array<struct<start_ms: long, end_ms: long>>"), "tensors": (pa.binary(), "binary"),
}
#: Bytes of sound whose features travel together: they are some three times as large.
PORTION = 1 << 20


def _row(file: bytes | None) -> tuple:
    try:
        payload = from_wav(file or b"")
        stream, spans, number, mean = _packed(payload)
    except ValueError:
        return (None,) * len(FEATURES)
    return payload, number, mean, [{"start_ms": int(a), "end_ms": int(b)} for a, b in spans], stream


def _features(batches):
    for batch in portions(batches, "media", PORTION):
        columns = zip(*map(_row, batch.column("media").to_pylist()), strict=True)
        made = [pa.array(c, kind) for c, (kind, _) in zip(columns, FEATURES.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *FEATURES])


def features(media: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, media): payload as read back, n_frames, logmel_mean, segments, tensors."""
    media = media.select("doc_id", "n_bytes", "media")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in media.schema] + [f"{name} {kind}" for name, (_, kind) in FEATURES.items()]
    return media.mapInArrow(_features, ", ".join(kinds))


def _unpacked(batches):
    for batch in portions(batches, "tensors", PORTION):
        for i, stream in enumerate(batch.column("tensors")):
            if not stream.is_valid:
                continue
            table = read_tensors(stream.as_py())
            mel = pa.concat_arrays([c.storage for c in table["logmel"].chunks]).cast(pa.list_(pa.float32()))
            n = table.num_rows
            ids = pa.concat_arrays([batch.column("doc_id").slice(i, 1)] * n)
            rest = [table[c].combine_chunks() for c in ("n_frames", "start_ms", "end_ms")]
            yield pa.RecordBatch.from_arrays([ids, pa.array(range(n), pa.int32()), mel, *rest], names=["doc_id", "place", "logmel", "n_frames", "start_ms", "end_ms"])


def tensor_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, place, logmel, n_frames, start_ms, end_ms): one row per tensor, its values frame by frame."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "tensors").mapInArrow(_unpacked, f"doc_id {kind}, place int, logmel array<float>, n_frames int, start_ms long, end_ms long")
