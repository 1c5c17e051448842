"""Audio columns: lossless 8-bit WAV media and fixed-shape features with time spans.

A payload of bytes is stored as unsigned 8-bit PCM samples in a WAV container, one sample a byte, and
everything after that starts from the stored bytes:

- polyphase resampling from 16 kHz to 10 kHz (up 5, down 8): each of the five phases of a windowed-sinc
  filter is one strided matrix product;
- overlapped Hann frames, power spectra, a bank of triangular mel filters, logarithms;
- the frames pooled to a tensor of fixed shape (``SLOTS`` time slots by ``BANDS`` bands), stored as an
  Arrow tensor (Spark has no tensor type: the column holds Arrow's tensor messages, and ``tensor_column``
  makes a collected one a fixed-shape tensor column), each slot with its time span;
- segments by hysteresis on frame energy: one begins above the upper level and lasts until the energy
  falls below the lower.

A text is handled in a projection without shuffle, frames of long audio in bounded runs. Nulls are
empty payloads, one block of padding; a null doc_id stays null. Equal payloads give equal values; repeated
rows stay, each with its own. A very long text is one media value, whole. An empty table gives an empty
result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.llm._words import texts, bounded

PAD = 64
RATE, UP, DOWN, TAPS = 16_000, 5, 8, 16
FRAME, HOP, BANDS, SLOTS = 256, 128, 16, 8
#: Hysteresis: levels above the quietest tenth of frames, as shares of the range to the loudest.
ENTER, LEAVE = 0.6, 0.4
_RUN = 1 << 12


def encode(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """Phases of a Hann-windowed sinc low-pass at the lower of the two Nyquist rates: (up, taps)."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    phases = h.reshape(taps, up).T
    return (phases / phases.sum(1, keepdims=True)).astype(np.float32)


_PHASES = _filter(UP, DOWN, TAPS)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, phases: np.ndarray = _PHASES) -> np.ndarray:
    """ceil(len(x) * up / down) samples: sample n is phase (n * down) % up at x[n * down // up]."""
    taps = phases.shape[1]
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(down, np.float32)])
    out = np.empty(n, np.float32)
    for i in range(min(up, n)):
        at, phase = divmod(i * down, up)
        rows = -(-(n - i) // up)
        view = np.lib.stride_tricks.as_strided(padded[at:], (rows, taps), (4 * down, 4), writeable=False)
        out[i::up] = view @ phases[phase, ::-1]
    return out


def _mel_bank(rate: float, size: int, bands: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


_BANK = _mel_bank(RATE * UP / DOWN, FRAME, BANDS)
_HANN = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) log-mel and frame energies; the end is padded to a whole frame."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), np.float32)])
    view = np.lib.stride_tricks.as_strided(x, (n, FRAME), (4 * HOP, 4), writeable=False)
    mel, energy = np.empty((n, BANDS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, _RUN):
        spectrum = np.fft.rfft(view[i : i + _RUN] * _HANN)
        power = spectrum.real**2 + spectrum.imag**2
        mel[i : i + _RUN] = np.log(power @ _BANK + 1e-6)
        energy[i : i + _RUN] = np.log(power.sum(1) + 1e-6)
    return mel, energy


def hysteresis(energy: np.ndarray) -> np.ndarray:
    """(first frame, end frame) of the segments."""
    low, high = np.percentile(energy, 10), energy.max()
    state = np.where(energy >= low + ENTER * (high - low), 1, np.where(energy < low + LEAVE * (high - low), -1, 0))
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate([[False], (last >= 0) & (state[last] > 0), [False]])
    return np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)


def pooled(mel: np.ndarray) -> np.ndarray:
    """(SLOTS, BANDS): means of equal stretches of frames; short audio repeats its frames."""
    cut = np.linspace(0, len(mel), SLOTS + 1)
    return np.stack([mel[int(a) : max(int(np.ceil(b)), int(a) + 1)].mean(0) for a, b in zip(cut[:-1], cut[1:])])


def features(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Of stored media: payload, tensor, time spans of its slots, segments; times in seconds."""
    payload = decode(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x))
    step = HOP * DOWN / (UP * RATE)
    spans = [(round(a * step, 4), round(b * step, 4)) for a, b in zip(*(np.linspace(0, len(mel), SLOTS + 1)[i:][:SLOTS].tolist() for i in (0, 1)))]
    return payload, pooled(mel), spans, [(round(a * step, 4), round(b * step, 4)) for a, b in hysteresis(energy).tolist()]


def as_message(x: np.ndarray) -> bytes:
    """An Arrow tensor message: shape, type and values, read by any Arrow library."""
    out = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(x, np.float32)), out)
    return out.getvalue().to_pybytes()


def tensor_column(table: pa.Table, column: str = "tensor") -> pa.Table:
    """A collected or reread table with its tensors as one Arrow fixed-shape tensor column."""
    rows = [pa.ipc.read_tensor(pa.BufferReader(m)).to_numpy() for m in table[column].to_pylist()]
    stacked = np.ascontiguousarray(np.stack(rows) if rows else np.zeros((0, SLOTS, BANDS)), np.float32)
    return table.set_column(table.schema.get_field_index(column), column, pa.FixedShapeTensorArray.from_numpy_ndarray(stacked))


_SPAN = "array<struct<start: double, end: double>>"
SCHEMA = f"doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, tensor binary, feature string, slots {_SPAN}, segments {_SPAN}"


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), span, span]
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", SCHEMA)]
    as_spans = lambda rows: [{"start": a, "end": b} for a, b in rows]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    for batch in batches:
        rows, held = [], 0
        for key, raw in zip(batch.column(0), texts(batch.column(1))):
            raw = raw.as_py()
            media = encode(raw + bytes(-len(raw) % PAD or (0 if raw else PAD)))
            payload, tensor, slots, segments = features(media)
            feature = " ".join(map(str, np.round(tensor.ravel() * 8).astype(int))) + f";{len(segments)}"
            rows.append((key.as_py(), len(raw), media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), as_message(tensor), feature, as_spans(slots), as_spans(segments)))
            held += len(media)
            if len(rows) == 1024 or held > 8 << 20:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)


def audio_columns(docs: DataFrame) -> DataFrame:
    """The media and features of every text: ``media`` (WAV), digests of the payload read back from it, ``tensor``
    (Arrow tensor message), ``feature`` (the tensor in eighths, and the number of segments), ``slots`` (time
    spans of the tensor's rows) and ``segments``, in seconds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(bounded(_columns), SCHEMA)


def summary(audio: DataFrame) -> DataFrame:
    """``audio_columns`` with the media's length and SHA-256 in its place."""
    return audio.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)}).drop("media")
