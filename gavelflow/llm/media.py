"""Media columns: texts as 8-bit audio, and its features as fixed-shape Arrow tensors with time spans.

A payload is the text's UTF-8 bytes with zero bytes up to a positive multiple of 64, stored without
loss as the samples of a mono 8-bit WAV file at RATE and read back from there. Features: polyphase
resampling by UP / DOWN (windowed sinc, one filter for each output phase), frames of FRAME samples
every HOP, their power spectra in MELS overlapping triangular bands on the mel scale, in decibels, and
the frames' energies, cut into segments by two thresholds: a segment is a run above the low one that
reaches the high one. Log-mel frames are laid out in tensors of SHAPE, the last one padded, each with
its span of time. op9's values are computed from the stored file and the stored tensors, read back.

Every clip is computed by itself, and features are rounded, so equal texts have equal values in any
batch. Rows: null counts as empty (one block of zeros). Repeated rows repeat their values. Other
columns are ignored. Memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import worker

BLOCK = 64
RATE = 16_000
UP, DOWN = 5, 8
FRAME, HOP, FFT, MELS = 250, 100, 256, 40
SHAPE = (96, MELS)
LOW_DB, HIGH_DB = 1.0, 4.0


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(4)
def _filter(up: int, down: int, half: int = 10) -> np.ndarray:
    """A windowed sinc that passes what both rates can hold."""
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    h = np.sinc(t / wide) * np.hamming(len(t))
    return h * (up / h.sum())


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up / down times its rate. Output n lies at input n * down / up. Outputs r, r + up, ... have one
    phase: they use one branch of the filter, at inputs that are down apart, so neither zeros between inputs
    nor outputs that are dropped again are computed."""
    h = _filter(up, down)
    mid = len(h) // 2
    size = -(-len(x) * up // down)
    out = np.zeros(size)
    taps = -(-len(h) // up)
    padded = np.concatenate([np.zeros(taps), x, np.zeros(taps + down)])
    for r in range(min(up, size)):
        at = r * down + mid  # of the output's last tap, in steps of the input's rate times up
        branch = h[at % up :: up][::-1]
        first = at // up + taps - len(branch) + 1
        n = len(range(r, size, up))
        out[r::up] = np.lib.stride_tricks.sliding_window_view(padded, len(branch))[first::down][:n] @ branch
    return out


@lru_cache(4)
def _bands(rate: float, fft: int, bands: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, each overlapping both neighbours."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    lo, mid, hi = hz[:-2, None], hz[1:-1, None], hz[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).T.copy()


_HANN = np.hanning(FRAME + 2)[1:-1]


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Decibels by frame and band, and by frame."""
    n = max(0, -(-(len(x) - FRAME) // HOP)) + 1
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x))) if len(x) < (n - 1) * HOP + FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    mel = np.empty((n, MELS))
    energy = np.empty(n)
    for lo in range(0, n, 4096):
        part = frames[lo : lo + 4096] * _HANN
        power = np.abs(np.fft.rfft(part, FFT)) ** 2
        mel[lo : lo + 4096] = power @ _bands(rate, FFT, MELS)
        energy[lo : lo + 4096] = (part * part).sum(axis=1)
    return 10 * np.log10(mel + 1e-6), 10 * np.log10(energy + 1e-6)


def segments(db: np.ndarray, low: float = LOW_DB, high: float = HIGH_DB) -> list[tuple[int, int]]:
    """Runs of frames over the median by low decibels that reach high somewhere."""
    base = np.median(db)
    above = np.diff(np.concatenate([[0], (db > base + low).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(above == 1), np.flatnonzero(above == -1)
    peaks = np.concatenate([[0], np.cumsum(db > base + high)])
    keep = peaks[ends] > peaks[starts]
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


class Clip:
    """One text's media and features."""

    def __init__(self, text: str | None):
        self.media = to_wav(payload(text))
        samples, rate = from_wav(self.media)  # what follows sees only the stored bytes
        x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float64) - 128) / 128
        self.rate = rate * UP / DOWN
        mel, energy = log_mel(resample(x), self.rate)
        self.mel = np.round(mel, 2).astype(np.float32)
        step = HOP / self.rate
        self.spans = [(round(a * step, 3), round((b - 1) * step + FRAME / self.rate, 3)) for a, b in segments(np.round(energy, 3))]

    def tensors(self) -> pa.ExtensionArray:
        n = -(-len(self.mel) // SHAPE[0])
        full = np.zeros((n, *SHAPE), dtype=np.float32)
        full.reshape(-1, MELS)[: len(self.mel)] = self.mel
        return pa.FixedShapeTensorArray.from_numpy_ndarray(full)

    def tensor_spans(self) -> list[tuple[float, float]]:
        step = HOP / self.rate
        return [(round(i * step, 3), round(min(i + SHAPE[0], len(self.mel)) * step, 3)) for i in range(0, len(self.mel), SHAPE[0])]


def feature(tensors: bytes, spans: list[dict]) -> str:
    """Of stored tensors and segments: how many tensors there are, a hash of their values, where the last one
    ends, and the segments."""
    table = pa.ipc.open_stream(tensors).read_all()
    values = table.column("log_mel").combine_chunks().to_numpy_ndarray()
    said = ",".join(f"{s['start_s']:.3f}-{s['end_s']:.3f}" for s in spans)
    digest = hashlib.sha256(np.ascontiguousarray(values).tobytes()).hexdigest()[:32]
    return f"tensors={len(values)};mel={digest};end={table.column('end_s')[-1].as_py():.3f};spans={said}"


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (a WAV file), spans (sounding segments) and tensors: an Arrow IPC
    stream of a fixed-shape tensor column and its start and end times, a row for each tensor."""

    def ipc(clip: Clip) -> bytes:
        spans = clip.tensor_spans()
        table = pa.table({"log_mel": clip.tensors(), "start_s": [a for a, _ in spans], "end_s": [b for _, b in spans]})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                clips = [Clip(t) for t in part.column(1).to_pylist()]
                spans = [[{"start_s": a, "end_s": b} for a, b in c.spans] for c in clips]
                kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), size, pa.array([c.media for c in clips]), pa.array(spans, kind), pa.array([ipc(c) for c in clips])],
                    ["doc_id", "n_bytes", "media", "spans", "tensors"],
                )

    schema = "doc_id long, n_bytes long, media binary, spans array<struct<start_s double, end_s double>>, tensors binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(worker.batches("media", run), schema)


def digests(table: DataFrame) -> DataFrame:
    """doc_id and what op9 returns of each row of a media table."""
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string"
    )
    names = [x.split()[0] for x in schema.split(",")]

    def row(n_bytes: int, media: bytes, spans: list[dict], tensors: bytes) -> tuple:
        samples, _ = from_wav(media)
        return (
            n_bytes,
            len(samples),
            hashlib.sha256(samples).hexdigest(),
            zlib.crc32(samples[-BLOCK:]),
            len(media),
            hashlib.sha256(media).hexdigest(),
            feature(tensors, spans),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            stored = (batch.column(c).to_pylist() for c in ("n_bytes", "media", "spans", "tensors"))
            cols = list(zip(*[row(*x) for x in zip(*stored, strict=True)], strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return table.select("doc_id", "n_bytes", "media", "spans", "tensors").mapInArrow(worker.batches("media", run), schema)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all documents."""
    return digests(media_table(spark.read.parquet(f"{sf_dir}/documents.parquet")))
