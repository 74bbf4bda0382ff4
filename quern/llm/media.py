"""Audio columns: lossless 8-bit PCM, polyphase resampling, log-mel filterbanks, energy segments."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, documents_of

UNIT, PAD = 576, 255
RATE, UP, DOWN = 24_000, 2, 3  # stored rate, and the factors to the 16 kHz that features are made at
FRAME, HOP, FFT, MELS, BLOCK = 400, 160, 512, 40, 64  # BLOCK: frames of a tensor
ON_DB, OFF_DB, LEAST_FRAMES = -6.0, -12.0, 3  # hysteresis against the loudest frame


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def phases(up: int, down: int, half: int) -> list[np.ndarray]:
    """The windowed-sinc low-pass, dealt into one filter per output phase (reversed for correlation)."""
    cut = 1 / max(up, down)
    n = np.arange(-half * up, half * up + 1)
    h = up * cut * np.sinc(cut * n) * np.hamming(len(n))
    return [h[p::up][::-1].astype(np.float32).copy() for p in range(up)]


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, half: int = 12) -> np.ndarray:
    """Polyphase resampling by up/down: only the kept output samples are computed, each with its phase's taps.

    y[n] = sum_k h[k] x[(n down - k) / up] over whole positions, with h centred.
    """
    n_out = -(-len(x) * up // down)
    filters = phases(up, down, half)
    y = np.zeros(n_out, np.float32)
    for r in range(up):
        n = np.arange(r, n_out, up)
        if not len(n):
            continue
        at = r * down + half * up  # position of the filter's end in the upsampled signal
        taps = filters[at % up]
        last = at // up  # newest input sample that the first output of this phase needs
        lead = len(taps) - 1 - last
        padded = np.concatenate([np.zeros(max(lead, 0), np.float32), x, np.zeros(half + down + len(taps), np.float32)])
        begin = max(-lead, 0)
        windows = np.lib.stride_tricks.sliding_window_view(padded[begin:], len(taps))[:: down][: len(n)]
        y[r::up] = windows @ taps
    return y


def mel_bank(rate: int = RATE * UP // DOWN) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale from 0 to the Nyquist frequency."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


def log_mel(y: np.ndarray, bank: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, frame energies in dB) of overlapping Hann-windowed frames, block by block."""
    n = max(1, 1 + (len(y) - FRAME) // HOP) if len(y) >= FRAME else 1
    y = np.concatenate([y, np.zeros(max(0, FRAME - len(y)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    window = np.hanning(FRAME).astype(np.float32)
    mel, db = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, block):
        part = frames[at:at + block] * window
        power = np.abs(np.fft.rfft(part, FFT).astype(np.complex64)) ** 2
        mel[at:at + block] = np.log(power @ bank + 1e-6)
        db[at:at + block] = 10 * np.log10(np.mean(part * part, 1) + 1e-10)
    return mel, db


def segments(db: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that rise above ON_DB below the peak and last until they fall under OFF_DB, LEAST_FRAMES or longer."""
    peak = float(db.max())
    on, off = db >= peak + ON_DB, db < peak + OFF_DB
    state = np.where(on, 1, np.where(off, 0, -1))
    known = np.flatnonzero(state >= 0)
    state = state[known[np.maximum(np.searchsorted(known, np.arange(len(db)), "right") - 1, 0)]] if len(known) else np.zeros(len(db), int)
    state[: known[0] if len(known) else len(db)] = 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= LEAST_FRAMES]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS), dim_names=("frame", "mel"))
STORED = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("mel", TENSOR)])


def features(media: bytes, bank: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """All log-mel frames as tensors (blocks, BLOCK, MELS) to 1/100, the time span of each and the energy segments, in seconds.

    The last tensor is filled up with the level of silence; its span ends with its last frame.
    """
    x = (np.frombuffer(from_wav(media), np.uint8).astype(np.float32) - 128) / 128
    mel, db = log_mel(resample(x), bank)
    n = -(-len(mel) // BLOCK)
    tensor = np.full((n * BLOCK, MELS), round(math.log(1e-6), 2), np.float32)
    tensor[: len(mel)] = np.round(mel, 2)
    second = HOP * DOWN / (RATE * UP)
    spans = [(k * BLOCK * second, min((k + 1) * BLOCK, len(mel)) * second) for k in range(n)]
    return tensor.reshape(n, BLOCK, MELS), spans, [(a * second, b * second) for a, b in segments(db)]


def to_tensors(tensor: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream of one batch: the time span and the fixed-shape tensor of each block."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensor.ravel()), BLOCK * MELS)
    starts, ends = (pa.array([s[i] for s in spans], pa.float64()) for i in (0, 1))
    batch = pa.RecordBatch.from_arrays([starts, ends, pa.ExtensionArray.from_storage(TENSOR, flat)], schema=STORED)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, STORED) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> pa.Table:
    """What :func:`to_tensors` stored: start, end and mel, of Arrow's fixed-shape tensor type."""
    return pa.ipc.open_stream(stored).read_all()


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as an 8-bit mono WAV.

    A null or empty text is one unit of padding; repeated rows are kept; other columns are ignored.
    """

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            return {"doc_id": batch.column(0), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "media": [to_wav(payload_of(t)) for t in texts]}

        return each

    return arrow_map(documents_of(docs), "doc_id long, n_bytes long, media binary", make)


def audio_features(media: DataFrame) -> DataFrame:
    """Read stored media back: doc_id, n_bytes, media, payload, tensors, n_blocks, segments.

    ``tensors`` is a stream of Arrow's fixed-shape tensors of BLOCK frames x MELS, as many as the
    sound needs, with their time spans; :func:`from_tensors` opens it. One scan, one sound at a
    time; equal media, equal values.
    """

    def make():
        bank = mel_bank()

        def each(batch: pa.RecordBatch) -> dict:
            sounds = batch.column(2).to_pylist()
            got = [features(m, bank) for m in sounds]
            return {"doc_id": batch.column(0), "n_bytes": batch.column(1), "media": batch.column(2), "payload": [from_wav(m) for m in sounds],
                    "tensors": [to_tensors(t, s) for t, s, _ in got], "n_blocks": [len(s) for _, s, _ in got],
                    "segments": [[{"start": a, "end": b} for a, b in s] for _, _, s in got]}

        return each

    return arrow_map(media.select("doc_id", "n_bytes", "media"), "doc_id long, n_bytes long, media binary, payload binary, tensors binary, n_blocks int, segments array<struct<start:double,end:double>>", make)


def media_digests(media: DataFrame) -> DataFrame:
    """Columns that tell whether the stored bytes hold the text, and a digest of the stored tensors and segments."""
    tail = F.substring("payload", F.length("payload") - 31, F.lit(32))
    edges = F.transform("segments", lambda s: F.concat_ws("-", F.round(s["start"] * 1000).cast("long").cast("string"), F.round(s["end"] * 1000).cast("long").cast("string")))
    return media.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_blocks").cast("string"), F.md5("tensors"), F.size("segments").cast("string"), F.md5(F.concat_ws(",", edges))).alias("feature"))
