"""Media columns: 8-bit WAV payloads, and log-mel features of them as fixed-shape tensors with time spans.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are stored as the samples of a mono 8-bit WAV
file at RATE. The stored samples are read back, resampled to TARGET by a polyphase filter (windowed sinc, one branch
for each output phase), cut into overlapping Hann windows, and turned into log-mel energies in decibels. Runs of frames
are segmented by energy with hysteresis: a segment begins above the upper level and ends below the lower one. Features
come in tensors of FRAMES x MELS numbers, in hundredths of a decibel as 16-bit integers (the level of 8-bit samples is not
known more exactly), the last one padded with FLOOR, each with its span of seconds and the loud spans in it. They are
stored for each document as Arrow's fixed-shape tensors: each task writes a Parquet file of its own with the Arrow schema, under
another name until it is whole, so that a task that is run again writes the same file. Spark reads the tensors as lists, any
Arrow reader as tensors. The digests of the features are taken from what is read back.

Null and empty texts have 64 zero bytes as payload. Equal texts have equal media and features. Very long texts are
framed in runs of BLOCK frames. Repeated rows get rows each; without documents the result is empty. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean_session, shared_dir, text_or_empty

RATE, TARGET, TAPS = 16_000, 8_000, 16
WINDOW, HOP, FFT, MELS = 200, 80, 256, 40
FRAMES, BLOCK, FLOOR = 64, 4096, -100.0
UNIT = 100  # tensors hold whole hundredths of a decibel, in 16 bits
UPPER, LOWER = 3.0, -3.0  # decibels against the median frame
BATCH = 8 << 20  # bytes of tensors sent at once, if a document has not more

#: A field of tensors in Spark's schema, which has lists only, marked as Arrow does it.
TENSOR = pa.fixed_shape_tensor(pa.int16(), (FRAMES, MELS))
MARK = {"ARROW:extension:name": TENSOR.extension_name, "ARROW:extension:metadata": json.dumps({"shape": TENSOR.shape})}
SPANS = T.ArrayType(T.StructType().add("t_start", "double").add("t_end", "double"))
PART = T.StructType().add("t_start", "double").add("t_end", "double").add("log_mel", T.ArrayType(T.ShortType()), metadata=MARK).add("loud", SPANS)
STORED = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("tensors", T.ArrayType(PART))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file."""
    size = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", size) + payload


def samples(media: bytes) -> tuple[bytes, int]:
    """The sample bytes and the rate of such a file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        if name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def branches(up: int, down: int) -> np.ndarray:
    """The low-pass filter's taps, a row for each output phase."""
    n = 2 * up * -(-TAPS * max(up, down) // (2 * up))
    t = np.arange(n) - n // 2  # the centre is tap TAPS // 2 of branch 0
    h = np.sinc(t / max(up, down)) * np.hanning(n + 1)[:-1]
    return (h * up / h.sum()).reshape(-1, up).T.astype(np.float32)


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """x at the target rate: out[m] is the filter branch (m * down) mod up over the samples around m * down / up."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x
    h = branches(up, down)
    taps = h.shape[1]
    padded = np.pad(x, (taps, taps))
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs of one phase, each down samples after the one before
        phase, start = first * down % up, first * down // up
        count = -(-(n - first) // up)
        acc = np.zeros(count, np.float32)
        base = start + taps + taps // 2
        for k in range(taps):
            s = base - k
            acc += h[phase, k] * padded[s : s + (count - 1) * down + 1 : down]
        out[first::up] = acc
    return out


@lru_cache
def mel_filters(rate: int = TARGET) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


HANN = np.hanning(WINDOW).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Decibels, a row of MELS for each frame."""
    n = max(1, 1 + -(-(len(x) - WINDOW) // HOP))
    x = np.pad(x, (0, (n - 1) * HOP + WINDOW - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    parts = []
    for a in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[a : a + BLOCK] * HANN, FFT)
        parts.append(10 * np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ mel_filters() + 1e-10))
    return np.maximum(np.concatenate(parts), FLOOR).astype(np.float32)


def segments(mel: np.ndarray) -> np.ndarray:
    """(first frame, last frame + 1) of the loud segments."""
    energy = mel.mean(axis=1)
    level = energy - np.median(energy)
    state = np.where(level >= UPPER, 1, np.where(level < LOWER, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = (known >= 0) & (state[np.maximum(known, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def features(media: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The payload read back, its log-mel frames and its segments."""
    payload, rate = samples(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resampled(x, rate, TARGET))
    return payload, mel, segments(mel)


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a stored WAV file. Written to the shared folder and read from there."""
    lean_session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "media": pa.array([wav(r + b"\0" * (-len(r) % 64 if r else 64)) for r in raw], pa.binary())})

    path = shared_dir(docs.sparkSession, "media")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def arrow_schema() -> pa.Schema:
    """The schema of the files: tensors by Arrow's type, and for Spark its own words."""
    span = pa.struct([("t_start", pa.float64()), ("t_end", pa.float64())])
    part = pa.struct([("t_start", pa.float64()), ("t_end", pa.float64()), ("log_mel", TENSOR), ("loud", pa.list_(span))])
    plain = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    return pa.schema([*plain, ("tensors", pa.list_(part))], metadata={"org.apache.spark.sql.parquet.row.metadata": STORED.json()})


def stored_tensors(stored_media: DataFrame) -> DataFrame:
    """A row of STORED for each stored medium: digests of its bytes, and its features as tensors with their spans; written to the shared folder and read from there."""
    path = shared_dir(stored_media.sparkSession, "tensors")
    span = pa.struct([("t_start", pa.float64()), ("t_end", pa.float64())])

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        *plain, mels, segs = zip(*rows)
        parts = np.array([-(-len(mel) // FRAMES) for mel in mels])
        padded = np.full((parts.sum() * FRAMES, MELS), FLOOR * UNIT, np.int16)
        start, end, loud = [], [], []
        for mel, seg, n, at in zip(mels, segs, parts.tolist(), (np.cumsum(parts) - parts).tolist()):
            padded[at * FRAMES : at * FRAMES + len(mel)] = np.rint(mel * UNIT)
            first = np.arange(n) * FRAMES
            last = np.minimum(first + FRAMES, len(mel))
            start.append(first * HOP / TARGET)
            end.append(((last - 1) * HOP + WINDOW) / TARGET)
            low, high = np.searchsorted(seg[:, 1], first, "right"), np.searchsorted(seg[:, 0], last, "left")
            loud += [[{"t_start": max(a, f) * HOP / TARGET, "t_end": min(b, e) * HOP / TARGET} for a, b in seg[i:j].tolist()] for f, e, i, j in zip(first.tolist(), last.tolist(), low, high)]
        part = pa.StructArray.from_arrays([pa.array(np.concatenate(start)), pa.array(np.concatenate(end)), as_tensor(padded), pa.array(loud, pa.list_(span))], PART.names)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([*map(pa.array, plain, kinds), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(parts)), pa.int32()), part)], schema=arrow_schema())

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, n_bytes, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                m = m.as_py()
                payload, mel, seg = features(m)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), mel, seg))
                held += mel.nbytes + FRAMES * MELS * 4
                if held >= BATCH:
                    yield columns(rows)
                    rows, held = [], 0
            if rows:
                yield columns(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = FileSystem.from_uri(path)
        name, own, n = f"{base}/part-{task.partitionId():06d}.parquet", f"{base}/_part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        writer = None
        for batch in batches_of(batches):
            writer = writer or pq.ParquetWriter(own, arrow_schema(), filesystem=files, compression="zstd", compression_level=3)
            writer.write_batch(batch)
            n += batch.num_rows
        if writer:
            writer.close()
            if files.get_file_info(name).type == FileType.NotFound:
                files.move(own, name)
            else:  # an earlier run of this task has finished
                files.delete_file(own)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    files, base = FileSystem.from_uri(path)
    files.create_dir(base)
    stored_media.select("doc_id", "n_bytes", "media").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return stored_media.sparkSession.read.schema(STORED).parquet(path)


def tensors(stored_media: DataFrame) -> DataFrame:
    """(doc_id, part, t_start, t_end, log_mel, loud): tensors of FRAMES x MELS, row by row, and the loud spans in each."""
    return stored_tensors(stored_media).select("doc_id", F.posexplode("tensors").alias("part", "t")).select("doc_id", "part", "t.*")


def as_tensor(values: np.ndarray) -> pa.FixedShapeTensorArray:
    """Values of shape (n, FRAMES, MELS), or the column log_mel as numbers, as Arrow's fixed-shape tensors."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(np.asarray(values, np.int16).reshape(-1, FRAMES, MELS)))


def tensor_type(rows: DataFrame) -> pa.FixedShapeTensorType:
    """The type that the schema of stored tensors is marked with."""
    mark = rows.schema["tensors"].dataType.elementType["log_mel"].metadata
    if mark.get("ARROW:extension:name") != TENSOR.extension_name:
        raise ValueError("log_mel is not marked as a tensor")
    return pa.fixed_shape_tensor(pa.int16(), json.loads(mark["ARROW:extension:metadata"])["shape"])


def described(rows: DataFrame) -> DataFrame:
    """Stored tensors' rows, with feature in place of the tensors, as taken from these and their spans."""
    kind = tensor_type(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(STORED.names.index("tensors"))
            part, at = held.flatten(), np.append(0, np.cumsum(held.value_lengths().to_numpy()))
            values = pa.ExtensionArray.from_storage(kind, part.field("log_mel").cast(kind.storage_type)).to_numpy_ndarray() if len(part) else None
            frame = lambda seconds: np.rint(seconds.to_numpy(zero_copy_only=False) * TARGET / HOP).astype(np.int64)
            end = np.rint((part.field("t_end").to_numpy() * TARGET - WINDOW) / HOP).astype(np.int64) + 1 - frame(part.field("t_start"))
            loud, spans = part.field("loud").flatten(), np.append(0, np.cumsum(part.field("loud").value_lengths().to_numpy()))
            on, off = frame(loud.field("t_start")), frame(loud.field("t_end"))
            out = []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                mel = values[i:j].reshape(-1, kind.shape[1])[: end[i:j].sum()] / UNIT
                a, b = on[spans[i] : spans[j]], off[spans[i] : spans[j]]
                cut = a[1:] != b[:-1]  # segments that go over the end of a tensor are joined again
                seg = np.stack([a[np.append(True, cut)[: len(a)]], b[np.append(cut, True)[: len(b)]]], axis=1)
                exact = hashlib.sha256(np.rint(mel * 10).astype("<i2").tobytes() + seg.astype("<i8").tobytes()).hexdigest()
                out.append(f"{len(mel)}:{len(seg)}:{mel.mean(dtype=np.float64):.1f}:{exact[:32]}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], [*STORED.names[:-1], "feature"])

    return rows.select(*STORED.names).mapInArrow(run, T.StructType(STORED.fields[:-1]).add("feature", "string"))


def digests(stored_media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored media.

    feature: frames, loud segments, mean level in decibels, and a digest of the decibels rounded to tenths and the segments,
    all taken from the stored tensors.
    """
    return described(stored_tensors(stored_media))
