"""Bulk WAV ingest into frame tables.

``read_wav`` reads files through a data source whose partitions are byte
ranges: a recording of hours is many tasks' work, and a task holds one piece of
its range at a time. ``frames_of`` decodes files that are already in a column.
"""

from __future__ import annotations

import io
import re
import struct
import wave
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
FRAMES_SCHEMA = (
    "path string, sample_rate int, frame_no long, mic array<float>, tap array<float>, error string"
)
#: Bytes of a file that one task reads, and of those it decodes at once.
RANGE_BYTES, PIECE_BYTES = 16 << 20, 1 << 20


@dataclass(frozen=True)
class Layout:
    """What a file's header says: sample format and place of the samples."""

    kind: int
    channels: int
    rate: int
    align: int
    bits: int
    at: int
    size: int


def layout(f: BinaryIO, length: int) -> Layout:
    """Read the chunk heads of a WAV file, and no samples."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt, body = 12, None, None
    while at + 8 <= length and (fmt is None or body is None):
        f.seek(at)
        tag, size = struct.unpack("<4sI", f.read(8))
        inside = min(size, length - at - 8)
        if tag == b"fmt ":
            data = f.read(min(inside, 40))
            kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", data)
            if kind == EXTENSIBLE and size >= 26:
                kind = struct.unpack_from("<H", data, 24)[0]
            fmt = kind, channels, rate, align, bits
        elif tag == b"data":
            body = at + 8, inside
        at += 8 + size + (size & 1)
    if fmt is None or body is None:
        raise ValueError("missing fmt or data chunk")
    if fmt[1] not in (1, 2):
        raise ValueError(f"unsupported channel count {fmt[1]} (expected 1 or 2)")
    if fmt[3] != fmt[1] * fmt[4] // 8 or not fmt[3]:
        raise ValueError(f"unsupported block size {fmt[3]} of {fmt[1]} channels with {fmt[4]} bits")
    _samples(b"", fmt[0], fmt[4])
    return Layout(*fmt, *body)


def _samples(raw: bytes, kind: int, bits: int) -> np.ndarray:
    if kind == FLOAT and bits == 32:
        return np.frombuffer(raw, "<f4")
    if kind != PCM or bits not in (8, 16, 24, 32):
        raise ValueError(f"unsupported sample format {kind}/{bits}")
    if bits == 8:
        ints = np.frombuffer(raw, "u1").astype(np.int32) - 128
    elif bits == 24:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
        ints = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24)) >> 8
    else:
        ints = np.frombuffer(raw, f"<i{bits // 8}")
    return (ints / np.float32(1 << (bits - 1))).astype(np.float32)


def tracks(raw: bytes, form: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(mic, tap) of whole sample blocks; one channel is the tap alone."""
    x = _samples(raw, form.kind, form.bits)
    return (x[:0], x) if form.channels == 1 else (x[0::2], x[1::2])


def decode(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(sample rate, mic, tap) of a whole file."""
    form = layout(io.BytesIO(data), len(data))
    return form.rate, *tracks(data[form.at : form.at + form.size - form.size % form.align], form)


def encode_pcm16(left: np.ndarray, right: np.ndarray, rate: int) -> bytes:
    """Two float tracks as 16-bit PCM bytes."""
    both = np.stack([left, right], axis=1).astype(np.float64)
    pcm = np.trunc(np.clip(both, -1.0, 1.0) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.tobytes())
    return out.getvalue()


def frames_of(files: DataFrame, frame_len: int) -> DataFrame:
    """Frame rows of (path, content). A broken file becomes one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rate, mic, tap = decode(bytes(content))
                except (ValueError, struct.error) as bad:
                    yield pd.DataFrame(
                        [(path, None, None, None, None, str(bad))],
                        columns=["path", "sample_rate", "frame_no", "mic", "tap", "error"],
                    )
                    continue
                n = len(tap)
                cuts = range(0, n, frame_len)
                yield pd.DataFrame(
                    {
                        "path": path,
                        "sample_rate": rate,
                        "frame_no": range(len(cuts)),
                        "mic": [mic[c : c + frame_len] for c in cuts],
                        "tap": [tap[c : c + frame_len] for c in cuts],
                        "error": None,
                    }
                )

    return files.select("path", "content").mapInPandas(run, FRAMES_SCHEMA)


def _file_system(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    if not re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


@dataclass
class ByteRange(InputPartition):
    """Part of a file: a frame belongs to the range that its first byte is in."""

    path: str
    length: int
    first: int
    end: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.frame_len = int(options["frameLength"])
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of all .wav files under the path. Names and lengths are listed; no file is opened."""
        from pyarrow import fs

        system, path = _file_system(self.path)
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        named = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))
        return [
            ByteRange(name, size, at, min(size, at + self.range_bytes)) for name, size in named for at in range(0, max(size, 1), self.range_bytes)
        ] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.path) as f:
            try:
                form = layout(f, partition.length)
            except (ValueError, struct.error) as bad:
                if partition.first == 0:
                    yield self._batch(partition.path, None, 0, [None], [None], str(bad))
                return
            frame = self.frame_len * form.align
            until = form.at + form.size - form.size % form.align
            last = -(-(until - form.at) // frame)
            now, end = (min(last, max(0, -(-(edge - form.at) // frame))) for edge in (partition.first, partition.end))
            if partition.end == partition.length:
                end = last
            step = max(1, PIECE_BYTES // frame)
            while now < end:
                stop = min(end, now + step)
                first = form.at + now * frame
                f.seek(first)
                mic, tap = tracks(f.read(min(form.at + stop * frame, until) - first), form)
                cut = lambda x: [x[c * self.frame_len : (c + 1) * self.frame_len] for c in range(stop - now)]  # noqa: B023, E731
                yield self._batch(partition.path, form.rate, now, cut(mic), cut(tap), None)
                now = stop

    @staticmethod
    def _batch(path: str, rate: int | None, first: int, mic: list, tap: list, error: str | None) -> pa.RecordBatch:
        n = len(tap)
        numbers = [None] if error else range(first, first + n)
        columns = [pa.array([path] * n), pa.array([rate] * n, pa.int32()), pa.array(numbers, pa.int64())]
        columns += [pa.array(x, pa.list_(pa.float32())) for x in (mic, tap)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([error] * n, pa.string())], names=["path", "sample_rate", "frame_no", "mic", "tap", "error"])


class WavFrames(DataSource):
    """``wav_frames``: frames of all .wav files under ``path``; options ``frameLength`` and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return FRAMES_SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read_wav(spark: SparkSession, path: str, frame_len: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of every .wav file under a path that all executors can reach, read in byte ranges.

    A broken file is one error row; an empty folder gives no rows.
    """
    spark.dataSource.register(WavFrames)
    options = {"frameLength": frame_len, "rangeBytes": range_bytes}
    return spark.read.format("wav_frames").options(**options).load(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row's ``content`` as file ``name`` under a folder that all executors can reach; returns name and length.

    A repeated task writes the same file again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _file_system(folder)
        system.create_dir(path)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"name": batch["name"], "length": [len(c) for c in batch["content"]]})

    return files.select("name", "content").mapInPandas(run, "name string, length long")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """File facts (path, length) without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length")
