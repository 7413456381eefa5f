"""Sound files as series, through RIFF headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.registry import register


def decode(content: bytes) -> tuple[int, np.ndarray]:
    """The rate and the samples of a RIFF WAVE file, a column for each of its channels: PCM of 8 to 32 bits, or float."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, kind, channels, rate, bits = 12, 1, 1, 0, 16
    while at + 8 <= len(content):
        tag, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if tag == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
        elif tag == b"data":
            dtype = {(3, 32): "<f4", (3, 64): "<f8", (1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4"}[kind if kind != 0xFFFE else 1, bits]
            frame = np.dtype(dtype).itemsize * channels
            return rate, np.frombuffer(body[: len(body) // frame * frame], dtype).reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("the file has no data")


def encode(x: np.ndarray, rate: int, scale: float | None = None) -> bytes:
    """A float file; by default the largest value becomes one."""
    peak = scale if scale is not None else (1 / np.abs(x).max() if len(x) and np.abs(x).max() else 1.0)
    data = (np.asarray(x) * peak).astype("<f4").tobytes()
    fmt = struct.pack("<HHIIHH", 3, 1, rate, 4 * rate, 4, 32)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def read_wav(spark: SparkSession, paths: Sequence[str], *, start: float | None = None, end: float | None = None) -> DataFrame:
    """(channel, idx, x, value) of sound files; the channel is the path, of a file of several with :0, :1, ... behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rate, x = decode(content.as_buffer().to_pybytes())
                for c in range(x.shape[1]):
                    name = path if x.shape[1] == 1 else f"{path}:{c}"
                    for s in range(0, len(x), 1 << 16):
                        part = np.arange(s, min(s + (1 << 16), len(x)))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part), pa.array(part / rate), pa.array(x[part, c].astype(float))], names=["channel", "idx", "x", "value"])

    rows = spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, "channel string, idx long, x double, value double")
    from tidegauge.operators.series import crop_irregular

    return crop_irregular(rows, start, end) if start is not None or end is not None else rows


def write_wav(df: DataFrame, path: str, *, rate: int, scale: float | None = None) -> None:
    """One file for each channel of block rows (channel, samples), below a path that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            names = []
            for c, s in zip(batch.column("channel").to_pylist(), batch.column("samples"), strict=True):
                store, base = fs.FileSystem.from_uri(path)
                store.create_dir(base, recursive=True)
                with store.open_output_stream(f"{base}/{c}.wav") as out:
                    out.write(encode(s.values.to_numpy(zero_copy_only=False), rate, scale))
                names.append(f"{path}/{c}.wav")
            yield pa.RecordBatch.from_arrays([pa.array(names)], names=["file"])

    df.select(F.col("channel").cast("string"), "samples").mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


register("wav", read=read_wav, write=write_wav, extensions=("wav",))
