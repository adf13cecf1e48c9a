"""WAV files as segments ``(path, sample_rate, channels, pcm)`` and back."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.audio import resample


def decode(content: bytes) -> tuple[int, int, np.ndarray]:
    """Sample rate, channels and mono samples in [-1, 1] of a PCM file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as f:
        rate, channels, width, raw = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << 8 * width - 1)
    return rate, channels, x.reshape(-1, channels).mean(1)


def encode(pcm: np.ndarray, rate: int) -> bytes:
    """16-bit mono; samples beyond full scale are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(np.asarray(pcm, float), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def read_segments(spark: SparkSession, path: str, to_rate: int | None = None) -> DataFrame:
    """All WAV files below ``path``, mixed to mono and, if asked, resampled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                rate, channels, x = decode(content)
                if to_rate and rate != to_rate:
                    x, rate = resample(x, rate, to_rate), to_rate
                rows.append((p, rate, channels, x.tolist()))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "pcm"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, channels int, pcm array<double>")


def encoded(segments: DataFrame, name: str = "name") -> DataFrame:
    """``(name, sample_rate, pcm)`` as ``(name, content)``, WAV files in a column that any sink can write."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({name: batch[name], "content": [encode(x, int(r)) for x, r in zip(batch["pcm"], batch["sample_rate"])]})

    return segments.select(name, "sample_rate", "pcm").mapInPandas(run, f"{name} string, content binary")
