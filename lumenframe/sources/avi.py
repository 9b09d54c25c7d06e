"""Uncompressed AVI files: a reader for `binaryFile` rows, a Spark data source, and a writer for small movies.

Compressed video needs a decoder library and is out of reach of this package; convert it first.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources.ingest import concat_offsets, discover

#: Weights of red, green and blue in luma.
LUMA = (0.299, 0.587, 0.114)


def _chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag, first, past) of the chunks of a RIFF list; lists are entered."""
    at = start
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag in (b"RIFF", b"LIST"):
            yield from _chunks(data, at + 12, min(end, at + 8 + size))
        else:
            yield tag, at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def decode(data: bytes, grayscale: str = "luma") -> Iterator[np.ndarray]:
    """Frames (rows, columns) of an uncompressed 8- or 24-bit file; grayscale: 'luma' or 'mean' of the channels."""
    height = width = bits = None
    for tag, a, b in _chunks(data, 0, len(data)):
        if tag == b"strf" and height is None:
            _, width, height, _, bits, compression = struct.unpack_from("<IiiHHI", data, a)
            if compression not in (0, 0x20424752) or bits not in (8, 24):
                raise ValueError("only uncompressed 8- and 24-bit video is read")
        elif tag[2:] in (b"db", b"dc") and height is not None:
            stride = (width * bits // 8 + 3) // 4 * 4
            rows = np.frombuffer(data, np.uint8, stride * abs(height), a).reshape(abs(height), stride)[:, : width * bits // 8]
            rows = rows[::-1] if height > 0 else rows
            if bits == 24:
                bgr = rows.reshape(abs(height), width, 3).astype(float)
                rows = bgr.mean(2) if grayscale == "mean" else np.rint(bgr[..., ::-1] @ np.array(LUMA))
            yield rows


def encode(movie: np.ndarray, fps: float = 20.0) -> bytes:
    """An uncompressed 8-bit AVI of a movie (t, y, x) of bytes."""
    t, h, w = movie.shape
    stride = (w + 3) // 4 * 4
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    list_ = lambda kind, body: b"LIST" + struct.pack("<I", len(body) + 4) + kind + body
    head = struct.pack("<14I", int(1e6 / fps), stride * h * int(fps + 1), 0, 0x10, t, 0, 1, stride * h, w, h, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"DIB ", 0, 0, 0, 0, 1000, int(fps * 1000), 0, t, stride * h, 0, 0, 0, 0, w, h)
    form = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, stride * h, 0, 0, 256, 0) + palette
    frames = b"".join(chunk(b"00db", np.pad(f[::-1], ((0, 0), (0, stride - w))).astype(np.uint8).tobytes()) for f in movie)
    body = b"AVI " + list_(b"hdrl", chunk(b"avih", head) + list_(b"strl", chunk(b"strh", stream) + chunk(b"strf", form))) + list_(b"movi", frames)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.avi", *, grayscale: str = "luma", ssub: int = 1, tsub: int = 1, crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(t, height, width, px): all numbered files of a folder as one movie, decoded a file to a task.

    Each file is cropped and binned as it is decoded, its last incomplete bin is dropped, and its frames follow
    those of the files before it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    order = discover(files.select(F.col("path").alias("file")))
    rows = files.join(F.broadcast(order), files["path"] == order["file"]).select("file_no", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for no, content in zip(batch["file_no"], batch["content"]):
                some, bin_ = [], 0
                for frame in decode(bytes(content), grayscale):
                    if crop:
                        frame = frame[crop[0] : crop[1], crop[2] : crop[3]]
                    some.append(np.asarray(frame, float))
                    if len(some) == tsub:
                        mean = np.mean(some, axis=0)
                        h, w = mean.shape[0] // ssub, mean.shape[1] // ssub
                        mean = mean[: h * ssub, : w * ssub].reshape(h, ssub, w, ssub).mean((1, 3))
                        yield pd.DataFrame({"file_no": [no], "local_t": [bin_], "height": [h], "width": [w], "px": [mean.ravel()]})
                        some, bin_ = [], bin_ + 1

    decoded = rows.mapInPandas(run, "file_no int, local_t int, height int, width int, px array<double>")
    sizes = decoded.select("height", "width").distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("the files have frames of different sizes")
    return concat_offsets(decoded).select(F.col("t").cast("int").alias("t"), "height", "width", "px")
