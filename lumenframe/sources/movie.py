"""Movie files as a splittable data source: a file's frames are dealt to tasks by ranges, and a task reads its bytes only.

    spark.dataSource.register(MovieSource)
    spark.read.format("movie").option("path", "/data/*.avi").option("box", "0:64:32:96").load()

The planner reads each file's chunk index, not its frames. Frames outside a time range, rows outside a box and frames
that no list names are not read at all; comparisons of t with constants are pushed down where the session allows it
(spark.sql.python.filterPushdown.enabled). Paths have to be ones that Python can open wherever tasks run: a shared
folder, or a URL that pyarrow knows. For stores that only Spark reads there is `avi.read_folder`.
"""

from __future__ import annotations

import base64
import importlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from lumenframe.sources.avi import LUMA

SCHEMA = "file_no int, local_t int, t int, height int, width int, px array<double>"
#: Frames that a task reads at most, and bytes of a batch of rows.
FRAMES = 512
BATCH_BYTES = 8_000_000


@contextmanager
def opened(path: str):
    """A file that can be read and sought; a URL goes through pyarrow's file systems."""
    if re.match(r"^[a-z][a-z0-9+.-]+://", path) and not path.startswith("file://"):
        from pyarrow import fs

        try:
            store, at = fs.FileSystem.from_uri(path)
        except (pa.ArrowInvalid, OSError) as e:
            raise ValueError(f"{path} cannot be opened from Python; read it with avi.read_folder") from e
        with store.open_input_file(at) as f:
            yield f
    else:
        with open(path.removeprefix("file://"), "rb") as f:
            yield f


def listed(path: str) -> list[str]:
    """Files that a path names (a file, a folder, or a folder with a pattern for names), numbers in names first, in order."""
    import fnmatch
    import os

    def number(p: str) -> tuple:
        stem = os.path.splitext(os.path.basename(p))[0]
        return (0, int(stem), p) if stem.isdigit() else (1, 0, p)

    found: list[str] = []
    for one in path.split(","):
        local = one.strip().removeprefix("file://")
        folder, name = os.path.split(local)
        if "://" in local:
            found.append(local)
        elif os.path.isdir(local):
            found += [os.path.join(local, n) for n in os.listdir(local) if n.lower().endswith(".avi")]
        elif any(c in name for c in "*?["):
            found += [os.path.join(folder, n) for n in os.listdir(folder) if fnmatch.fnmatch(n, name)]
        else:
            found.append(local)
    if not found:
        raise ValueError(f"no movie files at {path}")
    return sorted(set(found), key=number)


@dataclass(frozen=True)
class Layout:
    """Where a file's frames are, and what they hold."""

    path: str
    height: int
    width: int
    bits: int
    flipped: bool  # rows from the bottom up
    codec: str  # empty: plain pixels
    starts: np.ndarray
    sizes: np.ndarray

    @property
    def stride(self) -> int:
        return (self.width * self.bits // 8 + 3) // 4 * 4


def layout(path: str) -> Layout:
    """A file's index: the heads of its chunks are read, one seek each, never a frame; lists of later RIFF parts as well."""
    starts, sizes, head = [], [], None
    with opened(path) as f:
        end = f.seek(0, 2)
        stack = [(0, end)]
        while stack:
            at, past = stack.pop()
            while at + 8 <= past:
                f.seek(at)
                tag, size = struct.unpack("<4sI", f.read(8))
                if tag in (b"RIFF", b"LIST"):
                    stack.append((at + 8 + size + size % 2, past))
                    at, past = at + 12, min(past, at + 8 + size)
                    continue
                if tag == b"strf" and head is None:
                    head = struct.unpack("<IiiHHI", f.read(20))
                elif tag[2:] in (b"db", b"dc") and head is not None:
                    starts.append(at + 8)
                    sizes.append(size)
                at += 8 + size + size % 2
    if head is None:
        raise ValueError(f"{path} is no AVI file with a video stream")
    _, width, height, _, bits, compression = head
    codec = "" if compression in (0, 0x20424752) and bits in (8, 24) else struct.pack("<I", compression).decode("latin-1").strip("\0 ") or f"{bits} bits"
    return Layout(path, abs(height), width, bits, height > 0, codec, np.array(starts, np.int64), np.array(sizes, np.int64))


def decoder(name: str | None) -> Callable | None:
    """The function that 'module:function' names: (bytes of a frame's chunk, codec, height, width) -> array (height, width)."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def frame_of(f, of: Layout, n: int, box: tuple[int, int, int, int], grayscale: str, decode: Callable | None) -> np.ndarray:
    """A box (y0, y1, x0, x1) of a frame; of plain pixels only the rows of the box are read."""
    y0, y1, x0, x1 = box
    if of.codec:
        f.seek(int(of.starts[n]))
        return np.asarray(decode(f.read(int(of.sizes[n])), of.codec, of.height, of.width), float)[y0:y1, x0:x1]
    first, last = (of.height - y1, of.height - y0) if of.flipped else (y0, y1)
    f.seek(int(of.starts[n]) + first * of.stride)
    rows = np.frombuffer(f.read((last - first) * of.stride), np.uint8).reshape(-1, of.stride)
    rows = rows[::-1] if of.flipped else rows
    if of.bits == 8:
        return rows[:, x0:x1].astype(float)
    bgr = rows[:, 3 * x0 : 3 * x1].reshape(len(rows), -1, 3).astype(float)
    return bgr.mean(2) if grayscale == "mean" else np.rint(bgr[..., ::-1] @ np.array(LUMA))


def mask_option(mask: np.ndarray) -> str:
    """A mask (y, x) of flags as the text that the option `mask` takes."""
    return f"{mask.shape[0]}x{mask.shape[1]}:" + base64.b64encode(zlib.compress(np.packbits(np.asarray(mask, bool)).tobytes())).decode()


def _mask(text: str | None) -> np.ndarray | None:
    if not text:
        return None
    shape, _, body = text.partition(":")
    h, w = map(int, shape.split("x"))
    return np.unpackbits(np.frombuffer(zlib.decompress(base64.b64decode(body)), np.uint8), count=h * w).reshape(h, w).astype(bool)


@dataclass
class Frames(ds.InputPartition):
    """Frames of a file that one task reads: whole bins, by number."""

    file_no: int
    offset: int  # bins of the files before
    of: Layout
    bins: np.ndarray


class MovieSource(ds.DataSource):
    """Options: path; start, stop (bins of the whole movie); frames (JSON list of such); box (y0:y1:x0:x1); mask; ssub, tsub;
    grayscale (luma, mean); decoder (module:function); frames_per_task; pushdown (true, false).

    A file's last incomplete bin is dropped. Pixels outside the mask, which is one of the whole field, are 0. Compressed
    files are an error without a decoder.
    """

    @classmethod
    def name(cls) -> str:
        return "movie"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringReader if options.get("pushdown") == "true" else MovieReader)(options)


class MovieReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        self.path = get("path", "")
        self.low, self.high = int(get("start", 0)), int(get("stop", 1 << 31))
        self.only = np.array(sorted(set(json.loads(get("frames")))), np.int64) if get("frames") else None
        self.box = tuple(int(x) for x in get("box").split(":")) if get("box") else None
        self.mask, self.gray = _mask(get("mask")), get("grayscale", "luma")
        self.ssub, self.tsub = int(get("ssub", 1)), int(get("tsub", 1))
        self.decoder, self.most = get("decoder"), int(get("frames_per_task", FRAMES))

    def partitions(self) -> list[Frames]:
        with ThreadPoolExecutor(16) as pool:
            files = list(pool.map(layout, listed(self.path)))
        if len({(f.height, f.width) for f in files}) > 1:
            raise ValueError("the files have frames of different sizes")
        packed = [f for f in files if f.codec]
        if packed and not self.decoder:
            raise ValueError(f"{packed[0].path} is compressed ({packed[0].codec}): name a decoder (module:function), or convert it to plain 8- or 24-bit pixels")
        if self.mask is not None and self.mask.shape != (files[0].height, files[0].width):
            raise ValueError(f"the mask's shape {self.mask.shape} does not match the frames' {(files[0].height, files[0].width)}")
        out, offset = [], 0
        for no, f in enumerate(files):
            n = len(f.starts) // self.tsub
            bins = np.arange(max(0, self.low - offset), min(n, self.high - offset))
            if self.only is not None:
                bins = bins[np.isin(bins + offset, self.only)]
            for part in np.array_split(bins, max(1, -(-len(bins) * self.tsub // self.most))):
                if len(part):
                    frames = (part[:, None] * self.tsub + np.arange(self.tsub)).ravel()
                    out.append(Frames(no, offset, replace(f, starts=f.starts[frames], sizes=f.sizes[frames]), part))
            offset += n
        return out or [Frames(0, 0, replace(files[0], starts=files[0].starts[:0], sizes=files[0].sizes[:0]), np.empty(0, np.int64))]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        of, decode = partition.of, decoder(self.decoder)
        box = self.box or (0, of.height, 0, of.width)
        if not (0 <= box[0] < box[1] <= of.height and 0 <= box[2] < box[3] <= of.width):
            raise ValueError(f"box {box} is not within {of.height} x {of.width}")
        h, w = (box[1] - box[0]) // self.ssub, (box[3] - box[2]) // self.ssub
        keep = None if self.mask is None else self.mask[box[0] : box[1], box[2] : box[3]]
        step, rows, at = max(1, BATCH_BYTES // max(1, 8 * h * w)), [], 0

        def batch() -> pa.RecordBatch:
            n = len(rows)
            bins = partition.bins[at : at + n]
            px = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w)), pa.array(np.concatenate(rows)))
            same = lambda v: pa.array(np.full(n, v, np.int32))
            return pa.RecordBatch.from_arrays([same(partition.file_no), pa.array(bins.astype(np.int32)), pa.array((bins + partition.offset).astype(np.int32)), same(h), same(w), px], ["file_no", "local_t", "t", "height", "width", "px"])

        if len(partition.bins):
            with opened(of.path) as f:
                for i in range(len(partition.bins)):
                    mean = np.zeros((box[1] - box[0], box[3] - box[2]))
                    for j in range(self.tsub):
                        mean += frame_of(f, of, i * self.tsub + j, box, self.gray, decode)
                    mean /= self.tsub
                    if keep is not None:
                        mean = np.where(keep, mean, 0.0)
                    rows.append(mean[: h * self.ssub, : w * self.ssub].reshape(h, self.ssub, w, self.ssub).mean((1, 3)).ravel())
                    if len(rows) == step:
                        yield batch()
                        at, rows = at + step, []
            if rows:
                yield batch()


class FilteringReader(MovieReader):
    """A reader that bounds on t reach; sessions without filter pushdown accept none that takes filters."""

    def pushFilters(self, filters):  # noqa: N802
        """Bounds on t narrow the range; all other filters stay with Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if tuple(getattr(f, "attribute", ())) != ("t",) or not isinstance(value, int):
                yield f
            elif isinstance(f, ds.GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif isinstance(f, ds.GreaterThan):
                self.low = max(self.low, value + 1)
            elif isinstance(f, ds.LessThan):
                self.high = min(self.high, value)
            elif isinstance(f, ds.LessThanOrEqual):
                self.high = min(self.high, value + 1)
            elif isinstance(f, ds.EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value + 1)
            else:
                yield f


def facts(path: str, tsub: int = 1) -> dict:
    """Frames of all files together (in bins), their number by file, height and width, from the indexes alone."""
    with ThreadPoolExecutor(16) as pool:
        files = list(pool.map(layout, listed(path)))
    if len({(f.height, f.width) for f in files}) > 1:
        raise ValueError("the files have frames of different sizes")
    by_file = [len(f.starts) // tsub for f in files]
    return {"n": sum(by_file), "by_file": by_file, "height": files[0].height, "width": files[0].width, "files": [f.path for f in files]}


def read(spark: SparkSession, path: str, *, box: tuple[int, int, int, int] | None = None, t_range: tuple[int, int] | None = None, frames: list[int] | None = None, mask: np.ndarray | None = None, ssub: int = 1, tsub: int = 1, grayscale: str = "luma", decoder: str | None = None, frames_per_task: int = FRAMES) -> DataFrame:
    """(file_no, local_t, t, height, width, px) of the files at a path, or of a part of them."""
    spark.dataSource.register(MovieSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("movie").option("pushdown", pushed.lower()).option("path", path).option("ssub", ssub).option("tsub", tsub).option("grayscale", grayscale).option("frames_per_task", frames_per_task)
    for name, value in (("box", box and ":".join(map(str, box))), ("frames", None if frames is None else json.dumps([int(x) for x in frames])), ("decoder", decoder), ("mask", None if mask is None else mask_option(mask))):
        if value is not None:
            reader = reader.option(name, value)
    if t_range is not None:
        reader = reader.option("start", t_range[0]).option("stop", t_range[1])
    return reader.load()
