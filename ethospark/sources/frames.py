"""Frames of uncompressed YUV4MPEG2 videos as a data source, in batches and as a stream.

``spark.dataSource.register(VideoFrames)``, then ``spark.read.format("video_frames").load(path)``. A video is cut into
partitions of ``framesPerPartition`` frames, each of which seeks to its first frame, so a long video is read by many tasks
and none holds more than a frame. ``start`` and ``stop`` (frame numbers from 1, stop not included) read a part, ``scale``
resizes every frame as it is read.

As a stream the source follows files that still grow, as a camera's recorder writes them. The driver only looks at file
sizes: offsets are numbers of whole frames of each file, executors read what lies between two of them, partition by partition, and a
micro-batch that is read again has the same frames. ``framesPerBatch`` limits what is taken of each file at a time. Spark doesn't say where a query stopped before it asks how
far to go, so the reader takes all there is in its first batch, unless it can keep its place in a file of its own, ``progress``,
one for each query.
A camera that isn't there yet is waited for, ``openSeconds`` at most. Compressed videos need a decoder and plug in the
same way.

Files are opened through Arrow's file systems (local, HDFS, S3, GCS), where a path of Spark's own names is a URI.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "video string, frame bigint, width int, height int, px binary"
#: How long a camera is waited for, and between two tries, in seconds.
OPEN_SECONDS, RETRY_SECONDS = 5.0, 0.2
#: Headers that the driver reads at a time.
AT_ONCE = 32


def _place(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.removeprefix("file:"))
    return store, inner


def videos(path: str) -> dict[str, int]:
    """The video files of a path, a file or a tree, and their sizes, by one listing."""
    from pyarrow import fs

    store, inner = _place(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return {path: info.size}
    if info.type == fs.FileType.NotFound:
        return {}
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    lead = path.split("://", 1)[0] + "://" if "://" in path else ""
    return {lead + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".y4m")}


@dataclass
class Layout:
    """Where a video's frames are; all are of one size when none has parameters of its own."""

    first: int
    width: int
    height: int
    size: int
    frames: int

    @property
    def step(self) -> int:
        return len(b"FRAME\n") + self.size

    def of(self, size: int) -> Layout:
        """The same for a file of so many bytes."""
        return replace(self, frames=max(0, size - self.first) // self.step)


def layout(path: str) -> Layout:
    store, inner = _place(path)
    with store.open_input_file(inner) as f:
        head = f.read(4096)
        total = f.size()
    line, found, _ = head.partition(b"\n")
    words = line.split()
    if not found or not words or words[0] != b"YUV4MPEG2":
        raise ValueError(f"not a YUV4MPEG2 file: {path}")
    tags = {w[:1]: w[1:] for w in words[1:]}
    width, height, chroma = int(tags[b"W"]), int(tags[b"H"]), tags.get(b"C", b"420")
    across, down = (width, height) if chroma.startswith(b"444") else ((width + 1) // 2, height if chroma.startswith(b"422") else (height + 1) // 2)
    size = width * height + (0 if chroma.startswith(b"mono") else 2 * across * down)
    return Layout(len(line) + 1, width, height, size, 0).of(total)


def layouts(sizes: dict[str, int], known: dict[str, Layout]) -> dict[str, Layout]:
    """Layouts of files; headers that aren't known yet are read, some at a time, as a recorder writes them once."""
    new = [path for path in sizes if path not in known]
    with ThreadPoolExecutor(min(AT_ONCE, max(1, len(new)))) as pool:
        known.update(zip(new, pool.map(layout, new)))
    return {path: known[path].of(size) for path, size in sizes.items()}


def neighbours(n: int, m: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of m new places the two old ones of n between which it lies, and the second one's weight.

    Pixels are areas, so centres are at halves; places beyond the first and last centre take these.
    """
    at = np.clip((np.arange(m) + 0.5) * ratio - 0.5, 0, n - 1)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, n - 1), at - low


def resized(image: np.ndarray, height: int, width: int, ratios: tuple[float, float] | None = None) -> np.ndarray:
    """A grey image in another size, along rows and then along columns, rounded half up."""
    h, w = image.shape
    ry, rx = ratios or (h / height, w / width)
    (top, bottom, fy), (left, right, fx) = neighbours(h, height, ry), neighbours(w, width, rx)
    pixels = image.astype(np.float64)
    rows = pixels[:, left] * (1 - fx) + pixels[:, right] * fx
    return np.floor(rows[top] * (1 - fy)[:, None] + rows[bottom] * fy[:, None] + 0.5).astype(np.uint8)


def scaled(width: int, height: int, scale: float) -> tuple[int, int]:
    return max(1, round(width * scale)), max(1, round(height * scale))


def read_frames(path: str, start: int, stop: int, scale: float = 1.0) -> Iterator[tuple]:
    """Rows of the frames start to stop - 1, counted from 1."""
    there = layout(path)
    store, inner = _place(path)
    name = path.rsplit("/", 1)[-1]
    with store.open_input_file(inner) as f:
        for frame in range(max(1, start), min(stop, there.frames + 1)):
            f.seek(there.first + (frame - 1) * there.step)
            raw = f.read(there.step)
            if not raw.startswith(b"FRAME\n"):
                raise ValueError(f"frame {frame} of {path} has parameters of its own")
            at = len(b"FRAME\n")
            width, height, px = there.width, there.height, raw[at : at + there.width * there.height]
            if scale != 1.0:
                old = np.frombuffer(px, np.uint8).reshape(height, width)
                width, height = scaled(width, height, scale)
                px = resized(old, height, width, (1 / scale, 1 / scale)).tobytes()
            yield name, frame, width, height, px


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int


def read_json(path: str) -> dict[str, int]:
    from pyarrow import fs

    store, inner = _place(path)
    if store.get_file_info(inner).type == fs.FileType.NotFound:
        return {}
    with store.open_input_file(inner) as f:
        return json.loads(f.read())


def write_json(path: str, value: dict) -> None:
    store, inner = _place(path)
    with store.open_output_stream(inner + ".new") as f:
        f.write(json.dumps(value).encode())
    store.move(inner + ".new", inner)


def cut(path: str, start: int, stop: int, each: int) -> list[Part]:
    return [Part(path, a, min(a + each, stop)) for a in range(start, stop, each)]


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.each = options["path"], int(options.get("framesPerPartition", 1000))
        self.start, self.stop = int(options.get("start", 1)), int(options.get("stop", 1 << 62))
        self.scale = float(options.get("scale", 1))

    def partitions(self):
        there = layouts(videos(self.path), {})
        parts = [p for path, x in there.items() for p in cut(path, max(1, self.start), min(self.stop, x.frames + 1), self.each)]
        return parts or [Part("", 1, 1)]

    def read(self, partition):
        if partition.path:
            yield from read_frames(partition.path, partition.start, partition.stop, self.scale)


class CameraReader(DataSourceStreamReader):
    """Offsets are the frames taken of each file; what lies between two is read by the executors."""

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("framesPerBatch", 1000))
        self.each, self.scale = int(options.get("framesPerPartition", 100)), float(options.get("scale", 1))
        self.patience, self.opened = float(options.get("openSeconds", OPEN_SECONDS)), False
        self.known: dict[str, Layout] = {}
        self.progress = options.get("progress")
        self.told: dict[str, int] | None = read_json(self.progress) if self.progress else None

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        deadline = time.monotonic() + self.patience
        while not self.opened and not videos(self.path):
            if time.monotonic() > deadline:
                raise TimeoutError(f"no camera at {self.path}")
            time.sleep(RETRY_SECONDS)
        self.opened = True
        there = {path: x.frames for path, x in layouts(videos(self.path), self.known).items()}
        if self.told is not None:  # Spark reads up to what it was told before it asks again
            # a file that is gone keeps its place, so that offsets never go back
            there = self.told | {path: max(self.told.get(path, 0), min(n, self.told.get(path, 0) + self.most)) for path, n in there.items()}
        self.told = there
        return there

    def partitions(self, start, end):
        told = self.told or {}
        self.told = told | {path: max(n, told.get(path, 0)) for path, n in end.items()}
        return [p for path in sorted(end) for p in cut(path, start.get(path, 0) + 1, end[path] + 1, self.each)]

    def commit(self, end):
        if self.progress:
            write_json(self.progress, end)

    def read(self, partition):
        yield from read_frames(partition.path, partition.start, partition.stop, self.scale)


class VideoFrames(DataSource):
    @classmethod
    def name(cls):
        return "video_frames"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return BatchReader(self.options)

    def streamReader(self, schema: StructType):  # noqa: N802
        return CameraReader(self.options)
