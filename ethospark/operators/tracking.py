"""Multi-object tracking: constant-velocity Kalman filters, globally optimal assignment, gated.

Tracking a video is sequential, so a video is the unit of parallelism: rows are dealt by video and sorted by frame,
and a task walks through them with one tracker as its state, never holding more than a frame. Batch and streaming
share the tracker. Frames without detections count too: pass the whole frame axis, else tracks never age.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "video string, frame bigint, det bigint, track_id bigint, x double, y double, px double, py double, vx double, vy double"


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a least-cost matching, by shortest augmenting paths with potentials."""
    if cost.size == 0:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = (cost.T if turned else cost).astype(np.float64)
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    found = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if turned else (a, b) for a, b in found)


@dataclass
class Track:
    """State of one filter; single precision throughout. The covariance starts at zero."""

    state: np.ndarray
    cov: np.ndarray
    noise: np.ndarray
    missed: int = 0
    prior: np.ndarray = field(default_factory=lambda: np.zeros(4, np.float32))
    prior_cov: np.ndarray = field(default_factory=lambda: np.zeros((4, 4), np.float32))


class Tracker:
    """Identities of one video or camera.

    Per frame: predict all tracks; match predictions and detections at least total distance, then drop pairs beyond
    the gate; a detection left over joins the nearest predicted track inside the gate even if that one is matched,
    else starts a track; a track without a detection is missed, its noise grows, and after too many misses it ends.
    """

    def __init__(self, gate: float = 200.0, max_missed: float = 5, noise=(0.01, 0.1, 0.1), prune: bool = False):
        position, velocity, measured = noise
        self.gate, self.max_missed, self.prune = gate, max_missed, prune
        self.q = np.diag([position, position, velocity, velocity]).astype(np.float32)
        self.r = (np.eye(2) * measured).astype(np.float32)
        self.move = np.eye(4, dtype=np.float32)
        self.move[0, 2] = self.move[1, 3] = 1
        self.next_id = 1
        self.tracks: dict[int, Track] = {}

    def _predict(self) -> None:
        for t in self.tracks.values():
            t.prior = self.move @ t.state
            t.prior_cov = self.move @ t.cov @ self.move.T + t.noise
            t.state, t.cov = t.prior.copy(), t.prior_cov.copy()

    def _correct(self, t: Track, point) -> None:
        gain = np.linalg.solve(t.prior_cov[:2, :2] + self.r, t.prior_cov[:2]).T
        t.state = (t.prior + gain @ (np.array(point, np.float32) - t.prior[:2])).astype(np.float32)
        t.cov = (t.prior_cov - gain @ t.prior_cov[:2]).astype(np.float32)
        t.missed = 0

    def update(self, points: list[tuple[float, float]]) -> dict[int, int]:
        """Track of each detection by its place."""
        self._predict()
        ids = list(self.tracks)
        at = np.array([self.tracks[i].state[:2] for i in ids], np.float64).reshape(-1, 2)
        there = np.array(points, np.float64).reshape(-1, 2)
        far = np.hypot(at[:, None, 0] - there[None, :, 0], at[:, None, 1] - there[None, :, 1])
        given: dict[int, int] = {}
        seen: set[int] = set()
        for r, c in assign(far.astype(np.float32)):
            if np.float32(far[r, c]) < self.gate:
                given[c] = ids[r]
                seen.add(ids[r])
                self._correct(self.tracks[ids[r]], points[c])
        for c, point in enumerate(points):
            if c in given:
                continue
            best = int(far[:, c].argmin()) if ids else -1
            if ids and far[best, c] < self.gate:
                given[c] = ids[best]
                self._correct(self.tracks[ids[best]], point)
            else:
                given[c] = self.next_id
                self.tracks[self.next_id] = Track(np.array([*point, 0, 0], np.float32), np.zeros((4, 4), np.float32), self.q.copy())
                self.next_id += 1
            seen.add(given[c])
        for i in [i for i in self.tracks if i not in seen]:
            t = self.tracks[i]
            t.missed += 1
            with np.errstate(over="ignore"):
                t.noise = t.noise * np.float32(min(2.0, 1.0 + 0.2 * t.missed))
            if t.missed > self.max_missed:
                del self.tracks[i]
        if self.prune:
            self._prune()
        return given

    def _prune(self) -> None:
        """Of two tracks closer than half the gate the younger one ends, also if the older ends too. Off by default."""
        ids = sorted(self.tracks)
        at = np.array([self.tracks[i].state[:2] for i in ids], np.float64).reshape(-1, 2)
        near = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)) < self.gate / 2
        for b in np.flatnonzero(np.tril(near, -1).any(1)):
            del self.tracks[ids[b]]

    def rows(self, points) -> list[tuple]:
        """(place, track, x, y, px, py, vx, vy) of a frame's detections; positions are the measured ones."""
        out = []
        for c, i in sorted(self.update(points).items()):
            if i in self.tracks:
                s = self.tracks[i].state
                tail = [float(v) if np.isfinite(v) else None for v in s]
                out.append((c, i, float(points[c][0]), float(points[c][1]), *tail))
        return out

    def dump(self) -> tuple[int, list[int], list[int], list[float]]:
        """The state as plain lists, tracks in order of their start."""
        ids = list(self.tracks)
        numbers = [float(v) for i in ids for a in (self.tracks[i].state, self.tracks[i].cov, self.tracks[i].noise) for v in a.ravel()]
        return self.next_id, ids, [self.tracks[i].missed for i in ids], numbers

    def load(self, next_id: int, ids, missed, numbers) -> Tracker:
        self.next_id, block = int(next_id), np.array(numbers, np.float32).reshape(-1, 36)
        self.tracks = {
            int(i): Track(b[:4].copy(), b[4:20].reshape(4, 4).copy(), b[20:].reshape(4, 4).copy(), int(m)) for i, m, b in zip(ids, missed, block)
        }
        return self


def with_frame_axis(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """All sampled frames (video, frame), with their detections (det, x, y) or nulls."""
    return frames.select("video", "frame").join(detections.select("video", "frame", "det", "x", "y"), ["video", "frame"], "left")


def track(rows: DataFrame, gate: float = 200.0, max_missed: float = 5, noise=(0.01, 0.1, 0.1), prune: bool = False) -> DataFrame:
    """Tracks of detections (video, frame, det, x, y); rows without det are frames without detections."""
    dealt = (
        rows.select(F.col("video").cast("string").alias("video"), F.col("frame").cast("bigint").alias("frame"), F.col("det").cast("bigint").alias("det"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        .repartition("video")
        .sortWithinPartitions("video", "frame", "det")
    )
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, dets, tracker = None, [], None

        def done() -> list[tuple]:
            made = tracker.rows([(x, y) for _, x, y in dets])
            return [(*key, dets[c][0], *rest) for c, *rest in made]

        def packed(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for video, frame, det, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (video, frame):
                    if key is not None:
                        out += done()
                    if key is None or key[0] != video:
                        tracker = Tracker(gate, max_missed, noise, prune)
                    key, dets = (video, frame), []
                if det is not None:
                    dets.append((det, x, y))
            if out:
                yield packed(out)
        if key is not None and (out := done()):
            yield packed(out)

    return dealt.mapInArrow(run, OUT)
