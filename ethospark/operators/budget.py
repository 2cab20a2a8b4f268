"""Activity budgets: what each tracked individual did, how long it was there, and who looks like a stranger.

Input rows: video_filename, track_id, frame, row_no, x, y, behaviour (row_no is the order within a file). One shuffle
by (video, track) serves the window over a track's frames and the sums per track; all that follows works on one row
per track. A budget whose behaviours aren't given reads its rows once: their sums per track and behaviour are written to
the checkpoint folder, and the behaviours, the tracks and the videos' last frames are read from them. Rows are counted,
not distinct frames; the presence ratio divides by the last frame seen in the video's rows; ``unknown`` is a state and
part of every total, but gets no columns of its own.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

TRACK = ("video_filename", "track_id")
SHORT, SHORT_BORDER, MANUAL = "short_presence", "short_presence+border_entry", "manual_exclude"


def tracking_rows(raw: DataFrame, max_frame: int | None = None) -> DataFrame:
    """Text rows of tracking files to typed ones; rows without frame, id or position are dropped."""
    number = X.number
    zero = lambda c: F.coalesce(number(F.nullif(F.trim(F.col(c)), F.lit(""))), F.lit(0.0))
    rows = raw.select(
        *[c for c in raw.columns if c not in ("frame", "id", "x", "y") and not c.startswith(("primary_", "secondary_"))],
        number(F.col("frame"), "bigint").alias("frame"),
        number(F.col("id"), "bigint").alias("track_id"),
        number(F.col("x")).alias("x"),
        number(F.col("y")).alias("y"),
        X.behaviour(
            F.col("primary_motion_class"), zero("primary_motion_conf"), F.col("primary_static_class"), zero("primary_static_conf")
        ).alias("behaviour"),
    ).na.drop(subset=["frame", "track_id", "x", "y"])
    return limited(rows, max_frame)


def limited(rows: DataFrame, max_frame: int | None) -> DataFrame:
    """An analysis window's rows; 0 or None: all."""
    return rows.filter(F.col("frame") <= max_frame) if max_frame else rows


def window_frames(seconds: float, fps: float) -> int | None:
    return int(seconds * fps) or None if seconds > 0 else None


def behaviours(rows: DataFrame) -> list[str]:
    """The behaviours of all files, sorted, without ``unknown``: a handful of labels."""
    found = rows.select("behaviour").distinct().filter(~F.col("behaviour").isin("", X.UNKNOWN)).collect()
    return sorted(r[0] for r in found)


def with_entered(rows: DataFrame) -> DataFrame:
    """Add the behaviour before, in frame order with ties in file order, and whether the row enters a new one."""
    w = Window.partitionBy(*TRACK).orderBy("frame", "row_no")
    rows = rows.withColumn("previous", F.lag("behaviour").over(w))
    return rows.withColumn("entered", F.coalesce(F.col("previous") != F.col("behaviour"), F.lit(False)))


def frames_by_behaviour(rows: DataFrame, fps: float = 30.0) -> DataFrame:
    """Long form: frames, seconds and share of a track's rows, ``unknown`` included."""
    counted = rows.groupBy(*TRACK, "behaviour").agg(F.count("*").alias("frames"))
    total = F.sum("frames").over(Window.partitionBy(*TRACK))
    return counted.select(
        *TRACK, "behaviour", "frames", (F.col("frames") / F.lit(float(fps))).alias("seconds"), (100 * F.col("frames") / total).alias("pct")
    )


def transitions(rows: DataFrame) -> DataFrame:
    """How often each track enters each behaviour."""
    return with_entered(rows).filter("entered").groupBy(*TRACK, "behaviour").agg(F.count("*").alias("transitions"))


def by_behaviour(rows: DataFrame) -> DataFrame:
    """One row per track and behaviour: its rows and entries, first and last frame."""
    return (
        with_entered(rows)
        .groupBy(*TRACK, "behaviour")
        .agg(
            F.count("*").alias("n"),
            F.count_if("entered").alias("t"),
            F.min("frame").alias("first_seen_frame"),
            F.max("frame").alias("last_seen_frame"),
        )
    )


def kept(df: DataFrame) -> DataFrame:
    """Compute once, in the checkpoint folder; where none is set, in a temporary one on a single machine, else in the warehouse."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        warehouse = df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ethospark-") if sc.master.startswith("local") else f"{warehouse}/_checkpoints")
    return df.checkpoint()


def per_track(rows: DataFrame, domain: list[str], sums: DataFrame | None = None) -> DataFrame:
    """One row per track: rows, first and last frame, first position, and per behaviour its rows and entries.

    ``sums``: the rows' :func:`by_behaviour` if it is there already; the rows are read for first positions only then, and the
    optimizer leaves that join out where nobody asks for them.
    """
    own = [F.col("behaviour") == b for b in domain]
    at = F.min_by(F.struct("x", "y"), F.struct("frame", "row_no")).alias("at")
    if sums is None:
        each = [e for i, is_own in enumerate(own) for e in (F.count_if(is_own).alias(f"n{i}"), F.count_if(is_own & F.col("entered")).alias(f"t{i}"))]
        tracks = (
            with_entered(rows)
            .groupBy(*TRACK)
            .agg(F.count("*").alias("n_frames_present"), F.min("frame").alias("first_seen_frame"), F.max("frame").alias("last_seen_frame"), at, *each)
        )
    else:
        each = [F.sum(F.when(is_own, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i, is_own in enumerate(own) for c in ("n", "t")]
        tracks = sums.groupBy(*TRACK).agg(
            F.sum("n").alias("n_frames_present"), F.min("first_seen_frame").alias("first_seen_frame"), F.max("last_seen_frame").alias("last_seen_frame"), *each
        )
        tracks = tracks.join(rows.groupBy(*TRACK).agg(at), [*TRACK], "left")
    last = (tracks if sums is None else sums).groupBy("video_filename").agg(F.max("last_seen_frame").alias("max_frame"))
    return tracks.join(last, "video_filename")


def flagged(tracks: DataFrame, metadata: DataFrame | None, videos: DataFrame | None, min_presence: float, border: float, fps: float) -> DataFrame:
    """Add presence, border entry, the stranger flag with its reason, group columns, rate and type."""
    if metadata is not None:
        tracks = tracks.join(metadata.select("video_filename", "group_id", F.col("group_type").alias("own_type"), "excluded"), "video_filename", "left")
    else:
        tracks = tracks.withColumns(
            {"group_id": F.lit(""), "own_type": F.lit(None).cast("string"), "excluded": F.array().cast("array<bigint>")}
        )
    if videos is not None:
        tracks = tracks.join(videos.select("video_filename", F.col("fps").alias("_fps"), "width", "height"), "video_filename", "left")
    else:
        tracks = tracks.withColumns({c: F.lit(None).cast("double") for c in ("_fps", "width", "height")})
    presence = F.col("n_frames_present") / F.greatest(F.col("max_frame"), F.lit(1))
    short, manual = F.col("presence") < min_presence, F.coalesce(F.array_contains("excluded", F.col("track_id")), F.lit(False))
    return (
        tracks.withColumn("fps", F.coalesce("_fps", F.lit(float(fps))))
        .withColumn("group_id", F.coalesce("group_id", F.lit("")))
        .withColumn("presence", presence)
        .withColumn("border_entry", X.in_border(F.col("at.x"), F.col("at.y"), F.col("width"), F.col("height"), border))
        .withColumn("manual_exclude", manual)
        .withColumn("auto_flagged", short & ~manual)
        .withColumn("flag_reason", F.when(manual, MANUAL).when(short & F.col("border_entry"), SHORT_BORDER).when(short, SHORT).otherwise(""))
        .withColumn("individual_type", F.when(manual | short, "stranger").otherwise("group_member"))
    )


def _tracks(rows, domain, metadata, videos, fps, min_presence, border, separator, field_index, sums=None) -> DataFrame:
    tracks = flagged(per_track(rows, domain, sums), metadata, videos, min_presence, border, fps)
    return tracks.withColumn("group_type", X.group_type(F.col("video_filename"), separator, field_index, F.col("own_type")))


def dominant(domain: list[str], prefix: str):
    """The behaviour with the greatest value, the alphabetically first of equals; blank only without behaviours."""
    if not domain:
        return F.lit("")
    best = F.array_min(F.array(*[F.struct((-F.col(f"{prefix}{i}")).alias("v"), F.lit(b).alias("b")) for i, b in enumerate(domain)]))
    return best["b"]


def individual_budget(
    rows: DataFrame,
    metadata: DataFrame | None = None,
    videos: DataFrame | None = None,
    domain: list[str] | None = None,
    fps: float = 30.0,
    min_presence: float = 0.10,
    border: float = 0.15,
    separator: str = "_",
    field_index: int = 4,
    rounded: bool = True,
    ordered: bool = False,
) -> DataFrame:
    """One row per track with its time budget; three columns for each behaviour of the whole input."""
    sums = kept(by_behaviour(rows)) if domain is None else None
    domain = behaviours(sums) if domain is None else domain
    tracks = _tracks(rows, domain, metadata, videos, fps, min_presence, border, separator, field_index, sums)
    places = lambda c, n: F.bround(c, n) if rounded else c
    columns = [
        e
        for i, b in enumerate(domain)
        for e in (
            places(F.col(f"n{i}") / F.col("fps"), 2).alias(f"behavior_{b}_s"),
            F.col(f"t{i}").alias(f"behavior_{b}_n"),
            places(100 * F.col(f"n{i}") / F.col("n_frames_present"), 2).alias(f"behavior_{b}_pct"),
        )
    ]
    out = tracks.select(
        "video_filename", "group_id", "group_type", "track_id", "individual_type", "auto_flagged", "n_frames_present",
        places(F.col("n_frames_present") / F.col("fps"), 2).alias("duration_s"), places(F.col("presence"), 4).alias("presence_ratio"),
        *columns, dominant(domain, "n").alias("dominant_behavior_time"), dominant(domain, "t").alias("dominant_behavior_count"),
    )
    member_first = F.when(F.col("individual_type") == "group_member", 0).otherwise(1)
    return out.orderBy("video_filename", member_first, "track_id") if ordered else out


def suspects(
    rows: DataFrame,
    metadata: DataFrame | None = None,
    videos: DataFrame | None = None,
    fps: float = 30.0,
    min_presence: float = 0.10,
    border: float = 0.15,
    separator: str = "_",
    field_index: int = 4,
    rounded: bool = True,
    ordered: bool = False,
) -> DataFrame:
    """The tracks that are strangers, with the reason and when they were seen."""
    tracks = _tracks(rows, [], metadata, videos, fps, min_presence, border, separator, field_index)
    out = tracks.filter(F.col("individual_type") == "stranger").select(
        "video_filename", "group_id", "group_type", "track_id", "flag_reason",
        (F.bround("presence", 4) if rounded else F.col("presence")).alias("presence_ratio"), "first_seen_frame", "last_seen_frame",
        X.timecode(F.col("first_seen_frame"), F.col("fps")).alias("first_seen_timecode"),
        X.timecode(F.col("last_seen_frame"), F.col("fps")).alias("last_seen_timecode"), "border_entry", "auto_flagged", "manual_exclude",
    )
    return out.orderBy("video_filename", "track_id") if ordered else out


def tallies(budget: DataFrame) -> DataFrame:
    """Members and strangers of each video."""
    return budget.groupBy("video_filename").agg(
        F.count_if(F.col("individual_type") == "group_member").alias("members"),
        F.count_if(F.col("individual_type") == "stranger").alias("strangers"),
    )


def metadata_rows(raw: DataFrame, order: str) -> DataFrame:
    """Group metadata: blank file names are skipped, only all-digit ids kept, the last of duplicate rows wins."""
    ids = F.transform(
        F.filter(F.transform(F.split(F.coalesce("exclude_track_ids", F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s.rlike("^[0-9]+$")),
        lambda s: s.cast("bigint"),
    )
    rows = raw.withColumn("video_filename", F.trim("video_filename")).filter(F.col("video_filename") != "")
    last = rows.groupBy("video_filename").agg(F.max_by(F.struct("group_id", "group_type", ids.alias("excluded")), F.col(order)).alias("m"))
    return last.select("video_filename", F.trim(F.coalesce("m.group_id", F.lit(""))).alias("group_id"), F.trim(F.coalesce("m.group_type", F.lit(""))).alias("group_type"), "m.excluded")


#: Extensions of video files, the preferred first.
EXTENSIONS = (".MP4", ".mp4", ".avi", ".mov", ".mkv")


def video_files(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Each stem's video: by extension, then by tree (``tree`` 0: input, 1: clips); the bare stem where there is none."""
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(EXTENSIONS))):
        rank = F.when(F.col("name").endswith(EXTENSIONS[i]), i).otherwise(rank)
    known = files.withColumn("rank", rank).filter("rank is not null").withColumn("stem", X.stem(F.col("name")))
    best = known.groupBy("stem").agg(F.min(F.struct("tree", "rank", "name")).alias("b"))
    return tracks.join(best, "stem", "left").withColumn("video_filename", F.coalesce("b.name", "stem")).drop("b")
