"""Deterministic views that give the driver's tables the shape of the engine's inputs, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Behaviours that occur in the ``obs`` view.
DOMAIN = ("click", "graze", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking rows from events, as text columns named like a tracking file's."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    vid = F.expr("user_id div 25")  # so many tracks to a video; videos grow in number with the table
    frame = F.row_number().over(Window.partitionBy(vid).orderBy("ts", "event_id"))
    return e.select(
        F.concat(F.lit("cam_"), vid.cast("string"), F.lit("_x_y_herd"), (vid % 3).cast("string"), F.lit("_m.MP4")).alias("video_filename"),
        F.col("event_id").alias("row_no"),
        frame.cast("string").alias("frame"),
        F.col("user_id").cast("string").alias("id"),
        (F.col("event_id") * 37 % 1920).cast("string").alias("x"),
        (F.col("event_id") * 91 % 1080).cast("string").alias("y"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("primary_motion_class"),
        (F.get_json_object("props", "$.k").cast("double") / 100).cast("string").alias("primary_motion_conf"),
        F.when(F.col("event_id") % 4 == 0, "graze").otherwise("").alias("primary_static_class"),
        (F.col("event_id") % 100 / 100).cast("string").alias("primary_static_conf"),
    )


OBS = """
obs0 as (select concat('cam_', user_id // 25, '_x_y_herd', user_id // 25 % 3, '_m.MP4') as video_filename, event_id as row_no,
  row_number() over (partition by user_id // 25 order by ts, event_id) as frame, user_id as track_id,
  (event_id * 37 % 1920)::double as x, (event_id * 91 % 1080)::double as y,
  case when event_type = 'error' then '' else event_type end as mc, regexp_extract(props, '([0-9]+)', 1)::double / 100 as mf,
  case when event_id % 4 = 0 then 'graze' else '' end as sc, (event_id % 100)::double / 100 as sf from events),
obs as (select video_filename, row_no, frame, track_id, x, y,
  case when mc <> '' and mf >= sf then mc when sc <> '' then sc else 'unknown' end as behaviour from obs0)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections from embeddings: videos of ten frames of 25 boxes each."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i + 1).cast("double")
    x1, y1 = F.round((at(1) + 1) * 100).cast("int"), F.round((at(2) + 1) * 100).cast("int")
    return e.select(
        F.concat(F.lit("v"), F.expr("vec_id div 250").cast("string")).alias("video"), (F.col("vec_id") % 10).alias("frame"), F.col("vec_id").alias("det"), x1.alias("x1"), y1.alias("y1"),
        (x1 + F.round(F.abs(at(3)) * 80).cast("int") + 6).alias("x2"), (y1 + F.round(F.abs(at(4)) * 80).cast("int") + 6).alias("y2"),
        F.col("label").cast("string").alias("cls"), F.abs(at(5)).alias("conf"),
        F.when(F.col("vec_id") % 2 == 0, "static").otherwise("motion").alias("source"),
    )


BOXES = """
boxes0 as (select concat('v', vec_id // 250) as video, vec_id % 10 as frame, vec_id as det, round((embedding[2]::double + 1) * 100)::int as x1,
  round((embedding[3]::double + 1) * 100)::int as y1, round(abs(embedding[4]::double) * 80)::int + 6 as w, round(abs(embedding[5]::double) * 80)::int + 6 as h,
  label::varchar as cls, abs(embedding[6]::double) as conf, case when vec_id % 2 = 0 then 'static' else 'motion' end as source from embeddings),
boxes as (select video, frame, det, x1, y1, x1 + w as x2, y1 + h as y2, cls, conf, source from boxes0)"""


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from embeddings: 8 x 8 grey images, fifty to a video."""
    e = table(spark, sf_dir, "embeddings")
    px = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.rint((v.cast("double") + 1) * 127.5).cast("int"))))
    return e.select(F.expr("vec_id div 50").alias("video"), F.col("vec_id").alias("frame"), px.alias("px"))


GREY = """
grey as (select vec_id // 50 as video, vec_id as frame, list_transform(embedding, lambda v: greatest(0, least(255, round_even((v::double + 1) * 127.5, 0)::int))) as px from embeddings)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines from embeddings: twelve normalised boxes to a basename, a third of them augmented, five basenames to a clip."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.round(F.abs(F.element_at("embedding", i).cast("double")), 6)
    base = F.concat(F.lit("clip"), F.expr("vec_id div 60").cast("string"), F.lit("_"), F.expr("vec_id div 12").cast("string"))
    name = F.when(F.col("vec_id") % 3 == 0, F.concat(base, F.lit("_aug_flip_h"), F.when(F.col("vec_id") % 2 == 0, "_0").otherwise(""))).otherwise(base)
    return e.select(
        F.when(F.col("vec_id") % 2 == 0, "static").otherwise("motion").alias("stream"), F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"),
        name.alias("basename"), F.col("vec_id").alias("line_no"), F.col("label").alias("cls"),
        at(1).alias("xc"), at(2).alias("yc"), at(3).alias("bw"), at(4).alias("bh"),
    )


LABELS = """
labels0 as (select *, concat('clip', vec_id // 60, '_', vec_id // 12) as base from embeddings),
labels1 as (select case when vec_id % 2 = 0 then 'static' else 'motion' end as stream, case when vec_id % 5 = 0 then 'val' else 'train' end as split,
  case when vec_id % 3 = 0 then concat(base, '_aug_flip_h', case when vec_id % 2 = 0 then '_0' else '' end) else base end as basename, vec_id as line_no, label as cls,
  round(abs(embedding[1]::double), 6) as xc, round(abs(embedding[2]::double), 6) as yc, round(abs(embedding[3]::double), 6) as bw, round(abs(embedding[4]::double), 6) as bh from labels0)"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw group metadata from nations, one row for each of the first cameras and a later one that replaces it."""
    n = table(spark, sf_dir, "nation")
    cam = F.col("n_nationkey") % 5
    return n.select(
        F.when(F.col("n_nationkey") == 24, "").otherwise(F.concat(F.lit("cam_"), cam.cast("string"), F.lit("_x_y_herd"), (cam % 3).cast("string"), F.lit("_m.MP4"))).alias("video_filename"),
        F.col("n_name").alias("group_id"), F.when(F.col("n_regionkey") == 0, "").otherwise(F.lower("n_name")).alias("group_type"),
        F.concat(F.col("n_nationkey").cast("string"), F.lit("; "), (F.col("n_nationkey") * 7 % 150).cast("string"), F.lit(";x1")).alias("exclude_track_ids"),
        F.col("n_nationkey").alias("line_no"),
    )


METADATA = """
meta0 as (select case when n_nationkey = 24 then '' else concat('cam_', n_nationkey % 5, '_x_y_herd', n_nationkey % 5 % 3, '_m.MP4') end as video_filename, n_name as group_id,
  case when n_regionkey = 0 then '' else lower(n_name) end as group_type, [n_nationkey::bigint, (n_nationkey * 7 % 150)::bigint] as excluded, n_nationkey as line_no from nation),
meta as (select * from meta0 where video_filename <> '' qualify row_number() over (partition by video_filename order by line_no desc) = 1)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video table of the ``obs`` view: 30 frames a second, 1920 x 1080."""
    return raw_obs(spark, sf_dir).select("video_filename").distinct().select(
        "video_filename", F.lit(30.0).alias("fps"), F.lit(1920).alias("width"), F.lit(1080).alias("height")
    )
