"""Readers. Everything goes through Spark's own sources, so any store that Spark reads will do."""

from __future__ import annotations

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import exprs as X
from . import frames

#: What counts as an image in a dataset, in any case.
IMAGES = ("jpg", "jpeg", "png", "bmp", "tiff")
VIDEO_GLOB = "*.{mp4,MP4,avi,AVI,mov,MOV,mkv,MKV}"


def _file(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.col("_metadata.file_path"))


def _name(c="file"):
    return F.element_at(F.split(F.col(c), "/"), -1)


def tracking(spark: SparkSession, path: str) -> DataFrame:
    """Tracking files of a folder as text columns by name, training videos left out.

    Every file is read by its own header: columns can be in any order, columns a file lacks are null, others are not
    read; a file whose header has no frame or no id has no rows. ``row_no`` is the order inside a file, which is read whole
    (``multiLine``). As many columns are read as the widest header has, which a look at the lines finds first.
    """
    found = spark.read.option("pathGlobFilter", "*_tracking.csv").text(path).filter(F.contains("value", F.lit("frame")) & F.contains("value", F.lit("id")))
    widest = found.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    cells = F.array(*[f"_c{i}" for i in range(widest)])
    raw = spark.read.option("multiLine", True).option("pathGlobFilter", "*_tracking.csv").schema(", ".join(f"_c{i} string" for i in range(widest)))
    raw = _file(raw.csv(path)).select("file", F.monotonically_increasing_id().alias("row_no"), cells.alias("cells"))
    stem = F.regexp_replace(F.regexp_replace(_name(), r"\.csv$", ""), "_tracking", "")
    raw = raw.withColumn("stem", stem).filter(~F.col("stem").endswith("_Training"))
    # no value of a data row can be a column's name there, as frames and ids are numbers
    names = F.transform("cells", lambda c: F.ltrim(c, F.lit("\ufeff")))
    is_header = F.array_contains(names, "frame") & F.array_contains(names, "id")
    headers = raw.filter(is_header).groupBy("file").agg(F.min_by(names, "row_no").alias("header"))
    value = lambda c: F.get("cells", (F.array_position("header", c) - 1).cast("int")).alias(c)
    has = lambda c: F.when(F.array_position("header", c) > 0, value(c)).alias(c)
    rows = raw.filter(~F.coalesce(is_header, F.lit(False))).join(headers, "file")
    return rows.select("stem", "row_no", *[has(c) for c in schema.TRACKING_COLUMNS])


def group_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Raw metadata rows with ``line_no``; a folder without the file gives no rows."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except Exception as e:  # noqa: BLE001 - only an absent file is an empty table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema.METADATA_TEXT).withColumn("line_no", F.lit(0).cast("bigint"))
    missing = {f.name: F.lit(None).cast("string") for f in schema.METADATA_TEXT if f.name not in raw.columns}
    return raw.withColumns(missing).select(*schema.METADATA_TEXT.names).coalesce(1).withColumn("line_no", F.monotonically_increasing_id())


def files(spark: SparkSession, path: str, glob: str = VIDEO_GLOB) -> DataFrame:
    """Paths, names and stems of a tree's files, without reading them; of equal names the last path counts."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    found = found.select("path", _name("path").alias("name"), "modificationTime", "length")
    return found.groupBy("name").agg(F.max_by(F.struct("path", "modificationTime", "length"), "path").alias("f")).select("name", X.stem(F.col("name")).alias("stem"), "f.*")


def videos_in_order(spark: SparkSession, path: str, glob: str = VIDEO_GLOB) -> DataFrame:
    """All files of a tree (folder, name, path), also of equal names, by folder and name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"), _name("path").alias("name"), "path", "modificationTime").orderBy("folder", "name")


def has_files(spark: SparkSession, *folders: str) -> bool:
    """Whether any of the folders has a file whose name doesn't start with a dot; absent folders have none.

    Only names are listed, up to the first one that counts.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(conf)
        if store.exists(path):
            found = store.listFiles(path, True)
            while found.hasNext():
                if not found.next().getPath().getName().startswith("."):
                    return True
    return False


def has_annotations(spark: SparkSession, project: str) -> bool:
    """Whether a project has any image or label of either stream."""
    kinds = [f"{k}/{split}" for k in ("images", "labels") for split in ("train", "val")]
    return has_files(spark, *[f"{project}/annot_{stream}/{k}" for stream in ("motion", "static") for k in kinds])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = _file(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True))
    return raw.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lines with at least five fields: basename, line_no, cls, xc, yc, bw, bh."""
    part = F.split(F.trim("text"), r"\s+")
    rows = _lines(spark, path).filter(~F.col("file").endswith(".mask.txt"))
    return rows.filter(F.size(part) >= 5).select(
        F.regexp_replace(_name(), r"\.txt$", "").alias("basename"), "line_no", X.number(part[0], "int").alias("cls"),
        *[X.number(part[i]).alias(n) for i, n in ((1, "xc"), (2, "yc"), (3, "bw"), (4, "bh"))],
    ).na.drop()


def masks(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Mask rectangles of each basename; ``strict`` takes only lines of exactly four fields, else at least four."""
    part = F.split(F.trim("text"), r"\s+")
    fits = F.size(part) == 4 if strict else F.size(part) >= 4
    rows = _lines(spark, path).filter(F.col("file").endswith(".mask.txt") & fits)
    box = F.struct(*[X.number(part[i], "int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    return rows.groupBy(F.regexp_replace(_name(), r"\.mask\.txt$", "").alias("basename")).agg(F.array_sort(F.collect_list(F.struct("line_no", box.alias("box")))).alias("m")).select("basename", F.transform("m", lambda m: m["box"]).alias("boxes"))


def crops(spark: SparkSession, path: str) -> DataFrame:
    """Crop files under <primary>/<secondary>/, named by video, frame and corner."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,png}").load(path).select("path")
    part = F.split("path", "/")
    label, frame, x1, y1 = X.crop_parts(X.stem(_name("path")))
    return found.select(
        F.element_at(part, -3).alias("cls"), F.element_at(part, -2).alias("secondary"), label.alias("video"), frame.alias("frame"), x1.alias("x1"), y1.alias("y1"), "path"
    ).na.drop()


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """A training log with trimmed column names, as text."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def image_counts(spark: SparkSession, path: str) -> DataFrame:
    """Images of each leaf folder, one without a file in a folder below it; leaf folders without images have 0."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = found.withColumn("folder", F.regexp_replace("path", "/[^/]+$", ""))
    part = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(part)), lambda n: F.array_join(F.slice(part, F.lit(1), n), "/"))
    parents = found.select("folder").distinct().select(F.explode(above).alias("parent"), "folder").filter("parent <> folder")
    leaves = found.join(parents.select(F.col("parent").alias("folder")).distinct(), "folder", "left_anti")
    return leaves.groupBy("folder").agg(F.count_if(_is_image("path")).alias("images"))


def _is_image(path: str):
    return F.lower(F.substring_index(path, ".", -1)).isin(*IMAGES)


def dataset_count(spark: SparkSession, path: str) -> int:
    """Images of a dataset: of a YAML file its training folder's images or its list's lines, of a folder its leaf folders'.

    A YAML file without a training set, or whose training set is absent, counts 0.
    """
    if not path.endswith(".yaml"):
        return image_counts(spark, path).agg(F.sum("images")).first()[0] or 0
    content = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}
    if not content.get("train"):
        return 0
    train = content["train"] if "://" in content["train"] or content["train"].startswith("/") else f"{path.rpartition('/')[0]}/{content['train']}"
    try:
        if train.endswith(".txt"):
            return spark.read.text(train).count()
        return spark.read.format("binaryFile").load(train).select("path").filter(_is_image("path")).count()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def y4m_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """Grey frames of uncompressed YUV4MPEG2 videos: video, frame (from 1), width, height, px (bytes).

    Options are those of the source ``video_frames``: start, stop, framesPerPartition, scale.
    """
    spark.dataSource.register(frames.VideoFrames)
    return spark.read.format("video_frames").options(**options).load(path)


def camera(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same as a stream, following recordings that still grow; options framesPerBatch, framesPerPartition, scale and openSeconds."""
    spark.dataSource.register(frames.VideoFrames)
    return spark.readStream.format("video_frames").options(**options).load(path)
