"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of characters other than ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder; where none is set, a temporary one on a single machine, else one in the warehouse."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="ethospark-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def checkpointed(df: DataFrame, shrink: int = 1) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder.

    ``shrink``: write so many times fewer files than there are shuffle partitions, for tables much smaller than the
    data; a file costs the executors more than its few rows do.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(spark))
    if shrink > 1:
        df = df.coalesce(max(1, partitions(spark) // shrink))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Compute once and keep on the executors' disks; a lost part is computed again from its short lineage."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


#: Bytes that may be sent to all executors. Tables are measured before, and larger ones are joined by a shuffle.
SENT_BYTES = 32 << 20
#: A key with more rows than this is hot: where keys are too many to send, hot ones still are.
HOT_ROWS = 100_000


def is_small(df: DataFrame, row_bytes: str) -> bool:
    """Whether the table, at so many bytes a row (an SQL expression), is under ``SENT_BYTES``."""
    return (df.agg(F.sum(F.expr(row_bytes)).alias("n")).first()["n"] or 0) <= SENT_BYTES


def sent_if_small(df: DataFrame, row_bytes: str = "32") -> DataFrame:
    """A broadcast hint if the table is small (:func:`is_small`)."""
    return F.broadcast(df) if is_small(df, row_bytes) else df


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str, size: str, row_bytes: str = "64") -> DataFrame:
    """Inner join of rows with a table that has one row of each key and, as ``size``, how many rows have the key.

    A small table is sent. Of a large one the hot keys are sent, of which there are few as their rows are many, and
    only rows of other keys are shuffled, so that no task gets a hot key whole.
    """
    if is_small(per_key, row_bytes):
        return rows.join(F.broadcast(per_key), key)
    hot = per_key.filter(F.col(size) > HOT_ROWS)
    cold = rows.join(sent_if_small(hot.select(key), "16"), key, "left_anti").join(per_key.filter(F.col(size) <= HOT_ROWS), key)
    return rows.join(sent_if_small(hot, row_bytes), key).unionByName(cold)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(raw: bytes | None) -> str:
    """A text from its UTF-8 bytes: null is empty, bytes that are no UTF-8 become U+FFFD."""
    return (raw or b"").decode("utf-8", "replace")


#: Rows of a batch that become Python objects at a time.
ROWS = 1000


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(list of columns as Python lists) -> list of columns``, batch by batch. Strings arrive as UTF-8 bytes."""
    small_batches(df.sparkSession)
    names = T._parse_datatype_string(schema).names
    out = to_arrow(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                columns = [
                    (c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in part.columns
                ]
                made = fn(*columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=t) for v, t in zip(made, out, strict=True)], names=names
                )

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts have ``ROWS`` rows, unless the session has a size of its own.

    At the default of 10,000 rows, texts of some kilobytes make batches whose buffers, outside the heap on one side and
    in Python on the other, take a good part of a small executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS))


_KEPT: dict = {}


def new_token() -> str:
    """A key for :func:`per_worker`, made on the driver, that belongs to one model only."""
    return uuid.uuid4().hex


def per_worker(key: str, build):
    """What ``build`` makes, kept by a Python worker between its tasks (the last two keys only)."""
    if key not in _KEPT:
        while len(_KEPT) >= 2:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = build()
    return _KEPT[key]


def to_arrow(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in T._parse_datatype_string(schema).fields]


def veiled(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under column names of our own, so that no name of its columns can clash, and the names by theirs."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def doc_hash_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n: the fixed folds of the queries."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def words(text):
    """Array of the words of a text; nulls give an empty array."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES, -1), lambda w: w != "")


def ascii_lower(text: str):
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def span_digest(spans: str) -> tuple:
    """``kind:start:end`` joined by commas, for an array of structs already in the wanted order."""
    return F.array_join(
        F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


class Taken:
    """Spans of one text, none of them overlapping another, in any order of arrival; each look-up takes logarithmic time."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):  # those that overlap become one
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start

    def add(self, start: int, end: int) -> bool:
        """Take the span unless it overlaps; whether it was taken."""
        if self.overlaps(start, end):
            return False
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True
