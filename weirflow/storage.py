"""Intermediate tables in the folder that the cluster shares.

``write_table`` cuts the lineage by a Parquet table under
``spark.checkpoint.dir``: it survives the loss of an executor and is read back
column by column. Where that setting is missing, a local session gets a folder
of its own; a cluster without it is an error, since a machine's own temporary
folder cannot be read by the others.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Bytes of rows up to which a side may be broadcast, whatever its number of rows.
MAX_BROADCAST_BYTES = 64 << 20
_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session, set for local sessions if unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="weirflow-")
    return "file://" + _own[sc.applicationId]


def write_table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class Written:
    """A written table with its rows and their bytes at least, counted while it was written."""

    df: DataFrame
    rows: int
    bytes: int
    marked: int

    def fits(self, max_rows: int) -> bool:
        return self.rows <= max_rows and self.bytes <= MAX_BROADCAST_BYTES


def write_counted(df: DataFrame, name: str, mark: Column | None = None) -> Written:
    """As ``write_table``, with its size and the number of rows for which ``mark`` holds, without a job of their own."""
    seen = Observation()
    marked = [F.count(F.when(mark, 1)).alias("m")] if mark is not None else []
    out = write_table(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_bytes(df)), F.lit(0)).alias("b"), *marked), name)
    got = seen.get
    return Written(out, got["n"], got["b"], got.get("m", 0))


def drop_tables(spark: SparkSession | None = None) -> None:
    """Remove the intermediate tables; results read from them are then gone."""
    keep = []
    for owner, path in _made:
        if spark is not None and owner is not spark:
            keep.append((owner, path))
            continue
        with contextlib.suppress(Exception):
            jvm = owner.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = keep


atexit.register(drop_tables)


def _bytes(df: DataFrame) -> Column:
    """The bytes of a row at least: texts and nested values as text, 8 for anything else."""
    wide = ("string", "binary", "array", "map", "struct")
    each = [F.octet_length(F.col(f"`{c}`").cast("binary" if kind == "binary" else "string")) if kind.startswith(wide) else F.lit(8) for c, kind in df.dtypes]
    return reduce(Column.__add__, [F.coalesce(e.cast("bigint"), F.lit(0)) for e in each])


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df``, and their bytes at least."""
    r = df.select(_bytes(df).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_b"), F.lit(0)).alias("b")).first()
    return r.n, r.b


def small_or_plain(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows of ``max_bytes`` together.

    Rows and bytes are added up in the tasks first, so nothing that grows with
    the data is ever broadcast; beyond the limits the join shuffles, and AQE
    splits skewed partitions. Call it on a written table or a cheap plan, as
    that is read once for the sizes.
    """
    n, size = size_of(df)
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df
