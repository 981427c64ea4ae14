"""Watch streams: changed files, new findings, current diagnostics (STR-01..05).

Each micro-batch is one round. State lives in tables of the shared folder, one
part per batch id, so a batch that is run again overwrites its own part and
nothing is emitted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import new_since

#: Poll interval of a watch (fixed value).
INTERVAL = "500 milliseconds"


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, mtime_s) that are new or have another time; deletions say nothing (STR-02)."""
    old = before.select("path", F.col("mtime_s").alias("_old"))
    return now.join(old, "path", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("mtime_s"))).select("path", "mtime_s")


def snapshot(files: DataFrame) -> DataFrame:
    """path, mtime_s of walked files (STR-01); the greatest time of repeated paths."""
    return files.groupBy("path").agg(F.max(F.unix_seconds("mtime")).alias("mtime_s"))


def _read(spark: SparkSession, path: str, like: DataFrame, batch: int) -> DataFrame:
    try:
        return spark.read.schema(like.schema.add("batch", "long")).parquet(path).where(F.col("batch") < batch).drop("batch")
    except AnalysisException:
        return like.limit(0)


def watch(findings: DataFrame, state: str, emit: Callable[[DataFrame, int], None], key: str = "fingerprint", interval: str | None = INTERVAL) -> StreamingQuery:
    """Emit of each round the findings that no earlier round had (STR-03).

    ``findings`` is a stream; ``state`` a folder of the shared storage. With
    ``interval`` None all that is there is taken, then the query ends.
    """

    def round_(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = _read(spark, f"{state}/seen", batch.select(key), number)
        fresh = new_since(batch, seen, key).persist()
        emit(fresh, number)
        fresh.select(key).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{state}/seen")
        fresh.unpersist()

    out = findings.writeStream.foreachBatch(round_).option("checkpointLocation", f"{state}/checkpoint")
    return (out.trigger(availableNow=True) if interval is None else out.trigger(processingTime=interval)).start()


def current_diagnostics(stream: DataFrame, key: str = "uri", version: str = "version", count: str = "n") -> DataFrame:
    """Per document the state after its latest save (STR-04): an older save never replaces a newer one."""
    kind = stream.schema[key].dataType.simpleString()

    def latest(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v, n = state.get if state.exists else (-1, 0)
        before = v
        for p in parts:
            i = p[version].idxmax()
            if p.loc[i, version] > v:
                v, n = int(p.loc[i, version]), int(p.loc[i, count])
        if v != before:
            state.update((v, n))
            yield pd.DataFrame({key: [k[0]], version: [v], count: [n]})

    return stream.groupBy(key).applyInPandasWithState(latest, f"{key} {kind}, {version} long, {count} long", f"{version} long, {count} long", "update", GroupStateTimeout.NoTimeout)


def distinct_within(stream: DataFrame, at: str, keys: list[str], delay: str) -> DataFrame:
    """Each key once as long as its repetitions arrive within ``delay``; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
