from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.streaming.watch import changed_files, current_diagnostics, watch


def test_rounds_emit_only_what_is_new(spark, rows, tmp_path):
    src, state, out = tmp_path / "in", str(tmp_path / "state"), []
    for day, found in enumerate((["a", "b"], ["b", "c", "c"], [])):
        spark.createDataFrame([(f,) for f in found], "fingerprint string").coalesce(1).write.mode("append").parquet(str(src))
        q = watch(spark.readStream.schema("fingerprint string").parquet(str(src)), state, lambda df, n: out.append((n, sorted(r.fingerprint for r in df.collect()))), interval=None)
        q.awaitTermination()
        assert day >= 0
    assert out[:2] == [(0, ["a", "b"]), (1, ["c"])] and all(not x for _, x in out[2:])


def test_changed_files(spark, rows):
    now = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], "path string, mtime_s long")
    before = spark.createDataFrame([("a", 1), ("b", 2), ("gone", 1)], "path string, mtime_s long")
    assert rows(changed_files(now, before)) == [("b", 3), ("c", 1)]


def test_latest_save_wins(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("u", 2, 5), ("u", 1, 9), ("v", 1, 0)], "uri string, version long, n long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("uri string, version long, n long").option("maxFilesPerTrigger", 1).parquet(src)
    q = current_diagnostics(stream).writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.uri: (r.version, r.n) for r in spark.table("latest").collect()}
    assert got == {"u": (2, 5), "v": (1, 0)} and spark.table("latest").where(F.col("uri") == "u").count() == 1
