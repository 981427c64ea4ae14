"""Queries that run the code frontends over the samples of all families.

Lowering and the taint walk have no counterpart in SQL over text; the tests hold
them against probes with known answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.severity import default_level
from ..operators import memory, report
from ..operators import mining as M
from ..scan import Scan, ScanOptions
from ..session import table
from ..sources import files
from ..storage import shared_folder
from ..streaming.watch import watch
from .base import Book
from .texts import call_names

book = Book()


def sample_files(spark: SparkSession, d: str) -> DataFrame:
    """All code samples as files of their family and variant; one without an extension is taken for its family's language."""
    f = table(spark, d, "families")
    known = F.create_map(*[F.lit(x) for pair in (("python", "py"), ("js", "js"), ("go", "go"), ("rust", "rs"), ("c", "c")) for x in pair])
    parts = [f.select("fam_no", known[F.col("lang")].alias("usual"), F.lit(v).alias("variant"), F.posexplode(c).alias("i", "m")) for v, c in (("positive", "positives"), ("negative", "negatives"))]
    s = parts[0].unionByName(parts[1]).where("m.source is not null").withColumn("ext", F.coalesce("m.ext", "usual"))
    path = F.concat_ws("/", F.concat(F.lit("f"), "fam_no"), "variant", F.concat_ws(".", "i", "ext"))
    return files.with_language(s.select(path.alias("path"), F.col("m.source").alias("source")))


def learned_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Calls that two families or more show in their positives only, as sinks of every slot."""
    votes = M.votes(M.proposals(call_names(spark, d)).where("kind = 'sink'"), ["lang", "name"]).where("status = 'confirmed' and lang is not null")
    each = F.explode(F.array(F.lit(True), F.lit(False))).alias("receiver")
    return votes.select(F.col("lang").alias("family"), F.col("name").alias("sink"), F.lit("command").alias("label"), F.array().cast("array<int>").alias("slots"), each)


@book.query("low_inventory")
def low_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files, failures, functions and calls per language."""
    p = Scan(sample_files(spark, d)).program
    parts = p.lowered.select("lang", F.col("error").isNotNull().alias("failed"), F.size("functions").alias("f"), F.size("calls").alias("c"), F.size("edges").alias("e"))
    return parts.groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("failed").cast("int")).alias("n_failed"), F.sum("f").alias("n_functions"), F.sum("c").alias("n_calls"), F.sum("e").alias("n_edges"))


@book.query("gr04_call_bindings")
def gr04(spark: SparkSession, d: str) -> DataFrame:
    """Calls that are bound to a function of the program, per language family."""
    p = Scan(sample_files(spark, d)).program
    calls = p.part("calls").join(p.bindings.select("call", "callee").withColumnRenamed("callee", "target"), "call", "left")
    return calls.groupBy("family").agg(F.count(F.lit(1)).alias("n_calls"), F.count("target").alias("n_bound"))


@book.query("gr10_code_verdicts")
def gr10_code(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of all sink arguments in the samples, the sinks being those the samples themselves teach."""
    found = Scan(sample_files(spark, d), ScanOptions(sinks=learned_sinks(spark, d))).findings
    return found.groupBy("family", "label", "verdict").agg(F.count(F.lit(1)).alias("n"))


@book.query("agg15_memory_contracts")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the samples per language family: how many return fresh memory, release a parameter, misuse it."""
    p = Scan(sample_files(spark, d)).program
    s = memory.summaries(p)
    flag = lambda df, name: df.select("fn").distinct().withColumn(name, F.lit(1))
    f = p.part("functions").select("family", "fn").join(flag(s.fresh, "fresh"), "fn", "left").join(flag(s.consumes, "consumes"), "fn", "left").join(flag(memory.misuse(p, s), "misuse"), "fn", "left")
    n = lambda c: F.count(c).alias(f"n_{c}")
    return f.groupBy("family").agg(F.count(F.lit(1)).alias("n_functions"), n("fresh"), n("consumes"), n("misuse"))


@book.query("chk_registry")
def chk_registry(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all checks in the samples, by rule."""
    found = Scan(sample_files(spark, d)).checks
    return found.groupBy("check", "rule").agg(F.count(F.lit(1)).alias("n"))


_ESC = "replace(replace(replace({0}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
_ESC_ALL = f"replace(replace({_ESC}, ':', '%3A'), ',', '%2C')"


@book.query("snk03_annotations", f"""
with c as (select finding_id, sink_role, sink, source_desc, unnest(cut_sites) as s from sink_findings),
a as (select case when sink_role in ('execution', 'other') then 'error' when sink_role in ('resource', 'storage', 'crypto', 'xss') then 'warning' else 'notice' end as level, s.file as file, s.line as line, s.kind as rule_id, source_desc, sink from c where s is not null and s.file is not null and s.line is not null and s.kind is not null)
select '::' || level || ' file=' || {_ESC_ALL.format('file')} || ',line=' || line || ',title=' || {_ESC_ALL.format('rule_id')} || '::' || {_ESC.format("concat_ws(' ', source_desc, 'reaches', sink)")} as value from a
""")  # fmt: skip
def snk03(spark: SparkSession, d: str) -> DataFrame:
    """Annotation lines of all cut sites of findings."""
    c = table(spark, d, "sink_findings").select("sink_role", "sink", F.col("source_desc").alias("source"), F.explode("cut_sites").alias("s"))
    level = F.coalesce(default_level(F.col("sink_role")), F.lit("info"))
    a = c.select("sink", "source", level.alias("severity"), F.col("s.file").alias("file"), F.col("s.line").alias("line"), F.col("s.kind").alias("rule_id"))
    return report.annotations(a.where("file is not null and line is not null and rule_id is not null"))


@book.query("str01_watch", "select md5(concat_ws(chr(31), user_id, event_type)) as fingerprint, 0 as round from events group by 1")
def str01(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of findings: what each round has that none had before."""
    import uuid

    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d) if not _is_folder(spark, f"{d}/events.parquet") else spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet")
    at = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    found = stream.select(X.fingerprint(F.col("user_id"), F.col("event_type")).alias("fingerprint"))

    def emit(fresh: DataFrame, number: int) -> None:
        fresh.select("fingerprint").withColumn("round", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/n={number}")

    watch(found, at, emit, interval=None).awaitTermination()
    return spark.read.schema("fingerprint string, round int").parquet(f"{at}/out").select("fingerprint", F.col("round").cast("int").alias("round"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
