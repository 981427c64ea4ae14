"""Reports (SNK-01..05, 09, 10, FLT-13, FLT-14, AGG-02, 03, 05..07, 09, 19, JOIN-14, JOIN-15, A13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ENGINE_ID, REPORT_SCHEMA, __version__
from ..functions.severity import PROFILE_TIER, TIER_ORDER, level_rank
from ..storage import small_or_plain
from .joins import new_since

#: Report level of each severity (fixed values).
SARIF_LEVEL = {"critical": "error", "warning": "warning", "info": "note"}


def gated(a: DataFrame, profile: str = "default", min_confidence: float = 0.0, min_level: str = "info", hygiene: bool = False) -> DataFrame:
    """Adds ``gate``: the first filter that drops a row, or 'kept'."""
    tier = F.create_map(*[x for k, v in TIER_ORDER.items() for x in (F.lit(k), F.lit(v))])
    low = {"info": 0, "warning": 1, "critical": 2}[min_level]
    late = F.coalesce(tier[F.col("tier")], F.lit(2)) > PROFILE_TIER[profile]
    return a.withColumn(
        "gate",
        F.when(late & ~((F.col("tier") == "hygiene") & F.lit(hygiene)), "below-tier").when(F.col("confidence") < min_confidence, "below-confidence")
        .when(level_rank(F.col("severity")) < low, "below-severity").otherwise("kept"),
    )


def ledger(rows: DataFrame) -> DataFrame:
    """Rows by gate (AGG-09)."""
    return rows.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def overlay(a: DataFrame, patterns: DataFrame) -> DataFrame:
    """Advisories with what a bundle says about their rule; its words win where it has any (JOIN-14)."""
    p = patterns.select("rule_id", *[F.col(c).alias(f"_{c}") for c in ("title", "observation", "impact", "improvement", "severity")])
    joined = a.join(small_or_plain(p, 100_000), "rule_id", "left")
    over = {c: F.coalesce(F.col(f"_{c}"), F.col(c) if c in a.columns else F.lit(None).cast("string")) for c in ("title", "observation", "impact", "improvement", "severity")}
    return joined.withColumns(over).drop(*[f"_{c}" for c in over])


def coverage(status: DataFrame, found: DataFrame) -> DataFrame:
    """One row: files found, analysed, failed, partial; distinct sites; sites left open; a sample of open files."""
    f = status.agg(
        F.count(F.lit(1)).alias("n_files"), F.count(F.when(F.col("error").isNull(), 1)).alias("n_analysed"),
        F.count(F.when(F.col("error").isNotNull(), 1)).alias("n_failed"), F.count(F.when(F.col("partial"), 1)).alias("n_partial"),
    )
    s = found.agg(F.count_distinct(F.struct("file", "line", "sink", "slot")).alias("n_sites"), F.count(F.when(F.col("verdict") == "unknown", 1)).alias("n_unknown"), F.count(F.when(F.col("verdict") == "vulnerable", 1)).alias("n_vulnerable"))
    sample = found.where("verdict = 'unknown'").select("file").distinct().orderBy("file").limit(25).agg(F.array_sort(F.collect_list("file")).alias("unresolved_sample"))
    return f.join(F.broadcast(s)).join(F.broadcast(sample))


def merge_coverage(parts: DataFrame, files: DataFrame, keys: list[str], sample: int = 25) -> DataFrame:
    """keys, n, n_files, sample: coverage of parts added up (AGG-06).

    ``parts`` holds keys and the sum n of each part, ``files`` keys and file; a
    file of several parts counts once, the first ``sample`` of them stay by name.
    """
    one = files.where(F.col("file").isNotNull()).select(*keys, "file").distinct()
    first = one.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("file")))
    united = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list(F.when(F.col("_r") <= sample, F.col("file")))).alias("sample"))
    total = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    same = reduce(Column.__and__, [total[k].eqNullSafe(united[k]) for k in keys])
    return total.join(united, same, "left").select(*[total[k] for k in keys], "n", F.coalesce("n_files", F.lit(0)).alias("n_files"), "sample")


def merge_phases(timings: DataFrame) -> DataFrame:
    """phase, total_ms, slowest_ms, n of telemetry rows (phase, ms) of any number of runs (AGG-07)."""
    return timings.groupBy("phase").agg(F.sum(F.col("ms").cast("decimal(38,0)")).alias("total_ms"), F.max("ms").alias("slowest_ms"), F.count(F.lit(1)).alias("n"))


def timing_stats(rows: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """keys, mean_s, min_ms, max_ms, n (AGG-19)."""
    return rows.groupBy(*keys).agg(F.round(F.avg(F.col(ms) / 1000.0), 3).alias("mean_s"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.count(F.lit(1)).alias("n"))


def statistics(found: DataFrame) -> DataFrame:
    """One row: arguments asked about, functions and slots they are in, and their verdicts (AGG-02)."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v}")
    return found.agg(F.count(F.lit(1)).alias("n_arguments"), F.count_distinct("fn").alias("n_functions"), F.count_distinct(F.struct("sink", "slot")).alias("n_slots"), *[n(v) for v in ("vulnerable", "unknown", "sanitized", "clean")])


def funnel(calls: DataFrame, sinks: DataFrame, top: int = 10) -> DataFrame:
    """stage, n, top: calls (callee, bound) by how far they came on the way to being a sink (AGG-03).

    A call bound to a function of the program is 'program-local', one whose last
    name is in ``sinks`` (sink) is a 'sink', a bare one is 'local', the rest is
    'not-a-sink', of which the ``top`` most frequent callees are named.
    """
    named = calls.withColumn("sink", F.element_at(F.split("callee", r"\."), -1)).join(small_or_plain(sinks.select("sink", F.lit(True).alias("_s")).distinct(), 100_000), "sink", "left")
    stage = F.when(F.col("bound"), "program-local").when(F.col("_s"), "sink").when(~F.contains("callee", F.lit(".")), "local").otherwise("not-a-sink")
    per = named.groupBy(stage.alias("stage"), "callee").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("stage").orderBy(F.col("k").desc(), "callee")
    ranked = per.withColumn("_r", F.row_number().over(order))
    best = F.when(F.col("stage") == "not-a-sink", F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "callee")))), lambda x: x["callee"]))
    return ranked.groupBy("stage").agg(F.sum("k").alias("n"), best.alias("top"))


def run_status(c: DataFrame) -> DataFrame:
    """Adds status (failed, partial, complete) and clean to a coverage row."""
    failed = (F.col("n_files") == 0) | (F.col("n_analysed") == 0)
    partial = (F.col("n_failed") > 0) | (F.col("n_partial") > 0)
    status = F.when(failed, "failed").when(partial, "partial").otherwise("complete")
    return c.withColumn("status", status).withColumn("clean", (F.col("status") == "complete") & (F.col("n_vulnerable") == 0) & (F.col("n_unknown") == 0))


def json_lines(a: DataFrame, producer: str = ENGINE_ID) -> DataFrame:
    """Each advisory as one JSON text (SNK-01); write with ``df.write.text``."""
    return a.select(F.to_json(F.struct(F.lit(REPORT_SCHEMA).alias("schema_version"), F.lit(f"{producer} {__version__}").alias("producer"), *a.columns)).alias("value"))


def sarif_runs(a: DataFrame, group: str = "family") -> DataFrame:
    """One SARIF 2.1.0 log per ``group`` (SNK-02): rules, results, fingerprints, code flows.

    A log is one JSON text, so give a group whose findings one machine can read.
    """
    level = F.create_map(*[x for k, v in SARIF_LEVEL.items() for x in (F.lit(k), F.lit(v))])[F.col("severity")]

    def place(file: Column, line: Column) -> Column:
        return F.struct(F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), F.struct(F.greatest(line, F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))

    flow = F.transform(F.coalesce("steps", F.array().cast(a.schema["steps"].dataType)), lambda s: F.struct(place(F.substring_index(s["func"], "::", 1), s["line"]).alias("location")))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(" ", F.col("source"), F.lit("reaches"), F.col("sink")).alias("text")).alias("message"),
        F.array(place(F.col("file"), F.col("line"))).alias("locations"), F.struct(F.col("fingerprint").alias("stable/v1")).alias("partialFingerprints"),
        F.array(F.struct(F.array(F.struct(flow.alias("locations"))).alias("threadFlows"))).alias("codeFlows"),
    )
    per = a.groupBy(group).agg(F.array_sort(F.collect_set(F.struct(F.col("rule_id").alias("id")))).alias("rules"), F.array_sort(F.collect_list(F.struct("file", "line", "rule_id", result.alias("r")))).alias("rs"))
    driver = F.struct(F.lit(ENGINE_ID).alias("name"), F.lit(__version__).alias("version"), F.col("rules").alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("rs", lambda x: x["r"]).alias("results"))
    log = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return per.select(group, F.to_json(log).alias("value"))


def _escaped(c: Column, more: bool) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *((((":", "%3A"), (",", "%2C"))) if more else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def annotations(a: DataFrame) -> DataFrame:
    """Workflow annotations, one line each (SNK-03)."""
    kind = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    head = F.concat(F.lit("::"), kind, F.lit(" file="), _escaped(F.col("file"), True), F.lit(",line="), F.col("line").cast("string"), F.lit(",title="), _escaped(F.col("rule_id"), True), F.lit("::"))
    return a.select(F.concat(head, _escaped(F.concat_ws(" ", "source", F.lit("reaches"), "sink"), False)).alias("value"))


def code_frames(a: DataFrame, files: DataFrame, around: int = 1, tab: int = 4) -> DataFrame:
    """file, line, n, text: the lines around each finding, tabs expanded (SNK-04)."""
    lines = files.join(a.select(F.col("file").alias("path")).distinct(), "path", "left_semi").select(F.col("path").alias("file"), F.posexplode(F.split("source", "\n")).alias("i", "text"))
    want = a.select("file", "line", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("n")).distinct()
    return want.join(lines.select("file", (F.col("i") + 1).alias("n"), F.replace("text", F.lit("\t"), F.lit(" " * tab)).alias("text")), ["file", "n"]).select("file", "line", "n", "text")


def save_baseline(a: DataFrame, path: str) -> None:
    a.select("fingerprint", "rule_id", "file", "line").write.mode("overwrite").parquet(path)


def since_baseline(a: DataFrame, path: str) -> DataFrame:
    """Advisories that a saved baseline lacks, each fingerprint once."""
    return new_since(a, a.sparkSession.read.schema("fingerprint string").parquet(path))


def diagnostics(a: DataFrame) -> DataFrame:
    """Editor diagnostics: 0-based lines, severity as 1 to 3 (SNK-07's rows)."""
    return a.select(F.col("file").alias("uri"), (F.greatest(F.col("line"), F.lit(1)) - 1).alias("line"), F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "warning", 2).otherwise(3).alias("severity"), F.col("rule_id").alias("code"))


def markdown_scorecard(scores: DataFrame, limit: int = 200) -> str:
    """A small scorecard (grp, tp, fp, fn, tn, tpr, fpr) as Markdown (SNK-09)."""
    rows = scores.orderBy("grp").limit(limit).collect()
    head = "| group | TP | FP | FN | TN | TPR | FPR |\n|---|---|---|---|---|---|---|\n"
    return head + "".join(f"| {r.grp} | {r.tp} | {r.fp} | {r.fn} | {r.tn} | {r.tpr:.3f} | {r.fpr:.3f} |\n" for r in rows)


def corpus_coverage(families: DataFrame) -> DataFrame:
    """Families per language and class (SNK-10)."""
    return families.groupBy("lang", F.col("meta")["class"].alias("class")).agg(F.count(F.lit(1)).alias("n_families"))
