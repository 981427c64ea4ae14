"""Corpora, header blocks, ground truth and manifests (SRC-10, 11, 13..17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_LINES = 30
#: Version range of fact bundles that can be read.
BUNDLE_VERSIONS = (1, 1)
FACT_SCHEMA = "kind string, lang string, package string, key string, payload string, provenance int, layer int"


def group_families(files: DataFrame) -> DataFrame:
    """path, family, variant, heldout of corpus files; a stem in several languages is split by language.

    The family is what stands before the first '_positive' or '_negative' of a
    file's name; other files belong to none.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_extract(name, r"^(.*?)_(?:positive|negative)", 1)
    variant = F.regexp_extract(name, r"_(positive|negative)", 1)
    rows = files.withColumns({"stem": stem, "variant": variant, "heldout": F.contains(name, F.lit("_heldout_"))}).where("variant <> ''")
    langs = rows.groupBy("stem").agg(F.count_distinct("family_lang").alias("n"))
    return rows.join(langs, "stem").withColumn("family", F.when(F.col("n") > 1, F.concat_ws(".", "stem", "family_lang")).otherwise(F.col("stem"))).drop("n", "stem")


def header_block(source: Column, name: str = "weirflow") -> Column:
    """Key-value map of the comment block '[name]' within the first 30 lines; the first of equal keys holds."""
    lines = F.transform(F.slice(F.split(source, "\r?\n"), F.lit(1), F.lit(BLOCK_LINES)), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?://+|#+|/?\*+|--)?\s?", "")))
    at = F.array_position(lines, F.lit(f"[{name}]"))
    after = F.when(at > 0, F.slice(lines, (at + 1).cast("int"), F.lit(BLOCK_LINES)))
    pairs = F.filter(after, lambda x: x.rlike(r"^[a-z][a-z0-9-]*\s*:"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([a-z][a-z0-9-]*)", 1).alias("k"), F.regexp_extract(x, r"^[^:]*:\s*(.*)$", 1).alias("v"))
    entries = F.transform(pairs, entry)
    first = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(first)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, category, vulnerable, cwe of a ground-truth CSV with '#' comments."""
    return spark.read.csv(path, schema="id string, category string, vulnerable boolean, cwe string", comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def markers(files: DataFrame, pattern: str = r"vuln-code-snippet\s+vuln-line\s+(.*)") -> DataFrame:
    """challenge, file and line of each inline marker; a marker may name several challenges."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("source", "\n")).alias("at", "text")).where(F.col("text").rlike(pattern))
    names = F.split(F.trim(F.regexp_extract("text", pattern, 1)), r"[\s,]+")
    return lines.select(F.explode(names).alias("challenge"), "file", (F.col("at") + 1).alias("line")).where("challenge <> ''")


def check_manifest(manifest: DataFrame) -> DataFrame:
    """Rows of a manifest of pinned repositories whose revision is no full hash."""
    return manifest.where(~F.coalesce(F.col("sha").rlike("^[0-9a-f]{40}$"), F.lit(False)))


def vocabulary_fingerprint(kinds: list[str]) -> str:
    """Fingerprint of the fact kinds and their schema; a bundle must have the same."""
    import hashlib

    return hashlib.sha256("\n".join([FACT_SCHEMA, *sorted(kinds)]).encode()).hexdigest()


def write_bundle(facts: DataFrame, path: str, kinds: list[str]) -> None:
    """Facts and a manifest row, as Parquet."""
    spark = facts.sparkSession
    facts.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/facts")
    spark.createDataFrame([(BUNDLE_VERSIONS[1], vocabulary_fingerprint(kinds))], "version int, fingerprint string").write.mode("overwrite").parquet(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """The facts of a bundle whose version and vocabulary fit."""
    row = spark.read.schema("version int, fingerprint string").parquet(f"{path}/manifest").first()
    if row is None or not BUNDLE_VERSIONS[0] <= row.version <= BUNDLE_VERSIONS[1]:
        raise ValueError("bundle of another version")
    if row.fingerprint != vocabulary_fingerprint(kinds):
        raise ValueError("bundle of another vocabulary")
    return spark.read.schema(FACT_SCHEMA).parquet(f"{path}/facts")


def fact_counts(facts: DataFrame) -> DataFrame:
    """Facts of each kind (UDF-10)."""
    return facts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
