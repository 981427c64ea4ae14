"""Scans: lower once, ask many times (UDF-05..08)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ENGINE_ID, REPORT_SCHEMA, __version__
from .operators import checks, report, taint
from .operators import facts as K
from .operators.program import Program
from .session import ship
from .sources import diffs, files
from .sources.corpus import BUNDLE_VERSIONS, vocabulary_fingerprint
from .storage import write_table

FACT_KINDS = sorted(K.KINDS)
#: Policies and rules on named arguments in one bundle.
MAX_POLICIES = 1_000


@dataclass
class ScanOptions:
    """What a scan reports; the facts default to the seed vocabulary, on which a ``bundle`` is laid (see ``facts``)."""

    profile: str = "default"
    min_confidence: float = 0.0
    min_level: str = "info"
    hygiene: bool = False
    languages: tuple[str, ...] = ()
    sources: DataFrame | None = None
    sinks: DataFrame | None = None
    sanitizers: DataFrame | None = None
    bundle: DataFrame | None = None
    registry: tuple = field(default=checks.REGISTRY)


class Scan:
    """A program under the facts of one scan. Its tables are made when first asked for."""

    def __init__(self, source_files: DataFrame, options: ScanOptions | None = None) -> None:
        """``source_files`` holds path and source (language and family are added if missing)."""
        ship(source_files.sparkSession)
        self.options = options or ScanOptions()
        rows = source_files if "language" in source_files.columns else files.with_language(source_files)
        if self.options.languages:
            rows = rows.where(F.col("language").isin(*self.options.languages))
        self.files = rows
        self.program = Program.of(rows)

    @staticmethod
    def of_folder(spark: SparkSession, root: str, options: ScanOptions | None = None) -> Scan:
        return Scan(files.read_files(spark, root), options)

    def with_options(self, options: ScanOptions) -> Scan:
        """The same lowered program under other facts."""
        other = object.__new__(Scan)
        other.options, other.files, other.program = options, self.files, self.program
        return other

    def facts(self, kind: str) -> DataFrame:
        """The facts of one kind that this scan goes by."""
        given = getattr(self.options, kind, None)
        return given if given is not None else K.layered(self.files.sparkSession, kind, self.options.bundle)

    @cached_property
    def findings(self) -> DataFrame:
        kinds = ("sinks", "sources", "sanitizers", "propagators")
        return write_table(taint.findings(self.program, *[self.facts(k) for k in kinds]), "findings")

    @cached_property
    def checks(self) -> DataFrame:
        return checks.run(self.program, (*self.options.registry, *self._authored()))

    def _authored(self) -> list[tuple[str, checks.Check]]:
        """Checks that a bundle's policies and rules ask for."""
        bundle = self.options.bundle
        if bundle is None:
            return []
        out: list[tuple[str, checks.Check]] = []
        for kind in ("policies", "named"):
            rows = K.taught(bundle, kind).drop("_layer", "_seq", "family").distinct().limit(MAX_POLICIES + 1).collect()
            if len(rows) > MAX_POLICIES:
                raise ValueError(f"more than {MAX_POLICIES} {kind} in one bundle")
            for r in sorted(rows, key=repr):
                if kind == "policies":
                    out.append((f"policy {r.trigger}", lambda p, r=r: checks.guard_before(p, r.trigger, r.guards or [], r.rule)))
                else:
                    out.append((f"named {r.call}.{r.name}", lambda p, r=r: checks.named_argument(p, r.call, r.name, r.rule, r.required or (), r.banned or ())))
        return out

    @property
    def gated(self) -> DataFrame:
        o = self.options
        return report.gated(taint.advisories(self.findings), o.profile, o.min_confidence, o.min_level, o.hygiene)

    @property
    def advisories(self) -> DataFrame:
        return self.gated.where("gate = 'kept'").drop("gate")

    @property
    def coverage(self) -> DataFrame:
        return report.run_status(report.coverage(self.program.status, self.findings))

    @property
    def silent(self) -> DataFrame:
        return taint.explain(self.findings)

    def in_diff(self, diff: DataFrame) -> DataFrame:
        """Advisories on lines that a patch adds (DIF-02)."""
        return diffs.in_diff(self.advisories.withColumnRenamed("file", "file_path"), diffs.added_ranges(diff))


def identity(spark: SparkSession) -> DataFrame:
    """One row: engine, version, report schema, bundle version, vocabulary fingerprint (UDF-08)."""
    row = [(ENGINE_ID, __version__, REPORT_SCHEMA, BUNDLE_VERSIONS[1], vocabulary_fingerprint(FACT_KINDS))]
    return spark.createDataFrame(row, "engine string, version string, report_schema int, bundle_version int, vocabulary string")
