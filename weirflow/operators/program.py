"""Programs as tables: lowering, call binding, cross-function edges (LOW, JOIN-01..12, GR-03, GR-04, GR-09).

Files are lowered once, in the executors, to one nested row each; the parts are
columns of that written table, so a query reads just those it uses. What crosses
functions is joins over all files of a language family at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..frontends import FRONTENDS, TAUGHT, schema
from ..storage import write_table

#: Methods whose names are those of every container; never bound by their bare name (fixed values).
CONTAINER_VERBS = ("get", "set", "add", "append", "push", "pop", "insert", "remove", "delete", "has", "keys", "values", "items", "update", "clear", "map", "filter", "forEach", "find", "join", "split")
#: Re-exports that are followed.
MAX_REEXPORTS = 12


def lower_files(files: DataFrame, roles: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """One nested row per file of ``files`` (path, language, family, source); see ``frontends.schema``.

    ``roles`` gives, per language, keywords that facts teach (see ``frontends.lexical``).

    A file whose text cannot be parsed, or is null, has an error and no parts;
    it never fails the task.
    """
    kind = _parse_datatype_string(schema.LOWERED)
    wanted = to_arrow_schema(kind)

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, family, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = {"file": path, "lang": lang, "family": family, "module": None, "error": None, "partial": False, **{p: [] for p in schema.PARTS}}
                try:
                    taught = (roles or {}).get(lang)
                    row |= FRONTENDS[lang](path, source, taught) if taught and lang in TAUGHT else FRONTENDS[lang](path, source)
                except RecursionError:
                    row["error"] = "nested too deeply"
                except Exception as e:  # noqa: BLE001 - one file's failure is its own
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    return files.select("path", "language", "family", "source").mapInArrow(lower, kind)


@dataclass
class Program:
    """The tables of a lowered program. Lower once, query often."""

    lowered: DataFrame
    _parts: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @staticmethod
    def of(files: DataFrame, roles: dict[str, dict[str, str]] | None = None) -> Program:
        supported = files.where(F.col("language").isin(*FRONTENDS))
        # parsing costs far more than its bytes, so the parts must not be coalesced by size
        spark = files.sparkSession
        parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return Program(write_table(lower_files(supported.repartition(parts, "family", "path"), roles), "lowered"))

    def part(self, name: str) -> DataFrame:
        """One flat table of the program, written when it is first asked for."""
        if name not in self._parts:
            rows = self.lowered.select("file", "family", "module", F.explode(name).alias("x"))
            self._parts[name] = write_table(rows.select("file", "family", "module", "x.*"), name)
        return self._parts[name]

    @property
    def status(self) -> DataFrame:
        return self.lowered.select("file", "lang", "family", "error", "partial")

    @cached_property
    def bindings(self) -> DataFrame:
        """call, callee (function), shift: the calls whose callee is a function of the program.

        In this order: a function of the same file, one by its full name, one
        reached through re-exports, a class' constructor, then, for a call by a
        bare name only, the only function of that name that is no method: a method
        of a receiver whose class is unknown is bound to nothing. A method's
        receiver is its first parameter (shift 1). What is called through a
        variable or parameter is bound to the functions that are given for it.
        """
        functions = self.part("functions").select("family", "file", "fn", "qual", F.concat_ws(".", "module", "qual").alias("full"), F.size("params").alias("n"))
        calls = self.part("calls").select("family", "file", "call", "resolved", "callee").where("resolved <> ''")
        targets = calls.select("family", "resolved").distinct().withColumn("to", F.col("resolved"))
        imports = self.part("imports").where("symbol is not null").select("family", F.concat_ws(".", "module", "local").alias("to"), F.concat_ws(".", "package", "symbol").alias("_next")).distinct()
        names = functions.select("family", F.col("full").alias("to")).distinct()
        for _ in range(MAX_REEXPORTS):
            open_ = targets.join(names, ["family", "to"], "left_anti").join(imports, ["family", "to"]).where("_next <> to")
            moved = open_.groupBy("family", "resolved").agg(F.min("_next").alias("_next"))
            if moved.isEmpty():
                break
            targets = write_table(targets.join(moved, ["family", "resolved"], "left").select("family", "resolved", F.coalesce("_next", "to").alias("to")), "targets")
        c = calls.join(targets, ["family", "resolved"])
        bare = functions.withColumn("bare", F.element_at(F.split("qual", r"\."), -1))
        only = bare.where(~F.contains("qual", F.lit("."))).groupBy("family", "bare").agg(F.min("fn").alias("fn"), F.min("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k = 1")
        local = functions.select("family", "file", F.col("qual").alias("to"), "fn", "n")
        full = functions.select("family", F.col("full").alias("to"), "fn", "n")
        init = F.concat("to", F.lit(".__init__"))
        found = [
            (1, c.join(local, ["family", "file", "to"])),
            (2, c.join(full, ["family", "to"])),
            (3, c.withColumn("to", init).join(local, ["family", "file", "to"])),
            (4, c.withColumn("to", init).join(full, ["family", "to"])),
            (5, c.where(~F.contains("callee", F.lit(".")) & ~F.col("to").isin(*CONTAINER_VERBS)).withColumn("bare", F.element_at(F.split("to", r"\."), -1)).where(F.col("callee") == F.col("bare")).join(only, ["family", "bare"])),
        ]
        out = None
        for rank, df in found:
            one = df.select("call", "callee", F.col("fn").alias("target"), F.lit(rank).alias("rank"), F.col("to").endswith(".__init__").alias("init") if rank in (3, 4) else F.lit(False).alias("init"))
            out = one if out is None else out.unionByName(one)
        first = out.withColumn("_r", F.row_number().over(Window.partitionBy("call").orderBy("rank", "target"))).where("_r = 1")
        receivers = self.part("functions").select(F.col("fn").alias("target"), F.try_element_at("params", F.lit(1)).alias("_p")).join(self.part("nodes").select(F.col("node").alias("_p"), "path"), "_p")
        method = receivers.where(F.col("path").isin("self", "cls")).select("target", F.lit(1).alias("shift"))
        bound = write_table(first.join(method, "target", "left").select("call", F.col("target").alias("callee"), F.coalesce("shift", F.lit(0)).alias("shift"), "init"), "bindings")
        return write_table(bound.unionByName(self._callbacks(bound)), "bindings")

    def _callbacks(self, bound: DataFrame) -> DataFrame:
        """Calls of what a variable or parameter holds: functions given for it by name, here or by a caller (JOIN-12)."""
        flows = self.part("edges").where("kind = 'flow'").select("node", "next")
        own = self.part("nodes").where("kind = 'function'").select("node", F.col("path").alias("target"))
        held = own.unionByName(flows.join(own.withColumnRenamed("node", "next"), "next").select("node", "target"))
        args = self.part("args").select("call", "slot", "node").where("node is not null")
        given = args.where("slot >= 0").join(held, "node").join(bound.where("not init"), "call").select("callee", (F.col("slot") + F.col("shift")).alias("slot"), "target")
        params = self.part("functions").select(F.col("fn").alias("callee"), F.posexplode("params").alias("slot", "node"))
        taken = given.join(params, ["callee", "slot"]).select("node", "target")
        known = held.unionByName(taken)
        called = args.where("slot = -2").select("call", "node")
        hit = called.join(known, "node").select("call", "target").unionByName(called.join(flows, "node").select("call", F.col("next").alias("node")).join(taken, "node").select("call", "target"))
        return hit.distinct().join(bound.select("call"), "call", "left_anti").select("call", F.col("target").alias("callee"), F.lit(0).alias("shift"), F.lit(False).alias("init"))

    @cached_property
    def edges(self) -> DataFrame:
        """Backward edges node, next, kind, site over the whole program."""
        own = self.part("edges").select("node", "next", "kind", "site")
        b = self.bindings
        # a bound call passes on what its callee returns, not its arguments as such
        own = own.join(b.select(F.col("call").alias("site"), F.lit("through").alias("kind")), ["site", "kind"], "left_anti").select("node", "next", "kind", "site")
        calls = self.part("calls").select("call", "result")
        functions = self.part("functions").select("fn", "params", "ret")
        enter = b.where("not init").join(calls, "call").join(functions, F.col("callee") == F.col("fn")).select(F.col("result").alias("node"), F.col("ret").alias("next"), F.lit("enter").alias("kind"), F.col("call").alias("site"))
        params = functions.select(F.col("fn").alias("callee"), F.posexplode("params").alias("slot", "param"))
        named = params.join(self.part("nodes").select(F.col("node").alias("param"), F.col("path").alias("name")), "param")
        args = self.part("args").where("node is not null").join(b, "call")
        by_slot = args.where("name is null and (slot >= 0 or slot = -1 and shift = 1)").withColumn("slot", F.when(F.col("slot") < 0, F.lit(0)).otherwise(F.col("slot") + F.col("shift"))).where("not (slot = 0 and shift = 1 and init)")
        leave = by_slot.join(named.drop("name"), ["callee", "slot"]).unionByName(args.where("name is not null").drop("slot").join(named, ["callee", "name"]).select(*by_slot.columns, "param"))
        leave = leave.select(F.col("param").alias("node"), F.col("node").alias("next"), F.lit("leave").alias("kind"), F.col("call").alias("site"))
        return own.unionByName(enter).unionByName(leave)
