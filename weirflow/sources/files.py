"""Source files as tables (SRC-01..06, 09): walking, pruning, languages.

A folder is read with Spark's binaryFile source, whose length filter is pushed
to the listing; content is only read for files that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are not walked (fixed values).
PRUNED = ("target", "node_modules", "dist", "build", "vendor", "out", ".next", ".nuxt", ".cache", "cache", "coverage", "cypress", "playwright", "storybook-static")
#: Hidden folders that are walked (fixed values).
HIDDEN_WALKED = (".vitepress",)
#: Endings of bundles (fixed values).
BUNDLES = (".min.js", ".bundle.js", ".chunk.js", ".debug.js")
MAX_BYTES = 500_000
MIN_MINIFIED_BYTES, MINIFIED_LINE = 2_000, 300
#: Endings and folders of tests (fixed values).
TEST_ENDINGS = (".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "_test.rs", ".test.rs")
TEST_FOLDERS = ("tests", "test", "__tests__", "mocks", "__mocks__")
# Language and family of the supported extensions.
SUPPORTED = {
    "js": ("javascript", "js"), "jsx": ("javascript", "js"), "mjs": ("javascript", "js"), "cjs": ("javascript", "js"),
    "ts": ("typescript", "js"), "tsx": ("typescript", "js"), "mts": ("typescript", "js"), "cts": ("typescript", "js"), "vue": ("vue", "js"),
    "py": ("python", "python"), "pyi": ("python", "python"), "pyw": ("python", "python"),
    "go": ("go", "go"), "rs": ("rust", "rust"), "c": ("c", "c"), "h": ("c", "c"),
}
# Languages that are reported as skipped, by extension.
UNSUPPORTED = {
    "rb": "Ruby", "rake": "Ruby", "gemspec": "Ruby", "php": "PHP", "phtml": "PHP", "java": "Java", "kt": "Kotlin", "kts": "Kotlin",
    "scala": "Scala", "sc": "Scala", "swift": "Swift", "cs": "C#", "fs": "F#", "fsi": "F#", "fsx": "F#", "vb": "Visual Basic",
    "bas": "Visual Basic", "pl": "Perl", "pm": "Perl", "lua": "Lua", "r": "R", "jl": "Julia", "dart": "Dart", "ex": "Elixir", "exs": "Elixir",
    "erl": "Erlang", "hrl": "Erlang", "hs": "Haskell", "lhs": "Haskell", "ml": "OCaml", "mli": "OCaml", "clj": "Clojure", "cljs": "Clojure",
    "cljc": "Clojure", "groovy": "Groovy", "nim": "Nim", "zig": "Zig", "sol": "Solidity", "svelte": "Svelte", "astro": "Astro", "sh": "Shell",
    "bash": "Shell", "zsh": "Shell", "ksh": "Shell", "ps1": "PowerShell", "psm1": "PowerShell", "bat": "Batch", "cmd": "Batch", "sql": "SQL",
    "asm": "Assembly", "s": "Assembly", "f": "Fortran", "f90": "Fortran", "f95": "Fortran", "for": "Fortran", "pas": "Pascal", "pp": "Pascal",
    "tcl": "Tcl", "v": "SystemVerilog", "sv": "SystemVerilog", "vhd": "VHDL", "vhdl": "VHDL", "ada": "Ada", "adb": "Ada", "ads": "Ada",
    "cob": "COBOL", "cbl": "COBOL", "hx": "Haxe", "cr": "Crystal", "d": "D", "elm": "Elm", "purs": "PureScript", "re": "ReasonML", "rei": "ReasonML",
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def is_pruned(path: Column) -> Column:
    """Whether a root-relative path lies in a folder that is not walked, or is a bundle."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda f: f.startswith(".") & ~f.isin(*HIDDEN_WALKED, ".", ".."))
    bundle = F.lit(False)
    for end in BUNDLES:
        bundle = bundle | path.endswith(end)
    return F.arrays_overlap(folders, F.array(*map(F.lit, PRUNED))) | hidden | bundle


def is_test(path: Column) -> Column:
    """Whether a root-relative path is that of a test."""
    name = file_name(path)
    ending = F.lit(False)
    for end in TEST_ENDINGS:
        ending = ending | name.endswith(end)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return ending | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_FOLDERS))) | stem.startswith("mock") | F.lower(stem).endswith(".mock")


def looks_minified(ext: Column, text: Column) -> Column:
    """JavaScript of at least 2,000 bytes with over 300 bytes a line."""
    size = F.octet_length(text)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return ext.isin("js", "mjs", "cjs") & (size >= MIN_MINIFIED_BYTES) & (F.floor(size / lines) > MINIFIED_LINE)


def language_dimension(spark: SparkSession) -> DataFrame:
    """ext, language, family, supported: one row per known extension."""
    rows = [(e, lang, fam, True) for e, (lang, fam) in SUPPORTED.items()] + [(e, lang, None, False) for e, lang in UNSUPPORTED.items()]
    return spark.createDataFrame(rows, "ext string, language string, family string, supported boolean")


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ext, language, family and supported; unknown extensions have nulls."""
    return files.withColumn("ext", extension(F.col(path))).join(F.broadcast(language_dimension(files.sparkSession)), "ext", "left")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (root-relative), ext, language, family, supported, source of all walked files of a folder."""
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MAX_BYTES)
    rel = F.substring_index(F.col("path"), base, -1)
    files = raw.select(rel.alias("path"), F.col("modificationTime").alias("mtime"), "content").where(~is_pruned(F.col("path")))
    text = F.call_function("try_validate_utf8", F.col("content").cast("string"))
    known = with_language(files).where("language is not null").withColumn("source", F.when(F.col("supported"), text))
    return known.where(~F.coalesce(looks_minified(F.col("ext"), F.col("source")), F.lit(False))).drop("content")


def skipped_languages(files: DataFrame) -> DataFrame:
    """Files per language that has no frontend (AGG-14)."""
    return files.where("not supported").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))
