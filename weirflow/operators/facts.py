"""Vocabulary tables: what is a source, a sink, a sanitizer (FCT-01..08, FLT-01..06, FLT-10).

Facts are rows; several layers are merged by ``windows.merge_layers``: the seed,
then facts of a bundle for all languages ('*'), then those for one language. A
fact that is restricted to slots is never widened by one that is not. The seed
below comes from the public documentation of the frameworks named in it.

Kinds of facts: sources, sinks, sanitizers, propagators (which arguments pass
into a call's result), weak_calls, policies (guards that a call needs before it),
named (a named argument's required or banned literals), allocators and releases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import merge_layers

#: Where untrusted values come from: dotted paths.
SOURCES = {
    "python": (
        "flask.request.args", "flask.request.form", "flask.request.values", "flask.request.json", "flask.request.data", "flask.request.cookies", "flask.request.headers",
        "flask.request.files", "flask.request.get_json", "flask.request.path", "flask.request.query_string", "request.args", "request.form", "request.values", "request.json",
        "request.data", "request.cookies", "request.headers", "request.files", "request.GET", "request.POST", "request.body", "request.META", "request.query_params",
        "request.path_params", "self.request.GET", "self.request.POST", "self.get_argument", "sys.argv", "input", "os.environ", "os.getenv",
    ),
    "js": ("req.query", "req.body", "req.params", "req.headers", "req.cookies", "request.query", "request.body", "request.params", "ctx.query", "ctx.request.body", "process.argv", "location.search", "location.hash", "document.cookie", "window.location"),
    "go": ("r.URL.Query", "r.FormValue", "r.PostFormValue", "r.Header.Get", "req.FormValue", "os.Args", "c.Query", "c.Param", "c.PostForm"),
    "rust": ("std.env.args", "env.args", "std.env.var", "env.var"),
    "c": ("getenv", "fgets", "gets", "recv", "argv"),
}

#: call, label, dangerous slots (empty: all), needs a receiver.
SINKS = {
    "python": (
        ("os.system", "command", (0,), False), ("os.popen", "command", (0,), False), ("subprocess.run", "command", (0,), False), ("subprocess.call", "command", (0,), False),
        ("subprocess.Popen", "command", (0,), False), ("subprocess.check_output", "command", (0,), False), ("subprocess.check_call", "command", (0,), False),
        ("subprocess.getoutput", "command", (0,), False), ("eval", "code", (0,), False), ("exec", "code", (0,), False), ("compile", "code", (0,), False),
        ("execute", "sql", (0,), True), ("executemany", "sql", (0,), True), ("executescript", "sql", (0,), True), ("raw", "sql", (0,), True),
        ("open", "traversal", (0,), False), ("os.remove", "traversal", (0,), False), ("os.unlink", "traversal", (0,), False), ("shutil.rmtree", "traversal", (0,), False),
        ("flask.send_file", "traversal", (0,), False), ("requests.get", "ssrf", (0,), False), ("requests.post", "ssrf", (0,), False), ("urllib.request.urlopen", "ssrf", (0,), False),
        ("flask.redirect", "redirect", (0,), False), ("flask.render_template_string", "template", (0,), False), ("jinja2.Template", "template", (0,), False),
        ("pickle.loads", "deserialize", (0,), False), ("pickle.load", "deserialize", (0,), False), ("yaml.load", "deserialize", (0,), False), ("marshal.loads", "deserialize", (0,), False),
        ("markupsafe.Markup", "xss", (0,), False), ("flask.make_response", "xss", (0,), False), ("lxml.etree.fromstring", "xxe", (0,), False), ("xpath", "xpath", (0,), True),
        ("re.compile", "regex", (0,), False), ("logging.info", "log_leak", (), False),
    ),
    "js": (
        ("eval", "code", (0,), False), ("child_process.exec", "command", (0,), False), ("child_process.execSync", "command", (0,), False), ("exec", "command", (0,), False), ("query", "sql", (0,), True),
        ("innerHTML=", "xss", (0,), True), ("dangerouslySetInnerHTML=", "xss", (0,), True), ("res.redirect", "redirect", (0,), False), ("res.send", "xss", (0,), False), ("fs.readFile", "traversal", (0,), False),
        ("fs.readFileSync", "traversal", (0,), False), ("fetch", "ssrf", (0,), False), ("axios.get", "ssrf", (0,), False), ("document.write", "xss", (0,), False),
    ),
    "go": (("exec.Command", "command", (), False), ("os/exec.Command", "command", (), False), ("Query", "sql", (0,), True), ("Exec", "sql", (0,), True), ("os.Open", "traversal", (0,), False), ("http.Get", "ssrf", (0,), False), ("http.Redirect", "redirect", (2,), False)),
    "rust": (("Command.new", "command", (0,), False), ("std.process.Command.new", "command", (0,), False), ("File.open", "traversal", (0,), False), ("fs.read_to_string", "traversal", (0,), False)),
    "c": (("system", "command", (0,), False), ("popen", "command", (0,), False), ("strcpy", "buffer_overflow", (1,), False), ("printf", "format_string", (0,), False), ("fopen", "traversal", (0,), False)),
}

#: call, kind of effect.
SANITIZERS = {
    "python": (
        ("shlex.quote", "full"), ("int", "full"), ("float", "full"), ("bool", "full"), ("len", "full"), ("uuid.UUID", "full"), ("html.escape", "html_escape"), ("markupsafe.escape", "html_escape"),
        ("flask.escape", "html_escape"), ("bleach.clean", "html_escape"), ("urllib.parse.quote", "url_encode"), ("urllib.parse.quote_plus", "url_encode"),
        ("werkzeug.utils.secure_filename", "path_normalize"), ("os.path.basename", "path_normalize"), ("ast.literal_eval", "full"),
    ),
    "js": (("encodeURIComponent", "url_encode"), ("parseInt", "full"), ("Number", "full"), ("escapeHtml", "html_escape"), ("DOMPurify.sanitize", "html_escape"), ("path.basename", "path_normalize")),
    "go": (("strconv.Atoi", "full"), ("html.EscapeString", "html_escape"), ("url.QueryEscape", "url_encode"), ("filepath.Base", "path_normalize")),
    "rust": (("parse", "full"),),
    "c": (("atoi", "full"), ("strlen", "full"), ("strtol", "full")),
}

#: Calls that are weak of themselves: call, rule, CWE.
WEAK_CALLS = (
    ("hashlib.md5", "weak_hash", "CWE-328"), ("hashlib.sha1", "weak_hash", "CWE-328"), ("Crypto.Hash.MD5.new", "weak_hash", "CWE-328"), ("Crypto.Cipher.DES.new", "learned_weak_cipher_des", "CWE-327"),
    ("crypto.md5.New", "weak_hash", "CWE-328"), ("crypto/md5.New", "weak_hash", "CWE-328"), ("crypto/sha1.New", "weak_hash", "CWE-328"),
)


#: Calls of which only some arguments pass into the result: call, slots (none: nothing passes).
PROPAGATORS = {
    "python": (("re.sub", (1, 2)), ("re.split", (1,)), ("re.findall", (1,)), ("isinstance", ()), ("hasattr", ()), ("issubclass", ()), ("callable", ())),
    "js": (("Array.isArray", ()), ("Object.is", ()), ("isNaN", ())),
    "go": (("strings.Contains", ()), ("strings.HasPrefix", ())),
    "rust": (),
    "c": (("strcmp", ()), ("strncmp", ()), ("memcmp", ())),
}
#: Kind of fact: the column its key becomes, and what its payload (JSON) holds.
KINDS = {
    "sources": ("pattern", ""), "sinks": ("sink", "label string, slots array<int>, receiver boolean"), "sanitizers": ("sanitizer", "effect string"), "propagators": ("call", "slots array<int>"),
    "weak_calls": ("resolved", "rule string, cwe string"), "policies": ("trigger", "guards array<string>, rule string"), "named": ("call", "name string, required array<string>, banned array<string>, rule string"),
    "allocators": ("call", ""), "releases": ("call", ""),
}


def propagators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(fam, c, list(slots)) for fam, rows in PROPAGATORS.items() for c, slots in rows], "family string, call string, slots array<int>")


def taught(bundle: DataFrame, kind: str) -> DataFrame:
    """family, the kind's columns, _layer and _seq of a bundle's facts; those for '*' hold for every family, below its own."""
    key, payload = KINDS[kind]
    rows = bundle.where(F.col("kind") == kind).select("lang", F.col("key").alias(key), F.from_json("payload", payload).alias("_p") if payload else F.lit(None).alias("_p"), "provenance", "layer")
    every = F.array(*[F.lit(f) for f in SINKS])
    family = F.explode(F.when(F.col("lang") == "*", every).otherwise(F.array("lang"))).alias("family")
    own = (F.lit(2) + 2 * F.col("layer") + F.when(F.col("lang") == "*", 0).otherwise(1)).alias("_layer")
    return rows.select(family, key, *(["_p.*"] if payload else []), own, F.col("provenance").alias("_seq"))


def layered(spark: SparkSession, kind: str, bundle: DataFrame | None) -> DataFrame:
    """The facts of one kind: the seed with a bundle's on top of it (FCT-02, 04, 06)."""
    seed = {"sources": sources, "sinks": sinks, "sanitizers": sanitizers, "propagators": propagators}[kind](spark)
    if bundle is None:
        return seed
    more = taught(bundle, kind)
    if kind == "sinks":
        more = more.withColumns({"slots": F.coalesce("slots", F.array().cast("array<int>")), "receiver": F.coalesce("receiver", F.lit(False)), "label": F.coalesce("label", F.lit("other"))})
    both = seed.withColumns({"_layer": F.lit(1), "_seq": F.lit(0)}).unionByName(more)
    restricted = F.when(F.size("slots") > 0, 1).otherwise(0) if kind in ("sinks", "propagators") else F.lit(0)
    return merge_layers(both, ["family", KINDS[kind][0]], "_layer", restricted, "_seq").drop("_layer", "_seq")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(fam, p) for fam, ps in SOURCES.items() for p in ps], "family string, pattern string")


def sinks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(fam, c, label, list(slots), recv) for fam, rows in SINKS.items() for c, label, slots, recv in rows], "family string, sink string, label string, slots array<int>, receiver boolean")


def sanitizers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(fam, c, kind) for fam, rows in SANITIZERS.items() for c, kind in rows], "family string, sanitizer string, effect string")


def weak_calls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEAK_CALLS), "resolved string, rule string, cwe string")


def key_floors(facts: DataFrame) -> DataFrame:
    """key, min_bits of facts of any number of layers: an override may raise a floor, never lower it (FCT-05)."""
    return facts.groupBy("key").agg(F.max("min_bits").alias("min_bits"))
