"""Text functions, corpus mining, scores, sources and diffs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.names import last_segment, mirror_base
from ..operators import mining as M
from ..operators import similarity as S
from ..session import table
from ..sources import diffs, files
from ..storage import write_table
from . import general
from .base import Book

book = Book()

# ---------------------------------------------------------------- samples of families



def _listed(words) -> str:  # noqa: ANN001
    return ", ".join(f"'{w}'" for w in words)


def _code(source: str, hashed: bool) -> str:
    comments = f"(?sm){X.BLOCK_COMMENT}|{X.SLASH_LINE}" + (f"|{X.HASH_LINE}" if hashed else "")
    return rf"trim(regexp_replace(regexp_replace({source}, '{comments}', ' ', 'g'), '(?:[ \t]*\n)+', chr(10), 'g'), chr(10))"


_SAMPLES = f"""
samples as (
  select fam_no, lang, 'positive' as variant, m.source as source, m.ext as ext from (select fam_no, lang, unnest(positives) as m from families) where m.source is not null
  union all
  select fam_no, lang, 'negative', m.source, m.ext from (select fam_no, lang, unnest(negatives) as m from families) where m.source is not null),
code as (select fam_no, lang, variant, ext, case when ext in ({_listed(X.HASH_EXTENSIONS)}) then {_code('source', True)} else {_code('source', False)} end as text from samples)"""
_CALLS = rf"""
names as (select distinct fam_no, lang, variant, name from (select fam_no, lang, variant, unnest(regexp_extract_all(text, '({X.NAME})[ \t-\r]*\(', 1)) as name from code)
  where name not in ({_listed(X.CALL_KEYWORDS)}))"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """fam_no, lang, variant, ext, text of all code samples, without comments."""
    f = table(spark, d, "families")
    parts = [f.select("fam_no", "lang", F.lit(v).alias("variant"), F.explode(c).alias("m")) for v, c in (("positive", "positives"), ("negative", "negatives"))]
    s = parts[0].unionByName(parts[1]).where("m.source is not null")
    return s.select("fam_no", "lang", "variant", F.col("m.ext").alias("ext"), X.code_of(F.col("m.source"), F.coalesce("m.ext", F.lit(""))).alias("text"))


def call_names(spark: SparkSession, d: str) -> DataFrame:
    """fam_no, lang, variant, name of all called names, each once per family and variant."""
    return samples(spark, d).select("fam_no", "lang", "variant", F.explode(X.called_names(F.col("text"))).alias("name")).distinct()


@book.query("fn26_tokens", f"with {_SAMPLES} select fam_no, cast(sum(len(regexp_extract_all(text, '{X.TOKEN}'))) as bigint) as n_tokens from code group by 1")
def fn26(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("fam_no").agg(F.sum(F.size(X.code_tokens(F.col("text")))).alias("n_tokens"))


# the SQL abstracts token by token, each looking at the next; the operator rewrites the text in passes
_TOKENS = f"regexp_extract_all(text, '{X.QUOTED.replace(chr(39), chr(39) * 2)}|{X.NAME}|[0-9]+(?:\\.[0-9]+)?|{X.OTHER}')"
_SKELETON = rf"""list_transform(range(1, len(t) + 1), lambda i: case when regexp_matches(t[i], '(?s)^["''`].') then 'STR' when regexp_matches(t[i], '^[0-9]') then 'NUM'
  when regexp_matches(t[i], '^[A-Za-z_]') and t[i] not in ({_listed(X.SKELETON_KEYWORDS)}) and coalesce(t[i + 1], '') <> '(' then 'ID' else t[i] end)"""


@book.query("fn27_skeleton", f"with {_SAMPLES}, t as (select fam_no, variant, {_TOKENS} as t from code), k as (select fam_no, variant, {_SKELETON} as k from t) select fam_no, variant, md5(array_to_string(k, ' ')) as skeleton, cast(len(k) as integer) as n from k")
def fn27(spark: SparkSession, d: str) -> DataFrame:
    """Rename-proof fingerprints of all samples."""
    k = samples(spark, d).select("fam_no", "variant", X.skeleton_of(F.col("text")).alias("k"))
    return k.select("fam_no", "variant", F.md5(F.array_join("k", " ")).alias("skeleton"), F.size("k").alias("n"))


@book.query("fn30_calls", f"with {_SAMPLES}, {_CALLS} select fam_no, variant, string_agg(name, ',' order by name) as names from names group by 1, 2")
def fn30(spark: SparkSession, d: str) -> DataFrame:
    return call_names(spark, d).groupBy("fam_no", "variant").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@book.query("fn31_levenshtein", "select distinct func, sink, levenshtein(func, sink) as distance from sink_findings where func is not null and sink is not null")
def fn31(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sink_findings").where("func is not null and sink is not null").select("func", "sink").distinct().withColumn("distance", F.levenshtein("func", "sink").cast("bigint"))


@book.query("fn32_ids", f"select doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?i)({'|'.join(X.ADVISORY_IDS)})'), lambda x: upper(x)), ',') as ids from documents where text is not null")
def fn32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.advisory_ids(F.col("text")), ",").alias("ids"))


@book.query("fn01_last_segment", r"select distinct sink, regexp_extract(sink, '[^.]*$') as segment, coalesce(nullif(regexp_extract(sink, '^(.+?)(Async|Sync|Callback|Promise)$', 1), ''), '') as base from sink_findings where sink is not null")
def fn01(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sink_findings").where("sink is not null").select("sink").distinct()
    return s.select("sink", last_segment(F.col("sink")).alias("segment"), F.coalesce(mirror_base(F.col("sink")), F.lit("")).alias("base"))


@book.query("fn15_line_at", r"select doc_id, 1 + length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) as line from documents where text is not null")
def fn15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.line_at(F.col("text"), F.expr("length(text) div 2").cast("int")).cast("bigint").alias("line"))


@book.query("fn20_cwe", f"select cwe, count(*) as n from (select 'CWE-' || regexp_extract(item, '^(?i)CWE-0*([0-9]+)$', 1) as cwe from ({general.ORACLE['p4_found']}) where child = 'by_cwe') where cwe <> 'CWE-' group by 1")
def fn20(spark: SparkSession, d: str) -> DataFrame:
    """Scorecard cells per normalised weakness number."""
    cells = general.p4_found(spark, d).where("child = 'by_cwe'")
    return cells.select(X.canonical_cwe(F.col("item")).alias("cwe")).where("cwe is not null").groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sources


@book.query("src03_minified", r"""
select doc_id, octet_length(encode(text)) as n_bytes, (octet_length(encode(text)) >= 2000 and octet_length(encode(text)) // (length(text) - length(replace(text, chr(10), '')) + 1) > 300) as minified from documents where text is not null
""")  # fmt: skip
def src03(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), files.looks_minified(F.lit("js"), F.col("text")).alias("minified"))


_EXT = r"lower(regexp_extract(regexp_extract(file, '[^/]*$'), '[^.]\.([^.]+)$', 1))"


@book.query("src05_ext_map", f"""
with f as (select distinct file from file_timings where file <> ''),
m(ext, language) as (values {", ".join(f"('{e}', '{v[0]}')" for e, v in files.SUPPORTED.items())}, {", ".join(f"('{e}', '{v}')" for e, v in files.UNSUPPORTED.items())})
select coalesce(language, 'unknown') as language, count(*) as n_files from (select file, {_EXT} as ext from f) left join m using (ext) group by 1
""")  # fmt: skip
def src05(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_timings").where("file <> ''").select(F.col("file").alias("path")).distinct()
    return files.with_language(f).groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


@book.query("src04_tests", r"""
with f as (select distinct file from function_timings where file <> '')
select file, (regexp_matches(file, '(\.(test|spec)\.(ts|tsx|js|jsx)|_test\.rs|\.test\.rs)$') or len(list_intersect(string_split(file, '/'), ['tests', 'test', '__tests__', 'mocks', '__mocks__'])) > 0
  or starts_with(regexp_extract(file, '[^/]*$'), 'mock')) as is_test from f
""")  # fmt: skip
def src04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "function_timings").where("file <> ''").select("file").distinct().select("file", files.is_test(F.col("file")).alias("is_test"))


_PATCH = [
    "diff --git a/app/a.py b/app/a.py", "--- a/app/a.py", "+++ b/app/a.py", "@@ -1,3 +1,4 @@", " import os", "+import sys", " ", "-x = 1", "+x = 2", "@@ -10,0 +12,2 @@", "+y = 3", "+z = 4",
    "diff --git a/app/gone.py b/app/gone.py", "--- a/app/gone.py", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-a", "-b", "--- a/lib/b.go", "+++ b/lib/b.go", "@@ -5 +5 @@", "-old", "+new", "\\ No newline at end of file",
]


@book.query("dif01_hunks", "select * from (values ('app/a.py', 2, 2), ('app/a.py', 4, 4), ('app/a.py', 12, 13), ('lib/b.go', 5, 5)) t(path, start_line, end_line)")
def dif01(spark: SparkSession, d: str) -> DataFrame:
    """Added ranges of a literal patch; the lines are its known answer."""
    patch = spark.createDataFrame([("p", i, x) for i, x in enumerate(_PATCH)], "diff string, n long, line string")
    return diffs.added_ranges(patch).select("path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


# ---------------------------------------------------------------- near copies

_ALIKE = """
n as (select id, count(*) as n from g group by 1),
c as (select a.id as a, b.id as b, count(*) as c from g a join g b on a.g = b.g and a.scope = b.scope and a.id < b.id group by 1, 2),
p as (select a, b from c join n x on x.id = a join n y on y.id = b where {den} * c >= {num} * (x.n + y.n - c)),
k as (select a as id from p union all select b from p)
"""


@book.query("join20_pairs_jaccard", r"""
with w as (select doc_id as id, coalesce(lang, '') as scope, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null),
g as (select distinct id, scope, unnest(case when len(w) < 5 then w else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w where len(w) > 0),
""" + _ALIKE.format(num=4, den=5) + """select n.id as doc_id, cast((select count(*) from k where k.id = n.id) as bigint) as n_links from n""")  # fmt: skip
def join20(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the number of near copies in its language: five-word shingles, 0.8 or more."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("lang", F.coalesce("lang", F.lit("")))
    members, pairs = S.alike(S.shingle_sets(docs, "doc_id", X.words(F.col("text")), 5, "lang"), 4, 5)
    return S.link_counts(members, pairs).select(F.col("id").alias("doc_id"), "n_links")


@book.query("join20_pairs_tokens", r"""
with w as (select doc_id as id, coalesce(lang, '') as scope, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|[^ \t-\r\x{85}\p{Z}]') as w from documents where text is not null),
g as (select distinct id, scope, unnest(case when len(w) < 5 then w else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w where len(w) > 0),
""" + _ALIKE.format(num=4, den=5) + """select n.id as doc_id, cast((select count(*) from k where k.id = n.id) as bigint) as n_links from n""")  # fmt: skip
def join20_tokens(spark: SparkSession, d: str) -> DataFrame:
    """As join20_pairs_jaccard, whatever the script: every character that is no blank takes part."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("lang", F.coalesce("lang", F.lit("")))
    members, pairs = S.alike(S.shingle_sets(docs, "doc_id", X.text_tokens(F.col("text")), 5, "lang"), 4, 5)
    return S.link_counts(members, pairs).select(F.col("id").alias("doc_id"), "n_links")


def _lint_pairs(name: str, sql_grams: str, grams, num: int, den: int) -> None:  # noqa: ANN001
    @book.query(name, f"with {_SAMPLES}, {_CALLS if 'names' in sql_grams else 'unused as (select 1)'}, g as ({sql_grams}), " + _ALIKE.format(num=num, den=den) + "select n.id as fam_no, cast((select count(*) from k where k.id = n.id) as bigint) as n_links from n")
    def run(spark: SparkSession, d: str) -> DataFrame:
        members, pairs = S.alike(grams(spark, d), num, den)
        return S.link_counts(members, pairs).select(F.col("id").alias("fam_no"), "n_links")


def _call_sets(spark: SparkSession, d: str) -> DataFrame:
    per = call_names(spark, d).where("variant = 'positive'").groupBy(F.col("fam_no").alias("id"), F.coalesce("lang", F.lit("")).alias("scope"))
    return per.agg(F.array_sort(F.collect_set(F.xxhash64("name"))).alias("s"))


_lint_pairs("min11_call_overlap", "select distinct fam_no as id, coalesce(lang, '') as scope, name as g from names where variant = 'positive'", _call_sets, 4, 5)


_FIRST = _SAMPLES.replace("unnest(positives) as m from families", "list_filter(positives, lambda x: x.source is not null)[1] as m from families")


@book.query("min11_structural_clones", f"with {_FIRST}, t as (select fam_no as id, coalesce(lang, '') as scope, {_TOKENS} as t from code where variant = 'positive'), k as materialized (select id, scope, {_SKELETON} as k from t)," + r"""
a as (select distinct id, scope, unnest(list_transform(range(1, len(k) - 2), lambda i: array_to_string(k[i:i + 3], ' '))) as g from k where len(k) >= 4),
g as (select id, scope, g from a where id in (select id from a group by 1 having count(*) >= 8)),
""" + _ALIKE.format(num=17, den=20).replace("k as (", "e as (") + "select n.id as fam_no, cast((select count(*) from e where e.id = n.id) as bigint) as n_links from n")  # fmt: skip
def min11_clones(spark: SparkSession, d: str) -> DataFrame:
    """Each family with the renamed copies of its first positive in its language: four-token skeleton shingles, 8 at least, 0.85 or more (D008)."""
    f = table(spark, d, "families").select("fam_no", F.coalesce("lang", F.lit("")).alias("lang"), F.try_element_at(F.filter("positives", lambda m: m["source"].isNotNull()), F.lit(1)).alias("m")).where("m is not null")
    # written, as filters would else be pushed down and take the skeleton again for each token
    k = write_table(f.select("fam_no", "lang", X.skeleton_of(X.code_of(F.col("m.source"), F.coalesce("m.ext", F.lit("")))).alias("k")), "skeletons")
    sets = write_table(S.shingle_sets(k, "fam_no", F.col("k"), 4, "lang"), "sets")
    members, pairs = S.alike(sets.where(F.size("s") >= 8), 17, 20)
    return S.link_counts(members, pairs).select(F.col("id").alias("fam_no"), "n_links")


# ---------------------------------------------------------------- mining


@book.query("min01_inventory", f"with {_SAMPLES}, {_CALLS} select name, count(*) as n_variants, count(distinct fam_no) as n_families from names group by 1")
def min01(spark: SparkSession, d: str) -> DataFrame:
    return call_names(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n_variants"), F.count_distinct("fam_no").alias("n_families"))


_DELTA = """
delta as (select fam_no, lang, name, bool_or(variant = 'positive') as pos, bool_or(variant = 'negative') as neg from names group by 1, 2, 3)"""


@book.query("min02_proposals", f"with {_SAMPLES}, {_CALLS}, {_DELTA} select fam_no, string_agg(case when pos and not neg then name end, ',' order by name) as sinks, string_agg(case when neg and not pos then name end, ',' order by name) as sanitizers from delta where pos <> neg group by 1")
def min02(spark: SparkSession, d: str) -> DataFrame:
    """What each family proposes: calls of its positives only, and of its negatives only."""
    p = M.proposals(call_names(spark, d))
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name"))))
    per = p.groupBy("fam_no").agg(listed("sink").alias("s"), listed("sanitizer").alias("t"))
    return per.select("fam_no", F.when(F.size("s") > 0, F.array_join("s", ",")).alias("sinks"), F.when(F.size("t") > 0, F.array_join("t", ",")).alias("sanitizers"))


@book.query("min05_votes", f"with {_SAMPLES}, {_CALLS}, {_DELTA} select lang, name, case when pos then 'sink' else 'sanitizer' end as kind, count(*) as support, case when count(*) >= 2 then 'confirmed' else 'provisional' end as status from delta where pos <> neg group by 1, 2, 3")
def min05(spark: SparkSession, d: str) -> DataFrame:
    return M.votes(M.proposals(call_names(spark, d)), ["lang", "name", "kind"])


@book.query("min06_gate", f"""with {_SAMPLES}, {_CALLS}, {_DELTA}
select lang, name, count(case when pos and not neg then 1 end) as separates, count(case when neg then 1 end) as breaks from delta group by 1, 2
having count(case when pos and not neg then 1 end) > 0 and count(case when neg then 1 end) = 0""")  # fmt: skip
def min06(spark: SparkSession, d: str) -> DataFrame:
    """Sink candidates that separate a family and make no negative of any family noisy."""
    return M.independent_gate(call_names(spark, d), ["lang", "name"])


@book.query("min10_lint", f"""with {_SAMPLES}
, has as (select fam_no, bool_or(variant = 'positive' and trim(source) <> '') as p, bool_or(variant = 'negative' and trim(source) <> '') as n from samples group by 1),
same as (select distinct a.fam_no from code a join code b on a.fam_no = b.fam_no and a.variant = 'positive' and b.variant = 'negative' and a.text = b.text)
select fam_no, 'S001' as code from has where p and not n union all select fam_no, 'S002' from has where n and not p union all select fam_no, 'D003' from same
union all select fam_no, 'S006' from families where id in (select id from families group by 1 having count(distinct lang) > 1)""")  # fmt: skip
def min10(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "families")
    return M.lint(f, samples(spark, d), "fam_no", "id", "lang")


#: Classes of the corpus with their weaknesses.
_CLASSES = (
    ("authz.missing", ("CWE-862", "CWE-639")), ("crypto.weak", ("CWE-327", "CWE-328", "CWE-330")), ("inject.query", ("CWE-89", "CWE-90", "CWE-643")),
    ("inject.shell", ("CWE-78",)), ("mem.bounds", ("CWE-787", "CWE-125")),
)
_VALUES = ", ".join(f"('{c}', [{', '.join(repr(w) for w in ws)}])" for c, ws in _CLASSES)
_REQUIRED = ", ".join(repr(k) for k in M.REQUIRED_KEYS)
_KNOWN = ", ".join(repr(k) for k in M.KNOWN_KEYS)


@book.query("min10_metadata", f"""
with c(id, cwes) as (values {_VALUES}),
f as (select fam_no, coalesce(meta, map {{}}) as m, declared_check_call as t from families),
k as (select f.*, trim(m['cwe']) as cwe, regexp_extract(trim(m['cwe']), '^(?i)CWE-0*([0-9]+)$', 1) as n, trim(m['severity']) as sev, trim(m['class']) as cls, trim(m['purpose']) as pur, c.id as known, c.cwes,
  lower(list_last(string_split(t, '.'))) as name from f left join c on c.id = m['class'])
select fam_no, 'M001' as code, unnest(list_filter([{_REQUIRED}], lambda x: not list_contains(map_keys(m), x))) as detail from k
union all select fam_no, 'M004', unnest(list_filter(map_keys(m), lambda x: not list_contains([{_KNOWN}], x))) from k
union all select fam_no, 'M005', e.key from (select fam_no, unnest(map_entries(m)) as e from k) where e.key in ('observation', 'impact', 'improvement') and (length(e.value) < 20 or contains(e.value, 'TODO') or contains(e.value, '<'))
union all select fam_no, 'M002', cwe from k where cwe is not null and n = ''
union all select fam_no, 'M003', sev from k where sev is not null and lower(sev) not in ('critical', 'high', 'medium', 'warning', 'low', 'info')
union all select fam_no, 'M006', trim(m['cvss']) from k where m['cvss'] is not null and not coalesce(try_cast(m['cvss'] as double) between 0 and 10, false)
union all select fam_no, 'C001', '' from k where cls is null
union all select fam_no, 'C002', cls from k where cls is not null and known is null
union all select fam_no, 'C003', cwe from k where known is not null and n <> '' and not list_contains(cwes, 'CWE-' || n)
union all select fam_no, 'C005', coalesce(pur, '') from k where not coalesce(pur in ('knowledge', 'precision', 'anchor'), false)
union all select fam_no, 'C006', '' from k where m['shape'] is null
union all select fam_no, 'D005', t from k where regexp_matches(name, '^({'|'.join(M.DOUBLE_PREFIXES)})')
union all select fam_no, 'E040', t from k where name in ({_listed(M.EVERYDAY_VERBS)}) and m['package'] is null
""")  # fmt: skip
def min10_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the families' header blocks."""
    classes = spark.createDataFrame([(c, list(w)) for c, w in _CLASSES], "id string, cwes array<string>")
    return M.lint_metadata(table(spark, d, "families"), classes, "fam_no")
