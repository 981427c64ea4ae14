"""Queries of the general data-pipeline problems (4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.nested import report_rows, unread
from ..operators.snapshots import explain_changes
from ..session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rows(table(spark, sf_dir, "raw_reports"), table(spark, sf_dir, "sink_findings"))


def p4_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports that give no rows because they hold no object, and why."""
    return unread(table(spark, sf_dir, "raw_reports"), ["report_id"], "body")


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found with the changed fields, joined by commas."""
    return explain_changes(table(spark, sf_dir, "explain_snapshots")).selectExpr("project", "snap_no", "file", "line", "sink", "arg_slot", "change_kind", "array_join(changed_fields, ',') as changed_fields")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain_changes(table(spark, sf_dir, "explain_snapshots")).drop("changed_fields")


QUERIES = {"p4_found": p4_found, "p4_unread": p4_unread, "p5_found": p5_found, "p5_changes": p5_changes}

_TRIM = r"regexp_replace({0}, '^[\t-\r\x1c-\x20\x85\xa0]+|[\t-\r\x1c-\x20\x85\xa0]+$', '', 'g')"


def _t(c: str) -> str:
    return _TRIM.format(c)


_P5 = f"""
with rows as (
  select distinct {_t('project')} as project, snap_no,
    nullif(regexp_replace(replace({_t('file')}, '\\', '/'), '^(\\./)+', ''), '') as file, line,
    nullif({_t('sink')}, '') as sink, arg_slot,
    coalesce({_t('func')}, '') as func, lower(coalesce({_t('verdict')}, '')) as verdict,
    coalesce({_t('reason')}, '') as reason, coalesce({_t('source_desc')}, '') as source_desc,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(cut_reasons, []), lambda x: {_t('x')}), lambda x: x <> ''))), ',') as cut_reasons
  from explain_snapshots where snap_no is not null),
recs as (
  select project, snap_no, file, line, sink, arg_slot, list_sort(list(distinct func)) as func, list_sort(list(distinct verdict)) as verdict,
    list_sort(list(distinct reason)) as reason, list_sort(list(distinct source_desc)) as source_desc, list_sort(list(distinct cut_reasons)) as cut_reasons
  from rows where file is not null and line is not null and sink is not null group by all),
steps as (
  select project, snap_no, lag(snap_no) over (partition by project order by snap_no) as prev from (select distinct project, snap_no from rows)),
cur as (select s.prev, r.* from recs r join steps s on r.project is not distinct from s.project and r.snap_no = s.snap_no where s.prev is not null),
old as (select s.snap_no as at, r.* from recs r join steps s on r.project is not distinct from s.project and r.snap_no = s.prev)
select coalesce(c.project, o.project) as project, coalesce(c.snap_no, o.at) as snap_no, coalesce(c.file, o.file) as file,
  coalesce(c.line, o.line) as line, coalesce(c.sink, o.sink) as sink, coalesce(c.arg_slot, o.arg_slot) as arg_slot,
  case when o.file is null then 'added' when c.file is null then 'removed' else 'changed' end as change_kind{{extra}}
from cur c full join old o on c.project is not distinct from o.project and c.snap_no = o.at and c.file = o.file and c.line = o.line
  and c.sink = o.sink and c.arg_slot is not distinct from o.arg_slot
where o.file is null or c.file is null or c.func <> o.func or c.verdict <> o.verdict or c.reason <> o.reason
  or c.source_desc <> o.source_desc or c.cut_reasons <> o.cut_reasons
"""

_FIELDS = ("cut_reasons", "func", "reason", "source_desc", "verdict")
_EXTRA = ", array_to_string(list_filter([" + ", ".join(f"case when c.{f} is distinct from o.{f} then '{f}' end" for f in _FIELDS) + "], lambda x: x is not null), ',') as changed_fields"

_P4 = """
with once as (
  select report_id, case when json_valid(body) then cast(body as json) end as j from raw_reports),
opened as (
  select report_id, case when json_type(j) = 'VARCHAR' then case when json_valid(j ->> '$') then cast(j ->> '$' as json) end else j end as j from once),
obj as (select report_id, j from opened where json_type(j) = 'OBJECT'),
cwe as (
  select report_id, unnest(map_entries(cast(j -> 'by_cwe' as map(varchar, json)))) as e from obj where json_type(j -> 'by_cwe') = 'OBJECT'),
cwe_rows as (
  select report_id, e.key as item, e.value as v from cwe
  union all
  select report_id, v ->> 'cwe', v from (select report_id, unnest(cast(j -> 'by_cwe' as json[])) as v from obj where json_type(j -> 'by_cwe') = 'ARRAY')),
g as (select report_id, unnest(gs) as x, generate_subscripts(gs, 1) - 1 as gi from (
  select report_id, case json_type(j -> 'groups') when 'ARRAY' then cast(j -> 'groups' as json[]) when 'NULL' then [] else [j -> 'groups'] end as gs from obj)),
f as (select report_id, gi, unnest(fs) as x, generate_subscripts(fs, 1) - 1 as fi from (
  select report_id, gi, case json_type(x -> 'files') when 'ARRAY' then cast(x -> 'files' as json[]) when 'NULL' then [] else [x -> 'files'] end as fs from g)),
r as (select report_id, gi, fi, unnest(rs) as x, generate_subscripts(rs, 1) - 1 as ri from (
  select report_id, gi, fi, case json_type(x -> 'records') when 'ARRAY' then cast(x -> 'records' as json[]) when 'NULL' then [] else [x -> 'records'] end as rs from f)),
m as (select report_id, gi, fi, ri, child, unnest(ms) as x, generate_subscripts(ms, 1) - 1 as mi from (
  select report_id, gi, fi, ri, child, case json_type(x -> child) when 'ARRAY' then cast(x -> child as json[]) when 'NULL' then [] else [x -> child] end as ms
  from r cross join (values ('cut_sites'), ('cut_reasons')) c(child) where json_type(x -> child) is not null)),
s as (
  select finding_id, 'cut_sites' as child, unnest(cut_sites).detail as v, unnest(list_transform(cut_sites, lambda y: y is not null)) as there, generate_subscripts(cut_sites, 1) - 1 as mi from sink_findings
  union all
  select finding_id, 'cut_reasons', unnest(cut_reasons), unnest(list_transform(cut_reasons, lambda y: y is not null)), generate_subscripts(cut_reasons, 1) - 1 from sink_findings)
select 'raw_reports' as src, report_id as rec_id, 'by_cwe' as child, item, coalesce(cast(try_cast(v ->> 'TP' as decimal(38,0)) as varchar), '') as val from cwe_rows where item is not null
union all
select 'raw_reports', report_id, child, concat(gi, '.', fi, '.', ri, '.', mi),
  case child when 'cut_sites' then coalesce(x ->> 'detail', '') else x ->> '$' end from m where json_type(x) <> 'NULL'
union all
select 'sink_findings', finding_id, child, cast(mi as varchar), coalesce(v, '') from s where there
"""

_P4_UNREAD = """
with once as (select report_id, body, case when json_valid(body) then cast(body as json) end as j from raw_reports),
opened as (select report_id, body, case when json_type(j) = 'VARCHAR' then case when json_valid(j ->> '$') then cast(j ->> '$' as json) end else j end as j from once)
select report_id, case when trim(coalesce(body, '')) = '' then 'missing' when j is not null then 'no object' else 'unreadable' end as reason from opened where coalesce(json_type(j) <> 'OBJECT', true)
"""

ORACLE = {"p4_unread": _P4_UNREAD, "p4_found": _P4, "p5_found": _P5.replace("{extra}", ""), "p5_changes": _P5.replace("{extra}", _EXTRA)}
