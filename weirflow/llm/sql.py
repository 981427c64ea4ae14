"""DuckDB SQL of the queries that SQL can express on whole tables."""

_HELD = """select * from (select *, row_number() over (partition by timing_id order by received_at desc nulls last, ms desc nulls first) as _d
    from {0}) where _d = 1 and ms >= 0 and ms < 9223372036854775807"""

P1_FOUND = f"""
with held as (
  select 'function' as metric, lang_family as grp, measured_at, ms from ({_HELD.format("function_timings")})
  union all select 'file', lang_family, measured_at, ms from ({_HELD.format("file_timings")})
  union all select 'phase', lower(trim(phase)), measured_at, ms from ({_HELD.format("phase_timings")})),
ranked as (
  select metric, grp, strftime(date_trunc('week', measured_at), '%Y-%m-%d') as week_start, ms,
    row_number() over (partition by metric, grp, date_trunc('week', measured_at) order by ms) as r,
    count(*) over (partition by metric, grp, date_trunc('week', measured_at)) as n
  from held where measured_at is not null)
select metric, grp, week_start from ranked where n >= 30 group by all
having max(case when r = (95 * n + 99) // 100 then ms end) >= 8 * cast(max(case when r = (50 * n + 99) // 100 then ms end) as hugeint)
"""

P3_FOUND = f"""
select file, cast(rnk as integer) as rnk, timing_id from (
  select file, timing_id, row_number() over (partition by file order by ms desc, func, timing_id) as rnk
  from ({_HELD.format("function_timings")}) where file <> '' and func is not null) where rnk <= 5
"""

P2_FOUND = r"""
with sources as (
  select fam_no, m.source as source from (select fam_no, unnest(positives) as m from families union all select fam_no, unnest(negatives) from families)),
tokens as (select fam_no, regexp_extract_all(source, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]') as t from sources where source is not null),
grams as (
  select distinct fam_no, t[i] || chr(1) || t[i + 1] || chr(1) || t[i + 2] as g
  from (select fam_no, t, unnest(range(1, len(t) - 1)) as i from tokens where len(t) >= 3)),
sizes as (select fam_no, count(*) as n from grams group by 1),
common as (select a.fam_no as fam_a, b.fam_no as fam_b, count(*) as c from grams a join grams b on a.g = b.g and a.fam_no < b.fam_no group by 1, 2)
select fam_a, fam_b from common join sizes x on x.fam_no = fam_a join sizes y on y.fam_no = fam_b where 5 * c >= 3 * (x.n + y.n - c)
"""

P2_FAMILIES = (
    P2_FOUND.replace("select fam_a, fam_b from", ", pairs as (select fam_a, fam_b from")
    + """),
keys as (select fam_no, md5(string_agg(g, chr(2) order by g)) as k from grams group by 1),
ends as (select fam_a as f from pairs union all select fam_b from pairs)
select fam_no, min(fam_no) over (partition by k) as class_fam, cast((select count(*) from ends where f = fam_no) as bigint) as n_links from keys
"""
)

ORACLE = {"p2_found": P2_FOUND, "p2_families": P2_FAMILIES, "p1_found": P1_FOUND, "p3_found": P3_FOUND}
