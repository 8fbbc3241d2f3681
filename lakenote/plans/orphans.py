"""Queries of problem 5 and their SQL."""

from lakenote.operators.orphans import orphan_references, orphan_report
from lakenote.tables import read


def p5_found(spark, d):
    return orphan_references(read(spark, d, "links"), read(spark, d, "docs"), read(spark, d, "removed_docs"))


def p5_report(spark, d):
    return orphan_report(p5_found(spark, d))


_PLAIN = "nfc_normalize(regexp_replace(url_decode(split_part({}, '#', 1)), '^(\\./)+', ''))"
FOUND_SQL = f"""
with refs as (
  select distinct 'src' as side, src_id::varchar as k, src_id, dst_path, found_at from links where src_id is not null
  union all
  select distinct 'dst', {_PLAIN.format('dst_path')}, src_id, dst_path, found_at from links where dst_path is not null),
own as (
  select 'src' as side, doc_id::varchar as k, min(indexed_at) as first_at from docs group by 1, 2
  union all select 'dst', {_PLAIN.format('path')}, min(indexed_at) from docs group by 1, 2),
gone as (
  select distinct 'src' as side, doc_id::varchar as k from removed_docs
  union select distinct 'dst', {_PLAIN.format('path')} from removed_docs)
select distinct r.side, strftime(r.found_at at time zone 'UTC', '%Y-%m') as found_month,
  coalesce(r.src_id, -1)::bigint as src_id, coalesce(r.dst_path, '') as dst_path,
  case when o.k is not null then 'late' when g.k is not null then 'deleted' else 'missing' end as reason
from refs r left join own o on o.side = r.side and o.k = r.k left join gone g on g.side = r.side and g.k = r.k
where o.k is null or o.first_at > r.found_at
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": FOUND_SQL,
    "p5_report": f"""select side, found_month, reason, count(*) as refs,
  count(distinct case when side = 'src' then src_id::varchar else dst_path end) as keys
from ({FOUND_SQL}) group by 1, 2, 3""",
}
