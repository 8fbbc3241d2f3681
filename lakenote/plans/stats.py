"""Counts, roll-ups, listings and retention over the corpus tables, and their SQL."""

from pyspark.sql import functions as F

from lakenote.operators import stats as S
from lakenote.plans.common import DOCS, chunks, docs
from lakenote.tables import read


def stats_counts(spark, d):
    return S.totals(docs(spark, d), read(spark, d, "chunks"), read(spark, d, "vectors"))


def by_ext(spark, d):
    return S.by_extension(docs(spark, d))


def failed_files(spark, d):
    return docs(spark, d).where("error is not null").select("path", "error")


def tag_rollup(spark, d):
    return S.tag_counts(docs(spark, d))


def folder_counts(spark, d):
    return S.folder_counts(docs(spark, d))


def tree_sort(spark, d):
    return S.tree(docs(spark, d))


def tree_filter(spark, d):
    return S.tree_matches(S.tree(docs(spark, d)), "meeting").select("path", "type")


def switcher_score(spark, d):
    recents = S.most_recent(docs(spark, d), "path", "mtime", 30).withColumn("recent", F.row_number().over(S.Window.orderBy(F.desc("mtime"), "path")) - 1).select("path", "recent")
    return S.switch_to(docs(spark, d), "pro gar", recents)


def switcher_subsequence(spark, d):
    return docs(spark, d).select("path").distinct().withColumn("score", S.switcher_score(F.col("path"), "hmd")).where("score > 0")


def lru_recent(spark, d):
    return S.most_recent(read(spark, d, "events"), "user_id", "ts", 30)


def version_retention(spark, d):
    e = read(spark, d, "events")
    now = e.agg(F.max("ts")).collect()[0][0]
    return S.retained(e.select("user_id", "ts", "event_id"), "user_id", "ts", F.lit(now), 5, 24 * 7).select("user_id", "event_id")


def debounce_sessions(spark, d):
    return S.bursts(read(spark, d, "events"), "ts", 60.0, ["user_id"]).select("user_id", "burst_start", "burst_end", "events")


def editable_files(spark, d):
    """Notes that may be edited: Markdown or text, at most 5 MB, not hidden."""
    hidden = F.col("path").rlike(r"(^|/)\.")
    return docs(spark, d).where(F.col("ext").isin(".md", ".markdown", ".txt") & (F.col("size") <= 5_000_000) & ~hidden).select("path", "size")


def scan_visible(spark, d):
    """Files a scan takes: none hidden, locked, or in a tool folder, of a known type."""
    from lakenote.sources.files import visible

    return docs(spark, d).where(visible(F.col("path"))).select("path")


PARTS = "string_split({}, '/')"
QUERIES = {
    "stats_counts": stats_counts, "by_ext": by_ext, "failed_files": failed_files, "tag_rollup": tag_rollup, "folder_counts": folder_counts, "tree_sort": tree_sort,
    "tree_filter": tree_filter, "switcher_score": switcher_score, "switcher_subsequence": switcher_subsequence, "lru_recent": lru_recent,
    "version_retention": version_retention, "debounce_sessions": debounce_sessions, "editable_files": editable_files, "scan_visible": scan_visible,
}
_TREE = f"""f as (select distinct path, 'file' as type, ext from d), dirs as (select distinct array_to_string({PARTS.format('folder')}[1:n], '/') as path from (select folder, unnest(range(1, len({PARTS.format('folder')}) + 1)) as n from d where folder <> '')),
t as (select path, array_to_string({PARTS.format('path')}[1:len({PARTS.format('path')}) - 1], '/') as parent, {PARTS.format('path')}[-1] as name, type, ext, len({PARTS.format('path')})::int as depth from (select * from f union all select path, 'dir', null from dirs))"""
_NAME = "lower(string_split(path, '/')[-1])"


def _word_sql(w: str) -> str:
    at = f"instr({_NAME}, '{w}')"
    return f"case when {at} = 1 then 16 when {at} > 1 and regexp_matches(substr({_NAME}, {at} - 1, 1), '[\\s_\\-./(]') then 14 when {at} > 1 then 10 when contains(lower(path), '{w}') then 3 end"


SQL = {
    "stats_counts": f"""with {DOCS} select (select count(*) from d where kind = 'note') as notes, (select count(*) from d where kind = 'image') as images, (select count(error) from d) as errors,
(select count(distinct chunk_id) from chunks) as chunks, (select count(distinct chunk_id) from vectors) as vectors""",
    "by_ext": f"with {DOCS} select ext, count(*) as notes from d where kind = 'note' group by 1",
    "failed_files": f"with {DOCS} select path, error from d where error is not null",
    "tag_rollup": f"""with {DOCS}, t as (select doc_id, unnest(range(len(tags))) as i, unnest(tags) as tag from d where kind = 'note'), b as (select doc_id, i, string_split(trim(ltrim(tag, '#'), '/'), '/') as p from t where tag is not null),
e as (select doc_id, i, n, array_to_string(p[1:n], '/') as name from (select *, unnest(range(1, len(p) + 1)) as n from b))
select first(name order by doc_id, i, n) as tag, count(distinct doc_id) as notes from e where name <> '' group by lower(name)""",
    "folder_counts": f"""with {DOCS}, e as (select '' as folder from d union all select array_to_string({PARTS.format('folder')}[1:n], '/') from (select folder, unnest(range(1, len({PARTS.format('folder')}) + 1)) as n from d where folder <> ''))
select folder, count(*) as files from e group by 1""",
    "tree_sort": f"with {DOCS}, {_TREE} select * from t",
    "tree_filter": f"with {DOCS}, {_TREE}, h as (select * from t where type = 'file' and contains(lower(path), 'meeting')) select path, type from h union all select path, type from t where type = 'dir' and exists (select 1 from h where starts_with(h.path, t.path || '/'))",
    "switcher_score": f"""with {DOCS}, r as (select path, row_number() over (order by mtime desc nulls last, path) - 1 as recent from d order by mtime desc nulls last, path limit 30),
s as (select distinct path, {_word_sql('pro')} + {_word_sql('gar')} as score from d) select path, score::int as score from s left join r using (path) where score > 0 order by score desc, coalesce(recent, 1000000000), length(path), path limit 50""",
    "switcher_subsequence": f"with {DOCS} select path, score::int as score from (select distinct path, coalesce({_word_sql('hmd')}, case when regexp_matches({_NAME}, 'h.*m.*d') then 1 end) as score from d) where score > 0",
    "lru_recent": "select user_id, max(ts) as ts from events where user_id is not null group by 1 order by max(ts) desc, user_id limit 30",
    "version_retention": """select user_id, event_id from (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id) as k from events) where k <= 5 and ts >= (select max(ts) from events) - interval 7 days""",
    "debounce_sessions": """with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 60 seconds then 0 else 1 end as fresh from events where ts is not null),
y as (select *, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as b from x)
select user_id, min(ts) as burst_start, max(ts) as burst_end, count(*) as events from y group by user_id, b""",
    "editable_files": f"with {DOCS} select path, size from d where ext in ('.md', '.markdown', '.txt') and size <= 5000000 and not regexp_matches(path, '(^|/)\\.')",
    "scan_visible": f"""with {DOCS} select path from d where not regexp_matches(path, '(^|/)(\\.|~\\$)') and not regexp_matches(path, '(^|/)(node_modules|__pycache__|venv)/')
and lower(regexp_extract(path, '(\\.[^./]+)$', 1)) in ('.md', '.markdown', '.txt', '.rst', '.org', '.pdf', '.docx', '.pptx', '.xlsx', '.csv', '.html', '.htm', '.bmp', '.gif', '.jpeg', '.jpg', '.png', '.svg', '.webp')""",
}
