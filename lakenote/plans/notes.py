"""Markdown operators over the documents' texts as notes, and their SQL where it can say them."""

from pyspark.sql import functions as F

from lakenote.functions import markdown as M
from lakenote.functions import text as X
from lakenote.operators import notes as N
from lakenote.plans.common import CHUNKS, DOCS, docs
from lakenote.tables import read


def texts(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"))


def lines(spark, d):
    return texts(spark, d).where("body is not null").select("id", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "line"))


def note_files(spark, d):
    """The documents as files of a folder: a path and content each."""
    path = F.concat("source", F.lit("/"), F.coalesce(F.regexp_replace(F.lower(F.regexp_extract("text", r"^# *([^\r\n]+)", 1)), r"[^\p{L}\p{N}]+", "-"), F.lit("")), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, d, "documents").where("source is not null").select(path.alias("path"), F.col("text").alias("content"))


def sections_from_markdown(spark, d):
    return N.sections(texts(spark, d)).drop("trail")


def heading_crumbs(spark, d):
    return N.headings(lines(spark, d))


def note_outline(spark, d):
    return N.outline(heading_crumbs(spark, d))


def chunk_pack(spark, d):
    return N.chunk_notes(texts(spark, d)).select("id", "ord", "heading", "anchor", "text", F.size("images").alias("n_images"))


def slugify(spark, d):
    return docs(spark, d).where("title is not null").select("doc_id", X.slugify(F.col("title")).alias("slug"))


def plain_text(spark, d):
    return texts(spark, d).where("body is not null").select("id", X.plain_markdown(F.col("body")).alias("plain"))


def image_refs(spark, d):
    """The images of the passages, written into their texts as Markdown and as HTML, found again."""
    c = read(spark, d, "chunks").where("chunk_id is not null and text is not null").dropDuplicates(["chunk_id"])
    md = F.transform("images", lambda i: F.concat(F.lit("!["), F.coalesce(i["alt"], F.lit("")), F.lit("](/api/file?path="), X.url_path(i["url"]), F.lit(") <img alt='"), F.coalesce(i["alt"], F.lit("")), F.lit("' src='https://n.example/"), X.url_path(i["url"]), F.lit("'>")))
    noted = c.select("chunk_id", F.concat_ws("\n", "text", F.array_join(md, "\n")).alias("body"))
    return noted.select("chunk_id", F.explode(M.images(F.col("body"))).alias("i")).select("chunk_id", "i.url", "i.alt")


def note_tags(spark, d):
    n = N.read_notes(note_files(spark, d))
    return n.select("path", "title", F.array_join("tags", ",").alias("tags"))


def inline_tags(spark, d):
    return texts(spark, d).select("id", F.explode(X.inline_tags(F.col("body"))).alias("tag")).groupBy("tag").agg(F.countDistinct("id").alias("documents"), F.count("*").alias("uses"))


def word_counts(spark, d):
    return texts(spark, d).where("body is not null").select("id", X.word_count(F.col("body")).cast("bigint").alias("words"), X.excerpt(F.col("body"), 12).alias("excerpt"))


def note_links(spark, d):
    n = note_files(spark, d)
    return N.resolved(N.link_targets(n), n).select("path", "line", "form", "target", "found")


def broken_links(spark, d):
    n = note_files(spark, d)
    return N.broken_links(n, n)


def broken_totals(spark, d):
    return broken_links(spark, d).agg(F.count("*").alias("links"), F.countDistinct("path").alias("notes"))


def rewrite_links(spark, d):
    n = note_files(spark, d)
    return N.rewrite_links(n, n).select("path", F.size("links").alias("n_links"), F.md5("content").alias("content_md5"))


def _moved(n, new):
    return n.select(F.col("path").alias("src"), new.alias("dst")).where("src <> dst")


def relink_moved(spark, d):
    """All notes of one folder move into a folder below it."""
    n = note_files(spark, d)
    to = F.when(F.startswith("path", F.lit("vault-main/")), F.concat(F.lit("vault-main/archive/"), F.substring_index("path", "/", -1))).otherwise(F.col("path"))
    return N.relink(n, n, _moved(n, to), wiki=False)


def rename_wiki(spark, d):
    """Every second note takes a new name."""
    n = note_files(spark, d)
    to = F.when(F.pmod(F.hash("path"), F.lit(2)) == 0, F.regexp_replace("path", r"\.md$", "-renamed.md")).otherwise(F.col("path"))
    return N.relink(n, n, _moved(n, to))


def task_list(spark, d):
    return N.tasks(texts(spark, d).where("body is not null").select("id", F.regexp_replace("body", r"(?m)^- ", "- [ ] ").alias("body")))


def template_fill(spark, d):
    t = F.concat(F.lit("# {{title}}\n{{date}} {{ time }} {{date:DD.MM.YY [at] H}}\n"), F.coalesce("text", F.lit("")))
    now = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3601)
    return read(spark, d, "documents").select("doc_id", X.fill_template(t, F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), now, ("DD.MM.YY [at] H",)).alias("filled"))


def name_lookup(spark, d):
    return N.name_table(docs(spark, d))


def next_image_number(spark, d):
    return N.next_image_number(docs(spark, d).select(F.concat(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit("_"), (F.col("doc_id") % 50).cast("string"), F.lit(".png")).alias("path")))


_LINES = "ln as (select doc_id as id, unnest(l) as line, unnest(range(len(l)))::int as n from (select doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as l from documents where text is not null))"
_WS = "'[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{000b}\\x{001c}-\\x{001f}]+'"
_HEAD = f"'^(#{{1,6}}){_WS[1:-2]}+(.+?){_WS[1:-2]}*#*{_WS[1:-2]}*$'"
QUERIES = {
    "sections_from_markdown": sections_from_markdown, "heading_crumbs": heading_crumbs, "note_outline": note_outline, "chunk_pack": chunk_pack, "slugify": slugify, "plain_text": plain_text,
    "image_refs": image_refs, "note_tags": note_tags, "inline_tags": inline_tags, "word_counts": word_counts, "note_links": note_links, "broken_links": broken_links,
    "broken_totals": broken_totals, "rewrite_links": rewrite_links, "relink_moved": relink_moved, "rename_wiki": rename_wiki, "task_list": task_list,
    "template_fill": template_fill, "name_lookup": name_lookup, "next_image_number": next_image_number,
}
_CRUMB = ", ".join(f"case when level >= {k} and h{k}.n > greatest(-1{''.join(f', coalesce(h{j}.n, -1)' for j in range(1, k))}) then h{k}.heading end" for k in range(1, 7))
SQL = {
    "heading_crumbs": f"""with {_LINES}, f as (select *, sum(case when ltrim(line)[1:3] in ('```', '~~~') then 1 else 0 end) over (partition by id order by n) as fences from ln),
h as (select id, n, length(regexp_extract(line, {_HEAD}, 1))::int as level, trim(regexp_extract(line, {_HEAD}, 2)) as heading from f where fences % 2 = 0 and regexp_matches(line, {_HEAD})),
p as (select *, {", ".join(f"max(case when level = {k} then struct_pack(n := n, heading := heading) end) over (partition by id order by n) as h{k}" for k in range(1, 7))} from h)
select id, n, level, heading, concat_ws(' > ', {_CRUMB}) as crumb from p""",
    "image_refs": f"""with {CHUNKS}, i as (select chunk_id, unnest(images) as i from c where text is not null),
u as (select chunk_id, replace(replace(url_encode(i.url), '%2F', '/'), '%7E', '~') as url, coalesce(i.alt, '') as alt from i)
select chunk_id, '/api/file?path=' || url as url, trim(alt) as alt from u union all select chunk_id, 'https://n.example/' || url, alt from u""",
    "inline_tags": "select tag, count(distinct doc_id) as documents, count(*) as uses from (select doc_id, unnest(regexp_extract_all(text, '(?:^|\\s)#([A-Za-z][\\p{L}\\p{N}\\p{M}_/-]+)', 1)) as tag from documents) group by 1",
    "slugify": f"with {DOCS} select doc_id, regexp_replace(trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s-]', '', 'g')), '\\s+', '-', 'g') as slug from d where title is not null",
    "word_counts": f"""with t as (select doc_id as id, trim(regexp_replace(text, {_WS}, ' ', 'g'), ' ') as s from documents where text is not null)
select id, case when s = '' then 0 else len(string_split(s, ' ')) end as words, array_to_string(string_split(s, ' ')[1:12], ' ') || case when len(string_split(s, ' ')) > 12 then ' …' else '' end as excerpt from t""",
    "name_lookup": f"""with {DOCS}, n as (select path, lower(string_split(path, '/')[-1]) as name from d), k as (select path, name as k from n union select path, regexp_replace(name, '(.)\\.[^.]*$', '\\1') from n)
select 'path:' || path as key, path as found from d union all select 'name:' || k, min(struct_pack(n := length(path), path := path)).path from k group by k""",
    "next_image_number": f"""with {DOCS}, p as (select regexp_replace(path, '\\.[^.]*$', '') || '_' || (doc_id % 50) || '.png' as path from d)
select regexp_replace(regexp_replace(path, '[^/]*$', ''), '/$', '') as folder, lower(regexp_extract(path, '([^/]+)_(\\d{{1,9}})\\.[^./]+$', 1)) as stem, (max(regexp_extract(path, '([^/]+)_(\\d{{1,9}})\\.[^./]+$', 2)::int) + 1)::int as next from p group by 1, 2""",
    "template_fill": """select doc_id, '# Doc ' || doc_id || chr(10) || strftime(t, '%Y-%m-%d %H:%M ') || strftime(t, '%d.%m.%y') || ' at ' || hour(t) || chr(10) || coalesce(text, '') as filled from (select *, make_timestamp((1700000000 + doc_id * 3601) * 1000000) as t from documents)""",
}
SQL["note_outline"] = f"""with x as ({SQL["heading_crumbs"]}), y as (select *, regexp_replace(trim(regexp_replace(lower(heading), '[^\\p{{L}}\\p{{N}}\\p{{M}}_{_WS[2:-3]}-]', '', 'g')), {_WS}, '-', 'g') as slug from x where level <= 4)
select id, n, level, heading, slug || case when k > 1 then '-' || (k - 1) else '' end as anchor from (select *, row_number() over (partition by id, slug order by n) as k, count(*) over (partition by id) as c from y) where c > 1"""

_IN = _WS[2:-3]
SQL["sections_from_markdown"] = f"""with x as ({SQL["heading_crumbs"]}),
l as (select doc_id as id, unnest(l) as line, unnest(range(len(l)))::int as n from (select doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{{000b}}\\x{{000c}}\\x{{0085}}\\x{{2028}}\\x{{2029}}]') as l from documents where text is not null)),
m as (select l.id, l.n, l.line, x.crumb, x.level from l left join x on x.id = l.id and x.n = l.n union all select doc_id, -1, null, 'Document ' || doc_id, 1 from documents where text is not null),
p as (select *, count(crumb) over (partition by id order by n) - 1 as part from m),
s as (select id, part, max(crumb) as heading, regexp_replace(coalesce(string_agg(case when crumb is null then line end, chr(10) order by n), ''), '^[{_IN}]+|[{_IN}]+$', '', 'g') as text from p group by 1, 2)
select id, (row_number() over (partition by id order by part) - 1)::int as ord, heading, len(string_split(heading, ' > '))::int as level, text from s where part > 0 or text <> ''"""
_FILES = """f as (select source || '/' || coalesce(regexp_replace(lower(regexp_extract(text, '^# *([^\\r\\n]+)', 1)), '[^\\p{L}\\p{N}]+', '-', 'g'), '') || '-' || doc_id || '.md' as path, text from documents where source is not null and text is not null)"""
_BLANK = f"[{_IN}]".replace("\\s", " \\t\\x{000c}")
SQL["note_tags"] = f"""with {_FILES}, m as (select path, regexp_extract(text, '(?s)^---[ \\t]*\\r?\\n(.*?)\\r?\\n(?:---|\\.\\.\\.)[ \\t]*\\r?\\n', 1) as meta,
  substring(text, length(regexp_extract(text, '(?s)^---[ \\t]*\\r?\\n(.*?)\\r?\\n(?:---|\\.\\.\\.)[ \\t]*\\r?\\n', 0)) + 1) as text from f),
h as (select *, regexp_replace(regexp_extract(text, '(?m)^#{_BLANK}+([^\\r\\n]+?){_BLANK}*#*{_BLANK}*$', 1), '\\s*\\{{#([\\w-]+)\\}}\\s*$', '') as head,
  regexp_extract(meta, '(?im)^title[ \\t]*:[ \\t]*(\\S[^\\r\\n]*)', 1) as named,
  list_filter(list_transform(case when regexp_matches(meta, '(?im)^tags[ \\t]*:[ \\t]*\\[') then string_split(regexp_extract(meta, '(?im)^tags[ \\t]*:[ \\t]*\\[([^\\]]*)\\]', 1), ',')
    when regexp_matches(meta, '(?im)^tags[ \\t]*:[ \\t]*\\S') then regexp_split_to_array(regexp_extract(meta, '(?im)^tags[ \\t]*:[ \\t]*([^\\r\\n]*)', 1), '[,\\s]+')
    else regexp_extract_all(meta, '(?m)^[ \\t]+-[ \\t]+([^\\r\\n]*)', 1) end, lambda t: trim(trim(t), $$'"$$)), lambda t: t <> '') as given,
  regexp_extract_all(text, '(?:^|[{_IN}])#([A-Za-z][\\p{{L}}\\p{{N}}\\p{{M}}_/-]+)', 1) as inside from m)
select path, case when named <> '' then trim(named, $$'"$$) when head <> '' then head else regexp_replace(string_split(path, '/')[-1], '\\.md$', '') end as title,
  array_to_string(given || list_filter(inside, lambda t: not list_contains(given, t)), ',') as tags from h"""
_SIZE = "\\s*\\|\\s*\\d+(?:\\s*x\\s*\\d+)?\\s*"
SQL["plain_text"] = f"""with a as (select doc_id as id, regexp_replace(text, '!\\[{_SIZE}\\]\\([^)\\s]+\\)', '', 'g') as t from documents where text is not null),
b as (select id, replace(regexp_replace(t, '!\\[([^\\]]*?)(?:{_SIZE})?\\]\\([^)\\s]+\\)', '[image: \\1]', 'g'), '[image: ]', '') as t from a)
select id, trim(regexp_replace(regexp_replace(t, '<img\\b[^>]*?\\bsrc\\s*=[^>]*>', '', 'gi'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), ' ') as plain from b"""
SQL["task_list"] = f"""with l as (select doc_id as id, unnest(l) as line, unnest(range(len(l)))::int as n from (select doc_id, string_split(regexp_replace(text, '(?m)^- ', '- [ ] ', 'g'), chr(10)) as l from documents where text is not null)),
f as (select *, regexp_matches(line, '^[ \\t]*(```|~~~)') as mark, sum(case when regexp_matches(line, '^[ \\t]*(```|~~~)') then 1 else 0 end) over (partition by id order by n) as fences from l),
t as (select *, regexp_extract(line, '^[ \\t]*(?:>[ \\t]?)*[ \\t]*(?:(?:[-*+]|\\d{{1,9}}[.)])[ \\t]+)?\\[([ xX])\\][ \\t]+\\S', 1) as sign from f)
select id, (row_number() over (partition by id order by n) - 1)::int as task, n + 1 as line, sign <> ' ' as checked from t where not mark and fences % 2 = 0 and sign <> ''"""
