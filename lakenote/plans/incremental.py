"""Change capture and upkeep over the corpus tables, and their SQL.

The known state is each document's first index run, the listing its latest one without the removed documents.
"""

from pyspark.sql import functions as F

from lakenote.operators import incremental as I
from lakenote.plans.common import CHUNKS, DOCS, chunks, docs
from lakenote.plans.search import doc_images
from lakenote.tables import read


def _states(spark, d):
    """What was known before a day, and what is listed now: later runs, and changed sizes of every tenth document."""
    now = docs(spark, d)
    known = now.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 10 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime")
    gone = read(spark, d, "removed_docs").join(now, "path", "left_anti").select("path", F.lit(1).cast("bigint").alias("size"), F.col("removed_at").alias("mtime"))
    return now, known.unionByName(gone)


def snapshot_diff(spark, d):
    return I.snapshot_diff(*_states(spark, d))


def build_stats(spark, d):
    return I.status_counts(snapshot_diff(spark, d))


def missing_vectors(spark, d):
    return I.missing_vectors(chunks(spark, d), docs(spark, d), read(spark, d, "vectors"))


def vector_reuse(spark, d):
    """A new run renumbers all chunks and changes the text of every fifth; the others keep their vectors."""
    old = chunks(spark, d).join(docs(spark, d).select("doc_id", "title"), "doc_id")
    new = old.select((F.col("chunk_id") + 1_000_000).alias("chunk_id"), "doc_id", "title", "heading", F.when(F.col("chunk_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return I.reused_vectors(new, old, read(spark, d, "vectors")).select("chunk_id", F.size("vec").alias("dim"))


def stale_docs(spark, d):
    img = doc_images(spark, d)
    return I.stale_docs(img, img.where(F.col("key").like("%o%.png")))


def pending_images(spark, d):
    img = doc_images(spark, d).join(docs(spark, d).select("doc_id", "path"), "doc_id")
    return I.pending_images(img, img.select("key", F.col("key").like("%o%.png").alias("ocr_done")).distinct())


def image_text(spark, d):
    """Every image's text is its alternative text here."""
    c = chunks(spark, d).select("chunk_id", "text", "images")
    meta = c.select(F.explode("images").alias("i")).groupBy(F.col("i.url").alias("key")).agg(F.max("i.alt").alias("ocr"))
    return I.with_image_text(c, meta).select("chunk_id", "text")


def cascade_delete(spark, d):
    """Chunks without those of documents that failed."""
    return I.without_docs(chunks(spark, d).select("chunk_id", "doc_id"), docs(spark, d).where("error is not null or kind = 'image'"))


def near_exact_duplicates(spark, d):
    return I.same_content(read(spark, d, "documents").where("length(text) > 0"), "doc_id", "text")


def extract_cache(spark, d):
    """Extracts of all first runs: the paths whose file is as it was then need not be read again."""
    old = read(spark, d, "docs").where("doc_id % 3 > 0").select("path", I.stamp(F.col("mtime"), F.col("size"), "1").alias("stamp"))
    use, todo = I.cached_extracts(docs(spark, d).select("path", "mtime", "size"), old.dropDuplicates(["path", "stamp"]), "1")
    return use.select("path", F.lit("use").alias("what")).unionByName(todo.select("path", F.lit("read").alias("what")))


def upsert_docs(spark, d):
    """The table of first runs, with the rows of the latest runs put in."""
    first = read(spark, d, "docs").groupBy("doc_id").agg(F.min("indexed_at").alias("indexed_at"))
    late = docs(spark, d).where("doc_id % 2 = 0").select("doc_id", "indexed_at")
    return I.upsert(first, late, "doc_id")


STATE = f"""{DOCS}, k as (select path, case when doc_id % 10 = 0 then size + 1 else size end as size, mtime from d where doc_id % 7 <> 0 union all select path, 1, removed_at from removed_docs where path not in (select path from d)),
kk as (select path, any_value(size) as size, any_value(mtime) as mtime from k group by 1),
df as (select coalesce(n.path, k.path) as path, case when k.path is null then 'added' when n.path is null then 'removed' when n.size is not distinct from k.size and n.mtime is not distinct from k.mtime then 'unchanged' else 'updated' end as status from d n full join kk k on k.path = n.path)"""
IMAGES = """di as (select distinct doc_id, url_decode(regexp_extract(i.url, '^/api/file\\?path=(.*)$', 1)) as key from (select doc_id, unnest(images) as i from c) where i.url like '/api/file?path=_%' union select doc_id, path from d where kind = 'image')"""

QUERIES = {
    "snapshot_diff": snapshot_diff, "build_stats": build_stats, "missing_vectors": missing_vectors, "vector_reuse": vector_reuse, "stale_docs": stale_docs,
    "pending_images": pending_images, "image_text": image_text, "cascade_delete": cascade_delete, "near_exact_duplicates": near_exact_duplicates, "upsert_docs": upsert_docs, "extract_cache": extract_cache,
}
SQL = {
    "snapshot_diff": f"with {STATE} select path, status from df",
    "build_stats": f"with {STATE} select status, count(*) as files from df group by 1",
    "missing_vectors": f"with {DOCS} select distinct chunk_id, doc_id from chunks join d using (doc_id) where chunk_id not in (select chunk_id from vectors where vec is not null)",
    "vector_reuse": f"""with {DOCS}, {CHUNKS}, o as (select c.chunk_id, c.doc_id, d.title, c.heading, c.text, v.vec from c join d using (doc_id) left join (select * from vectors qualify row_number() over (partition by chunk_id) = 1) v using (chunk_id)),
n as (select chunk_id + 1000000 as chunk_id, doc_id, title, heading, case when chunk_id % 5 = 0 then text || '!' else text end as text from o)
select n.chunk_id, len(arg_max(o.vec, o.chunk_id))::int as dim from n join o on o.doc_id = n.doc_id and o.title is not distinct from n.title and o.heading is not distinct from n.heading and o.text is not distinct from n.text where o.vec is not null group by 1""",
    "stale_docs": f"with {DOCS}, {CHUNKS}, {IMAGES} select distinct doc_id from di where key like '%o%.png'",
    "pending_images": f"with {DOCS}, {CHUNKS}, {IMAGES} select key, min(path) as path from di join d using (doc_id) where key not like '%o%.png' group by 1",
    "image_text": f"""with {CHUNKS}, i as (select chunk_id, unnest(images) as i, unnest(range(len(images))) as n from c), m as (select i.url as url, max(i.alt) as ocr from i group by 1),
t as (select chunk_id, string_agg('[image' || case when length(i.alt) > 0 then ' ''' || i.alt || '''' else '' end || ' text in image: ' || trim(regexp_replace(ocr, '\\s+', ' ', 'g'))[1:1200] || ']', chr(10) || chr(10) order by n) as more from i join m on m.url = i.i.url where length(ocr) > 0 group by 1)
select chunk_id, trim(concat_ws(chr(10) || chr(10), text, more), ' ') as text from c left join t using (chunk_id)""",
    "cascade_delete": f"with {DOCS}, {CHUNKS} select chunk_id, doc_id from c where doc_id not in (select doc_id from d where error is not null or kind = 'image')",
    "near_exact_duplicates": "with g as (select text, min(doc_id) as first, count(distinct doc_id) as copies from documents where length(text) > 0 group by 1 having count(distinct doc_id) > 1) select distinct doc_id, first, copies from documents join g using (text)",
    "upsert_docs": f"with {DOCS} select doc_id, case when doc_id % 2 = 0 then d.indexed_at else f.indexed_at end as indexed_at from (select doc_id, min(indexed_at) as indexed_at from docs group by 1) f join d using (doc_id)",
    "extract_cache": f"""with {DOCS}, o as (select distinct path, mtime, size from docs where doc_id % 3 > 0 and mtime is not null and size is not null)
select d.path, case when o.path is null then 'read' else 'use' end as what from d left join o on o.path = d.path and o.mtime = d.mtime and o.size = d.size""",
}
