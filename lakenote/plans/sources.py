"""Readers, page layout and streams over the given tables."""

import uuid

from pyspark.sql import functions as F

from lakenote.engine import Engine
from lakenote.operators.filters import IMAGES, Filters
from lakenote.operators.hybrid import HashEmbedder, LexicalReranker
from lakenote.plans.common import DOCS, docs
from lakenote.sources import layout, readers
from lakenote.streaming.watch import burst_stream
from lakenote.tables import ensure_checkpoint_dir, read


def pages(spark, d):
    """Each document as an HTML page: its heading as title, paragraphs, and a link to its source."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.replace(esc(F.col("text")), F.lit("\n\n"), F.lit("</p>\n<p>"))
    html = F.concat(F.lit("<html><head><title> Page "), F.col("doc_id").cast("string"), F.lit("</title><style>p {}</style></head><body><h1>Doc</h1><p>"), body, F.lit("</p><a href='/s/"), F.coalesce("source", F.lit("none")), F.lit("'>source</a></body></html>"))
    return read(spark, d, "documents").where("text is not null").select(F.concat(F.lit("pages/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), html.alias("html"))


def html_to_markdown(spark, d):
    r = readers.read_files(pages(spark, d).select("path", F.col("html").cast("binary").alias("content")))
    return r.select("path", "title", F.md5("markdown").alias("markdown_md5"), F.length("markdown").alias("chars"), "error")


def csv_tables(spark, d):
    """The orders as CSV files of some 2,000 lines each, read as Markdown tables with all their rows."""
    o = read(spark, d, "orders").where("o_orderkey is not null")
    parts = max(1, o.count() // 2000)
    rows = F.array_join(F.sort_array(F.collect_list(F.concat_ws(";", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")))), "\n")
    files = o.groupBy(F.pmod("o_orderkey", F.lit(parts)).alias("part")).agg(F.concat(F.lit("order;customer\n"), rows).alias("text"))
    t = readers.csv_markdown(files.select(F.concat(F.lit("orders/"), F.col("part").cast("string"), F.lit(".csv")).alias("path"), "text"), None, None)
    return t.select("path", F.regexp_count("markdown", F.lit(r"\n")).cast("bigint").alias("rows"), F.md5("markdown").alias("digest"))


def file_kinds(spark, d):
    from lakenote.sources.files import extension, folder, kind, stem

    p = F.col("path")
    return docs(spark, d).select("path", extension(p).alias("ext"), stem(p).alias("stem"), folder(p).alias("folder"), kind(p).alias("reader"))


def blocks(spark, d):
    """The lines of page passages as layout blocks: the first and last line lie in the margin, lines in capitals are larger."""
    c = read(spark, d, "chunks").where(F.col("anchor").rlike(r"^page-\d+$") & F.col("text").isNotNull()).select("doc_id", F.substring("anchor", 6, 9).cast("int").alias("page"), F.split("text", r"\r\n|\r|\n").alias("l")).distinct()
    b = c.select("doc_id", "page", F.size("l").alias("k"), F.posexplode("l").alias("n", "text")).where("length(trim(text)) > 0")
    big = F.col("text").rlike(r"^[^a-z]{6,}$")
    return b.select("doc_id", "page", "n", F.col("n").cast("double").alias("y"), "text", F.lit("text").alias("kind"), F.when(big, 16.0).otherwise(11.0).alias("size"), ((F.col("n") == 0) | (F.col("n") == F.col("k") - 1)).alias("margin"))


def running_headers(spark, d):
    return layout.running_lines(blocks(spark, d))


def font_headings(spark, d):
    return layout.font_headings(layout.without_running_lines(blocks(spark, d))).where("level is not null").select("doc_id", "page", "n", "text", "level")


def page_markdown(spark, d):
    m = layout.to_markdown(layout.font_headings(layout.without_running_lines(blocks(spark, d))))
    return m.select("doc_id", F.md5("markdown").alias("markdown_md5"), F.length("markdown").alias("chars"))


def debounce_stream(spark, d):
    """Closed bursts of each user's events by a streaming job over the events file, run to its end and read from its sink.

    A burst is closed once an event is later than its end by the gap; the open ones of the last minute are not there yet.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/bursts-{uuid.uuid4().hex}"
    # a pattern, so that a file will do as well as a folder
    src = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    bursts = burst_stream(src.where("ts is not null"), "ts", "60 seconds", "0 seconds", ["user_id"])
    q = bursts.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(bursts.schema).parquet(f"{base}/out").select("user_id", "burst_start", F.col("burst_end"), "events")


def _engine(spark, d):
    return Engine.from_tables(spark, d, embedder=HashEmbedder(), reranker=LexicalReranker())


def engine_search(spark, d):
    hits = _engine(spark, d).search("how do I calibrate the garden router?", Filters(types=("markdown",)), 20, 2)
    return hits.select("n", "chunk_id", "path", "match", "rerank", "score", "snippet")


def engine_ask(spark, d):
    return _engine(spark, d).ask("which \"open-plan\" kitchen has a table?", mode="report")


_B = """b as (select distinct doc_id, page, n, k, text from (select doc_id, page, len(l) as k, unnest(l) as text, unnest(range(len(l)))::int as n from (select distinct doc_id, substring(anchor, 6, 9)::int as page, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as l from chunks where regexp_matches(anchor, '^page-[0-9]+$') and text is not null)) where length(trim(text)) > 0)"""
QUERIES = {
    "html_to_markdown": html_to_markdown, "csv_tables": csv_tables, "file_kinds": file_kinds, "running_headers": running_headers, "font_headings": font_headings,
    "page_markdown": page_markdown, "debounce_stream": debounce_stream, "engine_search": engine_search, "engine_ask": engine_ask,
}
SQL = {
    "csv_tables": """with n as (select greatest(1, count(*) // 2000) as parts from orders where o_orderkey is not null)
select 'orders/' || (o_orderkey % parts) || '.csv' as path, count(*) + 1 as rows, md5('| order | customer |' || chr(10) || '| --- | --- |' || chr(10) ||
  string_agg('| ' || o_orderkey || ' | ' || coalesce(o_custkey::varchar, '') || ' |', chr(10) order by o_orderkey || ';' || coalesce(o_custkey::varchar, ''))) as digest
from orders, n where o_orderkey is not null group by 1""",
    "file_kinds": f"""with {DOCS}, p as (select path, string_split(path, '/')[-1] as name, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as ext from d)
select path, ext, regexp_replace(name, '(.)\\.[^.]*$', '\\1') as stem, regexp_replace(regexp_replace(path, '[^/]*$', ''), '/$', '') as folder,
case when ext in ('.md', '.markdown') then 'markdown' when ext in ('.txt', '.rst', '.org') then 'text' when ext in ('.pdf', '.docx', '.pptx', '.xlsx', '.csv') then ext[2:]
  when ext in ('.html', '.htm') then 'html' when ext in ({", ".join(f"'{e}'" for e in sorted(IMAGES))}) then 'image' end as reader from p""",
    "running_headers": f"""with {_B}, m as (select doc_id, page, regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') as key from b where n = 0 or n = k - 1),
p as (select doc_id, count(distinct page) as pages from b group by 1 having count(distinct page) >= 3)
select doc_id, key from (select doc_id, key, count(distinct page) as n from m group by 1, 2) join p using (doc_id) where n >= greatest(3, least(pages * 0.05, 10))""",
    "debounce_stream": """with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 60 seconds then 0 else 1 end as fresh from events where ts is not null),
y as (select *, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as b from x)
select user_id, min(ts) as burst_start, max(ts) as burst_end, count(*) as events from y group by user_id, b having max(ts) <= (select max(ts) from events) - interval 60 seconds""",
}
