"""Filters, keyword, semantic and hybrid search over the corpus tables, and their SQL."""

from pyspark.sql import functions as F

from lakenote.operators import hybrid as H
from lakenote.operators import keyword as K
from lakenote.operators.filters import Filters, without_embedded_images
from lakenote.tables import checkpoint
from lakenote.plans.common import CHUNKS, DOCS, EXCERPT, TOKENS, UNITS, chunks, docs, units

NOW = "2026-01-01 00:00:00"
FILTERS = {
    "filter_folder": (Filters(folder="projects"), "(folder = 'projects' or folder ilike 'projects/%')"),
    "filter_tag": (Filters(tag="#Home"), "len(list_filter(tags, lambda t: lower(t) = 'home' or starts_with(lower(t), 'home/'))) > 0"),
    "filter_types": (Filters(types=("markdown", "spreadsheet", "pdf ")), "ext in ('.md', '.markdown', '.xlsx', '.csv', '.pdf')"),
    "filter_days": (Filters(days=200, now=NOW), f"mtime >= timestamptz '{NOW}+00' - interval 200 days"),
    "filter_path": (Filters(path="home.md"), "path = 'home.md'"),
    "filter_combined": (
        Filters(types=("markdown",), folder="/home/", tag="home", days=600, now=NOW),
        f"ext in ('.md', '.markdown') and (folder = 'home' or folder ilike 'home/%') and len(list_filter(tags, lambda t: lower(t) = 'home' or starts_with(lower(t), 'home/'))) > 0 and mtime >= timestamptz '{NOW}+00' - interval 600 days",
    ),
}


def filtered(f):
    return lambda spark, d: docs(spark, d).where(f.predicate()).select("doc_id", "path")


def doc_images(spark, d):
    key = F.url_decode(F.regexp_extract("i.url", r"^/api/file\?path=(.*)$", 1))
    shown = chunks(spark, d).select("doc_id", F.explode("images").alias("i")).select("doc_id", key.alias("key")).where("key <> ''")
    return shown.unionByName(docs(spark, d).where("kind = 'image'").select("doc_id", F.col("path").alias("key"))).distinct()


def loose_image_anti(spark, d):
    return without_embedded_images(docs(spark, d), doc_images(spark, d)).select("doc_id", "path", "kind")


def source_fields(spark, d):
    return chunks(spark, d).join(docs(spark, d).select("doc_id", "path", "title", "ext"), "doc_id").select("chunk_id", "path", "title", "heading", "anchor", "ext", F.size("images").alias("n_images"))


def rows(spark, d):
    return K.indexed(chunks(spark, d), docs(spark, d))


def posting_list(spark, d):
    return K.postings(rows(spark, d)).where("term in ('garden', 'jardin', 'router')").select("term", "chunk_id", F.col("col").cast("int").alias("col"), F.array_join("positions", ",").alias("positions"))


def term_df(spark, d):
    return K.postings(rows(spark, d)).groupBy("term").agg(F.countDistinct("chunk_id").alias("df"), F.sum(F.size("positions")).alias("tf"))


def doc_length(spark, d):
    return K.doc_lengths(rows(spark, d)).withColumn("n_tokens", F.col("n_tokens").cast("bigint"))


BM25 = {
    "bm25_single": ([K.Term(("garden",))], 10), "bm25_multi_or": ([K.Term(("garden",)), K.Term(("calendar",)), K.Term(("router",))], 25),
    "bm25_prefix": ([K.Term(("gard",), True)], 25), "bm25_phrase": ([K.Term(("somebody", "had", "to")), K.Term(("kitchen",))], 25),
    "bm25_weighted_cols": ([K.Term(("home",)), K.Term(("finance",)), K.Term(("manual",))], 25),
}


def scored(terms, k):
    def run(spark, d):
        r = rows(spark, d)
        return K.bm25(K.postings(r), K.doc_lengths(r), terms).select("chunk_id", F.round("score", 6).alias("score")).orderBy("score", "chunk_id").limit(k)

    return run


QUESTION = "how do I calibrate the garden router?"


def keyword_hits(spark, d):
    """Keyword search with filters, unstemmed, as a page of hits."""
    where = Filters(types=("markdown", "pdf")).predicate()
    hits = K.keyword_search(chunks(spark, d), docs(spark, d), QUESTION, where, 20, stemming=False)
    return hits.select("rank", "chunk_id", "path", "title", "heading", F.round("score", 6).alias("score"))


def bm25_stemmed(spark, d):
    hits = K.keyword_search(chunks(spark, d), docs(spark, d), QUESTION, None, 20)
    return hits.select("rank", "chunk_id", "path", F.round("score", 6).alias("score"))


def snippet_top10(spark, d):
    hits = K.keyword_search(chunks(spark, d), docs(spark, d), QUESTION, None, 10).select("rank", "chunk_id", "text")
    return K.snippets(hits, K.split_terms(K.parse(QUESTION), True), True).drop("text")


def first_vector(u):
    """The vector of the smallest chunk_id as the question."""
    got = u.orderBy("chunk_id").limit(1).collect()
    return list(got[0]["vec"]) if got else [0.0] * 64


def vector_topk(spark, d):
    u = units(spark, d)
    return H.vector_topk(u, first_vector(u), 20).select("chunk_id", F.round("sim", 6).alias("sim"))


def vector_topk_filtered(spark, d):
    u = units(spark, d)
    hits = H.semantic_search(u, chunks(spark, d), docs(spark, d), first_vector(u), Filters(folder="projects").predicate(), 10, -1.0, prefilter=True)
    return hits.select("rank", "chunk_id", "path", "similarity", "snippet")


def vector_post_filter(spark, d):
    u = units(spark, d)
    hits = H.semantic_search(u, chunks(spark, d), docs(spark, d), first_vector(u), Filters(types=("markdown",)).predicate(), 10, 0.1)
    return hits.select("rank", "chunk_id", "path", "similarity")


def _lists(spark, d):
    u = units(spark, d)
    kw = K.keyword_search(chunks(spark, d), docs(spark, d), "garden calendar", None, 40, stemming=False)
    sem = H.semantic_search(u, chunks(spark, d), docs(spark, d), first_vector(u), None, 40, 0.0)
    return checkpoint(kw), checkpoint(sem)  # 40 rows each


def rrf_hybrid(spark, d):
    kw, sem = _lists(spark, d)
    return H.fuse(kw, sem).select("chunk_id", F.round("rrf", 9).alias("rrf"), "match", "fused")


def _reranked(spark, d):
    kw, sem = _lists(spark, d)
    texts = chunks(spark, d).join(docs(spark, d).select("doc_id", "path", "title", "ext"), "doc_id")
    r = H.rerank(H.fuse(kw, sem), kw, sem, texts.select("chunk_id", "title", "heading", "text"), "garden calendar", H.LexicalReranker())
    return r.join(texts, "chunk_id")


def rerank_lexical(spark, d):
    return _reranked(spark, d).select("chunk_id", "match", "fused", "rerank", "final")


def per_doc_cap(spark, d):
    """The keyword list with at most two passages of a document."""
    kw = K.keyword_search(chunks(spark, d), docs(spark, d), "garden calendar", None, 200, stemming=False)
    return H.cap_per_document(kw, 2, 20, rank="rank").select("n", "chunk_id", "path")


def _page(spark, d):
    kw = K.keyword_search(chunks(spark, d), docs(spark, d), "garden calendar", None, 48, stemming=False)
    return H.cap_per_document(kw, 4, 12, rank="rank").withColumn("snippet", F.lit(""))


def answer_summary(spark, d):
    return H.answer(_page(spark, d), "summary")


def answer_report(spark, d):
    return H.answer(_page(spark, d), "report")


BASE = f"with {DOCS}, {CHUNKS}, "
ROWS = "r as (select c.chunk_id, d.doc_id, d.title, c.heading, c.text, array_to_string(d.tags, ' ') as tags from c join d using (doc_id))"
TOK = f"""cell as (select chunk_id, 0 as col, title as s from r union all select chunk_id, 1, heading from r union all select chunk_id, 2, text from r union all select chunk_id, 3, tags from r),
lst as (select chunk_id, col, {TOKENS.format('s')} as l from cell where s is not null),
tok as (select chunk_id, col, unnest(l) as term, unnest(range(len(l))) as pos from lst),
dl as (select r.chunk_id, coalesce(sum(len(l)), 0)::bigint as n_tokens from r left join lst using (chunk_id) group by 1)"""
INDEX = f"{BASE}{ROWS}, {TOK}"


def bm25_sql(terms: list[K.Term]) -> str:
    """CTEs ending in s (chunk_id, score)."""
    parts = []
    for n, t in enumerate(terms):
        cond = " and ".join(f"t{i}.chunk_id = t0.chunk_id and t{i}.col = t0.col and t{i}.pos = t0.pos + {i}" for i in range(1, len(t.words))) or "true"
        match = " and ".join(f"starts_with(t{i}.term, '{w}')" if t.prefix and i == len(t.words) - 1 else f"t{i}.term = '{w}'" for i, w in enumerate(t.words))
        parts.append(f"select {n} as no, t0.chunk_id, t0.col from {', '.join(f'tok t{i}' for i in range(len(t.words)))} where {cond} and {match}")
    return f"""f as (select no, chunk_id, sum(case col when 0 then 4.0 when 1 then 3.0 when 2 then 1.0 else 2.0 end)::double as f from ({' union all '.join(parts)}) group by 1, 2),
nn as (select no, count(*) as n from f group by 1), g as (select count(*) as docs, avg(n_tokens) as avgdl from dl),
w as (select no, case when ln((docs - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((docs - n + 0.5) / (n + 0.5)) end as idf, avgdl from nn, g),
s as (select f.chunk_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / avgdl))) as score from f join w using (no) join dl using (chunk_id) group by 1)"""


KW2 = [K.Term(("garden",), True), K.Term(("calendar",), True)]
HIT = f"{INDEX}, {bm25_sql(KW2)}"
RANKED = "k as (select c.chunk_id, d.path, d.title, c.heading, c.text, c.images, row_number() over (order by score, c.chunk_id) - 1 as rank from s join c using (chunk_id) join d using (doc_id) qualify rank < {})"
FIRST = "q as (select v from u order by chunk_id limit 1), sims as (select u.chunk_id, list_dot_product(u.v, q.v) as sim from u, q)"
SEM = f"""{UNITS}, {FIRST}, top as (select * from sims order by sim desc, chunk_id limit 200),
m as (select chunk_id, row_number() over (order by round(sim, 3) desc, sim desc, chunk_id) - 1 as rank from top join c using (chunk_id) join d using (doc_id) where sim >= 0.0 qualify rank < 40)"""
FUSE = """b as (select chunk_id, rank, 0 as src from k union all select chunk_id, rank, 1 from m),
fu as (select chunk_id, sum(1.0::double / (61 + rank)) as rrf, case when count(*) > 1 then 'both' when max(src) = 0 then 'keyword' else 'semantic' end as match, min(src * 1000 + rank) as first from b group by 1),
fz as (select chunk_id, rrf, match, (row_number() over (order by round(rrf, 12) desc, first) - 1)::int as fused from fu)"""
FOLDED = "list_distinct(string_split_regex(trim(lower(strip_accents({}))), '\\s+'))"
PAGE = f"""{HIT}, {RANKED.format(48)}, p as (select *, row_number() over (order by rank) as n from (select *, row_number() over (partition by path order by rank) as kk from k) where kk <= 4 qualify n <= 12)"""


def answer_sql(take: int, words: int, images: int) -> str:
    mark = "\\s*\\[image(?: (?:''[^'']*''|\"[^\"]*\"))?(?: text in image)?: [^\\]]*\\]"
    text = EXCERPT.format("text", words)
    return f"""{PAGE} select n::int as n, array_to_string(['### [' || n || '] ' || coalesce(title, '') || ' — ' || coalesce(heading, ''), '', '> ' || replace(regexp_replace({text}, '{mark}', '', 'g'), chr(10), chr(10) || '> '), '']
  || list_transform(coalesce(images, [])[1:{images}], lambda i: '![' || coalesce(nullif(i.alt, ''), heading) || '](' || i.url || ')' || chr(10)), chr(10)) as passage from p where n <= {take}"""


QUERIES = {
    **{k: filtered(f) for k, (f, _) in FILTERS.items()}, **{k: scored(*v) for k, v in BM25.items()},
    "loose_image_anti": loose_image_anti, "source_fields": source_fields, "posting_list": posting_list, "term_df": term_df, "doc_length": doc_length,
    "keyword_hits": keyword_hits, "bm25_stemmed": bm25_stemmed, "snippet_top10": snippet_top10, "vector_topk": vector_topk,
    "vector_topk_filtered": vector_topk_filtered, "vector_post_filter": vector_post_filter, "rrf_hybrid": rrf_hybrid, "rerank_lexical": rerank_lexical,
    "per_doc_cap": per_doc_cap, "answer_summary": answer_summary, "answer_report": answer_report,
}
SQL = {
    **{k: f"with {DOCS} select doc_id, path from d where {w}" for k, (_, w) in FILTERS.items()},
    **{k: f"{INDEX}, {bm25_sql(t)} select chunk_id, round(score, 6) as score from s order by round(score, 6), chunk_id limit {n}" for k, (t, n) in BM25.items()},
    "loose_image_anti": f"""{BASE} di as (select doc_id, url_decode(regexp_extract(i.url, '^/api/file\\?path=(.*)$', 1)) as key from (select doc_id, unnest(images) as i from c) union select doc_id, path from d where kind = 'image')
select doc_id, path, kind from d where not (kind = 'image' and exists (select 1 from di mine join di other on other.key = mine.key join d n on n.doc_id = other.doc_id where mine.doc_id = d.doc_id and n.kind = 'note' and mine.key <> ''))""",
    "source_fields": f"with {DOCS}, {CHUNKS} select chunk_id, path, title, heading, anchor, ext, len(images)::int as n_images from c join d using (doc_id)",
    "posting_list": f"{INDEX} select term, chunk_id, col::int as col, string_agg(pos::varchar, ',' order by pos) as positions from tok where term in ('garden', 'jardin', 'router') group by 1, 2, 3",
    "term_df": f"{INDEX} select term, count(distinct chunk_id) as df, count(*) as tf from tok group by 1",
    "doc_length": f"{INDEX} select chunk_id, n_tokens from dl",
    "keyword_hits": f"""{INDEX}, {bm25_sql(K.parse(QUESTION))} select row_number() over (order by score, c.chunk_id) - 1 as rank, c.chunk_id, d.path, d.title, c.heading, round(score, 6) as score
from s join c using (chunk_id) join d using (doc_id) where ext in ('.md', '.markdown', '.pdf') qualify rank < 20""",
    "vector_topk": f"with {UNITS}, {FIRST} select chunk_id, round(sim, 6) as sim from sims order by sims.sim desc, chunk_id limit 20",
    "vector_topk_filtered": f"""{BASE}{UNITS}, {FIRST}, top as (select sims.* from sims join c using (chunk_id) join d using (doc_id) where (folder = 'projects' or folder ilike 'projects/%') order by sim desc, chunk_id limit 50)
select row_number() over (order by round(sim, 3) desc, sim desc, chunk_id) - 1 as rank, chunk_id, path, round(sim, 3) as similarity, {EXCERPT.format('text', 40)} as snippet from top join c using (chunk_id) join d using (doc_id) qualify rank < 10""",
    "vector_post_filter": f"""{BASE}{UNITS}, {FIRST}, top as (select * from sims order by sim desc, chunk_id limit 50)
select row_number() over (order by round(sim, 3) desc, sim desc, chunk_id) - 1 as rank, chunk_id, path, round(sim, 3) as similarity from top join c using (chunk_id) join d using (doc_id) where sim >= 0.1 and ext in ('.md', '.markdown') qualify rank < 10""",
    "rrf_hybrid": f"{HIT}, {RANKED.format(40)}, {SEM}, {FUSE} select chunk_id, round(rrf, 9) as rrf, match, fused from fz",
    "rerank_lexical": f"""{HIT}, {RANKED.format(40)}, {SEM}, {FUSE},
pool as (select chunk_id from fz where fused < 20 union select chunk_id from k where rank < 15 union select chunk_id from m where rank < 15),
sc as (select chunk_id, round(len(list_intersect({FOLDED.format("substr(concat_ws(chr(10), title, heading, text), 1, 1500)")}, ['garden', 'calendar'])) / 2.0, 3)::double as rerank from pool join c using (chunk_id) join d using (doc_id))
select fz.chunk_id, match, fused, rerank, (row_number() over (order by rerank is null, rerank desc, fused) - 1)::int as final from fz left join sc using (chunk_id)""",
    "per_doc_cap": f"{HIT}, {RANKED.format(200)} select row_number() over (order by rank) as n, chunk_id, path from (select *, row_number() over (partition by path order by rank) as kk from k) where kk <= 2 qualify n <= 20",
    "answer_summary": answer_sql(4, 70, 1), "answer_report": answer_sql(10, 250, 3),
}
