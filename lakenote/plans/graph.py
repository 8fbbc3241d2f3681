"""Links, similar notes and the note graph over the corpus tables, and their SQL."""

from pyspark.sql import functions as F

from lakenote.operators import graph as G
from lakenote.plans.common import CHUNKS, DOCS, UNITS, chunks, docs, units
from lakenote.tables import read

HOME = "home.md"


def links(spark, d):
    return read(spark, d, "links")


def link_rows(spark, d):
    return G.link_pairs(links(spark, d), docs(spark, d)).select("src_path", "dst_path", "dst_title", "dst_ext")


def outgoing_links(spark, d):
    """Links of every document, counted by the extension they lead to."""
    return G.link_pairs(links(spark, d), docs(spark, d)).groupBy("src_path", "dst_ext").agg(F.count("*").alias("links"))


def backlinks(spark, d):
    return G.backlinks(links(spark, d), docs(spark, d), HOME)


def unlinked_notes(spark, d):
    return G.unlinked(links(spark, d), docs(spark, d))


def edges(spark, d):
    return G.link_pairs(links(spark, d), docs(spark, d)).select(F.col("src_path").alias("source"), F.col("dst_path").alias("target")).where("source <> target").distinct()


def node_degree(spark, d):
    return G.degrees(edges(spark, d))


def two_hop(spark, d):
    return G.within_hops(edges(spark, d), F.col("path").startswith("templates/"))


def vectors(spark, d):
    return G.doc_vectors(chunks(spark, d), units(spark, d), docs(spark, d))


def doc_vectors(spark, d):
    return vectors(spark, d).select("doc_id", F.posexplode("vec").alias("i", "x")).select("doc_id", "i", F.round("x", 6).alias("x"))


def similar_docs(spark, d):
    """The notes most similar to the note of the smallest id that has vectors."""
    v = vectors(spark, d)
    first = v.agg(F.min("doc_id")).collect()[0][0]
    return G.similar_to(v, first if first is not None else -1, 6, 0.0).select("doc_id", F.round("sim", 6).alias("sim"))


#: Least cosine of similar notes: 0.15 above the least of the stand-in vectors (Engine._least).
NEAR = 0.45


def similar_graph_top3(spark, d):
    """Each note's three most similar notes, every pair compared."""
    return G.neighbours(vectors(spark, d), 3, NEAR).select("doc_id", "other", F.round("sim", 6).alias("sim"))


def graph_edges(spark, d):
    return G.graph_edges(links(spark, d), docs(spark, d), G.neighbours(vectors(spark, d), 3, NEAR)).groupBy("source", "target", "type").agg(F.max("weight").alias("weight"))


def link_edges(spark, d):
    none = G.neighbours(vectors(spark, d).where("doc_id is null"), 3, NEAR)
    return G.graph_edges(links(spark, d), docs(spark, d), none).select("source", "target", "type")


def graph_nodes(spark, d):
    return docs(spark, d).where("kind = 'note'").select("path", "title", "ext", "folder")


def graph_counts(spark, d):
    return link_edges(spark, d).groupBy("type").agg(F.count("*").alias("edges"))


LINKS = f"{DOCS}, l as (select distinct src_id, dst_path from links where src_id is not null and dst_path is not null)"
PAIRS = f"{LINKS}, lp as (select distinct s.path as src_path, s.title as src_title, t.path as dst_path, t.title as dst_title, t.ext as dst_ext, t.kind as dst_kind from l join d s on s.doc_id = l.src_id join d t on t.path = l.dst_path)"
EDGES = f"{PAIRS}, e as (select distinct src_path as source, dst_path as target from lp where src_path <> dst_path)"
MEANS = f"""{DOCS}, {CHUNKS}, {UNITS}, x as (select doc_id, unnest(v) as x, unnest(range(64)) as i from u join c using (chunk_id) join d using (doc_id) where d.kind = 'note'),
mean as (select doc_id, i, avg(x) as x from x group by 1, 2), nrm as (select doc_id, sqrt(sum(x * x)) as n from mean group by 1),
dv as (select doc_id, list(x / n order by i) as v from mean join nrm using (doc_id) group by 1)"""
NEAREST = f"""{MEANS}, ab as (select a.doc_id, b.doc_id as other, round(list_dot_product(a.v, b.v), 9) as sim from dv a join dv b on a.doc_id <> b.doc_id where round(list_dot_product(a.v, b.v), 9) >= {NEAR}),
near as (select * from ab qualify row_number() over (partition by doc_id order by sim desc, other) <= 3)"""

QUERIES = {
    "link_rows": link_rows, "outgoing_links": outgoing_links, "backlinks": backlinks, "unlinked_notes": unlinked_notes, "node_degree": node_degree, "two_hop": two_hop,
    "doc_vectors": doc_vectors, "similar_docs": similar_docs, "similar_graph_top3": similar_graph_top3, "graph_edges": graph_edges, "link_edges": link_edges,
    "graph_nodes": graph_nodes, "graph_counts": graph_counts,
}
SQL = {
    "link_rows": f"with {PAIRS} select distinct src_path, dst_path, dst_title, dst_ext from lp",
    "outgoing_links": f"with {PAIRS} select src_path, dst_ext, count(*) as links from lp group by 1, 2",
    "backlinks": f"with {LINKS} select distinct d.path, d.title, d.ext from l join d on d.doc_id = l.src_id where l.dst_path = '{HOME}'",
    "unlinked_notes": f"with {LINKS} select path, title, mtime from d where kind = 'note' and not exists (select 1 from l join d s on s.doc_id = l.src_id where l.dst_path = d.path and s.path <> d.path)",
    "node_degree": f"with {EDGES} select path, count(*) as degree from (select source as path from e union all select target from e) group by 1",
    "two_hop": f"""with {EDGES}, b as (select source as a, target as b from e union select target, source from e), z as (select distinct a as path, 0 as hop from b where starts_with(a, 'templates/')),
one as (select distinct b.b as path, 1 as hop from z join b on b.a = z.path), two as (select distinct b.b as path, 2 as hop from one join b on b.a = one.path)
select path, min(hop)::int as hop from (select * from z union all select * from one union all select * from two) group by 1""",
    "doc_vectors": f"with {MEANS} select doc_id, i::int as i, round(x / n, 6) as x from mean join nrm using (doc_id)",
    "similar_docs": f"with {MEANS}, q as (select * from dv order by doc_id limit 1) select dv.doc_id, round(list_dot_product(dv.v, q.v), 6) as sim from dv, q where dv.doc_id <> q.doc_id and list_dot_product(dv.v, q.v) >= 0 order by list_dot_product(dv.v, q.v) desc, dv.doc_id limit 6",
    "similar_graph_top3": f"with {NEAREST} select doc_id, other, round(sim, 6) as sim from near",
    "graph_edges": f"""with {NEAREST}, {PAIRS.removeprefix(DOCS + ", ")}, le as (select distinct src_path as source, dst_path as target from lp where dst_kind = 'note'),
sp as (select least(x.path, y.path) as source, greatest(x.path, y.path) as target, max(sim) as sim from near join d x on x.doc_id = near.doc_id join d y on y.doc_id = near.other group by 1, 2)
select source, target, 'link' as type, null::double as weight from le union all
select source, target, 'similar' as type, round(sim, 3) as weight from sp where not exists (select 1 from le where least(le.source, le.target) = sp.source and greatest(le.source, le.target) = sp.target)""",
    "link_edges": f"with {PAIRS} select distinct src_path as source, dst_path as target, 'link' as type from lp where dst_kind = 'note'",
    "graph_nodes": f"with {DOCS} select path, title, ext, folder from d where kind = 'note'",
    "graph_counts": f"with {PAIRS} select 'link' as type, count(*) as edges from (select distinct src_path, dst_path from lp where dst_kind = 'note') having count(*) > 0",
}
