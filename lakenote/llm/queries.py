"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakenote.llm import ann, bpe, leak, neardup, ocr, spans, split
from lakenote.tables import read


def p1_found(spark, d):
    return ann.similar_pairs(read(spark, d, "vectors"))


def p1_neighbours(spark, d):
    """The 5 most similar chunks of every chunk whose id is divisible by 100, of any cosine."""
    v = read(spark, d, "vectors")
    return ann.neighbours(v, ask=F.col("id") % 100 == 0, spread=2.0).select("id", "other", F.round("cos", 6).alias("cos"), "rank")


def _p2_records(spark, d):
    return neardup.chunk_records(read(spark, d, "chunks")).unionByName(neardup.title_records(read(spark, d, "docs")))


def p2_found(spark, d):
    return neardup.near_duplicates(_p2_records(spark, d), 60)


def p2_members(spark, d):
    """The records of p2_found that have copies, with their class of equal texts."""
    return neardup.copy_members(_p2_records(spark, d))


def p2_classes(spark, d):
    """Every document with text by its near-duplicates on sets of five words at a similarity of 0.8: the smallest document of
    an equal set (class), the smallest that it is connected with (component), and its number of near-duplicates (links)."""
    docs = read(spark, d, "documents")
    records = neardup.word_shingles(docs, "text", 5).select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), "toks")
    return neardup.classes(records, docs.where("text <> ''").select(F.col("doc_id").alias("id")), 80).withColumnRenamed("id", "doc_id")


def p3_found(spark, d):
    return split.oversized(read(spark, d, "chunks"))


def p3_pieces(spark, d):
    return split.split_oversized(read(spark, d, "chunks"))


def p3_whole(spark, d):
    """Every split chunk with whether its pieces keep their promises."""
    return split.wholeness(read(spark, d, "chunks"))


def p4_found(spark, d):
    return ocr.repairs(read(spark, d, "chunks"), read(spark, d, "known_words"))


def p4_pages(spark, d):
    return ocr.repaired_pages(read(spark, d, "chunks"), read(spark, d, "known_words"))


def p6_ids(spark, d):
    return bpe.encode_corpus(read(spark, d, "documents"))


def p6_decoded(spark, d):
    """Every document's text as it comes back from its ids, by hash; null texts come back empty."""
    return bpe.decode_corpus(bpe.encode_corpus(read(spark, d, "documents"))).select("doc_id", F.md5("text").alias("digest"))


def p7_found(spark, d):
    return leak.leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_coverage(spark, d):
    return leak.covered(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_found(spark, d):
    return spans.shared_pairs(read(spark, d, "documents"))


def p8_shares(spark, d):
    return spans.shared_shares(read(spark, d, "documents"))


WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
P7_SQL = f"""
with w as (select doc_id, {WORDS.format('text')} as ws from documents where text is not null),
i as (select distinct item_id, {WORDS.format('text')} as ws from eval_items where text is not null),
iw as (select distinct item_id, array_to_string(ws[p:p + 12], ' ') as win from (select item_id, ws, unnest(range(1, len(ws) - 11)) as p from i where len(ws) >= 13)),
dw as (select doc_id, array_to_string(ws[p:p + 12], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from w where len(ws) >= 13))
select distinct doc_id, item_id from dw join iw using (win)
"""

P3_SQL = """
select distinct chunk_id, cast(regexp_matches(text, '[^\\s\\x{0085}\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]{1000}[^\\s\\x{0085}\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]{1000}[^\\s\\x{0085}\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]') as int) as forced
from chunks where length(text) > 2000
"""

# Near-duplicates by joining all runs: for small tables.
SETS = f"""
w as (select distinct chunk_id as id, text, {WORDS.format('text')} as ws from chunks where text is not null and chunk_id is not null),
t as (select distinct doc_id as id, title, array_to_string({WORDS.format('title')}, ' ') as s from docs where title is not null and doc_id is not null),
r as (select 'chunks' as tab, id, text as raw, list_distinct(list_transform(range(1, len(ws) - 1), lambda p: array_to_string(ws[p:p + 2], ' '))) as toks from w where len(ws) >= 20
  union all select 'docs', id, title, list_distinct(list_transform(range(1, length(s) - 1), lambda p: substring(s, p, 3))) from t where length(s) >= 20)"""
P2_SQL = f"""
with {SETS},
n as (select *, row_number() over () as k from r), e as (select tab, k, id, len(toks) as n, unnest(toks) as tok from n),
c as (select a.tab, a.id as x, b.id as y, a.k, b.k as l, a.n + b.n as total, count(*) as met from e a join e b on a.tab = b.tab and a.tok = b.tok and a.id < b.id group by all)
select distinct tab, x as id_a, y as id_b from c where 160 * met >= 60 * total
"""
P2_MEMBERS_SQL = f"with {SETS}, g as (select tab, raw, min(id) as class from r group by 1, 2 having count(distinct id) > 1) select distinct tab, class, id from r join g using (tab, raw)"
P2_CLASSES_SQL = f"""
with recursive w as (select distinct doc_id as id, {WORDS.format('text')} as ws from documents where text <> '' and doc_id is not null),
r as (select id, list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')))) as toks from w where len(ws) >= 5),
e as (select id, len(toks) as n, unnest(toks) as tok from r),
p as (select a.id as a, b.id as b from e a join e b on a.tok = b.tok and a.id <> b.id group by a.id, b.id having 180 * count(*) >= 80 * (max(a.n) + max(b.n))),
reach as (select a, b from p union select reach.a, p.b from reach join p on reach.b = p.a),
k as (select id, min(id) over (partition by toks) as class from r),
l as (select a as id, count(*) as links from p group by 1), m as (select a as id, min(b) as low from reach group by 1)
select w.id as doc_id, coalesce(k.class, w.id) as class, least(w.id, coalesce(m.low, w.id)) as component, coalesce(l.links, 0) as links
from (select distinct id from w) w left join k using (id) left join l using (id) left join m using (id)
"""
GRAMS = "g as (select doc_id, p as start, hash(substring(text, p, 300)) as h from (select distinct doc_id, text, unnest(range(1, length(text) - 298)) as p from documents where doc_id is not null and length(text) >= 300))"
P8_SQL = f"with {GRAMS}, d as (select distinct h, doc_id from g) select distinct a.doc_id as doc_a, b.doc_id as doc_b from d a join d b on a.h = b.h and a.doc_id < b.doc_id"
P8_SHARES_SQL = f"""
with {GRAMS}, o as (select h from g group by h having count(distinct doc_id) > 1), s as (select distinct doc_id, start from g where h in (select h from o)),
c as (select doc_id, sum(least(300, coalesce(nxt - start, 300))) as shared from (select *, lead(start) over (partition by doc_id order by start) as nxt from s) group by 1)
select doc_id, coalesce(length(text), 0) as chars, coalesce(shared, 0)::bigint as shared, case when length(text) > 0 then round(coalesce(shared, 0) / length(text), 4) else 0 end as share
from (select distinct doc_id, text from documents) left join c using (doc_id)
"""

QUERIES = {
    "p1_found": p1_found, "p1_neighbours": p1_neighbours,
    "p2_found": p2_found, "p2_members": p2_members, "p2_classes": p2_classes, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_whole": p3_whole,
    "p4_found": p4_found, "p4_pages": p4_pages, "p6_ids": p6_ids, "p6_decoded": p6_decoded,
    "p7_found": p7_found, "p7_coverage": p7_coverage, "p8_found": p8_found, "p8_shares": p8_shares,
}
P3_WHOLE_SQL = "select distinct chunk_id, true as whole, true as within, true as linked from chunks where length(text) > 2000"
SQL = {"p2_found": P2_SQL, "p2_members": P2_MEMBERS_SQL, "p2_classes": P2_CLASSES_SQL, "p8_found": P8_SQL, "p8_shares": P8_SHARES_SQL, "p3_found": P3_SQL, "p3_whole": P3_WHOLE_SQL, "p6_decoded": "select doc_id, md5(coalesce(text, '')) as digest from documents", "p7_found": P7_SQL}
