"""Tables of the corpus for the queries, and the same as SQL."""

from lakenote.operators.corpus import latest_docs, passages, unit_vectors
from lakenote.tables import read


def docs(spark, d):
    return latest_docs(read(spark, d, "docs"))


def chunks(spark, d):
    return passages(read(spark, d, "chunks"))


def units(spark, d):
    return unit_vectors(read(spark, d, "vectors"))


DOCS = """d as (select * from docs where doc_id is not null qualify row_number() over
  (partition by doc_id order by indexed_at desc nulls last, path desc nulls last, title desc nulls last, mtime desc nulls last) = 1)"""
CHUNKS = "c as (select * from chunks where chunk_id is not null qualify row_number() over (partition by chunk_id) = 1)"
UNITS = """u0 as (select chunk_id, list_transform(vec, lambda x: x::double) as v from vectors where len(vec) = 64 and len(list_filter(vec, lambda x: x is null)) = 0
  qualify row_number() over (partition by chunk_id) = 1),
u as (select chunk_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from u0 where list_dot_product(v, v) > 0)"""
TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
EXCERPT = """case when trim(regexp_replace({0}, '[\\s]+', ' ', 'g')) is null then null else
  array_to_string(string_split(trim(regexp_replace({0}, '[\\s]+', ' ', 'g')), ' ')[1:{1}], ' ') || case when len(string_split(trim(regexp_replace({0}, '[\\s]+', ' ', 'g')), ' ')) > {1} then ' …' else '' end end"""
