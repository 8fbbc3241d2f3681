import duckdb
import numpy as np

from lakenote.operators import graph
from lakenote.plans import graph as plans


def test_bucketed_neighbours_have_most_of_the_exact_ones(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 32))
    x = np.concatenate([base + 0.6 * r.normal(size=base.shape) for _ in range(4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "doc_id bigint, vec array<double>")
    exact = {(q.doc_id, q.other) for q in graph.neighbours_in_buckets(v, 3, 0.6, planes=0).collect()}
    got = {(q.doc_id, q.other) for q in graph.neighbours_in_buckets(v, 3, 0.6).collect()}
    assert len(exact) > 200 and len(got & exact) >= 0.9 * len(exact)
    assert graph.neighbours_in_buckets(v.limit(0), 3, 0.6).collect() == []


def nearest(x, ids, k, least):
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k] if s[i, j] >= least}


def test_neighbours_are_exact_over_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    base = r.normal(size=(50, 32))
    x = np.concatenate([*(base + 1.0 * r.normal(size=base.shape) for _ in range(4)), np.repeat(base[:1], 12, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [int(i) for i in r.permutation(len(x))]
    v = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in zip(ids, x)], "doc_id bigint, vec array<double>")
    want = nearest(x, ids, 3, 0.45)
    for block, strip in ((4096, 512), (30, 7)):
        monkeypatch.setattr(graph, "BLOCK", block)
        monkeypatch.setattr(graph, "STRIP", strip)
        rows = graph.neighbours(v).collect()
        assert len(rows) == len(want) > 200 and {(q.doc_id, q.other) for q in rows} == want
    assert graph.neighbours(v.limit(1)).collect() == graph.neighbours(v.limit(0)).collect() == []


def test_similar_graph_equals_its_sql(spark, data):
    con = duckdb.connect()
    for t in ("docs", "chunks", "vectors", "links"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name in ("similar_graph_top3", "graph_edges"):
        df = plans.QUERIES[name](spark, data)
        want = con.execute(plans.SQL[name]).fetchdf()[df.columns].astype(object)
        assert sorted(map(str, df.toPandas().astype(object).where(lambda z: z.notna(), None).values.tolist())) == sorted(map(str, want.where(want.notna(), None).values.tolist())), name
