from lakenote.llm import queries


def test_every_query_runs_with_its_columns(spark, data):
    want = {
        "p1_found": {"chunk_a", "chunk_b"}, "p2_found": {"tab", "id_a", "id_b"}, "p3_found": {"chunk_id", "forced"}, "p4_found": {"chunk_id", "kind", "fixed"},
        "p6_ids": {"doc_id", "ids"}, "p7_found": {"doc_id", "item_id"}, "p8_found": {"doc_a", "doc_b"},
    }
    for name, f in queries.QUERIES.items():
        df = f(spark, data)
        n = df.count()
        assert n >= 0
        if name in want:
            assert set(df.columns) == want[name] and n > 0, name
