from lakenote.llm import leak

W = [f"w{i}" for i in range(60)]


def frames(spark):
    docs = [
        (1, "Intro " + " ".join(W[:13]) + " end", 0), (2, " ".join(W[:12]) + " x " + " ".join(W[13:25]), 0), (3, None, 0), (4, "", 0), (5, "short", 0),
        (6, " ".join(W[30:60] + ["gap"] + W[0:30]), 0), (6, " ".join(W[30:60] + ["gap"] + W[0:30]), 0), (7, "W0, w1-W2_w3. " + " ".join(W[4:20]), 0),
        (8, "lorem ipsum " * 4000 + " ".join(W[20:40]), 0), (None, " ".join(W), 0),
    ]
    items = [(10, " ".join(W), "a"), (11, " ".join(W[:12]), "a"), (12, None, "a"), (13, "", None), (10, " ".join(W), "a"), (14, " ".join(W[5:20] + ["z"]), "b")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, at int"), spark.createDataFrame(items, "item_id bigint, text string, window string")


def test_documents_with_thirteen_words_in_a_row(spark, monkeypatch):
    d, i = frames(spark)
    want = {(1, 10), (6, 10), (6, 14), (7, 10), (7, 14), (8, 10)}
    got = leak.leaks(d, i).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    monkeypatch.setattr(leak, "WIDTH", 2)  # a sketch that is full lets all windows pass to the join
    assert sorted(map(tuple, leak.leaks(d, i).collect())) == sorted(map(tuple, got))


def test_tiles_cover_reordered_passages(spark):
    d, i = frames(spark)
    rows = {(r.doc_id, r.item_id): r for r in leak.covered(d, i, 0.9).collect()}
    assert rows[6, 10].covered == 60 and rows[6, 10].share == 1.0 and rows[6, 10].longest == 30
    assert (1, 10) not in rows


def test_tiling_marks_the_longest_first_and_never_overlaps():
    doc, item = "a b c d e f a b c".split(), "a b c x d e f a b c".split()
    seeds = {(p, q) for p in range(len(doc) - 1) for q in range(len(item) - 1) if doc[p : p + 2] == item[q : q + 2]}
    tiles = leak.tile(doc, item, seeds, 2)
    assert tiles[0] == (3, 4, 6)
    assert (0, 0, 3) in tiles
    assert sum(n for _, _, n in tiles) == 9


def test_empty_tables(spark):
    d, i = frames(spark)
    assert leak.leaks(d.limit(0), i).collect() == []
    assert leak.leaks(d, i.limit(0)).collect() == []


def test_a_window_of_many_documents_and_items_is_split(spark, monkeypatch):
    from lakenote.operators import skew

    monkeypatch.setattr(skew, "SALT_ROWS", 5)
    passage = " ".join(W[:13])
    d = spark.createDataFrame([(k, f"text {k} {passage}") for k in range(40)], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, f"{passage} item {k}") for k in range(12)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.longest) for r in leak.leaks(d, i).collect()) == [(a, b, 13) for a in range(40) for b in range(12)]
