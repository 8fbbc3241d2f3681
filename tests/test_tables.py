from datetime import datetime, timezone

from lakenote.operators import bloom, graph, incremental, stats
from lakenote.operators.corpus import latest_docs
from lakenote.operators.filters import Filters, without_embedded_images
from lakenote.operators.orphans import orphan_references
from pyspark.sql import functions as F

T = lambda m, d=1: datetime(2024, m, d, tzinfo=timezone.utc)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).alias("_block"))
    n = bloom.blocks_for(5000)
    filt = bloom.build(keys, "k", n)
    probe = spark.range(20000).select(F.when(F.col("id") == 19999, None).otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    got = bloom.probe(probe, "k", filt, n).groupBy((F.substring("k", 2, 9).cast("int") < 5000).alias("there")).agg(F.avg(F.col("maybe").cast("double")).alias("share"))
    share = {r.there: r.share for r in got.collect()}
    assert share[True] == 1.0 and share[False] < 0.05 and share[None] == 0.0
    assert bloom.probe(probe, "k", bloom.build(keys.limit(0), "k", 1), 1).where("maybe").count() == 0


def orphan_tables(spark):
    docs = [(1, "a.md", T(1)), (1, "a.md", T(6)), (2, "b c.md", T(5)), (3, "café.md", T(1)), (4, "null.md", None), (None, None, T(1))]
    links = [(1, "b%20c.md", T(2)), (1, "b%20c.md", T(6)), (1, "./café.md#top", T(2)), (9, "gone.md", T(2)), (9, "gone.md", T(2)), (8, None, T(3)), (None, "no.md", None), (2, "A.md", T(5)), (4, "null.md", T(1)), (None, None, T(1))]
    removed = [(9, "gone.md", T(1)), (None, None, None)]
    return (
        spark.createDataFrame([(*r, "x") for r in links], "src_id bigint, dst_path string, found_at timestamp, reason string"),
        spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, path string, indexed_at timestamp, side string"),
        spark.createDataFrame([(*r, "x") for r in removed], "doc_id bigint, path string, removed_at timestamp, gone string"),
    )


def test_orphans(spark):
    links, docs, removed = orphan_tables(spark)
    got = {tuple(r) for r in orphan_references(links, docs, removed).collect()}
    assert got == {
        ("dst", "2024-02", 1, "b%20c.md", "late"), ("src", "2024-02", 9, "gone.md", "deleted"), ("dst", "2024-02", 9, "gone.md", "deleted"),
        ("src", "2024-03", 8, "", "missing"), ("dst", None, -1, "no.md", "missing"), ("dst", "2024-05", 2, "A.md", "missing"),
    }


def test_orphans_of_empty_tables(spark):
    links, docs, removed = orphan_tables(spark)
    assert orphan_references(links.limit(0), docs, removed).count() == 0
    all_of = orphan_references(links, docs.limit(0), removed.limit(0)).collect()
    assert {r.reason for r in all_of} == {"missing"} and len(all_of) == 14


def test_a_hot_target_is_spread(spark):
    links = spark.range(3000).select(F.col("id").alias("src_id"), F.lit("hot.md").alias("dst_path"), F.lit(T(1)).alias("found_at"))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "hot.md").otherwise(F.concat(F.lit("p"), "id")).alias("path"), F.lit(T(2)).alias("indexed_at"))
    got = orphan_references(links, docs, docs.select("doc_id", "path").limit(0)).groupBy("side", "reason").count().collect()
    assert {tuple(r) for r in got} == {("src", "late", 3000), ("dst", "late", 3000)}


def test_latest_docs_and_filters(spark):
    rows = [(1, "Work/a.md", "t", ".md", "Work", "note", T(1), 5, ["Home/X", None], T(1)), (1, "Work/a.md", "t2", ".md", "Work", "note", T(2), 5, ["home"], T(3)), (1, "Work/a.md", "t0", ".md", "Work", "note", T(1), 5, None, None), (2, "Workshop/b.csv", None, ".csv", "Workshop", "note", None, None, None, T(1)), (None, None, None, None, None, None, None, None, None, None)]
    d = latest_docs(spark.createDataFrame(rows, "doc_id bigint, path string, title string, ext string, folder string, kind string, mtime timestamp, size bigint, tags array<string>, indexed_at timestamp"))
    assert {(r.doc_id, r.title) for r in d.collect()} == {(1, "t2"), (2, None)}
    ids = lambda f: sorted(r.doc_id for r in d.where(f.predicate()).collect())
    assert ids(Filters()) == [1, 2] and ids(Filters(folder="work")) == [] and ids(Filters(folder="Work")) == [1] and ids(Filters(tag="#Home")) == [1]
    assert ids(Filters(types=("spreadsheet", ""))) == [2] and ids(Filters(types=("csv",))) == [2] and ids(Filters(days=1, now="2024-02-01 12:00:00")) == [1] and ids(Filters(path="x")) == []
    assert ids(Filters(folder="%")) == [] and ids(Filters(tag="ho_e")) == []


def test_loose_images(spark):
    d = spark.createDataFrame([(1, "note"), (2, "image"), (3, "image"), (4, "image")], "doc_id bigint, kind string")
    i = spark.createDataFrame([(1, "k2"), (2, "k2"), (3, "k3"), (4, "k3")], "doc_id bigint, key string")
    assert sorted(r.doc_id for r in without_embedded_images(d, i).collect()) == [1, 3, 4]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "source string, target string")
    assert {(r.path, r.hop) for r in graph.within_hops(e, F.col("path") == "a").collect()} == {("a", 0), ("b", 1), ("x", 1), ("c", 2)}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.8, 0.6]), (4, [0.0, 1.0])], "doc_id bigint, vec array<double>")
    full = {(r.doc_id, r.other) for r in graph.neighbours_in_buckets(v, 2, 0.5, planes=0).collect()}
    assert full == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (4, 3)}
    assert {(r.doc_id, r.other) for r in graph.neighbours_in_buckets(v, 2, 0.5, planes=2).collect()} <= full
    docs = spark.createDataFrame([(i, p, p, ".md", "note", T(1)) for i, p in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))], "doc_id bigint, path string, title string, ext string, kind string, mtime timestamp")
    links = spark.createDataFrame([(1, "b"), (1, "b"), (2, "b"), (9, "c"), (None, "c"), (3, "zz")], "src_id bigint, dst_path string")
    near = spark.createDataFrame([(2, 1, 0.9), (3, 1, 0.8), (1, 3, 0.8)], "doc_id bigint, other bigint, sim double")
    assert {tuple(r) for r in graph.graph_edges(links, docs, near).collect()} == {("a", "b", "link", None), ("b", "b", "link", None), ("a", "c", "similar", 0.8)}
    assert [r.path for r in graph.unlinked(links, docs).collect()] == ["a", "c", "d"]


def test_change_capture(spark):
    s = "path string, mtime int, size int, status string"
    new = spark.createDataFrame([("a", 1, 1, ""), ("b", 2, 1, ""), ("c", 1, 2, ""), ("n", 1, 1, ""), ("n", 1, 1, ""), ("z", None, None, ""), (None, 1, 1, "")], s)
    old = spark.createDataFrame([("a", 1, 1, ""), ("b", 1, 1, ""), ("c", 1, 1, ""), ("r", 1, 1, ""), ("z", None, None, "")], s)
    got = {tuple(r) for r in incremental.snapshot_diff(new, old).collect()}
    assert got == {("a", "unchanged"), ("b", "updated"), ("c", "updated"), ("n", "added"), ("r", "removed"), ("z", "unchanged")}
    t = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    c = spark.createDataFrame([("b", 3), ("c", 4)], "key string, v int")
    assert {tuple(r) for r in incremental.upsert(t, c, "key").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in incremental.insert_new(t, c, "key").collect()} == {("a", 1), ("b", 2), ("c", 4)}
    im = spark.createDataFrame([("u", "said  here"), ("w", "")], "key string, ocr string")
    ch = spark.createDataFrame([(1, "text", [("u", "pic"), ("w", "x")]), (2, "t", None)], "chunk_id bigint, text string, images array<struct<url:string,alt:string>>")
    assert {r.chunk_id: r.text for r in incremental.with_image_text(ch, im).collect()} == {1: "text\n\n[image 'pic' text in image: said here]", 2: "t"}
    d = spark.createDataFrame([("a", "e", "1"), ("b", None, "1"), ("c", "e", "2")], "path string, error string, app_version string")
    assert [r.path for r in incremental.retry_failed(d, "2").collect()] == ["a"]


def test_rollups_and_switcher(spark):
    d = spark.createDataFrame([(1, "note", ["#A/b", "a"], "x/y", "x/y/project-plan.md"), (2, "note", ["a/B/c", None, ""], "", "top.md"), (3, "image", ["a"], "x", "x/p.png"), (4, "note", None, "x", "x/plan.md")], "doc_id bigint, kind string, tags array<string>, folder string, path string")
    assert [(r.tag, r.notes) for r in stats.tag_counts(d).collect()] == [("A", 2), ("A/b", 2), ("a/B/c", 1)]
    assert {r.folder: r.files for r in stats.folder_counts(d).collect()} == {"": 4, "x": 3, "x/y": 1}
    score = lambda q: {r.path: r.s for r in d.select("path", stats.switcher_score(F.col("path"), q).alias("s")).collect() if r.s}
    assert score("plan") == {"x/y/project-plan.md": 14, "x/plan.md": 16} and score("prjpln") == {"x/y/project-plan.md": 1} and score("x plan") == {"x/y/project-plan.md": 17, "x/plan.md": 19} and score("") == {}
    ev = spark.createDataFrame([("k", T(1)), ("k", T(2)), ("l", T(1)), (None, T(9))], "key string, ts timestamp")
    assert [r.key for r in stats.most_recent(ev, "key", "ts", 2).collect()] == ["k", "l"]
    b = spark.createDataFrame([(1, i) for i in (0, 1, 2, 9, 10)], "u int, s int").select("u", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.events for r in stats.bursts(b, "ts", 1.5, ["u"]).collect()) == [2, 3]


def test_uploads_and_extract_cache(spark):
    files = spark.createDataFrame([("n/images/a_2.png", bytearray(b"x")), ("n/images/A_7.png", bytearray(b"y"))], "path string, content binary")
    up = spark.createDataFrame([("1", "n/images", "a", ".PNG", bytearray(b"y")), ("2", "n/images", "a", ".PNG", bytearray(b"z")), ("3", "", "b", ".gif", bytearray(b"x"))], "name string, folder string, stem string, ext string, content binary")
    got = {r.name: (r.path, r.fresh) for r in incremental.place_uploads(up, files).collect()}
    assert got == {"1": ("n/images/A_7.png", False), "2": ("n/images/a_8.png", True), "3": ("b_1.gif", True)}
    f = spark.createDataFrame([("a", T(1), 1), ("b", T(1), 1), ("c", None, 1)], "path string, mtime timestamp, size bigint")
    c = f.select("path", incremental.stamp(F.col("mtime"), F.when(F.col("path") == "b", 2).otherwise(F.col("size")), "1").alias("stamp"))
    use, todo = incremental.cached_extracts(f, c.where("path <> 'c'"), "1")
    assert [r.path for r in use.collect()] == ["a"] and sorted(r.path for r in todo.collect()) == ["b", "c"]
