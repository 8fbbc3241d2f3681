from lakenote.functions import text as X
from lakenote.operators import notes as N
from pyspark.sql import functions as F

GARDEN = """---
title: Soil
tags:
  - earth
  - home/garden
---
# Ground
Intro with ![bed](pics/bed.png) and ![[embed.png|300]] and [[tools]].

## Drainage {#wet}
- [ ] dig
> - [x] fill
```
# no heading
- [ ] no task [x](y.md)
```
See [rel](../index.md#top), [web](https://x.y), `[code](z.md)`, [[Missing]] #earth #new/tag #new/tag
"""
FILES = [("garden/soil.md", GARDEN), ("garden/tools.md", "tags [[soil#Drainage|see]]\n[up](../index.md)"), ("index.md", "[self](index.md) [gone](nope.md) ![x](lost.png) [[a/name]]"), ("archive/name.md", "n"), ("name.md", "m [[garden/soil]]"), ("templates/daily.md", "[broken](no.md) {{title}}"), ("empty.md", ""), ("null.md", None)]
OTHER = ["garden/pics/bed.png", "pics/embed.png"]


def frames(spark):
    notes = spark.createDataFrame([(p, c, 0) for p, c in FILES], "path string, content string, key int")
    files = notes.select("path").unionByName(spark.createDataFrame([(p,) for p in OTHER], "path string"))
    return notes, files


def test_front_matter_tags_and_title(spark):
    got = {r.path: (r.title, r.tags) for r in N.read_notes(frames(spark)[0]).collect()}
    assert got["garden/soil.md"] == ("Soil", ["earth", "home/garden", "new/tag", "new/tag"])
    assert got["empty.md"] == ("empty", []) and "null.md" not in got


def test_sections_and_headings(spark):
    df = spark.createDataFrame([(1, "T", GARDEN.split("---\n", 2)[2]), (2, "T", "pre\n# A\n### B\n## C\ntext"), (3, "T", None), (4, "T", "")], "id bigint, title string, body string")
    got = [(r.id, r.heading) for r in N.sections(df).orderBy("id", "ord").collect()]
    assert got == [(1, "Ground"), (1, "Ground > Drainage {#wet}"), (2, "T"), (2, "A"), (2, "A > B"), (2, "A > C")]
    lines = df.where("body is not null").select("id", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    crumbs = [(r.id, r.crumb) for r in N.headings(lines).orderBy("id", "n").collect()]
    assert crumbs == [(1, "Ground"), (1, "Ground > Drainage {#wet}"), (2, "A"), (2, "A > B"), (2, "A > C")]


def test_passages_pack_paragraphs(spark):
    para = lambda c, n: " ".join([c] * n)
    body = "\n\n".join([para("a", 200), para("b", 200), para("c", 60), para("d", 300), para("e", 1000)])
    table = "\n".join(["| h | i |", "|---|---|"] + ["| x y | z |"] * 400)
    df = spark.createDataFrame([(1, "T", body), (2, "T", "# H\n" + table), (3, "T", "## Only {#own}")], "id bigint, title string, body string")
    rows = N.chunk_notes(df).orderBy("id", "ord").collect()
    one = [r.text for r in rows if r.id == 1]
    assert one[0].split().count("a") == 200 and one[1].startswith("c c") and one[1].split().count("d") == 300
    assert all(len(t.split()) <= 450 for t in one)
    two = [r.text for r in rows if r.id == 2]
    assert len(two) > 1 and all(t.startswith("| h | i |\n|---|---|") for t in two)
    assert [(r.heading, r.anchor, r.text) for r in rows if r.id == 3] == [("Only", "own", "")]


def test_links_are_resolved_and_rewritten(spark):
    notes, files = frames(spark)
    got = {r.path: r for r in N.rewrite_links(notes, files).collect()}
    soil = got["garden/soil.md"]
    assert "![bed](/api/file?path=garden/pics/bed.png)" in soil.content and "![embed|300](/api/file?path=pics/embed.png)" in soil.content
    assert "[tools](#doc=garden/tools.md)" in soil.content and "[rel](#doc=index.md)" in soil.content and "no task [x](y.md)" in soil.content
    assert sorted(soil.links) == ["garden/tools.md", "index.md"]
    assert "[see](#doc=garden/soil.md)" in got["garden/tools.md"].content and got["index.md"].links == ["name.md"]


def test_broken_links(spark):
    got = sorted((r.path, r.line, r.target) for r in N.broken_links(*frames(spark)).collect())
    assert got == [("garden/soil.md", 17, "Missing"), ("index.md", 1, "lost.png"), ("index.md", 1, "nope.md")]


def test_moves_keep_links(spark):
    notes, files = frames(spark)
    moved = spark.createDataFrame([("garden/soil.md", "deep/er/earth soil.md")], "src string, dst string")
    got = {r.path: (r.new_path, r.content) for r in N.relink(notes, files, moved).collect()}
    assert set(got) == {"garden/soil.md", "garden/tools.md", "name.md"}
    new, text = got["garden/soil.md"]
    assert new == "deep/er/earth soil.md" and "![bed](../../garden/pics/bed.png)" in text and "[rel](../../index.md#top)" in text
    assert "[[earth soil#Drainage|see]]" in got["garden/tools.md"][1] and "[[garden/earth soil]]" in got["name.md"][1]


def test_tasks_and_saves(spark):
    df = spark.createDataFrame([(1, GARDEN), (2, None), (3, "")], "id bigint, body string")
    assert [(r.task, r.checked) for r in N.tasks(df).orderBy("task").collect()] == [(0, False), (1, True)]
    ch = spark.createDataFrame([(1, 0, True, 2)], "id bigint, task int, checked boolean, expected int")
    assert "- [x] dig" in N.set_tasks(df, ch).collect()[0].body
    assert N.set_tasks(df, ch.withColumn("expected", F.lit(3))).collect() == []
    notes = spark.createDataFrame([("a.md", "old", 5), ("b.md", "same", 6)], "path string, content string, mtime_ns bigint")
    edits = spark.createDataFrame([("a.md", "new", 5, False), ("a.md", "new", 4, False), ("a.md", "new", 4, True), ("b.md", "same", 6, False), ("c.md", "x", None, False), ("c.pdf", "x", None, False), ("d.md", "x", 1, False)], "path string, content string, base_ns bigint, force boolean")
    assert sorted((r.path, r.status) for r in N.saves(notes, edits).collect()) == [("a.md", 200), ("a.md", 200), ("a.md", 409), ("b.md", 204), ("c.md", 200), ("c.pdf", 415), ("d.md", 409)]


def test_scalar_functions(spark):
    f = spark.range(1).select(
        X.slugify(F.lit(" Grüße, Café & Co! ")).alias("slug"), X.plain_markdown(F.lit("![a|300](u) ![](v) <img src='x'> [t](l)")).alias("plain"),
        X.image_refs(F.lit("![a|3x4](/api/i) ![b](rel.png)")).alias("img"), X.url_path(F.lit("a b/é~*.md")).alias("url"), X.safe_name(F.lit("d/My pic (1).PNG")).alias("safe"),
        X.safe_name(F.lit(".png")).alias("dot"), X.line_of(F.lit("a\nb\nc"), F.lit(4)).alias("line"), X.citations(F.lit("x [3] y [2, 4] [a]")).alias("cite"), X.word_count(F.lit("  ")).alias("none"), X.word_count(F.lit(None).cast("string")).alias("null"),
        X.without_image_marks(F.lit("a [image: b] c [image 'x' text in image: d]")).alias("marks"), X.fill_template(F.lit("{{Title}} {{date:YYYY [of] MM}} {{time}}"), F.lit("a$1"), F.timestamp_seconds(F.lit(0)), ("YYYY [of] MM",)).alias("fill"),
    ).collect()[0]
    assert (f.slug, f.plain, f.url, f.safe, f.line, f.cite, f.none) == ("grüße-café-co", "[image: a]   t", "a%20b/%C3%A9~%2A.md", "My-pic-1.png", 3, [3, 2, 4], 0)
    assert [tuple(i) for i in f.img] == [("/api/i", "a")] and f["null"] is None and f.marks == "a c" and f.fill == "a$1 1970 of 01 00:00" and f.dot.startswith("png")


def test_outline_paths_and_answer_notes(spark):
    h = spark.createDataFrame([(1, 0, 1, "A b"), (1, 2, 2, "A b"), (1, 3, 5, "deep"), (2, 0, 1, "alone")], "id bigint, n int, level int, heading string")
    assert [(r.n, r.anchor) for r in N.outline(h).orderBy("n").collect()] == [(0, "a-b"), (2, "a-b-1")]
    p = spark.createDataFrame([("a/b.md",), ("../x",), (".h/x",), ("",), (None,)], "p string").select("p", N.safe_path(F.col("p")).alias("ok"))
    assert [r.ok for r in p.collect()] == [True, False, False, False, False]
    a = N.answer_note(spark.createDataFrame([(2, "two"), (1, "one")], "n int, passage string"), spark.createDataFrame([(1, "a.md", "A"), (2, "b.md", None)], "n int, path string, title string"), "Why?")
    assert a.collect()[0].content == "# Why?\n\none\ntwo\n\n## Sources\n\n- [A](#doc=a.md)\n- [b.md](#doc=b.md)\n"
