import io
import os
import zipfile

from pyspark.sql import functions as F

from lakenote import index
from lakenote.engine import Engine
from lakenote.operators.filters import Filters
from lakenote.operators.hybrid import HashEmbedder, LexicalReranker
from lakenote.sources import layout, readers
from lakenote.sources.files import listing
from lakenote.streaming.watch import build_on_change, watch

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def office(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return b.getvalue()


DOCX = office({
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Steps</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>one</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>",
})
PPTX = office({
    "ppt/slides/slide1.xml": f'<p:sld {A}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Plan</a:t></a:r></a:p></p:sp><p:sp><a:p><a:pPr lvl="1"/><a:r><a:t>deep</a:t></a:r></a:p></p:sp></p:sld>',
    "ppt/slides/_rels/slide1.xml.rels": '<Relationships xmlns="x"><Relationship Type="y/notesSlide" Target="../notesSlides/n1.xml"/></Relationships>',
    "ppt/notesSlides/n1.xml": f'<p:notes {A}><p:sp><p:nvPr><p:ph type="body"/></p:nvPr><a:p><a:r><a:t>say it</a:t></a:r></a:p></p:sp></p:notes>',
})
XLSX = office({
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Stock" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
    "xl/worksheets/s.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>',
})


def test_readers(spark):
    big = "h;i\n" + "\n".join(f"{n};x" for n in range(700))
    rows = [("a.docx", DOCX), ("b.pptx", PPTX), ("c.xlsx", XLSX), ("d.csv", big.encode()), ("e.html", b"<head><title>T</title></head><script>no</script><h2>Head</h2><p>Text <a href='x'>l</a><ul><li>i</ul><img src='p.png' alt='q'>"), ("f.docx", b"broken"), ("g.pdf", b"x"), ("h.png", b"x"), ("i.md", None), ("j.md", b"\xff# T\n"), ("k.xyz", b"")]
    got = {r.path: r for r in readers.read_files(spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert got["a.docx"].markdown == "## Steps\n\n- one\n\n| a\\|b |  |\n| --- | --- |"
    assert got["b.pptx"].markdown == "## Slide 1: Plan\n\n  - deep\n\n**Speaker notes:** say it"
    assert got["c.xlsx"].markdown == "## Sheet: Stock\n\n| name |  | 5 |\n| --- | --- | --- |"
    assert got["d.csv"].markdown.count("\n") == 501 and got["e.html"].title == "T" and got["e.html"].markdown == "## Head\n\nText l\n\n- i\n\n![q](p.png)"
    assert {p for p, r in got.items() if r.error} == {"f.docx", "g.pdf", "i.md", "k.xyz"} and got["h.png"].title == "h.png"


def corpus(root):
    for p, t in {"a/one.md": "# One\nThe garden router needs care. [[two]]", "two.md": "# Two\nKitchen and garden #home/x", "b/note.txt": "plain garden text", ".hidden/x.md": "secret garden", "~$lock.docx": "x", "bad.docx": "not a zip", "pic é.png": "x"}.items():
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w", encoding="utf-8") as f:
            f.write(t)


def state(spark, out):
    drop = lambda t: index.table(spark, out, t).drop("indexed_at", "mtime")
    return {t: sorted(map(str, drop(t).collect())) for t in index.TABLES}


def test_incremental_build_equals_full_build(spark, tmp_path):
    root, out, again = (str(tmp_path / x) for x in ("notes", "index", "full"))
    os.makedirs(root)
    corpus(root)
    assert {r.path for r in listing(spark, root).collect()} == {"a/one.md", "two.md", "b/note.txt", "bad.docx", "pic é.png"}
    stats = lambda df: {r.status: r.files for r in df.collect()}
    assert stats(index.build(spark, root, out, HashEmbedder())) == {"added": 5, "updated": 0, "unchanged": 0, "removed": 0}
    assert stats(index.build(spark, root, out, HashEmbedder()))["unchanged"] == 5 and index.last_snapshot(spark, out) == 1
    os.remove(f"{root}/b/note.txt")
    with open(f"{root}/two.md", "a") as f:
        f.write("\n## More\nnew text about a lamp")
    assert stats(index.build(spark, root, out, HashEmbedder())) == {"added": 0, "updated": 1, "unchanged": 3, "removed": 1}
    index.build(spark, root, again, HashEmbedder())
    assert state(spark, out) == state(spark, again)
    e = Engine.from_index(spark, out, embedder=HashEmbedder(), reranker=LexicalReranker())
    hits = e.search("garden router", limit=5).orderBy("n").collect()
    assert hits[0].path == "a/one.md" and "\x02garden\x03" in hits[0].snippet and hits[0].match == "both"
    assert [r.path for r in e.search("garden", Filters(tag="home"), mode="keyword").collect()] == ["two.md"]
    assert e.search("", mode="keyword").collect() == [] and "One" in e.ask("garden router").orderBy("n").collect()[0].passage
    assert [r.path for r in e.outgoing("a/one.md").collect()] == ["two.md"] and [r.path for r in e.backlinks("two.md").collect()] == ["a/one.md"]
    assert {r.tag: r.notes for r in e.tags().collect()} == {"home": 1, "home/x": 1} and e.status().collect()[0].errors == 1
    assert "two.md" not in [r.path for r in e.orphans().collect()]
    nodes, edges = e.graph()
    assert nodes.count() == 3 and edges.where("type = 'link'").count() == 1 and e.similar("nope.md").collect() == []


def test_underscores_models_and_failures(spark, tmp_path, monkeypatch):
    class Broken(HashEmbedder):
        name = "broken"

        def embed_passages(self, texts):
            raise RuntimeError("no model")

        def embed_query(self, text):
            raise RuntimeError("no model")

    class BrokenReranker(LexicalReranker):
        def score(self, query, passages):
            raise RuntimeError("no model")

    root, out = str(tmp_path / "notes"), str(tmp_path / "index")
    for p in ("_index.md", "_drafts/x.md", "a/_b.md", "a/c.md", "a/node_modules/d.md", ".git/e.md", "bad.docx"):
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(f"# Note\ngarden {p}")
    assert {r.path for r in listing(spark, root).collect()} == {"_index.md", "_drafts/x.md", "a/_b.md", "a/c.md", "bad.docx"}
    assert listing(spark, str(tmp_path / "nowhere")).collect() == []
    index.build(spark, root, out, HashEmbedder())
    first = index.table(spark, out, "vectors")
    assert {r.model for r in first.collect()} == {"hash-64"} and first.count() == 4
    monkeypatch.setattr(index, "APP_VERSION", "3")
    with open(f"{root}/a/c.md", "a") as f:
        f.write(" more")
    stats = {r.status: r.files for r in index.build(spark, root, out, Broken()).collect()}
    assert stats == {"added": 1, "updated": 1, "unchanged": 3, "removed": 0}  # the file that failed is tried again
    assert index.table(spark, out, "vectors").count() == 0 and index.table(spark, out, "docs").count() == 5
    e = Engine.from_index(spark, out, embedder=Broken(), reranker=BrokenReranker())
    assert {r.match for r in e.search("garden", limit=5).collect()} == {"keyword"}


def test_folder_changes_stream(spark, tmp_path):
    root, seen = str(tmp_path / "w"), []
    os.makedirs(root)

    def run():
        q = build_on_change(watch(spark, root, str(tmp_path / "s"), F.col("path").like("%.md")), lambda df, n: seen.append(sorted((r.path, r.status) for r in df.collect())), str(tmp_path / "c"), once=True)
        q.awaitTermination(60)
        got, seen[:] = [x for x in seen if x], []
        return got

    for p in ("a.md", "b.md", "c.txt"):
        open(f"{root}/{p}", "w").close()
    assert run() == [[("a.md", "added"), ("b.md", "added")]]
    assert run() == []
    os.remove(f"{root}/a.md")
    with open(f"{root}/b.md", "w") as f:
        f.write("x")
    assert run() == [[("a.md", "removed"), ("b.md", "updated")]]


def block(page, n, text, size=11.0, margin=False, kind="text"):
    return (1, page, n, float(n), text, kind, size, margin)


BLOCK = "doc_id bigint, page int, n int, y double, text string, kind string, size double, margin boolean"


def test_layout(spark):
    rows = [b for p in (1, 2, 3) for b in (block(p, 0, f"Page {p} of 3", margin=True), block(p, 1, "Big title", 16.0), block(p, 2, "Body text. " * 20), block(p, 3, "# odd"))]
    b = spark.createDataFrame(rows, BLOCK)
    clean = layout.without_running_lines(b)
    assert clean.count() == 9
    h = layout.font_headings(clean)
    assert {(r.text, r.level) for r in h.where("level is not null").collect()} == {("Big title", 1)}
    md = layout.to_markdown(h).collect()[0].markdown
    assert md.startswith("## Big title {#page-1}\n\nBody text.") and "\\# odd" in md and "of 3" not in md
    o = spark.createDataFrame([(1, 1, 0, 1, "big  TITLE"), (1, 2, 1, 5, "Nowhere"), (1, 3, 2, 1, "Body")], "doc_id bigint, page int, ord int, level int, title string")
    m = layout.outline_headings(clean, o).where("level is not null").collect()
    assert {(r.page, r.text, r.level) for r in m} == {(1, "Big title", 1), (2, "Nowhere", 3), (3, "Body", 1)}
    spans = spark.createDataFrame([(1, 0.0, 5.0, 10.0, "ab"), (1, 5.1, 9.0, 10.0, "cd"), (1, 12.0, 14.0, 10.0, "ef")], "id int, x0 double, x1 double, size double, text string")
    assert layout.join_spans(spans, ["id"]).collect()[0].text == "abcd ef"
    ocr = spark.createDataFrame([(1, 1, "b", 0.9), (1, 0, "a", 0.6), (1, 2, "c", 0.1)], "id int, n int, text string, confidence double")
    assert layout.ocr_text(ocr, ["id"]).collect()[0].text == "a\nb"
    assert layout.to_markdown(layout.font_headings(b.limit(0))).collect() == []
