from lakenote.llm import ocr

KNOWN = "the garden meeting module kitchen winter described under between read-only long-term and we meet in with a of furnace behind".split()
PAGES = [
    "Annual Report Fulbar\nThe gar-\nden rneeting in the kitcheri 7\nbehind the w1nter furnacc\n\n- 4 -", "Annua1 Report Fulbar\nwe meet betvveen the read-\nonly modu|e and winter\n- 5 -",
    "Annual Rcport Fulbar\r\nclescribed with a fur-\r\nnace of the winter\r\n- 6 -", "Annual Report Fulbar\npre- and\n1999\nthe Kitcben iinder a garden\n- 7 -",
]


def frames(spark):
    rows = [(1, 10 + n, f"page-{n + 1}", t) for n, t in enumerate(PAGES)] + [(1, 10, "page-1", PAGES[0]), (1, 20, "page-9", None), (1, 21, "page-8", ""), (2, 30, "page-1", "A clean page " * 30), (3, 40, "intro", "gar-\nden"), (2, None, "page-2", "x")]
    words = spark.createDataFrame([(w, "en") for w in KNOWN] + [(None, None)], "word string, lang string")
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, chunk_id bigint, anchor string, text string, key string"), words


def test_furniture_and_joins(spark):
    chunks, words = frames(spark)
    got = {tuple(r) for r in ocr.repairs(chunks, words).collect()}
    assert {x for x in got if x[1] == "header"} == {(10, "header", "Annual Report Fulbar"), (11, "header", "Annua1 Report Fulbar"), (12, "header", "Annual Rcport Fulbar"), (13, "header", "Annual Report Fulbar")}
    assert {x for x in got if x[1] == "page_no"} == {(10 + n, "page_no", f"- {n + 4} -") for n in range(4)}
    assert {x for x in got if x[1] == "hyphen"} == {(10, "hyphen", "garden"), (11, "hyphen", "read-only"), (12, "hyphen", "furnace")}
    assert (11, "glyph", "between") in got and {x[0] for x in got} <= {10, 11, 12, 13}


def test_text_becomes_paragraphs(spark):
    chunks, words = frames(spark)
    got = {r.chunk_id: r.text for r in ocr.repaired_pages(chunks, words).collect()}
    assert set(got) == {10, 11, 12, 13} and got[10].startswith("The garden ") and "\n" not in got[11] and "Fulbar" not in got[12]


def test_editor_learns_the_misreadings_of_a_corpus():
    known = {w for w in KNOWN} | {f"{a}{b}" for a in ("mor", "len", "der", "cam", "hun", "win") for b in ("ning", "der", "men", "ching", "uring", "dow")}
    noisy = [(w.replace(a, b, 1), w) for w in sorted(known) for a, b in (("m", "rn"), ("d", "cl"), ("e", "c"), ("w", "vv")) if a in w]
    noisy = [(n, w) for n, w in noisy if n not in known]
    edits, tri = ocr.single_edits(known), ocr.trigrams(known)
    rows = [(ocr.char_features(n, i, tri), x) for n, _ in noisy[::2] if (lab := ocr.labelled(n, edits, known)) for i, x in enumerate(lab)]
    rows += [(ocr.char_features(w, i, tri), ocr.KEEP) for w in sorted(known) for i in range(len(w))]
    ed = ocr.Editor(known, ocr.Perceptron().train(rows), ocr.Perceptron().train([([""], "space")]))
    held = noisy[1::2]
    assert sum(ed.fix(n) == w for n, w in held) >= 0.9 * len(held)
    assert ed.fix("rusquin") is None


def test_page_numbers():
    assert [ocr.page_number(x) for x in ("Page 12 of 20", "- 3 -", "[5]", "xii", "p. 4", "Seite 5 von 9", "l2", "Title | 4", "the end.", "7 items")] == [12, 3, 5, 12, 4, 5, 12, None, None, None]
    assert ocr.line_key("Fragi1e errand | 12") == ocr.line_key("Fragile crrand | 13") != ""


def test_empty_tables(spark):
    chunks, words = frames(spark)
    assert ocr.repairs(chunks.limit(0), words).collect() == []
    assert {r.kind for r in ocr.repairs(chunks, words.limit(0)).collect()} == {"header", "page_no"}


def test_one_wide_line_does_not_drop_a_document_and_null_ids_are_one(spark):
    rows = [(None, 10 + n, f"page-{n + 1}", t + ("\nhttps://example.org/" + "x" * 200 if n == 1 else "")) for n, t in enumerate(PAGES)]
    chunks = spark.createDataFrame(rows, "doc_id bigint, chunk_id bigint, anchor string, text string")
    words = spark.createDataFrame([(w,) for w in KNOWN], "word string")
    got = {tuple(r) for r in ocr.repairs(chunks, words).collect()}
    assert {x[0] for x in got if x[1] == "hyphen"} == {10, 11, 12} and (10, "header", "Annual Report Fulbar") in got


def test_edits_found_by_the_join_are_those_of_all_known_words(spark):
    sample = ["rneeting", "gardcn", "clescribed", "xyz", "wimter"]
    words = spark.createDataFrame([(w,) for w in KNOWN], "word string").distinct()
    met = ocr.near_known(spark.createDataFrame([(w,) for w in sample], "word string"), words)
    whole = ocr.single_edits(set(KNOWN))
    assert all(ocr.labelled(w, met, set(KNOWN)) == ocr.labelled(w, whole, set(KNOWN)) for w in sample)
    assert len(met) < len(whole) and ocr.labelled("gardcn", met, set(KNOWN)) == ["=", "=", "=", "=", "e", "="]


def test_breaks_are_labelled_by_what_stands_unbroken():
    times = {"garden": 3, "read-only": 2, "readonly": 1, "old": 5, "tree": 4}
    assert [ocr.joined_label(*x, times) for x in (("gar", "den"), ("read", "only"), ("old", "tree"), ("qu", "zz"))] == ["join", "keep", "space", None]
