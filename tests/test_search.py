"""Keyword search against SQLite's FTS5, which implements the same published ranking, tokens and snippets."""

import random
import sqlite3

import pytest

from lakenote.functions.porter import stem
from lakenote.functions.text import stem_tokens
from lakenote.operators import hybrid as H
from lakenote.operators import keyword as K

WORDS = "garden gardens gardening router routers config configured configuration kitchen über café naïve running run relational 802.1Q foo_bar don't connect connected connection".split()


def rows():
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", ".", ":", ","]) for _ in range(n))
    return [(i, i // 3, text(2), text(3), text(r.randint(0, 70)), text(1)) for i in range(120)]


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(title, heading, text, tags, tokenize='porter unicode61 remove_diacritics 2')")
    for i, _, *cols in rows():
        c.execute("insert into t(rowid, title, heading, text, tags) values (?, ?, ?, ?, ?)", (i, *cols))
    return c


@pytest.mark.parametrize("q", ["garden router", "configuration", '"garden router" kitchen', "connect cafe uber", "foo_bar", "naive", "run"])
def test_scores_equal_full_text_engine(spark, fts, q):
    terms = K.parse(q)
    want = {r[0]: r[1] for r in fts.execute("select rowid, bm25(t, 4.0, 3.0, 1.0, 2.0) from t where t match ?", (K.match_text(terms),))}
    df = spark.createDataFrame(rows(), "chunk_id bigint, doc_id bigint, title string, heading string, text string, tags string")
    cut = K.split_terms(terms, True)
    got = {r.chunk_id: r.score for r in K.bm25(K.postings(df, True), K.doc_lengths(df, True), cut).collect()}
    assert got.keys() == want.keys() and len(got) > 0
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("q", ["garden router", '"garden router" kitchen', "configuration cafe"])
def test_snippets_equal_full_text_engine(spark, fts, q):
    terms = K.parse(q)
    want = dict(fts.execute("select rowid, snippet(t, 2, char(2), char(3), '…', 32) from t where t match ?", (K.match_text(terms),)))
    df = spark.createDataFrame([(r[0], r[4]) for r in rows()], "chunk_id bigint, text string")
    got = {r.chunk_id: r.snippet for r in K.snippets(df, K.split_terms(terms, True), True).collect()}
    same = sum(got[k] == want[k] for k in want)
    assert same == len(want), [(got[k], want[k]) for k in want if got[k] != want[k]][:2]


def test_stems_and_tokens_equal_full_text_engine():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    c.execute("create virtual table v using fts5vocab(t, 'instance')")
    words = (WORDS + "caresses ponies ties cats agreed feed plastered motoring sing conflated troubling sized hopping falling hissing filing happy sky relational conditional valenci digitizer conformabli radicalli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators is as be Ångström İstanbul Straße søren".split())
    for i, w in enumerate(words):
        c.execute("insert into t(rowid, x) values (?, ?)", (i + 1, w))
    want = {}
    for term, doc, _, pos in c.execute("select term, doc, col, offset from v order by doc, offset"):
        want.setdefault(doc - 1, []).append(term)
    assert [(w, stem_tokens(w)) for w in words] == [(w, want.get(i, [])) for i, w in enumerate(words)]
    assert stem("generalizations") == "gener"


def test_questions():
    assert K.match_text(K.parse('the "trunk port" config')) == '"trunk port" OR "config"*'
    assert K.match_text(K.parse("what is it")) == '"what" OR "is" OR "it"'
    assert K.parse("") == [] and K.parse('""') == []
    assert K.match_text(K.parse("a 7 x garden Garden")) == '"7" OR "garden"*'


def test_no_terms_and_empty_index(spark):
    df = spark.createDataFrame(rows()[:0], "chunk_id bigint, doc_id bigint, title string, heading string, text string, tags string")
    assert K.bm25(K.postings(df), K.doc_lengths(df), [K.Term(("x",))]).collect() == []
    assert K.bm25(K.postings(df), K.doc_lengths(df), []).collect() == []


def test_fusion_ties_and_caps(spark):
    kw = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "chunk_id bigint, rank int")
    sem = spark.createDataFrame([(9, 0), (2, 1)], "chunk_id bigint, rank int")
    got = {r.chunk_id: (r.fused, r.match) for r in H.fuse(kw, sem).collect()}
    assert got == {2: (0, "both"), 1: (1, "keyword"), 9: (2, "semantic"), 3: (3, "keyword")}
    ranked = spark.createDataFrame([(i, "a" if i < 4 else "b", i) for i in range(8)], "chunk_id bigint, path string, final int")
    assert [(r.n, r.chunk_id) for r in H.cap_per_document(ranked, 2, 3).orderBy("n").collect()] == [(1, 0), (2, 1), (3, 4)]


def test_rerank_keeps_the_rest_in_order(spark):
    n = 50
    kw = spark.createDataFrame([(i, i) for i in range(n)], "chunk_id bigint, rank int")
    texts = spark.createDataFrame([(i, "", "", "match" if i == 19 else "x") for i in range(n)], "chunk_id bigint, title string, heading string, text string")
    got = [r.chunk_id for r in H.rerank(H.fuse(kw, kw.limit(0)), kw, kw.limit(0), texts, "match", H.LexicalReranker()).orderBy("final").collect()]
    assert got[0] == 19 and got[1:20] == list(range(19)) and got[20:] == list(range(20, n))


def test_answer_passages(spark):
    hits = spark.createDataFrame([(1, "T", "H", "one [image: pic] two\nthree", "", [("u", "")]), (2, None, None, "", "\x02hit\x03 it", None)], "n int, title string, heading string, text string, snippet string, images array<struct<url:string,alt:string>>")
    got = {r.n: r.passage for r in H.answer(hits).collect()}
    assert got[1].splitlines()[:3] == ["### [1] T — H", "", "> one two three"] and "![H](u)" in got[1]
    assert "> **hit** it" in got[2]
    assert [k for k, _ in H.answer_events(hits.selectExpr("*", "'p' path", "'' anchor", "'.md' ext"))] == ["sources", "delta", "delta", "done"]
