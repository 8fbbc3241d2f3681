import itertools
import random

import numpy as np

from lakenote.llm import copies, spans


def corpus():
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdefgh ijklmn\nöß🙂") for _ in range(n))
    p, q = text(300), text(299)
    rows = [(1, text(200) + p + text(50)), (2, text(77) + p), (3, text(500) + q), (4, q + text(400)), (5, None), (6, ""), (7, "short"), (8, "a" * 1000), (9, "b" + "a" * 400)]
    whole = text(900)
    rows += [(20, whole), (21, whole), (22, whole), (23, text(10) + whole[100:600]), (24, text(5000) + p[10:] + text(10)), (1, rows[0][1])]
    return rows


def brute(rows, n):
    seen = {i: {t[k : k + n] for k in range(len(t) - n + 1)} for i, t in dict(rows).items() if t}
    return {(a, b) for a, b in itertools.combinations(sorted(seen), 2) if seen[a] & seen[b]}


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, a int, window string")
    got = {tuple(r) for r in spans.shared_pairs(df).collect()}
    assert got == brute(rows, 300) == {(1, 2), (8, 9), (20, 21), (20, 22), (21, 22), (20, 23), (21, 23), (22, 23)}


def test_shares(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    got = {r.doc_id: (r.chars, r.shared, r.share) for r in spans.shared_shares(df).collect()}
    assert got[1] == (550, 300, 0.5455) and got[3][1] == 0 and got[20] == (900, 900, 1.0) and got[23][1] == 500
    assert got[5] == (0, 0, 0.0) and got[6] == (0, 0, 0.0) and got[8] == (1000, 1000, 1.0) and got[9][1] == 400


def test_large_classes_keep_links_through_their_smallest_member(spark, monkeypatch):
    monkeypatch.setattr(copies, "EXPAND", 2)
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == {(1, 2), (8, 9), (20, 21), (20, 22), (20, 23)}


def test_winnowing_keeps_a_common_window_of_every_common_run():
    r = random.Random(7)
    for _ in range(50):
        common = "".join(r.choice("ab c") for _ in range(60))
        a, b = ("".join(r.choice("abc de") for _ in range(r.randint(0, 90))) + common for _ in range(2))
        owner, w = spans.kept([a, b], 60, 16)
        assert np.intersect1d(w[owner == 0], w[owner == 1]).size


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_pairs(df).collect() == [] and spans.shared_shares(df).collect() == []


def test_a_footer_in_thousands_of_texts_makes_no_pairs_for_the_shares(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh ijklmn\nöß") for _ in range(n))
    footer = text(340)
    df = spark.createDataFrame([(i, text(40 + i % 7) + footer) for i in range(5000)] + [(9000, text(500))], "doc_id bigint, text string")
    got = {row.doc_id: row.shared for row in spans.shared_shares(df).collect()}
    assert got.pop(9000) == 0 and len(got) == 5000 and all(n >= 340 for n in got.values())


def test_windows_of_many_records_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 8)
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefgh ijklmn\nöß") for _ in range(n))
    footer = text(340)
    rows = [(i, text(30) + footer[i % 60 :]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(p) for p in spans.shared_pairs(df).collect()} == brute(rows, 300)


def test_a_text_of_one_character_has_few_places(spark):
    owner, w, place = spans.placed(["x" * 200000, "y" + "x" * 700])
    assert len(owner) < 2000 and len(set(w.tolist())) < 80
