from hypothesis import given, settings
from hypothesis import strategies as st

from lakenote.llm import split

WORDS = st.lists(st.sampled_from(["alpha", "beta.", "gamma", "d" * 50, "x" * 130, "e!\n", "f\n\n", "  ", "\r\n", "é🙂"]), max_size=80)


@settings(max_examples=150, deadline=None)
@given(WORDS)
def test_pieces_put_together_are_the_text(words):
    text = " ".join(words)
    got = split.pieces(text, 100, 20)
    assert "".join(text[f:e] for _, f, e, _ in got) == text
    assert all(e - s <= 100 and 0 <= f - s <= 20 for s, f, e, _ in got)
    run = max((len(w) for w in text.split()), default=0) > 100
    assert any(x for *_, x in got) == run
    for _, _, e, forced in got[:-1]:
        assert forced or text[e - 1].isspace() or text[e].isspace()


def test_a_change_of_topic_is_cut():
    a = "The boiler heats the water in the pipe. " * 20
    b = "My dog chased a cat over the lawn. " * 20
    text = a + b
    cuts = [e for _, _, e, _ in split.pieces(text, 1000, 100)]
    assert len(a) in cuts


def test_rows(spark):
    long = ("word " * 500).strip()
    df = spark.createDataFrame([(1, None, "a", long, 0), (1, None, "a", long, 0), (2, "h", None, None, 0), (3, "h", "b", "", 0), (4, "h", "b", "x" * 2001, 0), (5, "h", "b", "x" * 2000, 0), (None, "h", "c", long, 0)], "chunk_id bigint, heading string, anchor string, text string, piece int")
    rows = split.split_oversized(df).collect()
    assert {r.chunk_id for r in rows} == {1, 4, None}
    one = sorted((r for r in rows if r.chunk_id == 1), key=lambda r: r.piece)
    assert [r.piece for r in one] == list(range(len(one))) and all(len(r.text) <= 2000 and r.anchor == "a" and r.heading is None for r in one)
    assert {tuple(r) for r in split.oversized(df).collect()} == {(1, 0), (4, 1), (None, 0)}
    assert split.oversized(df.limit(0)).collect() == []


def test_scripts_without_spaces_are_cut_after_sentences_and_overlap():
    text = "".join(f"第{i}句話說的是花園裡的事情。" for i in range(600))
    out = split.pieces(text)
    assert "".join(text[f:e] for _, f, e, _ in out) == text and all(e - s <= 2000 for s, _, e, _ in out)
    assert all(text[e - 1] == "。" for _, _, e, _ in out) and all(0 < f - s <= 200 and text[s - 1] == "。" for s, f, _, _ in out[1:])
    assert any(forced for *_, forced in out)  # the run is longer than a piece, so p3_found still says so
    short = " ".join("花園裡的事情。" * 60 for _ in range(20))
    assert not any(forced for *_, forced in split.pieces(short))


def test_long_runs_overlap_and_long_words_stay_whole():
    out = split.pieces("x" * 7000)
    assert [(s, f, e) for s, f, e, _ in out][:2] == [(0, 0, 2000), (1800, 2000, 3800)] and all(forced for *_, forced in out[:-1])
    text = "a " * 500 + "y" * 1950 + " " + "b " * 800
    assert all("y" * 1950 in text[s:e] or "y" * 50 not in text[s:e] for s, _, e, _ in split.pieces(text))


def test_valleys_of_rising_similarities_take_linear_time():
    text = "\n".join("same words again and again here" for _ in range(30000))
    import time

    t = time.time()
    split.pieces(text)
    assert time.time() - t < 60


def test_wholeness(spark):
    rows = [(1, "h", "a", "A sentence of some words here. " * 200), (2, None, None, "z" * 4500), (3, "h", "b", None), (4, "h", "b", "short")]
    df = spark.createDataFrame(rows, "chunk_id bigint, heading string, anchor string, text string")
    assert sorted(tuple(r) for r in split.wholeness(df).collect()) == [(1, True, True, True), (2, True, True, True)]
