import numpy as np

from lakenote.llm import sketch


def reader():
    return lambda f: f["h"].to_numpy().view(np.uint64)  # made here, so that tasks need not import the test


def test_levels_bound_the_counts_and_single_hashes_are_told(spark, monkeypatch):
    r = np.random.default_rng(1)
    h = r.integers(-(1 << 62), 1 << 62, 3000)
    times = np.concatenate([np.ones(2500, int), r.integers(2, 40, 499), [5000]])
    rows = np.repeat(h, times)
    df = spark.createDataFrame([(int(x),) for x in r.permutation(rows)], "h bigint").repartition(5)
    width = 1 << 21
    got = sketch.levels(h.view(np.uint64), sketch.counted(df, reader(), width), width)
    assert (times < 4.0 ** got).sum() + (got == 0).sum() >= len(h) and (times[got == 0] == 1).all()
    assert (times[got > 0] < 4.0 ** got[got > 0]).all() and (got[:2500] == 0).mean() > 0.98


def test_a_full_sketch_and_an_empty_table_tell_nothing_untrue(spark):
    df = spark.createDataFrame([(i,) for i in range(4000)], "h bigint")
    width = 1 << 4
    full = sketch.counted(df, reader(), width)
    assert (sketch.levels(np.arange(4000, dtype=np.uint64), full, width) > 0).all()
    assert not sketch.counted(df.limit(0), reader(), 1 << 20).any()
