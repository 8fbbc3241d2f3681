import numpy as np

from lakenote.llm import ann


def exact(x, ids, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_share_found_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 60)
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "ASKED", 150)
    r = np.random.default_rng(2)
    base = r.normal(size=(400, 64))
    near = base[:300] + 0.3 * r.normal(size=(300, 64))
    x = np.concatenate([base, near, np.repeat(base[:1], 9, axis=0)]).astype(np.float32)
    ids = [int(i) * 3 + 1 for i in range(len(x))]
    rows = [(i, [float(v) for v in row], "x") for i, row in zip(ids, x)]
    rows += [rows[5], (900001, None, "x"), (900002, [], "x"), (900003, [0.0] * 64, "x"), (900004, [1.0] * 32, "x"), (900005, [None] + [1.0] * 63, "x"), (None, [1.0] * 64, "x")]
    df = spark.createDataFrame(rows, "chunk_id bigint, vec array<float>, list string")
    got = {tuple(p) for p in ann.similar_pairs(df).collect()}
    want = exact(x.astype(np.float64), ids, 5, 0.85)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
    ask = {(q.id, q.other) for q in ann.neighbours(df, 5, 0.85, ask=ann.F.col("id") % 100 == 0).collect()}
    assert ask and {a for a, _ in ask} <= {i for i in ids if i % 100 == 0}


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(2, [1.0] * 64), (1, [2.0] * 64), (3, [-1.0] * 64)], "chunk_id bigint, vec array<float>")
    assert [tuple(r) for r in ann.similar_pairs(df).collect()] == [(1, 2)]
    assert ann.similar_pairs(df.limit(0)).collect() == []


def test_groups_of_copies_are_linked_to_their_first(spark):
    r = np.random.default_rng(3)
    x = [float(v) for v in r.normal(size=64)]
    near = [v + 0.02 for v in x]
    far = [float(v) for v in r.normal(size=64)]
    df = spark.createDataFrame([(i, x) for i in range(40)] + [(100, near), (200, far)], "chunk_id bigint, vec array<float>")
    got = {tuple(p) for p in ann.similar_pairs(df).collect()}
    copies = {(j, i) for i in range(40) for j in [n for n in range(6) if n != i][:5] if j < i} | {(a, b) for a in range(5) for b in range(a + 1, 6)}
    assert got == copies | {(j, 100) for j in range(5)}


def test_a_third_of_all_in_one_noisy_group_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 30)
    monkeypatch.setattr(ann, "BLOCK", 400)
    for noise in (0.3, 0.02):
        r = np.random.default_rng(4)
        one = r.normal(size=64)
        x = np.concatenate([one + noise * r.normal(size=(500, 64)), r.normal(size=(1000, 64))]).astype(np.float32)
        ids = [int(i) for i in r.permutation(len(x))]
        df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "chunk_id bigint, vec array<float>")
        assert {tuple(p) for p in ann.similar_pairs(df).collect()} == exact(x.astype(np.float64), ids, 5, 0.85), noise


def test_share_found_when_most_lists_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(ann, "FINE", 8)
    monkeypatch.setattr(ann, "PER_LIST", 1000)
    r = np.random.default_rng(9)
    base = r.normal(size=(2600, 64))
    x = np.concatenate([base, base[:400] + 0.35 * r.normal(size=(400, 64))]).astype(np.float32)
    block = ann._Block(ann._unit(x))
    near = ann._unit(x).astype(np.float32) @ block.c.T
    looked = sum(((near[:, one] >= ann.reach(0.85, low, 64, ann.SPREAD)).sum() * len(rows)) for one, rows, low, _, _ in block.lists)
    assert looked < 0.1 * len(x) ** 2  # nine in ten comparisons are never made
    ids = [int(i) for i in r.permutation(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "chunk_id bigint, vec array<float>")
    got, want = {tuple(p) for p in ann.similar_pairs(df).collect()}, exact(x.astype(np.float64), ids, 5, 0.85)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
