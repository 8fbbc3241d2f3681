import itertools
import random
import re

from lakenote.llm import copies, neardup


def brute(rows, n, percent, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= max(n, least):
            sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)))
    out = set()
    for (a, xs), (b, ys) in itertools.combinations(sorted(sets.items()), 2):
        if any((100 + percent) * len(x & y) >= percent * (len(x) + len(y)) for x in xs for y in ys):
            out.add((a, b))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(60):
        base = [r.choice(vocab) for _ in range(r.randint(22, 60))]
        rows.append((i * 10, " ".join(base)))
        for k in range(r.randint(0, 3)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i * 10 + k + 1, " ".join(w)))
    return rows + [(1000 + k, "the same text " * 9) for k in range(5)] + [(2000, None), (2001, ""), (2002, "too short"), (0, rows[0][1]), (3000, "long " + "very long text " * 3000)]


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "chunk_id bigint, text string, tab string, toks int")
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicates(neardup.chunk_records(df), 60).collect()}
    want = brute(rows, 3, 60, 20)
    assert got == want and len(want) > 20


def test_hot_tokens_are_split_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "chunk_id bigint, text string")
    assert {(r.id_a, r.id_b) for r in neardup.near_duplicates(neardup.chunk_records(df), 60).collect()} == brute(rows, 3, 60, 20)


def test_large_classes_are_given_by_their_smallest_member(spark, monkeypatch):
    monkeypatch.setattr(copies, "EXPAND", 3)
    same = "one text that stands in many records and has quite a few words so that it takes part in the comparison here"
    rows = [(i, same) for i in range(6)] + [(50, same + " indeed")]
    df = spark.createDataFrame(rows, "chunk_id bigint, text string")
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicates(neardup.chunk_records(df), 60).collect()}
    assert got == {(0, i) for i in range(1, 6)} | {(0, 50)}


def test_titles_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Minutes of the garden meeting"), (2, "minutes of the garden-meeting!"), (3, "Minutes of the garden meetings"), (4, None), (5, "Notes"), (1, "Minutes of the garden meeting")], "doc_id bigint, title string")
    got = {(r.tab, r.id_a, r.id_b) for r in neardup.near_duplicates(neardup.title_records(df), 60).collect()}
    assert got == {("docs", 1, 2), ("docs", 1, 3), ("docs", 2, 3)}
    assert neardup.near_duplicates(neardup.title_records(df.limit(0)), 60).collect() == []


def test_different_texts_of_one_set_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(copies, "EXPAND", 3)
    same = "one text that stands in many records and has quite a few words so that it takes part in the comparison here"
    rows = [(i, same) for i in range(5)] + [(10, same.upper()), (11, same.replace(" ", "\n")), (12, same + "!"), (50, same + " indeed"), (60, "Another stock passage " * 8)]
    df = spark.createDataFrame(rows, "chunk_id bigint, text string")
    records = neardup.chunk_records(df)
    shown = {(r.id_a, r.id_b) for r in neardup.near_duplicates(records, 60).collect()}
    others = [0, 10, 11, 12, 50]
    assert shown == {(0, i) for i in range(1, 5)} | set(itertools.combinations(others, 2))
    members = neardup.copy_members(records).collect()
    assert sorted(r.id for r in members) == [0, 1, 2, 3, 4] and len({r["class"] for r in members}) == 1
    derived = shown | set(itertools.combinations(range(5), 2)) | {(i, j) for i in range(1, 5) for a, j in shown if a == 0 and j > 4}
    assert derived == brute(rows, 3, 60, 20)


def test_classes_components_and_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(copies, "EXPAND", 3)
    rows = [(i, t) for i, t in corpus(8) if i < 3000]
    rows += [(1, rows[0][1]), (20, rows[-1][1] if rows[-1][1] else "x"), (30, rows[0][1])]  # ids with several sets
    words = [f"w{i}" for i in range(60)]
    rows += [(4000 + i, " ".join(words[i * 4 : i * 4 + 40])) for i in range(5)]  # a chain
    df = spark.createDataFrame(rows, "id bigint, text string")
    records = neardup.word_shingles(df, "text", 3, 20).select(neardup.F.lit("x").alias("tab"), "id", "toks")
    got = {r.id: (r["class"], r.component, r.links) for r in neardup.classes(records, df.where("text <> ''"), 60).collect()}
    pairs = brute(rows, 3, 60, 20)
    ids = {i for i, t in rows if t}
    part, links = {i: i for i in ids}, dict.fromkeys(ids, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in ids:
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    assert {i: v[1:] for i, v in got.items()} == {i: (part[i], links[i]) for i in ids}
    assert [got[i][0] for i in range(1000, 1005)] == [1000] * 5 and got[2002] == (2002, 2002, 0)
    assert {got[4000 + i][1] for i in range(5)} == {4000} and (4000, 4004) not in pairs


def test_tokens_are_shuffled_in_turns_and_only_prefixes_are_stored(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLICE", 1)
    monkeypatch.setattr(neardup, "COMPARED", 1)
    monkeypatch.setattr(neardup, "SLICES", 3)
    stored = []
    monkeypatch.setattr(neardup, "checkpoint", lambda df, keep=neardup.checkpoint: stored.append(keep(df)) or stored[-1])
    rows = corpus(7)
    df = spark.createDataFrame(rows, "chunk_id bigint, text string")
    assert {(r.id_a, r.id_b) for r in neardup.near_duplicates(neardup.chunk_records(df), 60).collect()} == brute(rows, 3, 60, 20)
    base = [f for f in stored if {"toks", "id"} <= set(f.columns)]
    assert len(base) == 1 and base[0].where("size(toks) > n - ceil(0.6 * n) + 1").isEmpty() and not base[0].where("size(toks) > 0").isEmpty()
    # three turns of candidates, together, and three of pairs
    assert sum(f.columns == ["a", "b"] for f in stored) == 7
