"""Near-duplicate records by set similarity, filtered through several global token orders (problem 2).

Every record becomes a set of hashed tokens. Under any total order of the tokens, two sets of the wanted similarity share
a token among the first few of each (prefix filter). Candidates are joined on the prefix tokens of the first order, where
the smaller set's prefix is the shorter one and enough tokens must follow in both (positional filter), and must also share
prefix tokens under every other order; the prefixes of the other orders travel as small bit sets with each row, so all
filters are intersected inside the join, before the sets themselves are fetched and compared exactly. All orders put rarer
tokens first, by a count-min sketch that is sent to every task, and differ in the order among tokens of like frequency. So
no token is shuffled but those of the prefixes, one slice of the tokens after the other, and sets only of the candidates;
tokens that the sketch knows to be of a single set only count as places in a prefix. No filter loses a pair, whatever the
sketch says; equal sets form one class, and frequent prefix tokens are split into blocks.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakenote.llm import sketch
from lakenote.llm.copies import expand
from lakenote.operators.skew import merge_join, salted_join
from lakenote.tables import checkpoint, words

#: Token orders; the first is joined, the others are intersected. Words of 64 bits in the bit set of all tokens and in
#: those of the other orders' prefixes.
ORDERS, WORDS, PREFIX_WORDS = 3, 2, 1
#: Records with one prefix token that are compared in one block.
BLOCK = 4096
#: Rows of prefix tokens that are shuffled at a time, unless that takes more than SLICES turns: each reads all records again.
SLICE, SLICES = 1 << 21, 8
#: Candidates whose sets are compared at a time, likewise.
COMPARED = 1 << 20
#: Bits of a token's hash; of the others four tell its level, or all number the records while their tokens are sorted.
BITS = 50
#: Cells of the sketch; at four bits each (32 MB) they are sent to every task.
WIDTH = 1 << 26
BIT_SETS = [f"f{j}" for j in range(WORDS)] + [f"b{i}{j}" for i in range(1, ORDERS) for j in range(PREFIX_WORDS)]


def run_sets(off: np.ndarray, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all runs of n consecutive items of each list, ascending: offsets and values like those given."""
    size, m = np.diff(off), len(flat) - n + 1
    w, lists, room = np.zeros(max(0, m), np.uint64), len(off) - 1, 1 << (64 - BITS)
    with np.errstate(over="ignore"):
        for k in range(n if m > 0 else 0):
            w = (w + flat[k : k + m]) * sketch.MIX
            w ^= w >> np.uint64(29)
    owner = np.repeat(np.arange(lists, dtype=np.uint64), size)
    inside = owner[: len(w)] == owner[n - 1 : n - 1 + len(w)]
    w, owner = w[inside] >> np.uint64(64 - BITS), owner[: len(w)][inside]
    ends, out = [np.zeros(1, np.int64)], []
    for s in range(0, lists, room):  # as many lists as the free bits can number
        a, b = np.searchsorted(owner, [s, s + room])
        key = np.sort(((owner[a:b] - np.uint64(s)) << np.uint64(BITS)) | w[a:b])
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        many = np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=min(room, lists - s))
        ends.append(np.cumsum(many) + ends[-1][-1])
        out.append(key & np.uint64((1 << BITS) - 1))
    return np.concatenate(ends), np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64)


def _runs(n: int):
    @F.arrow_udf("array<bigint>")
    def runs(h: pa.Array) -> pa.Array:
        h = h.fill_null([])
        off = h.offsets.to_numpy().astype(np.int64)
        flat = h.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[off[0] : off[-1]]
        ends, toks = run_sets(off - off[0], flat, n)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(toks))

    return runs


def word_shingles(df: DataFrame, text: str, n: int = 3, least: int = 1) -> DataFrame:
    """Add toks: hashes of all runs of n consecutive words; rows of fewer than max(n, least) words or of null are left out."""
    w = df.withColumn("_w", F.transform(words(F.col(text)), lambda x: F.xxhash64(x))).where(F.size("_w") >= max(n, least))
    return w.withColumn("toks", _runs(n)("_w")).drop("_w")


def char_shingles(df: DataFrame, text: str, n: int = 3, least: int = 1) -> DataFrame:
    """Add toks: hashes of all n-character substrings of the words joined by single spaces; rows whose joined words have
    fewer than max(n, least) characters or are null are left out."""
    s = F.col("_s")
    runs = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.xxhash64(F.substring(s, i, 1)))
    w = df.withColumn("_s", F.array_join(words(F.col(text)), " ")).where(F.length(s) >= max(n, least))
    return w.withColumn("toks", _runs(n)(runs)).drop("_s")


def _mixed(t: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (t ^ np.uint64(seed * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _bits(row: np.ndarray, tok: np.ndarray, rows: int) -> np.ndarray:
    """(rows, WORDS) words: the parity of each row's tokens by bit. Sets differ in at least as many tokens as they do in bits."""
    bit = row * (64 * WORDS) + (_mixed(tok, 99) & np.uint64(64 * WORDS - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=rows * 64 * WORDS) & 1).astype(bool).reshape(rows, -1), axis=1).view(np.int64)


def _flat(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of a frame with tabs and sets; tokens of different tabs are different, so the tab need not travel with them."""
    size = f["toks"].map(len).to_numpy()
    row = np.repeat(np.arange(len(f)), size)
    tok = np.concatenate([*f["toks"], np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
    tab = f["tab"].map({t: _mixed(np.frombuffer(str(t).encode().ljust(8)[:8], np.uint64), len(str(t)))[0] for t in f["tab"].unique()})
    return row, (tok ^ tab.to_numpy().astype(np.uint64)[row]) & np.uint64((1 << BITS) - 1)


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames cut so that the free bits can number their rows."""
    for f in frames:
        for s in range(0, len(f), 1 << (64 - BITS)):
            yield f.iloc[s : s + (1 << (64 - BITS))].reset_index(drop=True)


def _ordered(row: np.ndarray, level: np.ndarray, tok: np.ndarray, i: int) -> np.ndarray:
    """A number for each token by which rows come one after the other, in each the rarer tokens first, and of one level those
    of the i-th order's smallest hash."""
    return (row.astype(np.uint64) << np.uint64(BITS)) | (level.astype(np.uint64) << np.uint64(BITS - 4)) | (_mixed(tok, i) >> np.uint64(64 - BITS + 4))


def _hashes(f: pd.DataFrame) -> np.ndarray:
    return _flat(f)[1]


def _class_ids(row: np.ndarray, tok: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each row, by its set of tokens, and how many tokens it has."""
    n = np.bincount(row, minlength=rows)
    total = np.zeros((2, rows), np.uint64)
    first = np.cumsum(n) - n
    full = np.flatnonzero(n)
    with np.errstate(over="ignore"):
        for j in (0, 1):  # a set's hash must not hang on the order of its tokens
            if len(full):
                total[j, full] = np.add.reduceat(_mixed(tok, 11 + j), first[full])
        return _mixed(total[0] * sketch.MIX + total[1] + n.astype(np.uint64), 5).view(np.int64), n


def _lists(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values cut into lists of these sizes."""
    out = np.empty(len(size), object)
    if len(size):
        out[:] = np.split(values, np.cumsum(size)[:-1])
    return out


def _prefixed(sent, width: int, percent: int, prefixes):
    """Records (tab, id, raw, toks) with their class (cls), the number of their tokens (n), of those that stand in no other
    record (own), the prefix of the others with their levels in the first order, and bit sets of all the others and of the
    prefixes under the other orders. Only the first record of a class in a frame has tokens. prefixes, an accumulator, gets
    the number of tokens in prefixes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sent.value
        for f in _slices(frames):
            row, tok = _flat(f)
            rows = len(f)
            cls, n = _class_ids(row, tok, rows)
            level = sketch.levels(tok, counts, width)
            own = np.bincount(row[level == 0], minlength=rows)
            # places left in the prefix once the set's own tokens are counted; without any, no pair can reach the threshold
            k = np.minimum(n - (n * percent + 99) // 100 + 1 - own, n - own)
            take = (k > 0) & ~pd.Series(cls).duplicated().to_numpy()
            k = np.where(take, k, 0)
            prefixes.add(int(k.sum()))
            keep = (level > 0) & take[row]
            row, tok, level = row[keep], tok[keep], level[keep]
            size = np.bincount(row, minlength=rows)
            place = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
            out = f[["tab", "id", "raw"]].copy()
            out["cls"], out["n"], out["own"] = cls, n.astype(np.int32), own.astype(np.int32)
            for j, w in enumerate(_bits(row, tok, rows).T):
                out[f"f{j}"] = w
            for i in range(ORDERS):
                key = _ordered(row, level, tok, i)
                if i == 0:
                    by = np.argsort(key)[place < k[row]]
                    # the level is the same wherever the token stands, so it can be part of it
                    whole = (tok[by] | (level[by].astype(np.uint64) << np.uint64(BITS))).view(np.int64)
                    lists = _lists(whole, k)
                    lists[~take] = None
                    out["toks"] = lists
                else:
                    first = np.sort(key)[place < k[row]]
                    on = np.zeros((rows, 64 * PREFIX_WORDS), bool)
                    on[row[place < k[row]], (first & np.uint64(64 * PREFIX_WORDS - 1)).astype(np.int64)] = True
                    for j, w in enumerate(np.packbits(on, axis=1).view(np.int64).T):
                        out[f"b{i}{j}"] = w
            yield out

    return run


def _asked(sent, width: int):
    """(cls, n, toks) of the records whose class the sketch may know, once for each class of a frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            row, tok = _flat(f)
            cls, n = _class_ids(row, tok, len(f))
            take = (sketch.levels(cls.view(np.uint64), sent.value, width) > 0) & ~pd.Series(cls).duplicated().to_numpy()
            yield pd.DataFrame({"cls": cls[take], "n": n[take].astype(np.int32), "toks": _lists(tok[take[row]].view(np.int64), n[take])})

    return run


def _twice(f: pd.DataFrame) -> np.ndarray:
    """The classes of candidates; twice, as what the sketch meets once it gives as 0."""
    return np.repeat(f[["a", "b"]].to_numpy().ravel(), 2).view(np.uint64)


def _candidates(sets: DataFrame, percent: int, part: int, parts: int) -> DataFrame:
    """(a, b), distinct: the pairs of classes that pass all filters by a prefix token of the given part of the tokens."""
    cols = ["cls", "n", "room", "own", *BIT_SETS]
    every = sets.select("cls", "n", "own", *BIT_SETS, F.posexplode("toks").alias("place", "tok"))
    if parts > 1:
        every = every.where(F.pmod("tok", F.lit(parts)) == part)
    # room: how many tokens a set has left that others can have too, from the prefix token on
    one = every.withColumn("room", F.col("n") - F.col("own") - F.col("place")).select(*cols, "tok")
    # a class that stands in several frames comes several times; its rows meet in the partition of their token
    one = one.repartition("tok").dropDuplicates(["tok", "cls"])
    blocks = F.ceil(F.pow(F.lit(4.0), F.shiftrightunsigned("tok", BITS)) / BLOCK).cast("int")
    one = one.withColumn("blocks", blocks)
    small = one.where((100 + percent) * F.col("room") >= 2 * percent * F.col("n"))  # can be the smaller set of a pair
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    total = a("n") + b("n")
    differ = sum((F.bit_count(a(f"f{j}").bitwiseXOR(b(f"f{j}"))) for j in range(WORDS)), a("own") + b("own"))
    ok = ((a("n") < b("n")) | ((a("n") == b("n")) & (a("cls") < b("cls")))) & (100 * a("n") >= percent * b("n"))
    # the first token that a pair shares leaves room for all the others
    ok = ok & ((100 + percent) * F.least(a("room"), b("room")) >= percent * total) & ((100 + percent) * differ <= (100 - percent) * total)
    for i in range(1, ORDERS):
        meets = F.lit(0).cast("bigint")
        for j in range(PREFIX_WORDS):
            meets = meets.bitwiseOR(a(f"b{i}{j}").bitwiseAND(b(f"b{i}{j}")))
        ok = ok & (meets != 0)
    mine, all_ = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"), F.explode(F.expr("sequence(0, blocks - 1)"))
    left = small.where("blocks > 1").select(*cols, "tok", mine.alias("row"), all_.alias("col"))
    right = one.where("blocks > 1").select(*cols, "tok", all_.alias("row"), mine.alias("col"))
    meet = lambda x, y, keys: merge_join(x.alias("a"), y.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]).where(ok).select(F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b"))
    return meet(small.where("blocks = 1"), one.where("blocks = 1"), ["tok"]).unionByName(meet(left, right, ["tok", "row", "col"])).distinct()


def _free(df: DataFrame) -> None:
    """Have the driver let go of the shuffles that nothing refers to any more: their files stay on disk until it does."""
    for _ in range(2):  # what has just run may still be in the queue of finished events
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def similar_sets(records: DataFrame, base: DataFrame, percent: int, prefixes: int) -> DataFrame:
    """(a, b), a < b: all pairs of the classes of `base`, which is _prefixed of the records, with a Jaccard similarity of at
    least percent / 100.

    prefixes: about how many rows the prefix tokens make; they are shuffled in turns, and the files of a turn are given up
    before the next."""
    sets = base.where("toks is not null")
    parts = min(SLICES, 1 + prefixes // SLICE)
    candidates = None
    for i in range(parts):
        new = checkpoint(_candidates(sets, percent, i, parts))
        candidates = new if candidates is None else candidates.unionByName(new)
        _free(base)
    candidates = checkpoint(candidates.distinct()) if parts > 1 else candidates
    # sets are made once more instead of being stored, and only the candidates' are shuffled
    sent = base.sparkSession.sparkContext.broadcast(sketch.counted(candidates, _twice, WIDTH))
    whole = checkpoint(records.mapInPandas(_asked(sent, WIDTH), "cls bigint, n int, toks array<bigint>").dropDuplicates(["cls"]))
    sent.destroy()
    _free(base)
    side = lambda s: whole.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("toks").alias(f"toks_{s}"))
    parts, both, pairs = min(SLICES, 1 + candidates.count() // COMPARED), F.size(F.array_intersect("toks_a", "toks_b")), None
    for i in range(parts):
        some = candidates.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == i) if parts > 1 else candidates
        fetched = merge_join(merge_join(some, side("a"), "a"), side("b"), "b")
        new = checkpoint(fetched.where((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"))
        pairs = new if pairs is None else pairs.unionByName(new)
        del fetched
        _free(base)
    return pairs


def _classes(records: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (tab, cls, id, raw), cls standing for one set of one tab; pairs (tab, a, b) of similar classes."""
    raw = F.col("raw") if "raw" in records.columns else F.lit(0).cast("bigint")
    r = records.where("id is not null").select("tab", F.col("id").cast("bigint").alias("id"), raw.alias("raw"), "toks")
    # the sets are made anew for the sketch, the prefixes and the comparison: that costs less than storing every token
    sent = r.sparkSession.sparkContext.broadcast(sketch.counted(r.select("tab", "toks"), _hashes, WIDTH))
    bits = ", ".join(f"{c} bigint" for c in BIT_SETS)
    prefixes = r.sparkSession.sparkContext.accumulator(0)
    base = checkpoint(r.mapInPandas(_prefixed(sent, WIDTH, percent, prefixes), f"tab string, id bigint, raw bigint, cls bigint, n int, own int, {bits}, toks array<bigint>"))
    sent.destroy()
    _free(base)
    members = base.select("tab", "cls", "id", "raw").distinct()
    similar = similar_sets(r.select("tab", "toks"), base, percent, prefixes.value)
    pairs = merge_join(similar, members.select("tab", F.col("cls").alias("a")).distinct(), "a").select("tab", "a", "b")
    return members, pairs


def near_duplicates(records: DataFrame, percent: int = 80) -> DataFrame:
    """(tab, id_a, id_b), id_a < id_b, of the records (tab, id, toks, raw) that are near-duplicates within their tab.

    Records with a null id take no part, and the builders leave out null and short texts; repeated rows count once; a record with two sets pairs by
    either. Records of one raw text (raw: its hash; without the column, of one set) are copies, and those of more than
    copies.EXPAND copies are given by their smallest member (see copies); different texts of one set are linked like any others.
    """
    members, pairs = _classes(records, percent)
    members = checkpoint(members.withColumn("text", F.xxhash64("cls", "raw")))
    texts = members.select("tab", "cls", "text").distinct()
    side = lambda s: texts.select("tab", F.col("cls").alias(s), F.col("text").alias(f"t{s}"))
    across = merge_join(merge_join(pairs, side("a"), ["tab", "a"]), side("b"), ["tab", "b"]).select("tab", F.col("ta").alias("a"), F.col("tb").alias("b"))
    several = texts.groupBy("tab", "cls").agg(F.count("*").alias("n")).where("n > 1").select("tab", F.col("cls").alias("a"))
    mine = merge_join(side("a"), several, ["tab", "a"])
    equal = merge_join(mine, side("b").withColumnRenamed("b", "a"), ["tab", "a"]).where("ta < tb").select("tab", F.col("ta").alias("a"), F.col("tb").alias("b"))
    return expand(across.unionByName(equal), members.select("tab", F.col("text").alias("cls"), "id").distinct(), ["tab"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) is connected with.

    In each round a node takes the least label of its neighbours, then the label of that label, until nothing changes."""
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpoint(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")))
    while True:
        near = merge_join(both, label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        least = merge_join(label, near, "a").select("a", F.col("c").alias("was"), F.least("c", "m").alias("m"))
        jump = label.select(F.col("a").alias("m"), F.col("c").alias("next"))
        new = checkpoint(merge_join(least, jump, "m").select("a", "was", F.least("m", "next").alias("c")))
        label = new.select("a", "c")
        if new.where("c <> was").isEmpty():
            return label.select(F.col("a").alias("node"), F.col("c").alias("component"))


def classes(records: DataFrame, ids: DataFrame, percent: int = 80) -> DataFrame:
    """(id, class, component, links) for every id of `ids`: the smallest id with an equal set, the smallest id that it is
    connected with through near-duplicates, and the number of other records that are near-duplicates of it, copies included.

    Records and links are as in near_duplicates, but nothing is multiplied out: links are counted from the sizes of the linked
    classes. An id without a set is its own class and component."""
    members, pairs = _classes(records.withColumn("tab", F.lit("")), percent)
    members = checkpoint(members.select("id", "cls").distinct())
    pairs = checkpoint(pairs.select("a", "b"))
    sizes = members.groupBy("cls").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    # ids of one set are counted together under their class, an id of several sets under a key of its own
    own = members.groupBy("id").agg(F.min("cls").alias("g"), F.count("*").alias("sets"))
    own = own.select("id", F.when(F.col("sets") == 1, F.col("g")).otherwise(F.xxhash64("id", F.lit(7))).alias("g"), "sets")
    filed = checkpoint(merge_join(members, own, "id"))
    each = sizes.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    linked = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(each)
    reach = checkpoint(merge_join(filed.select("g", F.col("cls").alias("a")).distinct(), linked, "a").select("g", F.col("b").alias("cls")).distinct())
    several = filed.where("sets > 1")
    again = merge_join(reach, several.select("id", "cls"), "cls").groupBy("g", "id").agg((F.count("*") - 1).alias("again")).groupBy("g").agg(F.sum("again").alias("again"))
    links = merge_join(merge_join(reach, sizes, "cls").groupBy("g").agg(F.sum("size").alias("links")), again, "g", "left").select("g", (F.col("links") - F.coalesce("again", F.lit(0)) - 1).alias("links"))
    joined = merge_join(several, several.groupBy("id").agg(F.min("cls").alias("a")), "id").where("a <> cls").select("a", F.col("cls").alias("b"))
    part = merge_join(sizes, components(pairs.unionByName(joined)).withColumnRenamed("node", "cls"), "cls", "left").withColumn("part", F.coalesce("component", "cls"))
    # a class, or a component, may hold a third of all records
    part = salted_join(part, part.groupBy("part").agg(F.min("first").alias("component_first"), F.count("*").alias("n")), ["part"]).select("cls", "first", "component_first", "size")
    found = salted_join(filed, part, ["cls"], "size").groupBy("id", "g").agg(F.min("first").alias("class"), F.min("component_first").alias("component"))
    found = salted_join(found, merge_join(links, filed.groupBy("g").agg(F.count("*").alias("n")), "g"), ["g"])
    out = merge_join(ids.where("id is not null").select(F.col("id").cast("bigint").alias("id")).distinct(), found, "id", "left")
    return out.select("id", F.coalesce("class", "id").alias("class"), F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def copy_members(records: DataFrame) -> DataFrame:
    """(tab, class, id) of the records (tab, id, toks, raw) whose text stands in several, class being the smallest id: with the pairs of near_duplicates,
    all that classes of more than copies.EXPAND leave out, as each member has the links of the smallest."""
    m = records.where("id is not null").select("tab", "raw", F.col("id").cast("bigint").alias("id")).distinct()
    groups = m.groupBy("tab", "raw").agg(F.count("*").alias("n"), F.min("id").alias("class")).where("n > 1")
    return salted_join(m, groups, ["tab", "raw"]).select("tab", "class", "id")


def chunk_records(chunks: DataFrame, n: int = 3, least: int = 20) -> DataFrame:
    return word_shingles(chunks, "text", n, least).select(F.lit("chunks").alias("tab"), F.col("chunk_id").alias("id"), "toks", F.xxhash64("text").alias("raw"))


def title_records(docs: DataFrame, n: int = 3, least: int = 20) -> DataFrame:
    return char_shingles(docs.select("doc_id", "title").distinct(), "title", n, least).select(F.lit("docs").alias("tab"), F.col("doc_id").alias("id"), "toks", F.xxhash64("title").alias("raw"))
