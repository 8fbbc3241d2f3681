"""Long exact spans shared between records (problem 8).

Of every run of LENGTH characters the window with the smallest hash is kept (winnowing), so two texts with LENGTH
characters in common always keep one window of that run in common. Each partition counts its windows in a count-min sketch;
the sketches are merged cell by cell, and since they only overestimate, dropping the windows estimated to stand once loses
none. A second pass over the texts takes the other windows with the characters around them, and these are grouped exactly.
A pair is verified on the characters around the window, so whole texts are never shuffled; the share of a text needs no
pairs at all, only how many records each run of LENGTH characters around a repeated window stands in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakenote.llm import sketch
from lakenote.llm.copies import expand
from lakenote.operators.skew import merge_join, salted_join
from lakenote.tables import checkpoint

LENGTH, GRAM = 300, 64
BASE, OTHER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
#: Cells of the sketch; at four bits each (32 MB) they are sent to every task.
WIDTH = 1 << 26
#: Records with one window that are compared in one block.
BLOCK = 2048
#: Characters that one numpy pass takes.
PASS = 1 << 20


def rolling(h: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of every window of `length` characters, modulo 2**64, by doubling windows."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    out, done, m, cur, power = None, 0, 1, h, base
    with np.errstate(over="ignore"):
        while m <= length:
            if length & m:
                n = len(h) - (done + m) + 1
                out = cur[:n] if out is None else out[:n] * power + cur[done : done + n]
                done += m
            if 2 * m > length:
                break
            cur = cur[: len(cur) - m] * power + cur[m:]
            m, power = 2 * m, power * power
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def placed(texts: list[str], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, window, place) of the windows that winnowing keeps of each text; of those of a text that stand between the same
    characters the first."""
    size = np.array([len(t) for t in texts], np.int64)
    chars = points("".join(texts))
    h = rolling(chars, gram)
    span = length - gram + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * MIX
        h ^= h >> np.uint64(29)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | (low - (np.arange(len(h), dtype=np.uint64) & low))  # on ties the last place
    blocks = np.concatenate([key, np.full(-len(key) % span, ~np.uint64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
    owner = np.repeat(np.arange(len(texts)), size)
    inside = owner[:n] == owner[length - 1 : length - 1 + n]
    start = np.arange(n)[inside]
    back_by = (low - (least[inside] & low)).astype(np.int64)  # the place modulo 2**24
    pos = start + ((back_by - start) & int(low))
    pos = np.unique(pos)
    who, first = owner[pos], np.cumsum(size) - size
    place, side = pos - first[owner[pos]], length - gram
    # what stands around a window: a hash where that is all inside the text, else the place itself
    around = rolling(chars, gram + 2 * side)
    whole = (place >= side) & (place + gram + side <= size[who])
    mark = place.astype(np.uint64)
    mark[whole] = around[pos[whole] - side]
    by = np.lexsort((place, mark, h[pos], who))
    new = np.ones(len(by), bool)
    for x in (who, h[pos], mark):
        new[1:] &= x[by][1:] == x[by][:-1]
    new[1:] = ~new[1:]
    pos, who, place = pos[by][new], who[by][new], place[by][new]
    return who, h[pos], place


def kept(texts: list[str], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(owner, window): the distinct windows that winnowing keeps of each text."""
    owner, w, _ = placed(texts, length, gram)
    both = np.unique(np.stack([owner.astype(np.uint64), w]), axis=1)
    return both[0].astype(np.int64), both[1]


def _passes(texts: list[str], length: int) -> Iterator[list[int]]:
    at, chars = [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        at.append(i)
        chars += len(t)
        if chars >= PASS:
            yield at
            at, chars = [], 0
    if at:
        yield at


def _texts(f: pd.DataFrame) -> list[str | None]:
    """The texts of a frame, equal ones once: their windows are those of one record."""
    return f["text"].where(~f["text"].duplicated(), None).tolist()


def _hashes(length: int, gram: int):
    def run(f: pd.DataFrame) -> np.ndarray:
        texts = _texts(f)
        out = [kept([texts[i] for i in at], length, gram)[1] for at in _passes(texts, length)]
        return np.concatenate([*out, np.zeros(0, np.uint64)])

    return run


def _occurrences(sent, width: int, length: int, gram: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, side = sent.value, length - gram
        for f in frames:
            ids, texts = f["doc_id"].to_numpy(), _texts(f)
            for at in _passes(texts, length):
                owner, w, place = placed([texts[i] for i in at], length, gram)
                ok = sketch.levels(w, counts, width) > 0
                if not ok.any():
                    continue
                who, place = np.array(at)[owner[ok]], place[ok]
                lead = np.minimum(place, side)
                around = [texts[i][p - n : p + gram + side] for i, p, n in zip(who, place, lead)]
                yield pd.DataFrame({"doc_id": ids[who], "window": w[ok].view(np.int64), "place": place.astype(np.int32), "lead": lead.astype(np.int32), "around": around})

    return run


def repeated_windows(documents: DataFrame, copies: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, window, place, lead, around, n): every kept window that stands in more than one record, n of them, with its
    place and up to length - gram characters on either side, `lead` of them before it. One record for each group of copies."""
    spark = documents.sparkSession
    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= length)).select("doc_id", "text")
    sent = spark.sparkContext.broadcast(sketch.counted(texts, _hashes(length, gram), WIDTH))
    seen = checkpoint(texts.mapInPandas(_occurrences(sent, WIDTH, length, gram), "doc_id bigint, window bigint, place int, lead int, around string"))
    sent.destroy()
    first = copies.select(F.col("id").alias("doc_id"), "cls").distinct()
    seen = merge_join(seen, first, "doc_id", "left").select(F.coalesce("cls", "doc_id").alias("doc_id"), "window", "place", "lead", "around").dropDuplicates(["doc_id", "window", "place"])
    groups = seen.groupBy("window").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return checkpoint(salted_join(seen, groups.select("window", "n", F.col("n").alias("rows")), ["window"], "rows"))


def common_run(a: list[str], b: list[str], lead_a: np.ndarray, lead_b: np.ndarray, side: int, gram: int) -> np.ndarray:
    """The length of the run around the window that each pair of surroundings has in common."""
    wide = 2 * side + gram

    def grid(texts: list[str], lead: np.ndarray, pad: str) -> np.ndarray:
        return points("".join((pad * (side - n) + t).ljust(wide, pad) for t, n in zip(texts, lead))).reshape(-1, wide)

    same = grid(a, lead_a, "\ue000") == grid(b, lead_b, "\ue001")
    gap = lambda x: np.where(x.all(1), x.shape[1], np.argmin(x, axis=1))
    return np.where(same[:, side : side + gram].all(1), gap(same[:, :side][:, ::-1]) + gram + gap(same[:, side + gram :]), 0)


def _verified(length: int, gram: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), 2048):
                g = f.iloc[s : s + 2048]
                ok = common_run(g["around_a"].tolist(), g["around_b"].tolist(), g["lead_a"].to_numpy(), g["lead_b"].to_numpy(), length - gram, gram) >= length
                yield g.loc[ok, ["a", "b"]].drop_duplicates()

    return run


def exact_copies(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(cls, id): every document whose text of at least `length` characters stands in other documents too; cls is the smallest id."""
    keyed = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= length)).select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    groups = keyed.groupBy("h").agg(F.min("id").alias("cls"), F.max("id").alias("last"), F.count("*").alias("n")).where("cls < last").drop("last")
    return salted_join(keyed, groups, ["h"]).select("cls", "id").distinct()


def shared_pairs(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents with at least `length` consecutive characters in common, as stored.

    Null, empty and shorter texts give nothing; repeated rows count once; extra columns are ignored. Equal texts are one
    class: up to copies.EXPAND members give all their pairs, more give their smallest with each other member. Windows of
    many records are compared in blocks of BLOCK.
    """
    copies = checkpoint(exact_copies(documents, length))
    seen = repeated_windows(documents, copies, length).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    mine, every = F.pmod(F.xxhash64("doc_id", "place"), F.col("blocks")).cast("int"), F.explode(F.expr("sequence(0, blocks - 1)"))
    side = lambda s: [F.col("doc_id").alias(s), F.col("lead").alias(f"lead_{s}"), F.col("around").alias(f"around_{s}"), "window"]
    left = seen.select(*side("a"), mine.alias("row"), every.alias("col"))
    right = seen.select(*side("b"), every.alias("row"), mine.alias("col"))
    met = merge_join(left, right, ["window", "row", "col"]).where("a < b").select("a", "b", "lead_a", "lead_b", "around_a", "around_b")
    pairs = met.mapInPandas(_verified(length, GRAM), "a bigint, b bigint").distinct()
    return expand(pairs, copies).select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


def _grams(length: int, gram: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["around"].tolist()
            size = np.array([len(t) for t in texts], np.int64)
            chars = points("".join(texts))
            one, two = rolling(chars, length), rolling(chars, length, OTHER)
            owner = np.repeat(np.arange(len(texts)), size)
            at = np.flatnonzero(owner[: len(one)] == owner[length - 1 : length - 1 + len(one)]) if len(one) else np.zeros(0, np.int64)
            who = owner[at]
            start = f["place"].to_numpy()[who] - f["lead"].to_numpy()[who] + at - (np.cumsum(size) - size)[who]
            yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy()[who], "start": start.astype(np.int32), "g": one[at].view(np.int64), "h": two[at].view(np.int64)})

    return run


def shared_shares(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, chars, shared, share) of every document with text: the characters that stand elsewhere in runs of at least
    `length`. Null and empty texts give a share of 0; a text that another document has in full gives 1 if long enough.
    Runs are told apart by two hashes of 64 bits; no pairs are made, so the work grows with the repeated windows only."""
    copies = checkpoint(exact_copies(documents, length))
    grams = repeated_windows(documents, copies, length).select("doc_id", "place", "lead", "around").mapInPandas(_grams(length, GRAM), "doc_id bigint, start int, g bigint, h bigint").distinct()
    often = grams.groupBy("g", "h").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("low", "high")
    covered = salted_join(grams, often, ["g", "h"]).select("doc_id", "start").distinct()
    after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start"))
    part = covered.select("doc_id", F.least(F.lit(length), F.coalesce(after - F.col("start"), F.lit(length))).alias("fresh")).groupBy("doc_id").agg(F.sum("fresh").alias("part"))
    whole = copies.select(F.col("id").alias("doc_id")).distinct().withColumn("whole", F.lit(True))
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    shared = F.when(F.col("whole"), F.col("chars")).otherwise(F.coalesce("part", F.lit(0)))
    told = merge_join(merge_join(documents.select("doc_id", chars.alias("chars")).distinct(), part, "doc_id", "left"), whole, "doc_id", "left")
    return told.select("doc_id", "chars", shared.alias("shared"), F.when(F.col("chars") > 0, F.round(shared / F.col("chars"), 4)).otherwise(0.0).alias("share"))
