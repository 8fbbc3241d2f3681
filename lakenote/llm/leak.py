"""Evaluation texts leaking into training text (problem 7).

The items' windows of `span` words are the seeds. Every task runs a rolling hash (Karp-Rabin) over the words of its
documents and keeps the windows that a sketch of the seeds may hold; only these few positions are joined with the items,
windows of many documents split over several tasks. The sketch has one size, however many items there are. Greedy string
tiling then marks, for each document and item, the longest matches that do not overlap, checked word by word, and the
share of the item's words that they cover catches passages that were cut or reordered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakenote.llm import sketch
from lakenote.operators.skew import hot_keys, merge_join, split_join
from lakenote.tables import checkpoint, words

#: Words of a seed for finding a passage, and of one for the coverage of a reordered passage.
SPAN, SHORT = 13, 5
#: Cells of the sketch of the items' windows; at four bits each (32 MB) they are sent to every task.
WIDTH = 1 << 26
BASE = np.uint64(0x9E3779B97F4A7C15)


def windows(h: np.ndarray, span: int) -> np.ndarray:
    """Rolling hash of every window of `span` word hashes, modulo 2**64."""
    if len(h) < span:
        return np.zeros(0, np.uint64)
    out, power = np.zeros(len(h) - span + 1, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(span - 1, -1, -1):
            out += h[k : len(h) - span + 1 + k] * power
            power = power * BASE
    return out


def _rolled(span: int, sent):
    """Rows (id, hashes) to rows (id, at, window); with a sketch sent only the windows that it holds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = f["h"].map(len).to_numpy()
            flat = np.concatenate([*f["h"], np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
            w = windows(flat, span)
            owner = np.repeat(np.arange(len(f)), size)
            first = np.repeat(np.cumsum(size) - size, size)
            keep = owner[: len(w)] == owner[span - 1 :] if len(w) else np.zeros(0, bool)
            if sent is not None:
                keep &= sketch.levels(w, sent.value, WIDTH) > 0
            p = np.flatnonzero(keep)
            yield pd.DataFrame({"id": f["id"].to_numpy()[owner[p]], "at": (p - first[p]).astype(np.int32), "window": w[p].view(np.int64)})

    return run


def rolling(texts: DataFrame, span: int, sent=None) -> DataFrame:
    """(id, at, window) of the texts (id, text); null, empty and shorter texts have no window."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("window", T.LongType())])
    hashed = texts.where("id is not null and text is not null").select("id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.where(F.size("h") >= span).mapInPandas(_rolled(span, sent), schema)


def _twice(f: pd.DataFrame) -> np.ndarray:
    """The windows of a frame, each counted twice, so that the sketch tells those it met from those it did not."""
    return np.repeat(f["window"].to_numpy().view(np.uint64), 2)


def seeded(documents: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """(doc_id, at, item_id, item_at): every window that a document and an item share by its hash."""
    i = checkpoint(rolling(items.select(F.col("item_id").alias("id"), "text").distinct(), span).select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "window"))
    sent = documents.sparkSession.sparkContext.broadcast(sketch.counted(i.select("window"), _twice, WIDTH))
    d = checkpoint(rolling(documents.select(F.col("doc_id").alias("id"), "text"), span, sent).select(F.col("id").alias("doc_id"), "at", "window"))
    sent.destroy()
    hot = hot_keys(d.groupBy("window").agg(F.count("*").alias("n")), ["window"])
    return split_join(d, i, ["window"], hot).select("doc_id", "at", "item_id", "item_at")


def tile(doc: list[str], item: list[str], seeds: set[tuple[int, int]], span: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (at, item_at, words) of the longest matches first, none overlapping another.

    Each diagonal's seeds are joined to runs, checked word by word; the longest free part of any run is marked until no
    free part has `span` words. On ties the earlier place in the document, then in the item, is taken.
    """
    lines: dict[int, list[int]] = defaultdict(list)
    for p, q in seeds:
        lines[p - q].append(p)
    runs = []
    for gap, ps in lines.items():
        end = -1
        for p in sorted(ps):
            if p < end:
                continue
            end = p
            while end < len(doc) and end - gap < len(item) and doc[end] == item[end - gap]:
                end += 1
            if end - p >= span:
                runs.append((p, p - gap, end - p))
    d_used, i_used = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out, heap = [], [(-n, p, q) for p, q, n in runs]
    heapify(heap)
    while heap:
        n, p, q = heappop(heap)
        taken = np.flatnonzero(d_used[p : p - n] | i_used[q : q - n])
        if not len(taken):
            d_used[p : p - n] = i_used[q : q - n] = True
            out.append((p, q, -n))
            continue
        cuts = [-1, *taken.tolist(), -n]
        for a, b in zip(cuts, cuts[1:]):
            if b - a - 1 >= span:
                heappush(heap, (a + 1 - b, p + a + 1, q + a + 1))
    return out


def _tiled(span: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                found = tile(list(r.doc_words), list(r.item_words), {(s["at"], s["item_at"]) for s in r.seeds}, span)
                if found:
                    rows.append((r.doc_id, r.item_id, max(n for _, _, n in found), sum(n for _, _, n in found), len(r.item_words), len(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest", "covered", "item_words", "tiles"])

    return run


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, longest, covered, item_words, tiles) of every document that holds `span` words of an item in a row.

    longest is the longest common run in words, covered the words of the item that the tiles cover. Null, empty and
    shorter texts give nothing; repeated rows count once; extra columns are ignored; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "item_id", "longest", "covered", "item_words", "tiles")])
    pairs = seeded(documents, items, span).groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("at", "item_at")).alias("seeds"))
    pairs = checkpoint(pairs)
    hit = merge_join(documents.select("doc_id", "text"), pairs.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    texts = hit.select("doc_id", words(F.col("text")).alias("doc_words"))
    own = items.select("item_id", words(F.col("text")).alias("item_words")).distinct()
    many = hot_keys(pairs.groupBy("item_id").agg(F.count("*").alias("n")), ["item_id"])
    return split_join(merge_join(pairs, texts, "doc_id"), own, ["item_id"], many).select("doc_id", "item_id", "doc_words", "item_words", "seeds").mapInPandas(_tiled(span), schema)


def covered(documents: DataFrame, items: DataFrame, share: float = 0.5, span: int = SHORT) -> DataFrame:
    """(doc_id, item_id, longest, covered, item_words, tiles, share): documents in which tiles of at least `span` words
    cover at least that share of an item's words, in any order."""
    found = leaks(documents, items, span).withColumn("share", F.round(F.col("covered") / F.col("item_words"), 4))
    return found.where(F.col("covered") >= share * F.col("item_words"))
