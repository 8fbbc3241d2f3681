"""Splitting oversized items at natural boundaries (problem 3).

Boundaries are the ends of paragraphs, lines and sentences. At each boundary the words in a block before it are compared
with those in a block after it; a low similarity between two peaks is a valley and marks a change of topic. Within each
window of sizes the boundary with the deepest valley is cut; the next piece starts up to `overlap` characters earlier, at
the start of a word or sentence, or inside a long word anywhere. Without such a boundary a word end is cut, and only inside
a run without any that is longer than the limit any place. Scripts without white space are cut at the ends of sentences.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 2000, 200
#: Words of each block that is compared at a boundary, and the share of a piece that is filled at least.
BLOCK, FILL = 40, 0.5
BREAK = re.compile(r"(?P<para>(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*)|(?P<line>\r\n|\n|\r)|(?P<sent>(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？｡])[\"'”’)\]」』）]*\s*)")
WORD = re.compile(r"[^\W_]+")
SPACE = re.compile(r"\s+")
RANK = {"para": 3, "line": 2, "sent": 1}


def similarity(a: Counter, b: Counter) -> float:
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def valleys(text: str, cuts: list[int], block: int = BLOCK) -> list[float]:
    """The depth of the similarity valley at each boundary: how far both neighbouring peaks rise above it."""
    found = [(m.start(), m.group().lower()) for m in WORD.finditer(text)]
    starts, toks = [s for s, _ in found], [w for _, w in found]
    sims = []
    for c in cuts:
        k = bisect_left(starts, c)
        sims.append(similarity(Counter(toks[max(0, k - block) : k]), Counter(toks[k : k + block])))
    # the peak on either side is that of the neighbour, as long as the way there does not fall
    left, right = list(sims), list(sims)
    for i in range(1, len(sims)):
        left[i] = left[i - 1] if sims[i - 1] >= sims[i] else sims[i]
    for i in range(len(sims) - 2, -1, -1):
        right[i] = right[i + 1] if sims[i + 1] >= sims[i] else sims[i]
    return [(a - s) + (b - s) for a, b, s in zip(left, right, sims)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(start, fresh, end, forced): text[start:end] is a piece, text[start:fresh] repeats the piece before; forced marks an
    end inside a run of more than `limit` characters without white space."""
    if len(text) <= limit:
        return [(0, 0, len(text), False)]
    marks = [(m.end(), RANK[m.lastgroup]) for m in BREAK.finditer(text) if 0 < m.end() < len(text)]
    ends = [e for e, _ in marks]
    depth = valleys(text, ends)
    gaps = [m.span() for m in SPACE.finditer(text)]
    spaces = [e for _, e in gaps]
    out, start, fresh = [], 0, 0

    def inside(cut: int) -> bool:
        w = bisect_right(spaces, cut) - 1
        since = spaces[w] if w >= 0 else 0
        until = gaps[w + 1][0] if w + 1 < len(gaps) else len(text)
        return since < cut < until and until - since > limit

    while len(text) - start > limit:
        cut = 0
        lo, hi = bisect_right(ends, max(fresh, start + int(limit * FILL))), bisect_right(ends, start + limit)
        if lo < hi:
            cut = ends[max(range(lo, hi), key=lambda i: (round(depth[i], 9), marks[i][1], ends[i]))]
        else:
            k = bisect_right(ends, start + limit) - 1
            w = bisect_right(spaces, start + limit) - 1
            if k >= 0 and ends[k] > fresh:
                cut = ends[k]
            elif w >= 0 and spaces[w] > fresh:
                cut = spaces[w]
            else:
                near = [x[i] for x in (ends, spaces) if (i := bisect_right(x, fresh)) < len(x)]
                if start < fresh and min(near, default=len(text)) - fresh <= limit:
                    start = fresh  # a long word fits without the overlap
                    continue
                cut = start + limit
        out.append((start, fresh, cut, inside(cut)))
        fresh = cut
        back = max(start + 1, cut - overlap)
        starts = [x[i] for x in (ends, spaces) if (i := bisect_left(x, back)) < len(x) and x[i] < cut]
        start = min(starts, default=back)
    out.append((start, fresh, len(text), False))
    return out


def _split(limit: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (r.chunk_id, n, r.heading, r.anchor, s, fresh, e, forced, r.text[s:e])
                for r in f.itertuples(index=False) for n, (s, fresh, e, forced) in enumerate(pieces(r.text, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["chunk_id", "piece", "heading", "anchor", "start", "fresh", "end", "forced", "text"])

    return run


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece, heading, anchor, start, fresh, end, forced, text) of every chunk of more than `limit` characters.

    Pieces are numbered from 0; start, fresh and end are places in the chunk's text in code points, and the parts from
    fresh to end of all pieces put together are the text. Null, empty and short texts give no rows; repeated rows count
    once; null headings and anchors stay null; extra columns are ignored.
    """
    fields = [("chunk_id", T.LongType()), ("piece", T.IntegerType()), ("heading", T.StringType()), ("anchor", T.StringType()), ("start", T.IntegerType()), ("fresh", T.IntegerType()), ("end", T.IntegerType()), ("forced", T.BooleanType()), ("text", T.StringType())]
    large = chunks.where(F.length("text") > limit).select("chunk_id", "heading", "anchor", "text").distinct()
    return large.mapInPandas(_split(limit, overlap), T.StructType([T.StructField(c, t) for c, t in fields]))


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, forced) of every split chunk: 1 if some piece ends inside a run of more than `limit` characters without
    white space, so that this could not be avoided, else 0."""
    return split_oversized(chunks, limit, overlap).groupBy("chunk_id").agg(F.max(F.col("forced").cast("int")).alias("forced"))


def wholeness(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, whole, within, linked) of every split chunk: whether the fresh parts of its pieces put together are its
    text, no piece has more than `limit` characters, and every piece but the first repeats 1 to `overlap` characters, or none
    where a long word would else not fit."""
    p = split_oversized(chunks, limit, overlap).withColumn("k", F.xxhash64("heading", "anchor"))
    repeated = F.col("fresh") - F.col("start")
    one = p.groupBy("chunk_id", "k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.expr("substring(text, fresh - start + 1)").alias("t")))), lambda x: x["t"]), "").alias("all"),
        F.max(F.length("text")).alias("longest"), F.max(repeated).alias("most"),
    )
    texts = chunks.where(F.length("text") > limit).select("chunk_id", F.xxhash64("heading", "anchor").alias("k"), "text").distinct()
    whole = F.col("all") == F.col("text")
    return one.join(texts, ["chunk_id", "k"]).groupBy("chunk_id").agg(F.max(whole).alias("whole"), F.min(F.col("longest") <= limit).alias("within"), F.min(F.col("most") <= overlap).alias("linked"))
