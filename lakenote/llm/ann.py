"""The most similar vectors of every vector (problem 1).

An inverted file in two levels. Coarse centroids, fitted on a bounded sample, deal the vectors out to cells of bounded
blocks; a vector asked for goes to the cells that can hold similar ones. Within a block, fine lists are fitted where the
vectors lie, so their number follows the data, and what a vector differs by from its list's centroid is product-quantised.
For each list that can hold similar vectors, the entries of the asked vector's distance tables are summed at the stored
codes (asymmetric distances), and every row whose estimate can reach the wanted cosine is compared exactly.

Nothing is kept or probed by a fixed number: a list is passed over, and an estimate dropped, only when the wanted cosine
lies more than SPREAD (at least MARGIN) or SLACK standard deviations off, where what two vectors have apart from the
centroid is taken as unrelated. So in a group of like vectors all of its lists are searched, and all that may count compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakenote.operators.skew import merge_join, salted_join
from lakenote.tables import checkpoint

DIM = 64
#: Vectors that a coarse cell has on average, and the most cells: their centroids are sent to every task (1 MB).
PER_LIST, MAX_CELLS = 32768, 4096
#: Rounds of k-means, and vectors of the sample it is fitted on.
ROUNDS, SAMPLE = 6, 65536
#: Most stored vectors of a block, vectors asked for with one block, and those of them whose tables are held at once.
BLOCK, ASKED, STRIP = 32768, 32768, 8192
#: Vectors of a fine list on average, and of a block's own sample.
FINE, LOCAL = 64, 8192
#: Parts of a vector that are quantised each, and values of a part.
PARTS, VALUES = 4, 256
#: Standard deviations at which lists are passed over (and the least such distance), and at which estimates are dropped.
SPREAD, MARGIN, SLACK = 1.2, 0.06, 4.0
#: The share of a cell's, and of a fine list's vectors that may lie further from the centroid than its bound assumes.
FAR_CELL, FAR_LIST = 0.01, 0.25


def kmeans(x: np.ndarray, k: int, unit: bool, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows of a fixed shuffle; empty ones keep their place."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        by = np.argsort(near, kind="stable")
        lists, first = np.unique(near[by], return_index=True)
        c[lists] = np.add.reduceat(x[by], first, axis=0) / np.diff(first, append=len(x))[:, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[s : s + 2048] @ c.T - half).argmax(1) for s in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach(least: np.ndarray | float, s: np.ndarray | float, dim: int, spread: float) -> np.ndarray:
    """The cosine to a centroid from which a vector may have a cosine of `least` with a vector whose own is s."""
    apart = np.sqrt(np.maximum(0, (1 - np.square(least)) * (1 - np.square(s))) / max(1, dim - 1))
    return least * s - np.maximum(MARGIN, spread * apart)


def _filed(model):
    """Rows (id, vec) with their cell and their cosine to its centroid."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = model.value.astype(np.float64)
        for f in frames:
            if not len(f):
                continue
            raw = np.stack(f["vec"].to_numpy()).astype(np.float32)
            x = _unit(raw)
            near = nearest(x, c)
            yield pd.DataFrame({"id": f["id"], "cell": near.astype(np.int32), "s": np.einsum("nd,nd->n", x, c[near]), "vec": [r.tobytes() for r in raw]})

    return run


def _reached(model, low: np.ndarray, own: bool, spread: float):
    """Rows (id, least, vec) with the cells that can have a vector of a cosine of at least `least`; low is the cosine to
    the centroid that all but FAR_CELL of a cell's vectors have, above 1 for empty cells. own: the nearest cell only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = model.value.astype(np.float64)
        for f in frames:
            if not len(f):
                continue
            x = _unit(np.frombuffer(b"".join(f["vec"]), np.float32).reshape(len(f), -1))
            near, cos = nearest(x, c), x @ c.T
            if own:
                cells = list(near.astype(np.int32)[:, None])
            else:
                ok = (cos >= reach(f["least"].to_numpy()[:, None], np.minimum(low, 1)[None, :], x.shape[1], spread)) & (low <= 1)
                cells = [np.flatnonzero(r).astype(np.int32) for r in ok]
            yield pd.DataFrame({"id": f["id"], "least": f["least"], "cells": cells, "vec": f["vec"]})

    return run


class _Block:
    """The fine lists and codes of the stored vectors of one block."""

    def __init__(self, x: np.ndarray):
        small = x.astype(np.float32)
        some = small[np.random.default_rng(2).permutation(len(x))[:LOCAL]]
        self.c = kmeans(some, max(1, len(x) // FINE), True)
        near = nearest(small, self.c)
        s = np.einsum("nd,nd->n", small, self.c[near])
        sub, rest = x.shape[1] // PARTS, small - self.c[near]
        some = rest[np.random.default_rng(3).permutation(len(x))[:LOCAL]]
        self.cut = [slice(p * sub, (p + 1) * sub if p < PARTS - 1 else x.shape[1]) for p in range(PARTS)]
        self.books = [kmeans(np.ascontiguousarray(some[:, q]), min(VALUES, len(some)), False) for q in self.cut]
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, q]), b) for q, b in zip(self.cut, self.books)], axis=1)
        err = np.linalg.norm(rest - np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1), axis=1)
        slack = np.minimum(err, SLACK * err / np.sqrt(x.shape[1])) + 1e-5
        self.first = np.cumsum([0, *map(len, self.books)])
        by = np.argsort(near, kind="stable")  # rows stay in the order of their ids
        self.lists = []
        for rows in np.split(by, np.flatnonzero(np.diff(near[by])) + 1):
            self.lists.append((int(near[rows[0]]), rows, float(np.quantile(s[rows], FAR_LIST)), (codes[rows] + self.first[:-1]).T.ravel(), slack[rows]))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For every asked vector the products of its parts with all values of the part, one after the other."""
        return np.concatenate([q[:, cut] @ b.T for cut, b in zip(self.cut, self.books)], axis=1)


def _searched(k: int, dim: int, spread: float):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        stored = f["least"].isna().to_numpy()
        ids = f["id"].to_numpy()
        vec = _unit(np.frombuffer(b"".join(f["vec"]), np.float32).reshape(-1, dim))
        by_id = np.flatnonzero(stored)[np.argsort(ids[stored], kind="stable")]
        own, x, asked, q, wanted = ids[by_id], vec[by_id], ids[~stored], vec[~stored], f["least"].to_numpy()[~stored]
        out = []
        if len(own) and len(asked):
            block = _Block(x)
            for at in range(0, len(q), STRIP):
                part, name, bar = q[at : at + STRIP], asked[at : at + STRIP], wanted[at : at + STRIP]
                least, small = bar.copy(), part.astype(np.float32)
                table, to = block.tables(small), block.c @ small.T
                best, other = np.full((len(part), k), -9.0), np.full((len(part), k), np.iinfo(np.int64).max)
                for one, rows, low, codes, slack in block.lists:
                    row = np.flatnonzero(to[one] >= reach(least, low, dim, spread))
                    if not len(row):
                        continue
                    # the asymmetric distances: table entries at the stored codes, summed over the parts
                    guess = np.take(table[row], codes, axis=1).reshape(len(row), PARTS, -1).sum(1)
                    row = row[(guess + slack >= (least[row] - to[one, row])[:, None]).any(1)]
                    if not len(row):
                        continue
                    cos = np.round(part[row] @ x[rows].T, 9)
                    cos[(name[row][:, None] == own[rows]) | (cos < bar[row, None])] = -9
                    hit = cos.max(1) > best[row, -1]
                    hit |= (cos.max(1) == best[row, -1]) & (best[row, -1] > -9)  # of equal ones the smaller id
                    row, cos = row[hit], cos[hit]
                    if len(row):
                        all_cos = np.concatenate([best[row], cos], axis=1)
                        all_ids = np.concatenate([other[row], np.broadcast_to(own[rows], cos.shape)], axis=1)
                        top = np.lexsort((all_ids, -all_cos), axis=1)[:, :k]
                        best[row], other[row] = np.take_along_axis(all_cos, top, 1), np.take_along_axis(all_ids, top, 1)
                        least[row] = np.maximum(least[row], best[row, -1])
                r, j = np.nonzero(best > -9)
                out.append((name[r], other[r, j], best[r, j]))
        a, b, c = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pd.DataFrame({"id": a, "other": b, "cos": c})

    return run


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, vec): vectors of that many numbers, none null or infinite and not all zero; one for each id."""
    v = vectors.where("chunk_id is not null").where((F.size("vec") == dim) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("float")) == float("inf"))) & F.exists("vec", lambda v: v != 0))
    return v.select(F.col("chunk_id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec")).dropDuplicates(["id"])


def _copies(u: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """(rest, first) where more than k + 1 vectors are the same: first has for each such group (h) the k + 1 smallest ids in
    order and in `n` its size, rest the others. No vector has one of the rest among its k most similar before those of first."""
    keyed = u.select("id", F.xxhash64("vec").alias("h"))
    hot = keyed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    same = checkpoint(salted_join(keyed, hot.withColumn("size", F.col("n")), ["h"]))
    if same.isEmpty():
        return None
    # the limit on the rank is applied in each task before the shuffle, so a group is never gathered whole
    first = same.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("rank") <= k + 1)
    first = checkpoint(first.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("first"), F.first("size").alias("n")))
    rest = salted_join(same, first, ["h"]).where(~F.array_contains("first", F.col("id"))).select("id", "h")
    return checkpoint(rest), first


def neighbours(vectors: DataFrame, k: int = 5, least: float = -1.0, dim: int = DIM, ask: Column | None = None, spread: float = SPREAD) -> DataFrame:
    """(id, other, cos, rank): for every vector, or those that `ask` holds for, its k most similar others of a cosine of at least `least`, equal ones by id.

    Null, empty, all-zero vectors and those of another length take no part; repeated rows count once; of several vectors
    of one id one is taken. Of more than k + 1 equal vectors only the k + 1 smallest ids are indexed; the others' most similar
    are the first k of these. The sample is at most SAMPLE vectors, chosen by a hash of their ids; all vectors are indexed.
    Cosines are exact at nine decimals; a pair is lost only if its vectors lie less alike to the centroids, or to their codes,
    than `spread` and SLACK allow. Without a lower bound from `least`, each vector's own cell gives one first.
    """
    spark = vectors.sparkSession
    u = checkpoint(usable(vectors, dim))
    direct = None
    if copies := _copies(u, k):
        rest, first = copies
        u = checkpoint(merge_join(u, rest.select("id"), "id", "left_anti"))
        asked_rest = rest if ask is None else rest.where(ask)
        direct = salted_join(asked_rest, first, ["h"]).where(F.lit(least <= 1)).select("id", F.posexplode(F.slice("first", 1, k)).alias("rank", "other")).select("id", "other", F.lit(1.0).alias("cos"), (F.col("rank") + 1).alias("rank"))
    n = u.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = u.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").toPandas()["vec"]
    x = np.stack(sample.to_numpy()).astype(np.float32) if len(sample) else np.ones((1, dim), np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = spark.sparkContext.broadcast(kmeans(x, max(1, min(n // PER_LIST, MAX_CELLS, len(x))), True))
    filed = checkpoint(u.mapInPandas(_filed(model), "id bigint, cell int, s double, vec binary"))
    shape = filed.groupBy("cell").agg(F.percentile_approx("s", FAR_CELL, 1000).alias("low"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    low = np.full(len(model.value), 2.0)
    for r in shape.collect():  # a row for each cell, at most MAX_CELLS
        low[r.cell] = r.low

    cols = ["id", "least", "cell", "vec", "block", "queue"]
    mix = F.xxhash64("id", F.lit(7))

    def search(wanted: DataFrame, own: bool) -> DataFrame:
        reached = checkpoint(wanted.mapInPandas(_reached(model, low, own, spread), "id bigint, least double, cells array<int>, vec binary"))
        queues = reached.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("queues"))
        both = F.broadcast(shape.select("cell", "blocks").join(queues, "cell"))  # a row for each cell, at most MAX_CELLS
        stored = filed.join(both, "cell").withColumns({"block": F.pmod(mix, F.col("blocks")).cast("int"), "queue": F.explode(F.expr("sequence(0, queues - 1)")), "least": F.lit(None).cast("double")}).select(*cols)
        queries = reached.select("id", "least", F.explode("cells").alias("cell"), "vec").join(both, "cell").withColumns({"block": F.explode(F.expr("sequence(0, blocks - 1)")), "queue": F.pmod(mix, F.col("queues")).cast("int")}).select(*cols)
        found = stored.unionByName(queries).groupBy("cell", "block", "queue").applyInPandas(_searched(k, dim, spread), "id bigint, other bigint, cos double")
        best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "other"))
        return found.withColumn("rank", best).where(F.col("rank") <= k)

    wanted = (filed if ask is None else filed.where(ask)).select("id", F.lit(float(least)).alias("least"), "vec")
    if least <= 0:
        # the k-th best of the own cell bounds what other cells must offer
        bound = search(wanted, True).where(F.col("rank") == k).select("id", F.col("cos").alias("bound"))
        wanted = checkpoint(merge_join(wanted, bound, "id", "left").select("id", F.greatest("least", F.coalesce("bound", "least")).alias("least"), "vec"))
    ranked = search(wanted, False)
    return ranked if direct is None else ranked.unionByName(direct)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.85, dim: int = DIM) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: pairs of at least that cosine of which one is among the other's k most similar."""
    return neighbours(vectors, k, least, dim).select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()
