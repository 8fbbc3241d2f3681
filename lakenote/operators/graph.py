"""Links between notes, similar notes and the note graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakenote.operators.corpus import dot
from lakenote.tables import checkpoint

#: Vectors of a block when every pair is compared, and rows of a block that are compared with another block at once.
BLOCK, STRIP = 4096, 512


def link_pairs(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(src_path, src_title, src_ext, dst_path, dst_title, dst_ext): distinct links whose both ends are known documents."""
    ends = links.select("src_id", "dst_path").where("src_id is not null and dst_path is not null").distinct()
    s = docs.select(F.col("doc_id").alias("src_id"), F.col("path").alias("src_path"), F.col("title").alias("src_title"), F.col("ext").alias("src_ext"))
    t = docs.select(F.col("path").alias("dst_path"), F.col("title").alias("dst_title"), F.col("ext").alias("dst_ext"))
    return ends.join(s, "src_id").join(t, "dst_path").drop("src_id").distinct()


def outgoing(links: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """(path, title, ext) of the documents that a document links to, by title."""
    return link_pairs(links, docs.select("*")).where(F.col("src_path") == path).select(F.col("dst_path").alias("path"), F.col("dst_title").alias("title"), F.col("dst_ext").alias("ext")).distinct().orderBy("title", "path")


def backlinks(links: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """(path, title, ext) of the documents that link to a path, by title."""
    hit = links.where(F.col("dst_path") == path).select(F.col("src_id").alias("doc_id")).distinct()
    return docs.join(hit, "doc_id", "left_semi").select("path", "title", "ext").distinct().orderBy("title", "path")


def unlinked(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, title, mtime) of notes that no other note links to, by path without case; links are distinct before the join."""
    src = docs.select(F.col("doc_id").alias("src_id"), F.col("path").alias("src_path"))
    known = links.where("src_id is not null and dst_path is not null").select("src_id", "dst_path").distinct().join(src, "src_id").where("src_path <> dst_path").select(F.col("dst_path").alias("path")).distinct()
    return docs.where("kind = 'note'").join(known, "path", "left_anti").select("path", "title", "mtime").orderBy(F.lower("path"), "path")


def degrees(edges: DataFrame) -> DataFrame:
    """(path, degree) over both ends of edges (source, target)."""
    return edges.select(F.col("source").alias("path")).unionByName(edges.select(F.col("target").alias("path"))).groupBy("path").agg(F.count("*").alias("degree"))


def within_hops(edges: DataFrame, start: Column, hops: int = 2) -> DataFrame:
    """(path, hop): everything at most so many undirected steps from the paths for which `start` holds, with the least
    number of steps. Only new paths are followed in each step."""
    both = edges.select(F.col("source").alias("path"), F.col("target").alias("to")).unionByName(edges.select(F.col("target").alias("path"), F.col("source").alias("to"))).distinct()
    seen = both.select("path").distinct().where(start).withColumn("hop", F.lit(0))
    front = seen
    for n in range(1, hops + 1):
        front = front.select("path").join(both, "path").select(F.col("to").alias("path")).distinct().join(seen.select("path"), "path", "left_anti").withColumn("hop", F.lit(n))
        seen = seen.unionByName(front)
    return seen


def doc_vectors(chunks: DataFrame, vectors: DataFrame, docs: DataFrame, dim: int = 64) -> DataFrame:
    """(doc_id, vec): the normalised mean of the unit vectors of a note's chunks."""
    own = chunks.select("chunk_id", "doc_id").join(docs.where("kind = 'note'").select("doc_id"), "doc_id", "left_semi")
    whole = own.join(vectors, "chunk_id").groupBy("doc_id").agg(F.array(*(F.avg(F.get("vec", F.lit(i))) for i in range(dim))).alias("m"))
    return whole.withColumn("n", F.sqrt(dot(F.col("m"), F.col("m")))).select("doc_id", F.transform("m", lambda x: x / F.greatest(F.col("n"), F.lit(1e-12))).alias("vec"))


def similar_to(vecs: DataFrame, doc_id: int, k: int = 6, least: float = 0.45) -> DataFrame:
    """(doc_id, sim): the k documents most similar to one, itself left out, at least `least`; equal ones by id."""
    one = vecs.where(F.col("doc_id") == doc_id).select(F.col("vec").alias("q"), F.lit(1).alias("one"))
    return vecs.where(F.col("doc_id") != doc_id).withColumn("one", F.lit(1)).join(F.broadcast(one), "one").select("doc_id", dot(F.col("vec"), F.col("q")).alias("sim")).where(F.col("sim") >= least).orderBy(F.desc("sim"), "doc_id").limit(k)


def _sides(planes: int, tables: int):
    """A column of one key for each table: the table's number and the sides of its planes on which a vector lies."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sides(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return vec
        x = np.stack(vec.to_numpy())
        normals = np.random.default_rng(1).normal(size=(x.shape[1], tables * planes))
        bits = (x @ normals > 0).reshape(len(x), tables, planes)
        return pd.Series(list((bits << np.arange(planes)).sum(2) + (np.arange(tables) << planes)))

    return sides


def _compared(k: int, least: float):
    def top(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, own: bool) -> list[pd.DataFrame]:
        """The k most similar of b for each of a; b is in the order of its ids, so of equal ones the smallest comes first."""
        out = []
        for s in range(0, len(a), STRIP):
            sim = np.nan_to_num(np.round(x[s : s + STRIP] @ y.T, 9), nan=-9)
            rows = np.arange(len(sim))
            if own:
                sim[rows, s + rows] = -9
            for _ in range(min(k, len(b))):
                j = sim.argmax(1)
                v = sim[rows, j]
                ok = v >= max(least, -1.5)
                out.append(pd.DataFrame({"doc_id": a[s : s + STRIP][ok], "other": b[j[ok]], "sim": v[ok]}))
                sim[rows, j] = -9
        return out

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for block in dict.fromkeys(key):
            part = f[f["block"] == block].sort_values("doc_id")
            sides.append((part["doc_id"].to_numpy(), np.stack(part["vec"].to_numpy()) if len(part) else np.zeros((0, 1))))
        if not all(len(a) for a, _ in sides):
            return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "sim": np.zeros(0)})
        out = top(*sides[0], *sides[0], True) if len(sides) == 1 else top(*sides[0], *sides[1], False) + top(*sides[1], *sides[0], False)
        # each pair of blocks gives at most k rows for each vector to the shuffle
        return pd.concat(out)

    return run


def neighbours(vecs: DataFrame, k: int = 3, least: float = 0.45) -> DataFrame:
    """(doc_id, other, sim): each vector's k most similar others of at least `least`, exactly; equal ones by id.

    Every pair is compared, at nine decimals: the vectors are cut into blocks of about BLOCK rows, one matrix product is
    taken for each pair of blocks, and only its k best for each vector are shuffled. The time grows with the square of the
    number of vectors; each vector is sent once for every block."""
    vecs = checkpoint(vecs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "vec").where("doc_id is not null"))  # counted, then read
    blocks = max(1, -(-vecs.count() // BLOCK))
    mine, other = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = vecs.withColumn("block", mine).withColumn("other", other).select("doc_id", "vec", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = sent.groupBy("lo", "hi").applyInPandas(_compared(k, least), "doc_id bigint, other bigint, sim double")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("sim"), "other"))
    return found.withColumn("k", best).where(F.col("k") <= k).drop("k")


def neighbours_in_buckets(vecs: DataFrame, k: int = 3, least: float = 0.45, planes: int = 4, tables: int = 12) -> DataFrame:
    """(doc_id, other, sim): each vector's k most similar of those that fall on the same side of `planes` random planes in
    one of `tables` drawings; equal ones by id. Near vectors meet in some table with high probability; none are compared
    twice: at a cosine of 0.6 the defaults meet with a probability of 0.97. More planes make smaller buckets for larger
    collections and need more tables. With planes = 0 every pair is compared (see neighbours)."""
    if planes == 0:
        return neighbours(vecs, k, least)
    vecs = checkpoint(vecs)  # read on both sides of the join
    left = vecs.select(F.col("doc_id").alias("a"), F.col("vec").alias("va"))
    right = vecs.select(F.col("doc_id").alias("b"), F.col("vec").alias("vb"))
    sides = _sides(planes, tables)
    pairs = left.withColumn("key", F.explode(sides("va"))).join(right.withColumn("key", F.explode(sides("vb"))), "key")
    # the similarity is worked out before pairs met in several tables are made one, so that no vectors are shuffled again
    once = pairs.where("a < b").select("a", "b", dot(F.col("va"), F.col("vb")).alias("sim")).where(F.col("sim") >= least).dropDuplicates(["a", "b"])
    ends = F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("doc_id"), F.col("a").alias("other"))))
    scored = once.select(ends.alias("e"), "sim").select("e.doc_id", "e.other", "sim")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("sim"), "other"))
    return scored.withColumn("k", best).where(F.col("k") <= k).drop("k")


def graph_edges(links: DataFrame, docs: DataFrame, near: DataFrame) -> DataFrame:
    """(source, target, type, weight): link edges between notes, and similar pairs (near: doc_id, other, sim) that no link
    joins in either direction, each once with the smaller path first."""
    notes = docs.where("kind = 'note'").select("path")
    link = link_pairs(links, docs).join(notes.withColumnRenamed("path", "dst_path"), "dst_path", "left_semi").select(F.col("src_path").alias("source"), F.col("dst_path").alias("target")).distinct()
    p = docs.select("doc_id", "path")
    pair = near.join(p.withColumnRenamed("path", "x"), "doc_id").join(p.select(F.col("doc_id").alias("other"), F.col("path").alias("y")), "other")
    pair = pair.select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "sim").groupBy("source", "target").agg(F.max("sim").alias("sim"))
    taken = link.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    fresh = pair.join(taken, ["source", "target"], "left_anti")
    none = F.lit(None).cast("double")
    return link.select("source", "target", F.lit("link").alias("type"), none.alias("weight")).unionByName(fresh.select("source", "target", F.lit("similar").alias("type"), F.round("sim", 3).alias("weight")))
