"""Semantic and hybrid retrieval: exact vector top-k, reciprocal-rank fusion, re-ranking, per-document caps and answers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakenote.functions.text import HL_END, HL_START, excerpt, fold, without_image_marks
from lakenote.operators.corpus import dot

#: Fusion constant, and the sizes of the pool that is re-ranked: best fused, and best of each list on its own.
RRF_K, FUSED, EACH = 60, 20, 15


class Embedder(Protocol):
    name: str
    min_similarity: float

    def embed_passages(self, texts: list[str]) -> list[list[float]]: ...
    def embed_query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    def score(self, query: str, passages: list[str]) -> list[float]: ...


class HashEmbedder:
    """A deterministic stand-in for a model: hashed words and word pairs, of unit length."""

    name, min_similarity = "hash-64", 0.3

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _one(self, text: str) -> list[float]:
        import math
        import zlib

        v, w = [0.0] * self.dim, fold(text).split()
        for t in [*w, *map(" ".join, zip(w, w[1:]))]:
            h = zlib.crc32(t.encode())
            v[h % self.dim] += 1.0 if h >> 16 & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    def embed_passages(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    embed_query = _one


class LexicalReranker:
    """A deterministic stand-in for a model: the share of the question's words that a passage has."""

    def score(self, query: str, passages: list[str]) -> list[float]:
        q = set(fold(query).split())
        return [len(q & set(fold(p).split())) / max(1, len(q)) for p in passages]


def embed_missing(chunks: DataFrame, docs: DataFrame, vectors: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(chunk_id, vec) for chunks with a document but no vector, from the first 2,000 characters of title, heading and text.
    Chunks for which the model fails get none."""
    text = F.substring(F.concat_ws("\n", "title", "heading", "text"), 1, 2000)
    todo = chunks.join(docs.select("doc_id", "title"), "doc_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", text.alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), batch):
                part = f.iloc[s : s + batch]
                try:
                    vecs = list(embedder.embed_passages(part["t"].tolist()))
                except Exception:  # noqa: BLE001 - keyword search must not wait for a model; the next build tries again
                    continue
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "vec": vecs})

    return todo.mapInPandas(run, T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))]))


def vector_topk(vectors: DataFrame, query: list[float], k: int, least: float = -1.0) -> DataFrame:
    """(chunk_id, sim): the k unit vectors of largest dot product with the query, at least `least`; equal ones by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("chunk_id", dot(F.col("vec"), q).alias("sim")).orderBy(F.desc("sim"), "chunk_id").limit(k).where(F.col("sim") >= least)


def semantic_search(vectors: DataFrame, chunks: DataFrame, docs: DataFrame, query: list[float], where: Column | None = None, fetch: int = 40, least: float = 0.3, prefilter: bool = False) -> DataFrame:
    """Ranked hits with similarity (3 decimals) and a snippet of 40 words.

    As a vector index does, the best 5 * fetch vectors are taken before the filters; with prefilter the filters come
    first, so a selective one loses nothing.
    """
    d = docs if where is None else docs.where(where)
    known = chunks.select("chunk_id", "doc_id", "heading", "anchor", "text", "images").join(d.select("doc_id", "path", "title", "ext"), "doc_id")
    v = vectors.join(known.select("chunk_id"), "chunk_id", "left_semi") if prefilter else vectors
    hits = vector_topk(v, query, 5 * fetch, least).join(known, "chunk_id")
    hits = hits.withColumn("similarity", F.round("sim", 3)).withColumn("snippet", excerpt(F.col("text"), 40)).orderBy(F.desc("similarity"), F.desc("sim"), "chunk_id").limit(fetch)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), F.desc("sim"), "chunk_id")) - 1).drop("sim")


def fuse(keyword: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """(chunk_id, rrf, match, fused) of two ranked lists (chunk_id, rank from 0): reciprocal-rank fusion.

    match is keyword, semantic or both. Equal sums keep the keyword list's order, then the semantic list's.
    """
    both = keyword.select("chunk_id", "rank", F.lit(0).alias("src")).unionByName(semantic.select("chunk_id", "rank", F.lit(1).alias("src")))
    g = both.groupBy("chunk_id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("rrf"), F.min(F.struct("src", "rank")).alias("first"), F.count("*").alias("n"), F.max("src").alias("last"))
    match = F.when(F.col("n") > 1, "both").when(F.col("last") == 0, "keyword").otherwise("semantic")
    order = Window.orderBy(F.desc(F.round("rrf", 12)), "first.src", "first.rank")  # over two short lists
    return g.select("chunk_id", "rrf", match.alias("match"), (F.row_number().over(order) - 1).alias("fused"))


def rerank(fused: DataFrame, keyword: DataFrame, semantic: DataFrame, texts: DataFrame, question: str, model: Reranker, chars: int = 1500) -> DataFrame:
    """Add rerank and final: the pool is the best FUSED of the fusion and the best EACH of either list; the others keep
    their fused order behind it. texts: (chunk_id, title, heading, text). Fewer than two rows keep their order, and so
    do rows for which the model fails."""
    pool = fused.where(F.col("fused") < FUSED).select("chunk_id").unionByName(keyword.where(F.col("rank") < EACH).select("chunk_id")).unionByName(semantic.where(F.col("rank") < EACH).select("chunk_id")).distinct()
    body = F.substring(F.concat_ws("\n", "title", "heading", "text"), 1, chars)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                scores = [round(float(s), 3) for s in model.score(question, f["p"].tolist())]
            except Exception:  # noqa: BLE001 - without scores the fused order stands
                continue
            yield pd.DataFrame({"chunk_id": f["chunk_id"], "rerank": scores})

    scored = pool.join(texts, "chunk_id").select("chunk_id", body.alias("p")).mapInPandas(run, T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("rerank", T.DoubleType())]))
    order = Window.orderBy(F.col("rerank").isNull(), F.desc("rerank"), "fused")  # over two short lists
    return fused.join(scored, "chunk_id", "left").withColumn("final", F.row_number().over(order) - 1)


def cap_per_document(ranked: DataFrame, per_doc: int, limit: int, rank: str = "final", key: str = "path") -> DataFrame:
    """At most per_doc rows of a document in ranked order (0: no cap), then the first `limit`, numbered n from 1."""
    r = ranked
    if per_doc > 0:
        r = r.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where(F.col("_k") <= per_doc).drop("_k")
    return r.orderBy(rank).limit(limit).withColumn("n", F.row_number().over(Window.orderBy(rank)))  # over `limit` rows


def answer(hits: DataFrame, mode: str = "summary") -> DataFrame:
    """(n, passage): each hit as Markdown; summary takes 4 hits with their snippets, report 10 with up to 250 words."""
    take, n_words, n_images = (4, 70, 1) if mode == "summary" else (10, 250, 3)
    text = excerpt(F.col("text"), n_words)
    if mode == "summary":
        marked = F.replace(F.replace("snippet", F.lit(HL_START), F.lit("**")), F.lit(HL_END), F.lit("**"))
        text = F.when(F.length("snippet") > 0, marked).otherwise(text)
    quote = F.concat(F.lit("> "), F.replace(without_image_marks(text), F.lit("\n"), F.lit("\n> ")))
    shown = F.transform(F.slice(F.coalesce("images", F.array()), 1, n_images), lambda i: F.concat(F.lit("!["), F.coalesce(F.nullif(i["alt"], F.lit("")), "heading"), F.lit("]("), i["url"], F.lit(")\n")))
    head = F.concat(F.lit("### ["), F.col("n").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("heading", F.lit("")))
    return hits.where(F.col("n") <= take).select("n", F.array_join(F.concat(F.array(head, F.lit(""), quote, F.lit("")), shown), "\n").alias("passage"))


def answer_events(hits: DataFrame, mode: str = "summary") -> Iterator[tuple[str, object]]:
    """The sources, the passages one by one and the end, as an endpoint sends them; reads a ranked page of hits."""
    yield "sources", [r.asDict(True) for r in hits.select("n", "path", "title", "heading", "anchor", "snippet", "images", "ext").orderBy("n").toLocalIterator()]
    for r in answer(hits, mode).orderBy("n").toLocalIterator():
        yield "delta", r["passage"]
    yield "done", {}
