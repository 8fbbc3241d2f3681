"""One object over a corpus: every method gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakenote import index
from lakenote.operators import graph as G
from lakenote.operators import hybrid as H
from lakenote.operators import keyword as K
from lakenote.operators import stats as S
from lakenote.operators.corpus import latest_docs, passages, unit_vectors
from lakenote.operators.filters import Filters, without_embedded_images
from lakenote.tables import checkpoint, read


class Engine:
    """Search, graph and reports. embedder and reranker are plug-ins; without them search is by keyword only."""

    def __init__(self, docs: DataFrame, chunks: DataFrame, links: DataFrame, vectors: DataFrame | None = None, doc_images: DataFrame | None = None, postings: DataFrame | None = None, lengths: DataFrame | None = None, embedder: H.Embedder | None = None, reranker: H.Reranker | None = None, stemming: bool = True):
        self.docs, self.chunks, self.links, self.vectors = docs, chunks, links, vectors
        self.doc_images, self.postings, self.lengths = doc_images, postings, lengths
        self.embedder, self.reranker, self.stemming = embedder, reranker, stemming

    @classmethod
    def from_tables(cls, spark: SparkSession, d: str, **more) -> Engine:
        """Over the tables docs, chunks, links and vectors of a folder."""
        return cls(latest_docs(read(spark, d, "docs")), passages(read(spark, d, "chunks")), read(spark, d, "links"), unit_vectors(read(spark, d, "vectors")), **more)

    @classmethod
    def from_index(cls, spark: SparkSession, out: str, **more) -> Engine:
        """Over the last snapshot of a built index."""
        t = {n: index.table(spark, out, n) for n in index.TABLES}
        # vectors of another model than the one asked with are not compared
        made = t["vectors"] if more.get("embedder") is None else t["vectors"].where(F.col("model") == more["embedder"].name)
        vectors = made.select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))
        return cls(t["docs"], t["chunks"], t["links"].withColumnRenamed("doc_id", "src_id"), vectors, t["doc_images"], t["postings"], t["lengths"], **more)

    def _found(self) -> DataFrame:
        return self.docs if self.doc_images is None else without_embedded_images(self.docs, self.doc_images)

    def search(self, question: str, filters: Filters = Filters(), limit: int = 20, per_doc: int = 0, mode: str = "hybrid") -> DataFrame:
        """The best passages, numbered from 1: path, title, heading, anchor, text, images, snippet, match, similarity,
        rerank and score. mode is hybrid, keyword or semantic; limit is kept between 1 and 100."""
        limit, fetch = max(1, min(100, limit)), max(4 * limit, 40)
        docs, terms = self._found().where(filters.predicate()), K.split_terms(K.parse(question), self.stemming)
        kw = K.keyword_search(self.chunks, docs, question, None, fetch, self.stemming, self.postings, self.lengths)
        if mode == "semantic":
            kw = kw.limit(0)
        sem = kw.limit(0).select("*", F.lit(0.0).alias("similarity"), F.lit("").alias("snippet"))
        if mode != "keyword" and self.embedder is not None and self.vectors is not None and question.strip():
            try:
                q = index.embed_query(self.embedder, question)
            except Exception:  # noqa: BLE001 - a model that fails leaves keyword search
                q = None
            sem = sem if q is None else H.semantic_search(self.vectors, self.chunks, docs, q, None, fetch, self.embedder.min_similarity)
        kw, sem = checkpoint(kw), checkpoint(sem)  # at most 400 rows each, used several times
        fused = H.fuse(kw, sem)
        text = self.chunks.join(self.docs.select("doc_id", "path", "title", "ext"), "doc_id")
        if mode != "keyword" and self.reranker is not None and question.strip():
            fused = H.rerank(fused, kw, sem, text.select("chunk_id", "title", "heading", "text"), question, self.reranker)
        else:
            fused = fused.withColumn("rerank", F.lit(None).cast("double")).withColumn("final", F.col("fused"))
        hits = fused.join(text, "chunk_id").join(sem.select("chunk_id", "similarity"), "chunk_id", "left")
        page = H.cap_per_document(hits, per_doc, limit).withColumn("score", F.round(F.col("rrf") * 1000, 2))
        return K.snippets(page.select("n", "chunk_id", "path", "title", "ext", "heading", "anchor", "text", "images", "match", "similarity", "rerank", "score"), terms, self.stemming)

    def ask(self, question: str, filters: Filters = Filters(), mode: str = "summary", top: int = 12) -> DataFrame:
        """(n, passage): the passages that answer a question best, at most four of a document."""
        return H.answer(self.search(question, filters, max(1, min(50, top)), 4), mode)

    def tags(self) -> DataFrame:
        return S.tag_counts(self.docs)

    def tree(self) -> DataFrame:
        return S.tree(self.docs)

    def find_file(self, query: str, recents: DataFrame | None = None) -> DataFrame:
        return S.switch_to(self.docs, query, recents)

    def status(self) -> DataFrame:
        vectors = self.chunks.limit(0).select("chunk_id") if self.vectors is None else self.vectors
        return S.totals(self.docs, self.chunks, vectors)

    def doc(self, path: str) -> DataFrame:
        return self.docs.where(F.col("path") == path).select("path", "title", "ext", "tags", "error")

    def outgoing(self, path: str) -> DataFrame:
        return G.outgoing(self.links, self.docs, path)

    def backlinks(self, path: str) -> DataFrame:
        return G.backlinks(self.links, self.docs, path)

    def orphans(self) -> DataFrame:
        return G.unlinked(self.links, self.docs)

    def _least(self) -> float:
        return self.embedder.min_similarity + 0.15 if self.embedder else 1.0

    def similar(self, path: str, k: int = 6) -> DataFrame:
        """(path, title, ext, similarity) of the notes most similar to one; an unknown path gives none."""
        v = G.doc_vectors(self.chunks, self.vectors, self.docs)
        one = self.docs.where(F.col("path") == path).select("doc_id").limit(1).collect()
        near = G.similar_to(v, one[0][0] if one else -1, k, self._least())
        return near.join(self.docs, "doc_id").select("path", "title", "ext", F.round("sim", 3).alias("similarity")).orderBy(F.desc("similarity"), "path")

    def graph(self, similar: bool = True, k: int = 3) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the notes."""
        near = G.neighbours(G.doc_vectors(self.chunks, self.vectors, self.docs), k, self._least())
        nodes = self.docs.where("kind = 'note'").select(F.col("path").alias("id"), "title", "ext", "folder")
        return nodes, G.graph_edges(self.links, self.docs, near if similar else near.limit(0))
