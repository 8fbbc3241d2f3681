"""Building a corpus index from a folder, as snapshots of Parquet tables.

A build lists the folder, compares it with the last snapshot, reads only files that were added or updated, and writes the
tables docs, chunks, vectors, links and postings of the next snapshot; rows of unchanged files are taken over. A snapshot
counts once its row stands in the table `snapshots`, so readers never see half of one. Ids are hashes of paths, so that an
incremental build gives the same tables as a full one.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakenote.operators import incremental as I
from lakenote.operators import keyword as K
from lakenote.operators import notes as N
from lakenote.operators.hybrid import Embedder, embed_missing
from lakenote.sources.files import contents, extension, folder, listing, stem
from lakenote.sources.readers import read_files
from lakenote.tables import checkpoint

#: Stored with every document; files that failed under another version are read again.
APP_VERSION = "2"
TABLES = ("docs", "chunks", "vectors", "links", "doc_images", "postings", "lengths")


def identity(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 62) - 1))


def last_snapshot(spark: SparkSession, out: str) -> int:
    """The number of the last complete snapshot, 0 if there is none."""
    try:
        return spark.read.parquet(f"{out}/snapshots").agg(F.max("n")).collect()[0][0] or 0
    except Exception as e:  # noqa: BLE001 - Spark's error for a missing path
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def table(spark: SparkSession, out: str, name: str, n: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{out}/v{last_snapshot(spark, out) if n is None else n}/{name}")


def extract(files: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, notes) of files (path, mtime, size, content): docs rows, and (id, title, body, links) of readable notes."""
    read = checkpoint(read_files(files))  # used three times
    linked = N.rewrite_links(read.where("markdown is not null").select("path", F.col("markdown").alias("content")), names)
    meta = files.select("path", "mtime", "size").join(read.select("path", "kind", "title", "tags", "error"), "path")
    docs = meta.select(
        identity(F.col("path")).alias("doc_id"), "path", "title", extension(F.col("path")).alias("ext"), folder(F.col("path")).alias("folder"),
        F.when(F.col("kind") == "image", "image").otherwise("note").alias("kind"), "mtime", "size", "tags", "error", F.current_timestamp().alias("indexed_at"), F.lit(APP_VERSION).alias("app_version"),
    )
    notes = linked.join(read.select("path", "title"), "path").select(identity(F.col("path")).alias("id"), "path", "title", F.col("content").alias("body"), "links")
    return docs, notes


def build(spark: SparkSession, root: str, out: str, embedder: Embedder | None = None, full: bool = False, stemming: bool = True) -> DataFrame:
    """Write the next snapshot of the folder `root` to `out` and give (status, files): added, updated, unchanged, removed.

    Without changes no snapshot is written. With `full` every file is read again. Embeddings of passages whose title,
    heading and text are as before are taken over.
    """
    n = 0 if full else last_snapshot(spark, out)
    now = checkpoint(listing(spark, root))
    old = {t: table(spark, out, t, n) for t in TABLES} if n else {}
    # what failed under another version is not known, so it is read again
    known = old["docs"].join(I.retry_failed(old["docs"], APP_VERSION).select("path"), "path", "left_anti").select("path", "mtime", "size") if n else now.limit(0)
    diff = I.snapshot_diff(now, known).persist()
    try:
        counts = {r["status"]: r["files"] for r in I.status_counts(diff).collect()}
        stats = spark.createDataFrame([(s, counts.get(s, 0)) for s in ("added", "updated", "unchanged", "removed")], "status string, files bigint")
        if not any(counts.get(s) for s in ("added", "updated", "removed")):
            return stats
        todo = diff.where("status in ('added', 'updated')").select("path")
        gone = diff.where("status <> 'unchanged'").select(identity(F.col("path")).alias("doc_id"))
        todo = checkpoint(now.join(todo, "path", "left_semi"))
        files = contents(todo, root).join(todo, "path")
        docs, notes = extract(files, now.select("path"))
        notes = checkpoint(notes)
        to = f"{out}/v{last_snapshot(spark, out) + 1}"
        keep = lambda t: I.without_docs(old[t], gone) if n else None
        _write(docs, keep("docs"), f"{to}/docs")
        docs = spark.read.parquet(f"{to}/docs")
        chunks = N.chunk_notes(notes).select(identity(F.col("id"), F.col("ord")).alias("chunk_id"), F.col("id").alias("doc_id"), "ord", "heading", "anchor", "text", "images")
        _write(chunks, keep("chunks"), f"{to}/chunks")
        links = notes.select(F.col("id").alias("doc_id"), F.explode("links").alias("dst_path"))
        _write(links, keep("links"), f"{to}/links")
        chunks = spark.read.parquet(f"{to}/chunks")
        shown = chunks.select("doc_id", F.explode("images.url").alias("url")).where(F.startswith("url", F.lit("/api/file?path="))).select("doc_id", F.url_decode(F.substring("url", 16, 4096)).alias("key"))
        shown.unionByName(docs.where("kind = 'image'").select("doc_id", F.col("path").alias("key"))).distinct().write.mode("overwrite").parquet(f"{to}/doc_images")
        _embed(spark, chunks, docs, old, embedder, f"{to}/vectors")
        # only the passages of changed documents are cut into terms; the others' rows are taken over
        changed = chunks.join(gone, "doc_id", "left_semi")
        rows = K.indexed(changed, docs)
        stale = old["chunks"].join(gone, "doc_id", "left_semi").select("chunk_id") if n else None
        held = lambda t: I.without_docs(old[t], stale, "chunk_id") if n else None
        # clustered by term, so that a question reads few files
        _write(K.postings(rows, stemming), held("postings"), f"{to}/postings", ["term", "chunk_id"])
        _write(K.doc_lengths(rows, stemming), held("lengths"), f"{to}/lengths")
        spark.createDataFrame([(int(posixpath.basename(to)[1:]),)], "n bigint").coalesce(1).write.mode("append").parquet(f"{out}/snapshots")
        return stats
    finally:
        diff.unpersist()


def _write(new: DataFrame, kept: DataFrame | None, path: str, by: list[str] | None = None) -> None:
    whole = new if kept is None else kept.unionByName(new.select(*kept.columns))
    if by:
        whole = whole.repartitionByRange(by[0]).sortWithinPartitions(*by)
    whole.write.mode("overwrite").parquet(path)


def _embed(spark: SparkSession, chunks: DataFrame, docs: DataFrame, old: dict[str, DataFrame], embedder: Embedder | None, path: str) -> None:
    """Write (chunk_id, vec, model). Vectors of another model are never taken over: their numbers mean something else."""
    empty = spark.createDataFrame([], "chunk_id bigint, vec array<float>, model string")
    if embedder is None:
        empty.write.mode("overwrite").parquet(path)
        return
    model = F.lit(embedder.name).alias("model")
    titled = lambda c, d: c.join(d.select("doc_id", "title"), "doc_id")
    same = I.reused_vectors(titled(chunks, docs), titled(old["chunks"], old["docs"]), old["vectors"].where(F.col("model") == embedder.name)).select("chunk_id", "vec", model) if old else empty
    same.write.mode("overwrite").parquet(path)
    embed_missing(chunks, docs, spark.read.parquet(path), embedder).select("chunk_id", "vec", model).write.mode("append").parquet(path)


def embed_query(embedder: Embedder, text: str) -> list[float]:
    return [float(x) for x in embedder.embed_query(text)]


__all__ = ["TABLES", "build", "embed_query", "extract", "identity", "last_snapshot", "stem", "table"]
