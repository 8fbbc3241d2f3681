"""Change capture and incremental upkeep of the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most characters of an image's text that join a passage.
IMAGE_TEXT = 1200


def snapshot_diff(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status) of a listing (path, mtime, size) against the known files: added, updated, unchanged or removed.

    A file is unchanged if both its time and size are equal; null times or sizes count as changed unless both are null.
    Null paths are left out and repeated rows count once.
    """
    side = lambda df, s: df.where("path is not null").select("path", F.col("mtime").alias(f"mtime_{s}"), F.col("size").alias(f"size_{s}"), F.lit(True).alias(s)).dropDuplicates(["path"])
    j = side(listing, "new").join(side(known, "old"), "path", "full_outer")
    same = F.col("mtime_new").eqNullSafe(F.col("mtime_old")) & F.col("size_new").eqNullSafe(F.col("size_old"))
    return j.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(same, "unchanged").otherwise("updated").alias("status"))


def status_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("files"))


def missing_vectors(chunks: DataFrame, docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_id, doc_id) of chunks of known documents without a vector."""
    return chunks.select("chunk_id", "doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_semi").join(vectors.where("vec is not null").select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "doc_id")


def content_key(*cols: Column) -> Column:
    """A key by content; nulls and empty strings differ, and parts don't run together."""
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(F.concat(F.lit("="), c), F.lit("!")) for c in cols)), 256)


def reused_vectors(new: DataFrame, old: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_id, vec) for new chunks (chunk_id, doc_id, title, heading, text) whose content the same document had before.

    Of several old chunks of that content the one of the largest id is taken, as the last one written.
    """
    k = content_key(F.col("title"), F.col("heading"), F.col("text")).alias("k")
    had = old.select("chunk_id", "doc_id", k).join(vectors.where("vec is not null"), "chunk_id").groupBy("doc_id", "k").agg(F.max_by("vec", "chunk_id").alias("vec"))
    return new.select("chunk_id", "doc_id", k).join(had, ["doc_id", "k"]).select("chunk_id", "vec")


def stale_docs(doc_images: DataFrame, read_now: DataFrame) -> DataFrame:
    """(doc_id) of documents that show an image (key) whose text has just been read."""
    return doc_images.join(read_now.select("key").distinct(), "key", "left_semi").select("doc_id").distinct()


def pending_images(doc_images: DataFrame, image_meta: DataFrame) -> DataFrame:
    """(key, path): images whose text is not read yet, each by its first path."""
    done = image_meta.where("ocr_done").select("key")
    return doc_images.join(done, "key", "left_anti").groupBy("key").agg(F.min("path").alias("path"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the rows of `changes` in place of those of the same key."""
    return table.join(changes.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(changes)


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with those rows whose key it doesn't have yet."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def without_docs(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table without the rows of removed documents."""
    return table.join(gone.select(key).distinct(), key, "left_anti").select(*table.columns)


def with_image_text(chunks: DataFrame, image_meta: DataFrame) -> DataFrame:
    """Chunks (chunk_id, text, images with url and alt) with the text read in their images added as paragraphs, in order.

    image_meta: (key, ocr), the key being the image's url here. Images without text add nothing.
    """
    ocr = F.substring(F.trim(F.regexp_replace("ocr", r"(?U)\s+", " ")), 1, IMAGE_TEXT)
    alt = F.when(F.length("alt") > 0, F.concat(F.lit(" '"), F.col("alt"), F.lit("'"))).otherwise("")
    each = chunks.select("chunk_id", F.posexplode("images").alias("i", "img")).select("chunk_id", "i", F.col("img.url").alias("key"), F.col("img.alt").alias("alt"))
    said = each.join(image_meta.where("length(ocr) > 0"), "key").select("chunk_id", "i", F.concat(F.lit("[image"), alt, F.lit(" text in image: "), ocr, F.lit("]")).alias("t"))
    more = said.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "t")))["t"], "\n\n").alias("more"))  # as many as a chunk's images
    return chunks.join(more, "chunk_id", "left").withColumn("text", F.trim(F.concat_ws("\n\n", "text", "more"))).drop("more")


def retry_failed(docs: DataFrame, app_version: str) -> DataFrame:
    """Documents that failed under another version of the program and are read again."""
    return docs.where(F.col("error").isNotNull() & ~F.col("app_version").eqNullSafe(F.lit(app_version)))


def same_content(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """(key, first, copies) of rows whose content stands in several keys; first is the smallest key of the content."""
    k = df.select(key, content_key(*(F.col(c) for c in cols)).alias("k")).distinct()
    g = k.groupBy("k").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return k.join(g, "k").select(key, "first", "copies")


def stamp(mtime: Column, size: Column, version: str) -> Column:
    """What a cached extract depends on: the file's time and size and the reader's version; null if one is unknown."""
    return F.concat(F.unix_micros(mtime).cast("string"), F.lit(":"), size.cast("string"), F.lit(f":{version}"))


def cached_extracts(files: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(usable, todo) of files (path, mtime, size) against extracts (path, stamp, …): those whose stamp is still right, and
    the files to read again. Null times or sizes never match."""
    f = files.withColumn("stamp", stamp(F.col("mtime"), F.col("size"), version)).where("path is not null")
    return cache.join(f.select("path", "stamp"), ["path", "stamp"], "left_semi"), f.join(cache.select("path", "stamp"), ["path", "stamp"], "left_anti")


def place_uploads(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path, fresh) of uploads (name, folder, stem, ext, content) against files (path, content): a file of the same
    folder with the same bytes is used again, another gets the next free number `stem_N`."""
    here = files.select("path", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.sha1("content").alias("key"))
    known = here.groupBy("folder", "key").agg(F.min("path").alias("old"))
    m = r"([^/]+)_(\d{1,9})\.[^./]+$"
    top = here.where(F.col("path").rlike(m)).groupBy("folder", F.lower(F.regexp_extract("path", m, 1)).alias("low")).agg(F.max(F.regexp_extract("path", m, 2).cast("int")).alias("top"))
    u = uploads.withColumn("key", F.sha1("content")).withColumn("low", F.lower("stem")).join(known, ["folder", "key"], "left").join(top, ["folder", "low"], "left")
    n = F.coalesce("top", F.lit(0)) + F.dense_rank().over(Window.partitionBy("folder", "low", F.col("old").isNull()).orderBy("key"))
    prefix = F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/")))
    return u.select("name", F.coalesce("old", F.concat(prefix, "stem", F.lit("_"), n.cast("string"), F.lower("ext"))).alias("path"), F.col("old").isNull().alias("fresh"))
