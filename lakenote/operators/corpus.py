"""The corpus as operators see it: repeated rows counted once, each document at its latest index run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_docs(docs: DataFrame) -> DataFrame:
    """One row for each doc_id, that of the latest indexed_at (nulls first in time); null ids are left out.

    On equal times the row of the largest path, then title, is taken. Extra columns come along.
    """
    order = [F.col("indexed_at"), F.col("path"), F.col("title"), F.col("mtime")]
    rows = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), F.struct(*order)).alias("d"))
    return rows.select(*(F.col(f"d.{c}").alias(c) for c in docs.columns))


def passages(chunks: DataFrame) -> DataFrame:
    """Chunks without their repeated rows; null ids are left out."""
    return chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"])


def unit_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(chunk_id, vec) as unit vectors of doubles; null, all-zero vectors and those of another length are left out."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    v = vectors.where((F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull())).select("chunk_id", F.col("vec").cast("array<double>").alias("v")).dropDuplicates(["chunk_id"])
    return v.withColumn("n", norm).where("n > 0").select("chunk_id", F.transform("v", lambda x: x / F.greatest(F.col("n"), F.lit(1e-12))).alias("vec"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
