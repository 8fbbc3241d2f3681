"""Files of a notes folder as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakenote.operators.filters import IMAGES
from lakenote.tables import checkpoint

# File types with a reader, by the kind of reader, and folders that tools keep.
KINDS = {
    ".md": "markdown", ".markdown": "markdown", ".txt": "text", ".rst": "text", ".org": "text", ".pdf": "pdf", ".docx": "docx",
    ".pptx": "pptx", ".xlsx": "xlsx", ".csv": "csv", ".html": "html", ".htm": "html",
}
SKIPPED = ("node_modules", "__pycache__", "venv")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def kind(path: Column) -> Column:
    """The kind of reader of a path, `image`, or null for other files."""
    m = F.create_map(*(F.lit(x) for e, k in {**KINDS, **dict.fromkeys(IMAGES, "image")}.items() for x in (e, k)))
    return m[extension(path)]


def hidden(path: Column) -> Column:
    """True if some part is hidden, an office lock file or a tool folder."""
    return path.rlike(r"(^|/)(\.|~\$)") | path.rlike(rf"(^|/)({'|'.join(SKIPPED)})/")


def visible(path: Column) -> Column:
    """True for files a scan takes: of a known type, no part hidden, no office lock file, not in a tool folder."""
    return ~hidden(path) & extension(path).isin([*KINDS, *IMAGES])


def _entries(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for f in frames:
            for folder in f["path"]:
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True))
                rows = [(f"{folder}/{i.base_name}" if folder else i.base_name, i.type == fs.FileType.Directory, i.mtime_ns, i.size) for i in found if i.type != fs.FileType.NotFound]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "folder", "mtime_ns", "size"]).astype({"mtime_ns": "Int64", "size": "Int64"})

    return run


def _contents(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for f in frames:
            for path in f["path"]:
                try:
                    with store.open_input_stream(f"{base}/{path}", compression=None) as file:
                        data = file.read()
                except OSError:  # gone, or not to be read: it stands in the listing without content
                    data = None
                yield pd.DataFrame({"path": [path], "content": [data]})

    return run


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of the visible files below a folder; paths are relative to it.

    Folders are listed by tasks, level by level; the driver sees no names. An empty or missing folder gives no rows. Only
    what `visible` leaves out is left out: names that begin with `_` count like any others.
    """
    level, found = spark.createDataFrame([("",)], "path string"), []
    while True:
        entries = checkpoint(level.mapInPandas(_entries(root), "path string, folder boolean, mtime_ns bigint, size bigint"))
        found.append(entries.where("not folder"))
        level = entries.where(F.col("folder") & ~hidden(F.concat("path", F.lit("/")))).select("path").repartition(spark.sparkContext.defaultParallelism, "path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.unionByName, found)
    return files.where(visible(F.col("path"))).select("path", F.timestamp_micros(F.expr("mtime_ns div 1000")).alias("mtime"), "size")


def contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of files (path) below a folder, each read by one task; null for one that can't be read."""
    return files.select("path").mapInPandas(_contents(root), "path string, content binary")
