"""Search filters compiled to Columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakenote.functions.text import escape_like

# File types by group.
IMAGES = [".bmp", ".gif", ".jpeg", ".jpg", ".png", ".svg", ".webp"]
GROUPS = {
    "markdown": [".md", ".markdown"], "pdf": [".pdf"], "word": [".docx"], "powerpoint": [".pptx"], "spreadsheet": [".xlsx", ".csv"],
    "html": [".html", ".htm"], "text": [".txt", ".rst", ".org"], "image": IMAGES,
}


@dataclass(frozen=True)
class Filters:
    """types: groups or extensions; folder: recursive; path: one document; tag: also tags nested under it; days: changed
    within so many days before `now` (a timestamp literal, else the current time)."""

    types: tuple[str, ...] = field(default=())
    folder: str = ""
    path: str = ""
    tag: str = ""
    days: float = 0
    now: str | None = None

    def extensions(self) -> list[str]:
        names = [t.strip().lower() for t in self.types if t.strip()]
        return [e for t in names for e in GROUPS.get(t, [t if t.startswith(".") else "." + t])]

    def predicate(self) -> Column:
        """True for documents that pass every filter that is set; a null in a filtered column doesn't pass."""
        p = F.lit(True)
        if exts := self.extensions():
            p = p & F.col("ext").isin(exts)
        if f := self.folder.strip("/"):
            p = p & ((F.col("folder") == f) | F.col("folder").ilike(escape_like(f) + "/%"))
        if self.path:
            p = p & (F.col("path") == self.path)
        if t := self.tag.strip().lstrip("#").lower():
            p = p & F.exists("tags", lambda x: (F.lower(x) == t) | F.lower(x).startswith(t + "/"))
        if self.days > 0:
            now = F.lit(self.now).cast("timestamp") if self.now else F.current_timestamp()
            p = p & (F.col("mtime") >= F.timestamp_micros(F.unix_micros(now) - int(self.days * 86_400_000_000)))
        return F.coalesce(p, F.lit(False))


def without_embedded_images(docs: DataFrame, doc_images: DataFrame) -> DataFrame:
    """Documents but for images that some note also shows (doc_images: doc_id, key)."""
    notes = docs.where("kind = 'note'").select("doc_id")
    shown = doc_images.join(notes, "doc_id", "left_semi").select("key").distinct()
    embedded = docs.where("kind = 'image'").select("doc_id").join(doc_images, "doc_id").join(shown, "key", "left_semi").select("doc_id").distinct()
    return docs.join(embedded, "doc_id", "left_anti")
