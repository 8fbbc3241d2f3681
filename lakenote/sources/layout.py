"""Page layout as DataFrames: blocks (doc_id, page, n, y, text, kind, size, margin) to headings and Markdown.

Reading a PDF's blocks needs a library that is not part of this package; everything after that is done here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakenote.functions.text import escape_lead

#: Share of a document's pages on which a running line stands at least, within bounds; heading sizes against the body.
SHARE, LEAST, MOST = 0.05, 3, 10
RATIO, LEVELS = 1.15, 3


def norm(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def join_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by..., text) of spans (by..., x0, x1, size, text) from left to right: a visible gap is a space."""
    w = Window.partitionBy(*by).orderBy("x0", "x1")
    gap = F.col("x0") - F.lag("x1").over(w) > 0.15 * F.least("size", F.lag("size").over(w))
    sep = F.when(gap & ~F.lag("text").over(w).endswith(" ") & ~F.startswith("text", F.lit(" ")), " ").otherwise("")
    parts = spans.withColumn("part", F.concat(sep, "text")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.struct("x0", "x1", "part")))["part"], "").alias("text"))
    return parts.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))


def running_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, key) of margin lines that, but for digits, stand on enough pages of documents of three pages or more."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where("pages >= 3")
    key = F.regexp_replace(norm(F.col("text")), r"\d+", "#")
    n = blocks.where("margin").groupBy("doc_id", key.alias("key")).agg(F.countDistinct("page").alias("n"))
    need = F.greatest(F.lit(LEAST), F.least(F.col("pages") * SHARE, F.lit(MOST)))
    return n.join(pages, "doc_id").where(F.col("n") >= need).select("doc_id", "key")


def without_running_lines(blocks: DataFrame) -> DataFrame:
    """The blocks but for running headers and footers."""
    keyed = blocks.withColumn("key", F.when(F.col("margin"), F.regexp_replace(norm(F.col("text")), r"\d+", "#")))
    return keyed.join(running_lines(blocks), ["doc_id", "key"], "left_anti").drop("key").select(*blocks.columns)


def font_headings(blocks: DataFrame) -> DataFrame:
    """The blocks with level: short text clearly larger than the body, by its three largest sizes; null for other blocks.

    The body size has the most characters, on ties the smallest. If too many blocks look like headings, none is.
    """
    text = (F.col("kind") == "text") & (F.col("size") > 0)
    body = blocks.where(text).groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars")).groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))
    b = blocks.join(body, "doc_id", "left")
    cand = text & (F.col("size") >= F.col("body") * RATIO) & F.length("text").between(2, 120) & F.col("text").rlike(r"\p{L}") & ~F.rtrim("text").rlike(r"[.,;:]$")
    b = b.withColumn("cand", F.coalesce(cand, F.lit(False)))
    per = Window.partitionBy("doc_id")
    few = F.sum(F.col("cand").cast("int")).over(per) <= F.greatest(F.lit(4.0), 0.4 * F.sum((F.col("kind") == "text").cast("int")).over(per))
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "cand").orderBy(F.desc("size")))
    return b.withColumn("level", F.when(F.col("cand") & few & (rank <= LEVELS), rank)).select(*blocks.columns, "level")


def outline_headings(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """The blocks with level set from an outline (doc_id, page, ord, level, title): a block that equals a title becomes its
    heading; a title that only begins a block, or that no block has, becomes a heading of its own before it or at the top."""
    o = outline.where("length(trim(title)) > 0 and page >= 1").withColumn("level", F.least("level", F.lit(LEVELS)))
    t = blocks.where("kind = 'text'").withColumn("k", norm(F.col("text"))).select("doc_id", "page", "n", "y", "k", F.length("text").alias("len"))
    j = o.withColumn("want", norm(F.col("title"))).join(t, ["doc_id", "page"], "left")
    fits = (F.col("k") == F.col("want")) | (F.startswith("k", "want") & (F.col("len") < F.length("title") + 40))
    hit = j.groupBy("doc_id", "page", "ord", "level", "title", "want").agg(F.min(F.when(fits, F.struct("n", "y", (F.col("k") == F.col("want")).alias("same")))).alias("h"))
    exact = hit.where("h.same").groupBy("doc_id", "page", F.col("h.n").alias("n")).agg(F.min("level").alias("level"))
    known = blocks.join(exact, ["doc_id", "page", "n"], "left").select(*blocks.columns, "level")
    made = hit.where("h is null or not h.same").select(
        "doc_id", "page", F.lit(-1).alias("n"), F.coalesce(F.col("h.y") - 0.1, F.lit(-1.0)).alias("y"), F.col("title").alias("text"),
        F.lit("text").alias("kind"), F.lit(0.0).alias("size"), F.lit(False).alias("margin"), "level",
    )
    return known.unionByName(made.select(*blocks.columns, "level"))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown) of blocks with levels: section headings from `##`, `{#page-N}` anchors, and a page heading where a
    page doesn't begin with a section. Grouped by page first, so that a long document is not gathered block by block."""
    deep = blocks.where("level is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("level")).alias("levels"))
    b = blocks.join(deep, "doc_id", "left").withColumn("levels", F.coalesce("levels", F.array().cast("array<int>")))
    hashes = F.repeat(F.lit("#"), F.array_position("levels", F.col("level")).cast("int") + 1)
    line = F.when(F.col("level").isNotNull(), F.concat(hashes, F.lit(" "), F.trim("text"), F.lit(" {#page-"), F.col("page").cast("string"), F.lit("}\n"))).when(F.col("kind") == "table", F.concat("text", F.lit("\n")))
    line = line.otherwise(F.concat(escape_lead(F.trim(F.regexp_replace("text", r"(?U)\s+", " "))), F.lit("\n")))
    page = b.withColumn("line", line).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y", "n", "line", F.col("level").isNotNull().alias("head")))).alias("l"), F.first(F.size("levels")).alias("deep"))
    top = F.concat(F.repeat(F.lit("#"), F.least(F.col("deep") + 2, F.lit(6))), F.lit(" Page "), F.col("page").cast("string"), F.lit("\n"))
    text = page.withColumn("text", F.array_join(F.when(F.col("l")[0]["head"], F.col("l")["line"]).otherwise(F.concat(F.array(top), F.col("l")["line"])), "\n"))
    return text.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "text")))["text"], "\n").alias("markdown"))


def ocr_text(lines: DataFrame, by: list[str], least: float = 0.6) -> DataFrame:
    """(by..., text) of recognised lines (by..., n, text, confidence) that are sure enough, in order."""
    return lines.where(F.col("confidence") >= least).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "text")))["text"], "\n").alias("text"))
