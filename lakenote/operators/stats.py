"""Counts, roll-ups, listings and the file switcher."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: notes, images, errors, chunks, vectors."""
    d = docs.agg(F.count_if(F.col("kind") == "note").alias("notes"), F.count_if(F.col("kind") == "image").alias("images"), F.count("error").alias("errors"))
    one = F.lit(1).alias("one")
    parts = [d.select("*", one), chunks.agg(F.countDistinct("chunk_id").alias("chunks"), F.max(F.lit(1)).alias("_")).select("chunks", one), vectors.agg(F.countDistinct("chunk_id").alias("vectors")).select("vectors", one)]
    return reduce(lambda a, b: a.join(F.broadcast(b), "one"), parts).drop("one")  # three rows of one


def by_extension(docs: DataFrame) -> DataFrame:
    return docs.where("kind = 'note'").groupBy("ext").agg(F.count("*").alias("notes"))


def prefixes(parts: Column) -> Column:
    """All leading parts of a path given as an array, joined by slashes."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def tag_counts(docs: DataFrame) -> DataFrame:
    """(tag, notes): tags and their parents with the notes that have them; case counts as one tag, shown as first seen
    (by doc_id and place). Null and empty tags give nothing."""
    t = docs.where("kind = 'note'").select("doc_id", F.posexplode("tags").alias("i", "tag")).where("tag is not null")
    bare = F.regexp_replace(F.regexp_replace("tag", "^#+", ""), "^/+|/+$", "")
    each = t.select("doc_id", "i", F.posexplode(prefixes(F.split(bare, "/"))).alias("n", "name")).where("name <> ''")
    g = each.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("doc_id", "i", "n", "name")).alias("tag"), F.countDistinct("doc_id").alias("notes"))
    return g.orderBy("key").select("tag", "notes")


def folder_counts(docs: DataFrame) -> DataFrame:
    """(folder, files): files in each folder and below; '' is the whole corpus."""
    f = docs.select(F.explode(F.concat(F.array(F.lit("")), F.when(F.col("folder") == "", F.array()).otherwise(prefixes(F.split("folder", "/"))))).alias("folder"))
    return f.groupBy("folder").agg(F.count("*").alias("files"))


def tree(docs: DataFrame) -> DataFrame:
    """(path, parent, name, type, ext, depth) of all files and folders, folders first, then by name without case."""
    parts = F.split("path", "/")
    files = docs.select("path", F.lit("file").alias("type"), "ext").distinct()
    dirs = docs.where("folder <> ''").select(F.explode(prefixes(F.split("folder", "/"))).alias("path")).distinct().select("path", F.lit("dir").alias("type"), F.lit(None).cast("string").alias("ext"))
    n = F.size(parts)
    rows = files.unionByName(dirs).select("path", F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), F.element_at(parts, -1).alias("name"), "type", "ext", n.alias("depth"))
    return rows.orderBy("parent", F.col("type") != "dir", F.lower("name"), "name")


def tree_matches(files: DataFrame, query: str) -> DataFrame:
    """Files whose path holds the query, and the folders above them."""
    hit = files.where((F.col("type") == "file") & F.contains(F.lower("path"), F.lit(query.lower())))
    above = hit.where("parent <> ''").select(F.explode(prefixes(F.split("parent", "/"))).alias("path")).distinct()
    return hit.unionByName(files.where("type = 'dir'").join(above, "path", "left_semi"))


def switcher_score(path: Column, query: str) -> Column:
    """How well a path matches a query; 0 for no match. A word in the name counts 10, 6 more at its start or 4 at the start
    of a word; in the path 3; letters of a single word in order in the name 1."""
    name, full = F.lower(F.element_at(F.split(path, "/"), -1)), F.lower(path)
    ws = query.lower().split()
    scores = []
    for w in ws:
        at = F.instr(name, w)
        before = F.substr(name, at - 1, F.lit(1))
        s = F.when(at == 1, 16).when((at > 1) & before.rlike(r"[\s_\-./(]"), 14).when(at > 1, 10).when(F.contains(full, F.lit(w)), 3)
        if len(ws) == 1:
            s = s.when(name.rlike(".*?".join(_quoted(c) for c in w)), 1)
        scores.append(s)
    return F.coalesce(reduce(lambda a, b: a + b, scores), F.lit(0)) if scores else F.lit(0)


def _quoted(c: str) -> str:
    return c if c.isalnum() else "\\" + c


def switch_to(docs: DataFrame, query: str, recents: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """(path, score): the best matches, then the most recent (recents: path, recent from 0), shorter paths first."""
    s = docs.select("path").distinct().withColumn("score", switcher_score(F.col("path"), query)).where("score > 0")
    s = s.join(recents, "path", "left") if recents is not None else s.withColumn("recent", F.lit(None).cast("int"))
    return s.orderBy(F.desc("score"), F.coalesce("recent", F.lit(10**9)), F.length("path"), "path").limit(limit).select("path", "score")


def most_recent(df: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """The n keys used last, each once at its last use, newest first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(ts).alias(ts)).orderBy(F.desc(ts), key).limit(n)


def retained(versions: DataFrame, key: str, ts: str, now: Column, keep: int = 30, hours: float = 4) -> DataFrame:
    """Versions that stay: the newest `keep` of each key that are at most `hours` old at `now`."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), *[F.col(c) for c in versions.columns if c not in (key, ts)]))
    return versions.withColumn("age_rank", newest).where((F.col("age_rank") <= keep) & (F.unix_micros(F.col(ts).cast("timestamp")) >= F.unix_micros(now) - int(hours * 3_600_000_000)))


def bursts(events: DataFrame, ts: str, gap_seconds: float, by: list[str] = []) -> DataFrame:
    """(by..., burst_start, burst_end, events): runs of events with at most that gap between neighbours."""
    w = Window.partitionBy(*by).orderBy(ts)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.where(F.col(ts).isNotNull()).withColumn("t", t)
    e = e.withColumn("fresh", F.when(F.col("t") - F.lag("t").over(w) <= int(gap_seconds * 1e6), 0).otherwise(1))
    e = e.withColumn("burst", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(*by, "burst").agg(F.min(ts).alias("burst_start"), F.max(ts).alias("burst_end"), F.count("*").alias("events")).drop("burst")
