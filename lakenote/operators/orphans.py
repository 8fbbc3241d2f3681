"""References to records that do not exist, or did not exist yet (problem 5).

Each reference is tested against a broadcast Bloom filter of the parents' keys. A miss proves an orphan; only the
references that pass are verified by an exact join. References are distinct per key and month before anything is
shuffled, and the exact joins split the keys that are measured to be hot, so one key that holds a third of all references
is spread over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakenote.functions.paths import plain_paths
from lakenote.operators import bloom
from lakenote.operators.skew import hot_keys, split_join
from lakenote.tables import month


def parents(docs: DataFrame) -> DataFrame:
    """(side, key, first_at): every doc_id and every path in plain form with the time it was first indexed.

    Repeated rows count once. A parent whose indexed_at is null everywhere exists from the beginning (first_at null).
    """
    at = F.col("indexed_at").alias("at")
    ids = docs.where("doc_id is not null").select(F.lit("src").alias("side"), F.col("doc_id").cast("string").alias("key"), at)
    paths = docs.where("path is not null").select(F.lit("dst").alias("side"), plain_paths("path").alias("key"), at)
    return ids.unionByName(paths).groupBy("side", "key").agg(F.min("at").alias("first_at"))


def removed_keys(removed: DataFrame) -> DataFrame:
    """(side, key, gone) of the removed records, one row each."""
    ids = removed.where("doc_id is not null").select(F.lit("src").alias("side"), F.col("doc_id").cast("string").alias("key"))
    paths = removed.where("path is not null").select(F.lit("dst").alias("side"), plain_paths("path").alias("key"))
    return ids.unionByName(paths).distinct().withColumn("gone", F.lit(True))


def ends(links: DataFrame) -> DataFrame:
    """(side, key, src_id, dst_path, found_month, found_at): each end of a link that is not null."""
    base = links.select("src_id", "dst_path", "found_at", month(F.col("found_at")).alias("found_month"))
    src = base.where("src_id is not null").withColumns({"side": F.lit("src"), "key": F.col("src_id").cast("string")})
    return src.unionByName(base.where("dst_path is not null").withColumns({"side": F.lit("dst"), "key": plain_paths("dst_path")}))


def references(links: DataFrame) -> DataFrame:
    """The ends of the links, once per month with their earliest time."""
    return ends(links).groupBy("side", "key", "src_id", "dst_path", "found_month").agg(F.min("found_at").alias("found_at"))


def orphan_references(links: DataFrame, docs: DataFrame, removed: DataFrame) -> DataFrame:
    """(side, found_month, src_id, dst_path, reason) of every reference without a parent at the time it was found.

    reason is `late` where the parent was first indexed after found_at, `deleted` where only removed_docs has the key,
    else `missing`. Null ends give no row on their side and -1 or '' on the other; a null found_at is never late and has
    a null month; an empty docs table makes every reference an orphan; extra columns of any table are ignored.
    """
    owners = parents(docs)
    n_blocks = bloom.blocks_for(2 * docs.count())
    key = F.concat_ws(":", "side", "key")
    filt = bloom.build(owners.select(key.alias("k")), "k", n_blocks)
    refs = references(links)
    probed = bloom.probe(refs.withColumn("k", key), "k", filt, n_blocks).drop("k")
    on = ["side", "key"]
    hot = hot_keys(ends(links).groupBy(*on).agg(F.count("*").alias("n")), on)  # repeated rows count too: no key is split too little
    cols = ["side", "key", "src_id", "dst_path", "found_month", "found_at"]
    verified = (
        split_join(probed.where("maybe").select(*cols), owners.withColumn("known", F.lit(True)), on, hot, "left")
        .where("known is null or first_at > found_at").select(*cols, "first_at", "known")
    )
    proven = probed.where("not maybe").select(*cols, F.lit(None).cast("timestamp").alias("first_at"), F.lit(None).cast("boolean").alias("known"))
    # whether it is late is told after the union, so that both sides need the same columns and share one shuffle
    late = F.col("known") & (F.col("first_at") > F.col("found_at"))
    reason = F.when(late, "late").when(F.col("gone"), "deleted").otherwise("missing")
    return split_join(verified.unionByName(proven), removed_keys(removed), on, hot, "left").select(
        "side", "found_month", F.coalesce("src_id", F.lit(-1).cast("bigint")).alias("src_id"), F.coalesce("dst_path", F.lit("")).alias("dst_path"), reason.alias("reason"),
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(side, found_month, reason, refs, keys): orphans per referring side and month."""
    key = F.when(F.col("side") == "src", F.col("src_id").cast("string")).otherwise(F.col("dst_path"))
    return orphans.groupBy("side", "found_month", "reason").agg(F.count("*").alias("refs"), F.countDistinct(key).alias("keys"))
