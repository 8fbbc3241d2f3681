"""Groups of equal items inside pair results.

Equal items (for p2, records of one raw text) form one class and only its representative takes part in a join. Small classes are expanded to their
members afterwards; a class of more than EXPAND members is given as pairs of its smallest member with each other member,
and takes part in links to other classes through that smallest member, so that no link between different texts is lost
and no group of copies is multiplied out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakenote.operators.skew import merge_join, salted_join
from lakenote.tables import checkpoint

EXPAND = 100


def expand(pairs: DataFrame, members: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., id_a, id_b), id_a < id_b, distinct: members of the classes in `pairs` (by..., a, b) and pairs within classes.

    members: (by..., cls, id), distinct rows, one for every id of a class; a class without rows there is its own only member.
    """
    sizes = members.groupBy(*by, "cls").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    sized = checkpoint(salted_join(members, sizes.withColumn("size", F.col("n")), [*by, "cls"]).withColumnRenamed("size", "n"))
    m, keys = sized.where("n > 1"), [*by, "cls"]
    small = m.where(F.col("n") <= EXPAND)
    within = (
        merge_join(small, small.select(*keys, F.col("id").alias("other")), keys).select(*by, F.col("id").alias("id_a"), F.col("other").alias("id_b"))
        .unionByName(m.where(F.col("n") > EXPAND).select(*by, F.col("first").alias("id_a"), F.col("id").alias("id_b")))
    )
    shown = sized.where((F.col("n") <= EXPAND) | (F.col("id") == F.col("first")))
    side = lambda s: shown.select(*by, F.col("cls").alias(s), F.col("id").alias(f"i{s}"))
    ia, ib = F.coalesce("ia", "a"), F.coalesce("ib", "b")
    across = merge_join(merge_join(pairs, side("a"), [*by, "a"], "left"), side("b"), [*by, "b"], "left").select(*by, F.least(ia, ib).alias("id_a"), F.greatest(ia, ib).alias("id_b"))
    return across.unionByName(within).where("id_a < id_b").distinct()
