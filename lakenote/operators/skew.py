"""Joins of data whose size the optimizer can't know: never broadcast by a wrong estimate, hot keys split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key from which it is split, and the most keys that are: the list of split keys is broadcast, so this bounds it.
SALT_ROWS, HOT_KEYS = 65536, 4096


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorted partitions, whatever the optimizer thinks of the sizes.

    Rows out of explode or Python are underestimated, so that a plain join of them may be broadcast whole."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def hot_keys(counted: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """(on..., salts): the keys with more than SALT_ROWS rows, the HOT_KEYS largest at most, and in how many parts each is split."""
    hot = counted.where(F.col(n) > SALT_ROWS).orderBy(F.desc(n), *on).limit(HOT_KEYS)
    return hot.select(*on, F.ceil(F.col(n) / SALT_ROWS).cast("int").alias("salts"))


def split_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right, which has few rows for each key; the keys of `hot` (see hot_keys) are split.

    Rows of a hot key are dealt out to several tasks by a hash of the whole row, and right's rows of it go to each. how:
    inner, left, left_semi or left_anti. A null key meets nothing, as in any join."""
    hot, salts = F.broadcast(hot), F.coalesce("salts", F.lit(1))  # at most HOT_KEYS rows
    dealt = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("salts")
    every = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return merge_join(dealt, every, [*on, "_salt"], how).drop("_salt")


def salted_join(left: DataFrame, counted: DataFrame, on: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """split_join with `counted`, which has one row for each key and in `n` how many rows of left have it (n is dropped)."""
    return split_join(left, counted.drop(n), on, hot_keys(counted, on, n), how)
