"""A split-block Bloom filter as an ordinary DataFrame.

Each key belongs to one block of eight 64-bit words and sets one bit in each word. The filter is built with a
map-side combined bit_or and probed by a broadcast equi-join on the block number, so building and probing both stay in
generated JVM code. Its size is known before it is sent: blocks are a parameter and each takes 72 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakenote.operators.skew import hot_keys, split_join

WORDS = 8
BYTES_PER_BLOCK = 72
#: Most bytes of a filter that is broadcast; beyond it rows meet their block by a shuffle in which hot blocks are split.
MAX_BROADCAST = 64 << 20


def blocks_for(keys: int, bits_per_key: int = 12) -> int:
    """Blocks for that many keys (about 1 % false positives at 12 bits a key)."""
    return max(1, -(-keys * bits_per_key // (64 * WORDS)))


def _bits(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    h, g = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    masks = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(g, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]
    return F.pmod(h, F.lit(n_blocks)).cast("bigint"), masks


def build(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w7) over the non-null keys; an empty input gives an empty filter."""
    block, masks = _bits(F.col(key), n_blocks)
    rows = keys.where(F.col(key).isNotNull()).select(block.alias("_block"), *(m.alias(f"_w{i}") for i, m in enumerate(masks)))
    return rows.groupBy("_block").agg(*(F.expr(f"bit_or(_w{i})").alias(f"_w{i}") for i in range(WORDS)))


def probe(df: DataFrame, key: str, filt: DataFrame, n_blocks: int, out: str = "maybe") -> DataFrame:
    """Add a boolean column: false proves that the key was never added; null keys give false."""
    block, masks = _bits(F.col(key), n_blocks)
    small = n_blocks * BYTES_PER_BLOCK <= MAX_BROADCAST
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(m) != 0)
    placed = df.withColumn("_block", block)
    if small:
        joined = placed.join(F.broadcast(filt), "_block", "left")
    else:
        counts = placed.groupBy("_block").agg(F.count("*").alias("n"))
        joined = split_join(placed, filt, ["_block"], hot_keys(counts, ["_block"]), "left")
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_block", *(f"_w{i}" for i in range(WORDS)))
