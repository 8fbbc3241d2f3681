"""A count-min sketch of 64-bit hashes, merged over the partitions, that tells about how often each hash stands.

Each task counts its hashes by cell and sends the occupied cells of a stretch of the sketch as one row; stretches are
merged by adding. The merged sketch has four bits for each cell: 0 where it was met once at most, c where it was met fewer
than 4**c times. It only overestimates, so what it calls single is single. Its size is fixed by the width, whatever the
data; a full sketch tells less, and nothing untrue.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Cells of a stretch, cells of a part of a stretch (so that a place in it has 16 bits), and hashes a task holds at most.
STRETCH, PART, HELD = 1 << 20, 1 << 16, 1 << 22


def cells(h: np.ndarray, width: int) -> np.ndarray:
    """The cell of each hash."""
    with np.errstate(over="ignore"):
        m = (h ^ (h >> np.uint64(31))) * MIX
    return ((m ^ (m >> np.uint64(32))) & np.uint64(width - 1)).astype(np.int64)


def _log(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1] - 1


def _counted(hashes: Callable[[pd.DataFrame], np.ndarray], width: int):
    def rows(h: np.ndarray) -> pd.DataFrame:
        cell = np.sort(cells(h, width))
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        cell, power = cell[at], _log(np.diff(at, append=len(cell))).astype(np.uint8)
        block = cell // STRETCH
        cut = np.flatnonzero(np.diff(block)) + 1
        return pd.DataFrame({
            "block": block[np.concatenate([[0], cut])],
            "spots": [s.tobytes() for s in np.split((cell % PART).astype(np.uint16), cut)],
            "sizes": [np.bincount(p, minlength=STRETCH // PART).astype(np.int32).tobytes() for p in np.split((cell % STRETCH) // PART, cut)],
            "powers": [p.tobytes() for p in np.split(power, cut)],
        })

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in frames:
            held.append(hashes(f))
            n += len(held[-1])
            if n >= HELD:
                yield rows(np.concatenate(held))
                held, n = [], 0
        if n:
            yield rows(np.concatenate(held))

    return run


def _merged(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(STRETCH, np.int64)
    for spots, sizes, powers in zip(f["spots"], f["sizes"], f["powers"]):
        at = np.frombuffer(spots, np.uint16) + np.repeat(np.arange(STRETCH // PART) * PART, np.frombuffer(sizes, np.int32))
        total[at] += (2 << np.frombuffer(powers, np.uint8).astype(np.int64)) - 1  # the most that a count of that power can be
    level = np.where(total < 2, 0, np.minimum(15, 1 + _log(np.maximum(total, 1)) // 2)).astype(np.uint8)
    return pd.DataFrame({"block": [key[0]], "levels": [zlib.compress((level[::2] << 4 | level[1::2]).tobytes(), 1)]})


def counted(df: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], width: int) -> np.ndarray:
    """The merged sketch, width / 2 bytes. hashes gives the hashes (uint64) of a frame of df; width is a power of two.

    At most width / 2 bytes come to the driver, packed, stretch by stretch, whatever the size of df."""
    out = np.zeros((max(1, width // STRETCH), STRETCH // 2), np.uint8)
    part = df.mapInPandas(_counted(hashes, width), "block bigint, spots binary, sizes binary, powers binary")
    for r in part.groupBy("block").applyInPandas(_merged, "block bigint, levels binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return out.ravel()


def levels(h: np.ndarray, sketch: np.ndarray, width: int) -> np.ndarray:
    """For each hash a c so that it stands fewer than 4**c times; 0: once."""
    c = cells(h, width)
    return (sketch[c >> 1] >> np.where(c & 1, 0, 4).astype(np.uint8)) & np.uint8(15)
