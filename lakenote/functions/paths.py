"""Path spellings: one comparable form for every way a path is written in a link."""

from __future__ import annotations

import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_path(path: str | None) -> str | None:
    """Drop the fragment, decode percent signs, drop leading ./ and compose accents; case is kept."""
    if path is None:
        return None
    path = unquote(path.split("#", 1)[0])
    while path.startswith("./"):
        path = path[2:]
    return unicodedata.normalize("NFC", path)


@F.pandas_udf(T.StringType())
def plain_paths(s: pd.Series) -> pd.Series:
    """plain_path for a column; a spelling that repeats in a batch is worked out once."""
    return s.map({p: plain_path(p) for p in s.dropna().unique()}, na_action="ignore").astype(object).where(s.notna(), None)
