"""Scalar text functions as Columns, built from Spark's own expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakenote.functions.porter import stem
from lakenote.tables import words

#: Marks around matched terms in snippets.
HL_START, HL_END = "\x02", "\x03"


def fold(s: str) -> str:
    """Lower case without diacritics; letters that have no decomposition stay."""
    s = s.lower()
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


WORD = re.compile("[^\\W_\ue000-\uf8ff]+|[\ue000-\uf8ff]+")
_stem = lru_cache(1 << 17)(stem)


def stem_tokens(text: str | None) -> list[str] | None:
    """Runs of letters or digits, folded and stemmed."""
    return None if text is None else [_stem(w) for w in WORD.findall(fold(text))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(s: pd.Series) -> pd.Series:
    return s.map(stem_tokens)


def tokens(text: Column, stemming: bool = False) -> Column:
    """Terms in order: runs of letters or digits in lower case; with stemming also without diacritics and Porter-stemmed."""
    return stemmed(text) if stemming else words(text)


def slugify(s: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(s), r"(?U)[^\w\s-]", ""))
    return F.regexp_replace(bare, r"(?U)\s+", "-")


# The forms of images in notes.
IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)\)"
IMAGE_SIZE = r"\s*\|\s*\d+(?:\s*x\s*\d+)?\s*$"
HTML_IMAGE = r"(?i)<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']+)[\"'][^>]*>"


def plain_markdown(md: Column) -> Column:
    """Images become `[image: alt]` (nothing without alt), HTML images go, links become their text."""
    s = F.regexp_replace(md, r"!\[\s*\|\s*\d+(?:\s*x\s*\d+)?\s*\]\([^)\s]+\)", "")
    s = F.regexp_replace(s, r"!\[([^\]]*?)(?:\s*\|\s*\d+(?:\s*x\s*\d+)?\s*)?\]\([^)\s]+\)", "[image: $1]")
    s = F.regexp_replace(F.regexp_replace(s, r"\[image: \]", ""), HTML_IMAGE, "")
    return F.trim(F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1"))


def image_refs(md: Column) -> Column:
    """array<struct<url, alt>> of the Markdown images with a web or application address."""
    pairs = F.arrays_zip(F.regexp_extract_all(md, F.lit(IMAGE), F.lit(2)).alias("url"), F.regexp_extract_all(md, F.lit(IMAGE), F.lit(1)).alias("alt"))
    clean = F.transform(pairs, lambda p: F.struct(p["url"].alias("url"), F.trim(F.regexp_replace(p["alt"], IMAGE_SIZE, "")).alias("alt")))
    return F.filter(clean, _shown)


def _shown(image: Column) -> Column:
    return image["url"].startswith("/api/") | image["url"].startswith("http://") | image["url"].startswith("https://")


def html_images(md: Column) -> Column:
    """array<struct<url, alt>> of the HTML images with a web or application address; without an alt it is empty."""
    found = F.regexp_extract_all(md, F.lit(HTML_IMAGE), F.lit(0))
    alt = r"(?i)\balt\s*=\s*[\"']([^\"']*)[\"']"
    return F.filter(F.transform(found, lambda i: F.struct(F.regexp_extract(i, HTML_IMAGE, 1).alias("url"), F.regexp_extract(i, alt, 1).alias("alt"))), _shown)


def word_count(s: Column) -> Column:
    t = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def excerpt(s: Column, n: int) -> Column:
    """The first n words, with an ellipsis if there are more; blank text gives an empty string."""
    w = F.split(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")), " ")
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, " …").otherwise(""))


# Fixed value: what stands in a text in place of an image.
IMAGE_MARK = r"\s*\[image(?: (?:'[^']*'|\"[^\"]*\"))?(?: text in image)?: [^\]]*\]"


def without_image_marks(s: Column) -> Column:
    return F.regexp_replace(s, IMAGE_MARK, "")


def url_path(s: Column) -> Column:
    """Percent-encode a path: letters, digits and `_.-~/` stay."""
    q = F.url_encode(s)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return q


def escape_like(s: str) -> str:
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def escape_lead(s: Column) -> Column:
    """Keep a paragraph from being read as Markdown structure."""
    return F.regexp_replace(s, r"^([#>*+-]|\d+\.)", r"\\$1")


def table_cell(s: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))


def safe_name(s: Column) -> Column:
    """A file name for an upload: the stem's odd characters become dashes, at most 80 characters, lower-case extension."""
    base = F.element_at(F.split(s, "/"), -1)
    ext = F.regexp_extract(base, r"(?<=.)(\.[^.]*)$", 1)
    bare = F.regexp_replace(F.substr(base, F.lit(1), F.length(base) - F.length(ext)), r"(?U)[^\w.-]+", "-")
    bare = F.regexp_replace(bare, r"^[-.]+|[-.]+$", "")
    return F.concat(F.substring(F.when(bare == "", "image").otherwise(bare), 1, 80), F.lower(ext))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substr(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def inline_tags(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?U)(?:^|\s)#([A-Za-z][\w/-]+)"), F.lit(1))


def citations(answer: Column) -> Column:
    """Source numbers cited as [3] or [2, 4], in order."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda n: n.cast("int"))


# Date tokens of templates and Spark's patterns for them.
DATE_TOKENS = {"YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE", "ddd": "EEE", "DD": "dd", "D": "d", "HH": "HH", "H": "H", "mm": "mm", "ss": "ss"}


def spark_date_pattern(fmt: str) -> str:
    """A template's date format as a Spark pattern; `[...]` and other letters are literal."""
    out: list[str] = []
    held = ""
    for lit, tok, other in [*re.findall(r"\[([^\]]*)\]|(YYYY|YY|MMMM|MMM|MM|M|dddd|ddd|DD|D|HH|H|mm|ss)|(.)", fmt, re.S), ("", "", "")]:
        held += lit + other
        if held and not lit + other:
            out.append("'" + held.replace("'", "''") + "'")
            held = ""
        out += [DATE_TOKENS[tok]] if tok else []
    return "".join(out)


def fill_template(text: Column, title: Column, now: Column, formats: tuple[str, ...] = ()) -> Column:
    """Replace {{title}}, {{date}}, {{time}} and {{date:FORMAT}} for the given formats."""
    quote = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    for key, fmt in [("date", None), ("time", None), *(("(?:date|time)", f) for f in formats)]:
        pattern = spark_date_pattern(fmt or ("YYYY-MM-DD" if key == "date" else "HH:mm"))
        tail = r"\s*(?::\s*)?" if fmt is None else r"\s*:\s*" + re.escape(fmt) + r"\s*"
        text = F.regexp_replace(text, F.lit(r"(?i)\{\{\s*" + key + tail + r"\}\}"), F.date_format(now, pattern))
    return F.regexp_replace(text, F.lit(r"(?i)\{\{\s*title\s*(?::[^}]*)?\}\}"), quote(title))
