"""Keyword search: an inverted index and BM25 as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakenote.functions.text import HL_END, HL_START, fold, stem_tokens, tokens
from lakenote.tables import checkpoint

#: Weights of the columns title, heading, text and tags, and the constants of BM25.
WEIGHTS = (4.0, 3.0, 1.0, 2.0)
K1, B, FLOOR = 1.2, 0.75, 1e-6

# Words a question may hold that say nothing about its subject.
STOPWORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being
    below between both but by can could did do does doing down during each few for from further had
    has have having he her here hers herself him himself his how i if in into is it its itself just
    me more most my myself no nor not now of off on once only or other our ours ourselves out over
    own same she should so some such than that the their theirs them themselves then there these
    they this those through to too under until up very was we were what when where which while who
    whom why will with would you your yours yourself yourselves tell explain describe give show
    summarize summary detailed report notes note please know find list""".split()
)


@dataclass(frozen=True)
class Term:
    """Words in a row; prefix: the (last) word may go on."""

    words: tuple[str, ...]
    prefix: bool = False


def parse(question: str) -> list[Term]:
    """Quoted phrases first, then single words without stopwords and repeats; words of four letters are prefixes.

    A question of stopwords only keeps every word; one without words gives no terms.
    """
    found = re.compile(r"\w+")
    terms = [Term(tuple(w)) for p in re.findall(r'"([^"]+)"', question) if (w := found.findall(p.lower()))]
    rest = list(dict.fromkeys(found.findall(re.sub(r'"[^"]*"', " ", question).lower())))
    kept = [w for w in rest if (len(w) > 1 or w.isdigit()) and w not in STOPWORDS]
    terms += [Term((w,), len(w) >= 4) for w in kept]
    return terms or [Term((w,)) for w in rest]


def match_text(terms: list[Term]) -> str:
    """The terms in full-text query syntax."""
    return " OR ".join('"' + " ".join(t.words) + '"' + "*" * t.prefix for t in terms)


def split_terms(terms: list[Term], stemming: bool) -> list[Term]:
    """Terms cut into the index's tokens: a word with other signs in it is a phrase."""
    cut = stem_tokens if stemming else (lambda s: re.findall(r"[^\W_]+", s.lower()))
    out = [Term(tuple(x for w in t.words for x in cut(w)), t.prefix) for t in terms]
    return [t for t in out if t.words]


def indexed(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, title, heading, text, tags): what is indexed of every chunk of a known document."""
    return chunks.select("chunk_id", "doc_id", "heading", "text").join(docs.select("doc_id", "title", F.array_join("tags", " ").alias("tags")), "doc_id")


def postings(rows: DataFrame, stemming: bool = False) -> DataFrame:
    """(term, chunk_id, col, positions): col 0..3 are title, heading, text and tags; null columns have no terms."""
    cols = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("col"), tokens(F.col(c), stemming).alias("toks")) for i, c in enumerate(("title", "heading", "text", "tags"))))
    each = rows.select("chunk_id", F.explode(cols).alias("c")).select("chunk_id", "c.col", F.posexplode("c.toks").alias("pos", "term"))
    return each.groupBy("term", "chunk_id", "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def doc_lengths(rows: DataFrame, stemming: bool = False) -> DataFrame:
    """(chunk_id, n_tokens) over all four columns, also of chunks without tokens."""
    n = sum((F.coalesce(F.greatest(F.size(tokens(F.col(c), stemming)), F.lit(0)), F.lit(0)) for c in ("title", "heading", "text", "tags")), F.lit(0))
    return rows.select("chunk_id", n.alias("n_tokens"))


def term_counts(post: DataFrame, terms: list[Term]) -> DataFrame:
    """(term_no, chunk_id, col, tf) of every term; phrases count their starts, prefixes every word they begin."""
    rows = [(n, w, i, len(t.words), t.prefix and i == len(t.words) - 1) for n, t in enumerate(terms) for i, w in enumerate(t.words)]
    near = F.col("term").isin(sorted({r[1] for r in rows if not r[4]}))
    for w in sorted({r[1] for r in rows if r[4]}):
        near = near | F.col("term").startswith(w)
    wanted = F.array(*(F.struct(F.lit(n).alias("term_no"), F.lit(w).alias("word"), F.lit(i).alias("step"), F.lit(k).alias("steps"), F.lit(p).alias("prefix")) for n, w, i, k, p in rows))
    fits = F.filter(wanted, lambda x: (F.col("term") == x["word"]) | x["prefix"] & F.col("term").startswith(x["word"]))
    hit = post.where(near).select("chunk_id", "col", "positions", F.explode(fits).alias("w")).select("chunk_id", "col", "positions", "w.term_no", "w.step", "w.steps")
    starts = hit.select("term_no", "chunk_id", "col", "steps", "step", F.explode("positions").alias("pos")).groupBy("term_no", "chunk_id", "col", "steps", (F.col("pos") - F.col("step")).alias("start")).agg(F.countDistinct("step").alias("n"))
    return starts.where("n = steps").groupBy("term_no", "chunk_id", "col").agg(F.count("*").alias("tf"))


def bm25(post: DataFrame, lengths: DataFrame, terms: list[Term]) -> DataFrame:
    """(chunk_id, score): lower is better, as full-text engines rank; only chunks that match some term."""
    spark = post.sparkSession
    if not terms:
        return spark.createDataFrame([], "chunk_id bigint, score double")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("col") + 1)
    f = term_counts(post, terms).groupBy("term_no", "chunk_id").agg(F.sum(weight * F.col("tf")).alias("f"))
    seen = f.groupBy("term_no").agg(F.count("*").alias("n"))
    total = lengths.agg(F.count("*").alias("docs"), F.avg("n_tokens").alias("avgdl"))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, FLOOR).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avgdl")))
    known = F.broadcast(seen.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one"))  # a row a term
    return f.join(known, "term_no").join(lengths, "chunk_id").groupBy("chunk_id").agg((-F.sum(part)).alias("score"))


def _snippet(text: str, terms: list[Term], stemming: bool, width: int = 32) -> str:
    """The best window of `width` tokens with the matches marked; see snippets."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    toks = [(stem_tokens(text[a:b]) or [""])[0] if stemming else text[a:b].lower() for a, b in spans]
    hits = []
    for n, t in enumerate(terms):
        for p in range(len(toks) - len(t.words) + 1):
            last = len(t.words) - 1
            if all(toks[p + i] == w or i == last and t.prefix and toks[p + i].startswith(w) for i, w in enumerate(t.words)):
                hits.append((p, p + last, n))
    hits.sort()
    n = len(toks)

    def score(start: int) -> int:
        inside, total = set(), 0
        for a, b, t in hits:
            if start <= a < start + width:
                total += 1 if t in inside else 1000
                inside.add(t)
        return total

    firsts = [k for k in range(n) if k == 0 or (gap := text[spans[k - 1][1] : spans[k][0]].rstrip()) != text[spans[k - 1][1] : spans[k][0]] and gap[-1:] in (".", ":")]
    best, at = -1, 0
    for p, _, _ in hits:
        inside = [h for h in hits if p <= h[0] < p + width]
        start = p - int((width - (inside[-1][1] + 1 - p)) / 2)
        start = max(0, min(start, n - width))
        if (s := score(p)) > best:
            best, at = s, start
        if n > width:
            begin = max((k for k in firsts if k <= p), default=0)
            if begin < p:
                s = score(begin) + (120 if begin == 0 else 100)
                if s > best:
                    best, at = s, begin
    end = min(at + width, n)
    merged: list[list[int]] = []
    for a, b, _ in hits:
        if a < at or a >= end:
            continue
        b = min(b, end - 1)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, pos = "", spans[at][0] if at and n else 0
    for a, b in merged:
        out += text[pos : spans[a][0]] + HL_START + text[spans[a][0] : spans[b][1]] + HL_END
        pos = spans[b][1]
    out += text[pos:] if end >= n else text[pos : max(pos, spans[end - 1][1])]
    return ("…" if at else "") + out + ("" if end >= n else "…")


def snippets(hits: DataFrame, terms: list[Term], stemming: bool = False) -> DataFrame:
    """Add snippet to rows with a text: 32 tokens around the best group of matches. Meant for ranked rows, not a corpus."""
    out = T.StructType([*hits.schema.fields, T.StructField("snippet", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(snippet=[None if t is None else _snippet(t, terms, stemming) for t in f["text"]])

    return hits.mapInPandas(run, out)


def asked(rows: DataFrame, terms: list[Term], stemming: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a corpus without a stored index, for one question: every text is cut into terms once, and only
    the question's words and the lengths are kept of it."""
    near = sorted({w for t in terms for i, w in enumerate(t.words) if not (t.prefix and i == len(t.words) - 1)})
    begun = sorted({t.words[-1] for t in terms if t.prefix})

    def wanted(x: Column) -> Column:
        hit = x["term"].isin(near) if near else F.lit(False)
        for w in begun:
            hit = hit | F.startswith(x["term"], F.lit(w))
        return hit

    names = ("title", "heading", "text", "tags")
    cut = rows.select("chunk_id", *(F.coalesce(tokens(F.col(c), stemming), F.array().cast("array<string>")).alias(c) for c in names))
    placed = lambda k, c: F.transform(c, lambda t, i: F.struct(t.alias("term"), F.lit(k).cast("tinyint").alias("col"), i.alias("pos")))
    found = [F.filter(placed(k, c), wanted) for k, c in enumerate(names)]
    seen = checkpoint(cut.select("chunk_id", sum((F.size(c) for c in names), F.lit(0)).alias("n_tokens"), F.concat(*found).alias("hits")))
    each = seen.select("chunk_id", F.explode("hits").alias("h")).select("chunk_id", "h.term", "h.col", "h.pos")
    post = each.groupBy("term", "chunk_id", "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return post, seen.select("chunk_id", "n_tokens")


def keyword_search(chunks: DataFrame, docs: DataFrame, question: str, where=None, limit: int = 20, stemming: bool = True, post: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(chunk_id, doc_id, path, title, ext, heading, anchor, text, images, score, rank), best first, equal scores by id.

    post and lengths: a stored index; without it the whole corpus is read for the question's words.
    """
    terms = split_terms(parse(question), stemming)
    if post is None or lengths is None:
        post, lengths = asked(indexed(chunks, docs), terms, stemming)
    scores = bm25(post, lengths, terms)
    d = docs if where is None else docs.where(where)
    hits = scores.join(chunks.select("chunk_id", "doc_id", "heading", "anchor", "text", "images"), "chunk_id").join(d.select("doc_id", "path", "title", "ext"), "doc_id")
    top = hits.orderBy("score", "chunk_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("score", "chunk_id")) - 1)  # over the top rows only


__all__ = ["Term", "asked", "bm25", "doc_lengths", "fold", "indexed", "keyword_search", "match_text", "parse", "postings", "snippets", "split_terms", "term_counts"]
