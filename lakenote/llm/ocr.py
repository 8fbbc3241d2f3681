"""Repair of text from scanned pages (problem 4).

Running headers and page numbers are found by their place on the page: lines at either end whose folded form stands on
several pages of a document, and numbers that run with the pages. A character editor, an averaged perceptron trained here
on a bounded sample of the corpus's own misread words, proposes keep, replace, delete and insert operations for each word
that is not known; a word is read once, however often it stands in the corpus, and its pages get the reading by a join. A
second perceptron decides how lines broken inside a word are joined: it is trained on breaks whose word, whole or with a
hyphen, stands unbroken elsewhere in the corpus. What both propose is checked against the known words; the rest of the text
stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakenote.operators.skew import hot_keys, merge_join, split_join
from lakenote.tables import checkpoint

#: Word types and line breaks the editors are trained on at most, rounds of training, and candidates of a word.
SAMPLE, ROUNDS, BEAM = 6000, 4, 16
#: Pages on which a header stands at least, lines at either end, and the length of a wide line; a document of which more than
#: this share of the lines is wide was not scanned.
PAGES, EDGE, WIDE, WIDE_SHARE = 3, 2, 110, 0.25
#: The score by which a reading may fall short of the word as it stands, for each character that the word has beyond SHORT.
ODDS, SHORT = 5.0, 6
#: Most known words that are sent to every task; more are refused, not dropped.
MAX_WORDS = 2_000_000
BREAKS = "-¬­‐"
LINE = re.compile(r"\r\n|\n|\r")
STRIP = ".,;:!?()[]{}\"'«»“”„…"
SKIP = re.compile(r"[/\\=<>_@#*`]|^v?\d[\d.,:%-]*$|^\W*$")
# Words beside a page number in the languages of the corpus.
PAGE_WORDS = ("page", "p", "pp", "pg", "seite", "s", "página", "pagina", "pág", "pag", "blatt", "hoja", "folio")
OF_WORDS = ("of", "von", "de", "sur")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
# Shapes that scanners take for each other, written as one sequence of strokes for comparing lines.
STROKES = str.maketrans({
    "m": "rrl", "n": "rl", "d": "el", "h": "ll", "w": "vv", "u": "ll", "c": "e", "1": "l", "|": "l", "i": "l",
    "0": "o", "6": "o", "b": "o", "8": "o", "5": "s", "+": "t", "q": "g", "9": "g",
})


def fold_word(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c)).translate(STROKES)


_PAGE, _OF = {fold_word(w) for w in PAGE_WORDS}, {fold_word(w) for w in OF_WORDS}


def number(w: str) -> int | None:
    """The value of a page number in digits, also with misread ones, or in small Roman numerals."""
    w = w.lower()
    if any(c.isdigit() for c in w):
        w = w.translate(str.maketrans("l|iosb", "111056"))
        return int(w) if w.isdecimal() and len(w) < 7 else None
    if w and all(c in ROMAN for c in w) and len(w) < 8:
        v = [ROMAN[c] for c in w]
        return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))
    return None


def page_number(line: str) -> int | None:
    """The page number of a line that gives nothing else, or None."""
    toks = re.findall(r"[^\W_]+(?:[|+][^\W_]*)*|[|+][^\W_]+", line)
    if len(toks) > 1 and fold_word(toks[0]) in _PAGE:
        toks = toks[1:]
    if len(toks) == 3 and fold_word(toks[1]) in _OF or len(toks) == 2 and "/" in line:
        toks = toks[:1] if number(toks[-1]) is not None else toks
    return number(toks[0]) if len(toks) == 1 else None


def line_key(line: str) -> str:
    """A line's form without digits and with confusable shapes made equal; empty if it has no words."""
    toks = line.split()
    out = []
    for i, t in enumerate(toks):
        core = t.strip(STRIP + "-–—|")
        edge = i in (0, len(toks) - 1)
        out.append("#" if not any(c.isalpha() for c in core) or edge and len(core) < 7 and core.islower() and number(core) is not None else fold_word(core))
    return " ".join(x for x in out if x not in ("", "#"))


class Perceptron:
    """An averaged perceptron over string features and labels."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = defaultdict(dict)

    def scores(self, feats: list[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for f in feats:
            for label, v in self.w.get(f, {}).items():
                out[label] = out.get(label, 0.0) + v
        return out

    def train(self, rows: list[tuple[list[str], str]], rounds: int = ROUNDS) -> Perceptron:
        total: dict[str, dict[str, float]] = defaultdict(dict)
        t = 0
        for _ in range(rounds):
            for feats, gold in rows:
                t += 1
                s = self.scores(feats)
                best = max(s.items(), key=lambda x: (x[1], x[0]))[0] if s else ""
                if best == gold and s[gold] > 0:
                    continue
                for f in feats:
                    for label, step in ((gold, 1.0), (best, -1.0)):
                        if label and not (label == best == gold and step < 0):
                            self.w[f][label] = self.w[f].get(label, 0.0) + step
                            total[f][label] = total[f].get(label, 0.0) + step * t
        for f, by in self.w.items():
            for label in by:
                by[label] -= total[f].get(label, 0.0) / (t + 1)
        self.w = {f: {a: round(v, 4) for a, v in by.items() if abs(v) > 1e-4} for f, by in self.w.items()}
        return self


#: Labels of the operations that keep and delete a character; any other label is written in its place.
KEEP, DROP = "=", "~"


def char_features(s: str, i: int, seen: frozenset[str]) -> list[str]:
    p = f"  {s}  "
    a, b, c, d, e = p[i], p[i + 1], p[i + 2], p[i + 3], p[i + 4]
    known = "".join("1" if p[j : j + 3] in seen else "0" for j in (i, i + 1, i + 2))
    return ["", f"c{c}", f"l{b}{c}", f"r{c}{d}", f"w{b}{c}{d}", f"L{a}{b}{c}", f"R{c}{d}{e}", f"k{known}{c}", f"K{known}{c}{d}", f"P{known}{b}{c}"]


def trigrams(known: set[str]) -> frozenset[str]:
    return frozenset(f"  {w}  "[j : j + 3] for w in known for j in range(len(w) + 2))


def single_edits(known: set[str]) -> dict[tuple[str, str], set[str]]:
    """For each way of cutting one or two letters, or none, out of a known word: the parts cut."""
    out: dict[tuple[str, str], set[str]] = defaultdict(set)
    for w in known:
        for n in (0, 1, 2):
            for i in range(len(w) - n + 1):
                out[w[:i], w[i + n :]].add(w[i : i + n])
    return out


def labelled(word: str, edits: dict[tuple[str, str], set[str]], known: set[str]) -> list[str] | None:
    """The operation at each character of a misread word, if one edit of at most two characters makes exactly one known
    word of it: `=` keeps, `~` deletes, anything else replaces, and inserts what is longer than one."""
    found: dict[str, list[str]] = {}
    for n in (1, 2):
        for i in range(len(word) - n + 1):
            for part in edits.get((word[:i], word[i + n :]), ()):
                fixed = word[:i] + part + word[i + n :]
                if fixed != word and (part[:1] != word[i] and part[-1:] != word[i + n - 1] or not part or n == 1 and len(part) == 1):
                    found.setdefault(fixed, [KEEP] * i + [part or DROP] + [DROP] * (n - 1) + [KEEP] * (len(word) - i - n))
    return next(iter(found.values())) if len(found) == 1 else None


class Editor:
    """Both trained perceptrons with the known words."""

    def __init__(self, known: set[str], chars: Perceptron, joins: Perceptron):
        self.known, self.seen, self.chars, self.joins = known, trigrams(known), chars, joins
        self.longest = max(map(len, known), default=0)

    def fix(self, word: str) -> str | None:
        """The best-scored reading of an unknown word that is a known word, or None where keeping the word scores better: names
        are words too. A long word hardly ever comes near a known one by chance, so it needs less of a score. A single character has no reading, nor
        has a word of more than twice the length of any known one."""
        if not 2 <= len(word) <= 2 * self.longest:
            return None
        beam: list[tuple[float, str]] = [(0.0, "")]
        kept = 0.0
        for i, c in enumerate(word):
            s = self.chars.scores(char_features(word, i, self.seen))
            s.setdefault(KEEP, 0.0)
            kept += s[KEEP]
            top = sorted(s.items(), key=lambda x: -x[1])[:8]
            grown: dict[str, float] = {}
            for score, text in beam:
                for label, v in top:
                    t = text + (c if label == KEEP else "" if label == DROP else label)
                    grown[t] = max(grown.get(t, -1e9), score + v)
            beam = sorted(((v, t) for t, v in grown.items()), key=lambda x: -x[0])[: 4 * BEAM]
        least = kept - ODDS * max(0, len(word) - SHORT)
        return next((t for v, t in beam if v > least and t in self.known and t != word), None)

    def join(self, left: str, right: str) -> str | None:
        """A known word broken after `left`, as it is written whole, or None where the line break stays a space."""
        s = self.joins.scores(join_features(left, right, self.known))
        for label in sorted(("join", "keep", "space"), key=lambda x: -s.get(x, 0.0)):
            if label == "space":
                return None
            whole = left + right if label == "join" else f"{left}-{right}"
            if whole in self.known:
                return whole
        return None


def join_features(left: str, right: str, known: set[str]) -> list[str]:
    a, b = left + right in known, f"{left}-{right}" in known
    c, d = left in known, right in known
    return ["", f"ab{a}{b}", f"abcd{a}{b}{c}{d}", f"a{a}{left[-2:]}", f"b{b}{left}", f"d{d}{a}{b}", f"r{a}{right[:2]}"]


def joined_label(left: str, right: str, times: dict[str, int]) -> str | None:
    """How a break is to be read by what stands unbroken in the corpus, and how often: as one word, with its hyphen, or as two
    words. None where the corpus doesn't tell."""
    one, two = times.get(left + right, 0), times.get(f"{left}-{right}", 0)
    if one or two:
        return "join" if one >= two else "keep"
    return "space" if left in times and right in times else None


def core(tok: str) -> str:
    return tok.strip(STRIP).lower()


def body(text: str, drop: set[int]) -> list[tuple[int, str]]:
    return [(n, line) for n, line in enumerate(LINE.split(text)) if n not in drop]


def broken(lines: list[tuple[int, str]]) -> Iterator[tuple[int, int, str, str]]:
    """(line, next line, left, right) of each line that ends inside a word: the parts without the break and in lower case."""
    for k, (_, line) in enumerate(lines):
        t = line.rstrip()
        if len(t) < 2 or t[-1] not in BREAKS or not (t[-2].isalnum()):
            continue
        left = core(t.split()[-1][:-1])
        j = k + 1
        while j < len(lines) and not any(c.isalpha() for c in lines[j][1]):
            j += 1  # blank lines and stray numbers inside the text
        if j < len(lines) and left:
            yield k, j, left, core(lines[j][1].split()[0])


def unknown(tok: str, known: set[str]) -> str | None:
    w = core(tok)
    if not w or w in known or SKIP.search(w) or not any(c.isalpha() for c in w) or tok.strip(STRIP) in known:
        return None
    return w


def _found(known):
    """Pages (chunk_id, text, drop) to rows (kind, a, b, n, chunk_id): `break` with the parts of a broken word, `word` with an
    unknown word of the page, and `seen` with a word that stands unbroken and how often, summed up over the frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = known.value
        for f in frames:
            rows: set[tuple[str, str, str, int | None]] = set()
            times: dict[str, int] = defaultdict(int)
            for chunk, text, drop in f[["chunk_id", "text", "drop"]].itertuples(index=False):
                lines = body(text, set() if drop is None else set(drop))
                cut = set()
                for k, j, left, right in broken(lines):
                    rows.add(("break", left, right, None))
                    cut |= {(k, -1), (j, 0)}
                for k, (_, line) in enumerate(lines):
                    toks = line.split()
                    for i, t in enumerate(toks):
                        if (k, i) in cut or (k, i - len(toks)) in cut:
                            continue
                        times[core(t)] += 1
                        if w := unknown(t, words):
                            rows.add(("word", w, "", chunk))
                            rows |= {("word", x, "", chunk) for x in w.split("-") if len(x) > 2 and x not in words and "-" in w}
            out = [(kind, a, b, 1, chunk) for kind, a, b, chunk in rows] + [("seen", w, "", n, None) for w, n in times.items() if w]
            if out:
                yield pd.DataFrame(out, columns=["kind", "a", "b", "n", "chunk_id"]).astype({"chunk_id": "Int64"})

    return run


def _cuts(least: int):
    """Words to rows (word, head, tail, at, part): each way of cutting `least` to two characters out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, w[:i], w[i + n :], w[i : i + n]) for w in f["word"] for n in range(least, 3) for i in range(len(w) - n + 1)]
            if rows:
                yield pd.DataFrame(rows, columns=["word", "head", "tail", "part"])

    return run


def near_known(sample: DataFrame, words: DataFrame) -> dict[tuple[str, str], set[str]]:
    """single_edits of the known words as far as the words of the sample can meet them: found by a join, so that no table of
    all edits is ever made on the driver. sample and words: (word)."""
    mine = sample.mapInPandas(_cuts(1), "word string, head string, tail string, part string").select("head", "tail").distinct()
    whole = words.mapInPandas(_cuts(0), "word string, head string, tail string, part string")
    out: dict[tuple[str, str], set[str]] = defaultdict(set)
    for r in merge_join(whole, mine, ["head", "tail"]).select("head", "tail", "part").distinct().toLocalIterator():
        out[r["head"], r["tail"]].add(r["part"])
    return out


def train(found: DataFrame, known: set[str], words: DataFrame, sample: int = SAMPLE) -> Editor:
    """Editors trained on at most `sample` distinct unknown words, as many line breaks and as many known words, of which every
    character is kept, each chosen by hash. found: see _found; words: (word), the known words."""
    tri = trigrams(known)
    chosen = found.where("kind = 'word'").select(F.col("a").alias("word")).distinct().orderBy(F.xxhash64("word"), "word").limit(sample)
    chosen = checkpoint(chosen)
    edits = near_known(chosen, words)
    rows = []
    for w in sorted(r["word"] for r in chosen.collect()):
        if labels := labelled(w, edits, known):
            rows += [(char_features(w, i, tri), x) for i, x in enumerate(labels)]
    for r in words.orderBy(F.xxhash64("word"), "word").limit(sample).collect():
        rows += [(char_features(r["word"], i, tri), KEEP) for i in range(len(r["word"]))]
    breaks = checkpoint(found.where("kind = 'break'").select(F.col("a").alias("l"), F.col("b").alias("r")).distinct().orderBy(F.xxhash64("l", "r"), "l", "r").limit(sample))
    forms = breaks.select(F.explode(F.array("l", "r", F.concat("l", "r"), F.concat("l", F.lit("-"), "r"))).alias("a")).distinct()
    seen = found.where("kind = 'seen'").groupBy("a").agg(F.sum("n").alias("n"))
    times = {r["a"]: r["n"] for r in merge_join(seen, forms, "a").collect()}  # four forms for each of at most `sample` breaks
    taught = [(join_features(a, b, known), label) for a, b in sorted(map(tuple, breaks.collect())) if (label := joined_label(a, b, times))]
    return Editor(known, Perceptron().train(_mixed(rows)), Perceptron().train(_mixed(taught or [([""], "space")])))


def _mixed(rows: list) -> list:
    """Rows in a fixed order without runs of one kind."""
    return [rows[i] for i in sorted(range(len(rows)), key=lambda i: (i * 2654435761) % (1 << 32))]


def repair(text: str, drop: set[int], ed: Editor, read: dict[str, str]) -> tuple[str, list[tuple[str, str]]]:
    """(text, cases): the page as paragraphs of one line each without the dropped lines, and the words that were mended.
    read has the readings of the page's unknown words."""
    lines = body(text, drop)
    cases: list[tuple[str, str]] = []
    joins = {k: (j, whole) for k, j, left, right in broken(lines) if (whole := ed.join(left, right))}
    heads = {j for j, _ in joins.values()}
    paras: list[list[str]] = [[]]
    carry = ""
    for k, (_, line) in enumerate(lines):
        toks = line.split()
        if not toks:
            if k and not carry:
                paras.append([])
            continue
        if carry and not any(c.isalpha() for c in line):
            carry = carry  # a stray line between the parts of a word stands after it
            paras[-1] += toks
            continue
        for i, t in enumerate(toks):
            if i == 0 and k in heads and carry:
                tail = t
                t = carry + tail
                carry = ""
                paras[-1].append(t)
                continue
            if i == len(toks) - 1 and k in joins:
                whole = joins[k][1]
                cases.append(("hyphen", whole))
                carry = t.rstrip()[:-1] + ("-" if "-" in whole and whole.startswith(core(t[:-1]) + "-") else "")
                continue
            w = unknown(t, ed.known)
            if w:
                fixed = read.get(w)
                if fixed is None and "-" in w:
                    parts = w.split("-")
                    mended = [x if x in ed.known or len(x) < 3 else read.get(x) for x in parts]
                    for x, y in zip(parts, mended):
                        if y and y != x:
                            cases.append(("glyph", y))
                            t = _recase(t, x, y)
                elif fixed:
                    cases.append(("glyph", fixed))
                    t = _recase(t, w, fixed)
            paras[-1].append(t)
    return "\n\n".join(" ".join(p) for p in paras if p), cases


def _recase(tok: str, old: str, new: str) -> str:
    at = tok.lower().find(old)
    if at < 0:
        return new
    seen = tok[at : at + len(old)]
    if seen.isupper() and len(seen) > 1:
        new = new.upper()
    elif seen[:1].isupper():
        new = new[:1].upper() + new[1:]
    return tok[:at] + new + tok[at + len(old) :]


def scanned_pages(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, page, text) of the pages of scanned documents: those with an anchor `page-N`, most of whose lines
    are not wide, and of which some line ends inside a word or some word holds a sign among letters."""
    page = F.regexp_extract("anchor", r"^page-(\d{1,9})$", 1)
    p = chunks.where(F.col("anchor").rlike(r"^page-\d{1,9}$") & (F.length(F.trim("text")) > 0) & F.col("chunk_id").isNotNull()).select("doc_id", "chunk_id", page.cast("int").alias("page"), "text").distinct()
    marks = F.regexp_count("text", F.lit(rf"\p{{L}}[{BREAKS}][ \t]*[\r\n]|\p{{L}}[0156|+]\p{{L}}"))
    wide, lines = F.regexp_count("text", F.lit(rf"[^\r\n]{{{WIDE + 1}}}[^\r\n]*")), F.regexp_count("text", F.lit(r"[^\r\n]*\S[^\r\n]*"))
    docs = p.groupBy("doc_id").agg(F.sum(marks).alias("marks"), F.sum(wide).alias("wide"), F.sum(lines).alias("lines"))
    docs = docs.where((F.col("marks") > 0) & (F.col("wide") <= WIDE_SHARE * F.col("lines"))).select(F.col("doc_id").alias("of"))
    return merge_join(p, docs, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for doc, chunk, page, text in f[["doc", "chunk_id", "page", "text"]].itertuples(index=False):
            full = [(n, line.strip()) for n, line in enumerate(LINE.split(text)) if line.strip()]
            for n, line in dict(full[:EDGE] + full[-EDGE:]).items():
                num = page_number(line)
                rows.append((doc, chunk, page, n, line, None if num is not None else line_key(line), num))
        yield pd.DataFrame(rows, columns=["doc", "chunk_id", "page", "line", "raw", "key", "num"]).astype({"num": "Int64"})


def furniture(pages: DataFrame) -> DataFrame:
    """(chunk_id, line, raw, kind): running headers and page numbers among the first and last lines of the pages."""
    fields = [("doc", T.StringType()), ("chunk_id", T.LongType()), ("page", T.IntegerType()), ("line", T.IntegerType()), ("raw", T.StringType()), ("key", T.StringType()), ("num", T.LongType())]
    # pages without a doc_id are one document
    named = pages.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "chunk_id", "page", "text")
    edges = checkpoint(named.mapInPandas(_edges, T.StructType([T.StructField(c, t) for c, t in fields])))
    named = edges.where("length(key) > 0")
    heads = named.groupBy("doc", "key").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= PAGES)
    counted = edges.where("num is not null").withColumn("off", F.col("num") - F.col("page"))
    runs = counted.groupBy("doc", "off").agg(F.countDistinct("page").alias("n")).where("n > 1")
    return (
        merge_join(named, heads, ["doc", "key"], "left_semi").select("chunk_id", "line", "raw", F.lit("header").alias("kind"))
        .unionByName(merge_join(counted, runs, ["doc", "off"], "left_semi").select("chunk_id", "line", "raw", F.lit("page_no").alias("kind")))
    )


def _repaired(sent, full: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ed = sent.value
        for f in frames:
            rows = []
            for chunk, text, drop, read in f[["chunk_id", "text", "drop", "read"]].itertuples(index=False):
                whole, cases = repair(text, set() if drop is None else set(drop), ed, {} if read is None else {r["word"]: r["fixed"] for r in read})
                rows += [(chunk, whole)] if full else [(chunk, k, w) for k, w in cases]
            yield pd.DataFrame(rows, columns=["chunk_id", "text"] if full else ["chunk_id", "kind", "fixed"])

    return run


def _readings(sent):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame({"word": f["word"], "fixed": [sent.value.fix(w) for w in f["word"]]})
            if out["fixed"].notna().any():
                yield out[out["fixed"].notna()]

    return run


def _prepared(chunks: DataFrame, words: DataFrame):
    """(pages with their lines to drop and the readings of their unknown words, furniture, the editors)."""
    sc = chunks.sparkSession.sparkContext
    pages = checkpoint(scanned_pages(chunks))
    words = words.where("word is not null").select(F.lower("word").alias("word")).distinct()
    given = words.limit(MAX_WORDS + 1).collect()
    if len(given) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} known words; raise ocr.MAX_WORDS if the tasks have memory for them")
    known = {r[0] for r in given}
    lines = checkpoint(furniture(pages))
    drops = lines.groupBy("chunk_id").agg(F.collect_set("line").alias("drop"))
    pages = checkpoint(merge_join(pages, drops, "chunk_id", "left"))
    found = checkpoint(pages.mapInPandas(_found(sc.broadcast(known)), "kind string, a string, b string, n bigint, chunk_id bigint"))
    sent = sc.broadcast(train(found, known, words))
    odd = found.where("kind = 'word'").select(F.col("a").alias("word"), "chunk_id").distinct()
    times = odd.groupBy("word").agg(F.count("*").alias("n"))
    # few bytes, but much work: a given number of tasks, which is not made smaller for its size
    readings = times.select("word").repartition(4 * sc.defaultParallelism, "word").mapInPandas(_readings(sent), "word string, fixed string")
    by_page = split_join(odd, readings, ["word"], hot_keys(times, ["word"])).groupBy("chunk_id").agg(F.collect_list(F.struct("word", "fixed")).alias("read"))
    return merge_join(pages, by_page, "chunk_id", "left"), lines, sent


def repaired_pages(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, text) of every scanned page in readable paragraphs.

    Pages that are null, empty or not scanned give no row; repeated rows count once; null doc_ids are one document; extra
    columns are ignored; without known words only headers and page numbers go.
    """
    pages, _, sent = _prepared(chunks, words)
    return pages.mapInPandas(_repaired(sent, True), T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("text", T.StringType())]))


def repairs(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, kind, fixed): the words mended (hyphen, glyph) and the lines removed (header, page_no) of every page."""
    pages, lines, sent = _prepared(chunks, words)
    mended = pages.mapInPandas(_repaired(sent, False), T.StructType([T.StructField(c, t) for c, t in (("chunk_id", T.LongType()), ("kind", T.StringType()), ("fixed", T.StringType()))]))
    return mended.unionByName(lines.select("chunk_id", "kind", F.col("raw").alias("fixed"))).distinct()
