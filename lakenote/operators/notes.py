"""Notes to sections, passages, links and checks. The inside of a note is read by Columns (functions.markdown), lines and
links become rows, headings and lookups are windows and joins, and a rewritten note is put together from its pieces again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakenote.functions import markdown as M
from lakenote.functions import text as X
from lakenote.operators.skew import hot_keys, merge_join, split_join
from lakenote.sources.files import KINDS, extension, folder, stem


def read_notes(notes: DataFrame) -> DataFrame:
    """(path, title, tags, body) of Markdown notes (path, content): null contents give no row."""
    n = notes.where("content is not null").select("path", M.front_matter(F.col("content")).alias("meta"), M.body(F.col("content")).alias("body"))
    return n.select("path", M.title(F.col("meta"), F.col("body"), stem(F.col("path"))).alias("title"), M.tags(F.col("meta"), F.col("body")).alias("tags"), "body")


def sections(notes: DataFrame) -> DataFrame:
    """(id, ord, heading, level, text) of the sections of notes (id, title, body): a `#` in a fence is no heading. Text before
    the first heading stands under the title and is left out if blank; other empty sections stay. Null bodies give no row."""
    own = notes.where("body is not null")
    lines = own.select("id", F.posexplode(F.split("body", r"\R")).alias("n", "line"))
    first = own.select("id", F.lit(-1).alias("n"), F.lit(None).cast("string").alias("line"), F.array(F.coalesce("title", F.lit(""))).alias("trail"))
    heads = trails(lines).select("id", "n", "trail")
    marked = merge_join(lines, heads, ["id", "n"], "left").select("id", "n", "line", "trail").unionByName(first)
    w = Window.partitionBy("id").orderBy("n")
    part = marked.withColumn("ord", F.sum(F.col("trail").isNotNull().cast("int")).over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("trail").isNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    whole = part.groupBy("id", "ord").agg(F.first("trail", ignorenulls=True).alias("trail"), M.strip(text).alias("text"))
    shown = whole.where("ord > 0 or text <> ''")
    return shown.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("ord")) - 1).alias("ord"), F.array_join("trail", " > ").alias("heading"), F.size("trail").alias("level"), "text", "trail")


def trails(lines: DataFrame) -> DataFrame:
    """(id, n, level, heading, trail) of the heading lines of (id, n, line), with windows only: a fence line toggles code, and
    a heading of level L holds until one of a smaller or the same level; trail has those that hold, from the top."""
    w = Window.partitionBy("id").orderBy("n")
    fence = F.substring(F.ltrim("line"), 1, 3).isin("```", "~~~").cast("int")
    l = lines.withColumn("fences", F.sum(fence).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = r"(?U)^(#{1,6})\s+(.+?)\s*#*\s*$"
    h = l.where((F.col("fences") % 2 == 0) & F.col("line").rlike(m) & ~F.substring(F.ltrim("line"), 1, 3).isin("```", "~~~"))
    h = h.select("id", "n", F.length(F.regexp_extract("line", m, 1)).alias("level"), F.trim(F.regexp_extract("line", m, 2)).alias("heading"))
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    at = [F.max(F.when(F.col("level") == k, F.struct("n", "heading"))).over(before).alias(f"h{k}") for k in range(1, 7)]
    h = h.select("*", *at)
    keep = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"h{j}.n"), F.lit(-1)) for j in range(1, k)]
        fresh = F.col(f"h{k}.n") > (F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1))
        keep.append(F.when((F.col("level") >= k) & fresh, F.col(f"h{k}.heading")))
    return h.select("id", "n", "level", "heading", F.filter(F.array(*keep), lambda x: x.isNotNull()).alias("trail"))


def headings(lines: DataFrame) -> DataFrame:
    """(id, n, level, heading, crumb) of the heading lines of (id, n, line)."""
    return trails(lines).select("id", "n", "level", "heading", F.array_join("trail", " > ").alias("crumb"))


def chunk_notes(notes: DataFrame) -> DataFrame:
    """(id, ord, heading, anchor, text, images) of the passages of notes (id, title, body); null bodies give no row."""
    p = sections(notes).select("id", F.col("ord").alias("part"), "trail", F.posexplode(M.packed(M.paragraphs(F.col("text")))).alias("k", "md"))
    last = F.element_at("trail", -1)
    given = F.regexp_extract(last, M.ANCHOR, 1)
    heading = F.array_join(F.transform("trail", lambda h: F.regexp_replace(h, M.ANCHOR, "")), " > ")
    place = F.row_number().over(Window.partitionBy("id").orderBy("part", "k")) - 1
    return p.select("id", place.alias("ord"), heading.alias("heading"), F.when(given != "", given).otherwise(X.slugify(last)).alias("anchor"), X.plain_markdown(F.col("md")).alias("text"), M.images(F.col("md")).alias("images"))


def name_table(files: DataFrame) -> DataFrame:
    """(key, found): `path:` keys of every file, and `name:` keys of names and stems with the shortest path that has them."""
    name = F.element_at(F.split("path", "/"), -1)
    f = files.where("path is not null").select("path").distinct()
    keys = f.select("path", F.explode(F.array_distinct(F.array(F.lower(name), F.lower(stem(F.col("path")))))).alias("k"))
    short = keys.groupBy("k").agg(F.min(F.struct(F.length("path"), F.col("path")))["path"].alias("found")).select(F.concat(F.lit("name:"), "k").alias("key"), "found")
    return f.select(F.concat(F.lit("path:"), "path").alias("key"), F.col("path").alias("found")).unionByName(short)


def note_pieces(notes: DataFrame, code: bool) -> DataFrame:
    """(path, n, piece, form, label, target, keys) of the pieces of notes (path, content) between fences and links; form is
    null for text. code: code inside lines is a piece of its own, so that no link is seen in it."""
    p = notes.where("content is not null").select("path", F.posexplode(M.pieces(F.col("content"), code)).alias("n", "piece"))
    p = p.withColumn("form", M.form(F.col("piece")))
    p = p.withColumns({"label": M.label(F.col("piece"), F.col("form")), "target": M.target(F.col("piece"), F.col("form"))})
    return p.withColumn("keys", F.when(F.col("form").isNotNull(), M.lookup_keys(F.col("form"), folder(F.col("path")), F.col("target"))))


def link_targets(notes: DataFrame) -> DataFrame:
    """(path, line, n, form, link, target, keys) of all links outside code in Markdown notes (path, content)."""
    before = F.sum(F.regexp_count("piece", F.lit("\n"))).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    p = note_pieces(notes, True).withColumn("line", (F.coalesce(before, F.lit(0)) + 1).cast("int"))
    return p.where("form is not null").select("path", "line", "n", "form", F.col("piece").alias("link"), "target", "keys")


def resolved(links: DataFrame, files: DataFrame) -> DataFrame:
    """The links (path, n, keys, ...) with `found`, the file of the first of their keys that some file has, or null. Names
    that many notes link to are split."""
    keys = links.where("keys is not null").select("path", "n", F.posexplode("keys").alias("k", "key"))
    hot = hot_keys(keys.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    hit = split_join(keys, name_table(files), ["key"], hot).groupBy("path", "n").agg(F.min_by("found", "k").alias("found"))
    return merge_join(links, hit, ["path", "n"], "left")


def is_template(path):
    return F.lower(F.split(path, "/")[0]).eqNullSafe("templates") & F.contains(path, F.lit("/"))


def broken_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, link, target) of links that lead nowhere, in Markdown notes but for templates; web links are fine."""
    l = link_targets(notes.where(~is_template(F.col("path"))))
    web = F.col("form").isin("link", "image", "html") & F.col("target").rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//|#)")
    return resolved(l, files).where(F.col("found").isNull() & ~web).select("path", "line", "link", "target")


def put_together(pieces: DataFrame) -> DataFrame:
    """(path, content) of pieces (path, n, piece)."""
    return pieces.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("content"))


def rewrite_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, content, links) of notes with their links turned into application links, and the documents they lead to.
    Links that lead to no file stay as they are, but wiki links, which become their text. Null contents give no row."""
    p = resolved(note_pieces(notes, False), files)
    to, name, alias = F.col("found"), stem(F.col("found")), F.col("label")
    doc, file = F.concat(F.lit("(#doc="), X.url_path(to), F.lit(")")), F.concat(F.lit("(/api/file?path="), X.url_path(to), F.lit(")"))
    shown = lambda c, where: F.concat(F.lit("["), c, F.lit("]"), where)
    named = F.when(alias != "", alias).otherwise(name)
    sized = F.when(alias.rlike(r"^\d+(?:x\d+)?$"), F.concat(name, F.lit("|"), alias)).otherwise(named)
    own = F.when(alias != "", alias).otherwise(F.col("target"))
    src = F.regexp_extract("piece", r"(?is)^(<img\b[^>]*?\bsrc\s*=\s*[\"'])", 1)
    new = (
        F.when(to.isNull(), F.when(F.col("form") == "wiki", own))
        .when(F.col("form") == "embed", F.when(M.is_picture(to), F.concat(F.lit("!"), shown(sized, file))).otherwise(shown(named, doc)))
        .when(F.col("form") == "wiki", shown(own, doc)).when(F.col("form") == "image", F.concat(F.lit("!"), shown(alias, file)))
        .when(F.col("form") == "link", shown(alias, F.when(extension(to).isin(*KINDS), doc).otherwise(file)))
        .when(F.col("form") == "html", F.concat(src, F.lit("/api/file?path="), X.url_path(to), F.right("piece", F.lit(1))))
    )
    whole = put_together(p.select("path", "n", F.coalesce(new, "piece").alias("piece")))
    empty = notes.where("content = ''").select("path", "content")
    to_docs = F.transform(F.regexp_extract_all("content", F.lit(r"\]\(#doc=([^)\s]+)\)"), F.lit(1)), M.unquote)
    return whole.unionByName(empty).select("path", "content", F.filter(F.array_sort(F.array_distinct(to_docs)), lambda t: t != F.col("path")).alias("links"))


def relink(notes: DataFrame, files: DataFrame, moved: DataFrame, wiki: bool = True) -> DataFrame:
    """(path, new_path, content) of the notes whose text changes when files move (moved: src, dst, one row for each file).

    Relative links are kept right after the note or the file it links to has moved; with `wiki` also wiki links that lead to
    a renamed file by its name, whose folder, heading and alias are kept. External links, links to nowhere and absolute links
    to files that stay are kept; anchors and queries stay.
    """
    own = moved.select(F.col("src").alias("path"), F.col("dst").alias("new_path"))
    p = merge_join(resolved(note_pieces(notes, False), files), own, "path", "left")
    old_base, new_base = folder(F.col("path")), folder(F.coalesce("new_path", "path"))
    written = F.regexp_extract("target", r"^([^#?]*)", 1)
    file = F.col("form").isin("image", "link", "html") & ~F.col("target").rlike(M.EXTERNAL)
    by_name = F.col("form").isin("wiki", "embed") & F.lit(wiki)
    p = p.withColumn("src", F.when(file, M.joined(old_base, F.col("target"))).when(by_name, F.col("found")))
    hot = hot_keys(p.where("src is not null").groupBy("src").agg(F.count("*").alias("n")), ["src"])
    p = split_join(p, moved.select("src", "dst"), ["src"], hot, "left")

    to, rooted = F.coalesce("dst", "src"), F.startswith("target", F.lit("/"))
    path = F.when(rooted, F.concat(F.lit("/"), to)).otherwise(M.relative(to, new_base))
    path = F.when(F.contains(written, F.lit("%")) | F.contains(path, F.lit(" ")), X.url_path(path)).otherwise(path)
    path = F.concat(path, F.substr("target", F.length(written) + 1))
    stays = F.col("src").isNull() | (F.col("dst").isNull() & (rooted | (old_base == new_base)))
    last = M.name_of(F.col("target"))
    name = F.when(F.lower(last) == F.lower(M.name_of(F.col("src"))), M.name_of(F.col("dst"))).otherwise(stem(F.col("dst")))
    called = F.concat(F.substr("target", F.lit(1), F.length("target") - F.length(last)), name)
    new = F.when(file & ~stays, path).when(by_name & F.col("dst").isNotNull(), called)
    # the target stands behind the opening bracket or quote of the link
    behind = F.regexp_extract("piece", r"(?is)^(!?\[\[|!?\[[^\]]*\]\(\s*<?|<img\b[^>]*?\bsrc\s*=\s*[\"'])", 1)
    at = F.length(behind) + F.length(F.regexp_extract(F.substr("piece", F.length(behind) + 1), r"^(\s*)", 1))
    swapped = F.concat(F.substr("piece", F.lit(1), at), new, F.substr("piece", at + F.length("target") + 1))
    p = p.select("path", "n", F.coalesce(F.when(new != F.col("target"), swapped), "piece").alias("piece"), (new != F.col("target")).alias("changed"), "new_path")
    touched = p.groupBy("path").agg(F.max(F.coalesce("changed", F.lit(False))).alias("changed"), F.first("new_path").alias("new_path")).where("changed or new_path is not null")
    bare = merge_join(notes.where("content = ''").select("path", "content"), own, "path")
    done = merge_join(put_together(p), touched, "path").select("path", F.coalesce("new_path", "path").alias("new_path"), "content")
    return done.unionByName(bare.select("path", "new_path", "content"))


def tasks(notes: DataFrame) -> DataFrame:
    """(id, task, line, checked) of the tasks of notes (id, body), numbered from 0; fences may stand in quotes and lists."""
    t = notes.where("body is not null").select("id", F.posexplode(M.tasks(F.col("body"))).alias("task", "t"))
    return t.select("id", "task", (F.col("t.line") + 1).alias("line"), F.col("t.checked").alias("checked"))


def set_tasks(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, body) of notes with one task set each (changes: id, task, checked, expected); others and misfits give no row."""
    j = merge_join(notes.select("id", "body").where("body is not null"), changes, "id").withColumn("found", M.tasks(F.col("body")))
    fits = j.where((F.size("found") == F.col("expected")) & (F.col("task") >= 0) & (F.col("task") < F.col("expected")))
    return fits.select("id", M.with_task(F.col("body"), F.get("found", F.col("task"))["line"], F.col("checked")).alias("body"))


def saves(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, status, content) of edits (path, content, base_ns, force) against notes (path, content, mtime_ns).

    409 if the note changed or went since base_ns was read and the save is not forced, 204 if nothing changes, 413 if it
    is too large, 415 if the type can't be edited, else 200; content is what stands afterwards.
    """
    e = edits.select("path", F.col("content").alias("new"), "base_ns", F.coalesce("force", F.lit(False)).alias("force"))
    j = e.join(notes.select("path", "content", "mtime_ns", F.lit(True).alias("here")), "path", "left")
    clash = ~F.col("force") & F.col("base_ns").isNotNull() & ~F.col("mtime_ns").eqNullSafe(F.col("base_ns"))
    editable = F.lower("path").rlike(r"\.(md|markdown|txt)$")
    status = F.when(~editable, 415).when(F.octet_length("new") > 5_000_000, 413).when(clash, 409).when(F.col("content").eqNullSafe(F.col("new")) & F.col("here"), 204).otherwise(200)
    return j.select("path", status.alias("status"), F.when(status == 200, F.col("new")).otherwise(F.col("content")).alias("content"))


def next_image_number(files: DataFrame) -> DataFrame:
    """(folder, stem, next) after the highest number of pasted images `stem_N.ext` in each folder."""
    m = r"([^/]+)_(\d{1,9})\.[^./]+$"
    f = files.where(F.col("path").rlike(m)).select(folder(F.col("path")).alias("folder"), F.lower(F.regexp_extract("path", m, 1)).alias("stem"), F.regexp_extract("path", m, 2).cast("int").alias("n"))
    return f.groupBy("folder", "stem").agg((F.max("n") + 1).alias("next"))


def outline(heads: DataFrame, deepest: int = 4) -> DataFrame:
    """(id, n, level, heading, anchor) of headings (id, n, level, heading) of notes that have more than one down to a level.

    The anchor is the heading's slug; the second of its kind in a note gets `-1`, the third `-2`.
    """
    from lakenote.functions.text import slugify

    h = heads.where(F.col("level") <= deepest).withColumn("slug", slugify(F.col("heading")))
    again = F.row_number().over(Window.partitionBy("id", "slug").orderBy("n")) - 1
    h = h.withColumn("again", again).withColumn("of", F.count("*").over(Window.partitionBy("id"))).where("of > 1")
    return h.select("id", "n", "level", "heading", F.concat("slug", F.when(F.col("again") > 0, F.concat(F.lit("-"), F.col("again").cast("string"))).otherwise("")).alias("anchor"))


def safe_path(path):
    """True for paths that stay inside the root, `..` taken away, and touch nothing hidden; null and empty paths are not safe."""
    plain = M.normal(path)
    return F.coalesce((F.length(F.trim(path)) > 0) & (plain != "") & ~F.startswith(path, F.lit("/")) & ~plain.rlike(r"(^|/)\.") & ~path.rlike(r"\x00"), F.lit(False))


def answer_note(passages: DataFrame, sources: DataFrame, question: str) -> DataFrame:
    """(content) of a note with the passages (n, passage) of an answer and the list of its sources (n, path, title)."""
    one = lambda df, c: df.groupBy().agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", c.alias("t"))))["t"], "\n").alias("t"))  # noqa: E731 - a page of at most 100 rows
    link = F.concat(F.lit("- ["), F.coalesce("title", "path"), F.lit("](#doc="), F.col("path"), F.lit(")"))
    text, refs = one(passages, F.col("passage")).withColumn("k", F.lit(1)), one(sources, link).select(F.col("t").alias("refs"), F.lit(1).alias("k"))
    return text.join(refs, "k").select(F.concat(F.lit(f"# {question}\n\n"), "t", F.lit("\n\n## Sources\n\n"), "refs", F.lit("\n")).alias("content"))
