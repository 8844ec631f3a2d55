"""A book from its markup to the rows of a package: notes, chapters, contents, links, manifest.

Everything is read off two tables of all books, elements and pieces of markup, which are written once: positions order whatever
a book has, and what belongs to a section, note or chapter is found by position or parent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookengine.functions import text as tx
from bookengine.operators import elements as el
from bookengine.operators import notes as nt
from bookengine.operators import structure as st
from bookengine.operators import tokens as tok
from bookengine.operators.blocks import BLOCK, block_size, row_numbers, running_sums
from bookengine.sources import sinks

#: Names of bodies that hold notes.
NOTES_BODIES = ("notes", "comments")
TITLE_INFO = "/FictionBook/description/title-info"


@dataclass(frozen=True)
class Books:
    """Pieces of markup and elements of all books, by ``key``."""

    key: str
    pieces: DataFrame
    elements: DataFrame
    #: Of the blocks that windows work on; None if no book is over one block.
    size: int | None

    def find(self, path: str, within: DataFrame | None = None) -> DataFrame:
        # tags are in lower case
        return el.select_path(self.elements, self.key, path.replace("FictionBook", "fictionbook"), within, self.size, self.texts_behind())

    def texts_behind(self) -> DataFrame:
        return tok.piece_texts_behind(self.pieces, self.key)


def parse_books(files: DataFrame, key: str, text: str = "text", block: int = BLOCK) -> Books:
    """Pieces and elements of well-formed books, written once in the shared folder. Texts are in the pieces alone; windows run over tags."""
    pieces = sinks.staged(tok.markup_pieces(files, key, text), "pieces")
    size = block_size(pieces, "piece", block)
    size = None if size is None else size * tok.STRIDE
    tags = tok.piece_tags(pieces, key)
    nested = sinks.staged(el.with_depth(tags.withColumn("attrs", F.transform_values("attrs", lambda _, v: tok.unescape(v))), key, size=size), "tags")
    return Books(key, pieces, sinks.staged(el.element_table(nested, key, size), "elements"), size)


def _lines(text: Column, *breaks: str) -> Column:
    return F.concat(F.when(F.col("opens").isin(*breaks), "\n").otherwise(""), text)


#: Kinds of units that ``book_texts`` gives the texts of.
KINDS = ("title", "annotation", "note", "paragraph")


def _outermost(books: Books, found: DataFrame, spans: DataFrame) -> DataFrame:
    return el.open_count(found, spans, books.key, "start", books.size).where("around = 0").drop("around")


def note_parts(books: Books, names: tuple[str, ...] = NOTES_BODIES) -> DataFrame:
    """key, start, end, tag, note_id, body_name of what stands in notes bodies at any nesting: sections with an id, and titles, that no other of these is around."""
    key = books.key
    bodies = books.find("/FictionBook/body[@name]").where(F.element_at("attrs", "name").isin(*names))
    note_id = F.coalesce(F.try_element_at("attrs", F.lit("id")), F.lit(""))
    slim = books.elements.where("tag IN ('section', 'title')").select(key, "start", "end", "tag", note_id.alias("note_id"))
    inner = el.open_count(slim.where("tag = 'title' OR note_id <> ''"), bodies, key, "start", books.size)
    candidates = sinks.staged(inner.where("around > 0").drop("around"), "note_candidates")
    tops = _outermost(books, candidates, candidates)
    named = bodies.select(key, F.col("start").alias("_body"), F.col("end").alias("_over"), F.element_at("attrs", "name").alias("body_name"))
    # bodies of a book are few, and a top lies in one
    placed = tops.join(named, key).where("start > _body AND start < _over")
    return sinks.staged(placed.select(key, "start", "end", "tag", "note_id", "body_name"), "note_parts")


def _note_children(books: Books, parts: DataFrame) -> DataFrame:
    """key, start, end, tag and the note (its start) of the elements directly in notes."""
    notes = parts.where("tag = 'section'").select(F.col(books.key).alias("_key"), F.col("start").alias("note"))
    own = books.elements.join(notes, F.col(books.key).eqNullSafe(F.col("_key")) & (F.col("parent") == F.col("note")))
    return own.select(books.key, "start", "end", "tag", "note")


def _filed(books: Books, rows: DataFrame, chapter_level: int) -> DataFrame:
    """Sections with the number of their file: a section above the level starts one."""
    return running_sums(rows, [books.key], "start", {"file_ix": F.when(F.col("level") < chapter_level, 1).otherwise(0)}, books.size)


def section_rows(books: Books) -> DataFrame:
    """Sections of each book's first body: key, start, end, section_id, level (0 directly in the body)."""
    key = books.key
    body = books.find("/FictionBook/body[1]")
    slim = books.elements.where("tag = 'section'").select(key, "start", "end", "depth", F.try_element_at("attrs", F.lit("id")).alias("section_id"))
    sections = el.open_count(slim, body, key, "start", books.size).where("around > 0").drop("around")
    top = body.select(F.col(key).alias("_key"), F.col("depth").alias("_top"))
    leveled = sections.join(top, F.col(key).eqNullSafe(F.col("_key")))
    return leveled.select(key, "start", "end", "section_id", (F.col("depth") - F.col("_top") - 1).cast("int").alias("level"))


def paragraph_rows(books: Books, chapter_level: int = 1) -> DataFrame:
    """Paragraphs of main bodies: key, start, end, file_ix, para_ix (in the file, from 1). Titles and section annotations are left out."""
    key = books.key
    body = books.find("/FictionBook/body[1]")
    aside = books.elements.where("tag IN ('title', 'annotation')")
    paragraphs = el.open_count(books.elements.where("tag IN ('p', 'v')").select(key, "start", "end"), body, key, "start", books.size).where("around > 0").drop("around")
    paragraphs = _outermost(books, paragraphs, aside)
    starts = section_rows(books).where(F.col("level") < chapter_level).select(key, (2 * F.col("start")).alias("_at"), F.lit(1).alias("_step"))
    asked = paragraphs.select(key, "start", "end", (2 * F.col("start") + 1).alias("_at"), F.lit(0).alias("_step"))
    filed = running_sums(asked.unionByName(starts, allowMissingColumns=True), [key], "_at", {"file_ix": F.col("_step")}, books.size).where("start IS NOT NULL")
    numbered = row_numbers(filed.withColumn("file_ix", F.greatest("file_ix", F.lit(1)).cast("int")), [key, "file_ix"], "start", "para_ix", books.size)
    return numbered.select(key, "start", "end", "file_ix", F.col("para_ix").cast("int").alias("para_ix"))


def book_texts(books: Books, kinds: tuple[str, ...] = KINDS, parts: DataFrame | None = None, chapter_level: int = 1) -> DataFrame:
    """key, kind, start, value, note, file_ix, para_ix: the texts of all titles, of books' own annotations, of notes' children and of main bodies' paragraphs, in one pass and written once.

    Titles and annotations are a line for each paragraph or div, without what is inside links and without white space around; children of notes
    are a line for each paragraph, blank lines dropped; paragraphs are as they stand.
    """
    key, plain = books.key, F.coalesce("unlinked", "text")
    rows = {
        "title": lambda: books.elements.where("tag = 'title'").select(key, "start", "end"),
        "annotation": lambda: books.find(f"{TITLE_INFO}/annotation").select(key, "start", "end"),
        "note": lambda: _note_children(books, note_parts(books) if parts is None else parts).where("tag <> 'title'").select(key, "start", "end", "note"),
        "paragraph": lambda: paragraph_rows(books, chapter_level),
    }
    values = {"title": _lines(plain, "p", "div"), "annotation": _lines(plain, "p", "div"), "note": _lines(F.col("text"), "p"), "paragraph": F.col("text")}
    units = books.elements.limit(0).select(key, F.lit(None).cast("string").alias("kind"), "start", "end", *(F.lit(None).cast(t).alias(n) for n, t in (("note", "long"), ("file_ix", "int"), ("para_ix", "int"))))
    for kind in kinds:
        units = units.unionByName(rows[kind]().withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    found = el.texts_of(tok.piece_texts(books.pieces, key), units, key, {k: values[k] for k in kinds}, books.size, "note", "file_ix", "para_ix")
    trimmed = F.regexp_replace("value", rf"^[{tx.WS}]+|[{tx.WS}]+\z", "")
    full = F.array_join(F.filter(F.split("value", "\n"), lambda x: x.rlike(f"[^{tx.WS}]")), "\n")
    value = F.when(F.col("kind").isin("title", "annotation"), trimmed).when(F.col("kind") == "note", full).otherwise(F.col("value"))
    return sinks.staged(found.withColumn("value", value), "texts")


def _of_kind(texts: DataFrame, kind: str, key: str) -> DataFrame:
    return texts.where(F.col("kind") == kind).select(F.col(key).alias("_owner"), F.col("start").alias("_start"), "value")


def _titled(rows: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Rows of title elements with their text as ``value``."""
    said = _of_kind(texts, "title", key)
    return rows.join(said, F.col(key).eqNullSafe(F.col("_owner")) & (F.col("start") == F.col("_start"))).drop("_owner", "_start")


def annotations(books: Books, texts: DataFrame | None = None) -> DataFrame:
    """key, annotation: the text of a book's own annotation; sections' annotations are no concern of it."""
    texts = book_texts(books, ("annotation",)) if texts is None else texts
    return texts.where("kind = 'annotation'").select(books.key, F.col("value").alias("annotation"))


def extract_notes(books: Books, parts: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes, titles) of the bodies that hold notes, at any nesting.

    A note is a section with an id that no other note and no title is around: title (of its own title elements the last),
    body (its other children, each on a line of its own). Notes have key, body_name, pos, note_id, title, body, note_number and
    body_number. Titles outside notes: key, body_name, pos, body_title, place; place 1 is the body's title, others are reported only.
    """
    key = books.key
    parts = note_parts(books) if parts is None else parts
    texts = book_texts(books, ("title", "note"), parts) if texts is None else texts
    sections = parts.where("tag = 'section'").select(key, "body_name", F.col("start").alias("pos"), "note_id")
    ranked = _titled(parts.where("tag = 'title'").select(key, "start", "body_name"), texts, key).withColumn("body_title", tx.sanitize_title(F.col("value"))).where("body_title <> ''")
    place = F.row_number().over(Window.partitionBy(key, "body_name").orderBy("pos"))
    body_titles = ranked.select(key, "body_name", F.col("start").alias("pos"), "body_title").withColumn("place", place)

    own_titles = _titled(_note_children(books, parts).where("tag = 'title'"), texts, key)
    last_title = own_titles.groupBy(key, F.col("note").alias("pos")).agg(F.max_by("value", "start").alias("title"))
    lines = texts.where("kind = 'note'").groupBy(key, F.col("note").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    # children without text count once something stands before them
    values = F.transform("parts", lambda x: x["value"])
    first = F.array_position(F.transform(values, lambda v: v != ""), True).cast("int")
    body = F.when(first > 0, F.array_join(F.slice(values, first, F.size(values)), "\n")).otherwise("")
    whole = sections.join(last_title, [key, "pos"], "left").join(lines, [key, "pos"], "left")
    notes = whole.select(key, "body_name", "pos", "note_id", tx.sanitize_title(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce(body, F.lit("")).alias("body"))
    return nt.number_notes(notes, key, "body_name", "pos", books.size), body_titles


def titled_notes(books: Books, parts: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Notes with ``body_title``: of the body's titles the first, else its name in title case."""
    notes, titles = extract_notes(books, parts, texts)
    return nt.body_titles(notes, titles.where("place = 1").select(books.key, "body_name", "body_title"), [books.key, "body_name"])


def main_sections(books: Books, texts: DataFrame | None = None) -> DataFrame:
    """``section_rows`` with title (null without one; of several the first), without brackets."""
    key = books.key
    texts = book_texts(books, ("title",)) if texts is None else texts
    titles = _titled(books.elements.where("tag = 'title'").select(key, "start", "parent"), texts, key)
    t = titles.groupBy(F.col(key).alias("_of"), F.col("parent").alias("_parent")).agg(F.min_by("value", "start").alias("title"))
    said = section_rows(books).join(t, F.col(key).eqNullSafe(F.col("_of")) & (F.col("start") == F.col("_parent")), "left")
    return said.drop("_of", "_parent").withColumn("title", tx.sanitize_title(F.col("title")))


def chapter_paragraphs(books: Books, texts: DataFrame | None = None) -> DataFrame:
    """key, pos, file_ix, fname, para_ix, text of main bodies' paragraphs."""
    texts = book_texts(books, ("paragraph",)) if texts is None else texts
    return texts.where("kind = 'paragraph'").select(books.key, F.col("start").alias("pos"), "file_ix", F.concat(F.lit("index"), F.col("file_ix").cast("string")).alias("fname"), "para_ix", F.col("value").alias("text"))


def contents(books: Books, sections: DataFrame, chapter_level: int = 1) -> DataFrame:
    """Contents of main bodies: key, toc_ix, ref, title, level, of the sections with a title."""
    key = books.key
    filed = _filed(books, sections, chapter_level)
    rows = filed.withColumns({"fname": F.concat(F.lit("index"), F.greatest("file_ix", F.lit(1)).cast("int").cast("string")), "is_main": F.lit(True), "body_name": F.lit("")})
    return st.toc_entries(rows.where("title <> ''"), key, "start")


def links(books: Books, sections: DataFrame, notes: DataFrame, chapter_level: int = 1) -> DataFrame:
    """Links of whole books: key, pos, href, resolved. Local ones lead to the file of the section or note with their id, if there is one; of an id given twice the first counts."""
    key = books.key
    href = F.map_values(F.map_filter("attrs", lambda k, _: F.lower(k).rlike("(^|:)href$")))
    found = books.elements.where("tag = 'a'").select(key, F.col("start").alias("pos"), F.try_element_at(href, F.lit(1)).alias("href")).where("href IS NOT NULL")
    filed = _filed(books, sections, chapter_level)
    of_sections = filed.where("section_id IS NOT NULL").select(key, "start", F.col("section_id").alias("anchor_id"), F.concat(F.lit("index"), F.greatest("file_ix", F.lit(1)).cast("int").cast("string")).alias("file"))
    of_notes = notes.select(key, F.col("pos").alias("start"), F.col("note_id").alias("anchor_id"), F.col("body_name").alias("file"))
    anchors = of_sections.unionByName(of_notes).groupBy(key, "anchor_id").agg(F.min_by("file", "start").alias("file"))
    local = F.when(F.startswith("href", F.lit("#")), tx.href_fragment(F.col("href")))
    joined = found.withColumn("anchor_id", local).join(anchors, [key, "anchor_id"], "left")
    return joined.select(key, "pos", "href", F.coalesce(F.concat("file", F.lit("#"), "anchor_id"), F.col("href")).alias("resolved"))


def manifest(books: Books, paragraphs: DataFrame, notes: DataFrame) -> DataFrame:
    """key, item_id, href, media_type, properties: chapter files, a file for each notes body, and the images."""
    from bookengine.operators import packaging as pk

    key, xhtml = books.key, F.lit("application/xhtml+xml")
    chapters = paragraphs.select(key, F.col("file_ix").cast("long").alias("file_ix"), "fname").distinct()
    # notes files stand behind all chapters, in the order of their bodies
    bodies = notes.groupBy(key, F.col("body_name").alias("fname")).agg(F.min("pos").alias("_pos")).select(key, (F.lit(1 << 40) + F.col("_pos")).alias("file_ix"), "fname")
    files = chapters.unionByName(bodies).select(key, "file_ix", "fname", xhtml.alias("media_type"), F.lit(True).alias("in_manifest"))
    cover = books.find(f"{TITLE_INFO}/coverpage/image").select(key, F.substring(F.try_element_at(F.map_values("attrs"), F.lit(1)), 2, 1 << 20).alias("_id")).groupBy(key).agg(F.min("_id").alias("_cover"))
    binary = books.find("/FictionBook/binary[@id]").select(key, F.col("start").alias("image_ix"), F.element_at("attrs", "id").alias("fname"), F.coalesce(F.try_element_at("attrs", F.lit("content-type")), F.lit("")).alias("media_type"))
    images = binary.join(cover, key, "left").withColumn("is_cover", F.coalesce(F.col("fname") == F.col("_cover"), F.lit(False))).drop("_cover")
    none = files.select(key, F.lit(1).alias("ix"), "fname", "media_type").where(F.lit(False))
    return pk.manifest_rows(key, files, images, none, none)
