"""Queries of whole books, from markup to the rows of a package.

A book is built from each document: metadata, a main body with nested sections that holds all its lines, bodies of notes
that are nested and titled in several ways, and a cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookengine.functions import text as tx
from bookengine.operators import fb2
from bookengine.plans.book_queries import _escape
from bookengine.plans.registry import query, table
from bookengine.plans.scalar_queries import SQL_FIRST
from bookengine.sources import sinks
from bookengine.sources.books import FB2_NAMESPACE

_OPENING = f'<?xml version="1.0" encoding="UTF-8"?>\n<FictionBook xmlns="{FB2_NAMESPACE}" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><genre>prose</genre><author><last-name>'
_NOTES = (
    '<body name="notes"><title><p>Notes [of]</p></title><section><title><p>Part</p></title><section id="n1"><title><p>[1]</p></title><empty-line/><p>Note &#8212; of ',
    '</p><section><title><p>t</p></title><p>inner</p></section><p>after</p></section></section><section id="n2"><title><p>first</p></title><title><p>2</p></title><p>x <a l:href="#s1">link</a></p></section></body>',
)


def _paragraphs(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit("<p>"), F.array_join(lines, "</p><p>"), F.lit("</p>"))).otherwise("")


def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of a book for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_replace(tx.first_line(F.col("text")), r"[\x00-\x1F]", " ").alias("line"), F.regexp_replace("text", r"[\x00-\x09\x0B-\x1F]", " ").alias("lines"))
    n = F.col("doc_id")
    lines = F.split(_escape("lines"), "\n", -1)
    half = F.floor((F.size(lines) + 1) / 2).cast("int")
    parts = [
        F.lit(_OPENING), F.col("source"), F.lit("</last-name></author><book-title>"), _escape("line"), F.lit("</book-title>"),
        F.when(n % 3 != 0, F.concat(F.lit('<annotation id="a1"><p>About '), "source", F.lit("</p><p>second</p></annotation>"))).otherwise(""),
        F.lit('<date value="2020-01-01">spring</date><coverpage><image l:href="#c"/></coverpage><lang>'), F.col("lang"), F.lit("</lang></title-info></description><body><title><p>"), _escape("line"),
        F.lit('</p></title><section id="s1"><title><p>One</p></title><annotation><p>Of a section</p></annotation>'), _paragraphs(F.slice(lines, 1, half)),
        F.lit('<p>See <a l:href="#n1" type="note">[1]</a> and <a l:href="#s3">there</a>.</p><section id="s2"><title><p>Two</p><p>[more]</p></title><p>Inner <emphasis>of</emphasis> it</p></section></section><section id="s3">'),
        _paragraphs(F.slice(lines, half + 1, F.size(lines))), F.lit('<p><a l:href="#gone">x</a></p></section></body>'), F.lit(_NOTES[0]), F.col("source"), F.lit(_NOTES[1]),
        F.when(n % 2 == 0, '<body name="comments"><section id="c1"><p>c</p></section></body>').otherwise(""), F.lit('<binary id="c" content-type="image/png">iVBORw0KGgo=</binary></FictionBook>'),
    ]
    return docs.select(F.concat(F.lit("lib/"), n.cast("string"), F.lit(".fb2")).alias("path"), F.concat(*parts).alias("text"))


def books(spark: SparkSession, sf_dir: str) -> fb2.Books:
    return fb2.parse_books(book_files(spark, sf_dir), "path")


BOOKS_SQL = f"""d AS (SELECT 'lib/' || doc_id || '.fb2' AS path, doc_id, source, lang, regexp_replace({SQL_FIRST}, '[\\x00-\\x1F]', ' ', 'g') AS line, string_split(regexp_replace(text, '[\\x00-\\x09\\x0B-\\x1F]', ' ', 'g'), chr(10)) AS lines FROM documents),
b AS (SELECT *, (len(lines) + 1) // 2 AS half FROM d)"""

#: Path, and its value in SQL: the texts of the elements in order.
PATHS = {
    "/FictionBook/description/title-info/lang": "[lang]",
    "/FictionBook/body[@name='notes']/section[1]/section/p": "['Note — of ' || source, 'after']",
    "//section[@id='n2']/title[-1]/p": "['2']",
    "//section[title]/section/title/p[1]": "['Two', '[1]', 't']",
    "//body[@name]/section[@id][p]/..": "CASE WHEN doc_id % 2 = 0 THEN [NULL, NULL] ELSE [NULL] END",
    "/FictionBook/body[1]//section[@id='s3']/p[-1]/a[text()='x']": "['x']",
    "//section[2]/title": "[NULL, NULL]",
    "//date[@value='2020-01-01']": "['spring']",
    "/FictionBook/*/title-info[genre='prose']/annotation/p[2]": "CASE WHEN doc_id % 3 <> 0 THEN ['second'] ELSE [] END",
}
_PATHS_SQL = " UNION ALL ".join("SELECT path, '{}' AS query, unnest({}) AS text FROM d".format(p.replace("'", "''"), v) for p, v in PATHS.items())


@query(f"WITH {BOOKS_SQL} {_PATHS_SQL}")
def s09_select_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children, descendants, parents, attributes, positions and texts on nested books."""
    found = books(spark, sf_dir)
    rows = None
    for path in PATHS:
        part = found.find(path).select("path", "start", F.lit(path).alias("query"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(found.texts_behind(), ["path", "start"], "left").select("path", "query", "text")


_NOTES_SQL = """SELECT path, 'notes' AS body_name, 'n1' AS note_id, '' AS title, 'Note — of ' || source || chr(10) || 't' || chr(10) || 'inner' || chr(10) || 'after' AS body, 1 AS note_number, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS body_number, 'Notes ' AS body_title FROM d
 UNION ALL SELECT path, 'notes', 'n2', '2', 'x link', 2, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END, 'Notes ' FROM d
 UNION ALL SELECT path, 'comments', 'c1', '', 'c', 1, 2, 'Comments' FROM d WHERE doc_id % 2 = 0"""


@query(f"WITH {BOOKS_SQL} {_NOTES_SQL}")
def m01_nested_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes at several depths, one with an inner section in its midst, with the titles of their bodies."""
    return fb2.titled_notes(books(spark, sf_dir)).select("path", "body_name", "note_id", "title", "body", "note_number", "body_number", "body_title")


@query(f"WITH {BOOKS_SQL} SELECT path, 'notes' AS body_name, 'Notes ' AS body_title, 1 AS place FROM d UNION ALL SELECT path, 'notes', 'Part', 2 FROM d")
def j06_titles_of_note_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in notes bodies: the first is the body's, the others are reported."""
    return fb2.extract_notes(books(spark, sf_dir))[1].select("path", "body_name", "body_title", "place")


@query(f"WITH {BOOKS_SQL} SELECT path, 'About ' || source || chr(10) || 'second' AS annotation FROM d WHERE doc_id % 3 <> 0")
def p08_own_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the books have none, though a section of theirs does; the others' have an attribute."""
    return fb2.annotations(books(spark, sf_dir))


_PACKAGE_SQL = f"""WITH {BOOKS_SQL}, notes AS ({_NOTES_SQL}),
p AS (SELECT path, 1 AS f, k AS n, x FROM (SELECT path, unnest(lines[1:half]) AS x, unnest(range(1, half + 1)) AS k FROM b) UNION ALL SELECT path, 1, half + 1, 'See [1] and there.' FROM b UNION ALL SELECT path, 1, half + 2, 'Inner of it' FROM b
  UNION ALL SELECT path, 2, k, x FROM (SELECT path, unnest(lines[half + 1:]) AS x, unnest(range(1, len(lines) - half + 1)) AS k FROM b) UNION ALL SELECT path, 2, len(lines) - half + 1, 'x' FROM b)
SELECT path, 'paragraph' AS kind, n::BIGINT AS ix, 'index' || f AS name, md5(x) AS value FROM p
UNION ALL SELECT path, 'note', note_number, body_name || '#' || note_id, title || '|' || body || '|' || body_title FROM notes
UNION ALL SELECT path, 'contents', ix, 'index1', t FROM d, (VALUES (1, '0:One'), (2, '1:Two' || chr(10))) v(ix, t)
UNION ALL SELECT path, 'link', 0, h, r FROM d, (VALUES ('#n1', 'notes#n1'), ('#s3', 'index2#s3'), ('#gone', '#gone'), ('#s1', 'index1#s1')) v(h, r)
UNION ALL SELECT path, 'manifest', 0, i, r FROM d, (VALUES ('file1', 'index1|application/xhtml+xml|'), ('file2', 'index2|application/xhtml+xml|'), ('file3', 'notes|application/xhtml+xml|'), ('book-cover-image', 'c|image/png|cover-image')) v(i, r)
UNION ALL SELECT path, 'manifest', 0, 'file4', 'comments|application/xhtml+xml|' FROM d WHERE doc_id % 2 = 0"""


@query(_PACKAGE_SQL)
def flagship_fb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole books from file to package: chapters written in order of books and read back, notes, contents, links, manifest."""
    found = books(spark, sf_dir)
    inside = fb2.note_parts(found)
    texts = fb2.book_texts(found, parts=inside)
    sections = sinks.staged(fb2.main_sections(found, texts), "sections")
    notes = sinks.staged(fb2.titled_notes(found, inside, texts), "notes")
    target = sinks.output_folder(spark, "chapters")
    sinks.write_library(fb2.chapter_paragraphs(found, texts), target, "path")
    paragraphs = sinks.read_chapters(spark, target, "pos long, file_ix int, fname string, para_ix int, text string, path string")
    row = lambda df, kind, ix, name, value: df.select("path", F.lit(kind).alias("kind"), ix.cast("long").alias("ix"), name.alias("name"), value.alias("value"))
    parts = [
        row(paragraphs, "paragraph", F.col("para_ix"), F.col("fname"), F.md5(F.encode("text", "UTF-8"))),
        row(notes, "note", F.col("note_number"), F.concat_ws("#", "body_name", "note_id"), F.concat("title", F.lit("|"), "body", F.lit("|"), "body_title")),
        row(fb2.contents(found, sections), "contents", F.col("toc_ix"), F.substring_index("ref", "#", 1), F.concat_ws(":", "level", "title")),
        row(fb2.links(found, sections, notes), "link", F.lit(0), F.col("href"), F.col("resolved")),
        row(fb2.manifest(found, paragraphs, notes), "manifest", F.lit(0), F.col("item_id"), F.concat_ws("|", "href", "media_type", F.coalesce("properties", F.lit("")))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
