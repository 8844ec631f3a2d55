"""Queries of FB2 intake and of the rows that packages are made of.

FB2 books are built inside the query from rows of documents and parsed back.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookengine.functions import metadata as meta
from bookengine.functions import text as tx
from bookengine.operators import fb2
from bookengine.operators import packaging as pk
from bookengine.operators import tokens as tok
from bookengine.plans.registry import query, table
from bookengine.plans.scalar_queries import SQL_FIRST
from bookengine.plans.structure_queries import KINDS_SQL, kinds, sections
from bookengine.sources import books as src
from bookengine.sources import sinks


def _escape(column: str) -> Column:
    return F.replace(F.replace(F.replace(F.col(column), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fb2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each document: title, two authors, all lines as paragraphs, notes body, cover, one binary; every ninth is damaged, every eleventh no book."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_replace(tx.first_line(F.col("text")), r"[\x00-\x1F]", " ").alias("line"), F.regexp_replace("text", r"[\x00-\x09\x0B-\x1F]", " ").alias("lines"))
    n = F.col("doc_id").cast("string")
    parts = [
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<FictionBook xmlns="{src.FB2_NAMESPACE}" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info>'),
        F.lit("<genre> prose </genre><genre></genre><author><first-name>Ann</first-name><last-name>"), F.col("source"), F.lit("</last-name></author><author><first-name> </first-name></author><book-title>"),
        _escape("line"), F.lit("</book-title><lang>"), F.col("lang"), F.lit("</lang><annotation><p>About "), F.col("source"), F.lit('</p><p>second</p></annotation><coverpage><image l:href="#c"/></coverpage><sequence name="S" number="'), n,
        F.lit('"/></title-info><document-info><id>id-'), n, F.lit("</id></document-info></description><body><section><p>"), F.replace(_escape("lines"), F.lit("\n"), F.lit("</p><p>")),
        F.when(F.col("doc_id") % 9 == 0, "</section>").otherwise(F.lit('</p></section></body><body name="notes"><section id="n1"><title><p>1</p></title><p>Note of '), ), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.col("source"), F.lit("</p><p>more</p></section></body>"))),
        F.lit('<binary id="c" content-type="image/png">iVBORw0KGgo=</binary></FictionBook>'),
    ]
    whole = F.when(F.col("doc_id") % 11 == 0, "plain text").otherwise(F.concat(*parts))
    return docs.select(F.concat(F.lit("lib/"), n, F.lit(".fb2")).alias("path"), F.lit(None).cast("string").alias("member"), whole.alias("text"))


GOOD = "doc_id % 11 <> 0 AND doc_id % 9 <> 0"


@query(
    f"SELECT 'lib/' || doc_id || '.fb2' AS path, trim({SQL_FIRST}) AS title, lang, 'id-' || doc_id AS id, 1::INT AS n_authors, source AS last_name, 'prose' AS genres, doc_id::INT AS seq_num, '#c' AS cover, 2::INT AS n_bodies, 1::INT AS n_binaries FROM documents WHERE {GOOD}"
)
def s07_read_fb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, _ = src.read_fb2(fb2_files(spark, sf_dir))
    info = F.col("description.title-info")
    authors = meta.authors(F.transform(info["author"], lambda a: F.struct(a["first-name"].alias("first"), a["middle-name"].alias("middle"), a["last-name"].alias("last"))))
    return books.select(
        "path",
        F.trim(info["book-title"]).alias("title"),
        info["lang"].alias("lang"),
        F.col("description.document-info.id").alias("id"),
        F.size(authors).alias("n_authors"),
        authors[0]["last"].alias("last_name"),
        F.array_join(meta.genres(info["genre"]), ",").alias("genres"),
        meta.series_number(info["sequence"][0]["_number"]).alias("seq_num"),
        info["coverpage"]["image"]["_l:href"].alias("cover"),
        F.size("bodies").alias("n_bodies"),
        F.size("binaries").alias("n_binaries"),
    )


@query("SELECT 'lib/' || doc_id || '.fb2' AS path, CASE WHEN doc_id % 11 = 0 THEN 'no book' ELSE 'damaged' END AS reason FROM documents WHERE NOT (" + GOOD + ")")
def s11_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read_fb2(fb2_files(spark, sf_dir))[1].select("path", "reason")


@query("SELECT doc_id, text FROM documents")
def s05_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds_of = ("UTF-16BE", "UTF-16LE", "UTF-8")
    docs = table(spark, sf_dir, "documents")
    coded = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", kinds_of[0]))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", kinds_of[1]))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", kinds_of[2])))
    return src.decode_files(docs.select("doc_id", coded.alias("content")))[0]


#: Declared labels of ``mixed_files``; what a charset lacks is a question mark there.
_DECLARED = ("UTF-8", "windows-1252", "iso-8859-15", "x-mac-roman", "windows-1253", "gb18030", "UTF-16", "x-nobody", "utf8", "us-ascii")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with a declaration, in the charset that it names; one of an unknown charset, one with a byte that is no UTF-8."""
    for batch in batches:
        ids, out = batch.column("doc_id").to_pylist(), []
        for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
            label = _DECLARED[doc_id % len(_DECLARED)]
            codec = {"x-mac-roman": "mac_roman", "UTF-16": "utf-8", "x-nobody": "utf-8"}.get(label, label)
            content = f'<?xml version="1.0" encoding="{label}"?>\n{text}'.encode(codec, "replace")
            out.append(content + b"\xff" if label == "utf8" else content)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "content"])


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_coded, "doc_id long, content binary")


_LABEL_SQL = "([" + ", ".join(f"'{x}'" for x in _DECLARED) + "])[doc_id % 10 + 1]"


@query(
    f"""WITH l AS (SELECT doc_id, {_LABEL_SQL} AS label, CASE WHEN doc_id % 10 IN (4, 9) THEN regexp_replace(text, '[^\x00-\x7F]', '?', 'g') ELSE text END AS text FROM documents WHERE doc_id % 10 NOT IN (7, 8))
 SELECT doc_id, md5('<?xml version="1.0" encoding="' || label || '"?>' || chr(10) || text) AS digest FROM l"""
)
def s05_mixed_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ten declarations in one batch."""
    return src.decode_files(mixed_files(spark, sf_dir))[0].select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'unknown charset' ELSE 'malformed text' END AS reason FROM documents WHERE doc_id % 10 IN (7, 8)")
def s11_undecodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of that batch that can't be decoded."""
    return src.decode_files(mixed_files(spark, sf_dir))[1]


@query(f"SELECT 'lib/' || doc_id || '.fb2' AS path, 'About ' || source || chr(10) || 'second' AS annotation FROM documents WHERE {GOOD}")
def p08_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, _ = src.read_fb2(fb2_files(spark, sf_dir))
    markup = books.select("path", F.concat(F.lit("<annotation>"), "annotation_markup", F.lit("</annotation>")).alias("markup"))
    return tok.text_fragment(tok.tokenize_markup(markup, "path", "markup"), "path", "annotation").withColumnRenamed("fragment", "annotation")


@query(f"SELECT 'lib/' || doc_id || '.fb2' AS path, 'Ann' AS first, '' AS middle, source AS last FROM documents WHERE {GOOD}")
def p05_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, _ = src.read_fb2(fb2_files(spark, sf_dir))
    raw = F.transform(F.col("description.title-info.author"), lambda a: F.struct(a["first-name"].alias("first"), a["middle-name"].alias("middle"), a["last-name"].alias("last")))
    return books.select("path", F.explode(meta.authors(raw)).alias("a")).select("path", "a.*")


@query(f"SELECT 'lib/' || doc_id || '.fb2' AS path, 'n1' AS note_id, '1' AS title, 'Note of ' || source || chr(10) || 'more' AS body, 1 AS note_number, 0 AS body_number FROM documents WHERE {GOOD}")
def m01_extract_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # damaged files have no elements to rely on; whole ones are parsed from their markup
    files = fb2_files(spark, sf_dir)
    whole = files.join(src.read_fb2(files)[0].select("path"), "path", "left_semi")
    notes, _ = fb2.extract_notes(fb2.parse_books(whole, "path"))
    return notes.select("path", "note_id", "title", "body", "note_number", "body_number")


# --- package rows -----------------------------------------------------------------------------


@query(
    f"""WITH {KINDS_SQL}, im AS (SELECT source AS book_id, doc_id AS ix, 'img' || doc_id AS fname, doc_id % 2 = 0 AS cov, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
 x AS (SELECT book_id, 'file' AS kind, file_ix::BIGINT AS ix, fname, 'application/xhtml+xml' AS media_type, FALSE AS cov FROM fk WHERE kind <> 'toc' UNION ALL SELECT book_id, 'image', ix, fname, 'image/png', n = 1 FROM im
  UNION ALL SELECT book_id, 'vignette', 1, 'v1', 'image/png', FALSE FROM (SELECT DISTINCT book_id FROM fk) UNION ALL SELECT book_id, 'resource', 1, 'r1', 'text/css', FALSE FROM (SELECT DISTINCT book_id FROM fk))
 SELECT book_id, CASE WHEN cov THEN 'book-cover-image' ELSE kind || row_number() OVER (PARTITION BY book_id, kind ORDER BY ix) END AS item_id, fname AS href, media_type, CASE WHEN cov THEN 'cover-image' END AS properties FROM x"""
)
def k03_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = kinds(spark, sf_dir).select("book_id", "file_ix", "fname", F.lit("application/xhtml+xml").alias("media_type"), (F.col("kind") != "toc").alias("in_manifest"))
    docs = table(spark, sf_dir, "documents")
    images = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("image_ix"), F.concat(F.lit("img"), F.col("doc_id").cast("string")).alias("fname"), F.lit("image/png").alias("media_type"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) == 1).alias("is_cover"))
    ids = files.select("book_id").distinct()
    extra = lambda name, kind: ids.select("book_id", F.lit(1).alias("ix"), F.lit(name).alias("fname"), F.lit(kind).alias("media_type"))
    return pk.manifest_rows("book_id", files, images, extra("v1", "image/png"), extra("r1", "text/css"))


@query(f"WITH {KINDS_SQL} SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY file_ix) AS spine_ix, fname AS idref, CASE WHEN kind = 'cover' THEN 'no' ELSE 'yes' END AS linear FROM fk WHERE kind <> 'toc'", spine_ix="INT")
def k04_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = kinds(spark, sf_dir).select("book_id", "file_ix", "fname", (F.col("kind") != "toc").alias("in_spine"), (F.col("kind") == "cover").alias("is_cover_page"))
    return pk.spine_rows(files, "book_id")


@query(
    f"WITH {KINDS_SQL}, s AS (SELECT book_id, arg_min(fname, file_ix) FILTER (kind = 'cover') AS c, arg_min(fname, file_ix) FILTER (kind = 'annotation') AS a, arg_min(fname, file_ix) AS i, arg_min(fname, file_ix) FILTER (kind = 'toc') AS t FROM fk GROUP BY book_id) "
    "SELECT book_id, 'text' AS type, coalesce(CASE WHEN book_id LIKE '%1' THEN c END, CASE WHEN book_id LIKE '%2' THEN a END, i) AS href FROM s UNION ALL SELECT book_id, 'toc', t FROM s WHERE t IS NOT NULL"
)
def k05_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk.guide_rows(kinds(spark, sf_dir), "book_id", F.col("book_id").like("%1"), F.col("book_id").like("%2"), toc_page=True)


@query(
    f"""WITH b AS (SELECT doc_id, {SQL_FIRST} AS title, lang, md5(text) AS book_id, source, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'S' END AS seq_name, (doc_id % 3)::INT AS seq_num FROM documents)
 SELECT * FROM (SELECT doc_id, 'dc:title' AS name, 0 AS ix, title AS value FROM b UNION ALL SELECT doc_id, 'dc:language', 0, lang FROM b UNION ALL SELECT doc_id, 'dc:identifier', 0, 'urn:uuid:' || book_id FROM b
 UNION ALL SELECT doc_id, 'cover', 0, CASE WHEN doc_id % 4 = 0 THEN 'c' ELSE '' END FROM b UNION ALL SELECT doc_id, 'series', 0, seq_name FROM b UNION ALL SELECT doc_id, 'series_index', 0, CASE WHEN seq_name <> '' AND seq_num > 0 THEN seq_num::VARCHAR END FROM b
 UNION ALL SELECT doc_id, 'dc:creator', 0, 'Ann' FROM b UNION ALL SELECT doc_id, 'dc:creator', 1, source FROM b UNION ALL SELECT doc_id, 'dc:subject', 0, lang FROM b) WHERE value <> ''"""
)
def k06_package_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    books = table(spark, sf_dir, "documents").select(
        "doc_id", tx.first_line(F.col("text")).alias("title"), "lang", F.md5(F.encode("text", "UTF-8")).alias("book_id"), F.array(F.lit("Ann"), "source").alias("authors"), F.array("lang").alias("genres"), F.lit("").alias("annotation"),
        F.when(n % 4 == 0, "c").otherwise("").alias("cover_id"), F.when(n % 2 == 0, "").otherwise("S").alias("seq_name"), (n % 3).cast("int").alias("seq_num"),
    )
    return pk.package_metadata(books, "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'conflict' ELSE 'write' END AS outcome FROM documents")
def k02_write_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    free, blocked = pk.write_conflicts(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return free.withColumn("outcome", F.lit("write")).unionByName(blocked.withColumn("outcome", F.lit("conflict")))


@query("SELECT source AS book_id, count(*) AS chapters FROM documents GROUP BY source")
def k01_chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"))


@query("SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS file_ix, doc_id, octet_length(encode(text)) AS length, md5(text) AS digest FROM documents", file_ix="INT", length="INT")
def k01_write_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters written by book and read back."""
    ix = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    chapters = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), ix.alias("file_ix"), "doc_id", "text")
    path = sinks.output_folder(spark, "chapters")
    sinks.write_chapters(chapters, path, "book_id")
    written = sinks.read_chapters(spark, path, "file_ix int, doc_id long, text string, book_id string")
    content = F.encode("text", "UTF-8")
    return written.select("book_id", "file_ix", "doc_id", F.octet_length(content).alias("length"), F.md5(content).alias("digest"))


_SECOND_SQL = """WITH o AS (SELECT source AS book_id, CASE WHEN source LIKE '%1' THEN 'replaced' WHEN source LIKE '%2' THEN 'conflict' ELSE 'written' END AS outcome FROM documents)
SELECT DISTINCT 'outcome' AS what, book_id, outcome AS value, 0::BIGINT AS n FROM o WHERE book_id LIKE '%1' OR book_id LIKE '%2' UNION ALL SELECT DISTINCT 'outcome', book_id || 'b', 'written', 0 FROM o WHERE book_id LIKE '%2'
UNION ALL SELECT 'chapter', source || CASE WHEN b THEN 'b' ELSE '' END, CASE WHEN b OR source LIKE '%1' THEN md5('again ' || text) ELSE md5(text) END, count(*) FROM (SELECT *, unnest([FALSE, TRUE]) AS b FROM documents)
  WHERE NOT b OR source LIKE '%2' GROUP BY ALL"""


@query(_SECOND_SQL)
def k01_second_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All books are written; then some are replaced, some meet a conflict, new ones come beside them, and the others stay."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("file_ix"), "text")
    path = sinks.output_folder(spark, "chapters")
    sinks.write_chapters(docs, path, "book_id")
    again = docs.withColumn("text", F.concat(F.lit("again "), "text"))
    replaced = sinks.write_chapters(again.where("book_id LIKE '%1'"), path, "book_id", overwrite=True)
    seconds = again.where("book_id LIKE '%2'")
    beside = sinks.write_chapters(seconds.unionByName(seconds.withColumn("book_id", F.concat("book_id", F.lit("b")))), path, "book_id")
    written = sinks.read_chapters(spark, path, "file_ix long, text string, book_id string")
    chapters = written.groupBy(F.lit("chapter").alias("what"), "book_id", F.md5(F.encode("text", "UTF-8")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return replaced.unionByName(beside).select(F.lit("outcome").alias("what"), "book_id", F.col("outcome").alias("value"), F.lit(0).cast("long").alias("n")).unionByName(chapters)


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive for each document: its text as a book under a name in code page 866, a file that is no book, and one outside the folder; every seventh is cut off."""
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            buffer = BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                for name in (f"in/\x7f{doc_id}.fb2", "in/readme.txt", "out/other.fb2"):
                    archive.writestr(name, text)
            content, coded = bytearray(buffer.getvalue()), "in/Ж".encode("cp866")
            # the name stands in the first header and in the directory; the same bytes may occur in packed text, which stays
            for at in (30, archive.start_dir + 46):
                content[at : at + len(coded)] = coded
            yield pa.RecordBatch.from_arrays([pa.array([f"lib/{doc_id}.zip"]), pa.array([bytes(content[: len(content) // 2] if doc_id % 7 == 0 else content)], pa.binary())], ["path", "content"])


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_zipped, "path string, content binary")


@query("SELECT 'lib/' || doc_id || '.zip' AS path, 'in/Ж' || doc_id || '.fb2' AS member, octet_length(encode(text))::BIGINT AS length, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0")
def s02_scan_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = src.expand_archives(archives(spark, sf_dir), "in/", code_page="cp866")
    return found.select("path", "member", "length", F.md5("content").alias("digest"))


@query("SELECT 'lib/' || doc_id || '.zip' AS path, NULL::VARCHAR AS member, 'damaged archive' AS reason FROM documents WHERE doc_id % 7 = 0")
def s02_archive_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.expand_archives(archives(spark, sf_dir), "in/", code_page="cp866")[1]


@query("SELECT doc_id, 'in/Ж' || doc_id || '.fb2' AS member FROM documents WHERE doc_id % 7 <> 0")
def s12_member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = src.expand_archives(archives(spark, sf_dir), code_page="cp866")
    return found.where(F.startswith("member", F.lit("in/"))).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), "member")
