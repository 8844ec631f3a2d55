"""Intake of book files: directories, archives, encodings, FB2 fields."""

from __future__ import annotations

import codecs
import re
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of an archive member that is not read further.
MOST_MEMBER_BYTES = 512 << 20


def looks_like(text: Column, start: str = "<?xml", holds: str = "<FictionBook", head: int = 512) -> Column:
    """The first decoded characters start as they should and name the root element."""
    first = F.left(text, F.lit(head))
    return F.startswith(first, F.lit(start)) & F.contains(first, F.lit(holds))


def scan_books(spark: SparkSession, root: str, extension: str = ".fb2") -> DataFrame:
    """path, member, content, length of every book file under a folder; unreadable files are skipped, and so are empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    return files.where(F.endswith(F.lower("path"), F.lit(extension))).select("path", F.lit(None).cast("string").alias("member"), "content", "length")


def _expander(prefix: str, extension: str, code_page: str | None, most_bytes: int):
    def members(path: str, content: bytes) -> Iterator[dict]:
        try:
            archive = zipfile.ZipFile(BytesIO(content), metadata_encoding=code_page)
        except (zipfile.BadZipFile, UnicodeDecodeError):
            yield {"path": path, "member": None, "content": None, "length": len(content), "reason": "damaged archive"}
            return
        for info in archive.infolist():
            if info.is_dir() or not info.filename.startswith(prefix) or not info.filename.lower().endswith(extension):
                continue
            row = {"path": path, "member": info.filename, "content": None, "length": info.file_size, "reason": "too large"}
            if info.file_size <= most_bytes:
                try:
                    row |= {"content": archive.read(info), "reason": None}
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError):
                    row["reason"] = "damaged member"
            yield row

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                # a batch for each member, so that one is held at a time
                yield from (pa.RecordBatch.from_pylist([row], EXPANDED) for row in members(path, content))

    return expand


EXPANDED = pa.schema({"path": pa.string(), "member": pa.string(), "content": pa.binary(), "length": pa.int64(), "reason": pa.string()})


def expand_archives(archives: DataFrame, prefix: str = "", extension: str = ".fb2", code_page: str | None = None, most_bytes: int = MOST_MEMBER_BYTES) -> tuple[DataFrame, DataFrame]:
    """(books, quarantine) of zip archives (path, content): path, member, content, length of the books; no archives in archives.

    ``code_page`` decodes member names that are not marked as UTF-8. Quarantine holds path, member (null for an archive)
    and reason: damaged archive, damaged member, or too large, for members of over ``most_bytes``.
    """
    rows = archives.select("path", "content").mapInArrow(_expander(prefix, extension, code_page, most_bytes), "path string, member string, content binary, length long, reason string")
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").select("path", "member", "reason")


def scan_archives(spark: SparkSession, root: str, prefix: str = "", extension: str = ".fb2", code_page: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``expand_archives`` over the zip files under a folder."""
    return expand_archives(scan_books(spark, root, ".zip"), prefix, extension, code_page)


#: Byte order marks, longest first: the 32-bit little-endian mark begins with the 16-bit one. Fixed values.
MARKS = (("0000FEFF", "UTF-32BE"), ("FFFE0000", "UTF-32LE"), ("EFBBBF", "UTF-8"), ("FEFF", "UTF-16BE"), ("FFFE", "UTF-16LE"))


def detect_encoding(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(F.lit(False), "unknown")
    for mark, name in MARKS:
        out = out.when(F.startswith(head, F.lit(mark)), name)
    return out.otherwise("unknown")


#: Labels that declarations give beside those that Python's codecs know. Fixed values.
LABELS = {
    "win-1251": "cp1251", "win1251": "cp1251", "windows1251": "cp1251", "windows-1251u": "cp1251", "cp-1251": "cp1251", "x-cp1251": "cp1251", "x-cp1250": "cp1250", "x-cp1252": "cp1252",
    "windows1252": "cp1252", "windows1250": "cp1250", "koi8": "koi8_r", "koi": "koi8_r", "koi8r": "koi8_r", "koi8u": "koi8_u", "dos-866": "cp866", "x-mac-cyrillic": "mac_cyrillic", "x-mac-roman": "mac_roman", "x-sjis": "shift_jis", "x-gbk": "gbk", "x-big5": "big5", "unicode": "utf_8",
}
#: Codecs that are no charset of files.
_NO_CHARSET = {"idna", "punycode", "unicode-escape", "raw-unicode-escape", "undefined", "utf-7", "mbcs", "oem"}
#: Bytes of content that are decoded before a batch goes on.
_DECODED_BYTES = 4 << 20


def codec_of(label: str) -> str | None:
    """Name of the codec for a declared label; None if there is none. A declaration that can be read byte by byte is in no wide charset, whatever it says."""
    label = label.strip().lower()
    try:
        found = codecs.lookup(LABELS.get(label, label))
    except (LookupError, ValueError):
        return None
    if not found._is_text_encoding or found.name.replace("_", "-") in _NO_CHARSET:
        return None
    return "utf-8" if found.name.startswith(("utf-16", "utf-32")) else found.name


def decode_content(content: bytes) -> tuple[str | None, str | None]:
    """(text, reason): the text of a file by its byte order mark, else by the charset of the XML declaration, else UTF-8; or why there is none."""
    for mark, name in MARKS:
        if content.startswith(bytes.fromhex(mark)):
            codec, content = name, content[len(mark) // 2 :]
            break
    else:
        declared = re.search(rb"""^[^>]*\bencoding\s*=\s*["']([^"']*)["']""", content[:200])
        codec = codec_of(declared[1].decode("latin-1")) if declared else "utf-8"
    if codec is None:
        return None, "unknown charset"
    try:
        return content.decode(codec), None
    except (UnicodeDecodeError, UnicodeError):
        return None, "malformed text"


def _decoded(content: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [k for k, name in enumerate(batch.schema.names) if name != content]
            values, start = batch.column(content), 0
            found: list[tuple[str | None, str | None]] = []
            held = 0
            for k in range(batch.num_rows):
                value = values[k].as_py()
                found.append((None, "no content") if value is None else decode_content(value))
                held += len(value or b"")
                if held >= _DECODED_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(start, k + 1 - start)
                    texts, reasons = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), pa.array(texts, pa.string()), pa.array(reasons, pa.string())], [*(batch.schema.names[i] for i in others), "_text", "_reason"])
                    start, found, held = k + 1, [], 0

    return rows


def decode_files(files: DataFrame, content: str = "content", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(decoded, quarantine): files with ``text`` in place of their content, and those that can't be decoded with ``reason``.

    Reasons: unknown charset, malformed text, no content. A file that can't be decoded never stops the others; nothing is replaced
    or left out in those that can. The byte order mark is no part of the text.
    """
    others = [f for f in files.schema if f.name != content]
    schema = StructType([*others, StructField("_text", StringType()), StructField("_reason", StringType())])
    rows = files.mapInArrow(_decoded(content), schema)
    names = [f"`{f.name}`" for f in others]
    return rows.where("_reason IS NULL").select(*names, F.col("_text").alias(text)), rows.where("_reason IS NOT NULL").select(*names, F.col("_reason").alias("reason"))


def decode_binaries(rows: DataFrame, value: str) -> DataFrame:
    """Rows with ``content`` from base64 in lines; what can't be decoded is dropped."""
    return rows.withColumn("content", F.try_to_binary(F.regexp_replace(value, r"[ \r\n\t]", ""), F.lit("base64"))).where("content is not null").drop(value)


#: Namespace of FB2 documents. Fixed value.
FB2_NAMESPACE = "http://www.gribuser.ru/xml/fictionbook/2.0"

#: The part of a book that is read as a record.
FB2_SCHEMA = """description struct<
  `title-info`: struct<genre: array<string>, author: array<struct<`first-name`: string, `middle-name`: string, `last-name`: string>>, `book-title`: string, lang: string, date: string,
    coverpage: struct<image: struct<`_l:href`: string, `_xlink:href`: string>>, sequence: array<struct<_name: string, _number: string>>>,
  `document-info`: struct<id: string>>,
body array<string>,
binary array<struct<_id: string, `_content-type`: string, _VALUE: string>>,
_corrupt_record string"""


def read_fb2(files: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(books, quarantine): description, inner markup of the bodies, binaries; and the files that can't be read, with the reason.

    A damaged book never stops the batch. The annotation is taken from the markup of title-info, where its order of text and tags is kept.
    """
    sniffed = files.withColumn("_book", looks_like(F.ltrim(F.col(text))))
    # behind an explode, through which no filter is pushed, so that each text is parsed once
    parsed = sniffed.where("_book").withColumn("fb2", F.explode(F.array(F.from_xml(F.col(text), FB2_SCHEMA, {"mode": "PERMISSIVE", "rowTag": "FictionBook", "columnNameOfCorruptRecord": "_corrupt_record"}))))
    bad = F.col("fb2").isNull() | F.col("fb2._corrupt_record").isNotNull() | F.col("fb2.body").isNull()
    # the book's own, which sections may have as well
    info = F.regexp_extract(F.col(text), r"(?s)<title-info\b[^>]*>(.*?)</title-info>", 1)
    annotation = F.regexp_extract(info, r"(?s)<annotation\b[^>]*>(.*?)</annotation>", 1)
    books = parsed.where(~bad).select("path", "member", F.col("fb2.description").alias("description"), F.col("fb2.body").alias("bodies"), F.col("fb2.binary").alias("binaries"), annotation.alias("annotation_markup"))
    skipped = sniffed.where("NOT _book OR _book IS NULL").select("path", "member", F.lit("no book").alias("reason"))
    return books, skipped.unionByName(parsed.where(bad).select("path", "member", F.lit("damaged").alias("reason")))
