"""Book files, archives and encodings, on files written here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from bookengine.operators import packaging as pk
from bookengine.sources import books as src
from bookengine.sources import sinks

BOOK = '<?xml version="1.0" encoding="{}"?>\n<FictionBook xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><genre>prose</genre><book-title>Тень</book-title><lang>ru</lang></title-info></description><body><p>Да</p></body></FictionBook>'


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.fb2").write_text(BOOK.format("UTF-8"), "utf-8")
    (tmp_path / "sub/B.FB2").write_text(BOOK.format("UTF-8"), "utf-8")
    (tmp_path / "sub/empty.fb2").write_bytes(b"")
    (tmp_path / "broken.fb2").write_text(BOOK.format("UTF-8")[:-20], "utf-8")
    (tmp_path / "junk.fb2").write_text("no markup")
    (tmp_path / "plain.xml").write_text("<x/>")
    for name, codec, mark in (("u8", "utf-8", b"\xef\xbb\xbf"), ("u16le", "utf-16-le", b"\xff\xfe"), ("u16be", "utf-16-be", b"\xfe\xff"), ("u32le", "utf-32-le", b"\xff\xfe\0\0"), ("u32be", "utf-32-be", b"\0\0\xfe\xff")):
        (tmp_path / f"bom_{name}.fb2").write_bytes(mark + BOOK.format("UTF-8").encode(codec))
    (tmp_path / "cp1251.fb2").write_bytes(BOOK.format("windows-1251").encode("cp1251"))
    with zipfile.ZipFile(tmp_path / "tree.zip", "w") as z:
        z.writestr("in/one.fb2", BOOK.format("UTF-8"))
        z.writestr("in/two.txt", "no")
        z.writestr("out/three.fb2", BOOK.format("UTF-8"))
        z.writestr("in/inner.zip", b"PK")
        info = zipfile.ZipInfo("in/X.fb2")
        z.writestr(info, BOOK.format("UTF-8"))
    raw = (tmp_path / "tree.zip").read_bytes().replace(b"in/X.fb2", "in/Ж.fb2".encode("cp866"))
    (tmp_path / "tree.zip").write_bytes(raw)
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    return tmp_path


def test_scan_books(spark, tree):
    names = {r["path"].rsplit("/", 1)[1] for r in src.scan_books(spark, str(tree)).collect()}
    assert names == {"a.fb2", "B.FB2", "broken.fb2", "junk.fb2", "cp1251.fb2", *(f"bom_{n}.fb2" for n in ("u8", "u16le", "u16be", "u32le", "u32be"))}


def test_scan_archives(spark, tree):
    books, bad = src.scan_archives(spark, str(tree), "in/", code_page="cp866")
    rows = books.collect()
    assert {r["member"] for r in rows} == {"in/one.fb2", "in/Ж.fb2"}
    assert all(bytes(r["content"]).startswith(b"<?xml") and r["length"] == len(r["content"]) for r in rows)
    assert [(r["path"].rsplit("/", 1)[1], r["member"], r["reason"]) for r in bad.collect()] == [("bad.zip", None, "damaged archive")]


def test_quarantine_of_archive_members(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, size in (("good.fb2", 10), ("large.fb2", 3000), ("hurt.fb2", 50)):
            z.writestr(name, name[0] * size)
    content = buffer.getvalue().replace(b"h" * 50, b"H" * 50)
    books, bad = src.expand_archives(spark.createDataFrame([("a.zip", content), ("b.zip", content[:100]), ("c.zip", b"")], "path string, content binary"), most_bytes=1000)
    assert [(r["path"], r["member"], bytes(r["content"])) for r in books.collect()] == [("a.zip", "good.fb2", b"g" * 10)]
    assert sorted(map(tuple, bad.collect()), key=str) == [("a.zip", "hurt.fb2", "damaged member"), ("a.zip", "large.fb2", "too large"), ("b.zip", None, "damaged archive"), ("c.zip", None, "damaged archive")]


def test_encodings_and_quarantine(spark, tree):
    (tree / "cp1253.fb2").write_bytes(BOOK.format("windows-1253").replace("Тень", "Σκιά").replace("Да", "Ναι").encode("cp1253"))
    (tree / "nobody.fb2").write_text(BOOK.format("x-nobody"), "utf-8")
    (tree / "bytes.fb2").write_bytes(BOOK.format("UTF-8").encode()[:-30] + b"\xff\xfe")
    (tree / "win1251.fb2").write_bytes(BOOK.format("win-1251").encode("cp1251"))
    (tree / "wide.fb2").write_text(BOOK.format("UTF-16"), "utf-8")
    decoded, undecodable = src.decode_files(src.scan_books(spark, str(tree)))
    books, bad = src.read_fb2(decoded)
    name = lambda r: r["path"].rsplit("/", 1)[1]
    found = {name(r): r["t"] for r in books.select("path", F.col("description.title-info.book-title").alias("t")).collect()}
    assert found == {"cp1253.fb2": "Σκιά", **dict.fromkeys(("a.fb2", "B.FB2", "cp1251.fb2", "win1251.fb2", "wide.fb2", *(f"bom_{n}.fb2" for n in ("u8", "u16le", "u16be", "u32le", "u32be"))), "Тень")}
    assert {name(r): r["reason"] for r in bad.collect()} == {"broken.fb2": "damaged", "junk.fb2": "no book"}
    assert {name(r): r["reason"] for r in undecodable.collect()} == {"nobody.fb2": "unknown charset", "bytes.fb2": "malformed text"}


def test_decode_content():
    for label, codec in (("windows-1251", "cp1251"), ("KOI8-U", "koi8_u"), ("Shift_JIS", "shift_jis"), ("ISO-8859-5", "iso8859-5"), ("x-mac-cyrillic", "mac_cyrillic")):
        text = f"<?xml version='1.0' encoding = '{label}'?>Ж" if codec != "shift_jis" else f"<?xml version='1.0' encoding='{label}'?>日本"
        assert src.decode_content(text.encode(codec)) == (text, None)
    assert src.decode_content(b"") == ("", None) and src.decode_content(b"\xef\xbb\xbf") == ("", None)
    # text behind the declaration names no charset, and neither does what is no charset
    assert src.decode_content("<a>é encoding='x-none'</a>".encode()) == ("<a>é encoding='x-none'</a>", None)
    for label in ("rot13", "base64", "idna", "unicode_escape", "", "\0"):
        assert src.decode_content(f"<?xml encoding='{label}'?>".encode()) == (None, "unknown charset")
    assert src.decode_content(b"\xff\xfea") == (None, "malformed text") and src.decode_content(b"\xff\xfe\0\0\0") == (None, "malformed text")


def test_decode_files_keeps_other_columns(spark):
    files = spark.createDataFrame([("a", 1, b"x", "t"), ("b", 2, None, "t"), ("c", 3, b"\xff", None)], "path string, n int, content binary, reason string")
    good, bad = src.decode_files(files.drop("reason"))
    assert [tuple(r) for r in good.collect()] == [("a", 1, "x")]
    assert sorted(map(tuple, bad.collect())) == [("b", 2, "no content"), ("c", 3, "malformed text")]


def test_binaries(spark):
    df = spark.createDataFrame([(1, "aGVs\r\n bG8="), (2, "@@"), (3, None)], "id int, v string")
    assert [(r["id"], bytes(r["content"])) for r in src.decode_binaries(df, "v").collect()] == [(1, b"hello")]


def test_write_chapters(spark, tmp_path):
    df = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 1, "c"), (None, 1, "n")], "book_id string, file_ix int, body string")
    path = str(tmp_path / "out")
    kept = lambda: sorted(((r["book_id"], r["file_ix"], r["body"]) for r in sinks.read_chapters(spark, path, "file_ix int, body string, book_id string").collect()), key=repr)
    said = lambda out: {r["book_id"]: r["outcome"] for r in out.collect()}
    assert said(sinks.write_chapters(df, path, "book_id")) == {"x": "written", "y": "written", None: "written"}
    first = kept()
    assert len(first) == 4
    # what is there stays, and what is new is written beside it
    more = spark.createDataFrame([("x", 1, "other"), ("z", 1, "d"), (None, 7, "m")], "book_id string, file_ix int, body string")
    assert said(sinks.write_chapters(more, path, "book_id")) == {"x": "conflict", "z": "written", None: "conflict"}
    assert kept() == sorted([*first, ("z", 1, "d")], key=repr)
    # overwriting a book replaces all of it and no other
    assert said(sinks.write_chapters(more, path, "book_id", overwrite=True)) == {"x": "replaced", "z": "replaced", None: "replaced"}
    assert kept() == sorted([("x", 1, "other"), ("y", 1, "c"), ("z", 1, "d"), (None, 7, "m")], key=repr)
    assert said(sinks.write_chapters(more.limit(0), path, "book_id", overwrite=True)) == {}
    assert len(kept()) == 4


def test_write_conflicts(spark):
    planned = spark.createDataFrame([("a",), ("b",)], "book_id string")
    free, blocked = pk.write_conflicts(planned, planned.where("book_id = 'a'"), "book_id")
    assert [r[0] for r in free.collect()] == ["b"]
    assert [r[0] for r in blocked.collect()] == ["a"]
    assert pk.write_conflicts(planned, planned, "book_id", overwrite=True)[0].count() == 2


def test_fb2_books_hold_whole_texts(spark, duck):
    import html
    import re

    from bookengine.plans.book_queries import GOOD, fb2_files
    from compare import DATA

    books, _ = src.read_fb2(fb2_files(spark, DATA))
    found = {r["path"]: r["body"] for r in books.selectExpr("path", "bodies[0] AS body").collect()}
    texts = {f"lib/{k}.fb2": text for k, text in duck.execute(f"SELECT doc_id, text FROM documents WHERE {GOOD}").fetchall()}
    words = lambda x: re.sub("[\\x00-\\x20]+", " ", x).strip()
    assert {k: [words(html.unescape(x)) for x in re.findall("(?s)<p>(.*?)</p>", body)] for k, body in found.items()} == {k: [words(html.unescape(x)) for x in text.split("\n")] for k, text in texts.items()}
    assert any(text.count("\n") > 2 for text in texts.values())


def test_write_library(spark, tmp_path):
    rows = [(f"b{k % 7}", k // 7 + 1, str(k)) for k in range(70)] + [("hot", k, "x") for k in range(2500)]
    df = spark.createDataFrame(rows, "book string, file_ix int, body string").repartition(5)
    sinks.write_library(df, str(tmp_path / "all"), "book")
    read = sinks.read_chapters(spark, str(tmp_path / "all"), "book string, file_ix int, body string")
    assert sorted(map(tuple, read.collect())) == sorted(rows)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_library(df, str(tmp_path / "all"), "book")


def test_staged_tables_can_be_discarded(spark):
    import os

    df = spark.createDataFrame([(1, "a")], "k int, v string")
    read = sinks.staged(df, "kept")
    folder = os.path.dirname(os.path.dirname(read.inputFiles()[0].removeprefix("file:").replace("///", "/")))
    assert [tuple(r) for r in read.collect()] == [(1, "a")] and os.path.isdir(folder)
    sinks.discard_all(spark)
    assert not os.path.exists(folder)
