"""Blocked windows, the element table and books, against plain Python and its XML parser."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from bookengine.operators import blocks, fb2
from bookengine.operators import elements as el
from bookengine.operators import tokens as tok


@pytest.mark.parametrize("size", [None, 3, 1000])
def test_blocked_windows(spark, size):
    rng = random.Random(5)
    rows = [(key, at, rng.choice([None, *range(9)])) for key in ("a", "b", None) for at in rng.sample(range(40), 25)]
    # one key with most of the rows
    rows += [("hot", at, rng.choice([None, 1, 2])) for at in range(200)]
    table = spark.createDataFrame(rows, "key string, at int, value int")
    sums, last, after = {}, {}, {}
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        for i, (at, _) in enumerate(own):
            sums[key, at] = (i + 1, sum(v or 0 for _, v in own[: i + 1]))
            last[key, at] = next((v for _, v in reversed(own[:i]) if v is not None), None)
            after[key, at] = next((v for _, v in own[i + 1 :] if v is not None), None)
    found = blocks.running_sums(table, ["key"], "at", {"n": F.lit(1), "total": F.coalesce("value", F.lit(0))}, size)
    assert {(r["key"], r["at"]): (r["n"], r["total"]) for r in found.collect()} == sums
    for helper, expected in ((blocks.last_before, last), (blocks.first_after, after)):
        found = helper(table, ["key"], "at", "value", "near", size)
        assert {(r["key"], r["at"]): r["near"] for r in found.collect()} == expected
    assert blocks.block_size(table, "at", 200) is None and blocks.block_size(table, "at", 199) == 199
    assert blocks.block_size(table.limit(0), "at") is None


def random_markup(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice("abc")
        attrs = rng.choice(["", "", ' id="x"', ' id="y" n="1"'])
        text = rng.choice(["", "one", "two &amp; three"])
        inner = random_markup(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else ""
        out += f"<{tag}{attrs}/>" if not text and not inner else f"<{tag}{attrs}>{text}{inner}</{tag}>"
        out += rng.choice(["", "tail"])
    return out


#: Path, and the same for the standard library's parser, which counts positions among elements of one name.
PATHS = [
    ("/top", None),
    ("/top/a", "./a"),
    ("//a", ".//a"),
    ("/top/*/b", "./*/b"),
    ("//a/b/..", ".//a/b/.."),
    ("//a[@id]", ".//a[@id]"),
    ("//b[@id='y']/c", ".//b[@id='y']/c"),
    ("//c[1]", ".//c[1]"),
    ("//a[2]/b", ".//a[2]/b"),
    ("//b[-1]", ".//b[last()]"),
    ("//a[b]", ".//a[b]"),
    ("//a//c", ".//a//c"),
    ("//a[@id='x']//b[@n]", ".//a[@id='x']//b[@n]"),
]


@pytest.mark.parametrize("size", [None, 4])
def test_paths(spark, size):
    rng = random.Random(2)
    markup = {k: f"<top>{random_markup(rng)}</top>" for k in range(30)}
    files = spark.createDataFrame(list(markup.items()), "key int, text string")
    raw = tok.tokenize_markup(files, "key", "text")
    tokens = el.with_depth(raw.withColumn("text", tok.unescape(F.col("text"))), "key", size=size).cache()
    table = el.element_table(tokens, "key", size).cache()
    texts = el.texts_behind(tokens, "key").cache()
    trees = {k: ET.fromstring(m) for k, m in markup.items()}
    said = lambda found: found.join(texts, ["key", "start"], "left").collect()
    # parents and depths
    want = [(k, len(path), e.tag, e.text or None) for k, t in trees.items() for path, e in walk(t, ())]
    assert sorted(((r["key"], r["depth"] - 1, r["tag"], r["text"]) for r in said(table)), key=repr) == sorted(want, key=repr)
    # in blocks the steps that have windows
    for path, other in PATHS if size is None else [PATHS[k] for k in (8, 9, 11)]:
        found = sorted(((r["key"], r["tag"], r["text"]) for r in said(el.select_path(table, "key", path, size=size))), key=repr)
        expected = sorted(((k, e.tag, e.text or None) for k, t in trees.items() for e in ([t] if other is None else {id(x): x for x in t.findall(other)}.values())), key=repr)
        assert found == expected, path
    text = el.select_path(table, "key", "//a[text()='one']", size=size, texts=texts).collect()
    assert len(text) == sum(e.text == "one" for t in trees.values() for e in t.iter("a"))
    child = el.select_path(table, "key", "//a[b='two & three']", size=size, texts=texts).collect()
    assert len(child) == sum(any(c.text == "two & three" for c in e.findall("b")) for t in trees.values() for e in t.iter("a"))
    if size is not None:
        return
    within = el.select_path(table, "key", "//a", size=size)
    assert sorted(map(repr, el.select_path(table, "key", "./b", within, size).collect())) == sorted(map(repr, el.select_path(table, "key", "//a/b", size=size).collect()))


def walk(element, path):
    yield path, element
    for child in element:
        yield from walk(child, (*path, element))


def test_paths_that_cannot_be_read(spark):
    for path in ("//", "/a[", "/a]b", "a b"):
        with pytest.raises(ValueError, match="can't be read"):
            el.path_steps(path)
    assert el.path_steps("//a[@b='x]/y'][2]/..") == [("//", "a", ["@b='x]/y'", "2"]), ("/", "..", [])]


def test_elements_without_an_end(spark):
    files = spark.createDataFrame([(1, "<a><b>x<p>y<br>z</b></a><c>open"), (2, None), (3, "no tags"), (4, "")], "key int, text string")
    tokens = el.with_depth(tok.tokenize_markup(files, "key", "text"), "key", ("a", "b", "c"))
    rows = {r["tag"]: r for r in el.element_table(tokens, "key").collect()}
    assert set(rows) == {"a", "b", "p", "br", "c"}
    assert rows["p"]["parent"] == rows["br"]["parent"] == rows["b"]["start"] and rows["p"]["end"] == rows["p"]["start"]
    assert rows["c"]["end"] == el.NO_END and rows["c"]["parent"] == 0


def test_pieces(spark):
    markup = "<sec>x<emphasis>y</emphasis> z<image/><p>q &amp; <a href='#1'>1</a>r</p>tail<b/></sec>"
    pieces = tok.markup_pieces(spark.createDataFrame([(1, markup), (2, ""), (3, "text"), (4, None)], "key int, text string"), "key", "text")
    assert "".join(r["raw"] for r in pieces.where("key = 1").orderBy("piece").collect()) == markup
    texts = [(r["opens"], r["text"], r["unlinked"]) for r in tok.piece_texts(pieces, "key").where("key = 1").orderBy("pos").collect()]
    assert texts == [("sec", "xy z", None), ("p", "q & 1r", "q & r"), ("", "tail", None)]
    tags = [(r["kind"], r["tag"]) for r in tok.piece_tags(pieces, "key").orderBy("pos").collect()]
    assert tags == [("open", "sec"), ("open", "emphasis"), ("close", "emphasis"), ("selfclose", "image"), ("open", "p"), ("open", "a"), ("close", "a"), ("close", "p"), ("selfclose", "b"), ("close", "sec")]
    assert [(r["text"]) for r in tok.piece_texts_behind(pieces, "key").orderBy("start").collect()] == ["x", "y", "q & ", "1"]


def test_unescape(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&#65;&#x42;&#X43;": "ABC", "&#8212;|&#x1F600;": "—|😀", "&#xD800;&#0;&#1114112;": "&#xD800;&#0;&#1114112;", "&nbsp;&quot;&apos;&gt;&lt;": "&nbsp;\"'><", "no": "no", "&": "&", "": "", None: None}
    found = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tok.unescape(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in found} == cases
    named = tok.resolve_entities(spark.createDataFrame([(1, "&#65;&copy;&#x42;&nosuch;&#xD800;")], "k int, t string"), "k", "t").first()
    assert named["resolved"] == "A©B&nosuch;&#xD800;"


NOTES = """<FictionBook><description><title-info><annotation id="k"><p>own</p></annotation></title-info></description>
<body><section id="s"><annotation><p>other</p></annotation><p>x</p></section></body>
<body name="notes"><section><title><p>Second [1]</p></title><section id="a"><p>one</p><section id="inner"><title><p>no</p></title><p>two</p></section><p>three</p></section></section>
<section><section><section id="b"><title><p>7</p></title><empty-line/><p/><p>deep</p><empty-line/><p>end</p></section></section></section><title><p>late</p></title></body>
<body name="other"><section id="z"><p>z</p></section></body>
<body name="comments"><section id="c"><p>c</p></section><section id=""><section id="d"/></section></body></FictionBook>"""


@pytest.mark.parametrize("block", [blocks.BLOCK, 4])
def test_notes_at_any_depth(spark, block):
    # a block of four pieces makes every book many blocks
    books = fb2.parse_books(spark.createDataFrame([("x", NOTES), ("y", NOTES.replace("own", "mine"))], "book string, text string"), "book", block=block)
    notes = {(r["book"], r["note_id"]): (r["body_name"], r["note_number"], r["body_number"], r["title"], r["body"], r["body_title"]) for r in fb2.titled_notes(books).collect()}
    one = {
        "a": ("notes", 1, 1, "", "one\nno\ntwo\nthree", "Second "),
        "b": ("notes", 2, 1, "7", "deep\n\nend", "Second "),
        "c": ("comments", 1, 2, "", "c", "Comments"),
        "d": ("comments", 2, 2, "", "", "Comments"),
    }
    assert notes == {(book, k): v for book in "xy" for k, v in one.items()}
    assert sorted((r["body_title"], r["place"]) for r in fb2.extract_notes(books)[1].collect()) == [("Second ", 1)] * 2 + [("late", 2)] * 2
    assert sorted(map(tuple, fb2.annotations(books).collect())) == [("x", "own"), ("y", "mine")]
    sections = fb2.main_sections(books)
    assert [(r["section_id"], r["level"], r["title"]) for r in sections.where("book = 'x'").collect()] == [("s", 0, None)]
    assert [(r["file_ix"], r["para_ix"], r["text"]) for r in fb2.chapter_paragraphs(books).where("book = 'x'").collect()] == [(1, 1, "x")]
