"""Paragraphs with inline elements against worked examples."""

from bookengine.operators import mixed as mx
from bookengine.operators import tokens as tok

HOW = mx.Normalization(speech=("-–", "— "), dashes=("-–", "—"), dialogue=("—", " "))


def pieces(spark, *markups):
    return tok.markup_pieces(spark.createDataFrame(list(enumerate(markups)), "id int, m string"), "id", "m")


def texts(spark, markup, how=HOW):
    return [(r["text"], r["behind"]) for r in mx.paragraph_texts(pieces(spark, markup), "id", how).orderBy("piece").collect()]


def test_roles_of_runs(spark):
    assert texts(spark, "<p>- Yes</p>") == [("— Yes", None)]
    # neither a run in an element nor a tail is the beginning of speech
    assert texts(spark, "<p><b>- Yes</b>- no</p>") == [("- Yes- no", None)]
    assert texts(spark, "<p>a - b <i>c - d</i> e - f</p> g - h") == [("a — b c - d e - f", None), (None, " g — h")]
    assert texts(spark, "<p>a &#8212; b</p><p/><p></p><v>x\r</v>") == [("a — b", None), ("", None), ("", None), ("x", None)]
    assert texts(spark, "<p>a <i> </i>b</p>") == [("a b", None)]
    assert texts(spark, "<section>- x<cite>- y</cite></section>") == []
    assert texts(spark, "<p>- x  y</p>", mx.Normalization()) == [("- x  y", None)]
    assert texts(spark, "") == [] and texts(spark, None) == []


def test_drop_caps_of_chapters(spark):
    book = (
        "<description><p>no title yet</p></description><body><p>Before</p><title><p>Title</p></title><epigraph><p>Motto</p></epigraph><p></p><p/><p>«Once» upon</p><p>Not</p>"
        "<section><title><p>T</p></title><p><i>Inline</i> first</p><p>No more</p></section>"
        "<section><title><p>T</p></title><subtitle>Sub</subtitle><cite><p>c</p></cite><p><a/>tail</p><p>Head</p></section>"
        "<section><title><p>T</p></title><p> blank</p><p>Late</p></section><section><title><p>T</p></title></section></body>"
        '<body name="notes"><title><p>N</p></title><p>Note</p></body>'
    )
    rows = pieces(spark, book, "", None, book.replace("Head", "Tail"))
    for size in (None, 8):
        found = sorted((r["id"], r["piece"], r["drop_cap"]) for r in mx.chapter_drop_caps(rows, "id", "«", size=size).collect())
        assert [(k, cap) for k, _, cap in found] == [(0, "«O"), (0, "H"), (3, "«O"), (3, "T")]
