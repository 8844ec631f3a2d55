"""Cases of scalar functions beyond what the tables hold."""

import uuid

import pytest
from pyspark.sql import functions as F

from bookengine.functions import formats as fmt
from bookengine.functions import metadata as meta
from bookengine.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("pattern", "keys", "expected"),
    [
        ("#title", {"#title": "T"}, "T"),
        ("#title", {"#title": ""}, ""),
        ("{#series - }#title", {"#series": "S", "#title": "T"}, "S - T"),
        ("{#series - }#title", {"#series": "", "#title": "T"}, "T"),
        ("{(#series{ #number}) }#title", {"#series": "", "#number": "3", "#title": "T"}, "T"),
        ("{(#series{ #number}) }#title", {"#series": "S", "#number": "", "#title": "T"}, "(S) T"),
        (r"\{#title\}", {"#title": "T"}, "{T}"),
        ("#authors by #author", {"#authors": "A, B", "#author": "A"}, "A, B by A"),
        ("#abbrseries #ABBRseries", {"#abbrseries": "ab", "#ABBRseries": "AB"}, "ab AB"),
        ("{#title}", {"#title": "T"}, ""),
        ("no keys", {"#title": "T"}, ""),
        ("#title #series", {"#title": "#series", "#series": "S"}, "#series S"),
    ],
)
def test_format_keywords(spark, pattern, keys, expected):
    assert value(spark, fmt.format_keywords(pattern, {k: F.lit(v) for k, v in keys.items()})) == expected


@pytest.mark.parametrize(("n", "text", "expected"), [(0, "  alpha beta", "alpha"), (3, "alpha", "alp"), (-1, "alpha beta", "alpha"), (4, " \t ", ""), (2, "", "")])
def test_first_word(spark, n, text, expected):
    assert value(spark, tx.first_word(F.lit(text), n)) == expected


@pytest.mark.parametrize(("text", "expected"), [("  long  night", "ln"), ("one two three", "ott"), ("   ", ""), ("2nd 'quoted", "nq"), ("Война и мир", "Вим")])
def test_abbreviation(spark, text, expected):
    assert value(spark, tx.abbreviation(F.lit(text))) == expected


@pytest.mark.parametrize("name", ["plain", "with blank", "Имя файла " * 8, "x" * 200, "a&b=c"])
def test_percent_encode_parts(spark, name):
    from urllib.parse import quote

    parts = value(spark, tx.percent_encode_parts(F.lit(name)))
    assert "".join(parts) == "UTF-8''" + quote(name, safe="$&+=:@~")
    assert all(len(p) <= 74 for p in parts)


def test_uuid5(spark):
    for text in ("", "id-7", "Книга"):
        assert value(spark, meta.uuid5(F.lit(text))) == str(uuid.uuid5(uuid.UUID(meta.NAMESPACE), text))
    assert value(spark, meta.book_id(F.lit("5F2C6A0E-3b1d-4c55-9d0e-7a41c2b8e913"))) == meta.NAMESPACE


@pytest.mark.parametrize(
    ("text", "expected"),
    [("-Hello", "— Hello"), ("–  Hello", "— Hello"), ("Hello - you", "Hello - you"), ("-", "-"), ("-  ", "-  "), ("", "")],
)
def test_normalize_speech(spark, text, expected):
    assert value(spark, tx.normalize_speech(F.lit(text), "-–", "— ")) == expected


@pytest.mark.parametrize(("text", "expected"), [("a – b - c", "a — b — c"), ("a - - b", "a — — b"), ("a-b", "a-b"), ("- a", "- a")])
def test_normalize_dashes(spark, text, expected):
    assert value(spark, tx.normalize_dashes(F.lit(text), "-–", "—")) == expected


@pytest.mark.parametrize(("text", "expected"), [("a  — b", "a_— b"), ("— a", "— a"), (" ", ""), ("  ", " "), ("a\n b", "a b"), (" — a", "_— a"), ("a——b", "a_—_—b")])
def test_normalize_dialogue(spark, text, expected):
    assert value(spark, tx.normalize_dialogue(F.lit(text), "—", "_")) == expected


def test_dialogue_keeps_words(spark):
    # two spacings of a dialogue give the same words
    a, b = ("Yes —  he said — no.", "Yes — he said  — no.")
    words = lambda t: value(spark, tx.split_words(tx.normalize_dialogue(F.lit(t), "—", " ")))
    assert words(a) == words(b)


@pytest.mark.parametrize("text", ["Mr. Fox met Dr. Owl. They spoke! ", "One.  Two?! Three", "", "no end", " . . ", "a.\n\nb."])
def test_sentences_are_lossless(spark, text):
    found = value(spark, tx.split_sentences(F.lit(text), F.lit("en")))
    assert "".join(found) == text
    assert value(spark, tx.split_sentences(F.lit(text), F.lit("xx"))) == ([text] if text else [])


def test_abbreviations_do_not_end_sentences(spark):
    assert value(spark, tx.split_sentences(F.lit("Mr. Fox met Dr. Owl. They spoke."), F.lit("en"))) == ["Mr. Fox met Dr. Owl. ", "They spoke."]


def test_small_functions(spark):
    assert value(spark, tx.clean_file_name(F.lit("..a/b:c"))) == "abc"
    assert value(spark, tx.clean_file_name(F.lit("..."))) == "_bad_file_name_"
    assert value(spark, tx.slugify(F.lit("Жизнь & Größe"))) == "zhizn-grosse"
    assert value(spark, tx.pad_number(F.lit(7), 3)) == "007"
    assert value(spark, tx.pad_number(F.lit(0), 3)) == ""
    assert value(spark, tx.pad_number(F.lit(12345), 3)) == "12345"
    assert value(spark, tx.bracket_note_title(F.lit("12"))) == "12) "
    assert value(spark, tx.anchor_href(F.lit(""), F.lit(" www.example.org, "))) == "www.example.org"
    assert value(spark, tx.anchor_href(F.lit("a\\b"), F.lit("x"))) == "a/b"
    assert value(spark, tx.anchor_href(F.lit(None).cast("string"), F.lit("plain words"))) is None
    assert value(spark, tx.drop_cap(F.lit("«Once upon"), "«")) == "«O"
    assert value(spark, tx.drop_cap(F.lit(" Once"), "«")) == ""
    assert value(spark, tx.text_length(F.array(F.lit("ab"), F.lit(""), F.lit("c")))) == 5
    assert value(spark, meta.language(F.lit("Deutsch"))) == "de"
    assert value(spark, meta.language(F.lit("???"))) == "ru"


def test_contexts_demand_their_struct(spark):
    books = spark.createDataFrame([("T", "S", 1, "en", [("A", "", "B")])], "title string, seq_name string, seq_num int, lang string, authors array<struct<first:string,middle:string,last:string>>")
    assert fmt.with_user_expression(books, "x", "opf-title", "concat(title, '!', all_authors)").first()["x"] == "T!B, A"
    with pytest.raises(ValueError, match="needs the struct"):
        fmt.with_user_expression(books, "x", "opf-author", "author.last")
