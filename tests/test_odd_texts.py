"""Queries against their SQL on texts that the given tables lack."""

import pytest

from bookengine.plans.catalog import ORACLES, QUERIES
from compare import assert_same

TEXTS = (
    "",
    " \n ",
    "...",
    ". . Dr. X",
    "\u2003He saw, Brown.\u00a0The, tree! Dr.\u2028Green et de. Foo",
    "a\x1cb. Dr.\x1dBrown x. The\x1f End.\x1e The",
    "Dr. \x01 Foo. \x01\x01 Dr. Bar Dr.\x01Baz \x01 ! Qux",
    "\nA first line that is empty",
    # packed, this holds the bytes in/\x7f
    "ĀāĂăĄąĆ\u40c7w…",
    "It, was (Dr.) Brown.) No, Brown. de de z.B. The Étude, étude. İx, Straße! «Dr.», »The« ",
)


@pytest.fixture(scope="module")
def odd(spark, duck, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(n * len(TEXTS) + k, text, lang, f"src{n}", len(text)) for n, lang in enumerate(("en", "de", "en", "es", "fr") * 5) for k, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["e01_learned_abbreviations", "e01_learned_sentences", "f01_format_keywords", "s02_archive_quarantine", "s02_scan_archives", "s12_member_names"])
def test_query_on_odd_texts(name, spark, odd):
    folder, con = odd
    found = con.execute(ORACLES[name])
    assert_same(QUERIES[name](spark, folder), [c[0] for c in found.description], found.fetchall())
