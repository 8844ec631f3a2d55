"""Queries of paragraphs with inline elements.

Each document becomes a body whose lines are paragraphs of four forms in turn: a line of dialogue, one with an emphasis and a tail, one that
begins with a strong element, and a verse with text behind it. Half of them stand under a second title and an epigraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookengine.functions import text as tx
from bookengine.operators import mixed as mx
from bookengine.operators import tokens as tok
from bookengine.plans.registry import query, table
from bookengine.plans.scalar_queries import _D, _DASHES, WS

HOW = mx.Normalization(speech=(_DASHES, "— "), dashes=(_DASHES, "—"), dialogue=(_DASHES, " "))
CAPS = mx.Normalization(speech=(_DASHES, "«"))
IGNORE = '«"'


def mixed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, raw."""
    lines = F.split(F.regexp_replace("text", r"[\x00-\x09\x0B-\x1F]", " "), "\n", -1)
    half = F.floor((F.size("lines") + 1) / 2)

    def escaped(line: Column) -> Column:
        return F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))

    def paragraph(line: Column, k: Column) -> Column:
        form, said = k % 4, escaped(line)
        made = (
            F.when(form == 0, F.concat(F.lit("<p>&#8211; "), said, F.lit("</p>")))
            .when(form == 1, F.concat(F.lit('<p id="x">-'), said, F.lit(" <emphasis>- in - it</emphasis> – tail  - end</p>")))
            .when(form == 2, F.concat(F.lit("<p><strong>— "), said, F.lit("</strong> — tail</p>")))
            .otherwise(F.concat(F.lit("<v>"), said, F.lit("</v> – behind - it ")))
        )
        return F.concat(F.when(k == half, "<section><title><p>Two</p></title><epigraph><p>Q</p></epigraph>").otherwise(""), made)

    # a single line leaves nothing to the second half, whose title stands there all the same
    none = F.when(F.size("lines") == 1, "<section><title><p>Two</p></title><epigraph><p>Q</p></epigraph>").otherwise("")
    body = F.concat(F.lit("<body><title><p>T</p></title>"), F.array_join(F.transform("lines", paragraph), ""), none, F.lit('</section></body><body name="notes"><title><p>N</p></title><p>- note</p></body>'))
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    return tok.markup_pieces(docs.select("doc_id", body.alias("markup")), "doc_id", "markup")


_LINES_SQL = """ls AS (SELECT doc_id, len(lines) AS n, (len(lines) + 1) // 2 AS half, unnest(lines) AS x, unnest(range(len(lines))) AS k
  FROM (SELECT doc_id, string_split(regexp_replace(text, '[\\x00-\\x09\\x0B-\\x1F]', ' ', 'g'), chr(10)) AS lines FROM documents)),
pl AS (SELECT *, (CASE WHEN k < half THEN 5 ELSE 14 END + 2 * k)::INT AS piece FROM ls)"""


def _speech_sql(x: str, to: str = "— ") -> str:
    return f"regexp_replace({x}, '^[{_D}][{WS}]*([^{WS}])', '{to}\\1')"


def _dashes_sql(x: str) -> str:
    once = f"regexp_replace({x}, '([{WS}])[{_D}]([{WS}])', '\\1—\\2', 'g')"
    return f"regexp_replace({once}, '([{WS}])[{_D}]([{WS}])', '\\1—\\2', 'g')"


def _dialogue_sql(x: str) -> str:
    one = f"regexp_replace({x}, '[{WS}]*([{WS}])', '\\1', 'g')"
    rest = f"regexp_replace(substr({one}, 2), '[{WS}]?([{_D}])', chr(160) || '\\1', 'g')"
    return f"CASE WHEN regexp_matches({x}, '^[{WS}]$') THEN '' WHEN regexp_matches({one}, '^[{_D}]') THEN left({one}, 1) || {rest} ELSE regexp_replace({one}, '[{WS}]?([{_D}])', chr(160) || '\\1', 'g') END"


_HEAD = _dialogue_sql(_dashes_sql(_speech_sql("head")))
_MIXED_SQL = f"""WITH {_LINES_SQL}, parts AS (SELECT *, CASE k % 4 WHEN 0 THEN '– ' || x WHEN 1 THEN '-' || x || ' ' WHEN 2 THEN '' ELSE x END AS head, CASE k % 4 WHEN 1 THEN '- in - it' WHEN 2 THEN '— ' || x ELSE '' END AS inner_,
 CASE k % 4 WHEN 1 THEN ' – tail  - end' WHEN 2 THEN ' — tail' ELSE '' END AS tail, ' – behind - it ' AS over FROM pl),
ends AS (SELECT DISTINCT doc_id, n, half FROM ls)
SELECT doc_id, piece, ({_HEAD}) || ({_dialogue_sql('inner_')}) || ({_dialogue_sql('tail')}) AS text, NULL AS behind FROM parts
UNION ALL SELECT doc_id, piece + 1, NULL, {_dialogue_sql(_dashes_sql('over'))} FROM parts WHERE k % 4 = 3
UNION ALL SELECT doc_id, p, t, NULL FROM (SELECT doc_id, unnest([2, 7 + 2 * half, 11 + 2 * half, 18 + 2 * n, 21 + 2 * n])::INT AS p, unnest(['T', 'Two', 'Q', 'N', '— note']) AS t FROM ends)"""


@query(_MIXED_SQL)
def n01_mixed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct speech at heads alone, dashes there and behind paragraphs, dialogue everywhere (N01 to N03)."""
    return mx.paragraph_texts(mixed_pieces(spark, sf_dir), "doc_id", HOW)


@query(
    f"WITH {_LINES_SQL}, told AS (SELECT * FROM pl WHERE NOT (k % 4 = 3 AND x = '')), first AS (SELECT doc_id, min(k) AS k FROM told GROUP BY doc_id, k >= half), "
    f"caps AS (SELECT doc_id, piece, {_speech_sql('head', '«')} AS t FROM (SELECT doc_id, k, piece, CASE k % 4 WHEN 0 THEN '– ' || x WHEN 1 THEN '-' || x || ' ' ELSE x END AS head FROM told) JOIN first USING (doc_id, k) WHERE k % 4 <> 2) "
    f"SELECT * FROM (SELECT doc_id, piece, regexp_extract(regexp_extract(t, '^[^{tx.WS_BREAKING}]*', 0), '^[«\"]*[^«\"{WS}]', 0) AS drop_cap FROM caps) WHERE drop_cap <> ''"
)
def e06_chapter_drop_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line behind a title, epigraphs passed over; a line that begins in an inline element has none."""
    return mx.chapter_drop_caps(mixed_pieces(spark, sf_dir), "doc_id", IGNORE, CAPS)
