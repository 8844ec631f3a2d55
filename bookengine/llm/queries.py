"""The registered queries of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookengine.llm.conversations import damage, repair_report
from bookengine.llm.exact_dedup import exact_dedup
from bookengine.llm.fill_middle import fill_in_middle, restore
from bookengine.llm.language import identify_language
from bookengine.llm.lattice_dedup import near_vectors
from bookengine.llm.licenses import LEAST_DICE, TEMPLATES, scan_licenses
from bookengine.llm.mixing import mix_sources
from bookengine.llm.ngram_join import ngram_components
from bookengine.llm.packing import pack_documents
from bookengine.llm.pii import KINDS, extract_pii
from bookengine.llm.quality import score_quality
from bookengine.llm.secret_ledger import findings, update_ledger
from bookengine.llm.spans import count_kind, span_text
from bookengine.llm.suffix_dedup import repeated_bytes

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pii(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(span_text(F.col("base"), KINDS, kind_first=True), 256).alias("base_sha256"),
        span_text(F.concat("base", "added"), KINDS, kind_first=True).alias("spans"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("assign", "access", "hex")
    docs = _table(spark, sf_dir, "documents")
    # two runs over one ledger: the second scans only blobs that the first has not seen
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    ledger = update_ledger(docs.where(~early), update_ledger(docs.where(early)))
    found = findings(docs, ledger)
    spans = span_text(F.col("findings"), kinds, kind_first=False)
    return found.select("doc_id", *(count_kind(F.col("findings"), kind).alias(f"n_{kind}") for kind in kinds), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return repair_report(damage(rows), rows)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_license_scan, op2_exact_dedup, op3_quality, op4_pii, op5_ngram_join, op6_packing, op7_lattice_dedup, op8_secret_ledger, op9_suffix_dedup, op10_mixing, op11_language, op12_fill_middle, op13_conversations)}

#: Fixed values of the contract: upper and lower ASCII letters, and what separates words.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

_OP2_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256
FROM t JOIN g USING (h)
"""


def _spans_sql(kind: str, place: int, pattern: str, accept: str) -> str:
    """Matches m of a pattern with their code-point positions: what stands between them adds up."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place, s AS start, s + length(m) AS stop
  FROM (SELECT doc_id, m, sum(length(b)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT doc_id, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, unnest(range(len(ms))) AS k
              FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS bs FROM d))
        WINDOW w AS (PARTITION BY doc_id ORDER BY k))
  WHERE {accept}"""


_ASSIGN_HEAD = """(?i:password|passwd|secret|token|api_?key)[""\\x27]?\\x20*[:=]\\x20*[""\\x27]?"""
_OP8_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(
        (
            _spans_sql("assign", 1, _ASSIGN_HEAD.replace('""', '"') + "[A-Za-z0-9+/_.=-]+", "length(regexp_extract(m, '^" + _ASSIGN_HEAD.replace('""', '"') + "([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
            _spans_sql("access", 2, "AKIA[A-Z0-9]+", "length(m) >= 20"),
            _spans_sql("hex", 3, "[0-9a-f]{24,}", "TRUE"),
        )
    )
    + """),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""
)

_OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, (ARRAY[1, 2, 3])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
lv AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum(3.0 * source_size) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS lighter
      FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - capped)::DOUBLE / (weights - lighter)) AS level FROM lv),
t AS (SELECT source, source_size, coalesce(least(3.0 * source_size, weight * level), 0)::DOUBLE AS target FROM s, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS times FROM t),
r AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT r.source, h, words, sum(words) OVER (PARTITION BY r.source ORDER BY h) AS upto, target - times * source_size AS budget
      FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source),
th AS (SELECT source, h AS threshold, words, least(budget - (upto - words), words)::DOUBLE AS remains FROM c
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN upto >= budget THEN h END NULLS LAST, h DESC) = 1)
SELECT d.doc_id, d.size, b.source_size::BIGINT AS source_size, b.target,
  least(d.size * b.times + CASE WHEN d.h < th.threshold THEN d.size WHEN d.h = th.threshold THEN floor(d.size::DOUBLE * th.remains / th.words::DOUBLE) ELSE 0 END, 3 * d.size)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN th ON d.source IS NOT DISTINCT FROM th.source
"""

_OP1_SQL = f"""
WITH templates(license, words) AS (SELECT license, regexp_extract_all(lower(body), '[0-9a-z]+') FROM (VALUES {", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)}) v(license, body)),
tg AS (SELECT license, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS grams FROM templates),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
seg AS (SELECT doc_id, 0 AS line_no, t AS s FROM d UNION ALL SELECT doc_id, unnest(range(1, len(string_split(t, chr(10))) + 1)), unnest(string_split(t, chr(10))) FROM d),
sw AS (SELECT doc_id, line_no, regexp_extract_all(s, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM seg),
sg AS (SELECT doc_id, line_no, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM sw WHERE len(w) > 1),
m AS (SELECT doc_id, line_no, license, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM sg, tg
      WHERE 2 * least(len(g), len(grams)) >= {LEAST_DICE} * (len(g) + len(grams)))
SELECT doc_id, line_no::BIGINT AS line_no, license, dice::DOUBLE AS dice FROM m WHERE dice >= {LEAST_DICE}
"""

_OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, by the bits of its bytes."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = "xor(c, b)"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda x: {bit})[1]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {byte}))"


def _op13_sql() -> str:
    """The edits of each row extend the cheapest, then ASCII-least, way to each of the four states (cost, audit, rows)."""
    longer = lambda s, cost, letter, line: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': list_append({s}.o, {line})}} END"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    insert = lambda s, role: longer(s, 2, "I", f"'{role}:'")
    # two rounds of inserts reach all that is useful
    wide = "SELECT *, {u} AS u2, {a} AS a2 FROM ({rows})"
    opened = wide.format(u=least("u", insert("b", "user"), insert("s", "user"), insert("a", "user")), a="a", rows="{rows}")
    opened = opened.replace("u2, a AS a2", "u1")
    opened = "SELECT * REPLACE (" + least("a", insert("u1", "assistant")) + " AS a) FROM (" + opened + ")"
    opened = "SELECT * EXCLUDE (u1) REPLACE (" + least("u1", insert("a", "user")) + " AS u) FROM (" + opened + ")"
    keep = lambda s: longer(s, "cut", "K", "role || ':' || text")
    rerole = lambda s, role: longer(s, "cut + 2", "R", f"'{role}:' || text")
    drop = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + 3, 'a': {s}.a || 'D', 'o': {s}.o}} END"
    when = lambda test, way: f"CASE WHEN NOT gone AND {test} THEN {way} END"
    step = {
        "b": drop("b"),
        "s": least(drop("s"), when("initial = 's'", keep("b"))),
        "u": least(drop("u"), *(when("initial = 'u'", keep(x)) for x in "bsa"), *(when("TRUE", rerole(x, "user")) for x in "bsa")),
        "a": least(drop("a"), when("initial = 'a'", keep("u")), when("TRUE", rerole("u", "assistant"))),
    }
    rows = opened.replace("{rows}", "SELECT dp.*, f.role, f.text, f.initial, f.gone, f.cut FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.k = dp.k + 1")
    end = opened.replace("{rows}", "SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1")
    way = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"
    white = r"\x20\x09-\x0D"
    return f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM r),
n AS (SELECT *, row_number() OVER w AS k, left(role, 1) AS initial, NOT regexp_matches(text, '[^{white}]') AS is_blank FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
q AS (SELECT *, NOT is_blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS is_repeat FROM n),
f AS (SELECT *, is_blank OR is_repeat AS gone, (NOT is_blank AND NOT is_repeat AND NOT regexp_matches(text, '[.!?][{white}]*$'))::BIGINT AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM q),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_repeat) AS duplicate, sum(cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
dp AS (SELECT conv_id, 0::BIGINT AS k, {{'c': 0, 'a': '', 'o': []}}::{way} AS b, NULL::{way} AS s, NULL::{way} AS u, NULL::{way} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, k + 1, {", ".join(f"({v})::{way}" for v in step.values())} FROM ({rows})),
e AS (SELECT conv_id, list_min([b, a]) AS best FROM ({end}))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


_OP13_SQL = _op13_sql()

ORACLES: dict[str, str] = {"op1_license_scan": _OP1_SQL, "op2_exact_dedup": _OP2_SQL, "op8_secret_ledger": _OP8_SQL, "op10_mixing": _OP10_SQL, "op12_fill_middle": _OP12_SQL, "op13_conversations": _OP13_SQL}
