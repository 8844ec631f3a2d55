"""Queries of the token table, entities, encodings, segmentation and hyphenation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookengine.functions import text as tx
from bookengine.operators import breaks as br
from bookengine.operators import segment as seg
from bookengine.operators import tokens as tok
from bookengine.plans.registry import query, table
from bookengine.plans.scalar_queries import LINES, WS
from bookengine.sources import books as src
from bookengine.sources import sinks

CLEAN_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)>', '', 'g'), '(?s)<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'g')"
)
TOKENS_SQL = f"""raws AS (SELECT page_id, unnest(range(1, len(t) + 1))::INT AS pos, unnest(t) AS raw FROM (SELECT page_id, regexp_extract_all({CLEAN_SQL}, '<[^>]+>|[^<]+') AS t FROM pages)),
tok AS (SELECT page_id, pos, raw, CASE WHEN raw LIKE '</%' THEN 'close' WHEN raw LIKE '<!%' OR raw LIKE '<?%' THEN 'decl' WHEN raw LIKE '<%/>' THEN 'selfclose' WHEN raw LIKE '<%' THEN 'open' ELSE 'text' END AS kind,
  lower(regexp_extract(raw, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) AS tag FROM raws)"""
_LISTED = "tag IN ('" + "', '".join(tok.CLOSED) + "')"
DEPTH_SQL = f"""dep AS (SELECT *, (sum(CASE WHEN {_LISTED} AND kind = 'open' THEN 1 WHEN {_LISTED} AND kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos)
  + CASE WHEN {_LISTED} AND kind = 'close' THEN 1 ELSE 0 END)::INT AS depth FROM tok)"""


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.tokenize_markup(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT page_id FROM pages WHERE starts_with(left(html, 512), '<!DOCTYPE html') AND contains(left(html, 512), '<html')")
def s03_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.where(src.looks_like(F.col("html"), "<!DOCTYPE html", "<html")).select("page_id")


_BOMS = ("0000FEFF", "FFFE0000", "EFBBBF", "FEFF", "FFFE", "")
_BOM_SQL = "(['" + "', '".join(_BOMS) + "'])[doc_id % 6 + 1]"


@query(f"SELECT doc_id, (['UTF-32BE', 'UTF-32LE', 'UTF-8', 'UTF-16BE', 'UTF-16LE', 'unknown'])[doc_id % 6 + 1] AS encoding FROM documents")  # noqa: F541
def s04_detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    bom = F.unhex(F.element_at(F.array(*map(F.lit, _BOMS)), (F.col("doc_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", src.detect_encoding(F.concat(bom, F.encode("text", "UTF-8"))).alias("encoding"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&') AS resolved FROM pages")
def s06_resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.resolve_entities(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"WITH {TOKENS_SQL} SELECT page_id, pos, kind, tag, CASE WHEN kind = 'text' THEN raw END AS text, nullif(regexp_extract(CASE WHEN kind = 'text' THEN '' ELSE raw END, 'href\\s*=\\s*\"([^\"]*)\"', 1), '') AS href FROM tok")
def s08_tokenize_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tokens(spark, sf_dir).select("page_id", "pos", "kind", "tag", "text", F.try_element_at("attrs", F.lit("href")).alias("href"))


@query(
    f"WITH {TOKENS_SQL}, nx AS (SELECT *, lead(CASE WHEN kind = 'text' THEN raw END) OVER (PARTITION BY page_id ORDER BY pos) AS nt FROM tok) "
    "SELECT page_id, pos, 'href' AS what, regexp_extract(raw, 'href\\s*=\\s*\"([^\"]*)\"', 1) AS value FROM nx WHERE tag = 'a' AND kind = 'open' AND contains(raw, 'href') "
    "UNION ALL SELECT page_id, pos, 'text', nt FROM nx WHERE tag = 'h1' AND kind = 'open' AND nt IS NOT NULL"
)
def s09_select_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = page_tokens(spark, sf_dir)
    hrefs = tok.select_attribute(tokens, "page_id", "a", "href").select("page_id", "pos", F.lit("href").alias("what"), "value")
    heads = tok.select_text(tokens, "page_id", "h1").where("text is not null").select("page_id", "pos", F.lit("text").alias("what"), F.col("text").alias("value"))
    return hrefs.unionByName(heads)


@query("SELECT doc_id, length(text)::INT AS n_chars, sha256(text) AS content_sha256 FROM documents WHERE doc_id % 7 <> 0")
def s10_extract_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # base64 in lines of 76 as books carry it; every seventh is broken and must be dropped
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{76})", "$1\r\n ")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "@@@").otherwise(coded).alias("value"))
    found = src.decode_binaries(docs, "value")
    return found.select("doc_id", F.char_length(F.decode("content", "UTF-8")).alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


_ARTICLE_SQL = """art AS (SELECT * FROM (SELECT *, sum((tag = 'article' AND kind = 'open')::INT) OVER w AS so, sum((tag = 'article' AND kind = 'close')::INT) OVER w AS sc,
  lag(tag) OVER (PARTITION BY page_id ORDER BY pos) AS pt, lag(kind) OVER (PARTITION BY page_id ORDER BY pos) AS pk FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY pos))
  WHERE (so >= 1 AND sc = 0 AND NOT (tag = 'article' AND kind = 'open' AND so = 1)) OR (kind = 'text' AND sc = 1 AND pt = 'article' AND pk = 'close'))"""
FRAGMENT_SQL = f"""{_ARTICLE_SQL},
lnk AS (SELECT *, sum(CASE WHEN tag = 'a' AND kind = 'open' THEN 1 WHEN tag = 'a' AND kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS links FROM art),
frag AS (SELECT page_id, regexp_replace(string_agg(CASE WHEN kind = 'open' AND tag IN ('p', 'div') THEN chr(10) WHEN kind = 'text' AND links = 0 THEN raw END, '' ORDER BY pos), '^[{WS}]+|[{WS}]+$', '', 'g') AS fragment
  FROM lnk WHERE kind = 'open' AND tag IN ('p', 'div') OR kind = 'text' AND links = 0 GROUP BY page_id)"""


@query(f"WITH {TOKENS_SQL}, {FRAGMENT_SQL} SELECT page_id, fragment FROM frag")
def t01_text_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.text_fragment(page_tokens(spark, sf_dir), "page_id", "article")


@query(
    f"WITH f AS (SELECT page_id, regexp_replace(replace(replace(replace(html, chr(13), ''), '<p>', chr(10)), '</p>', ''), '<[^(><)]+>', '', 'g') AS t FROM pages) "
    f"SELECT page_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')), chr(10)) AS fragment FROM f"
)
def t02_full_text_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tok.full_text_fragment(F.col("html")).alias("fragment"))


_HTML_CLASS = "CASE tag " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in tok.HTML_CLASSES.items()) + " ELSE 'unknown' END"


@query(
    f"""WITH {TOKENS_SQL}, {DEPTH_SQL},
 nest AS (SELECT page_id, pos, tag, CASE WHEN {_LISTED} AND kind = 'open' THEN depth - 1 ELSE depth END AS around, CASE WHEN {_LISTED} AND kind = 'open' THEN depth END AS own FROM dep WHERE kind IN ('open', 'selfclose')),
 par AS (SELECT a.page_id, a.pos, a.tag, arg_max(b.tag, b.pos) AS parent FROM nest a LEFT JOIN nest b ON a.page_id = b.page_id AND b.own = a.around AND b.pos < a.pos GROUP BY ALL)
 SELECT page_id, pos, tag, {_HTML_CLASS} AS class, parent FROM par WHERE NOT ({_HTML_CLASS} = 'unknown' AND coalesce(parent IN ('body', 'section'), FALSE))"""
)
def c01_classify_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.classify_elements(page_tokens(spark, sf_dir), tok.HTML_CLASSES, "page_id")


@query(f"WITH {TOKENS_SQL}, {DEPTH_SQL} SELECT page_id, pos, tag, kind, depth, least(depth, 6) AS level FROM dep")
def c02_section_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.element_depth(page_tokens(spark, sf_dir), "page_id").select("page_id", "pos", "tag", "kind", "depth", "level")


# --- segmentation -----------------------------------------------------------------------------


def _sentences_sql(text: str) -> str:
    out = "CASE lang "
    for lang, words in tx.ABBREVIATIONS.items():
        marked = f"regexp_replace({text}, '([.!?…]+[{WS}]+)', '\\1' || chr(1), 'g')"
        joined = f"regexp_replace({marked}, '((?:^|[^\\p{{L}}])(?:{'|'.join(words)})\\.[{WS}]+)\\x01', '\\1', 'g')"
        out += f"WHEN '{lang}' THEN list_filter(string_split({joined}, chr(1)), lambda s: s <> '') "
    return out + f"ELSE list_filter([{text}], lambda s: s <> '') END"


SENTENCES_SQL = f"(SELECT doc_id, lang, para_ix, unnest(range(len(s)))::INT AS sent_ix, unnest(s) AS text FROM (SELECT doc_id, lang, para_ix, {_sentences_sql('text')} AS s FROM (SELECT doc_id, lang, unnest(range(len(p)))::INT AS para_ix, unnest(p) AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents))))"


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = seg.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return seg.sentences(paras, "doc_id", "para_ix")


def _with_abbreviations(column: str) -> str:
    return f"replace({column}, ', ', ' Dr. ')"


@query(f"SELECT doc_id, unnest(range(len(s)))::INT AS sent_ix, unnest(s) AS text FROM (SELECT doc_id, {_sentences_sql(_with_abbreviations('text'))} AS s FROM documents)")
def e01_split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(", "), F.lit(" Dr. ")))
    return seg.sentences(docs, "doc_id")


_LEARNING = "replace(replace(text, ', ', ' Dr. '), ' de ', ' z.B. ')"
_CORE = "regexp_replace({}, '^[^\\p{{L}}]+|[^\\p{{L}}.]+$', '', 'g')"
_BREAKS_SQL = f"""src AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang, {_LEARNING} AS text FROM documents),
wd AS (SELECT lang, unnest(ws) AS word, unnest(list_prepend('', ws)[1:len(ws)]) AS before FROM (SELECT lang, regexp_extract_all(text, '[^{WS}]+') AS ws FROM src WHERE lang <> 'xx')),
co AS (SELECT lang, {_CORE.format("word")} AS core, before FROM wd),
ty AS (SELECT lang, regexp_replace(lower(core), '\\.+$', '') AS type, core LIKE '%.' AND core NOT LIKE '%..' AS period, left(core, 1) <> lower(left(core, 1)) AS up, right(before, 1) IN ('.', '!', '?', '…') AS ended, before = '' AS first FROM co),
ct AS MATERIALIZED (SELECT lang, type, count(*) FILTER (period) AS n_with, count(*) FILTER (NOT period) AS n_without, count(*) FILTER (NOT up) AS n_lower, count(*) FILTER (up AND NOT ended AND NOT first) AS n_inner FROM ty WHERE type <> '' GROUP BY ALL),
tt AS (SELECT lang, sum(n_with + n_without)::DOUBLE AS n, sum(n_with)::DOUBLE AS p FROM ct GROUP BY lang),
sc AS (SELECT ct.*, length(replace(type, '.', '')) AS letters, length(type) - length(replace(type, '.', '')) AS inside,
  -2 * (n_with * ln(p / n) + CASE WHEN n_without > 0 THEN n_without * ln(1 - p / n) ELSE 0 END - n_with * ln({br.EXPECTED}) - n_without * ln(1 - {br.EXPECTED})) AS ratio FROM ct JOIN tt USING (lang) WHERE n_with > 0),
ab AS MATERIALIZED (SELECT lang, type, n_with, n_without FROM sc WHERE ratio * exp(-letters) * (inside + 1) * pow(letters::DOUBLE, -n_without::DOUBLE) >= {br.LEAST_SCORE}),
st AS MATERIALIZED (SELECT lang, type FROM ct WHERE n_lower > 0 AND n_inner = 0)"""


def _learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two abbreviations put in; of every tenth the language has no model."""
    lang = F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", lang.alias("lang"), F.replace(F.replace("text", F.lit(", "), F.lit(" Dr. ")), F.lit(" de "), F.lit(" z.B. ")).alias("text"))


@query(f"WITH {_BREAKS_SQL} SELECT lang, type, n_with, n_without FROM ab")
def e01_learned_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations of each language, learned from all documents."""
    return br.train_breaks(_learning(spark, sf_dir).where("lang <> 'xx'")).abbreviations.select("lang", "type", "n_with", "n_without")


@query(
    f"""WITH {_BREAKS_SQL}, pa AS (SELECT doc_id, CASE WHEN lang = 'xx' THEN 'en' ELSE lang END AS lang, list_filter(string_split(regexp_replace(text, '([.!?…]+[{WS}]+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM src),
 fr AS (SELECT doc_id, lang, unnest(parts) AS text, unnest(list_prepend('', parts)[1:len(parts)]) AS prev, unnest(range(len(parts))) AS ix FROM pa),
 f2 AS (SELECT doc_id, lang, text, ix, {_CORE.format(f"regexp_extract(prev, '([^{WS}]+)[{WS}]+$', 1)")} AS before, {_CORE.format(f"regexp_extract(text, '^[{WS}]*([^{WS}]+)', 1)")} AS head FROM fr),
 f3 AS (SELECT *, CASE WHEN before LIKE '%.' AND before NOT LIKE '%..' THEN regexp_replace(lower(before), '\\.+$', '') END AS a, CASE WHEN left(head, 1) <> lower(left(head, 1)) THEN regexp_replace(lower(head), '\\.+$', '') END AS s FROM f2),
 f4 AS (SELECT doc_id, text, ix, sum((ix = 0 OR ab.type IS NULL OR st.type IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY ix)::INT - 1 AS sent_ix FROM f3 LEFT JOIN ab ON ab.lang = f3.lang AND ab.type = a LEFT JOIN st ON st.lang = f3.lang AND st.type = s)
 SELECT doc_id, sent_ix, string_agg(text, '' ORDER BY ix) AS text FROM f4 GROUP BY ALL"""
)
def e01_learned_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the learned model; a language without one takes English's."""
    docs = _learning(spark, sf_dir)
    return br.learned_sentences(docs, br.train_breaks(docs.where("lang <> 'xx'")), "doc_id")


@query(f"SELECT doc_id, para_ix, sent_ix, unnest(range(len(w)))::INT AS word_ix, unnest(w) AS word FROM (SELECT *, regexp_split_to_array(text, '[{tx.WS_BREAKING}]') AS w FROM {SENTENCES_SQL})")
def e02_split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.words(document_sentences(spark, sf_dir), "doc_id", "para_ix", "sent_ix")


@query(
    f"SELECT doc_id, para_ix, sent_ix, 'kobo.' || dense_rank() OVER (PARTITION BY doc_id ORDER BY para_ix) || '.' || row_number() OVER (PARTITION BY doc_id, para_ix ORDER BY sent_ix) AS address FROM {SENTENCES_SQL}"
)
def e03_segment_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segment_addresses(document_sentences(spark, sf_dir), "doc_id").select("doc_id", "para_ix", "sent_ix", "address")


_PATTERN_VALUES = ", ".join(f"('{p}', {k}, {v})" for p, k, v in seg.pattern_rows())
_LONGEST = max(len(p) for p, _, _ in seg.pattern_rows())
_EXCEPTIONS = "CASE word " + " ".join(f"WHEN '{w}' THEN replace('{h}', '-', '-')" for w, h in seg.EXCEPTIONS.items()) + " END"


@query(
    f"""WITH pat(piece, place, value) AS (VALUES {_PATTERN_VALUES}),
 w AS MATERIALIZED (SELECT word, {_EXCEPTIONS} AS fixed, row_number() OVER (ORDER BY word) AS wid FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\n]+')) AS word FROM documents)),
 ch AS MATERIALIZED (SELECT wid, n, unnest(range(n + 2)) AS i, unnest(cs) AS c FROM (SELECT wid, length(word) AS n, list_filter(string_split('.' || word || '.', ''), lambda c: c <> '') AS cs FROM w WHERE length(word) > 2 AND fixed IS NULL)),
 nx AS MATERIALIZED (SELECT wid, n, i, c, {", ".join(f"lead(c, {k}) OVER w AS c{k}" for k in range(1, _LONGEST))} FROM ch WINDOW w AS (PARTITION BY wid ORDER BY i)),
 pc AS MATERIALIZED (SELECT wid, n, i, unnest([{", ".join(" || ".join(["c", *(f"c{j}" for j in range(1, k + 1))]) for k in range(_LONGEST))}]) AS piece FROM nx),
 v AS (SELECT wid, i + place - 1 AS after FROM pc JOIN pat USING (piece) WHERE i + place - 1 BETWEEN 2 AND n - 2 GROUP BY wid, after HAVING max(value) % 2 = 1),
 h AS (SELECT ch.wid, string_agg(c || CASE WHEN v.wid IS NOT NULL THEN '-' ELSE '' END, '' ORDER BY i) AS hyphenated FROM ch LEFT JOIN v ON v.wid = ch.wid AND v.after = ch.i WHERE ch.i BETWEEN 1 AND ch.n GROUP BY ch.wid)
 SELECT word, coalesce(fixed, h.hyphenated, word) AS hyphenated FROM w LEFT JOIN h USING (wid)"""
)
def e04_hyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([^ \n]+)"), F.lit(1))).alias("word"))
    return seg.hyphenate(words, hyphen="-")


#: Patterns and exceptions of our own by dictionary, and the tags by which books ask for them.
DICTIONARIES = {
    "en-us": (("1t2h", "n1t", "t1i", "1er.", "er1e", "1tion", "s1t", "4ed.", ".re3", "n1d"), ("there", "wi-th")),
    "de-1901": (("1sch", "ch1e", "s3t", "1ver", "ü1b", "n1g2", ".un3", "1keit."), ("schön", "ni-cht")),
    "fr": (("é1r", "1tion", "o1u", "1ment.", "l1l", "n3t"), ("et-re",)),
    "es": (("ó1n", "1ñ", "1ción", "l2l", "r1r", "e1s4."), ("que",)),
}
_TAGS = {"en": "EN", "de": "de-DE", "fr": "fr-CA", "es": "es"}
_TAG_SQL = "CASE WHEN doc_id % 10 = 0 THEN 'it' ELSE CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TAGS.items()) + " END END"
_DICTIONARY_OF = {"EN": "en-us", "de-DE": "de-1901", "fr-CA": "fr", "es": "es"}
_BY_DICTIONARY = [(name, *row) for name, (patterns, _) in DICTIONARIES.items() for row in seg.pattern_rows(patterns)]
_WIDEST = max(len(r[1]) for r in _BY_DICTIONARY)


@query(
    f"""WITH pat(dict, piece, place, value) AS (VALUES {", ".join(f"('{d}', '{p}', {k}, {v})" for d, p, k, v in _BY_DICTIONARY)}),
 ex(dict, word, fixed) AS (VALUES {", ".join(f"('{d}', '{w.replace('-', '')}', '{w}')" for d, (_, words) in DICTIONARIES.items() for w in words)}),
 di(lang, dict) AS (VALUES {", ".join(f"('{t}', '{d}')" for t, d in _DICTIONARY_OF.items())}),
 dw AS MATERIALIZED (SELECT DISTINCT {_TAG_SQL} AS lang, unnest(regexp_extract_all(text, '[^ \n]+')) AS word FROM documents),
 w AS MATERIALIZED (SELECT lang, word, di.dict, ex.fixed, row_number() OVER (ORDER BY lang, word) AS wid FROM dw LEFT JOIN di USING (lang) LEFT JOIN ex USING (dict, word)),
 ch AS MATERIALIZED (SELECT wid, dict, n, unnest(range(n + 2)) AS i, unnest(cs) AS c FROM (SELECT wid, dict, length(word) AS n, list_filter(string_split('.' || word || '.', ''), lambda c: c <> '') AS cs FROM w WHERE length(word) > 2 AND fixed IS NULL AND dict IS NOT NULL)),
 nx AS MATERIALIZED (SELECT wid, dict, n, i, c, {", ".join(f"lead(c, {k}) OVER w AS c{k}" for k in range(1, _WIDEST))} FROM ch WINDOW w AS (PARTITION BY wid ORDER BY i)),
 pc AS MATERIALIZED (SELECT wid, dict, n, i, unnest([{", ".join(" || ".join(["c", *(f"c{j}" for j in range(1, k + 1))]) for k in range(_WIDEST))}]) AS piece FROM nx),
 v AS (SELECT wid, i + place - 1 AS after FROM pc JOIN pat USING (dict, piece) WHERE i + place - 1 BETWEEN 2 AND n - 2 GROUP BY wid, after HAVING max(value) % 2 = 1),
 h AS (SELECT ch.wid, string_agg(c || CASE WHEN v.wid IS NOT NULL THEN '-' ELSE '' END, '' ORDER BY i) AS hyphenated FROM ch LEFT JOIN v ON v.wid = ch.wid AND v.after = ch.i WHERE ch.i BETWEEN 1 AND ch.n GROUP BY ch.wid)
 SELECT lang, word, coalesce(fixed, h.hyphenated, word) AS hyphenated FROM w LEFT JOIN h USING (wid)"""
)
def e04_hyphenate_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents in four languages, and one without a dictionary, each by its own; dictionaries are written as pattern files and read."""
    root = sinks.output_folder(spark, "dictionaries")
    for name, (patterns, exceptions) in DICTIONARIES.items():
        for suffix, lines in (("pat", patterns), ("hyp", exceptions)):
            sinks.write_text(spark, f"{root}/hyph-{name}.{suffix}.txt", "\n".join(lines))
    patterns, exceptions = seg.read_dictionaries(spark, root)
    tag = F.when(F.col("doc_id") % 10 == 0, "it")
    for lang, name in _TAGS.items():
        tag = tag.when(F.col("lang") == lang, name)
    words = table(spark, sf_dir, "documents").select(tag.alias("lang"), F.explode(F.regexp_extract_all("text", F.lit(r"([^ \n]+)"), F.lit(1))).alias("word"))
    return seg.hyphenate_books(words, patterns, exceptions, "-")


_AVAILABLE = ("en-us", "de-1901", "fr", "es", "de-1996")
_LANGS = "(['EN', 'de-AT', 'de', 'fr-CA', 'es', 'it'])[doc_id % 6 + 1]"


@query(
    f"""WITH m(tag, dict) AS (VALUES {", ".join(f"('{t}', '{d}')" for t, d in seg.DICTIONARY_NAMES.items())}), l AS (SELECT DISTINCT {_LANGS} AS lang FROM documents),
 c AS (SELECT lang, 0 AS rank, lower(lang) AS dict FROM l UNION ALL SELECT lang, 1, m.dict FROM l JOIN m ON m.tag = lower(lang) UNION ALL SELECT lang, 2, regexp_extract(lower(lang), '^([a-z]+)', 1) FROM l
  UNION ALL SELECT lang, 3, m.dict FROM l JOIN m ON m.tag = regexp_extract(lower(lang), '^([a-z]+)', 1))
 SELECT l.lang, arg_min(c.dict, c.rank) AS dictionary FROM l LEFT JOIN c ON c.lang = l.lang AND c.dict IN ('{"', '".join(_AVAILABLE)}') GROUP BY l.lang"""
)
def e05_hyphen_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select(F.element_at(F.array(*map(F.lit, ("EN", "de-AT", "de", "fr-CA", "es", "it"))), (F.col("doc_id") % 6 + 1).cast("int")).alias("lang"))
    return seg.hyphen_dictionary(langs, spark.createDataFrame([(d,) for d in _AVAILABLE], "dictionary string"))


@query(
    f"WITH f AS (SELECT doc_id, min(para_ix) AS para_ix FROM {LINES} WHERE text <> '' GROUP BY doc_id) "
    f"SELECT doc_id, para_ix, regexp_extract(regexp_extract(CASE WHEN doc_id % 2 = 0 THEN '«' || text ELSE text END, '^[^{tx.WS_BREAKING}]*', 0), '^[«\"]*[^«\"{WS}]', 0) AS drop_cap FROM f JOIN {LINES} l USING (doc_id, para_ix)"
)
def e06_drop_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = seg.paragraphs(table(spark, sf_dir, "documents"), "doc_id")
    quoted = paras.withColumn("text", F.when((F.col("doc_id") % 2 == 0) & (F.col("text") != ""), F.concat(F.lit("«"), "text")).otherwise(F.col("text")))
    return seg.drop_caps(quoted, "doc_id", '«"')


@query(f"SELECT doc_id, para_ix, sent_ix, length(text)::INT AS text_length FROM {SENTENCES_SQL}")
def e07_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(spark, sf_dir).select("doc_id", "para_ix", "sent_ix", tx.text_length(tx.split_words(F.col("text"))).alias("text_length"))


@query(f"SELECT doc_id, para_ix, sent_ix, regexp_replace(text, '[{tx.WS_BREAKING}]', ' ', 'g') AS joined FROM {SENTENCES_SQL}")
def e08_join_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(spark, sf_dir).select("doc_id", "para_ix", "sent_ix", tx.join_words(tx.split_words(F.col("text"))).alias("joined"))
