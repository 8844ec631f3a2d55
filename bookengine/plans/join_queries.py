"""Queries of note references and placement, links, images, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookengine.functions import text as tx
from bookengine.operators import links as ln
from bookengine.operators import notes as nt
from bookengine.operators import tokens as tok
from bookengine.plans.markup_queries import TOKENS_SQL, page_tokens
from bookengine.plans.registry import query, table
from bookengine.plans.scalar_queries import SQL_FIRST
from bookengine.plans.structure_queries import _NUMBERED_SQL

# Document d refers to note d % 250 in paragraph d // 3 of its source; notes are the benchmark items.


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("book_id"), "doc_id", F.col("doc_id").alias("pos"), F.floor(F.col("doc_id") / 3).cast("long").alias("para_ix"), (F.col("doc_id") % 250).alias("note_id"), F.concat(F.lit("ref"), F.col("doc_id").cast("string")).alias("ref"), tx.first_line(F.col("text")).alias("ref_text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("note_id"), F.col("item_id").cast("string").alias("title"), F.col("text").alias("body"))


REFS_SQL = f"refs AS (SELECT source AS book_id, doc_id, doc_id AS pos, doc_id // 3 AS para_ix, doc_id % 250 AS note_id, 'ref' || doc_id AS ref, {SQL_FIRST} AS ref_text FROM documents), notes AS (SELECT item_id AS note_id, item_id::VARCHAR AS title, text AS body FROM benchmark)"


@query(f"WITH {REFS_SQL} SELECT doc_id, note_id, CASE WHEN body IS NULL THEN 'linkanchor' ELSE 'noteanchor' END AS class, CASE WHEN body IS NOT NULL THEN 'noteanchor' END AS inline_class, body FROM refs LEFT JOIN notes USING (note_id)")
def j01_note_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nt.resolve_references(references(spark, sf_dir), notes(spark, sf_dir), ["note_id"])
    inline = nt.resolve_references(found.withColumnRenamed("class", "default_class").drop("title", "body"), notes(spark, sf_dir), ["note_id"], "inline")
    return inline.select("doc_id", "note_id", F.col("default_class").alias("class"), F.col("class").alias("inline_class"), "body")


_PATH_SQL = "regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1)"


@query(
    f"WITH {TOKENS_SQL}, l AS (SELECT page_id, pos, '#' || regexp_extract(raw, 'href\\s*=\\s*\"/([^\"]*)\"', 1) AS href FROM tok WHERE tag = 'a' AND kind = 'open'), an AS (SELECT DISTINCT page_id, pos % 3 = 0 AS known, href FROM l) "
    "SELECT l.page_id, l.pos, l.href, CASE WHEN a.id IS NOT NULL THEN 'file' || (l.page_id % 4) || substr(l.href, 1, 1) || a.id ELSE l.href END AS resolved FROM l "
    "LEFT JOIN (SELECT page_id, substr(href, 2) AS id FROM l GROUP BY ALL HAVING length(substr(href, 2)) % 2 = 0) a ON a.page_id = l.page_id AND a.id = substr(l.href, 2)"
)
def j02_resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = tok.select_attribute(page_tokens(spark, sf_dir), "page_id", "a", "href")
    local = hrefs.select("page_id", "pos", F.concat(F.lit("#"), F.regexp_extract("value", "^/(.*)$", 1)).alias("href"))
    # ids of even length are anchors of the page
    ids = local.select("page_id", F.substring("href", F.lit(2), F.char_length("href")).alias("anchor_id")).distinct().where(F.char_length("anchor_id") % 2 == 0)
    anchors = ids.withColumn("file", F.concat(F.lit("file"), (F.col("page_id") % 4).cast("string")))
    return ln.resolve_links(local, anchors, ["page_id"]).select("page_id", "pos", "href", "resolved")


_IMAGES_SQL = "images AS (SELECT source AS book_id, 'img' || doc_id % 10 AS image_id, doc_id AS image_ix, 'bin' || doc_id AS image_file FROM documents), uniq AS (SELECT book_id, image_id, arg_min(image_file, image_ix) AS image_file FROM images GROUP BY ALL)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.concat(F.lit("img"), (F.col("doc_id") % 10).cast("string")).alias("image_id"), F.col("doc_id").alias("image_ix"), F.concat(F.lit("bin"), F.col("doc_id").cast("string")).alias("image_file"))


@query(f"WITH {_IMAGES_SQL} SELECT d.doc_id, u.image_id IS NOT NULL AS found, coalesce(u.image_file, '{ln.NOT_FOUND}') AS image_file FROM documents d LEFT JOIN uniq u ON u.book_id = d.source AND u.image_id = 'img' || d.doc_id % 13")
def j03_resolve_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book_id"), F.concat(F.lit("img"), (F.col("doc_id") % 13).cast("string")).alias("image_id"))
    found = ln.resolve_images(refs, images(spark, sf_dir).drop("image_ix").withColumn("image_ix", F.regexp_extract("image_file", "([0-9]+)", 1).cast("long")), ["book_id", "image_id"], "image_ix")
    return found.select("doc_id", F.col("image_ix").isNotNull().alias("found"), "image_file")


@query(
    f"WITH {_IMAGES_SQL}, b AS (SELECT DISTINCT source AS book_id, CASE WHEN length(source) = 4 THEN '' ELSE 'img' || ascii(substr(source, 5, 1)) % 13 END AS cover_ref FROM documents) "
    "SELECT b.book_id, b.cover_ref, CASE WHEN u.image_file IS NOT NULL THEN u.image_file WHEN b.cover_ref = '' THEN 'default-cover' END AS cover_file FROM b LEFT JOIN uniq u ON u.book_id = b.book_id AND u.image_id = b.cover_ref"
)
def j04_resolve_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = F.when(F.char_length("source") == 4, "").otherwise(F.concat(F.lit("img"), (F.ascii(F.substring("source", 5, 1)) % 13).cast("string")))
    books = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), cover.alias("cover_ref")).distinct()
    return ln.resolve_cover(books, images(spark, sf_dir), "book_id", "image_ix", default_cover=True)


#: Override rows: name, title, lang, asin. Fixed values of the query.
OVERRIDES = (("en/25", "Exact suffix", "", "B000000001"), ("25", "Short suffix", "xx", ""), ("10", "Ten", "", "bad"), ("*", "", "any", "B00STAR000"))


@query(
    f"""WITH o(name, title, lang, asin) AS (VALUES {", ".join(map(str, OVERRIDES))}), b AS (SELECT page_id, 'Page ' || page_id AS title, '' AS lang, '' AS asin, ltrim({_PATH_SQL}, '/') AS path FROM pages),
 s AS (SELECT page_id, unnest(range(len(p))) AS rank, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '/'))) AS name FROM (SELECT page_id, string_split(path, '/') AS p FROM b)),
 a AS (SELECT * FROM s UNION ALL SELECT page_id, 1000, '*' FROM b),
 m AS (SELECT page_id, arg_min({{'title': o.title, 'lang': o.lang, 'asin': CASE WHEN regexp_matches(o.asin, '^[A-Za-z0-9]{{10}}$') THEN o.asin END}}, rank) AS r FROM a JOIN o USING (name) GROUP BY page_id)
 SELECT page_id, coalesce(nullif(r.title, ''), title) AS title, coalesce(nullif(r.lang, ''), lang) AS lang, coalesce(nullif(r.asin, ''), asin) AS asin FROM b LEFT JOIN m USING (page_id)"""
)
def j05_apply_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.ltrim(F.regexp_extract("url", "^https?://[^/]*(/[^?#]*)", 1), F.lit("/"))
    books = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), F.lit("").alias("lang"), F.lit("").alias("asin"), path.alias("path"))
    overrides = spark.createDataFrame(OVERRIDES, "name string, title string, lang string, asin string")
    return ln.apply_overwrites(books, overrides, "page_id", "path", ("title", "lang", "asin")).drop("path")


@query(
    "WITH n AS (SELECT conv_id, turn, role AS body_name FROM conversations), t AS (SELECT DISTINCT conv_id, role AS body_name, 'Notes of ' || conv_id AS body_title FROM conversations WHERE role = 'user' AND conv_id % 2 = 0) "
    "SELECT n.conv_id, n.turn, coalesce(t.body_title, upper(left(n.body_name, 1)) || substr(n.body_name, 2)) AS body_title FROM n LEFT JOIN t USING (conv_id, body_name)"
)
def j06_body_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("body_name"))
    titles = conv.where("body_name = 'user' AND conv_id % 2 = 0").select("conv_id", "body_name", F.concat(F.lit("Notes of "), F.col("conv_id").cast("string")).alias("body_title")).distinct()
    return nt.body_titles(conv, titles, ["conv_id", "body_name"]).select("conv_id", "turn", "body_title")


#: Vignette rows: level, key, image. Fixed values of the query.
VIGNETTES = (("default", "before", "d-before"), ("default", "after", "d-after"), ("1", "before", "one-before"), ("2", "after", "NONE"))


@query(
    f"WITH v(level, key, image) AS (VALUES {', '.join(map(str, VIGNETTES))}), p AS (SELECT doc_id, (1 + doc_id % 3)::VARCHAR AS level, CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE 'after' END AS key FROM documents) "
    "SELECT p.doc_id, p.level, p.key, CASE WHEN lower(coalesce(a.image, b.image)) <> 'none' THEN coalesce(a.image, b.image) END AS image FROM p LEFT JOIN v a ON a.level = p.level AND a.key = p.key LEFT JOIN v b ON b.level = 'default' AND b.key = p.key"
)
def j07_resolve_vignettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "documents").select("doc_id", (1 + F.col("doc_id") % 3).cast("string").alias("level"), F.when(F.col("doc_id") % 2 == 0, "before").otherwise("after").alias("key"))
    return ln.resolve_vignettes(places, spark.createDataFrame(VIGNETTES, "level string, key string, image string")).select("doc_id", "level", "key", "image")


@query(f"WITH {REFS_SQL} SELECT 'dangling' AS problem, doc_id AS id FROM refs ANTI JOIN notes USING (note_id) UNION ALL SELECT 'unreferenced', note_id FROM (SELECT note_id * 7 AS note_id FROM notes) n ANTI JOIN refs USING (note_id)")
def j08_link_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    lost = nt.dangling(refs, notes(spark, sf_dir), ["note_id"]).select(F.lit("dangling").alias("problem"), F.col("doc_id").alias("id"))
    spread = notes(spark, sf_dir).withColumn("note_id", F.col("note_id") * 7)
    return lost.unionByName(nt.unreferenced(spread, refs, ["note_id"]).select(F.lit("unreferenced").alias("problem"), F.col("note_id").alias("id")))


@query(f"WITH {REFS_SQL}, n7 AS (SELECT note_id * 7 AS note_id FROM notes) SELECT note_id, coalesce(arg_max(ref, pos), 'nowhere') AS back_ref FROM n7 LEFT JOIN refs USING (note_id) GROUP BY note_id")
def j09_back_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = notes(spark, sf_dir).select((F.col("note_id") * 7).alias("note_id"))
    return nt.back_links(spread, references(spark, sf_dir), ["note_id"]).select("note_id", "back_ref")


_CSS_SQL = "'@font-face { src: url(\"' || source || '.ttf\"); } p { background: url(\"img' || doc_id % 5 || '.png\"); }'"


@query(
    f"WITH r AS (SELECT source || '.ttf' AS href, 'fonts/' || source AS target FROM documents WHERE source LIKE '%1' GROUP BY source UNION ALL SELECT 'img2.png', 'images/two'), u AS (SELECT doc_id, unnest(range(len(x)))::INT AS pos, unnest(x) AS href FROM (SELECT doc_id, regexp_extract_all({_CSS_SQL}, 'url\\(\"([^\"]*)\"\\)', 1) AS x FROM documents)) "
    "SELECT doc_id, pos, href, target FROM u LEFT JOIN r USING (href)"
)
def j10_stylesheet_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    css = F.concat(F.lit('@font-face { src: url("'), "source", F.lit('.ttf"); } p { background: url("img'), (F.col("doc_id") % 5).cast("string"), F.lit('.png"); }'))
    fonts = docs.where("source LIKE '%1'").select(F.concat("source", F.lit(".ttf")).alias("href"), F.concat(F.lit("fonts/"), "source").alias("target")).distinct()
    resources = fonts.unionByName(spark.createDataFrame([("img2.png", "images/two")], "href string, target string"))
    return ln.stylesheet_references(docs.select("doc_id", css.alias("css")), resources, "doc_id").select("doc_id", "pos", "href", "target")


@query(f"WITH {REFS_SQL} SELECT doc_id, ref_text || CASE WHEN body IS NOT NULL THEN ' [' || body || ']' ELSE '' END AS text FROM refs LEFT JOIN notes USING (note_id)")
def m02_inline_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.inline_notes(references(spark, sf_dir), notes(spark, sf_dir), ["note_id"]).select("doc_id", "text")


@query(f"WITH {REFS_SQL} SELECT book_id, para_ix, string_agg(title || ') ' || body, chr(10) ORDER BY pos) AS block FROM refs JOIN notes USING (note_id) GROUP BY book_id, para_ix")
def m03_block_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.block_notes(references(spark, sf_dir), notes(spark, sf_dir), ["note_id"], ["book_id", "para_ix"])


@query(
    f"WITH {REFS_SQL}, n7 AS (SELECT note_id * 7 AS note_id, body FROM notes), b AS (SELECT note_id, arg_max(ref, pos) AS ref FROM refs GROUP BY note_id) "
    "SELECT note_id, coalesce(ref, 'nowhere') AS back_ref, CASE WHEN len(list_filter(string_split(body, chr(10)), lambda p: p <> '')) > 1 THEN split_part(body, chr(10), 1) || ' (…etc.)' ELSE body END AS text FROM n7 LEFT JOIN b USING (note_id)"
)
def m04_floating_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = notes(spark, sf_dir).withColumn("note_id", F.col("note_id") * 7)
    return nt.floating_notes(spread, references(spark, sf_dir), ["note_id"]).select("note_id", "back_ref", "text")


@query(f"WITH {_NUMBERED_SQL} SELECT book_id, doc_id, CASE WHEN body_number > 0 THEN body_number || '.' ELSE '' END || note_number || ' ' || body_name || 'B' AS label FROM numb JOIN bods USING (book_id, body_name)")
def m05_renumber_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.concat(F.lit("body"), (F.col("doc_id") % 3).cast("string")).alias("body_name"), "doc_id")
    numbered = nt.number_notes(rows, "book_id", "body_name", "doc_id")
    return nt.renumber_notes(numbered, "{#body_number.}#number #body_name#body_name_FL").select("book_id", "doc_id", "label")
