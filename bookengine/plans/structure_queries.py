"""Queries of chapters, pages, contents, aggregates and windows.

Synthetic books: a source is a book, its documents are sections in order of doc_id, level 1 + doc_id % 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookengine.functions import text as tx
from bookengine.operators import notes as nt
from bookengine.operators import packaging as pk
from bookengine.operators import pages as pg
from bookengine.operators import segment as seg
from bookengine.operators import structure as st
from bookengine.operators import tokens as tok
from bookengine.operators.blocks import block_size
from bookengine.plans.markup_queries import FRAGMENT_SQL, TOKENS_SQL, _sentences_sql, page_tokens
from bookengine.plans.registry import query, table
from bookengine.plans.scalar_queries import SQL_FIRST


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("book_id"), "doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("level"), tx.first_line(F.col("text")).alias("title"), F.char_length("text").cast("int").alias("text_length"), (F.col("doc_id") % 5 != 0).alias("has_title"))


SECTIONS_SQL = f"sec AS (SELECT source AS book_id, doc_id, (1 + doc_id % 3)::INT AS level, {SQL_FIRST} AS title, length(text)::INT AS text_length, doc_id % 5 <> 0 AS has_title FROM documents)"
CHAPTERS_SQL = f"""{SECTIONS_SQL}, cap AS (SELECT *, sum((rn = 1 OR level < 2)::INT) OVER (PARTITION BY book_id ORDER BY doc_id)::INT AS file_ix FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS rn FROM sec)),
chap AS (SELECT *, 'index' || file_ix AS fname FROM cap)"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.chapter_split(sections(spark, sf_dir), "book_id", "doc_id", 2)


@query(f"WITH {CHAPTERS_SQL} SELECT book_id, doc_id, level, file_ix, fname FROM chap")
def c04_chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters(spark, sf_dir).select("book_id", "doc_id", "level", "file_ix", "fname")


@query(
    f"WITH {SECTIONS_SQL}, d AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '* * *' ELSE title END AS subtitle, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS rn FROM sec) "
    "SELECT book_id, doc_id, sum((rn = 1 OR level < 1 OR subtitle = '* * *')::INT) OVER (PARTITION BY book_id ORDER BY doc_id)::INT AS file_ix FROM d"
)
def c05_split_on_subtitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = sections(spark, sf_dir).withColumn("subtitle", F.when(F.col("doc_id") % 4 == 0, "* * *").otherwise(F.col("title")))
    return st.chapter_split(marked, "book_id", "doc_id", 1, ("* * *",)).select("book_id", "doc_id", "file_ix")


_UNITS_SQL = f"flatten(list_transform({_sentences_sql('text')}, lambda s: list_transform(regexp_split_to_array(s, '[{tx.WS_BREAKING}]'), lambda w, i: length(w) + CASE WHEN i > 1 THEN 1 ELSE 0 END)))"
# the fold keeps 'chars;word;first;first:chars,...' in one string
_FOLD = f"""list_reduce(list_transform(u, lambda x: x::VARCHAR), lambda a, x: CASE WHEN split_part(a, ';', 1)::INT + x::INT >= {st.CHARS_PER_PAGE}
  THEN '0;' || (split_part(a, ';', 2)::INT + 1) || ';' || (split_part(a, ';', 2)::INT + 1) || ';' || split_part(a, ';', 4) || split_part(a, ';', 3) || ':' || (split_part(a, ';', 1)::INT + x::INT) || ','
  ELSE (split_part(a, ';', 1)::INT + x::INT) || ';' || (split_part(a, ';', 2)::INT + 1) || ';' || split_part(a, ';', 3) || ';' || split_part(a, ';', 4) END, '0;0;0;')"""


def pages_sql(rows: str, key: str) -> str:
    """Pages of rows (key, u: lengths)."""
    return f"""fold AS (SELECT {key}, {_FOLD} AS f FROM {rows}),
closed AS (SELECT {key}, list_filter(string_split(split_part(f, ';', 4) || CASE WHEN split_part(f, ';', 2)::INT > split_part(f, ';', 3)::INT THEN split_part(f, ';', 3) || ':' || split_part(f, ';', 1) ELSE '' END, ','), lambda x: x <> '') AS p FROM fold),
paged AS (SELECT {key}, page_no, split_part(x, ':', 1)::INT AS start_word, split_part(x, ':', 2)::INT AS n_chars FROM (SELECT {key}, unnest(range(len(p)))::INT AS page_no, unnest(p) AS x FROM closed))"""


PAGED_SQL = f"un AS (SELECT doc_id, {_UNITS_SQL} AS u FROM documents), {pages_sql('un', 'doc_id')}"


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.paginate(table(spark, sf_dir, "documents"), "doc_id", seg.units(F.col("text"), F.col("lang")))


@query(f"WITH {PAGED_SQL} SELECT doc_id, page_no, start_word, n_chars FROM paged")
def c06_paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir)


@query(
    """WITH p AS (SELECT doc_id, unnest(range(len(x)))::INT AS para_ix, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 l AS (SELECT doc_id, list((length(text) // 500)::VARCHAR ORDER BY para_ix) AS n FROM p GROUP BY doc_id),
 f AS (SELECT doc_id, list_reduce(n, lambda a, x: CASE WHEN split_part(a, ';', 1)::INT >= 2 THEN x || ';' || (split_part(a, ';', 2)::INT + 1) || ';' || split_part(a, ';', 3) || (split_part(a, ';', 2)::INT + 1) || ','
   ELSE (split_part(a, ';', 1)::INT + x::INT) || ';' || split_part(a, ';', 2) || ';' || split_part(a, ';', 3) || split_part(a, ';', 2) || ',' END, '0;0;') AS a FROM l)
 SELECT doc_id, unnest(range(len(z)))::INT AS para_ix, unnest(z)::INT AS file_ix FROM (SELECT doc_id, list_filter(string_split(split_part(a, ';', 3), ','), lambda x: x <> '') AS z FROM f)"""
)
def c07_split_by_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = seg.paragraphs(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "para_ix", F.floor(F.char_length("text") / 500).cast("int").alias("n_pages"))
    return st.split_by_pages(paras, "doc_id", 2)


def _greedy_sql(rows: str, limit: int) -> str:
    """Pages of rows (book_id, w from 0, u), one page of every book at a time."""
    return f"""cum AS (SELECT book_id, w, sum(u) OVER (PARTITION BY book_id ORDER BY w) AS upto FROM {rows}), whole AS (SELECT book_id, max(w) + 1 AS n, max(upto) AS total FROM cum GROUP BY book_id),
r AS (SELECT book_id, 0::BIGINT AS page_no, 0::BIGINT AS start_word, 0::HUGEINT AS before FROM whole
  UNION ALL SELECT r.book_id, r.page_no + 1, min(cum.w) + 1, min(cum.upto) FROM r JOIN cum ON cum.book_id IS NOT DISTINCT FROM r.book_id AND cum.upto >= r.before + {limit} GROUP BY r.book_id, r.page_no),
greedy AS (SELECT r.book_id, page_no, start_word, (coalesce(lead(before) OVER (PARTITION BY r.book_id ORDER BY page_no), total) - before)::BIGINT AS n_chars FROM r JOIN whole ON whole.book_id IS NOT DISTINCT FROM r.book_id WHERE start_word < n)"""


@query(
    f"WITH RECURSIVE un AS (SELECT source AS book_id, doc_id, {_UNITS_SQL} AS u FROM documents), flat AS (SELECT book_id, doc_id, unnest(u) AS u, unnest(range(len(u))) AS i FROM un), "
    f"words AS (SELECT book_id, u, row_number() OVER (PARTITION BY book_id ORDER BY doc_id, i) - 1 AS w FROM flat), {_greedy_sql('words', st.CHARS_PER_PAGE)} SELECT book_id, page_no, start_word, n_chars FROM greedy"
)
def c06_paginate_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source as one file, a run each: books with a third of all words."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", "text", "lang")
    return pg.paginate_runs(docs, "book_id", "doc_id", seg.units(F.col("text"), F.col("lang")))


@query(
    "WITH RECURSIVE paras AS (SELECT source AS book_id, doc_id, coalesce(length(text) // 500, 0) AS u, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS w FROM documents), "
    f"{_greedy_sql('paras', 20)} SELECT p.book_id, doc_id AS para_ix, max(page_no)::INT AS file_ix FROM paras p JOIN greedy g ON g.book_id IS NOT DISTINCT FROM p.book_id AND g.start_word <= p.w GROUP BY p.book_id, doc_id"
)
def c07_split_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as books, documents as their paragraphs, 20 pages a file."""
    docs = table(spark, sf_dir, "documents")
    n_pages = F.coalesce(F.floor(F.char_length("text") / 500), F.lit(0)).cast("int")
    return st.split_by_pages(docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("para_ix"), n_pages.alias("n_pages")), "book_id", 20, 1 << 14)


_FILES_SQL = f"{CHAPTERS_SQL}, files AS (SELECT book_id, file_ix, fname, (sum(text_length) // {st.CHARS_PER_PAGE})::INT AS n_pages, file_ix % 9 <> 0 AS in_spine FROM chap GROUP BY ALL)"


def chapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = chapters(spark, sf_dir).groupBy("book_id", "file_ix", "fname").agg(F.floor(F.sum("text_length") / st.CHARS_PER_PAGE).cast("int").alias("n_pages"))
    return grouped.withColumn("in_spine", F.col("file_ix") % 9 != 0)


@query(
    f"WITH {_FILES_SQL}, p AS (SELECT book_id, file_ix, fname, unnest(range(n_pages + 1)) AS page FROM files WHERE in_spine) "
    "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY file_ix, page) AS number, CASE WHEN page = 0 THEN fname ELSE fname || '#page_' || (page - 1) END AS href FROM p",
    number="INT"
)
def c08_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.page_map(chapter_files(spark, sf_dir), "book_id")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapters(spark, sf_dir).where("has_title").withColumns({"is_main": F.col("doc_id") % 7 != 0, "level": F.col("level") - 1})
    return rows.withColumn("body_name", F.when(F.col("is_main"), "").otherwise("notes"))


TOC_SQL = f"""{CHAPTERS_SQL}, ttl AS (SELECT book_id, doc_id, level - 1 AS level, title, fname, doc_id % 7 <> 0 AS is_main, CASE WHEN doc_id % 7 <> 0 THEN '' ELSE 'notes' END AS body_name FROM chap WHERE has_title),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, body_name, is_main ORDER BY doc_id) AS n FROM ttl) WHERE is_main OR n = 1),
toc AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS toc_ix, fname || '#tocref' || doc_id AS ref, replace(regexp_replace(title, '[\\[{{].*[\\]}}]', '', 'g'), chr(13), '') AS title, level, body_name, is_main FROM tk)"""


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.toc_entries(titles(spark, sf_dir), "book_id", "doc_id")


@query(f"WITH {TOC_SQL} SELECT book_id, toc_ix, ref, title, level, body_name, is_main FROM toc", toc_ix="INT")
def c09_toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc(spark, sf_dir)


@query(f"WITH {TOC_SQL} SELECT book_id, toc_ix, title, level FROM toc WHERE NOT (is_main AND level = 0 AND book_id LIKE '%1') UNION ALL SELECT DISTINCT source, 0, 'Ann ' || source || ' ' || source, 0 FROM documents WHERE source LIKE '%1' OR source NOT IN (SELECT book_id FROM toc WHERE is_main AND level = 0)")
def c10_implied_body_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id")).distinct()
    # books whose name ends in 1 lose their own titles of level 0
    entries = toc(spark, sf_dir).where("NOT (is_main AND level = 0 AND book_id LIKE '%1')")
    found = st.implied_body_title(books, entries, "book_id", F.concat(F.lit("Ann "), F.col("book_id")), F.col("book_id"))
    return found.select("book_id", F.col("toc_ix").cast("long").alias("toc_ix"), "title", "level")


@query(f"WITH {CHAPTERS_SQL} SELECT book_id, doc_id, file_ix::VARCHAR AS title, level FROM chap WHERE NOT has_title AND text_length > 0")
def c11_untitled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.untitled_sections(chapters(spark, sf_dir), "book_id", "doc_id")


_ENDS = f"{SECTIONS_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS end_pos FROM sec), f AS (SELECT *, lead(end_pos) OVER (PARTITION BY book_id ORDER BY end_pos) AS nx FROM e WHERE has_title AND text_length > 0)"


@query(f"WITH {_ENDS} SELECT book_id, doc_id, end_pos FROM f WHERE nx IS NULL OR nx > end_pos + 1", end_pos="INT")
def c12_chapter_end_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = sections(spark, sf_dir).withColumn("end_pos", F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id")))
    return st.chapter_end_marks(ends, "book_id", "doc_id")


@query(f"WITH {TOC_SQL} SELECT book_id, toc_ix, ref, CASE WHEN level = 0 THEN 'Book ' || book_id ELSE replace(title, chr(10), ' ') END AS title, (CASE WHEN is_main THEN level ELSE 0 END)::INT AS indent FROM toc WHERE NOT is_main OR level <= 1", toc_ix="INT")
def c13_toc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.toc_page(toc(spark, sf_dir), "book_id", 1, F.concat(F.lit("Book "), F.col("book_id")))


@query(f"WITH {TOC_SQL} SELECT book_id, toc_ix, NULL::INT AS parent_ix FROM toc", toc_ix="INT")
def c14_toc_tree_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.toc_tree(toc(spark, sf_dir), "book_id", "flat")


#: (level under which a first descent leaves the top entry, open entries beyond which a descent stays flat) of the stack machine.
_STACKS = {"normal": (2, 1 << 30), "kindle": (2, 1)}


def _tree_sql(kind: str, rows: str = TOC_SQL) -> str:
    """The stack machine as a recursive query: one entry of every book at a time."""
    limit, most = _STACKS[kind]
    less, outer = "stack[1:len(stack) - 1]", "stack[1:coalesce(list_max(list_transform(range(1, len(stack) + 1), lambda i: CASE WHEN stack[i].level < e.level THEN i END)), 0)]"
    return f"""WITH RECURSIVE {rows}, e AS (SELECT book_id, toc_ix::INT AS toc_ix, level::INT AS level, row_number() OVER (PARTITION BY book_id ORDER BY toc_ix) AS n FROM toc),
 r AS (SELECT book_id, 0::BIGINT AS n, NULL::INT AS last, []::STRUCT(level INT, toc_ix INT)[] AS stack, NULL::INT AS toc_ix, NULL::INT AS parent_ix FROM (SELECT DISTINCT book_id FROM e)
  UNION ALL SELECT book_id, n, level, list_append(rest, {{'level': level, 'toc_ix': toc_ix}}), toc_ix, CASE WHEN len(rest) > 0 THEN rest[len(rest)].toc_ix END
  FROM (SELECT e.*, CASE WHEN last IS NULL THEN stack WHEN last < e.level THEN CASE WHEN e.level < {limit} OR len(stack) > {most} THEN {less} ELSE stack END WHEN last = e.level THEN {less} ELSE {outer} END AS rest
        FROM r JOIN e ON e.book_id = r.book_id AND e.n = r.n + 1))
 SELECT book_id, toc_ix, parent_ix FROM r WHERE n > 0"""


@query(_tree_sql("normal"))
def c14_toc_tree_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.toc_tree(toc(spark, sf_dir), "book_id", "normal", range(3))


@query(_tree_sql("kindle"))
def c14_toc_tree_kindle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.toc_tree(toc(spark, sf_dir), "book_id", "kindle", range(3))


_ONE_TITLE = "toc AS (SELECT source AS book_id, doc_id AS toc_ix, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source) THEN 0 ELSE 1 + length(text) % 5 END AS level FROM documents WHERE text IS NOT NULL)"


@query(_tree_sql("normal", _ONE_TITLE))
def c14_one_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as they mostly are: the title is the only entry of level 0, and all documents of the source hang under it or beside it."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("source").alias("book_id"), F.col("doc_id").alias("toc_ix"), (1 + F.char_length("text") % 5).alias("level"))
    titles = docs.groupBy("book_id").agg(F.min("toc_ix").alias("toc_ix")).select("toc_ix", F.lit(0).alias("_title"))
    entries = docs.join(titles, "toc_ix", "left").select("book_id", "toc_ix", F.coalesce("_title", "level").alias("level"))
    return st.toc_tree(entries, "book_id", "normal", range(6), block_size(docs, "toc_ix"))


@query(f"WITH {TOC_SQL} SELECT book_id, toc_ix + 1 AS play_order, title, 'before' AS placement FROM toc UNION ALL SELECT DISTINCT book_id, 1, 'Contents', 'before' FROM toc UNION ALL SELECT book_id, toc_ix, title, 'after' FROM toc UNION ALL SELECT book_id, max(toc_ix) + 1, 'Contents', 'after' FROM toc GROUP BY book_id", play_order="INT")
def c15_play_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = toc(spark, sf_dir)
    return st.play_order(entries, "book_id", "before").withColumn("placement", F.lit("before")).unionByName(st.play_order(entries, "book_id", "after").withColumn("placement", F.lit("after")))


KINDS_SQL = f"{_FILES_SQL}, fk AS (SELECT book_id, file_ix, fname, CASE file_ix WHEN 2 THEN 'toc' WHEN 3 THEN 'annotation' WHEN 4 THEN 'cover' ELSE 'text' END AS kind FROM files)"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("file_ix") == 2, "toc").when(F.col("file_ix") == 3, "annotation").when(F.col("file_ix") == 4, "cover").otherwise("text")
    return chapter_files(spark, sf_dir).select("book_id", "file_ix", "fname", kind.alias("kind"))


@query(
    f"WITH {KINDS_SQL} SELECT book_id, file_ix, kind, row_number() OVER (PARTITION BY book_id ORDER BY list_position(['cover', 'toc', 'annotation', 'text'], kind), file_ix) AS place, 'before' AS placement FROM fk "
    "UNION ALL SELECT book_id, file_ix, kind, row_number() OVER (PARTITION BY book_id ORDER BY list_position(['cover', 'annotation', 'text', 'toc'], kind), file_ix), 'after' FROM fk",
    place="INT"
)
def c16_file_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = kinds(spark, sf_dir)
    out = None
    for placement in ("before", "after"):
        rows = st.file_placement(files, "book_id", placement).select("book_id", "file_ix", "kind", "place", F.lit(placement).alias("placement"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {SECTIONS_SQL} SELECT book_id, doc_id, CASE WHEN row_number() OVER (PARTITION BY book_id ORDER BY doc_id) = 1 THEN 'main' WHEN doc_id % 3 = 1 THEN 'notes' ELSE 'named' END AS kind FROM sec")
def c03_body_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 1, "NOTES").when(F.col("doc_id") % 3 == 2, "afterword")
    bodies = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", F.col("doc_id").alias("body_ix"), name.alias("body_name"))
    return st.body_kind(bodies, "book_id").select("book_id", "doc_id", "kind")


# --- aggregates, windows, orders, unions ------------------------------------------------------


@query("SELECT source AS book_id, count(*) AS notes_per_book, count(DISTINCT doc_id % 3) AS note_bodies, count(*) FILTER (doc_id % 3 = 0) AS first_body FROM documents GROUP BY source")
def g01_notes_per_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.concat(F.lit("body"), (F.col("doc_id") % 3).cast("string")).alias("body_name"))
    return nt.notes_per_body(notes, "book_id", "body_name", "body0")


@query(f"WITH {SECTIONS_SQL} SELECT book_id, level, sum(text_length)::BIGINT AS text_length, bool_or(text_length > 0) AS has_text FROM sec GROUP BY ALL")
def g02_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.section_lengths(sections(spark, sf_dir), "book_id")


@query(f"WITH {PAGED_SQL} SELECT source AS book_id, count(*) AS pages, count(DISTINCT doc_id) AS files FROM paged JOIN documents USING (doc_id) GROUP BY source")
def g03_pages_per_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book_id"))
    return st.pages_per_book(document_pages(spark, sf_dir), files, "book_id", "doc_id")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'skipped' WHEN l.quality = 0 THEN 'failed' ELSE 'processed' END AS status, count(*) AS books FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def g04_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") != 0).alias("ok"))
    return pk.run_counters(table(spark, sf_dir, "documents"), results, "doc_id")


@query("SELECT doc_id, 'Ann ' || source || CASE WHEN doc_id % 3 <> 0 THEN ', Carl Dee' ELSE '' END AS all_authors, 'Ann ' || source || CASE WHEN doc_id % 3 <> 0 THEN CASE lang WHEN 'de' THEN ' и др' ELSE ', et al' END ELSE '' END AS short FROM documents")
def g05_author_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bookengine.functions import formats as fmt
    from bookengine.plans.scalar_queries import books

    b = books(spark, sf_dir).withColumn("lang", F.when(F.col("lang") == "de", "ru").otherwise(F.col("lang")))
    return b.select("doc_id", fmt.author_string(b, "#f #l").alias("all_authors"), fmt.author_string(b, "#f #l", short=True).alias("short"))


@query("SELECT min(doc_id) AS doc_id, source AS book_id, md5(text) AS image_id FROM documents GROUP BY source, md5(text)")
def w01_first_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bookengine.operators.links import first_of

    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book_id"), F.md5(F.encode("text", "UTF-8")).alias("image_id"))
    return first_of(rows, ["book_id", "image_id"], "doc_id")


@query(f"WITH {SECTIONS_SQL} SELECT book_id, doc_id, row_number() OVER w AS section_no, sum(text_length) OVER w::BIGINT AS chars_so_far, last_value(CASE WHEN has_title THEN title END IGNORE NULLS) OVER w AS latest_title FROM sec WINDOW w AS (PARTITION BY book_id ORDER BY doc_id)".replace("OVER w::BIGINT", "OVER w"), section_no="INT", chars_so_far="BIGINT")
def w02_running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.running_counters(sections(spark, sf_dir), "book_id", "doc_id")


_NUMBERED_SQL = """numb AS (SELECT source AS book_id, 'body' || doc_id % 3 AS body_name, doc_id, row_number() OVER (PARTITION BY source, doc_id % 3 ORDER BY doc_id) AS note_number FROM documents),
bods AS (SELECT book_id, body_name, CASE WHEN count(*) OVER (PARTITION BY book_id) > 1 THEN row_number() OVER (PARTITION BY book_id ORDER BY min(doc_id)) ELSE 0 END AS body_number FROM numb GROUP BY book_id, body_name)"""


@query(f"WITH {_NUMBERED_SQL} SELECT book_id, body_name, doc_id, note_number, body_number FROM numb JOIN bods USING (book_id, body_name)", note_number="INT", body_number="INT")
def w03_note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bookengine.operators.notes import number_notes

    notes = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.concat(F.lit("body"), (F.col("doc_id") % 3).cast("string")).alias("body_name"), "doc_id")
    return number_notes(notes, "book_id", "body_name", "doc_id")


@query(f"WITH {CHAPTERS_SQL} SELECT book_id, fname, row_number() OVER (PARTITION BY book_id ORDER BY length(fname) DESC, fname) AS place FROM (SELECT DISTINCT book_id, fname FROM chap)", place="INT")
def o01_longest_key_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.longest_first(chapters(spark, sf_dir), "book_id", "fname")


@query(f"WITH {KINDS_SQL} SELECT book_id, arg_min(fname, file_ix) AS first_text FROM fk WHERE kind = 'text' AND file_ix > 1 GROUP BY book_id")
def o02_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.first_file(kinds(spark, sf_dir), "book_id", "text", after=1)


@query("SELECT source AS book_id, doc_id::VARCHAR AS name, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT regexp_extract(url, '^https?://([^/]*)', 1), page_id::VARCHAR, NULL, url FROM pages")
def u01_concat_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("name"), "lang")
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("book_id"), F.col("page_id").cast("string").alias("name"), "url")
    return pk.concat_lists(docs, pages)


# --- one query end to end ---------------------------------------------------------------------

_PROFILE_UNITS = f"list_transform(regexp_split_to_array(s, '[{tx.WS_BREAKING}]'), lambda w, i: length(w) + CASE WHEN i > 1 THEN 1 ELSE 0 END)"


@query(
    f"""WITH {TOKENS_SQL}, {FRAGMENT_SQL}, lg AS (SELECT page_id, fragment AS text, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM frag JOIN pages USING (page_id)),
 sp AS (SELECT page_id, title, {_sentences_sql('text')} AS ss FROM lg), uu AS (SELECT page_id, title, len(ss)::INT AS n_sentences, flatten(list_transform(ss, lambda s: {_PROFILE_UNITS})) AS u FROM sp),
 {pages_sql('uu', 'page_id')} SELECT page_id, title, n_sentences, len(u)::INT AS n_words, (SELECT count(*) FROM paged WHERE paged.page_id = uu.page_id)::INT AS n_pages FROM uu"""
)
def flagship_page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages to articles, sentences, words and book pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    article = tok.text_fragment(page_tokens(spark, sf_dir), "page_id", "article").join(pages, "page_id")
    text, lang = F.col("fragment"), F.col("lang")
    found = article.select("page_id", "title", F.size(tx.split_sentences(text, lang)).alias("n_sentences"), seg.units(text, lang).alias("units"))
    return found.select("page_id", "title", "n_sentences", F.size("units").alias("n_words"), F.size(st.page_starts(F.col("units"))).alias("n_pages"))
