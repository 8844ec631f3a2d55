"""Chapters, pages and tables of contents.

Running counters are windows over one book or file, in document order; rules that reset depend on what was
overshot before and are folds over an array of lengths, never over texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookengine.functions import text as tx
from bookengine.operators.blocks import last_before, last_values_before, row_numbers, running_sums
from bookengine.operators.pages import CHARS_PER_PAGE, page_of_runs


def _ordered(key: str, by: str) -> Window:
    return Window.partitionBy(key).orderBy(by)


def chapter_split(sections: DataFrame, key: str, by: str, chapter_level: int, dividers: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """``file_ix`` and ``fname``: a file starts at the book's first section, at each section shallower than the level, and at each subtitle that is a divider.

    ``size``, here and below: windows in blocks of so many positions, where a book may be large (see ``blocks.block_size``).
    """
    starts = (F.col("_n") == 1) | (F.col("level") < chapter_level)
    if dividers:
        starts = starts | F.coalesce(F.col("subtitle").isin(*dividers), F.lit(False))
    numbered = row_numbers(sections, [key], by, "_n", size)
    filed = running_sums(numbered, [key], by, {"file_ix": F.when(starts, 1).otherwise(0)}, size).drop("_n")
    return filed.withColumn("file_ix", F.col("file_ix").cast("int")).withColumn("fname", F.concat(F.lit("index"), F.col("file_ix").cast("string")))


def page_starts(units: Column, limit: int = CHARS_PER_PAGE) -> Column:
    """Pages of a file as array of (start_word, n_chars). A page closes after the word that reaches the limit; what is over is not carried."""
    page = "struct<start_word:int,n_chars:int>"
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("word"), F.lit(0).alias("first"), F.array().cast(f"array<{page}>").alias("pages"))

    def step(acc: Column, unit: Column) -> Column:
        chars, word = acc["chars"] + unit, acc["word"] + 1
        full = chars >= limit
        closed = F.array_append(acc["pages"], F.struct(acc["first"].alias("start_word"), chars.alias("n_chars")))
        return F.struct(F.when(full, 0).otherwise(chars).alias("chars"), word.alias("word"), F.when(full, word).otherwise(acc["first"]).alias("first"), F.when(full, closed).otherwise(acc["pages"]).alias("pages"))

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["first"].alias("start_word"), acc["chars"].alias("n_chars"))
        return F.when(acc["word"] > acc["first"], F.array_append(acc["pages"], rest)).otherwise(acc["pages"])

    return F.aggregate(units, start, step, finish)


def paginate(files: DataFrame, key: str, units: Column, limit: int = CHARS_PER_PAGE) -> DataFrame:
    """key, page_no (from 0), start_word, n_chars."""
    return files.select(key, F.posexplode(page_starts(units, limit)).alias("page_no", "p")).select(key, "page_no", "p.start_word", "p.n_chars")


def split_by_pages(paras: DataFrame, key: str, pages_per_file: int, size: int | None = None) -> DataFrame:
    """key, para_ix, file_ix: a paragraph opens a new file when the current one has that many pages. Needs n_pages (markers in the paragraph).

    A file closes as a page does, with markers for characters: ``size`` gives blocks of so many paragraphs where a book may be large.
    Without it, a fold over the paragraphs of a book notes where files begin.
    """
    if size is not None:
        found = page_of_runs(paras, key, "para_ix", F.array("n_pages"), pages_per_file, size)
        return found.select(key, "para_ix", F.col("page_no").cast("int").alias("file_ix"))
    rows = paras.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("para_ix", "n_pages"))).alias("paras"))
    start = F.struct(F.lit(0).cast("bigint").alias("pages"), F.lit(0).alias("place"), F.array(F.lit(1)).alias("firsts"))

    def step(acc: Column, para: Column) -> Column:
        new, place = acc["pages"] >= pages_per_file, acc["place"] + 1
        pages = (F.when(new, 0).otherwise(acc["pages"]) + para["n_pages"]).cast("bigint")
        return F.struct(pages.alias("pages"), place.alias("place"), F.when(new, F.array_append(acc["firsts"], place)).otherwise(acc["firsts"]).alias("firsts"))

    begun = rows.select(key, F.transform("paras", lambda p: p["para_ix"]).alias("ixs"), F.aggregate("paras", start, step, lambda acc: acc["firsts"]).alias("firsts"))
    upto = lambda k: F.coalesce(F.get(F.col("firsts"), k + 1), F.size("ixs") + 1)
    files = begun.select(key, F.posexplode(F.transform("firsts", lambda first, k: F.slice("ixs", first, upto(k) - first))).alias("file_ix", "ixs"))
    return files.select(key, F.explode("ixs").alias("para_ix"), "file_ix")


def page_map(files: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """key, number, href: a page for each file of the reading order and one for each of its markers. Needs file_ix, fname, n_pages, in_spine.

    Sums over files tell where each one's numbers begin, so that no window holds the pages of a book.
    """
    n_pages = F.col("n_pages").cast("int")
    counted = running_sums(files.where("in_spine"), [key], "file_ix", {"_upto": n_pages + 1}, size)
    pages = counted.select(key, "_upto", n_pages.alias("_n"), "fname", F.explode(F.sequence(F.lit(0), n_pages)).alias("page"))
    href = F.when(F.col("page") == 0, F.col("fname")).otherwise(F.concat("fname", F.lit("#page_"), (F.col("page") - 1).cast("string")))
    return pages.select(key, (F.col("_upto") - F.col("_n") + F.col("page")).cast("int").alias("number"), href.alias("href"))


def toc_entries(titles: DataFrame, key: str, by: str, size: int | None = None) -> DataFrame:
    """One entry for each title of a main body, the first alone of a notes body; brackets leave the text. Needs title, is_main, body_name, level, fname."""
    kept = row_numbers(titles, [key, "body_name", "is_main"], by, "_n", size).where("is_main OR _n = 1")
    numbered = row_numbers(kept, [key], by, "toc_ix", size)
    text = tx.sanitize_title(F.col("title"))
    return numbered.select(key, F.col("toc_ix").cast("int").alias("toc_ix"), F.concat("fname", F.lit("#tocref"), F.col(by).cast("string")).alias("ref"), text.alias("title"), "level", "body_name", "is_main")


def implied_body_title(books: DataFrame, entries: DataFrame, key: str, authors: Column, title: Column) -> DataFrame:
    """Entries, and for books whose main body has no title an entry 'authors title' in front (toc_ix 0)."""
    missing = books.join(entries.where("is_main AND level = 0").select(key).distinct(), key, "left_anti")
    implied = missing.select(key, F.lit(0).alias("toc_ix"), F.lit("index1").alias("ref"), F.concat_ws(" ", authors, title).alias("title"), F.lit(0).cast("int").alias("level"), F.lit("").alias("body_name"), F.lit(True).alias("is_main"))
    return entries.unionByName(implied)


def untitled_sections(sections: DataFrame, key: str, by: str) -> DataFrame:
    """Entries for sections with text but no title, titled by file number. Needs has_title, text_length, file_ix."""
    return sections.where(~F.col("has_title") & (F.col("text_length") > 0)).select(key, by, F.col("file_ix").cast("string").alias("title"), "level")


def chapter_end_marks(sections: DataFrame, key: str, by: str) -> DataFrame:
    """Ends of titled sections with text; where ends follow each other directly, the last stands. Needs has_title, text_length, end_pos."""
    ends = sections.where(F.col("has_title") & (F.col("text_length") > 0))
    following = F.lead("end_pos").over(_ordered(key, "end_pos"))
    return ends.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") > F.col("end_pos") + 1)).select(key, by, "end_pos")


def toc_page(entries: DataFrame, key: str, max_level: int, book_title: Column | None = None) -> DataFrame:
    """Rows of the contents page: deeper entries go, entries of notes stand at indent 0; a title from the metadata may replace the book's."""
    title = tx.all_lines(F.col("title"))
    if book_title is not None:
        title = F.when(F.col("level") == 0, book_title).otherwise(title)
    indent = F.when(F.col("is_main"), F.col("level")).otherwise(0).cast("int")
    return entries.where(~F.col("is_main") | (F.col("level") <= max_level)).select(key, "toc_ix", "ref", title.alias("title"), indent.alias("indent"))


#: A descent to a level under this one leaves the entry above it childless: chapters do not hang under the title of their book.
TOP_LEVELS = 2
#: ``normal``: under the innermost entry that is open; ``kindle``: under the outermost, so that two ranks remain; ``flat``: no entry has a parent.
TREES = ("normal", "kindle", "flat")


def toc_tree(entries: DataFrame, key: str, kind: str = "normal", levels: tuple[int, ...] | None = None, size: int | None = None) -> DataFrame:
    """key, toc_ix, parent_ix (null at the top). An entry stays open until one of its level or less follows, or until the very
    next one is a descent that stays under ``TOP_LEVELS``. For each level that occurs one window carries the entry that is open at it,
    so that a book of any number of entries is never one row; ``levels`` saves the job that looks which occur.
    """
    if kind not in TREES:
        raise ValueError(f"no such kind of contents: {kind}")
    level = F.col("level").cast("int")
    rows = entries.select(key, F.col("toc_ix").cast("int").alias("toc_ix"), level.alias("level"))
    if kind == "flat":
        return rows.select(key, "toc_ix", F.lit(None).cast("int").alias("parent_ix"))
    if levels is None:
        levels = tuple(entries.agg(F.array_sort(F.collect_set(level))).first()[0])
    rows = last_before(rows, [key], "toc_ix", "level", "_last", size)
    skips = (F.col("_last") < F.col("level")) & (F.col("level") < TOP_LEVELS)
    # at each level: the entry that opens it, no entry where it closes, null where the row leaves it as it is
    opens = F.struct(F.col("toc_ix").alias("ix"))
    closes = F.struct(F.lit(None).cast("int").alias("ix"))
    at = {f"_at{n}": F.when(F.col("level") == n, opens).when((F.col("level") < n) | (skips & (F.col("_last") <= n)), closes) for n in levels}
    rows = last_values_before(rows.withColumns(at), [key], "toc_ix", {f"_open{n}": f"_at{n}" for n in levels}, size)
    ranked = sorted(levels, reverse=kind == "normal")
    is_above = {n: (F.col("level") > n) & ~F.coalesce(skips & (F.col("_last") <= n), F.lit(False)) for n in ranked}
    parent = F.coalesce(*(F.when(is_above[n], F.col(f"_open{n}.ix")) for n in ranked), F.lit(None).cast("int"))
    return rows.select(key, "toc_ix", parent.alias("parent_ix"))


def play_order(entries: DataFrame, key: str, toc_placement: str = "none", toc_title: str = "Contents", size: int | None = None) -> DataFrame:
    """key, play_order, title: a contents page in front shifts all numbers by one, one behind comes last."""
    shift = 1 if toc_placement == "before" else 0
    rows = row_numbers(entries, [key], "toc_ix", "_n", size).select(key, (F.col("_n") + shift).cast("int").alias("play_order"), "title")
    if toc_placement not in ("before", "after"):
        return rows
    place = F.lit(1) if toc_placement == "before" else F.count(F.lit(1)) + 1
    contents = entries.groupBy(key).agg(place.cast("int").alias("play_order"))
    return rows.unionByName(contents.select(key, "play_order", F.lit(toc_title).alias("title")))


#: Order of kinds of files in a book, by where the contents page stands.
PLACEMENT = {"none": ("cover", "annotation", "text"), "before": ("cover", "toc", "annotation", "text"), "after": ("cover", "annotation", "text", "toc")}


def file_placement(files: DataFrame, key: str, toc_placement: str = "none") -> DataFrame:
    """Files numbered in reading order (``place``); kinds that have no place go. Needs kind, file_ix."""
    kinds = PLACEMENT[toc_placement]
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return files.where(F.col("kind").isin(*kinds)).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, "file_ix")))


def body_kind(bodies: DataFrame, key: str, notes_names: tuple[str, ...] = ("notes", "comments")) -> DataFrame:
    """``kind`` of each body: the first is main whatever its name, bodies named as notes are notes, others named."""
    nth = F.row_number().over(_ordered(key, "body_ix"))
    is_notes = tx.is_one_of(F.coalesce("body_name", F.lit("")), F.array(*map(F.lit, notes_names)))
    return bodies.withColumn("kind", F.when(nth == 1, "main").when(is_notes, "notes").otherwise("named"))


def running_counters(sections: DataFrame, key: str, by: str, size: int | None = None) -> DataFrame:
    """Number of each section, characters up to its end, and the latest title so far. Needs text_length, has_title, title."""
    summed = running_sums(sections, [key], by, {"section_no": F.lit(1), "chars_so_far": F.col("text_length")}, size)
    titled = last_before(summed.withColumn("_title", F.when(F.col("has_title"), F.col("title"))), [key], by, "_title", "_earlier", size)
    return titled.select(key, by, F.col("section_no").cast("int").alias("section_no"), "chars_so_far", F.coalesce("_title", "_earlier").alias("latest_title"))


def section_lengths(sections: DataFrame, key: str) -> DataFrame:
    """Text by book and level, and whether there is any: contents list only sections with text. Needs level, text_length."""
    return sections.groupBy(key, "level").agg(F.sum("text_length").alias("text_length"), F.bool_or(F.col("text_length") > 0).alias("has_text"))


def pages_per_book(pages: DataFrame, files: DataFrame, key: str, file: str) -> DataFrame:
    """Pages and files of each book; pages are counted by file before files meet their books."""
    per_file = pages.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    return per_file.join(files, file).groupBy(key).agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("files"))


def first_file(files: DataFrame, key: str, kind: str = "text", after: int = 0) -> DataFrame:
    """The first file of a kind behind a place in the book. Needs kind, file_ix, fname."""
    return files.where((F.col("kind") == kind) & (F.col("file_ix") > after)).groupBy(key).agg(F.min_by("fname", "file_ix").alias("first_text"))


def longest_first(names: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct names of a book in the order in which replacements must go: the longest first, then by code point."""
    order = Window.partitionBy(key).orderBy(F.char_length(name).desc(), name)
    return names.select(key, name).distinct().withColumn("place", F.row_number().over(order))
