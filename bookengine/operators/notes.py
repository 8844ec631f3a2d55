"""Notes: references, placement, labels. All joins are equi-joins on (book, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookengine.functions import formats as fmt
from bookengine.functions import text as tx
from bookengine.operators.blocks import row_numbers

MODES = ("default", "inline", "block", "float", "float-old", "float-new", "float-new-more")


def resolve_references(refs: DataFrame, notes: DataFrame, on: list[str], mode: str = "default") -> DataFrame:
    """References with their note's columns and ``class``: noteanchor, or linkanchor for a miss where the mode marks it."""
    found = refs.join(notes.withColumn("_hit", F.lit(True)), on, "left")
    miss = F.lit(None).cast("string") if mode in ("inline", "block") else F.lit("linkanchor")
    return found.withColumn("class", F.when(F.col("_hit"), "noteanchor").otherwise(miss)).drop("_hit")


def body_titles(notes: DataFrame, titles: DataFrame, on: list[str]) -> DataFrame:
    """Notes with ``body_title``: the body's own, else its name in title case."""
    return notes.join(titles, on, "left").withColumn("body_title", F.coalesce(F.nullif("body_title", F.lit("")), tx.title_case(F.col("body_name"))))


def dangling(refs: DataFrame, notes: DataFrame, on: list[str]) -> DataFrame:
    return refs.join(notes, on, "left_anti")


def unreferenced(notes: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    return notes.join(refs, on, "left_anti")


def back_links(notes: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    """Notes with ``back_ref``: where they are referred to last; 'nowhere' without a reference. References need ref, pos."""
    last = refs.groupBy(*on).agg(F.max_by("ref", "pos").alias("back_ref"))
    return notes.join(last, on, "left").withColumn("back_ref", F.coalesce("back_ref", F.lit("nowhere")))


def inline_notes(refs: DataFrame, notes: DataFrame, on: list[str]) -> DataFrame:
    """The reference's text followed by the note's body; a miss leaves it alone. Needs ref_text, body."""
    found = refs.join(notes, on, "left")
    return found.withColumn("text", F.concat("ref_text", F.when(F.col("body").isNotNull(), F.concat(F.lit(" ["), "body", F.lit("]"))).otherwise("")))


def block_notes(refs: DataFrame, notes: DataFrame, on: list[str], para: list[str]) -> DataFrame:
    """For each paragraph the notes that it refers to, in order. Needs pos, title, body."""
    found = refs.join(notes, on)
    entry = F.struct("pos", F.concat(tx.bracket_note_title(F.col("title")), "body").alias("note"))
    blocks = found.groupBy(*para).agg(F.array_sort(F.collect_list(entry)).alias("notes"))
    return blocks.select(*para, F.array_join(F.transform("notes", lambda n: n["note"]), "\n").alias("block"))


def floating_notes(notes: DataFrame, refs: DataFrame, on: list[str], mode: str = "float-new-more") -> DataFrame:
    """Notes with back-link and text; where the mode says so, notes of several paragraphs say that there is more. Needs body."""
    linked = back_links(notes, refs, on)
    several = F.size(F.filter(F.split("body", "\n"), lambda p: p != "")) > 1
    text = F.when(several, F.concat(tx.first_line(F.col("body")), F.lit(" (…etc.)"))).otherwise(F.col("body")) if mode == "float-new-more" else F.col("body")
    return linked.withColumn("text", text)


def number_notes(notes: DataFrame, book: str, body: str, by: str, size: int | None = None) -> DataFrame:
    """``note_number`` within each body in discovery order, and ``body_number`` of the bodies, 0 where a book has only one. ``size``: windows over notes in blocks."""
    first = notes.groupBy(book, body).agg(F.min(by).alias("_first"))
    numbered = first.withColumn("body_number", F.row_number().over(Window.partitionBy(book).orderBy("_first")))
    several = F.count(F.lit(1)).over(Window.partitionBy(book)) > 1
    numbered = numbered.withColumn("body_number", F.when(several, F.col("body_number")).otherwise(0)).drop("_first")
    counted = row_numbers(notes, [book, body], by, "note_number", size)
    return counted.withColumn("note_number", F.col("note_number").cast("int")).join(numbered, [book, body])


def renumber_notes(notes: DataFrame, pattern: str) -> DataFrame:
    """Numbered notes with ``label`` by a keyword pattern."""
    return notes.withColumn("label", fmt.format_keywords(pattern, fmt.note_keywords(F.col("body_name"), F.col("body_number"), F.col("note_number"))))


def notes_per_body(notes: DataFrame, key: str, body: str, first: str) -> DataFrame:
    """Notes and note bodies of each book, and the notes of its body named ``first``."""
    return notes.groupBy(key).agg(F.count(F.lit(1)).alias("notes_per_book"), F.count_distinct(body).alias("note_bodies"), F.count_if(F.col(body) == first).alias("first_body"))
