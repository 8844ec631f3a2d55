"""Rows that packages are made of: manifest, reading order, guide, metadata, overwrite policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookengine.operators.blocks import row_numbers

COVER_ID = "book-cover-image"


def manifest_rows(key: str, files: DataFrame, images: DataFrame, vignettes: DataFrame, resources: DataFrame, size: int | None = None) -> DataFrame:
    """key, item_id, href, media_type, properties of everything in a book; the cover image has an id of its own.

    Files need file_ix, fname, media_type, in_manifest; images image_ix, fname, media_type, is_cover; the others ix, fname, media_type.
    ``size``: windows in blocks.
    """
    parts = (
        files.where("in_manifest").select(key, F.lit("file").alias("kind"), F.col("file_ix").cast("long").alias("ix"), "fname", "media_type"),
        images.select(key, F.lit("image").alias("kind"), F.col("image_ix").cast("long").alias("ix"), "fname", "media_type", "is_cover"),
        vignettes.select(key, F.lit("vignette").alias("kind"), F.col("ix").cast("long").alias("ix"), "fname", "media_type"),
        resources.select(key, F.lit("resource").alias("kind"), F.col("ix").cast("long").alias("ix"), "fname", "media_type"),
    )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    cover = F.coalesce("is_cover", F.lit(False))
    item = F.when(cover, COVER_ID).otherwise(F.concat("kind", F.col("_number").cast("string")))
    return row_numbers(rows, [key, "kind"], "ix", "_number", size).select(key, item.alias("item_id"), F.col("fname").alias("href"), "media_type", F.when(cover, "cover-image").alias("properties"))


def spine_rows(files: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """key, spine_ix, idref, linear: the reading order; a cover page is not linear. Needs file_ix, fname, in_spine, is_cover_page. ``size``: windows in blocks."""
    numbered = row_numbers(files.where("in_spine"), [key], "file_ix", "spine_ix", size)
    return numbered.select(key, F.col("spine_ix").cast("int").alias("spine_ix"), F.col("fname").alias("idref"), F.when(F.col("is_cover_page"), "no").otherwise("yes").alias("linear"))


def guide_rows(files: DataFrame, key: str, open_cover: Column, annotation_first: Column, toc_page: bool) -> DataFrame:
    """key, type, href. Reading starts at the cover if asked, at the annotation if that holds, else at the first index file. Needs fname, file_ix, kind."""
    start = files.groupBy(key).agg(
        F.min_by("fname", F.when(F.col("kind") == "cover", F.col("file_ix"))).alias("cover"),
        F.min_by("fname", F.when(F.col("kind") == "annotation", F.col("file_ix"))).alias("annotation"),
        F.min_by("fname", F.when(F.startswith("fname", F.lit("index")), F.col("file_ix"))).alias("index"),
        F.min_by("fname", F.when(F.col("kind") == "toc", F.col("file_ix"))).alias("toc"),
    )
    href = F.coalesce(F.when(open_cover, F.col("cover")), F.when(annotation_first, F.col("annotation")), F.col("index"))
    rows = start.select(key, F.lit("text").alias("type"), href.alias("href")).where("href is not null")
    if toc_page:
        rows = rows.unionByName(start.select(key, F.lit("toc").alias("type"), F.col("toc").alias("href")).where("href is not null"))
    return rows


def package_metadata(books: DataFrame, key: str) -> DataFrame:
    """key, name, ix, value: Dublin-Core rows; empty values go. Needs title, lang, book_id, authors (array), genres (array), annotation, cover_id, seq_name, seq_num."""
    single = {
        "dc:title": F.col("title"),
        "dc:language": F.col("lang"),
        "dc:identifier": F.concat(F.lit("urn:uuid:"), "book_id"),
        "dc:description": F.col("annotation"),
        "cover": F.col("cover_id"),
        "series": F.col("seq_name"),
        "series_index": F.when((F.coalesce("seq_name", F.lit("")) != "") & (F.col("seq_num") > 0), F.col("seq_num").cast("string")),
    }
    entry = lambda name, ix, value: F.struct(F.lit(name).alias("name"), ix.cast("int").alias("ix"), value.alias("value"))
    rows = F.concat(
        F.array(*(entry(n, F.lit(0), v) for n, v in single.items())),
        F.transform("authors", lambda a, i: entry("dc:creator", i, a)),
        F.transform("genres", lambda g, i: entry("dc:subject", i, g)),
    )
    return books.select(key, F.explode(rows).alias("r")).select(key, "r.name", "r.ix", "r.value").where("value <> ''")


def write_conflicts(planned: DataFrame, existing: DataFrame, on: str, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what may be written, what is in the way); nothing is in the way if targets may be overwritten."""
    if overwrite:
        return planned, planned.limit(0)
    return planned.join(existing, on, "left_anti"), planned.join(existing, on, "left_semi")


def run_counters(books: DataFrame, results: DataFrame, on: str) -> DataFrame:
    """status, books: how many were skipped (no result), failed (result not ok) and processed. Results need ok."""
    ok = F.col("ok")
    status = F.when(ok.isNull(), "skipped").when(~ok, "failed").otherwise("processed")
    return books.select(on).join(results.select(on, "ok"), on, "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("books"))


def concat_lists(*lists: DataFrame) -> DataFrame:
    """File lists of different columns as one table; what a list lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)
