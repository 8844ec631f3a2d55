"""Links, images, overrides: keyed lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookengine.functions import text as tx

NOT_FOUND = "image-not-found"


def resolve_links(links: DataFrame, anchors: DataFrame, on: list[str]) -> DataFrame:
    """``resolved``: ``file#id`` for a local href whose id is known, else the href. Links need href, anchors anchor_id and file."""
    local = F.when(F.startswith("href", F.lit("#")), tx.href_fragment(F.col("href")))
    found = links.withColumn("anchor_id", local).join(anchors, [*on, "anchor_id"], "left")
    return found.withColumn("resolved", F.coalesce(F.concat("file", F.lit("#"), "anchor_id"), F.col("href")))


def first_of(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_n = 1").drop("_n")


def resolve_images(refs: DataFrame, images: DataFrame, on: list[str], by: str) -> DataFrame:
    """References with ``image_file``: of images that share an id the first; a miss shows the shared substitute."""
    return refs.join(first_of(images, on, by), on, "left").withColumn("image_file", F.coalesce("image_file", F.lit(NOT_FOUND)))


def resolve_cover(books: DataFrame, images: DataFrame, book: str, by: str, default_cover: bool = False) -> DataFrame:
    """Books with ``cover_file``: the referred image; none for a miss; the default cover, if asked, for books without a reference. Needs cover_ref."""
    unique = first_of(images, [book, "image_id"], by).select(book, F.col("image_id").alias("cover_ref"), F.col("image_file").alias("cover_file"))
    missing = F.when(F.coalesce("cover_ref", F.lit("")) == "", F.lit("default-cover" if default_cover else None).cast("string"))
    return books.join(unique, [book, "cover_ref"], "left").withColumn("cover_file", F.coalesce("cover_file", missing))


def path_suffixes(path: Column) -> Column:
    """The path, ever shorter suffixes of it, and '*'."""
    parts = F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.array_append(suffixes, F.lit("*"))


def apply_overwrites(books: DataFrame, overrides: DataFrame, book: str, path: str, fields: tuple[str, ...]) -> DataFrame:
    """Books whose ``fields`` an override replaces where it is not empty; one override a book: whole path, shorter suffixes, then '*'.

    An ASIN must have ten letters or digits. Overrides have ``name`` and the fields.
    """
    valid = overrides.select("name", *((F.when(F.col(f).rlike("^[A-Za-z0-9]{10}$"), F.col(f)) if f == "asin" else F.col(f)).alias(f) for f in fields))
    tried = books.select(book, F.posexplode(path_suffixes(F.col(path))).alias("rank", "name"))
    best = tried.join(valid, "name").groupBy(book).agg(F.min_by(F.struct(*fields), "rank").alias("_override"))
    found = books.join(best, book, "left")
    return found.select(*(F.coalesce(F.nullif(F.col("_override")[c], F.lit("")), F.col(c)).alias(c) if c in fields else F.col(c) for c in books.columns))


def resolve_vignettes(places: DataFrame, vignettes: DataFrame) -> DataFrame:
    """Places (level, key) with ``image``: the level's row, else the default's; 'none' in any case shows nothing."""
    exact = vignettes.select("level", "key", F.col("image").alias("_own"))
    default = vignettes.where("level = 'default'").select("key", F.col("image").alias("_default"))
    image = F.coalesce("_own", "_default")
    return places.join(exact, ["level", "key"], "left").join(default, "key", "left").withColumn("image", F.when(F.lower(image) != "none", image)).drop("_own", "_default")


def stylesheet_references(sheets: DataFrame, resources: DataFrame, key: str) -> DataFrame:
    """key, pos, href, target of every ``url("…")`` of a stylesheet; target is null where no resource has that name."""
    found = sheets.select(key, F.posexplode(F.regexp_extract_all(F.col("css"), F.lit('url\\("([^"]*)"\\)'), F.lit(1))).alias("pos", "href"))
    return found.join(resources, "href", "left")
