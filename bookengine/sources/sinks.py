"""Writing books: chapter files by book, under a policy for targets that exist."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chapters that one output file holds at most, of one book.
CHAPTERS_PER_FILE = 1000
#: Folders of intermediate tables and outputs that each application has got and not discarded.
_written: dict[str, set[str]] = {}


def written_books(chapters: DataFrame, path: str, book: str) -> DataFrame:
    """The books that an output folder holds; none where there is no folder yet. Only names of folders are read."""
    spark = chapters.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = chapters.select(book)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return names.limit(0)
    return spark.read.schema(chapters.schema).parquet(path).select(book).distinct()


def write_chapters(chapters: DataFrame, path: str, book: str, overwrite: bool = False) -> DataFrame:
    """Writes a folder for each book with its chapters in order, and returns book and outcome: written, replaced or conflict.

    A book that the folder holds already is in conflict and stays as it is, unless it may be overwritten: then it is replaced
    as a whole. Other books stay in any case, and a book that fails takes none with it. Rows are dealt by book and run of chapters, so that a book of any
    size is many tasks, and sorted inside tasks, so that a task holds one open file at a time.
    """
    there = written_books(chapters, path, book).select(F.col(book).alias("_there"), F.lit(True).alias("_held"))
    planned = chapters.select(book).distinct()
    held = F.coalesce("_held", F.lit(False))
    outcome = F.when(~held, "written").otherwise("replaced" if overwrite else "conflict")
    # written before the folder changes, so that it says what was found there
    outcomes = staged(planned.join(there, planned[book].eqNullSafe(there["_there"]), "left").select(book, outcome.alias("outcome")), "outcomes")
    blocked = outcomes.where("outcome = 'conflict'").select(F.col(book).alias("_blocked"))
    free = chapters.join(blocked, chapters[book].eqNullSafe(blocked["_blocked"]), "left_anti") if not overwrite else chapters
    run = F.floor(F.col("file_ix") / CHAPTERS_PER_FILE)
    dealt = free.repartition(book, run).sortWithinPartitions(book, "file_ix")
    # dynamic: only the folders of the books at hand are replaced, when all of them are written
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(book).parquet(path)
    return outcomes


def write_library(chapters: DataFrame, path: str, book: str) -> None:
    """All books in one table whose files hold many books each, in order of book and chapter, so that a reader of one book skips most of them by their statistics.

    For libraries of very many small books, where a folder for each is mostly overhead. Existing output is an error. Rows are dealt as in ``write_chapters``.
    """
    run = F.floor(F.col("file_ix") / CHAPTERS_PER_FILE)
    chapters.repartition(book, run).sortWithinPartitions(book, "file_ix").write.option("compression", "zstd").parquet(path)


def output_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all machines share (``spark.checkpoint.dir``); a temporary one where Spark runs on one machine without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = shared.rstrip("/") if shared else f"file://{tempfile.mkdtemp(prefix='bookengine-')}"
    path = f"{folder}/bookengine/{uuid.uuid4().hex}/{name}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def discard_all(spark: SparkSession) -> None:
    """Delete every folder that this application has got from ``output_folder``, once all results that read them are written elsewhere."""
    for path in sorted(_written.pop(spark.sparkContext.applicationId, set())):
        # the folder that a path has to itself
        target = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of text, by Spark's own file system, so that any store works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table written once in the shared folder, and read again from there: what is read several times is worked out once, and a lost executor costs no more."""
    path = output_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_chapters(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_chapters`` has written; the schema holds the book's column as well."""
    return spark.read.schema(schema).parquet(path)
