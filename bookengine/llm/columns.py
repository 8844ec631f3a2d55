"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookengine.llm.store import materialize

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and nothing else that could clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def with_row_ids(docs: DataFrame) -> DataFrame:
    """row_id (long, unique), doc_id and text (null: empty). Where doc_id is unique it is the row id; else rows are numbered and written once, so that the numbers stay."""
    seen = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if seen["rows"] == seen["ids"] and docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        return doc_text(docs).select(F.col("doc_id").cast("long").alias("row_id"), "doc_id", "text")
    return materialize(doc_text(docs).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), "rows")


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores in front until none of the tables has such a column (in any case of letters)."""
    taken = {c.lower() for table in tables for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of a table under their names, dots in these included."""
    return [F.col(f"`{c}`") for c in docs.columns]


def numbered(docs: DataFrame, nulls_last: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a unique long in the order of doc_id, and the name of that column: doc_id itself where it is unique.

    Else the rows are sorted, numbered and written once, so that the numbers stay; of rows that share an id
    each then counts on its own.
    """
    row = free_name("row_number", docs)
    seen = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if seen["rows"] == seen["ids"]:
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    order = F.col("doc_id").asc_nulls_last() if nulls_last else F.col("doc_id").asc_nulls_first()
    return materialize(docs.orderBy(order).withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def as_docs(rows: DataFrame, row: str, *more: str) -> DataFrame:
    """Numbered rows under their number as doc_id, with the text."""
    return rows.select(F.col(row).alias("doc_id"), "text", *more)


def without(rows: DataFrame, row: str, dropped: DataFrame, docs: DataFrame) -> DataFrame:
    """Numbered rows, with the columns of ``docs``, less those whose number is a doc_id of ``dropped``."""
    return rows.join(dropped.select(F.col("doc_id").alias(row)), row, "left_anti").select(*own_columns(docs))


def hash_bits(col: Column) -> Column:
    """60 bits of the MD5 of a value's text, as a long: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(col.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def byte_steps(batch: pa.RecordBatch, column: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into steps: first row, end row, UTF-8 bytes, offsets of the rows in these bytes."""
    col = batch.column(column)
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    if len(col) == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(col):
        end = int(np.searchsorted(offsets, offsets[start] + step_bytes, side="right")) - 1
        end = min(max(end, start + 1), len(col))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose ``column`` (strings or bytes) has at most so many bytes, or of one row."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def binary_views(column: pa.Array | pa.ChunkedArray) -> Iterator[memoryview]:
    """The values of a binary column without nulls, not copied."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist() if len(chunk) else [0]
        view = memoryview(data) if data is not None else memoryview(b"")
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield view[a:b]


def word_bounds(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes not in ``breaks``; ASCII white space by default) and the first word of each row (with a final end)."""
    white = breaks[data]
    first = np.empty(len(data), dtype=bool)
    last = np.empty(len(data), dtype=bool)
    if len(data):
        first[0] = last[-1] = True
        first[1:] = white[:-1]
        last[:-1] = white[1:]
        inner = offsets[1:-1]
        first[inner[inner < len(data)]] = True
        last[inner[inner > 0] - 1] = True
        first &= ~white
        last &= ~white
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)
