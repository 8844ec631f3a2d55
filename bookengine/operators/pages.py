"""Pages of a file of any length.

A page closes after the word that reaches the limit and what is over is not carried, so that where a page begins depends on
all words before it. A file is cut into blocks of runs (paragraphs, documents). What a block does depends on one number, the characters
that are open where it begins, and changes only where another word is the first to close a page; so each block is a small table:
characters needed, pages closed, where the last page begins, characters left open. These tables alone pass through one task a file, in a stream;
then blocks cut their own pages. Words of a file are never in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of a block, and characters of a page.
RUNS, CHARS_PER_PAGE = 1024, 2300
_TABLE = "n_words long, total long, needs array<long>, closed array<long>, opens array<long>, left array<long>"
_ENTRY = "chars long, pages long, first long, words long, is_last boolean"


def _sums(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(characters before each word and behind the last, words before each run) of a block whose runs are in order."""
    units = group.column("_units").combine_chunks()
    words = units.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(units), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(words))), np.cumsum(sizes) - sizes


def _following(before: np.ndarray, limit: int) -> np.ndarray:
    """For a page that begins at each word: the word behind it, or the number of words + 1 if the block does not close it."""
    return np.searchsorted(before[1:], before[:-1] + limit) + 1


def _block_table(limit: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def table(key: tuple, group: pa.Table) -> pa.Table:
        before, _ = _sums(group.sort_by("_by"))
        n = len(before) - 1
        jump = np.append(_following(before, limit), n)
        jump = np.where(jump > n, np.arange(n + 1), jump)
        closed = (jump != np.arange(n + 1)).astype(np.int64)
        # pointers double until each is at the last page that begins in the block
        while not np.array_equal(further := jump[jump], jump):
            closed, jump = closed + closed[jump], further
        first = np.flatnonzero((before[:-1] < limit) & (before[1:] > before[:-1])) + 1
        columns = {"needs": before[first], "closed": 1 + closed[first], "opens": jump[first], "left": before[n] - before[jump[first]]}
        row = {"_key": pa.array([key[0].as_py()], key[0].type), "_block": pa.array([key[1].as_py()], pa.int64()), "n_words": pa.array([n], pa.int64()), "total": pa.array([int(before[n])], pa.int64())}
        return pa.table(row | {name: pa.array([values], pa.list_(pa.int64())) for name, values in columns.items()})

    return table


def _entries(limit: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """State where each block begins, from tables that come by key and block."""
    names = ["_key", "_block", "chars", "pages", "first", "words", "is_last"]
    types = [kind, *[pa.int64()] * 5, pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(column), t) for column, t in zip(zip(*rows), types)], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, pages, first, words = None, 0, 0, 0, 0
        for rows in batches:
            out = []
            columns = {name: rows.column(name) for name in rows.schema.names}
            for k in range(rows.num_rows):
                key, block, n, total = (columns[name][k].as_py() for name in ("_key", "_block", "n_words", "total"))
                if held is not None:
                    out.append((*held, key != held[0]))
                if held is None or key != held[0]:
                    chars, pages, first, words = 0, 0, 0, 0
                held = (key, block, chars, pages, first, words)
                needs = columns["needs"][k].values.to_numpy()
                at = int(np.searchsorted(needs, limit - chars))
                if at == len(needs):
                    chars += total
                else:
                    chars, first = columns["left"][k].values[at].as_py(), words + columns["opens"][k].values[at].as_py()
                    pages += columns["closed"][k].values[at].as_py()
                words += n
            if out:
                yield batch(out)
        if held is not None:
            yield batch([(*held, True)])

    return walk


def _cuts(before: np.ndarray, chars: int, limit: int) -> list[int]:
    """Words of a block at which a page begins because the one before it has closed; the number of words if that is at the block's end."""
    n, found = len(before) - 1, []
    at = int(np.searchsorted(before[1:], limit - chars)) + 1
    following = _following(before, limit)
    while at <= n:
        found.append(at)
        at = int(following[at]) if at < n else n + 1
    return found


def _pages(limit: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def pages(key: tuple, group: pa.Table, entry: pa.Table) -> pa.Table:
        before, _ = _sums(group.sort_by("_by"))
        state = entry.to_pylist()[0]
        cuts = _cuts(before, state["chars"], limit)
        begins = np.array([state["first"], *(state["words"] + c for c in cuts)], np.int64)
        marks = np.array([-state["chars"], *(before[c] for c in cuts), before[-1]], np.int64)
        chars = np.diff(marks)
        # the page that is open at the block's end belongs to a later block, but at the end of the file it is the rest
        keep = len(begins) if state["is_last"] and begins[-1] < state["words"] + len(before) - 1 else len(cuts)
        numbers = np.arange(keep) + state["pages"]
        return pa.table({"_key": pa.array([key[0].as_py()] * keep, key[0].type), "page_no": pa.array(numbers, pa.int64()), "start_word": pa.array(begins[:keep]), "n_chars": pa.array(chars[:keep])})

    return pages


def _run_pages(limit: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def pages(key: tuple, group: pa.Table, entry: pa.Table) -> pa.Table:
        group = group.sort_by("_by")
        before, offsets = _sums(group)
        state = entry.to_pylist()[0]
        cuts = np.array(_cuts(before, state["chars"], limit), np.int64)
        return pa.table({"_key": group.column("_key"), "_by": group.column("_by"), "page_no": pa.array(state["pages"] + np.searchsorted(cuts, offsets, side="right"), pa.int64())})

    return pages


def _by_block(runs: DataFrame, key: str, by: str, units: Column, limit: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Runs dealt to blocks, and the state where each block begins."""
    if limit < 1:
        raise ValueError("a page holds at least one character")
    dealt = runs.select(F.col(key).alias("_key"), F.col(by).cast("long").alias("_by"), F.expr(f"CAST(`{by}` AS BIGINT) div {size}").alias("_block"), F.coalesce(units, F.array().cast("array<int>")).alias("_units"))
    kind = runs.schema[key].dataType.simpleString()
    tables = dealt.groupBy("_key", "_block").applyInArrow(_block_table(limit), f"_key {kind}, _block long, {_TABLE}")
    ordered = tables.repartition("_key").sortWithinPartitions("_key", "_block")
    from pyspark.sql.pandas.types import to_arrow_type

    return dealt, ordered.mapInArrow(_entries(limit, to_arrow_type(runs.schema[key].dataType)), f"_key {kind}, _block long, {_ENTRY}")


def paginate_runs(runs: DataFrame, key: str, by: str, units: Column, limit: int = CHARS_PER_PAGE, size: int = RUNS) -> DataFrame:
    """key, page_no (from 0), start_word (in the file), n_chars: pages of files given in runs of word lengths, in order of a whole number.

    Gives what ``structure.paginate`` gives for the runs of a file put together. Runs without words (or null) give none; a file without words has no page.
    ``size``: positions of a block. Lengths must not be negative, and no two runs of a file share a position.
    """
    dealt, entries = _by_block(runs, key, by, units, limit, size)
    kind = runs.schema[key].dataType.simpleString()
    made = dealt.groupBy("_key", "_block").cogroup(entries.groupBy("_key", "_block")).applyInArrow(_pages(limit), f"_key {kind}, page_no long, start_word long, n_chars long")
    return made.withColumnRenamed("_key", key)


def page_of_runs(runs: DataFrame, key: str, by: str, units: Column, limit: int = CHARS_PER_PAGE, size: int = RUNS) -> DataFrame:
    """key, the position, page_no: the page on which each run begins (of a run without words: the page on which the next one would)."""
    dealt, entries = _by_block(runs, key, by, units, limit, size)
    kind = runs.schema[key].dataType.simpleString()
    made = dealt.groupBy("_key", "_block").cogroup(entries.groupBy("_key", "_block")).applyInArrow(_run_pages(limit), f"_key {kind}, _by long, page_no long")
    return made.select(F.col("_key").alias(key), F.col("_by").cast(runs.schema[by].dataType).alias(by), "page_no")
