"""Repeated byte strings by distributed prefix doubling over a sample of suffix positions.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts elsewhere. Ranking every suffix would
shuffle many times the corpus, so the suffixes ranked are those at content-chosen positions: in each window
of LENGTH bytes, the position whose CORE bytes have the least hash. Equal windows choose the same place,
so each window is judged at one ranked position, and no repeat is lost.

1. Positions are ranked by the CORE bytes behind them; unique ones are done (not repeated).
2. Positions of equal context (the bytes of all windows around the position) are past the threshold: all their windows
   repeat. One position of each context goes on as a witness.
3. Witnesses whose core has several contexts are ranked again and again, each time by the pair of their rank and the hash of
   the bytes at the next offset, up to LENGTH bytes from the position on, and in the same way backwards. Spark brings equal
   pairs together by sorting; a position that is unique leaves, and so bounds how far a repeat can reach; the
   others go on until they are unique or past the threshold. What the two bounds leave are the windows that can repeat.
4. These windows are compared within each core, inside a sorted group of bounded size, or by a Spark aggregation where a group is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookengine.llm.columns import byte_steps, with_row_ids
from bookengine.llm.shingles import BASE, mix, powers
from bookengine.llm.store import materialize, scratch

LENGTH = 200
#: Windows per position, and bytes that all of them contain.
OFFSETS = 128
CORE = LENGTH - OFFSETS + 1
#: Bytes of a context: before the position and from it on.
BEFORE = OFFSETS - 1
CONTEXT = BEFORE + LENGTH
#: Bytes from the position on, and before it, by which positions are ranked in turn.
AHEAD, BEHIND = (106, 146, LENGTH), (32, 64, BEFORE)
#: Contexts of one core that a task ranks together.
GROUP = 4096
_STEP = 1 << 17
_PLACE = np.uint64(26)
_INVERSE = pow(BASE, -1, 1 << 64)


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return sums


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, from running minima within blocks."""
    n = len(x)
    blocks = np.append(x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def chosen_positions(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Positions that some window of LENGTH bytes inside one row chooses; the leftmost of equal hashes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64)
    gram = (sums[CORE:] - sums[:-CORE]) * powers(_INVERSE, len(data) + 1)[: len(data) - CORE + 1]
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    found = []
    # a place takes 26 bits: longer data is cut into parts that overlap by a window
    most = 1 << int(_PLACE)
    for start in range(0, len(data) - LENGTH + 1, most - LENGTH):
        part = gram[start : start + most]
        if len(part) < OFFSETS:
            break
        keyed = ((part >> _PLACE) << _PLACE) | np.arange(len(part), dtype=np.uint64)
        place = (_sliding_least(keyed, OFFSETS) & np.uint64(most - 1)).astype(np.int64) + start
        ends = np.repeat(offsets[1:], np.diff(offsets))[start : start + len(place)]
        place = place[ends - np.arange(start, start + len(place)) >= LENGTH]
        if len(place):
            found.append(place[np.append(True, place[1:] != place[:-1])])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * powers(_INVERSE, len(sums))[a] + (b - a).astype(np.uint64))


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in byte_steps(batch, step_bytes=_STEP):
            sums = _sums(data)
            at = chosen_positions(data, offsets, sums)
            yield pa.RecordBatch.from_arrays([pa.array(_hash(sums, at, at + CORE).view(np.int64))], ["core"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("row_id").to_numpy(zero_copy_only=False)
        for start, _, data, offsets in byte_steps(batch, step_bytes=_STEP):
            sums = _sums(data)
            at = chosen_positions(data, offsets, sums)
            row = np.searchsorted(offsets, at, side="right") - 1
            low, high = np.maximum(at - BEFORE, offsets[row]), np.minimum(at + LENGTH, offsets[row + 1])
            context = mix(_hash(sums, low, high) + (at - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (high - at).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_hash(sums, at, at + CORE).view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[start + row]), pa.array((at - offsets[row]).astype(np.int64))],
                ["core", "context", "row_id", "at"],
            )


def _rank_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each wanted position the hashes of the pieces between its offsets, ahead and behind; null beyond the text's ends."""
    for batch in batches:
        out: list[tuple] = []
        for row, text, wanted in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            sums, at = _sums(data), np.array([w["at"] for w in wanted], np.int64)
            pieces = []
            for edges in ([at + x for x in (CORE, *AHEAD)], [at - x for x in (0, *BEHIND)]):
                for near, far in zip(edges, edges[1:], strict=False):
                    there = (far >= 0) & (far <= len(data))
                    low, high = (np.where(there, f(near, far), 0) for f in (np.minimum, np.maximum))
                    pieces.append([h if ok else None for h, ok in zip(_hash(sums, low, high).view(np.int64).tolist(), there.tolist(), strict=True)])
            ahead, behind = list(zip(*pieces[: len(AHEAD)], strict=True)), list(zip(*pieces[len(AHEAD) :], strict=True))
            out += [(w["core"], w["context"], w["n"], row, w["at"], list(f), list(g)) for w, f, g in zip(wanted, ahead, behind, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        longs = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), longs, longs)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["core", "context", "n", "row_id", "at", "ahead", "behind"])


def _doubled(positions: DataFrame, pieces: str, steps: int) -> DataFrame:
    """id and reached: after how many steps a position still shares its rank with another; positions that the first step tells apart are left out."""
    state, reached, count = positions.select("id", F.col("core").alias("rank"), F.col(pieces).alias("pieces")), [], positions.count()
    for k in range(steps):
        piece = F.col("pieces")[k]
        pairs = state.where(piece.isNotNull()).select("id", F.xxhash64("rank", piece).alias("rank"), "pieces")
        # written, so that the join has plain exchanges, whose hot partitions Spark splits
        again = materialize(pairs.groupBy("rank").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1").select("rank"), "equal_ranks", count // 2)
        state = materialize(pairs.join(again, "rank").select("id", "rank", "pieces"), "ranks", count)
        count = state.count()
        reached.append(state.select("id", F.lit(k + 1).alias("reached")))
    return reduce(DataFrame.unionByName, reached).groupBy("id").agg(F.max("reached").alias("reached"))


def _possible_windows(witnesses: DataFrame, rows: DataFrame) -> DataFrame:
    """core, context, n, row_id, at and the offsets from ``low`` to ``high`` whose windows can repeat; witnesses without any are left out."""
    wanted = witnesses.groupBy("row_id").agg(F.collect_list(F.struct("core", "context", "n", "at")).alias("wanted"))
    texts = rows.select("row_id", "text").join(wanted, "row_id")
    ranked = texts.mapInArrow(_rank_pieces, "core long, context long, n long, row_id long, at long, ahead array<long>, behind array<long>")
    # written, so that the ids stay
    ranked = materialize(ranked.withColumn("id", F.monotonically_increasing_id()), "rank_pieces")
    ahead, behind = (_doubled(ranked, name, len(steps)).withColumnRenamed("reached", name) for name, steps in (("ahead", AHEAD), ("behind", BEHIND)))
    found = ranked.drop("ahead", "behind").join(ahead, "id", "left").join(behind, "id", "left")
    # unique with so many bytes ahead: only windows that end before can repeat; likewise behind
    low = F.element_at(F.array(*(F.lit(LENGTH - x + 1) for x in AHEAD), F.lit(0)), F.coalesce("ahead", F.lit(0)) + 1)
    high = F.element_at(F.array(*(F.lit(x - 1) for x in BEHIND), F.lit(BEFORE)), F.coalesce("behind", F.lit(0)) + 1)
    return found.select("core", "context", "n", "row_id", "at", low.alias("low"), high.alias("high")).where("low <= high")


def _context_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            raw = text.encode()
            for w in wanted:
                first = max(w["at"] - BEFORE, 0)
                out.append((w["core"], w["context"], w["n"], w["low"], w["high"], w["large"], w["at"] - first, raw[first : w["at"] + LENGTH]))
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["core", "context", "n", "low", "high", "large", "before", "data"])


def _window_columns(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes and which windows exist and can repeat, for rows of ``_context_bytes``."""
    value, inside = _window_hashes(rows.column("before").to_numpy(), rows.column("data").to_pylist())
    low, high = (rows.column(k).to_numpy()[:, None] for k in ("low", "high"))
    offset = np.arange(OFFSETS)
    return value, inside & (offset >= low) & (offset <= high)


def _window_hashes(before: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each context (rows) and offset (columns) the hash of the window that starts so far before the position, and whether it exists."""
    laid = np.zeros((len(data), CONTEXT), np.uint8)
    length = np.array([len(x) for x in data], np.int64)
    column = np.arange(CONTEXT)
    start = BEFORE - before
    laid[(column >= start[:, None]) & (column < (start + length)[:, None])] = np.frombuffer(b"".join(data), np.uint8)
    sums = np.zeros((len(data), CONTEXT + 1), np.uint64)
    np.cumsum((laid.astype(np.uint64) + np.uint64(1)) * powers(BASE, CONTEXT), axis=1, out=sums[:, 1:])
    at = BEFORE - np.arange(OFFSETS)
    value = mix((sums[:, at + LENGTH] - sums[:, at]) * powers(_INVERSE, CONTEXT + 1)[at])
    inside = (at >= start[:, None]) & (at + LENGTH <= (start + length)[:, None])
    return value, inside


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by core: which offsets' windows another context of the core shares. Cores stay whole across batches."""
    kept: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        core = rows.column("core").to_numpy()
        full = int(np.searchsorted(core, core[-1])) if len(core) else 0
        kept = rows.slice(full)
        if full:
            yield _judge(rows.slice(0, full))
    if kept is not None and len(kept):
        yield _judge(kept)


def _judge(rows: pa.Table) -> pa.RecordBatch:
    core, context, n = (rows.column(k).to_numpy() for k in ("core", "context", "n"))
    value, inside = _window_columns(rows)
    value = mix(value + core.view(np.uint64)[:, None])
    again = np.zeros(value.shape, bool)
    for k in range(OFFSETS):
        here = np.flatnonzero(inside[:, k])
        order = here[np.argsort(value[here, k])]
        same = np.append(value[order[1:], k] == value[order[:-1], k], False)
        again[order, k] = same | np.append(False, same[:-1])[: len(order)]
    hit = again.any(axis=1) & (n == 1)
    marks = [x.tobytes() for x in np.packbits(again[hit], axis=1)]
    return pa.RecordBatch.from_arrays([pa.array(core[hit]), pa.array(context[hit]), pa.array(marks, pa.binary())], ["core", "context", "marks"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            value, inside = _window_columns(part)
            row, offset = np.nonzero(inside)
            take = lambda name: pa.array(part.column(name).to_numpy()[row])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([take("core"), take("context"), take("n"), pa.array(offset.astype(np.int32)), pa.array(value[row, offset].view(np.int64))], ["core", "context", "n", "offset", "window"])


def _pack_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = []
        for offsets in batch.column("offsets").to_pylist():
            bits = np.zeros(OFFSETS, bool)
            bits[offsets] = True
            marks.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("core"), batch.column("context"), pa.array(marks, pa.binary())], ["core", "context", "marks"])


def _partly_repeated(witnesses: DataFrame, rows: DataFrame, group: int) -> DataFrame:
    """(core, context, marks) of contexts seen once that share windows with another context of their core."""
    possible = materialize(_possible_windows(witnesses, rows), "possible")
    sizes = materialize(possible.groupBy("core").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "possible_cores", possible.count() // 2)
    # each context is told whether its core is large: after a join by core Spark can leave out the exchange of ``together``, and then may
    # read that join's input by mapper or split it, so that the contexts of one core no longer meet
    shared = possible.join(sizes.select("core", (F.col("size") > group).alias("large")), "core")
    wanted = shared.groupBy("row_id").agg(F.collect_list(F.struct("core", "context", "n", "low", "high", "large", "at")).alias("wanted"))
    texts = rows.select("row_id", "text").join(wanted, "row_id").select("text", "wanted")
    contexts = materialize(texts.mapInArrow(_context_bytes, "core long, context long, n long, low int, high int, large boolean, before long, data binary"), "contexts")
    marks = "core long, context long, marks binary"
    together = lambda part: part.repartition("core").sortWithinPartitions("core").mapInArrow(_repeated, marks)
    small = together(contexts.where("not large"))
    if sizes.where(F.col("size") > group).isEmpty():
        return small
    windows = contexts.where("large").mapInArrow(_windows, "core long, context long, n long, offset int, window long")
    windows = materialize(windows, "windows")
    twice = materialize(windows.groupBy("core", "offset", "window").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1").drop("seen"), "repeated_windows")
    large = windows.where("n = 1").join(twice, ["core", "offset", "window"]).groupBy("core", "context").agg(F.collect_list("offset").alias("offsets"))
    return small.unionByName(large.mapInArrow(_pack_offsets, marks))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        whole, parts, marks = (batch.column(k).to_pylist() for k in ("whole", "parts", "marks"))
        for text, at, some, bits in zip(batch.column("text").to_pylist(), whole, parts, marks, strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            n = len(data)
            edges = np.zeros(n + 1, np.int64)
            if at:
                at = np.array(at, np.int64)
                np.add.at(edges, np.maximum(at - BEFORE, 0), 1)
                np.add.at(edges, np.minimum(at + LENGTH, n), -1)
            if some:
                mask = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(some), -1), axis=1)
                row, offset = np.nonzero(mask)
                start = np.array(some, np.int64)[row] - offset
                np.add.at(edges, start, 1)
                np.add.at(edges, start + LENGTH, -1)
            gone = np.cumsum(edges)[:n] > 0
            spans = int((gone & ~np.append(False, gone[:-1])).sum()) if n else 0
            out.append((n, int(gone.sum()), spans, sha256(data[~gone].tobytes()).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes that stay) of every row.

    Texts are UTF-8 bytes; null counts as empty. Texts under LENGTH bytes lose nothing. Equal rows are
    each other's elsewhere. Null and repeated ids keep their rows. Empty table: empty result.
    """
    rows = with_row_ids(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch(docs.sparkSession) as keep:
        cores = rows.select("text").mapInArrow(_cores, "core long")
        again = materialize(cores.groupBy("core").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1").select("core"), "cores")
        positions = rows.select("row_id", "text").mapInArrow(_positions, "core long, context long, row_id long, at long")
        positions = materialize(positions.join(again, "core"), "positions")
        classes = positions.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"), F.min_by("at", "row_id").alias("at"))
        classes = materialize(classes, "context_classes", positions.count())
        count = classes.count()
        several = materialize(classes.groupBy("core").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "mixed_cores", count // 2)
        partly = _partly_repeated(classes.join(several.select("core"), "core"), rows, group)
        judged = classes.where("n > 1").select("core", "context", F.lit(None).cast("binary").alias("marks")).unionByName(partly)
        judged = materialize(judged, "judged", 2 * count)
        spots = positions.join(judged, ["core", "context"]).groupBy("row_id").agg(
            # a collected list skips nulls: whole contexts go to one list, parts with their marks to the others
            F.collect_list(F.when(F.col("marks").isNull(), F.col("at"))).alias("whole"),
            F.collect_list(F.when(F.col("marks").isNotNull(), F.struct("at", "marks"))).alias("some"),
        )
        spots = materialize(spots.select("row_id", "whole", F.transform("some", lambda x: x["at"]).alias("parts"), F.transform("some", lambda x: x["marks"]).alias("marks")), "spots")
        keep(spots)
    return rows.join(spots, "row_id", "left").select("doc_id", "text", "whole", "parts", "marks").mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
