"""Fill-in-middle transformation with a sparse index of multibyte characters.

Texts are UTF-8 bytes. The index of a step of texts holds only its multibyte characters: where each starts, in bytes
and in code points, and how many bytes more than one they have taken so far. A cut is converted by one binary search
in that list and one addition, in either direction; where a text is ASCII the list is empty and both counts are equal.

Cuts are made between units (lines or code points) and depend on a hash of the document's id alone, so that a repeated
run gives the same rows. All work is in one pass over the rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookengine.llm.columns import byte_slices, byte_steps

#: Marks in front of prefix, suffix and middle. Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
UNITS = ("line", "char")


class MultibyteIndex:
    """The multibyte characters of UTF-8 bytes: ``at`` (byte where each starts), ``char_at`` (its code point) and ``excess`` (bytes beyond one a character in the first k of them)."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.char_at = self.at - self.excess[:-1]

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points in front of byte cuts (at borders of characters)."""
        return cut - self.excess[np.searchsorted(self.at, cut, side="left")]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Byte cuts that have so many code points in front of them."""
        return cut + self.excess[np.searchsorted(self.char_at, cut, side="left")]


def unit_cuts(data: np.ndarray, offsets: np.ndarray, index: MultibyteIndex, unit: str, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the byte cut behind ``draw % (n + 1)`` of them for each column of draws."""
    if unit == "char":
        first = index.chars(offsets)
        n = np.diff(first)
        return n, index.bytes(first[:-1, None] + draws % (n + 1)[:, None])
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[1:]]))
    ends = ends[ends > 0]
    first, last = (np.searchsorted(ends, x, side="right") for x in (offsets[:-1], offsets[1:]))
    n = last - first
    take = draws % (n + 1)[:, None]
    # behind no unit a cut stands at the text's start
    behind = ends[np.minimum(first[:, None] + np.maximum(take, 1) - 1, max(len(ends) - 1, 0))] if len(ends) else np.zeros_like(take)
    return n, np.where(take > 0, behind, offsets[:-1, None])


def _transform(unit: str, rate: int, spm_rate: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            for start, end, data, offsets in byte_steps(batch):
                step = batch.slice(start, end - start)
                draws = np.stack([step.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)], axis=1)
                marked = np.zeros(end - start, bool)
                for mark in (PREFIX, SUFFIX, MIDDLE):
                    marked |= pc.match_substring(step.column("text"), mark).to_numpy(zero_copy_only=False)
                index = MultibyteIndex(data)
                n, cuts = unit_cuts(data, offsets, index, unit, draws[:, :2])
                a, b = cuts.min(axis=1), cuts.max(axis=1)
                plain = marked | (np.diff(offsets) == 0) | (draws[:, 2] % 100 >= rate)
                spm = draws[:, 3] % 100 < spm_rate
                chars = index.chars(np.stack([offsets[:-1], a, b], axis=1))
                whole = memoryview(np.ascontiguousarray(data))
                out = []
                for lo, x, y, hi, as_is, swap in zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
                    if as_is:
                        out.append(bytes(whole[lo:hi]))
                    elif swap:
                        out.append(b"".join((s, whole[y:hi], p, whole[lo:x], m, whole[x:y])))
                    else:
                        out.append(b"".join((p, whole[lo:x], s, whole[y:hi], m, whole[x:y])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                counts = (pa.array(v, mask=plain) for v in (chars[:, 1] - chars[:, 0], chars[:, 2] - chars[:, 1], a - offsets[:-1], b - a))
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()), *counts, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"])

    return rows


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points), prefix_bytes, middle_bytes and output.

    ``unit`` is line (``[^\\n]*\\n|[^\\n]+``) or char (code point). Of 100 documents ``rate`` are cut, of these ``spm_rate``
    have the suffix first. One row per input row, repeated rows and ids included: rows of one id get the same draws. Null
    texts count as empty; empty texts and texts that hold a mark stay plain, with null counts. A null doc_id draws as the
    empty string. Very long texts are steps of their own. Empty table: empty result.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *draws)
    return rows.mapInArrow(_transform(unit, rate, spm_rate), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks can't arise where parts meet, as none begins with another's end."""
    parts = F.split(F.substring(output, 1 + len(PREFIX), (1 << 31) - 1), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    joined = F.when(form == "psm", F.concat(parts[0], parts[2], parts[1])).otherwise(F.concat(parts[1], parts[2], parts[0]))
    return F.when(form == "plain", output).otherwise(joined)
