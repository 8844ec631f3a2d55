"""Exact dedup against a minimal perfect hash over the digests of earlier documents.

The history is an index of shards. A shard covers the digests with one remainder and stores
* ``levels``: bit arrays of a layered perfect hash; a digest's slot is the rank of the first bit that
  it alone claimed,
* ``digests``: the full 32-byte digests in slot order, compared byte by byte at every lookup,
* ``winners``, ``places`` and ``sizes``: the doc_id that stays, the place of its row, and the number of rows of each digest.

Rows are pre-aggregated to distinct digests before any lookup, so a text that fills a third of the
table is one probe. Digests not in the history are grouped on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from hashlib import sha256
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookengine.llm.columns import as_docs, byte_slices, doc_text, numbered, without
from bookengine.llm.store import materialize, scratch

#: Distinct digests that one shard holds on average: 20,000 x 48 bytes, about 1 MB.
SHARD_DIGESTS = 20_000
GAMMA = 2.0
#: Stands for a missing doc_id.
LOWEST = -(1 << 63)
INDEX = "shard long, levels array<binary>, digests binary, winners binary, places binary, sizes binary"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([sha256(x.encode().lower()).digest() for x in texts], pa.binary())],
            ["doc_id", "digest"],
        )


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id and SHA-256 of the text after lower-casing A-Z (bytes.lower touches ASCII letters only)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_text(docs).mapInArrow(_digests, f"doc_id {kind}, digest binary")


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest (rows of four words) in the bit array of a level."""
    x = keys[:, level % 4] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_levels(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Bit arrays of the perfect hash, and the slot of each of the distinct keys."""
    slots, rest, levels, before = np.zeros(len(keys), np.int64), np.arange(len(keys)), [], 0
    while len(rest):
        size = max(8, int(GAMMA * len(rest)) + 7 & ~7)
        place = _places(keys[rest], len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        won = alone[place]
        rank = np.cumsum(alone) - 1
        slots[rest[won]] = before + rank[place[won]]
        levels.append(np.packbits(alone).tobytes())
        before += int(alone.sum())
        rest = rest[~won]
    return levels, slots


def find_slots(keys: np.ndarray, levels: list[bytes]) -> np.ndarray:
    """Slot that the perfect hash names for each key; -1 if no level claims it. Only a byte check tells members."""
    slots, rest, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, packed in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        place = _places(keys[rest], k, len(bits))
        hit = bits[place]
        slots[rest[hit]] = before + (np.cumsum(bits) - 1)[place[hit]]
        before += int(bits.sum())
        rest = rest[~hit]
    return slots


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _build_shard(group: pd.DataFrame) -> pd.DataFrame:
    levels, slots = build_levels(_words(group["digest"]))
    order = np.argsort(slots)
    return pd.DataFrame(
        {
            "shard": [int(group["shard"].iloc[0])],
            "levels": [levels],
            "digests": [b"".join(group["digest"].iloc[order])],
            "winners": [group["winner"].to_numpy(np.int64)[order].tobytes()],
            "places": [group["place"].to_numpy(np.int64)[order].tobytes()],
            "sizes": [group["n"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def _look_up(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The probes as they are or, for members, with the history's winner where it is the larger, and with both sizes."""
    out = probes[["digest", "winner", "place", "n"]].copy()
    if len(index) and len(probes):
        shard = index.iloc[0]
        slots = find_slots(_words(probes["digest"]), list(shard["levels"]))
        stored = np.frombuffer(shard["digests"], dtype="<u8").reshape(-1, 4)
        member = (slots >= 0) & (stored[slots] == _words(probes["digest"])).all(axis=1)
        winners, places, sizes = (np.frombuffer(shard[k], np.int64)[slots] for k in ("winners", "places", "sizes"))
        older = member & (winners > out["winner"].to_numpy(np.int64))
        out["winner"], out["place"] = np.where(older, winners, out["winner"]), np.where(older, places, out["place"])
        out["n"] += np.where(member, sizes, 0)
    return out


def _per_digest(digests: DataFrame, shards: int) -> DataFrame:
    """One row a digest: the winner (largest doc_id), the place of its row and the number of rows, from partial aggregates."""
    key = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    # a row without doc_id counts, but can't stay while another row of its text has one
    id_ = F.coalesce("doc_id", F.lit(LOWEST))
    return digests.groupBy("digest").agg(F.max(id_).alias("winner"), F.max_by("row", id_).alias("place"), F.count(F.lit(1)).alias("n")).withColumn("shard", key % shards)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Index over ``history`` (doc_id, digest, row): one row per shard, each of bounded size."""
    return _per_digest(history, shards).groupBy("shard").applyInPandas(_build_shard, INDEX)


def look_up(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Distinct digests of ``incoming`` with winner, place and size; those of members take the history in."""
    probes = _per_digest(incoming, shards)
    return probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look_up, "digest binary, winner long, place long, n long")


def exact_dedup(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """Which row of each text stays.

    The rows whose hashed doc_id falls under ``history_share`` make the history, the others come in
    against it; any share gives the same result. Returns one row per input row: doc_id, keep_id
    (largest doc_id with this text), group_size, kept, text_sha256.

    Null text counts as empty. Of rows that repeat a doc_id and its text one is kept. A null doc_id
    never wins against another and is kept only where no row of the text has an id. Empty table: empty result. Other
    columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        # written, so that the row numbers, which settle ties, stay
        digests = materialize(text_digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
        count = digests.count()
        shards = max(1, -(-count // SHARD_DIGESTS))
        old = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1000)), F.lit(0)) < int(1000 * history_share)
        index = materialize(build_index(digests.where(old), shards), "index")
        fresh = look_up(digests.where(~old), index, shards)
        # a member's row holds all of its digest, and so is the larger; unvisited slots have one row, nonmembers are groups of their own
        slots = index.mapInPandas(_slots, "digest binary, winner long, place long, n long")
        groups = slots.unionByName(fresh).groupBy("digest").agg(F.max("winner").alias("winner"), F.max_by("place", "n").alias("stays"), F.max("n").alias("group_size"))
        groups = materialize(groups.select("digest", F.nullif("winner", F.lit(LOWEST)).alias("keep_id"), "stays", "group_size"), "groups", count)
        keep(digests, groups)
    return digests.hint("merge").join(groups, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, less all but one of each text: the row of largest doc_id stays."""
    rows, row = numbered(docs, nulls_last=False)
    return without(rows, row, exact_dedup(as_docs(rows, row)).where("not kept"), docs)


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            raw = row.digests
            yield pd.DataFrame({"digest": [raw[i : i + 32] for i in range(0, len(raw), 32)], "winner": np.frombuffer(row.winners, np.int64), "place": np.frombuffer(row.places, np.int64), "n": np.frombuffer(row.sizes, np.int64)})
