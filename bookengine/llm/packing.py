"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document (its token ids and one end id) is cut into pieces of at most ``piece`` tokens; whole windows
of ``capacity`` tokens stand alone, and a document ends with one small piece. The other pieces are dealt into bounded groups by a hash, and each
group is divided into as many windows as its tokens need: every piece starts as a partial partition
with one filled part, and the two partitions of largest imbalance merge, the fullest part of one onto
the emptiest of the other. If a part exceeds the capacity, the window count rises and the group is
divided again.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookengine.llm.columns import byte_slices, doc_text
from bookengine.llm.store import materialize

CAPACITY = 2048
#: Cut of the rest of a document beside its whole windows; smaller pieces level better.
PIECE = 512
END_ID = 1
#: Pieces a group holds on average.
GROUP_PIECES = 1600
#: Small pieces that documents end with, one each, by their token count: the last ones to be placed, they level what is left.
SLIVERS = (8, 16, 32, 64)
#: Encoded words that a Python worker remembers before it forgets all.
CACHE_WORDS = 50_000


class WordEncoder:
    """Little-endian 32-bit ids of whole texts under a byte-level BPE tokenizer file.

    The split pattern always cuts between a non-space and a single space that a non-space follows, so
    the ids of a text are the ids of such chunks in order, and a chunk need be encoded only once.
    Chunks not yet known are encoded joined, by tiktoken, from the file's own vocabulary: in this kind
    of file the ids are the merge ranks. A string of an added token is its one id, as the file declares, and
    what stands between two is encoded on its own.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        if any(x[flag] for x in model["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: an added token takes in what stands beside it")
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.added = {content: np.array([i], "<u4").tobytes() for content, i in special.items()}
        # the longest of the tokens that start at a place
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        byte_of = {ord(char): byte for char, byte in zip(*_byte_letters(), strict=True)}
        ranks = {bytes(byte_of[ord(c)] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        ids = self._ids(" " + " ".join(words))
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(x.encode()) + 1 for x in words])) + 1
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self.known[word] = raw[start:end]
            start = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        # split by a group: texts at even places, added tokens at odd ones
        parts = [self.cut.split(x) if self.cut and x else [x] for x in texts]
        between = self._encode_plain([x for part in parts for x in part[::2]])
        for part in parts:
            yield b"".join(self.added[x] if k % 2 else next(between) for k, x in enumerate(part))

    def _encode_plain(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        # around double spaces a chunk depends on its neighbours: such texts are encoded whole
        split = [None if not x or "  " in x or x[0] == " " or x[-1] == " " else x.split(" ") for x in texts]
        self._learn(list({w for x in split if x for w in x[1:] if w not in self.known}))
        for text, words in zip(texts, split, strict=True):
            if words is None:
                yield self._ids(text).tobytes()
            else:
                yield self._ids(words[0]).tobytes() + b"".join(map(self.known.__getitem__, words[1:]))


def _byte_letters() -> tuple[str, range]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(moved)) for b in range(256)), range(256)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cuts(tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    whole = tokens // capacity * capacity
    sliver = SLIVERS[tokens % len(SLIVERS)]
    end = [tokens] if tokens - whole > 4 * sliver else []
    rest = tokens - whole - (sliver if end else 0)
    parts = -(-rest // piece)
    edges = [whole + rest * i // parts for i in range(parts + 1)] + end if parts else []
    return [(s, capacity) for s in range(0, whole, capacity)] + [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _cutter(tokenizer_path: str, capacity: int, piece: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in byte_slices(batches, "text"):
            ids, rows = batch.column("doc_id"), []
            texts = batch.column("text").to_pylist()
            for i, raw in enumerate(x + end for part in range(0, len(texts), 200) for x in encoder.encode(texts[part : part + 200])):
                for start, length in _cuts(len(raw) // 4, capacity, piece):
                    rows.append((i, start, length, crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4))
            at, start, length, crc, total = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([],) * 5))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *map(pa.array, (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_text(docs).mapInArrow(_cutter(tokenizer_path, capacity, piece, end_id), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Divide items into ``windows`` parts of near-equal sums (largest differencing method).

    A partial partition is a list of (sum, items) in descending order; missing parts are empty.
    """
    heap = [(-x, i, [(x, [i])]) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the k-th fullest of one meets the k-th emptiest of the other
        spare = windows - len(a)
        merged = a + b[:spare] if len(b) <= spare else a + b[:spare]
        for k, (total, items) in enumerate(b[spare:]):
            place = len(a) - 1 - k
            merged[place] = (merged[place][0] + total, merged[place][1] + items)
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], turn, merged))
        turn += 1
    return [items for _, items in heap[0][2]] if heap else []


def pack_group(lengths: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity`` by largest differencing; the window count rises while a part is over."""
    windows = max(1, -(-sum(lengths) // capacity)) if lengths else 0
    while windows:
        parts = differencing(lengths, windows)
        if max(sum(lengths[i] for i in part) for part in parts) <= capacity:
            return parts
        windows += 1
    return []


def _packer(capacity: int):
    def pack(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        group = group.take(pc.sort_indices(group, sort_keys=order))
        lengths = group.column("length").to_numpy()
        whole = int((lengths == capacity).sum())
        parts = [[i] for i in range(whole)] + [[whole + i for i in part] for part in pack_group(lengths[whole:].tolist(), capacity)]
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for k, part in enumerate(parts):
            sequence[part] = k
            offset[part] = np.cumsum([0, *lengths[part][:-1]])
        sequence += group.column("bucket").to_numpy().astype(np.int64) << 32
        return group.drop_columns("bucket").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with the sequence and the offset that each goes to: every id of every document, once.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; the pieces of a sequence
    fill it from 0 without gaps, up to ``capacity`` tokens.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are packed each on its own; a
    null doc_id is allowed. Empty table: empty result. A document of any length is dealt over many
    groups by piece, so that no group grows with it.
    """
    pieces = materialize(document_pieces(docs, tokenizer_path, capacity, piece, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # the row's place in the table takes part, so that rows repeating one document spread as well
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("bucket").applyInArrow(_packer(capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
