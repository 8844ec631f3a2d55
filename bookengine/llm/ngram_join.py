"""Similarity join on word shingles: size-banded tiles, bitmap bounds, exact intersections.

1. Documents with equal shingle sets form a class; classes are compared, not copies.
2. Tiles are the classes that share a key. A key is a triple of minimum hashes; with 40 keys two sets
   of Jaccard similarity 0.8 share none with probability (1 - 0.8^3)^40 < 4e-13.
3. Each class is first paired with the two pivots (least or largest class of a tile) that share most of its keys, so
   that copies of one page are joined into components by linearly many pairs.
4. Tiles that still hold several components are compared inside. Rows of a tile lie in order of size, and each meets
   those of its size band alone (up to 1.25 times its size); a tile over a block's rows or bytes is cut by band and
   into blocks. Only classes with a possible partner in another component go on to the exact step, where a
   block's links are joined as they are found, so that a block gives at most a tree of links.
5. In both places no pair is intersected before its bitmaps admit it. Signatures are hashed bitmaps, wider
   for larger sets: a bit set on one side alone is a shingle that the other lacks, which bounds the overlap
   from above. Pairs that the bound admits are verified by intersecting sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookengine.llm.columns import as_docs, binary_views, byte_slices, doc_text, numbered, without
from bookengine.llm.components import connected_components
from bookengine.llm.shingles import mix, shingle_sets
from bookengine.llm.store import materialize, scratch

#: Link if PART * intersection >= LEAST * union.
LEAST, PART = 80, 100
KEYS, KEY_ROWS = 40, 3
#: Pivots that a class is paired with, at most.
PIVOTS = 2
#: Classes of one block of a tile, and bytes of their shingles.
BLOCK, BLOCK_BYTES = 2048, 1 << 25
#: Pairs that are judged at a time.
PORTION = 1 << 18
#: Bits of a bitmap for each shingle, at least.
BITS = 4
TILE = ("key", "low", "high", "i", "j")


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:count] | np.uint64(1), numbers[count:]


def tile_keys(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """KEYS numbers, each from KEY_ROWS minimum hashes."""
    mult, add = seeds
    least = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(least, (shingles[k : k + 512, None] * mult + add).min(axis=0), out=least)
    rows = mix(least).reshape(KEYS, KEY_ROWS)
    value = np.arange(KEYS, dtype=np.uint64)
    for j in range(KEY_ROWS):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return value.view(np.int64)


def bitmap(shingles: np.ndarray, bits: int) -> bytes:
    marks = np.zeros(bits, bool)
    marks[(shingles % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def band_bits(n: int) -> int:
    """Width of a set's bitmap: a power of two, of at least BITS bits a shingle. A wider one folds onto a narrower."""
    return max(64, 1 << int(BITS * n - 1).bit_length())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = _seeds(KEYS * KEY_ROWS)
    for batch in byte_slices(batches, "text"):
        rows = []
        for s in shingle_sets(batch):
            keys = tile_keys(s, seeds) if len(s) else np.zeros(0, np.int64)
            rows.append((len(s), blake2b(s.tobytes(), digest_size=16).digest(), keys, bitmap(s, band_bits(len(s))) if len(s) else b""))
        n, digest, keys, marks = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
            ["doc_id", "n", "digest", "keys", "marks"],
        )


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text"):
        sets = [s.tobytes() for s in shingle_sets(batch)]
        same = [blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())], ["cid", "shingles"]).filter(pa.array(same, pa.bool_()))


def _links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if PART * min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return PART * both >= LEAST * (len(a) + len(b) - both) > 0


def _within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their bitmaps admit."""
    for batch in batches:
        size = batch.num_rows
        n = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
        marks = _Signatures([*binary_views(batch.column("ma")), *binary_views(batch.column("mb"))])
        bound = marks.bound(np.arange(size), np.arange(size, 2 * size), n)
        keep = PART * bound >= LEAST * (n[:size] + n[size:] - bound)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets link."""
    for batch in batches:
        sets = zip(binary_views(batch.column("sa")), binary_views(batch.column("sb")), strict=True)
        keep = [_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sets]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by tile, tiles whole across batches, and where each tile starts (with a final end)."""
    kept: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if kept is None else pa.concat_tables([kept, rows])).combine_chunks()
        starts = _tile_starts(rows)
        last = int(starts[-1]) if len(starts) else 0
        kept = rows.slice(last)
        if last:
            yield rows.slice(0, last), starts
    if kept is not None and len(kept):
        yield kept, np.array([0, len(kept)])


def _tile_starts(rows: pa.Table) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    if len(rows):
        new[0] = True
        for name in TILE:
            column = rows.column(name).to_numpy()
            new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


class _Signatures:
    """Bitmaps of rows, as words, at their own width or folded onto a narrower one: pieces laid over each other."""

    def __init__(self, marks: list[bytes]):
        self.width = np.array([len(m) // 8 for m in marks], np.int64)
        self.place = np.zeros(len(marks), np.int64)
        self.full: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == width)
            self.place[rows] = np.arange(len(rows))
            self.full[width] = np.frombuffer(b"".join(marks[r] for r in rows), np.uint64).reshape(len(rows), width)
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def at(self, width: int, narrow: int) -> np.ndarray:
        if (width, narrow) not in self.folded:
            full = self.full[width]
            self.folded[width, narrow] = np.bitwise_or.reduce(full.reshape(len(full), width // narrow, narrow), axis=1)
        return self.folded[width, narrow]

    def bound(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Largest possible intersections of rows ``a`` with rows ``b``."""
        out = np.zeros(len(a), np.int64)
        pair = self.width[a] * (1 << 32) + self.width[b]
        for code in np.unique(pair).tolist():
            rows = np.flatnonzero(pair == code)
            wa, wb = code >> 32, code & 0xFFFFFFFF
            narrow = min(wa, wb)
            x, y = self.at(wa, narrow), self.at(wb, narrow)
            step = max(1, (1 << 20) // narrow)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                s, t = x[self.place[a[part]]], y[self.place[b[part]]]
                only_a = np.bitwise_count(s & ~t).sum(axis=1, dtype=np.int64)
                only_b = np.bitwise_count(t & ~s).sum(axis=1, dtype=np.int64)
                out[part] = np.minimum(n[a[part]] - only_a, n[b[part]] - only_b)
        return out


class _Tiles:
    """The pairs of a table of whole tiles that may link: other component, same size band, left with right, admitted by the bitmaps."""

    def __init__(self, rows: pa.Table):
        self.left, self.right, self.comp, self.n, self.key = (rows.column(k).to_numpy() for k in ("left", "right", "comp", "n", "key"))
        kept = rows.column("kept").combine_chunks()
        self.kept, self.kept_by = kept.flatten().to_numpy(), np.cumsum([0, *kept.value_lengths().to_pylist()])
        self.marks = _Signatures(list(binary_views(rows.column("marks"))))

    def pairs(self, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of one tile, in portions."""
        order = start + np.argsort(self.n[start:end], kind="stable")
        n = self.n[order]
        # in order of size each row meets the rows behind it, up to the largest size that it can link with
        count = np.searchsorted(n, n * PART // LEAST, side="right") - np.arange(len(n)) - 1
        upto = np.cumsum(count)
        lower, first = None, 0
        while first < len(n):
            before = int(upto[first] - count[first])
            last = max(first + 1, int(np.searchsorted(upto, before + PORTION, side="right")))
            i = np.repeat(np.arange(first, last), count[first:last])
            j = np.arange(len(i)) - np.repeat(upto[first:last] - count[first:last] - before, count[first:last]) + i + 1
            a, b = self._admitted(order[i], order[j])
            if len(a):
                lower = self._lower_keys(start, end) if lower is None else lower
                alone = ~_meet(lower, a - start, b - start)
                yield a[alone], b[alone]
            first = last

    def _admitted(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (self.comp[a] != self.comp[b]) & ((self.left[a] & self.right[b]) | (self.left[b] & self.right[a]))
        a, b = a[ok], b[ok]
        bound = self.marks.bound(a, b, self.n)
        ok = PART * bound >= LEAST * (self.n[a] + self.n[b] - bound)
        return a[ok], b[ok]

    def _lower_keys(self, start: int, end: int) -> np.ndarray:
        """A bit for each key below the tile's own that several of its rows have: a pair that shares one counts in that tile."""
        at = slice(self.kept_by[start], self.kept_by[end])
        row = np.repeat(np.arange(end - start), np.diff(self.kept_by[start : end + 1]))
        below = self.kept[at] < self.key[start]
        _, code, seen = np.unique(self.kept[at][below], return_inverse=True, return_counts=True)
        several = seen[code] > 1
        place = (np.cumsum(seen > 1) - 1)[code[several]].astype(np.uint64)
        bits = np.zeros((end - start, int((seen > 1).sum()) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (row[below][several], (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        return bits


def _meet(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` have a bit in common."""
    step = max(1, (1 << 20) // bits.shape[1])
    return np.concatenate([np.zeros(0, bool), *((bits[a[k : k + step]] & bits[b[k : k + step]]).any(axis=1) for k in range(0, len(a), step))])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tile that have a possible partner in it."""
    for rows, starts in _whole_tiles(batches):
        tiles, some = _Tiles(rows), np.zeros(len(rows), bool)
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            for a, b in tiles.pairs(start, end):
                some[a] = some[b] = True
        yield from rows.filter(pa.array(some)).combine_chunks().to_batches()


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each tile, as a forest over the components that it holds."""
    for rows, starts in _whole_tiles(batches):
        tiles, sets = _Tiles(rows), [np.frombuffer(x, np.uint64) for x in binary_views(rows.column("shingles"))]
        root, found = tiles.comp.copy(), []
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            tile = root[start:end]
            for a, b in tiles.pairs(start, end):
                while len(a := a[apart := root[a] != root[b]]):
                    b = b[apart]
                    # up to the first link, which joins two components: pairs between these need no test any more
                    k = next((k for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if _links(sets[x], sets[y])), None)
                    if k is None:
                        break
                    found.append((a[k], b[k]))
                    tile[tile == root[a[k]]] = root[b[k]]
                    a, b = a[k + 1 :], b[k + 1 :]
        left, right = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        cid = rows.column("cid").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(cid[left]), pa.array(cid[right])], ["a", "b"])


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cid and sorted shingles of the wanted classes (cid), from the text of one document each; written."""
    wanted = wanted.distinct().join(classes.select("cid", "rep", "digest"), "cid").withColumnRenamed("rep", "_rep")
    texts = doc_text(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("cid", "digest", "text")
    # rows that repeat a doc_id with another text are told apart by the digest
    return materialize(texts.mapInArrow(_arrays, "cid long, shingles binary"), "shingles")


def _shared_tiles(classes: DataFrame, count: int) -> DataFrame:
    """cid, key and pivot of the tiles of several classes; written. Of some keys the least class is the pivot, of the others the largest."""
    tiles = classes.select("cid", F.explode("keys").alias("key"))
    ends = tiles.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high")
    # written, so that the join has plain exchanges, whose hot partitions Spark splits
    pivots = materialize(ends.select("key", F.when(F.col("key") % 2 == 0, F.col("low")).otherwise(F.col("high")).alias("pivot")), "pivots", count * KEYS // 2)
    return materialize(tiles.join(pivots, "key"), "tiles", count * KEYS)


def _pivot_pairs(tiles: DataFrame, classes: DataFrame, count: int) -> DataFrame:
    """Pairs (a, b) of a class and a pivot of its tiles, PIVOTS a class at most, that the bitmaps admit."""
    shared = tiles.where("cid <> pivot").groupBy("cid", "pivot").agg(F.count(F.lit(1)).alias("keys"))
    # a class has KEYS pivots at most
    best = shared.groupBy("cid").agg(F.collect_list(F.struct("keys", "pivot")).alias("best")).select("cid", F.explode(F.slice(F.sort_array("best", asc=False), 1, PIVOTS)).alias("best"))
    pairs = materialize(best.select(F.col("cid").alias("a"), F.col("best.pivot").alias("b")), "pivot_pairs", count * PIVOTS)
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb"))
    admitted = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_within_bound, "a long, b long")
    return materialize(admitted, "stars", count * PIVOTS)


def _pivot_links(stars: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    sets = _sets(stars.select(F.explode(F.array("a", "b")).alias("cid")), classes, docs)
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    # b is the pivot of many pairs: it is joined first, to pairs that carry no array yet
    joined = stars.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return joined.mapInArrow(_linked, "a long, b long").distinct()


def _dealt(tiles: DataFrame, member: DataFrame, classes: DataFrame, count: int) -> DataFrame:
    """Rows of the tiles that hold several components, dealt to blocks: TILE, left, right, cid, comp, n, marks, kept."""
    rows = tiles.join(member.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("comp"))
    met = rows.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cid")).alias("one"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("two")
    )
    # small groups meet under many keys: of keys with the same members one is enough
    mixed = met.where("lo < hi").groupBy("size", "one", "two").agg(F.min("key").alias("key")).select("key")
    # written, so that the joins have plain exchanges, whose hot partitions Spark splits
    mixed = materialize(mixed, "mixed", count * KEYS // 2)
    members = rows.join(mixed, "key").groupBy("cid").agg(F.min("comp").alias("comp"), F.collect_list("key").alias("kept"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(PART / LEAST)) + 1e-9).cast("long")
    members = materialize(members.join(classes.select("cid", "n", "marks"), "cid").withColumn("band", band), "tile_members", count)
    sizes = members.select(F.explode("kept").alias("key"), "band", "n").groupBy("key", "band").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    # a block is bounded in rows and in bytes of shingles, of which a set of this band has eight for each of so many
    fits = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), BLOCK_BYTES / (8 * F.pow(F.lit(PART / LEAST), F.col("band") + 1))))
    total = sizes.groupBy("key").agg((F.sum("size") <= BLOCK).alias("few"), (8 * F.sum("shingles") <= BLOCK_BYTES).alias("light")).select("key", (F.col("few") & F.col("light")).alias("one_block"))
    blocks = sizes.select("key", "band", F.ceil(F.col("size") / F.floor(fits)).cast("int").alias("blocks"))
    # a band's rows meet their own band, as left side the next one, as right side the last one
    after = blocks.select("key", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_after"))
    before = blocks.select("key", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_before"))
    counts = materialize(blocks.join(after, ["key", "band"], "left").join(before, ["key", "band"], "left").join(total, "key"), "blocks", count * KEYS)
    dealt = members.withColumn("key", F.explode("kept")).join(counts, ["key", "band"])
    me = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    tile = lambda low, high, i, j, left, right: F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # a group that fits one block is one tile
    zero, yes = F.lit(0), F.lit(True)
    whole = F.array(tile(F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint"), zero, zero, yes, yes))
    own = F.transform(upto(F.col("blocks")), lambda o: tile(F.col("band"), F.col("band"), F.least(me, o), F.greatest(me, o), me <= o, me >= o))
    up = F.transform(upto(F.coalesce("blocks_after", F.lit(0))), lambda o: tile(F.col("band"), F.col("band") + 1, me, o, F.lit(True), F.lit(False)))
    down = F.transform(upto(F.coalesce("blocks_before", F.lit(0))), lambda o: tile(F.col("band") - 1, F.col("band"), o, me, F.lit(False), F.lit(True)))
    dealt = dealt.select("key", "cid", "comp", "n", "marks", "kept", F.explode(F.when(F.col("one_block"), whole).otherwise(F.concat(own, up, down))).alias("t"))
    return dealt.select("key", "t.*", "cid", "comp", "n", "marks", "kept")


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(*TILE).sortWithinPartitions(*TILE)


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row.

    Null, empty and blank texts have no shingle and link with nothing, not even with each other; their
    component is their own id. Texts of fewer than five words are one shingle. Rows that repeat an id
    keep their rows. Null ids take part; a component without any id has a null id. Empty table: empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch(docs.sparkSession) as keep:
        profile = materialize(doc_text(docs).mapInArrow(_profile, f"doc_id {kind}, n long, digest binary, keys array<long>, marks binary"), "profile")
        classes = profile.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("marks").alias("marks"))
        # written, so that the numbers stay
        classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes", profile.count())
        count = classes.count()
        tiles = _shared_tiles(classes, count)
        links = materialize(_pivot_links(_pivot_pairs(tiles, classes, count), classes, docs), "links", count * PIVOTS)
        member = materialize(connected_components(links), "members", count)
        dealt = _dealt(tiles.select("cid", "key"), member, classes, count)
        possible = materialize(_by_tile(dealt).mapInArrow(_possible, dealt.schema), "possible")
        if not possible.isEmpty():
            sets = _sets(possible.select("cid"), classes, docs)
            more = _by_tile(possible.join(sets, "cid").select(*possible.columns, "shingles")).mapInArrow(_tile_links, "a long, b long")
            links = materialize(links.unionByName(more), "links")
            member = materialize(connected_components(links), "members", count)
        roots = classes.select("cid", "digest", "rep").join(member.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        least = materialize(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "least", count)
        named = materialize(roots.join(least, "root").select("digest", "component_id"), "components", count)
        keep(profile, named)
    return profile.select("doc_id", "n", "digest").join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_component(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, less those that link to a document of smaller id.

    Of rows that share an id one stays for each component, by their order in the table. Documents
    without words all stay.
    """
    rows, row = numbered(docs)
    return without(rows, row, ngram_components(as_docs(rows, row)).where("doc_id > component_id"), docs)
