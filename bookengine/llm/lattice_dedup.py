"""Embedding near-duplicates by lattice hashing.

Each table projects the normalised vectors to eight random directions, scales and shifts them, and decodes
the result to the nearest point of the E8 lattice: that cell is the vector's home. A vector also
probes the neighbouring cells that its projection lies nearest to. Vectors of one label meet where a
probe hits a home. A sketch of 128 signs of random projections travels with each row, and pairs whose sketches differ in more
bits than near vectors do are left out of the join; every other pair that meets is verified by its cosine in double precision.

With the defaults a pair at cosine 0.93 meets in at least one table with probability above 0.999.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookengine.llm.components import connected_components
from bookengine.llm.shingles import mix
from bookengine.llm.store import materialize, scratch

LEAST_COSINE = 0.93
TABLES = 14
PROBES = 4
SCALE = 0.9
SEED = 20_240_607
#: Signs of a sketch, and standard deviations beyond the mean that the bits of a pair at the least cosine may differ by.
SIGNS, DEVIATIONS = 128, 6.5


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: from a lattice point to its neighbours."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            root = np.zeros(8)
            root[i], root[j] = a, b
            whole.append(root)
    halves = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + halves)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest whole points of even sum: round, and where the sum is odd turn the coordinate that was rounded furthest."""
    point = np.rint(y)
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    off = y[odd] - point[odd]
    worst = np.abs(off).argmax(axis=1)
    point[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by a half: the nearer of the two nearest points."""
    whole = _nearest_d8(y)
    half = _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _number(points: np.ndarray, table: int) -> np.ndarray:
    """A number for each lattice point of a table."""
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    value = np.full(doubled.shape[:-1], table + 1, np.uint64)
    for k in range(8):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + doubled[..., k])
    return value.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (rows x tables) and probed cells (rows x tables x probes) of unit vectors."""
    roots = e8_roots()
    home = np.zeros((len(unit), tables), np.int64)
    near = np.zeros((len(unit), tables, probes), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, unit.shape[1]])
        y = unit @ (rng.normal(size=(unit.shape[1], 8)) * scale) + rng.uniform(size=8)
        point = nearest_e8(y)
        home[:, t] = _number(point, t)
        if probes:
            lead = np.argsort(-((y - point) @ roots.T), axis=1, kind="stable")[:, :probes]
            near[:, t] = _number(point[:, None, :] + roots[lead], t)
    return home, near


def sketches(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows x 2 numbers: the signs of SIGNS random projections."""
    rng = np.random.default_rng([seed, SIGNS, unit.shape[1]])
    return np.packbits(unit @ rng.normal(size=(unit.shape[1], SIGNS)) > 0, axis=1).view(np.int64)


def most_differing(least: float) -> int:
    """Bits that the sketches of vectors at this cosine or a larger one differ in at most: two signs differ with probability angle / pi."""
    p = math.acos(min(max(least, -1.0), 1.0)) / math.pi
    return math.ceil(SIGNS * p + DEVIATIONS * math.sqrt(SIGNS * p * (1 - p)))


def _dealer(tables: int, probes: int, scale: float, seed: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                vectors = part.column("embedding").to_pylist()
                width = np.array([len(v) for v in vectors])
                home, near, signs = np.zeros((len(vectors), tables), np.int64), np.zeros((len(vectors), tables, probes), np.int64), np.zeros((len(vectors), 2), np.int64)
                for size in np.unique(width):
                    rows = np.flatnonzero(width == size)
                    x = np.array([vectors[i] for i in rows], np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    home[rows], near[rows] = cells(x, tables, probes, scale, seed)
                    signs[rows] = sketches(x, seed)
                near = near.reshape(len(vectors), -1)
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("label"), pa.array(list(home), pa.list_(pa.int64())), pa.array(list(near), pa.list_(pa.int64())), pa.array(signs[:, 0]), pa.array(signs[:, 1])], ["cid", "label", "home", "near", "s", "t"])

    return deal


def _judge(least: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            va, vb = batch.column("va"), batch.column("vb")
            size, other = (x.value_lengths().to_numpy(zero_copy_only=False) for x in (va, vb))
            for width in np.unique(size[size == other]):
                rows = np.flatnonzero((size == width) & (other == width))
                for k in range(0, len(rows), 4000):
                    part = rows[k : k + 4000]
                    x, y = (v.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), width) for v in (va, vb))
                    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
                    keep[part] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return judge


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; links join rows of equal label alone.

    Equal vectors of a label form a class: its members link with each other, and classes are compared
    once. Null, zero and empty vectors, vectors with a null or non-finite component, and null labels link
    with nothing; vectors of different lengths never link. Rows that repeat an id keep their rows; a null id is
    its own component unless it links. Empty table: empty result.
    """
    x = F.col("embedding")
    # null components make the test null
    usable = F.col("label").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding", usable.alias("usable"))
    with scratch(vectors.sparkSession) as keep:
        # written, so that the class numbers stay
        classes = materialize(rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")).withColumn("cid", F.monotonically_increasing_id()), "classes")
        label = vectors.schema["label"].dataType.simpleString()
        dealt = materialize(classes.mapInArrow(_dealer(tables, probes, scale, seed), f"cid long, label {label}, home array<long>, near array<long>, s long, t long"), "cells")
        home = dealt.select("label", F.explode("home").alias("cell"), F.col("cid").alias("b"), F.col("s").alias("sb"), F.col("t").alias("tb"))
        probe = dealt.select("label", F.explode(F.concat("home", "near")).alias("cell"), F.col("cid").alias("a"), F.col("s").alias("sa"), F.col("t").alias("ta"))
        differing = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) + F.bit_count(F.col("ta").bitwiseXOR(F.col("tb")))
        pairs = probe.join(home, ["label", "cell"]).where((F.col("a") != F.col("b")) & (differing <= most_differing(least))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        left = classes.select(F.col("cid").alias("a"), F.col("embedding").alias("va"))
        right = classes.select(F.col("cid").alias("b"), F.col("embedding").alias("vb"))
        links = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(_judge(least), "a long, b long"), "links")
        sizes = classes.select("cid", "size")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        partners = both.join(sizes.withColumnRenamed("cid", "b"), "b").groupBy("a").agg(F.sum("size").alias("others")).withColumnRenamed("a", "cid")
        member = connected_components(links).withColumnRenamed("node", "cid")
        named = classes.join(partners, "cid", "left").join(member, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        named = materialize(named.select("label", "embedding", "rep", "root", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "classes_linked")
        least_id = materialize(named.groupBy("root").agg(F.min("rep").alias("component_id")), "components")
        keep(named, least_id)
    named = named.join(least_id, "root").select("label", "embedding", "n_links", "component_id", F.lit(True).alias("usable"))
    found = rows.join(named, ["label", "embedding", "usable"], "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
