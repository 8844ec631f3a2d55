"""Packing, mixing, vectors, the pipeline, and the registered queries."""

import math
import os
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookengine.llm import queries as q
from bookengine.llm import store
from bookengine.llm.exact_dedup import drop_repeats
from bookengine.llm.lattice_dedup import e8_roots, most_differing, near_vectors, nearest_e8, sketches
from bookengine.llm.mixing import mix_sources, mixed_documents, source_targets
from bookengine.llm.ngram_join import one_of_each_component
from bookengine.llm.packing import CAPACITY, END_ID, WordEncoder, differencing, pack_documents, pack_group
from bookengine.llm.quality import keep_quality
from compare import DATA, assert_same

ODD = ["", " ", "a  b", "<|endoftext|> x\n y \n\nz", " x y　z it's we'll  ", "x \n y", "ab  cd \tef", "über 123 €", "x" * 3000, "\n", "a\n b"]


ADDED = ["<|endoftext|>", "<|endoftext|>" * 3, "one <|endoftext|> two", "one<|endoftext|>two  three ", "<|endoftext|>\n\n x", "<|endoftext|", "a <|endoftext|><|endoftext|>", "<|<|endoftext|>|>", "é  <|endoftext|>  é"]


def contract_ids(texts):
    """Ids under the tokenizer file as it is, with nothing set on it."""
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(q.tokenizer_path())
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder():
    texts = ADDED + ODD
    expected = contract_ids(texts)
    assert expected[0] == [50256]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(q.tokenizer_path()).encode(texts * 2)] == expected * 2


def test_added_tokens(spark):
    rows = pack_documents(spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string"), q.tokenizer_path()).collect()
    found = {(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in rows}
    assert found == {(k, 0, len(x) + 1, len(x) + 1, crc32(np.array([*x, END_ID], "<u4").tobytes())) for k, x in enumerate(contract_ids(ADDED))}


def test_large_ids_beside_a_null(spark):
    ids = [2**60 + 1, 2**60 + 2, 2**53 + 1, -(2**63), 2**63 - 1, None]
    rows = pack_documents(spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string"), q.tokenizer_path()).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(ids)


def test_near_equal_windows():
    # without a rise the windows differ by less than the least item; the count rises only as far as needed
    for seed in range(5):
        rng = random.Random(seed)
        lengths = [rng.randrange(200, 512) for _ in range(600)]
        parts = pack_group(lengths, CAPACITY)
        sums = [sum(lengths[i] for i in p) for p in parts]
        assert sorted(i for p in parts for i in p) == list(range(600))
        assert max(sums) <= CAPACITY
        assert max(sums) - min(sums) < min(lengths)
        least = math.ceil(sum(lengths) / CAPACITY)
        assert all(max(sum(lengths[i] for i in p) for p in differencing(lengths, w)) > CAPACITY for w in range(least, len(parts)))
        assert len(parts) <= 1.03 * least + 1


def test_differencing():
    assert differencing([], 3) == []
    for seed in range(5):
        rng = random.Random(seed)
        lengths = [rng.randrange(1, 512) for _ in range(200)]
        parts = pack_group(lengths, CAPACITY)
        assert sorted(i for p in parts for i in p) == list(range(200))
        sums = [sum(lengths[i] for i in p) for p in parts]
        assert max(sums) <= CAPACITY
        assert len(parts) <= math.ceil(sum(lengths) / CAPACITY) + 2 or max(sum(lengths[i] for i in p) for p in differencing(lengths, len(parts) - 1)) > CAPACITY
    assert len(pack_group([CAPACITY] * 3, CAPACITY)) == 3


def check_packing(rows, texts):
    """``texts``: (doc_id, text) of the packed rows."""
    ids = [[*x, END_ID] for x in contract_ids([t or "" for _, t in texts])]
    expected = defaultdict(list)
    for (doc, _), x in zip(texts, ids, strict=True):
        expected[doc].append(x)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    covered = Counter()
    for r in rows:
        options = [x for x in expected[r["doc_id"]] if len(x) == r["doc_tokens"] and crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert options
        covered[r["doc_id"]] += r["length"]
    assert covered == Counter({d: sum(map(len, xs)) for d, xs in expected.items()})
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(sequences)


def test_pack_documents(small, nothing):
    rows = pack_documents(small, q.tokenizer_path(), group_pieces=5).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()])
    assert pack_documents(nothing, q.tokenizer_path()).count() == 0


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, target = sum(sizes.values()), {}
    free = set(order)
    while True:
        rest = total - sum(3 * sizes[s] for s in order if s not in free)
        target = {s: rest * weight[s] / sum(weight[x] for x in free) if s in free else 3 * sizes[s] for s in order} if free else {s: 3 * sizes[s] for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        free -= over


def test_targets(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = {**{f"s{k}": rng.choice([0, 1, 5, 100, 1000, 40000]) for k in range(8)}, None: 50}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r["source"]: r["target"] for r in source_targets(df).collect()}
        assert found == pytest.approx(targets_by_hand(sizes))


def test_mixing(small, unique, nothing):
    for docs in (small, unique):
        rows = mix_sources(docs).collect()
        assert len(rows) == docs.count()
        sizes = Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"]) for r in rows) == sizes
        assert all(0 <= r["taken"] <= 3 * r["size"] and abs(r["taken"] - r["size"] * r["copies"]) <= r["size"] / 2 + 1 for r in rows)
        again = mix_sources(docs).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
        kept = mixed_documents(docs)
        assert kept.columns == docs.columns
    by_source = defaultdict(list)
    for r in mix_sources(unique).join(unique.select("doc_id", "source"), "doc_id").collect():
        by_source[r["source"]].append(r)
    for rows in by_source.values():
        # the document at the threshold makes the target good but for less than a word; whole copies come nearer than half of the largest document
        assert 0 <= rows[0]["target"] - sum(r["taken"] for r in rows) + 1e-6 < 1 + 2e-6
        assert abs(sum(r["size"] * r["copies"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) / 2 + 1e-6
    assert mix_sources(nothing).count() == 0
    assert mixed_documents(nothing).count() == 0


def test_e8():
    roots = e8_roots()
    assert len({tuple(r) for r in roots}) == 240
    assert np.allclose((roots**2).sum(axis=1), 2)
    y = np.random.default_rng(0).normal(size=(300, 8)) * 2
    near = nearest_e8(y)
    # no neighbour of the decoded point is nearer
    distance = ((y - near) ** 2).sum(axis=1)
    assert ((((y - near)[:, None, :] - roots[None]) ** 2).sum(axis=2) >= distance[:, None] - 1e-9).all()
    assert (distance <= 1 + 1e-9).all()


def test_sketches_keep_near_pairs():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    differing = lambda a, b: np.bitwise_count((sketches(a) ^ sketches(b)).view(np.uint64)).sum(axis=1)
    for cosine in (0.93, 0.97):
        y = cosine * x + math.sqrt(1 - cosine**2) * aside
        assert differing(x, y).max() <= most_differing(0.93)
    # and leave out almost all others
    assert (differing(x[::2], x[1::2]) <= most_differing(0.93)).mean() < 0.01
    # the chance that a pair at the least cosine differs in more bits
    p = math.acos(0.93) / math.pi
    assert sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(most_differing(0.93) + 1, 129)) < 1e-7


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.normal(size=32)
        for _ in range(5):
            near = base + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.3, 0.36, 0.5])
            rows.append((len(rows), near.astype(np.float32).tolist(), k % 4))
    odd = [None, [0.0] * 32, [], [float("nan")] * 32, [1.0, None] * 16, [float("inf")] + [1.0] * 31, [1.0] * 5]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[0][1], rows[0][2]), (2002, rows[0][1], rows[0][2]), (2003, [3e38] * 32, 0), (2004, [1e-38] * 32, 0)]
    return rows


def test_near_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, size int")
    found = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert len(found) == len(rows)
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    root, links = {i: i for i, _, _ in rows}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x, m) in enumerate(good):
        for j, y, n in good[:a]:
            if m == n and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.93:
                links[i] += 1
                links[j] += 1
                s, t = find(i), find(j)
                root[max(s, t)] = min(s, t)
    total = sum(links.values())
    assert total > 200
    assert sum(r["n_links"] for r in found.values()) >= 0.9 * total
    assert all(r["n_links"] <= links[i] for i, r in found.items())
    assert sum(found[i]["component_id"] != find(i) for i in found) <= 0.02 * len(found)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert near_vectors(df.limit(0)).count() == 0


NAMES = ["row_number", "_ROW_number", "__row_number", "copies", "copy", "__copy", "scored_text", "_scored_text", "score", "cid", "digest", "a.b"]


def test_clashing_names(spark, unique):
    """Stages return the columns that they got, whatever their names, with the values that they held."""
    docs = unique.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(f"{k} "), F.col("doc_id").cast("string")).alias(name) for k, name in enumerate(NAMES)))
    labels = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    for stage in (drop_repeats, one_of_each_component, mixed_documents, lambda x: keep_quality(x, labels)):
        kept = stage(docs)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows
        assert all([r[name] for name in NAMES] == [f"{k} {r['doc_id']}" for k in range(len(NAMES))] for r in rows)


def test_scratch_tables(spark):
    folder = lambda path: os.path.isdir(path.removeprefix("file:"))
    before, outer = store.spill(spark.range(5), "before")
    with store.scratch(spark) as keep:
        kept, _ = store.spill(spark.range(25), "kept", 25)
        _, gone = store.spill(kept, "gone")
        keep(kept)
        assert folder(gone)
    assert not folder(gone)
    assert (kept.count(), before.count()) == (25, 5)
    assert kept.rdd.getNumPartitions() == 1
    store.discard_all(spark)
    assert not folder(outer)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_against_sql(name, spark, duck):
    found = duck.execute(q.ORACLES[name])
    assert_same(q.QUERIES[name](spark, DATA), [c[0] for c in found.description], found.fetchall())


def test_pipeline(spark):
    cp = pytest.importorskip("corpus_pipeline")
    from test_dedup import components_by_hand, lowered

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    stages = dict(cp.STAGES)
    kept = stages["quality classifier"](spark, docs, DATA)
    scores = {r["doc_id"]: r["score"] for r in q.QUERIES["op3_quality"](spark, DATA).collect()}
    assert {i for i, _ in texts(kept)} == {i for i, s in scores.items() if s >= 0.5}
    exact = stages["exact dedup"](spark, kept, DATA)
    last = {}
    for i, t in sorted(texts(kept)):
        last[lowered(t)] = i
    assert sorted(i for i, _ in texts(exact)) == sorted(last.values())
    near = stages["n-gram Jaccard join"](spark, exact, DATA)
    assert sorted(i for i, _ in texts(near)) == sorted(i for i, n, c in components_by_hand(texts(exact)) if i == c or not n)
    mixed = stages["mixing sources"](spark, near, DATA)
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(near).collect()}
    assert Counter(i for i, _ in texts(mixed)) == Counter({i: c for i, c in copies.items() if c})
    packed = stages["packing"](spark, mixed, DATA).collect()
    check_packing(packed, texts(mixed))
    for df in (kept, exact, near, mixed):
        assert df.columns == columns
    assert cp.run(spark, DATA).count() == len(packed)


@pytest.mark.parametrize("kind", ["empty", "nulls", "repeated"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    """No rows give no pieces; null texts are empty, and one of them stays; of a row that repeats, id included, one stays."""
    import corpus_pipeline

    text = "One row of plain words that stands here many times, and nothing else beside it."
    rows = {"empty": [], "nulls": [(k, None, None, None, None) for k in range(5)], "repeated": [(7, text, "en", "s", len(text))] * 40}[kind]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    store.discard_all(spark)
    # a mix without words takes no row; the one row that stays is one piece of its sequence
    assert len(found) == {"empty": 0, "nulls": 0, "repeated": 1}[kind]
    assert all((r["doc_id"], r["start"], r["offset"], r["length"] == r["doc_tokens"]) == (7, 0, 0, True) for r in found)
