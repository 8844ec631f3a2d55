"""Exact dedup, n-gram join, repeated bytes and components against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from bookengine.llm import ngram_join, suffix_dedup
from bookengine.llm.components import connected_components
from bookengine.llm.exact_dedup import build_levels, drop_repeats, exact_dedup, find_slots
from bookengine.llm.ngram_join import ngram_components, one_of_each_component
from bookengine.llm.suffix_dedup import repeated_bytes


def lowered(text):
    return (text or "").encode().lower()


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    levels, slots = build_levels(keys)
    assert sorted(slots) == list(range(5000))
    assert (find_slots(keys, levels) == slots).all()
    assert build_levels(keys[:0])[0] == []


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_dedup(small, share):
    rows = small.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r["text"])].append(r["doc_id"])
    found = exact_dedup(small, share).collect()
    assert len(found) == len(rows)
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[(i, keep, len(ids), hashlib.sha256(text).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == expected
    # one row of each text is kept, and it is the one of largest id
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drop_repeats(small, unique, nothing):
    for docs in (small, unique):
        kept = drop_repeats(docs)
        assert kept.columns == docs.columns
        texts = [lowered(r["text"]) for r in kept.collect()]
        assert len(texts) == len(set(texts)) == len({lowered(r["text"]) for r in docs.collect()})
    assert drop_repeats(nothing).count() == 0
    assert exact_dedup(nothing).count() == 0


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components_by_hand(rows):
    """(doc_id, n, component) of (doc_id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return [(doc, len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def test_ngram_components(small, nothing):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(small).collect())
    assert found == Counter(components_by_hand(rows))
    assert ngram_components(nothing).count() == 0


def test_bound_admits_every_overlap():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    signatures = ngram_join._Signatures([ngram_join.bitmap(s, ngram_join.band_bits(len(s))) for s in sets])
    a, b = np.triu_indices(60, 1)
    true = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    bound = signatures.bound(a, b, n)
    assert (bound >= true).all()
    assert (bound <= np.minimum(n[a], n[b])).all()


@pytest.mark.parametrize("block", [512, 4])
def test_ngram_components_of_many_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    # clusters of copies with few or many edits, passages shared by all, and pairs on both sides of the threshold
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [word() for _ in range(60)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(30, 160))]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randrange(0, 7)):
                text[rng.randrange(len(text))] = word()
            rows.append(text)
    rows += [shared + [word() for _ in range(k % 40)] for k in range(50)]
    docs = [(k, " ".join(t)) for k, t in enumerate(rows)]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert found == sorted(components_by_hand(docs))


def test_one_of_each_component(small, unique, nothing):
    for docs in (small, unique):
        kept = one_of_each_component(docs).collect()
        n = Counter(c for _, size, c in components_by_hand([(k, r["text"]) for k, r in enumerate(docs.collect())]) if size)
        blank = sum(not shingle_set(r["text"]) for r in docs.collect())
        assert len(kept) == len(n) + blank
    assert one_of_each_component(nothing).count() == 0


def removed_by_hand(texts):
    data = [(t or "").encode() for t in texts]
    length = suffix_dedup.LENGTH
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_repeated_bytes(small, group, nothing):
    rows = small.collect()
    expected = Counter((r["doc_id"], *x) for r, x in zip(rows, removed_by_hand([r["text"] for r in rows]), strict=True))
    assert any(0 < x[2] < x[1] for x in expected)
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(small, group).collect())
    assert found == expected
    assert repeated_bytes(nothing).count() == 0


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_repeated_bytes_at_the_edges(spark, group):
    # passages of 199, 200 and 201 bytes with different surroundings, and repeats inside one document
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for size in (199, 200, 201, 260, 330):
        passage = noise(size)
        texts += [noise(rng.randrange(0, 50)) + passage + noise(rng.randrange(0, 50)) for _ in range(4)]
    texts += [noise(20) + (p := noise(210)) + noise(3) + p, "z" * 199, "z" * 200, "y" * 200, "y" * 201]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(docs, group).collect()}
    assert [found[k] for k in range(len(texts))] == removed_by_hand(texts)


def test_repeated_bytes_when_joins_change_while_running(spark):
    # joins planned by sorting that turn out small enough to broadcast, as on large tables; contexts of a core must still meet in one task
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for copies in [2] * 40 + [12]:
        passage = noise(260)
        texts += [noise(rng.randrange(150, 200)) + passage[rng.randrange(20) :] + noise(rng.randrange(150, 200)) for _ in range(copies)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(docs, 4).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [found[k] for k in range(len(texts))] == removed_by_hand(texts)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
