"""Fill-in-middle, language identification and conversation repair against plain Python."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookengine.llm import conversations as cv
from bookengine.llm import language as lg
from bookengine.llm.fill_middle import MultibyteIndex, fill_in_middle, restore
from compare import DATA

# --- fill-in-middle ---------------------------------------------------------------------------

TEXTS = [None, "", "\n", "\n\n", "a", "é", "a\nb\nc", "é\n€uro\n𝄞\nend\n", "x" * 70_000 + "\n" + "é" * 70_000, "has <P> in it", "<S>", "a<M>\nb", "<\n<P\nS>\n>", "tail\n\n\n", "日本語\nテキスト\n" * 40, "same", "same"]


def cut_by_hand(doc_id, text, unit, rate=100, spm_rate=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall("[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fill_in_middle(spark, small, nothing, unit):
    docs = [(k, t) for k, t in enumerate(TEXTS * 6)] + [(None, "a\nb"), (3, "x\ny"), (3, "x\ny")]
    # columns of the result's names beside the ones that are read
    table = spark.createDataFrame([(*d, 1, "x", 2, 3) for d in docs], "doc_id long, text string, n int, form string, h1 long, output long").repartition(3)
    for rate, spm_rate in ((100, 50), (60, 100)):
        cut = fill_in_middle(table, unit, rate, spm_rate)
        rows = cut.withColumn("again", restore(F.col("output"), F.col("form"))).collect()
        found = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows]
        assert sorted(found, key=repr) == sorted((cut_by_hand(*d, unit, rate, spm_rate) for d in docs), key=repr)
        assert sorted(((r["doc_id"], r["again"]) for r in rows), key=repr) == sorted(((i, t or "") for i, t in docs), key=repr)
    assert fill_in_middle(small, unit).count() == small.count()
    assert fill_in_middle(nothing, unit).collect() == []


def test_index_of_multibyte_characters():
    text = "aé€𝄞b" * 50 + "plain" + "ñ"
    data = np.frombuffer(text.encode(), np.uint8)
    index = MultibyteIndex(data)
    chars = np.arange(len(text) + 1)
    cuts = np.array([len(text[:c].encode()) for c in chars])
    assert (index.bytes(chars) == cuts).all() and (index.chars(cuts) == chars).all()
    assert len(index.at) == sum(ord(c) > 127 for c in text)
    assert len(MultibyteIndex(np.frombuffer(b"ascii", np.uint8)).at) == 0


# --- language ---------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lg.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    # what it gives depends on no language of the held-out fold
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert sorted(lg.identify_language(hidden).collect()) == sorted(lg.identify_language(docs).collect())


def test_language_of_odd_rows(spark, small, nothing):
    words = {"en": "the and of with thing", "de": "der und nicht schön über", "fr": "être où déjà les dans", "pl": "się że nie źle łąka"}
    rows = [(k, " ".join(random.Random(k).choices(words[lang].split(), k=12)), lang, 1.0) for k, lang in enumerate(list(words) * 40)]
    odd = [(1000, None, "en", 1.0), (1001, "", "en", 1.0), (1002, "12 34 !?", "de", 1.0), (None, "THE AND OF", None, 1.0), (1003, "ÜBER SCHÖN NICHT " * 9000, None, 1.0), (1003, "ÜBER SCHÖN NICHT " * 9000, None, 1.0), (1004, "x", "fr", 1.0)]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double").repartition(3)
    found = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in lg.identify_language(table).collect()]
    assert len(found) == len(rows) + len(odd)
    assert {f[1] for f in found if f[0] is None} == {False}
    by_id = {f[0]: f[2:] for f in found}
    assert all(by_id[k] == ("und", 0.0) for k in (1000, 1001, 1002))
    assert by_id[None][0] == "en" and by_id[1003][0] == "de" and by_id[1004][0] in words
    assert all(by_id[k][0] == lang for k, _, lang, _ in rows)
    assert all(f[1] == (crc32(str(f[0]).encode()) % 3 == 1) for f in found if f[0] is not None)
    assert {r["lang_pred"] for r in lg.identify_language(small).collect()} == {"en", "und"}  # one language to learn
    assert {(r["lang_pred"], r["score"]) for r in lg.identify_language(small.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert lg.identify_language(nothing).collect() == []


def test_margins_are_linear_in_the_features():
    rng = np.random.default_rng(1)
    texts = ["the cat", "", "x", "über alles, 12 -- schön", "a" * 300]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    weights, bias = rng.normal(size=(lg.BUCKETS, 3)), rng.normal(size=3)
    x = lg.features(data, offsets)
    assert np.allclose(lg.margins(weights, bias, data, offsets), lg.SCALE * x @ weights + bias)
    # a text's features don't depend on its neighbours
    assert np.allclose(x[3], lg.features(np.frombuffer(texts[3].encode(), np.uint8), np.array([0, len(texts[3].encode())]))[0])


def test_svm_separates():
    rng = np.random.default_rng(2)
    x = rng.random((200, 5)) / 30
    sign = np.where(x[:, 0] > x[:, 1], 1.0, -1.0)
    w = lg.fit_svm(x, sign, 2000)
    assert np.mean(np.sign(x @ w[:-1] * lg.SCALE + w[-1]) == sign) > 0.95
    assert lg.family("pt-BR") == lg.family("fr") == "romance" and lg.family("qq") == "qq"


# --- conversations ----------------------------------------------------------------------------


def ends(edits_of_rows):
    """Every sequence of edits of rows (must_delete, initial, truncated), with up to two inserts anywhere: (cost, audit, initials)."""
    options = []
    for gone, initial, cut in edits_of_rows:
        row = [(3, "D", "")]
        if not gone:
            row += [(cut, "K", initial), (2 + cut, "R", "u"), (2 + cut, "R", "a")]
        options.append(row)
    inserts = [[(0, "", "")], *([(2, "I", c) for c in "ua"], [(4, "II", c + d) for c in "ua" for d in "ua"])]
    inserts = [x for group in inserts for x in group]
    slots = []
    for row in options:
        slots += [inserts, row]
    for way in itertools.product(*slots, inserts):
        yield sum(w[0] for w in way), "".join(w[1] for w in way), "".join(w[2] for w in way)


def test_edits_against_every_sequence():
    kinds = {"x": (True, "", False), **{c: (False, c if c != "o" else "t", False) for c in "osua"}, **{c.upper(): (False, c if c != "o" else "t", True) for c in "osua"}}
    for size in (0, 1, 2):
        for text in map("".join, itertools.product(kinds, repeat=size)):
            best = min((cost, audit) for cost, audit, initials in ends([kinds[k] for k in text]) if re.fullmatch("(s?(ua)+)?", initials))
            links = [cv.LINKS[k] for k in text]
            last = cv.last_state(links)
            cost, edits = cv.solve(text, cv.START, last) if text else (0, "")
            assert (cost + 2 * len(cv.TAIL[last]), edits.replace(",", "") + cv.TAIL[last]) == best, text


def test_links_compose():
    rng = random.Random(3)
    for _ in range(60):
        kinds = rng.choices("xosuaOSUA", k=rng.randrange(2, 30))
        links = [cv.LINKS[k] for k in kinds]
        cut = rng.randrange(1, len(links))
        assert cv.compose([cv.compose(links[:cut]), cv.compose(links[cut:])]) == cv.compose(links)


def repaired_by_hand(rows):
    """rows: (turn, role, text) of a conversation after damage, in order. The contract's columns but conv_id, and the repaired rows."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, counts = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    states = {"": (0, "", ())}  # what has been emitted, as far as it matters: "", s, u, a
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def widen(states):
        for _ in range(3):
            for at, (cost, audit, out) in list(states.items()):
                made = after[at][-1]
                way = (cost + 2, audit + "I", (*out, (cv.ROLE[made], "")))
                states[made] = min(way, states.get(made, way))
        return states

    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        new = {}
        for at, (cost, audit, out) in widen(states).items():
            ways = [(at, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                made = after[at][-1]
                ways.append((made, (cost + 2 + extra, audit + "R", (*out, (cv.ROLE[made], text)))))
                if role[:1] and role[:1] in after[at]:
                    ways.append((role[:1], (cost + extra, audit + "K", (*out, (role, text)))))
            for to, way in ways:
                new[to] = min(way, new.get(to, way))
        states = new
    cost, audit, out = min(way for at, way in widen(states).items() if at in ("", "a"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), list(out)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def odd_conversations():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "umbrella", "", None]
    said = ["Yes.", "No", "Why?", "Über!", "", "  ", None, "\n\t", "Long " * 5000 + ".", "end. \r\n", "two\nlines", "é"]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(said)))
    # one conversation that holds a third of all rows, and many repeats of one row
    rows += [(99, k, "user" if k % 2 == 0 else "assistant", f"Line {k}{'.' if k % 5 else ''}") for k in range(150)]
    rows += [(98, 1, "user", "Again.")] * 60 + [(97, None, "user", "Again.")] * 20
    return rows


SIZES = [(cv.FAN, cv.BLOCK_ROWS), (2, 4)]


@pytest.mark.parametrize("fan, block_rows", SIZES)
def test_repair(spark, fan, block_rows):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, rid string, conv int, block int, place int").repartition(3)
    expected = {}
    for conv in {r[0] for r in rows}:
        expected[conv] = repaired_by_hand(in_order([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]))
    found = cv.repair_report(table, fan=fan, block_rows=block_rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in found.collect()} == {c: e[0] for c, e in expected.items()}
    messages = {}
    for r in sorted(cv.repaired_messages(table, fan, block_rows).collect(), key=lambda r: r["place"]):
        messages.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert messages == {c: e[1] for c, e in expected.items() if e[1]}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert cv.repair_report(empty).collect() == [] and cv.repaired_messages(empty).collect() == []
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "conv_id string")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert sorted(map(tuple, cv.repair_report(empty, ids).collect()), key=repr) == [("a", *nothing), (None, *nothing)]


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(60), None) for r, x in (("system", "One. Two! Three? é."), (None, None))]

    def hurt(conv, turn, role, text):
        draw = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        one = (conv, turn, "user" if draw == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(draw, text))
        return [one] * {0: 0, 3: 2}.get(draw, 1)

    found = cv.damage(spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, copies int")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((x for r in rows for x in hurt(*r)), key=repr)
