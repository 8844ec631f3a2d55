"""Folds and joins against plain Python."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as strats
from pyspark.sql import functions as F

from bookengine.operators import links as ln
from bookengine.operators import pages as pg
from bookengine.operators import segment as seg
from bookengine.operators import structure as st
from bookengine.operators import tokens as tok


def pages_by_hand(units, limit):
    pages, chars, first = [], 0, 0
    for k, u in enumerate(units):
        chars += u
        if chars >= limit:
            pages.append((first, chars))
            chars, first = 0, k + 1
    if first < len(units):
        pages.append((first, chars))
    return pages


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(strats.lists(strats.integers(0, 30), max_size=40))
def test_pages(spark, units):
    df = spark.createDataFrame([(units,)], "u array<int>")
    found = df.select(st.page_starts(F.col("u"), 50).alias("p")).first()["p"]
    assert [(p["start_word"], p["n_chars"]) for p in found] == pages_by_hand(units, 50)
    assert sum(p["n_chars"] for p in found) == sum(units)


@pytest.mark.parametrize(("limit", "size", "most"), [(50, 3, 30), (7, 1, 9), (1, 4, 2), (2300, 2, 40), (20, 5, 60)])
def test_pages_in_blocks(spark, limit, size, most):
    rng = random.Random(limit)
    books = {name: [[rng.choice([0, rng.randrange(most)]) for _ in range(rng.choice([0, 1, rng.randrange(40)]))] for _ in range(n)] for name, n in (("a", 60), ("b", 1), ("c", 7), (None, 9))}
    books |= {"none": [[], []], "zeros": [[0, 0], [0], []], "exact": [[limit], [limit, limit]]}
    rows = [(name, 3 * k + 1, units) for name, runs in books.items() for k, units in enumerate(runs)] + [("a", 10**6, None)]
    df = spark.createDataFrame(rows, "book string, ix int, u array<int>").repartition(4)
    expected = {name: [(k, *p) for k, p in enumerate(pages_by_hand([u for run in runs for u in run], limit))] for name, runs in books.items()}
    found = {name: [] for name in books}
    for r in pg.paginate_runs(df, "book", "ix", F.col("u"), limit, 3 * size).collect():
        found[r["book"]].append((r["page_no"], r["start_word"], r["n_chars"]))
    assert {name: sorted(x) for name, x in found.items()} == expected
    at = {(r["book"], r["ix"]): r["page_no"] for r in pg.page_of_runs(df.where("u IS NOT NULL"), "book", "ix", F.col("u"), limit, 3 * size).collect()}
    for name, runs in books.items():
        words = 0
        closes = [start for _, start, _ in expected[name][1:]]
        flat = [u for run in runs for u in run]
        if expected[name] and expected[name][-1][2] >= limit:
            closes.append(len(flat))
        for k, run in enumerate(runs):
            assert at[name, 3 * k + 1] == sum(c <= words for c in closes)
            words += len(run)
    assert pg.paginate_runs(df.limit(0), "book", "ix", F.col("u"), limit).collect() == []


def test_pages_of_one_file_of_ten_million_words(spark):
    """The whole file as an array for the fold by hand, in runs for the blocks."""
    runs = spark.range(20000).select(F.lit(1).alias("book"), F.col("id").alias("ix"), F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.pmod(F.hash(k, "id"), F.lit(17)).cast("int")).alias("u"))
    found = [(r["start_word"], r["n_chars"]) for r in pg.paginate_runs(runs, "book", "ix", F.col("u")).orderBy("page_no").collect()]
    assert found == pages_by_hand([u for r in runs.orderBy("ix").select("u").toLocalIterator() for u in r["u"]], st.CHARS_PER_PAGE)


def test_split_by_pages(spark):
    rng = random.Random(7)
    paras = {name: [rng.choice([0, 0, 1, 2, 5]) for _ in range(n)] for name, n in (("a", 300), ("b", 1), ("c", 20))}
    df = spark.createDataFrame([(name, 2 * k, n) for name, x in paras.items() for k, n in enumerate(x)], "book string, para_ix int, n_pages int").repartition(3)
    expected = set()
    for name, x in paras.items():
        pages = file = 0
        for k, n in enumerate(x):
            if pages >= 4:
                pages, file = 0, file + 1
            pages += n
            expected.add((name, 2 * k, file))
    for size in (None, 32):
        found = st.split_by_pages(df, "book", 4, size)
        assert set(map(tuple, found.collect())) == expected and found.dtypes == [("book", "string"), ("para_ix", "int"), ("file_ix", "int")]


def tree_by_hand(levels, kind):
    limit, most = {"normal": (2, 1 << 30), "kindle": (2, 1), "flat": (1 << 30, 1)}[kind]
    stack, out, last = [], [], None
    for k, level in enumerate(levels):
        if last is not None:
            if last < level:
                if level < limit or len(stack) > most:
                    stack.pop()
            elif last == level:
                stack.pop()
            else:
                while stack and stack[-1][0] >= level:
                    stack.pop()
        out.append((k, stack[-1][1] if stack else None))
        stack.append((level, k))
        last = level
    return out


@pytest.mark.parametrize("kind", ["normal", "kindle", "flat"])
@pytest.mark.parametrize("levels", [[0], [0, 1, 2, 3, 2, 1], [0, 2, 1, 3], [1, 1, 0, 2, 2, 1], [3, 2, 1, 0], [0, 1, 2, 2, 3, 1, 2, 0, 1]])
def test_toc_tree(spark, kind, levels):
    df = spark.createDataFrame([("b", k, level) for k, level in enumerate(levels)], "book_id string, toc_ix int, level int")
    found = sorted((r["toc_ix"], r["parent_ix"]) for r in st.toc_tree(df, "book_id", kind).collect())
    assert found == tree_by_hand(levels, kind)


def test_toc_tree_of_large_books_in_blocks(spark):
    rng = random.Random(14)
    books = {f"b{n}": [rng.randrange(lo, hi) for _ in range(n)] for n, lo, hi in ((1, 0, 1), (200, 0, 4), (400, 0, 7), (300, 1, 5), (250, -2, 3), (90, 3, 9))}
    # one title, then chapters alone: the usual book
    books["title"] = [0] + [rng.randrange(1, 5) for _ in range(500)]
    rows = [(b, k, level) for b, levels in books.items() for k, level in enumerate(levels)] + [(None, k, level) for k, level in enumerate([0, 2, 1, 2])]
    df = spark.createDataFrame(rows, "book_id string, toc_ix int, level int").repartition(3)
    for kind in st.TREES:
        for size in (None, 16):
            found = {}
            for r in st.toc_tree(df, "book_id", kind, size=size).collect():
                found.setdefault(r["book_id"], []).append((r["toc_ix"], r["parent_ix"]))
            assert {b: sorted(x) for b, x in found.items()} == {b: tree_by_hand(levels, kind) for b, levels in (books | {None: [0, 2, 1, 2]}).items()}
    assert "collect_list" not in st.toc_tree(df, "book_id", "normal")._jdf.queryExecution().toString()
    assert st.toc_tree(df.limit(0), "book_id", "normal").collect() == []
    with pytest.raises(ValueError):
        st.toc_tree(df, "book_id", "deep")


def hyphenate_by_hand(word, patterns):
    dotted, values = f".{word}.", [0] * (len(word) + 3)
    for pattern in patterns:
        letters, digits = "", {}
        for c in pattern:
            if c.isdigit():
                digits[len(letters)] = int(c)
            else:
                letters += c
        for start in (m.start() for m in re.finditer(f"(?={re.escape(letters)})", dotted)):
            for place, v in digits.items():
                values[start + place] = max(values[start + place], v)
    if len(word) <= 2:
        return word
    return "".join(c + ("-" if values[k + 2] % 2 and 2 <= k + 1 <= len(word) - 2 else "") for k, c in enumerate(word))


def test_hyphenation(spark):
    words = ["nation", "father", "the", "ab", "therefore", "überer", "ciónñez", "élérer", "Nation", "x1y2"]
    df = spark.createDataFrame([(w,) for w in words * 2], "word string")
    found = {r["word"]: r["hyphenated"] for r in seg.hyphenate(df, exceptions={"father": "fat-her"}, hyphen="-").collect()}
    assert found.pop("father") == "fat-her"
    assert found == {w: hyphenate_by_hand(w, seg.PATTERNS) for w in words if w != "father"}
    assert all(h.replace("-", "") == w for w, h in found.items())


def test_hyphenation_by_dictionary(spark, tmp_path):
    patterns = {"en-us": ("1t2h", "n1t", "1tion", ".re3", "4ed."), "fr": ("é1r", "t1i", "o1n."), "de-1901": ("1sch", "s3t")}
    exceptions = {"en-us": ["fat-her", "", "re-do"], "fr": []}
    for name, found in patterns.items():
        (tmp_path / f"hyph-{name}.pat.txt").write_text("% a remark\n" + "\n".join(found[:2]) + "  % more\n\n" + " ".join(found[2:]), "utf-8")
    for name, found in exceptions.items():
        (tmp_path / f"hyph-{name}.hyp.txt").write_text("\n".join(found), "utf-8")
    (tmp_path / "readme.txt").write_text("n1o")
    table, fixed = seg.read_dictionaries(spark, str(tmp_path))
    rows = {(r["dictionary"], r["letters"], r["place"], r["value"]) for r in table.collect()}
    assert rows == {(name, *row) for name, found in patterns.items() for row in seg.pattern_rows(found)}
    assert {(r["dictionary"], r["word"], r["hyphenated"]) for r in fixed.collect()} == {("en-us", "father", "fat-her"), ("en-us", "redo", "re-do")}
    words = ["nation", "father", "redo", "reited", "élérion", "Tischstation", "the", "on", "", "x" * 3000 + "nth"]
    books = [(lang, w) for lang in ("en", "EN", "fr-CA", "de", "pl", None) for w in words] * 2
    got = {(r["lang"], r["word"]): r["hyphenated"] for r in seg.hyphenate_books(spark.createDataFrame(books, "lang string, word string"), table, fixed, "-").collect()}
    names = {"en": "en-us", "EN": "en-us", "fr-CA": "fr", "de": "de-1901"}

    def by_hand(lang, word):
        name = names.get(lang)
        known = {x.replace("-", ""): x for x in exceptions.get(name, []) if x}
        return known.get(word) or (hyphenate_by_hand(word, patterns[name]) if name else word)

    assert got == {(lang, w): by_hand(lang, w) for lang, w in books}


def test_overrides_prefer_the_longest_suffix(spark):
    books = spark.createDataFrame([(1, "a/b/c.fb2", "t", ""), (2, "x/c.fb2", "t", ""), (3, "x/y.fb2", "t", "B1")], "id int, path string, title string, asin string")
    rows = spark.createDataFrame([("*", "", "1234567890"), ("c.fb2", "short", "bad"), ("b/c.fb2", "long", "")], "name string, title string, asin string")
    found = {r["id"]: (r["title"], r["asin"]) for r in ln.apply_overwrites(books, rows, "id", "path", ("title", "asin")).collect()}
    assert found == {1: ("long", ""), 2: ("short", ""), 3: ("t", "1234567890")}


def test_tokens(spark):
    html = '<!-- <p> --><body><script>"</p>"</script><p class="a" id="1">x<![CDATA[y]]><br/></p> tail<odd></body>'
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    rows = tok.tokenize_markup(df, "id", "html").orderBy("id", "pos").collect()
    assert [(r["kind"], r["tag"], r["text"]) for r in rows] == [("open", "body", None), ("open", "p", None), ("text", "", "xy"), ("selfclose", "br", None), ("close", "p", None), ("text", "", " tail"), ("open", "odd", None), ("close", "body", None)]
    assert rows[1]["attrs"] == {"class": "a", "id": "1"}


def test_text_fragment_skips_links_but_keeps_tails(spark):
    html = "<x><t>head <a>in</a>tail<p>one</p><div>two</div></t> own tail<b>not</b></x>"
    df = spark.createDataFrame([(1, html)], "id int, html string")
    assert tok.text_fragment(tok.tokenize_markup(df, "id", "html"), "id", "t").first()["fragment"] == "head tail\none\ntwo own tail"


def test_entities(spark):
    df = spark.createDataFrame([(1, "a&lt;b&nope;c&copy;"), (2, "none"), (3, "&amp;amp;")], "id int, t string")
    found = {r["id"]: r["resolved"] for r in tok.resolve_entities(df, "id", "t").collect()}
    assert found == {1: "a<b&nope;c©", 2: "none", 3: "&amp;"}


def test_learned_breaks(spark):
    import math
    from collections import Counter

    from bookengine.operators import breaks as br

    rng = random.Random(4)
    plain = ["tree", "house", "walked", "green", "over", "lake"]
    text = lambda: " ".join(rng.choice([f"He saw Dr. Brown {rng.choice(plain)}.", f"The {rng.choice(plain)} z.B. stood.", f"It was {rng.choice(plain)} etc. The {rng.choice(plain)} fell!", f"\"No ({rng.choice(plain)}).\" He said the {rng.choice(plain)}..."]) for _ in range(60))
    docs = [(k, rng.choice(["en", "de"]), text()) for k in range(12)] + [(90, None, "A Dr. B."), (91, "fr", None), (92, "en", "")]
    df = spark.createDataFrame(docs, "id int, lang string, text string").repartition(3)
    model = br.train_breaks(df)
    core = lambda w: re.sub(r"^[^A-Za-z]+|[^A-Za-z.]+$", "", w)
    for lang in ("en", "de"):
        words = [core(w) for _, name, t in docs if name == lang for w in t.split() if core(w)]
        kind = lambda w: re.sub(r"\.+$", "", w.lower())
        stop = lambda w: w.endswith(".") and not w.endswith("..")
        n_with, n_without = Counter(kind(w) for w in words if stop(w)), Counter(kind(w) for w in words if not stop(w))
        chance = sum(n_with.values()) / len(words)
        expected = {}
        for w, n in n_with.items():
            m, inner = n_without[w], w.count(".")
            null, other = n * math.log(chance) + m * math.log(1 - chance), n * math.log(0.99) + m * math.log(0.01)
            score = -2 * (null - other) * math.exp(-(len(w) - inner)) * (inner + 1) * (len(w) - inner) ** -m
            if score >= 0.3:
                expected[w] = score
        found = {r["type"]: r["score"] for r in model.abbreviations.where(f"lang = '{lang}'").collect()}
        assert set(found) == set(expected) and all(math.isclose(found[w], expected[w], rel_tol=1e-9) for w in found)
        assert {"dr", "z.b"} <= set(found) and not set(found) & set(plain)
    texts = {k: t for k, _, t in docs} | {93: "Dr. Brown came. The Dr. Brown etc. The end", 94: "One. Two.", 95: "One. Two."}
    paras = spark.createDataFrame([(k, lang, t) for k, lang, t in docs] + [(93, "en", texts[93]), (94, "pl", "One. Two."), (95, None, "One. Two.")], "id int, lang string, text string")
    got = {}
    for r in sorted(br.learned_sentences(paras, model, "id").collect(), key=lambda r: (r["id"], r["sent_ix"])):
        got.setdefault(r["id"], []).append(r["text"])
    assert all("".join(got.get(k, [])) == (t or "") for k, t in texts.items())
    assert got[93] == ["Dr. Brown came. ", "The Dr. Brown etc. ", "The end"] and got[94] == ["One. ", "Two."] and got[95] == ["One. Two."]
    assert not any(s.endswith("Dr. ") for k in range(12) for s in got[k])
    other = br.BreakModel(model.abbreviations.where("lang = 'de'"), model.starters.where("lang = 'de'"))
    assert [r["text"] for r in br.learned_sentences(paras.where("id = 94"), other, "id").collect()] == ["One. Two."]


def test_learned_breaks_read_texts_three_times(spark):
    """Once to learn, once for the words at cuts, once to join; texts are never dealt by language or word."""
    from bookengine.operators import breaks as br

    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = [(k, "en", f"He saw Dr. Brown {k}. The z.B. tree! Dr. Green fell. ") for k in range(50)]
    df = spark.createDataFrame(docs, "id int, lang string, text string").mapInArrow(noted, "id int, lang string, text string")
    model = br.train_breaks(df)
    found = br.learned_sentences(df, model, "id").collect()
    assert len(found) == 150 and seen.value <= 3 * len(docs)


def test_numbering_of_one_book_in_blocks(spark):
    from bookengine.operators import notes as nt
    from bookengine.operators import packaging as pk

    rng = random.Random(6)
    rows = [("hot", k, rng.randrange(4), rng.choice(["* * *", "t"]), f"T{k}", rng.random() < 0.5, rng.randrange(50), True, "", f"f{k}") for k in rng.sample(range(900), 400)]
    rows += [("small", k, 1, "t", f"T{k}", True, 5, k < 3, "notes" if k > 2 else "", f"f{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "book string, ix int, level int, subtitle string, title string, has_title boolean, text_length int, is_main boolean, body_name string, fname string").repartition(3).cache()
    files = df.select("book", F.col("ix").alias("file_ix"), "fname", F.col("has_title").alias("in_spine"), (F.col("ix") == 0).alias("is_cover_page"))
    manifest = files.select("book", "file_ix", "fname", F.lit("m").alias("media_type"), F.col("in_spine").alias("in_manifest"))
    images = df.select("book", F.col("ix").alias("image_ix"), "fname", F.lit("i").alias("media_type"), (F.col("ix") == 3).alias("is_cover"))
    for made in (
        lambda size: st.chapter_split(df, "book", "ix", 1, ("* * *",), size).select("book", "ix", "file_ix", "fname"),
        lambda size: st.toc_entries(df, "book", "ix", size),
        lambda size: st.running_counters(df, "book", "ix", size),
        lambda size: pk.spine_rows(files, "book", size),
        lambda size: st.page_map(files.select("book", "file_ix", "fname", (F.col("file_ix") % 4).alias("n_pages"), "in_spine"), "book", size),
        lambda size: st.play_order(df.select("book", F.col("ix").alias("toc_ix"), "title"), "book", "before", size=size),
        lambda size: st.play_order(df.select("book", F.col("ix").alias("toc_ix"), "title"), "book", "after", size=size),
        lambda size: nt.number_notes(df.select("book", "ix", F.concat("body_name", F.col("level").cast("string")).alias("body")), "book", "body", "ix", size),
        lambda size: pk.manifest_rows("book", manifest, images, *[manifest.select("book", F.col("file_ix").alias("ix"), "fname", "media_type").limit(k) for k in (30, 1)], size),
    ):
        whole, blocks = made(None), made(16)
        assert whole.dtypes == blocks.dtypes
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, blocks.collect()))
