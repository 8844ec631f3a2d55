"""Sentences, words, addresses and hyphenation as tables."""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookengine.functions import text as tx


def paragraphs(docs: DataFrame, key: str, text: str = "text", *more: str) -> DataFrame:
    return docs.select(key, *more, F.posexplode(F.split(text, "\n")).alias("para_ix", "text"))


def sentences(paras: DataFrame, *keys: str) -> DataFrame:
    """A row for each sentence: keys, sent_ix, text. Needs lang."""
    return paras.select(*keys, F.posexplode(tx.split_sentences(F.col("text"), F.col("lang"))).alias("sent_ix", "text"))


def words(sents: DataFrame, *keys: str, ignore_nbsp: bool = False) -> DataFrame:
    return sents.select(*keys, F.posexplode(tx.split_words(F.col("text"), ignore_nbsp)).alias("word_ix", "word"))


def segment_addresses(sents: DataFrame, key: str) -> DataFrame:
    """``kobo.{paragraph}.{sentence}``: paragraphs with text count within the file, sentences within the paragraph."""
    para = F.dense_rank().over(Window.partitionBy(key).orderBy("para_ix"))
    sent = F.row_number().over(Window.partitionBy(key, "para_ix").orderBy("sent_ix"))
    return sents.select("*", F.format_string("kobo.%d.%d", para, sent).alias("address"))


#: A small pattern table of our own, in the usual notation: digits between letters, '.' for a word's border.
PATTERNS = ("1t2h", "n1t", "t1i", "i2on", "1er.", "er1e", "e1re", "h1e", "a1n", "2nd", "en1s", "s1t", "1tion", "le1s", "i3e", "u1n", "n1g2", "é1r", "ó1n", "1ñ", "ch1e", "o1u", "4er.", "ü1b")
EXCEPTIONS = {"the": "the", "ciónciónar": "ción-ción-ar"}
HYPHEN = "­"


#: Names of the files of a dictionary: patterns, and words that go before them.
PATTERN_FILE, EXCEPTION_FILE = r"hyph-(.+)\.pat\.txt$", r"hyph-(.+)\.hyp\.txt$"


def pattern_rows(patterns: tuple[str, ...] = PATTERNS) -> list[tuple[str, int, int]]:
    """(letters, place, value) for every digit of every pattern; place counts the letters before it."""
    rows = []
    for pattern in patterns:
        letters = "".join(c for c in pattern if not c.isdigit())
        place = 0
        for c in pattern:
            if c.isdigit():
                rows.append((letters, place, int(c)))
            else:
                place += 1
    return rows


def parse_patterns(lines: DataFrame, text: str = "value") -> DataFrame:
    """dictionary, letters, place, value of pattern lines (dictionary, text): as ``pattern_rows``, on columns. Blank lines, and '%' with what follows it, give nothing."""
    pattern = lines.select("dictionary", F.explode(F.regexp_extract_all(F.regexp_replace(text, "%.*$", ""), F.lit(r"(\S+)"), F.lit(1))).alias("pattern")).distinct()
    digits = F.regexp_extract_all("pattern", F.lit("([0-9])"), F.lit(1))
    # what stands in front of the k-th digit holds k digits, the others are letters
    parts = F.split("pattern", "[0-9]")
    places = F.transform(digits, lambda d, k: F.struct(F.char_length(F.array_join(F.slice(parts, F.lit(1), k + 1), "")).alias("place"), d.cast("int").alias("value")))
    rows = pattern.select("dictionary", F.regexp_replace("pattern", "[0-9]", "").alias("letters"), F.explode(places).alias("p"))
    return rows.select("dictionary", "letters", "p.place", "p.value").where("letters <> ''")


def parse_exceptions(lines: DataFrame, text: str = "value") -> DataFrame:
    """dictionary, word, hyphenated of exception lines: words with their hyphens. Of a word given several times the ASCII-least form counts."""
    form = F.trim(text)
    rows = lines.where(form != "").select("dictionary", F.replace(form, F.lit("-"), F.lit("")).alias("word"), form.alias("hyphenated"))
    return rows.groupBy("dictionary", "word").agg(F.min("hyphenated").alias("hyphenated"))


def read_dictionaries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(patterns, exceptions) of all dictionaries in a folder: ``hyph-{dictionary}.pat.txt`` and ``hyph-{dictionary}.hyp.txt``, a line for each word or pattern."""
    lines = spark.read.text(root, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file"), "value")
    of = lambda pattern: lines.where(F.col("file").rlike(pattern)).select(F.regexp_extract("file", pattern, 1).alias("dictionary"), "value")
    return parse_patterns(of(PATTERN_FILE)), parse_exceptions(of(EXCEPTION_FILE))


def hyphenate_by_dictionary(words: DataFrame, patterns: DataFrame, exceptions: DataFrame, hyphen: str = HYPHEN) -> DataFrame:
    """dictionary, word, hyphenated for each distinct pair (Liang's patterns, case-sensitive); words of all dictionaries go in one pass.

    No hyphen within the first two or the last two letters, none in words of two letters, none where the dictionary is null or has no patterns. Exceptions go
    first. From each letter on only pieces are taken that begin as some pattern of the dictionary does, in the lengths that such patterns have;
    a piece carries two hashes of its word, not the word, and meets the patterns in a join on (dictionary, letters).
    """
    distinct = words.select("dictionary", "word").distinct().join(exceptions.withColumnRenamed("hyphenated", "_fixed"), ["dictionary", "word"], "left")
    keys = (F.xxhash64("dictionary", "word"), F.xxhash64("word", "dictionary", F.lit(1)))
    keyed = distinct.select("dictionary", "word", "_fixed", keys[0].alias("k"), keys[1].alias("l"), F.char_length("word").alias("n"))
    # a row a dictionary: the first two letters of its patterns, with the lengths of those that begin so
    letters = patterns.select("dictionary", "letters").distinct()
    heads = letters.groupBy("dictionary", F.left("letters", F.lit(2)).alias("head")).agg(F.array_sort(F.collect_set(F.char_length("letters"))).alias("sizes"))
    heads = heads.groupBy("dictionary").agg(F.map_from_entries(F.collect_list(F.struct("head", "sizes"))).alias("heads"))
    open_words = keyed.where("_fixed IS NULL AND n > 2").join(heads, "dictionary")
    dotted = F.concat(F.lit("."), "word", F.lit("."))
    sizes = lambda s, head, n: F.filter(F.coalesce(F.try_element_at("heads", head), F.array().cast("array<int>")), lambda z: s + z - 1 <= n)
    at = lambda s, n: F.transform(F.array_distinct(F.concat(sizes(s, F.substring(dotted, s, F.lit(2)), n), sizes(s, F.substring(dotted, s, F.lit(1)), n))), lambda z: F.struct(s.alias("start"), F.substring(dotted, s, z).alias("letters")))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") + 2), lambda s: at(s, F.col("n") + 2)))
    pieces = open_words.select("dictionary", "k", "l", "n", F.explode(cut).alias("p")).select("dictionary", "k", "l", "n", "p.start", "p.letters")
    # after how many letters of the word a value stands: the leading dot is no letter
    after = (F.col("start") - 1 + F.col("place") - 1).alias("after")
    values = pieces.join(patterns, ["dictionary", "letters"]).select("k", "l", "n", after, "value").groupBy("k", "l", "n", "after").agg(F.max("value").alias("value"))
    good = values.where((F.col("value") % 2 == 1) & (F.col("after") >= 2) & (F.col("after") <= F.col("n") - 2))
    cuts = good.groupBy("k", "l").agg(F.array_sort(F.collect_list("after")).alias("cuts"))
    edges = F.concat(F.array(F.lit(0)), "cuts", F.array("n"))
    part = lambda c, i: F.when(i > 0, F.substring("word", F.element_at(edges, i) + 1, c - F.element_at(edges, i))).otherwise("")
    split = F.filter(F.transform(edges, part), lambda x: x != "")
    hyphenated = F.when(F.col("cuts").isNotNull(), F.array_join(split, hyphen))
    fixed = F.replace("_fixed", F.lit("-"), F.lit(hyphen))
    return keyed.join(cuts, ["k", "l"], "left").select("dictionary", "word", F.coalesce(fixed, hyphenated, "word").alias("hyphenated"))


def hyphenate(words: DataFrame, patterns: tuple[str, ...] = PATTERNS, exceptions: dict[str, str] | None = None, hyphen: str = HYPHEN) -> DataFrame:
    """word, hyphenated for each distinct word, by one dictionary that is given as values."""
    exceptions = EXCEPTIONS if exceptions is None else exceptions
    spark, name = words.sparkSession, F.lit("own").alias("dictionary")
    rows = pattern_rows(patterns)
    table = pa.table({"letters": pa.array([r[0] for r in rows], pa.string()), "place": pa.array([r[1] for r in rows], pa.int32()), "value": pa.array([r[2] for r in rows], pa.int32())})
    fixed = pa.table({"word": pa.array(list(exceptions), pa.string()), "hyphenated": pa.array(list(exceptions.values()), pa.string())})
    found = hyphenate_by_dictionary(words.select(name, "word"), spark.createDataFrame(table).select(name, "*"), spark.createDataFrame(fixed).select(name, "*"), hyphen)
    return found.select("word", "hyphenated")


def hyphenate_books(words: DataFrame, patterns: DataFrame, exceptions: DataFrame, hyphen: str = HYPHEN) -> DataFrame:
    """lang, word, hyphenated of words in many languages, each by the dictionary that its tag leads to; words of a language without one stay as they are."""
    distinct = words.select("lang", "word").distinct()
    chosen = hyphen_dictionary(distinct, patterns.select("dictionary").distinct())
    chosen = chosen.select(F.col("lang").alias("_lang"), "dictionary")
    named = distinct.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    found = hyphenate_by_dictionary(named.where("dictionary IS NOT NULL"), patterns, exceptions, hyphen)
    return named.join(found, ["dictionary", "word"], "left").select("lang", "word", F.coalesce("hyphenated", "word").alias("hyphenated"))


#: Languages whose dictionary has another name, and dictionaries that exist. Fixed values.
DICTIONARY_NAMES = {"de": "de-1901", "de-de": "de-1901", "de-at": "de-1996", "de-ch": "de-ch-1901", "el": "el-monoton", "el-gr": "el-monoton", "en": "en-us", "mn": "mn-cyrl", "sh": "sh-latn", "sr": "sr-cyrl", "zh": "zh-latn-pinyin"}


def hyphen_dictionary(langs: DataFrame, available: DataFrame, lang: str = "lang") -> DataFrame:
    """lang, dictionary: the first that exists of the tag, its mapped name, its base and the base's mapped name; null if none."""
    names = F.create_map(*map(F.lit, chain.from_iterable(DICTIONARY_NAMES.items())))
    tag = F.lower(lang)
    base = F.regexp_extract(tag, "^([a-z]+)", 1)
    tried = F.array(tag, F.try_element_at(names, tag), base, F.try_element_at(names, base))
    candidates = langs.select(lang).distinct().select(lang, F.posexplode(tried).alias("rank", "dictionary"))
    best = candidates.join(available, "dictionary").groupBy(lang).agg(F.min_by("dictionary", "rank").alias("dictionary"))
    return langs.select(lang).distinct().join(best, lang, "left")


def drop_caps(paras: DataFrame, key: str, ignore: str) -> DataFrame:
    """The drop cap of each chapter's first paragraph with text."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("para_ix"))
    opening = paras.where(F.col("text") != "").withColumn("_n", first).where("_n = 1")
    return opening.select(key, "para_ix", tx.drop_cap(F.col("text"), ignore).alias("drop_cap"))


def units(text: Column, lang: Column) -> Column:
    """Lengths that pages are filled with: each word's code points, and one blank before it unless it begins a sentence."""
    return F.flatten(F.transform(tx.split_sentences(text, lang), lambda s: F.transform(tx.split_words(s), lambda w, i: F.char_length(w) + F.when(i > 0, 1).otherwise(0))))
