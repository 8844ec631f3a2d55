"""Sentence breaks learned from a corpus without labels (Kiss and Strunk's statistics), as aggregates and joins.

A word that stands with a period far more often than chance, and hardly ever without, is an abbreviation. After an abbreviation a
sentence ends only if the next word begins in upper case although it occurs in lower case elsewhere and never in upper case inside a sentence.
Both tables are counts by (language, word type), so a corpus of any size gives tables of the size of its vocabulary.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from bookengine.functions.text import MARK, WS
from bookengine.sources import sinks

#: Least score of an abbreviation, and the share of periods that one is expected to have. Fixed values of the method.
LEAST_SCORE = 0.3
EXPECTED = 0.99
#: The language whose model serves others that have none.
FALLBACK = "en"
_ENDS = ".!?…"
#: White space as Python writes it.
_CLASS = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WS)
_BORDER, _WORD, _BLANK = re.compile(f"[{_ENDS}][{_CLASS}]+"), re.compile(f"[^{_CLASS}]+"), re.compile(f"[{_CLASS}]")
_OPENING = re.compile(f"[{_ENDS}][{_CLASS}]+(?=([^{_CLASS}]+))")
#: Different words that a task holds before it passes their counts on.
_WORDS_AT_ONCE = 1 << 18
#: Characters of text that a batch of rows is made of.
_TEXT_AT_ONCE = 4 << 20
WORDS = pa.schema({"lang": pa.string(), "word": pa.string(), "n": pa.int64(), "n_opening": pa.int64()})
SEAMS = pa.schema({"ix": pa.int32(), "before": pa.string(), "head": pa.string()})
SENTENCES = pa.schema({"sent_ix": pa.int32(), "text": pa.string()})


@dataclass(frozen=True)
class BreakModel:
    """``abbreviations``: lang, type, n_with, n_without, score. ``starters``: lang, type of the words that begin a sentence when in upper case behind an abbreviation."""

    abbreviations: DataFrame
    starters: DataFrame


def _core(word: Column) -> Column:
    """A word without what is no letter around it; its periods behind stay."""
    return F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}.]+$", "")


def _type(core: Column) -> Column:
    return F.regexp_replace(F.lower(core), r"\.+$", "")


def score_abbreviations(counts: DataFrame) -> DataFrame:
    """Counts (lang, type, n_with, n_without) with ``score``: log-likelihood ratio of a period behind the type, less for long types and for each time without, more for periods inside."""
    total = counts.groupBy("lang").agg((F.sum("n_with") + F.sum("n_without")).alias("_all"), F.sum("n_with").alias("_periods"))
    c = counts.join(total, "lang")
    chance = F.col("_periods") / F.col("_all")
    log = lambda n, p: F.when(n > 0, n * F.ln(p)).otherwise(0.0)
    n, m = F.col("n_with"), F.col("n_without")
    ratio = -2 * (log(n, chance) + log(m, 1 - chance) - n * F.ln(F.lit(EXPECTED)) - m * F.ln(F.lit(1 - EXPECTED)))
    inner = F.char_length("type") - F.char_length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.char_length("type") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -m.cast("double"))
    return c.where("n_with > 0").select("lang", "type", "n_with", "n_without", score.alias("score"))


def train_breaks(docs: DataFrame, text: str = "text", lang: str = "lang") -> BreakModel:
    """A model for each language of the corpus. Rows without a language or a text teach nothing. The corpus is read once: counts and abbreviations are staged."""
    # words are counted in the task first, so that what is shuffled is vocabulary, and each word is taken apart once
    said = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    words = said.mapInArrow(_counted, from_arrow_schema(WORDS)).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("n_opening").alias("n_opening"))
    core = words.select("lang", _core(F.col("word")).alias("core"), "n", "n_opening")
    period = F.endswith("core", F.lit(".")) & ~F.endswith("core", F.lit(".."))
    upper = F.left("core", F.lit(1)) != F.lower(F.left("core", F.lit(1)))
    times = lambda condition, n: F.sum(F.when(condition, n).otherwise(0))
    typed = core.select(_type(F.col("core")).alias("type"), period.alias("period"), upper.alias("upper"), "lang", "n", (F.col("n") - F.col("n_opening")).alias("n_inner")).where("type <> ''")
    counts = typed.groupBy("lang", "type").agg(
        times(F.col("period"), F.col("n")).alias("n_with"), times(~F.col("period"), F.col("n")).alias("n_without"), times(~F.col("upper"), F.col("n")).alias("n_lower"), times(F.col("upper"), F.col("n_inner")).alias("n_inner_upper")
    )
    counts = sinks.staged(counts, "words")
    scored = score_abbreviations(counts.select("lang", "type", "n_with", "n_without"))
    return BreakModel(sinks.staged(scored.where(F.col("score") >= LEAST_SCORE), "abbreviations"), counts.where("n_lower > 0 AND n_inner_upper = 0").select("lang", "type"))


def _words(text: str) -> list[str]:
    """Words between white space. Python's own blanks are those and four controls."""
    return _WORD.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by language: how often they occur, and how often as the first of a text or behind an end mark."""
    counts: dict[str, tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (every, opening) in counts.items():
            columns = [[lang] * len(every), list(every), list(every.values()), [opening[w] for w in every]]
            yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, WORDS, strict=True)], schema=WORDS)
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            text = text.as_py()
            every, opening = counts.setdefault(lang.as_py(), (Counter(), Counter()))
            words = _words(text)
            every.update(words)
            opening.update(words[:1])
            opening.update(_OPENING.findall(text))
            if sum(len(c) for c, _ in counts.values()) >= _WORDS_AT_ONCE:
                yield from rows()
    yield from rows()


def _fragments(text: str, cut: bool) -> list[str]:
    """A text cut behind end marks; whole if its language has no model."""
    if not cut:
        return [text]
    found: list[str] = []
    for piece in text.split(MARK):
        ends = [m.end() for m in _BORDER.finditer(piece)]
        found += [piece[a:b] for a, b in pairwise([0, *ends, len(piece)]) if a < b]
    return found


def _rows(make: Callable[..., Iterator[tuple]], keys: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first columns of a batch beside the rows that ``make`` gives for the values of the others, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            held = 0
            for k in range(batch.num_rows):
                values = [batch.column(c)[k].as_py() for c in range(keys, batch.num_columns)]
                found.extend(make(*values))
                at.extend(repeat(k, len(found) - len(at)))
                held += len(values[0])
                if held >= _TEXT_AT_ONCE or k + 1 == batch.num_rows:
                    beside = batch.select(range(keys)).take(pa.array(at, pa.int32()))
                    made = [pa.array(column, field.type) for column, field in zip(zip(*found, strict=True) if found else [()] * len(schema), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays([*beside.columns, *made], [*beside.schema.names, *schema.names])
                    at, found, held = [], [], 0

    return run


def _seams(text: str, cut: bool) -> Iterator[tuple[int, str, str]]:
    """Place of a fragment, the word with a period before it, and its first word."""
    before = ""
    for ix, fragment in enumerate(_fragments(text, cut)):
        words = _words(fragment)
        if "." in before:
            yield ix, before, words[0] if words else ""
        before = words[-1] if words and _BLANK.match(fragment[-1]) else ""


def _sentences(text: str, cut: bool, joined: list[int] | None) -> Iterator[tuple[int, str]]:
    """Fragments whose place is in ``joined`` go on with the sentence before them."""
    inside = set(joined or ())
    fragments = _fragments(text, cut)
    starts = [ix for ix in range(len(fragments)) if ix not in inside]
    for n, (start, end) in enumerate(pairwise([*starts, len(fragments)])):
        yield n, "".join(fragments[start:end])


def learned_sentences(paras: DataFrame, model: BreakModel, *keys: str) -> DataFrame:
    """keys, sent_ix, text: sentences of paragraphs (keys, lang, text), whose concatenation is the text. Keys tell paragraphs apart.

    A language without a model takes that of ``FALLBACK``; without that either, and for a null language, a text is one sentence. Empty and null texts have none.
    Paragraphs are cut behind end marks, and fragments behind an abbreviation are joined to the next unless a starter follows. What is judged is the two words at
    a cut; texts are dealt out once, to meet the places of the fragments that are joined.
    """
    known = model.abbreviations.select(F.col("lang").alias("_known")).unionByName(model.starters.select(F.col("lang").alias("_known"))).distinct()
    fallback = known.where(F.col("_known") == FALLBACK).withColumnRenamed("_known", "_fallback")
    # a row a language
    with_model = paras.where("text <> ''").select(*keys, "lang", "text").join(F.broadcast(known), F.col("lang") == F.col("_known"), "left")
    with_model = with_model.join(F.broadcast(fallback), F.col("lang").isNotNull() & F.col("_known").isNull() & (F.col("lang") != F.col("_fallback")), "left")
    named = with_model.select(*keys, F.coalesce("_known", "_fallback").alias("_lang"), "text")
    fields = [named.schema[k] for k in keys]
    kept = StructType([*fields, named.schema["_lang"]])
    seams = named.where("_lang IS NOT NULL").select(*kept.names, "text", F.lit(True).alias("_cut"))
    seams = seams.mapInArrow(_rows(_seams, len(kept), SEAMS), StructType([*kept, *from_arrow_schema(SEAMS)]))
    # behind an explode, through which no filter is pushed, so that each word is taken apart once
    cores = seams.select(*kept.names, "ix", "head", F.explode(F.array(F.struct(_core(F.col("before")).alias("before"), _core(F.col("head")).alias("head")))).alias("core"))
    before, head = F.col("core.before"), F.col("core.head")
    upper = F.left(head, F.lit(1)) != F.lower(F.left(head, F.lit(1)))
    # a head in lower case starts nothing: with the blank it is no type, and such heads are spread over the tasks
    starter = F.when(upper, _type(head)).otherwise(F.concat(F.lit(" "), "head"))
    asked = cores.where(F.endswith(before, F.lit(".")) & ~F.endswith(before, F.lit(".."))).select(*kept.names, "ix", _type(before).alias("_abbreviation"), starter.alias("_starter"))
    a = model.abbreviations.select(F.col("lang").alias("_lang"), F.col("type").alias("_abbreviation"))
    s = model.starters.select(F.col("lang").alias("_lang"), F.col("type").alias("_starter"))
    joined = asked.join(a, ["_lang", "_abbreviation"], "left_semi").join(s, ["_lang", "_starter"], "left_anti").groupBy(*keys).agg(F.collect_list("ix").alias("_joined"))
    joined = joined.select(*(F.col(k).alias(f"_key_{n}") for n, k in enumerate(keys)), "_joined")
    same = [named[k].eqNullSafe(joined[f"_key_{n}"]) for n, k in enumerate(keys)]
    dealt = named.join(joined, same, "left").select(*keys, "text", F.col("_lang").isNotNull().alias("_cut"), "_joined")
    return dealt.mapInArrow(_rows(_sentences, len(keys), SENTENCES), StructType([*fields, *from_arrow_schema(SENTENCES)]))
