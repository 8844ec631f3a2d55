"""Spans of regular expressions as Column expressions, in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of span. ``accept`` drops failing matches; ``worth`` is a cheap test that texts without a match fail.

    Patterns use possessive quantifiers: nothing to backtrack into, so long runs cost no stack.
    """

    kind: str
    pattern: str
    accept: Callable[[Column], Column] | None = None
    worth: Callable[[Column], Column] | None = None


SPAN = "struct<kind:string,start:bigint,end:bigint>"
MATCH = "struct<kind:string,start:bigint,end:bigint,found:string,before:string,after:string>"
#: Matches that one fold adds up; a fold copies its list for each of them.
CHUNK = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(array: Column) -> Column:
    """An array cut into arrays of CHUNK values."""
    count = F.greatest(F.ceil(F.size(array) / CHUNK).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.slice(array, (k - 1) * CHUNK + 1, CHUNK))


Op = Callable[[Column, Column], Column]


def _running(values: Column, op: Op) -> Column:
    """What all values before each give, and what all give, by a fold from 0."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, n: F.struct(op(acc["at"], n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    return F.aggregate(values, start, step)


def _shifted(parts: Column, by: Column, op: Op) -> Column:
    return F.flatten(F.zip_with(parts, by, lambda p, base: F.transform(p["out"], lambda x: op(base, x))))


def running(values: Column, op: Op) -> Column:
    """For each value (bigint) of an array what the values before it give by an associative ``op``, from 0, in time that grows with its length.

    Chunks are folded each on its own, then what the chunks give, in chunks again; of those there are so few
    that one fold is enough.
    """
    ends = lambda parts: F.transform(parts, lambda p: p["at"])
    in_chunks = lambda array: F.transform(_chunks(array), lambda c: _running(c, op))
    whole = lambda parts: _bound(_bound(ends(parts), in_chunks), lambda above: _shifted(above, _running(ends(above), op)["out"], op))
    return _bound(_bound(values, in_chunks), lambda parts: _shifted(parts, whole(parts), op))


def running_sums(lengths: Column) -> Column:
    """Sum of the values before each value of an array."""
    return running(lengths, lambda a, b: a + b)


def apart(others: Column, taken: Column) -> Column:
    """Spans of an array that overlap none of another (structs of the same fields, kind and start and end among them), in time that grows with both.

    All are put in order of their starts. A span overlaps an earlier one if the farthest end so far is behind its start, and a later one
    if the next start is before its end.
    """
    last = 1 << 60

    def marked(spans: Column, own: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x.alias("span")))

    def kept(every: Column) -> Column:
        ends = running(F.transform(every, lambda x: F.when(x["own"], 0).otherwise(x["span"]["end"]).cast("bigint")), F.greatest)
        # looking back from the end, the least start so far is the greatest distance from a place behind all
        starts = F.reverse(running(F.reverse(F.transform(every, lambda x: F.when(x["own"], 0).otherwise(last - x["start"]).cast("bigint"))), F.greatest))
        free = lambda x, n: x["own"] & (n["before"] <= x["start"]) & (last - n["behind"] >= x["span"]["end"])
        near = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("before"), s.alias("behind")))
        judged = F.zip_with(every, near, lambda x, n: F.when(free(x, n), x["span"]))
        return F.filter(judged, lambda x: x.isNotNull())

    return F.when((F.size(others) == 0) | (F.size(taken) == 0), others).otherwise(_bound(F.array_sort(F.concat(marked(taken, False), marked(others, True))), kept))


def rule_matches(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of one rule that it accepts, with the text before each (from the last match on)
    and behind it (up to the next).

    ``split`` gives the text around the matches that ``regexp_extract_all`` gives; their lengths add up
    to positions.
    """
    # split has one piece more than there are matches
    both = F.struct(F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1)).alias("found"), F.split(text, rule.pattern, -1).alias("between"))
    sides = lambda x: F.zip_with(x["between"], F.slice(x["between"], F.lit(2), F.size(x["between"])), lambda b, a: F.struct(b.alias("before"), a.alias("after")))

    def span(x: Column, at: Column) -> Column:
        start = at + F.char_length(x["before"])
        return F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), (start + F.char_length(x["found"])).alias("end"), x["found"].alias("found"), x["before"].alias("before"), x["after"].alias("after"))

    def placed(found: Column) -> Column:
        lengths = F.transform(found, lambda x: (F.char_length(x["before"]) + F.char_length(x["found"])).cast("bigint"))
        return F.zip_with(found, running_sums(lengths), span)

    joined = lambda x: F.filter(F.zip_with(x["found"], sides(x), lambda m, y: F.struct(m.alias("found"), y["before"].alias("before"), y["after"].alias("after"))), lambda m: m["found"].isNotNull())
    spans = _bound(_bound(both, joined), placed)
    if rule.accept is not None:
        accept = rule.accept
        spans = F.filter(spans, lambda x: accept(x["found"]))
    worth = text.rlike(rule.pattern) if rule.worth is None else rule.worth(text) & text.rlike(rule.pattern)
    return F.when(worth, spans).otherwise(F.array().cast(f"array<{MATCH}>"))


def find_matches(text: Column, rules: tuple[Rule, ...]) -> Column:
    return F.concat(*(rule_matches(text, rule) for rule in rules))


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def find_spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans of all rules, one after the other in the order of the rules."""
    return bare(find_matches(text, rules))


def span_text(spans: Column, kinds: tuple[str, ...], kind_first: bool) -> Column:
    """kind:start:end, comma-joined, ordered by kind as listed and start, or by start and then kind."""
    place = lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["kind"])
    first, second = (place, lambda x: x["start"]) if kind_first else (lambda x: x["start"], place)
    order = F.array_sort(F.transform(spans, lambda x: F.struct(first(x).alias("a"), second(x).alias("b"), x["end"].alias("end"), x["start"].alias("start"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
