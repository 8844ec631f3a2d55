"""The element table: one row per element of a marked-up document, with its interval of tokens; paths over it as joins.

``start`` and ``end`` are the positions of an element's tags, so that one element holds another if its interval does.
Children are found by an equi-join on the parent, descendants by a running count of the open contexts: no step compares
pairs of elements.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookengine.operators.blocks import BLOCK, first_after, last_before, last_values_before, running_sums

#: The end of an element that nothing closes.
NO_END = (1 << 62) - 1


def with_depth(tokens: DataFrame, key: str, nesting: tuple[str, ...] | None = None, size: int | None = BLOCK) -> DataFrame:
    """Tokens with ``depth`` (open elements around, own included) and ``nests`` (a tag that opens or closes an element which can hold others).

    ``nesting`` names the elements that tags open and close; by default all, as in well-formed markup. Others hold nothing.
    """
    nests = F.lit(True) if nesting is None else F.col("tag").isin(*nesting)
    opens, closes = nests & (F.col("kind") == "open"), nests & (F.col("kind") == "close")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    summed = running_sums(tokens, [key], "pos", {"depth": step}, size)
    leaf = F.col("kind").isin("open", "selfclose") & ~opens
    return summed.withColumns({"depth": F.col("depth") + F.when(closes | leaf, 1).otherwise(0), "nests": opens | closes})


def element_table(tokens: DataFrame, key: str, size: int | None = BLOCK) -> DataFrame:
    """key, start, end, parent (start of the element around; 0 at the top), depth, tag, attrs of tokens with depth, or of their tags alone.

    A closing tag closes the element opened last at its depth, whatever its name. Without any, the element holds all that follows.
    """
    tags = tokens.where(F.col("kind").isin("open", "close", "selfclose") & (F.col("tag") != ""))
    opens = F.col("kind") != "close"
    # at one depth opening and closing tags take turns
    closing = F.when(F.col("kind") == "close", F.col("pos"))
    matched = first_after(tags.withColumn("_close", closing), [key, "depth"], "pos", "_close", "_end", size).where(opens)
    # an element asks, one level further out, for the element opened last before it; each offers itself to its own level
    asks = matched.select(key, F.col("pos").alias("start"), F.when(F.col("nests"), F.coalesce("_end", F.lit(NO_END))).otherwise(F.col("pos")).alias("end"), "depth", "tag", "attrs", (F.col("depth") - 1).alias("_level"), F.lit(None).cast("long").alias("_offer"))
    offers = tags.where((F.col("kind") == "open") & F.col("nests")).select(key, F.col("pos").alias("start"), F.col("depth").alias("_level"), F.col("pos").cast("long").alias("_offer"))
    nested = last_before(asks.unionByName(offers, allowMissingColumns=True), [key, "_level"], "start", "_offer", "parent", size).where("tag IS NOT NULL")
    return nested.select(key, "start", "end", F.coalesce("parent", F.lit(0).cast("long")).alias("parent"), "depth", "tag", "attrs")


def texts_behind(tokens: DataFrame, key: str) -> DataFrame:
    """key, start, text: the text directly behind opening tags."""
    texts = tokens.where("kind = 'text'").select(key, (F.col("pos") - 1).alias("start"), "text")
    return _semi(texts, tokens.where("kind = 'open'"), key, "start", "pos")


def open_count(rows: DataFrame, spans: DataFrame, key: str, at: str, size: int | None = BLOCK) -> DataFrame:
    """Rows with ``around``: how many spans (start, end) hold their position ``at`` strictly inside. A span does not hold its own start."""
    begin = spans.select(key, (2 * F.col("start") + 1).alias("_at"), F.lit(1).alias("_step"))
    over = spans.select(key, (2 * F.col("end") + 1).alias("_at"), F.lit(-1).alias("_step"))
    asked = rows.withColumns({"_at": 2 * F.col(at).cast("long"), "_step": F.lit(0), "_asks": F.lit(True)})
    every = asked.unionByName(begin.unionByName(over), allowMissingColumns=True)
    return running_sums(every, [key], "_at", {"around": F.col("_step")}, size).where("_asks").drop("_at", "_step", "_asks")


#: A step of a path, and a test in brackets.
_STEP = re.compile(r"""(//?|^)(\.\.|\.|\*|[\w:-]+)((?:\[(?:[^\]'"]|'[^']*'|"[^"]*")*\])*)""")
_TEST = re.compile(r"""\[((?:[^\]'"]|'[^']*'|"[^"]*")*)\]""")
_VALUE = re.compile(r"""(@?[\w:()-]+)\s*=\s*(?:'([^']*)'|"([^"]*)")$""")


def path_steps(path: str) -> list[tuple[str, str, list[str]]]:
    """(separator, selector, tests) of every step; a path that can't be read is an error."""
    steps, at = [], 0
    while at < len(path):
        found = _STEP.match(path, at)
        if found is None:
            raise ValueError(f"path {path!r} can't be read from {path[at:]!r} on")
        steps.append((found[1], found[2], _TEST.findall(found[3])))
        at = found.end()
    return steps


def _semi(rows: DataFrame, others: DataFrame, key: str, column: str, other: str) -> DataFrame:
    o = others.select(F.col(key).alias("_key"), F.col(other).alias("_other")).distinct()
    return rows.join(o, rows[key].eqNullSafe(o["_key"]) & (rows[column] == o["_other"]), "left_semi")


def _tested(found: DataFrame, elements: DataFrame, key: str, test: str, size: int | None, texts: DataFrame | None) -> DataFrame:
    if re.fullmatch(r"-?[0-9]+", test):
        n = int(test)
        forward = F.col("start") if n > 0 else -F.col("start")
        numbered = running_sums(found.withColumn("_by", forward), [key, "parent"], "_by", {"_n": F.lit(1)}, size)
        return numbered.where(F.col("_n") == abs(n)).drop("_n", "_by")
    equal = _VALUE.match(test)
    name, value = (equal[1], equal[2] if equal[2] is not None else equal[3]) if equal else (test, None)
    held = lambda c: c.isNotNull() & (c != "") if value is None else c == value
    if name.startswith("@"):
        attribute = F.try_element_at("attrs", F.lit(name[1:]))
        return found.where(attribute.isNotNull() if value is None else attribute == value)
    if name == "text()":
        return _semi(found, texts.where(held(F.col("text"))), key, "start", "start")
    children = elements.where(F.col("tag") == name)
    if value is not None:
        children = _semi(children, texts.where(F.col("text") == value), key, "start", "start")
    return _semi(found, children, key, "start", "parent")


def select_path(elements: DataFrame, key: str, path: str, within: DataFrame | None = None, size: int | None = BLOCK, texts: DataFrame | None = None) -> DataFrame:
    """The elements that a path leads to from the document's top, or from the elements ``within``; each once, as rows of ``elements``.

    ``/tag``, ``//tag`` (at any depth), ``*``, ``.``, ``..`` and the tests ``[n]`` (of the elements that share a parent; from the end if negative),
    ``[@name]``, ``[@name='value']``, ``[tag]``, ``[tag='value']``, ``[text()]``, ``[text()='value']``. A path that starts with
    ``/`` starts at the top in any case. Tests of texts need ``texts``: key, start, text.
    """
    context = None if path.startswith("/") else within
    for separator, selector, tests in path_steps(path):
        if selector == ".":
            found = context
        elif selector == "..":
            found = None if context is None else _semi(elements, context, key, "start", "parent")
        else:
            if context is None:
                found = elements if separator == "//" else elements.where("parent = 0")
            elif separator == "//":
                found = open_count(elements, context, key, "start", size).where("around > 0").drop("around")
            else:
                found = _semi(elements, context, key, "parent", "start")
            found = found if selector == "*" else found.where(F.col("tag") == selector)
        for test in tests:
            found = _tested(elements if found is None else found, elements, key, test, size, texts)
        context = found
    return elements if context is None else context


def texts_of(pieces: DataFrame, units: DataFrame, key: str, values: dict[str, Column], size: int | None = BLOCK, *more: str) -> DataFrame:
    """key, kind, start, value and the columns ``more`` of units (kind, start, end; none inside another of its kind): by ``values[kind]``
    what the pieces (pos) inside a unit say, joined in order; '' without any.

    All kinds go in one pass: the pieces' texts are dealt out once, by document, and joined where they are.
    """
    unit = F.struct("start", "end", *more)
    offers = units.select(key, (2 * F.col("start")).alias("_at"), "kind", *(F.when(F.col("kind") == k, unit).alias(f"_unit_{k}") for k in values))
    asks = pieces.withColumn("_at", 2 * F.col("pos") + 1)
    placed = last_values_before(asks.unionByName(offers, allowMissingColumns=True), [key], "_at", {f"_in_{k}": f"_unit_{k}" for k in values}, size)
    # a unit stands for itself, so that those without pieces stay
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(f"_unit_{k}", F.when(F.col("kind").isNull(), F.col(f"_in_{k}"))).alias("unit"), F.when(F.col("kind").isNull(), value).alias("piece")) for k, value in values.items()))
    held = F.filter(parts, lambda x: x["unit"].isNotNull() & (F.col("pos").isNull() | (F.col("pos") <= x["unit"]["end"])))
    kept = placed.select(key, "pos", F.explode(held).alias("p"))
    said = F.when(F.col("p.piece") != "", F.struct("pos", F.col("p.piece").alias("piece")))
    joined = kept.groupBy(key, F.col("p.kind").alias("kind"), F.col("p.unit.start").alias("start")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["piece"]), "").alias("value"), *(F.first(F.col("p.unit")[m]).alias(m) for m in more))
    return joined.select(key, "kind", "start", "value", *more)
