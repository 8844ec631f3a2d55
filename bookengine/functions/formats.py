"""Formatting expressions: keyword patterns compiled to one Column, and user SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookengine.functions import text as tx

Keys = dict[str, Column]


def _blocks(pattern: str) -> list:
    """The pattern as nested lists of text; unmatched braces are text."""
    root: list = []
    stack = [root]
    k = 0
    while k < len(pattern):
        char = pattern[k]
        if char == "\\" and pattern[k + 1 : k + 2] in ("{", "}"):
            stack[-1].append(pattern[k + 1])
            k += 2
            continue
        if char == "{" and _closes(pattern, k):
            stack[-1].append([])
            stack.append(stack[-1][-1])
        elif char == "}" and len(stack) > 1:
            stack.pop()
        else:
            stack[-1].append(char)
        k += 1
    return root


def _closes(pattern: str, start: int) -> bool:
    depth = 0
    for k in range(start, len(pattern)):
        if pattern[k - 1 : k] == "\\":
            continue
        depth += {"{": 1, "}": -1}.get(pattern[k], 0)
        if depth == 0:
            return True
    return False


def _compile(block: list, keys: Keys) -> Column:
    """A block's text: everything joined if any keyword directly in it has a value, else ''."""
    pieces: list[Column] = []
    used: list[Column] = []
    literal = ""

    def close(text: str) -> str:
        if text:
            pieces.append(F.lit(text))
        return ""

    flat = "".join(x if isinstance(x, str) else "\x00" for x in block)
    inner = iter(x for x in block if not isinstance(x, str))
    names = sorted(keys, reverse=True)
    k = 0
    while k < len(flat):
        name = next((n for n in names if flat.startswith(n, k)), None)
        if name is not None:
            literal = close(literal)
            value = F.coalesce(keys[name], F.lit(""))
            pieces.append(value)
            used.append(value != "")
            k += len(name)
        elif flat[k] == "\x00":
            literal = close(literal)
            pieces.append(_compile(next(inner), keys))
            k += 1
        else:
            literal += flat[k]
            k += 1
    close(literal)
    if not used:
        return F.lit("")
    any_value = used[0]
    for condition in used[1:]:
        any_value = any_value | condition
    return F.when(any_value, F.concat(*pieces)).otherwise("")


def format_keywords(pattern: str, keys: Keys) -> Column:
    """Replace ``#key`` by its Column. A ``{block}``, or the whole pattern, in which no keyword has a value is ''.

    The pattern is compiled on the driver; longer keys go first, so that #authors is not read as #author
    and an s. Values are never expanded again. Escaped braces are text.
    """
    return _compile(_blocks(pattern), keys)


def author_keywords(author: Column) -> Keys:
    name = lambda part: F.coalesce(author[part], F.lit(""))
    initial = lambda part: F.when(name(part) != "", F.concat(tx.first_char(name(part)), F.lit("."))).otherwise("")
    return {"#f": name("first"), "#fi": initial("first"), "#m": name("middle"), "#mi": initial("middle"), "#l": name("last")}


def _series_keywords(books: DataFrame, pad: int, word: int) -> Keys:
    series, number = F.coalesce(books["seq_name"], F.lit("")), F.coalesce(books["seq_num"], F.lit(0))
    return {
        "#title": F.coalesce(books["title"], F.lit("")),
        "#series": series,
        "#series_first_word": tx.first_word(series, word),
        "#abbrseries": F.lower(tx.abbreviation(series)),
        "#ABBRseries": F.upper(tx.abbreviation(series)),
        "#number": F.when(number > 0, number.cast("string")).otherwise(""),
        "#padnumber": tx.pad_number(number, pad),
    }


def title_keywords(books: DataFrame, pad: int = 2, word: int = 0) -> Keys:
    base = F.element_at(F.split(books["path"], "/"), -1)
    return _series_keywords(books, pad, word) | {"#file_name": F.regexp_replace(base, r"\.[^.]*$", ""), "#file_name_ext": base, "#date": F.coalesce(books["date"], F.lit(""))}


def author_string(books: DataFrame, pattern: str, short: bool = False) -> Column:
    """All authors joined by commas, or the first and a note that there are more."""
    formatted = F.transform(books["authors"], lambda a: format_keywords(pattern, author_keywords(a)))
    if not short:
        return F.array_join(formatted, ", ")
    more = F.when(F.size(formatted) > 1, F.when(books["lang"] == "ru", " и др").otherwise(", et al")).otherwise("")
    return F.when(F.size(formatted) > 0, F.concat(formatted[0], more)).otherwise("")


def file_name_keywords(books: DataFrame, author_pattern: str, pad: int = 2, word: int = 0) -> Keys:
    return _series_keywords(books, pad, word) | {"#authors": author_string(books, author_pattern), "#author": author_string(books, author_pattern, short=True), "#bookid": books["book_id"]}


def note_keywords(body_name: Column, body_number: Column, note_number: Column) -> Keys:
    first = tx.first_char(body_name)
    return {
        "#number": note_number.cast("string"),
        "#body_number": F.when(body_number > 0, body_number.cast("string")).otherwise(""),
        "#body_name": body_name,
        "#body_name_Fl": first,
        "#body_name_fl": F.lower(first),
        "#body_name_FL": F.upper(first),
    }


#: Contexts of user expressions and the struct that some demand.
CONTEXTS = {"opf-title": None, "section-title": None, "stamp-title": None, "toc-title": None, "output-filename": None, "link-notes": "note", "opf-author": "author", "section-author": "author"}


def with_user_expression(books: DataFrame, name: str, context: str, expression: str, **extra: Column) -> DataFrame:
    """``books`` with the value of a Spark SQL expression over its columns, three helper names and the context's struct."""
    demanded = CONTEXTS[context]
    if demanded is not None and demanded not in extra:
        raise ValueError(f"context {context} needs the struct {demanded}")
    helpers = {"first_author_short": author_string(books, "#l", short=True), "all_authors": author_string(books, "#l{, #f}"), "series_letters": F.upper(tx.abbreviation(F.coalesce(books["seq_name"], F.lit(""))))}
    scope = {n: c for n, c in (helpers | extra).items() if n not in books.columns}
    return books.withColumns(scope).withColumn(name, F.expr(expression)).drop(*(n for n in scope if n != name))
