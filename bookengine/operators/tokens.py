"""The token table: one row per tag or text run of a marked-up document, in order."""

from __future__ import annotations

from html.entities import html5
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookengine.functions import text as tx

TOKEN = r"<[^>]+>|[^<]+"
ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*)\s*=\s*"([^"]*)\""""
#: Elements whose ends real pages keep; depth counts these alone.
CLOSED = ("html", "head", "body", "article", "div", "ul", "li", "nav", "a", "title", "h1", "footer")

#: Classes of FB2 tags.
FB2_CLASSES = {
    "title": "title", "subtitle": "subtitle", "p": "p", "v": "p", "epigraph": "epigraph", "annotation": "annotation", "poem": "poem",
    "stanza": "stanza", "cite": "cite", "text-author": "text-author", "emphasis": "emphasis", "i": "emphasis", "strong": "strong", "b": "strong",
    "strikethrough": "strikethrough", "code": "code", "date": "time", "sup": "sup", "sub": "sub", "style": "style", "table": "table", "tr": "tr",
    "td": "td", "th": "th", "image": "image", "empty-line": "empty-line", "a": "link", "body": "body", "section": "section",
}
HTML_CLASSES = {"h1": "title", "p": "p", "b": "strong", "br": "empty-line", "a": "link", "ul": "list", "li": "item", "nav": "navigation", "div": "block", "article": "section", "body": "body", "footer": "block", "title": "title"}


def clean_markup(markup: Column) -> Column:
    """Without comments, scripts and styles; CDATA sections are text."""
    out = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", "")
    return F.regexp_replace(out, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")


#: Elements that stand inside a line of text. Fixed values.
INLINE = ("a", "emphasis", "i", "strong", "b", "strikethrough", "code", "sup", "sub", "style", "image", "em", "span")
#: Tags of one piece have positions from its number times this on.
STRIDE = 1 << 24


def markup_pieces(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """key, piece, raw: the markup cut in front of every tag that is not inline. A paragraph with its inline tags is one piece, so that texts are cut without a shuffle."""
    cut = rf"(?=<(?!/?(?:{'|'.join(INLINE)})[\s/>]))"
    return docs.select(key, F.posexplode(F.split(clean_markup(F.col(markup)), cut, -1)).alias("piece", "raw")).where("raw <> ''")


def piece_tags(pieces: DataFrame, key: str) -> DataFrame:
    """The tags of pieces as token rows, without texts: key, pos (in the order of the document), kind, tag, attrs."""
    tags = pieces.where(F.contains("raw", F.lit("<"))).select(key, "piece", F.posexplode(F.regexp_extract_all("raw", F.lit("(<[^>]+>)"), F.lit(1))).alias("k", "raw"))
    return tags.select(key, ((F.col("piece") + 1).cast("long") * STRIDE + F.col("k")).alias("pos"), *token_columns(F.col("raw"))).drop("text")


def piece_texts(pieces: DataFrame, key: str) -> DataFrame:
    """key, pos (of the tag in front), opens (the tag that a piece opens with, else ''), text, unlinked (without what links hold; null if there are none)."""
    raw = F.regexp_replace("raw", "\r", "")
    said = lambda markup: unescape(F.regexp_replace(markup, "<[^>]*>", ""))
    opens = F.lower(F.regexp_extract("raw", r"^<([A-Za-z][A-Za-z0-9:-]*)(?:[^>]*[^/>])?>", 1))
    # closing tags with nothing behind them are half of all pieces
    spoken = pieces.where(~F.col("raw").rlike(r"^</[^>]*>\z"))
    return spoken.select(key, ((F.col("piece") + 1).cast("long") * STRIDE).alias("pos"), opens.alias("opens"), said(raw).alias("text"), F.when(raw.rlike(r"<a\b"), said(F.regexp_replace(raw, r"(?s)<a\b[^>]*(?<!/)>.*?</a\s*>", ""))).alias("unlinked"))


def piece_texts_behind(pieces: DataFrame, key: str) -> DataFrame:
    """key, start, text: the text directly behind each opening tag, where there is any."""
    found = pieces.select(key, "piece", F.posexplode(F.arrays_zip(F.regexp_extract_all("raw", F.lit("(<[^>]+>)[^<]*"), F.lit(1)).alias("tag"), F.regexp_extract_all("raw", F.lit("<[^>]+>([^<]*)"), F.lit(1)).alias("text"))).alias("k", "p"))
    opening = ~F.startswith("p.tag", F.lit("</")) & ~F.endswith("p.tag", F.lit("/>"))
    return found.where(opening & (F.col("p.text") != "")).select(key, ((F.col("piece") + 1).cast("long") * STRIDE + F.col("k")).alias("start"), unescape(F.col("p.text")).alias("text"))


def tokenize_markup(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """key, pos (from 1), kind (open, close, selfclose, decl, text), tag, attrs, text. A '<' without '>' is dropped."""
    raw = docs.select(key, F.posexplode(F.regexp_extract_all(clean_markup(F.col(markup)), F.lit(f"({TOKEN})"), F.lit(1))).alias("p", "raw"))
    return raw.select(key, (F.col("p") + 1).alias("pos"), *token_columns(F.col("raw")))


def token_columns(r: Column) -> list[Column]:
    """kind, tag, attrs, text of a tag or a run of text."""
    kind = (
        F.when(F.startswith(r, F.lit("</")), "close")
        .when(F.startswith(r, F.lit("<!")) | F.startswith(r, F.lit("<?")), "decl")
        .when(F.startswith(r, F.lit("<")) & F.endswith(r, F.lit("/>")), "selfclose")
        .when(F.startswith(r, F.lit("<")), "open")
        .otherwise("text")
    )
    names, values = (F.regexp_extract_all(r, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    # of an attribute given twice the first counts
    pairs = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda x, i: (F.array_position(names, x["name"]) == i + 1))
    attrs = F.when(F.contains(r, F.lit("=")) & F.startswith(r, F.lit("<")), F.map_from_entries(pairs)).otherwise(F.create_map().cast("map<string,string>"))
    return [kind.alias("kind"), F.lower(F.regexp_extract(r, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1)).alias("tag"), attrs.alias("attrs"), F.when(kind == "text", r).alias("text")]


def order(key: str) -> Window:
    return Window.partitionBy(key).orderBy("pos")


def upto(key: str) -> Window:
    return order(key).rowsBetween(Window.unboundedPreceding, 0)


def inside(kind: Column, tag: Column, name: str, window: Window) -> Column:
    """How many elements of a name are open at a token; its own tags count as inside."""
    opened = F.sum(F.when((tag == name) & (kind == "open"), 1).otherwise(0)).over(window)
    closed = F.sum(F.when((tag == name) & (kind == "close"), 1).otherwise(0)).over(window)
    own = F.when((tag == name) & (kind == "close"), 1).otherwise(0)
    return opened - closed + own


def element_depth(tokens: DataFrame, key: str, tags: tuple[str, ...] = CLOSED) -> DataFrame:
    """Tokens with ``depth`` (open elements around, own included) and ``level``, which styles cap at 6."""
    listed = F.col("tag").isin(*tags)
    step = F.when(listed & (F.col("kind") == "open"), 1).when(listed & (F.col("kind") == "close"), -1).otherwise(0)
    depth = F.sum(step).over(upto(key)) + F.when(listed & (F.col("kind") == "close"), 1).otherwise(0)
    return tokens.withColumn("depth", depth.cast("int")).withColumn("level", F.least(F.col("depth"), F.lit(6)))


def classify_elements(tokens: DataFrame, classes: dict[str, str], key: str, containers: tuple[str, ...] = ("body", "section")) -> DataFrame:
    """Opening tags with ``class`` and ``parent``; a tag of no class is 'unknown', and dropped directly under a container.

    The parent is the element opened last, before the token, one level further out.
    """
    nesting = tuple({*CLOSED, *containers})
    listed = F.col("tag").isin(*nesting)
    nested = element_depth(tokens, key, nesting).where("kind IN ('open', 'selfclose')")
    around = F.when(listed & (F.col("kind") == "open"), F.col("depth") - 1).otherwise(F.col("depth"))
    # each opening offers itself to its own level, and every token asks at the level around it
    offers = nested.where(listed & (F.col("kind") == "open")).select(key, "pos", F.col("depth").alias("_level"), F.col("tag").alias("_offer"), F.lit(None).cast("string").alias("tag"))
    asks = nested.select(key, "pos", around.alias("_level"), F.lit(None).cast("string").alias("_offer"), "tag")
    before = Window.partitionBy(key, "_level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = offers.unionByName(asks).withColumn("parent", F.last("_offer", ignorenulls=True).over(before)).where("tag is not null")
    lookup = F.create_map(*map(F.lit, chain.from_iterable(classes.items())))
    kind = F.coalesce(F.try_element_at(lookup, F.col("tag")), F.lit("unknown"))
    dropped = (F.col("class") == "unknown") & F.coalesce(F.col("parent").isin(*containers), F.lit(False))
    return found.select(key, "pos", "tag", kind.alias("class"), "parent").where(~dropped)


def article_tokens(tokens: DataFrame, key: str, root: str) -> DataFrame:
    """Tokens inside the first element of a name, its own tags left out, and the text right behind its end (``is_tail``)."""
    w = upto(key)
    starts = F.sum(F.when((F.col("tag") == root) & (F.col("kind") == "open"), 1).otherwise(0)).over(w)
    ends = F.sum(F.when((F.col("tag") == root) & (F.col("kind") == "close"), 1).otherwise(0)).over(w)
    before = F.struct("kind", "tag")
    previous = F.lag(before).over(order(key))
    marked = tokens.withColumns({"_starts": starts, "_ends": ends, "_previous": previous})
    body = (F.col("_starts") >= 1) & (F.col("_ends") == 0) & ~((F.col("tag") == root) & (F.col("kind") == "open") & (F.col("_starts") == 1))
    tail = (F.col("kind") == "text") & (F.col("_ends") == 1) & (F.col("_previous.kind") == "close") & (F.col("_previous.tag") == root)
    return marked.where(body | tail).withColumn("is_tail", tail).drop("_starts", "_ends", "_previous")


def text_fragment(tokens: DataFrame, key: str, root: str) -> DataFrame:
    """key, fragment: text of an element and its tail. Paragraphs and divs start a line; what is inside links is skipped."""
    body = article_tokens(tokens, key, root)
    links = inside(F.col("kind"), F.col("tag"), "a", upto(key))
    piece = F.when((F.col("kind") == "open") & F.col("tag").isin("p", "div"), "\n").when((F.col("kind") == "text") & (F.col("_links") == 0), F.col("text"))
    pieces = body.withColumn("_links", links).select(key, "pos", piece.alias("piece")).where("piece is not null")
    joined = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda x: x["piece"]), "")
    return joined.select(key, F.regexp_replace(text, f"^[{tx.WS}]+|[{tx.WS}]+\\z", "").alias("fragment"))


def full_text_fragment(markup: Column) -> Column:
    """All text of an element's markup, a line for each paragraph, blank lines dropped. Tags that hold parentheses survive."""
    out = F.replace(F.replace(F.replace(markup, F.lit("\r"), F.lit("")), F.lit("<p>"), F.lit("\n")), F.lit("</p>"), F.lit(""))
    lines = F.split(F.regexp_replace(out, r"<[^(><)]+>", ""), "\n")
    return F.array_join(F.filter(lines, lambda x: x.rlike(f"[^{tx.WS}]")), "\n")


#: References by number, and those that XML names itself. Fixed values.
NUMERIC = "#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}"
XML_NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def numbered_character(name: Column) -> Column:
    """The character of ``#65`` or ``#x41``; null for other names and for numbers that are no character."""
    code = F.when(F.lower(F.left(name, F.lit(2))) == "#x", F.conv(F.substring(name, 3, 6), 16, 10)).when(F.startswith(name, F.lit("#")), F.substring(name, 2, 7)).cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    # rows without a character decode a blank
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(32).cast("long")), 8, "0")), "UTF-32"))


def unescape(text: Column) -> Column:
    """Text with XML's own references and those by number resolved; others stay."""
    pattern = f"&({NUMERIC}|{'|'.join(XML_NAMES)});"

    def character(name: Column) -> Column:
        out = F.coalesce(numbered_character(name), F.concat(F.lit("&"), name, F.lit(";")))
        for known, value in XML_NAMES.items():
            out = F.when(name == known, value).otherwise(out)
        return out

    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda before, name: F.concat(before, F.when(name.isNull(), "").otherwise(character(name))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


#: Named character references that end in a semicolon.
ENTITIES = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}


def resolve_entities(docs: DataFrame, key: str, markup: str, entities: dict[str, str] = ENTITIES) -> DataFrame:
    """key, resolved: references by name and by number become characters; unknown names and numbers stay.

    The table of names is fixed and small, so it is broadcast; texts are taken apart at the references and joined again in order.
    """
    table = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"name": list(entities), "value": list(entities.values())})))
    pattern = f"&([A-Za-z][A-Za-z0-9]*|{NUMERIC});"
    text = F.col(markup)
    between = F.split(text, pattern, -1)
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    plain = docs.where(~text.rlike(pattern)).select(key, text.alias("resolved"))
    parts = docs.where(text.rlike(pattern)).select(key, F.posexplode(F.zip_with(between, names, lambda b, n: F.struct(b.alias("before"), n.alias("name")))).alias("pos", "p")).select(key, "pos", "p.before", "p.name")
    found = parts.join(table, "name", "left")
    value = F.coalesce("value", numbered_character(F.col("name")), F.when(F.col("name").isNotNull(), F.concat(F.lit("&"), "name", F.lit(";"))), F.lit(""))
    joined = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("before", value).alias("piece")))).alias("pieces"))
    return plain.unionByName(joined.select(key, F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("resolved")))


def select_attribute(tokens: DataFrame, key: str, tag: str, attribute: str) -> DataFrame:
    """``//tag[@attribute]``: key, pos and value of every such element, in order."""
    value = F.try_element_at("attrs", F.lit(attribute))
    return tokens.where((F.col("tag") == tag) & F.col("kind").isin("open", "selfclose") & value.isNotNull()).select(key, "pos", value.alias("value"))


def select_text(tokens: DataFrame, key: str, tag: str) -> DataFrame:
    """``//tag/text()`` of the text right behind each opening tag: key, pos of the tag, text."""
    following = F.lead(F.when(F.col("kind") == "text", F.col("text"))).over(order(key))
    return tokens.withColumn("_text", following).where((F.col("tag") == tag) & (F.col("kind") == "open")).select(key, "pos", F.col("_text").alias("text"))
