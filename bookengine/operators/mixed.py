"""Paragraphs of mixed content: what is done to a run of text depends on where it stands among inline elements.

A piece of markup (``tokens.markup_pieces``) is a paragraph with its inline elements, so that every run is read and written where it lies,
without a shuffle. Direct speech is taken up at the head of a paragraph alone, dashes there and behind the paragraph, dialogue in all of its text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookengine.functions import text as tx
from bookengine.operators import tokens as tok
from bookengine.operators.blocks import last_values_before, running_sums

#: Tags of paragraphs, and of what drop caps keep out of. Fixed values.
PARAGRAPHS = ("p", "v")
ASIDES = ("title", "subtitle", "epigraph", "annotation", "cite", "poem", "text-author")


@dataclass(frozen=True)
class Normalization:
    """(characters, what they become) of each change; None leaves it out."""

    speech: tuple[str, str] | None = None
    dashes: tuple[str, str] | None = None
    dialogue: tuple[str, str] | None = None

    def apply(self, text: Column, is_head: bool, is_own: bool) -> Column:
        """A run: at the head of its paragraph or not, the paragraph's own or of an inline element."""
        if self.speech and is_head:
            text = tx.normalize_speech(text, *self.speech)
        if self.dashes and is_own:
            text = tx.normalize_dashes(text, *self.dashes)
        # bound to a name once: the change looks at its text several times
        return F.get(F.transform(F.array(text), lambda t: tx.normalize_dialogue(t, *self.dialogue)), F.lit(0)) if self.dialogue else text


def _tag(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))


def _opens(raw: Column) -> Column:
    return F.startswith(raw, F.lit("<")) & ~F.startswith(raw, F.lit("</")) & ~F.endswith(raw, F.lit("/>"))


def _tokens(raw: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(raw, "\r", ""), F.lit(f"({tok.TOKEN})"), F.lit(1))


def paragraph_texts(pieces: DataFrame, key: str, how: Normalization) -> DataFrame:
    """key, piece, text, behind: the normalised text of each paragraph with its inline elements, and of what stands directly behind it.

    A run directly behind the opening tag is the head; runs in inline elements, and behind them, are inner ones. A paragraph without text gives
    ''; behind is null where a paragraph ends a line of markup. An element that is not inline ends the paragraph that it stands in.
    """
    first = F.get("_tokens", F.lit(0))
    rows = pieces.select(key, "piece", _tokens(F.col("raw")).alias("_tokens"))
    rows = rows.where(_tag(first).isin(*PARAGRAPHS) & F.startswith(first, F.lit("<")))

    def run(raw: Column, k: Column) -> Column:
        text = tok.unescape(raw)
        return F.when(F.startswith(raw, F.lit("<")), "").when(k == 1, how.apply(text, True, True)).otherwise(how.apply(text, False, False))

    inside = F.array_join(F.transform("_tokens", run), "")
    behind = how.apply(tok.unescape(F.get("_tokens", F.lit(1))), False, True)
    empty = F.endswith(first, F.lit("/>"))
    said = F.when(_opens(first), inside).when(empty, "")
    after = F.when(~_opens(first) & (F.size("_tokens") > 1), behind)
    return rows.select(key, "piece", said.alias("text"), after.alias("behind")).where("text IS NOT NULL OR behind IS NOT NULL")


def chapter_drop_caps(pieces: DataFrame, key: str, ignore: str, how: Normalization = Normalization(), size: int | None = None) -> DataFrame:
    """key, piece, drop_cap of the first line behind each title of the first body, where it is a paragraph's own.

    What stands in titles, epigraphs, quotations and the like is passed over. The first text decides: inside an inline element it takes the chance away.
    Windows carry a few characters a paragraph; ``size`` is that of their blocks (see ``blocks.block_size``).
    """
    tokens = pieces.select(key, "piece", _tokens(F.col("raw")).alias("_tokens")).withColumn("_first", F.get("_tokens", F.lit(0)))
    tag, opens, closes = _tag(F.col("_first")), _opens(F.col("_first")), F.startswith("_first", F.lit("</"))
    is_text = lambda x: ~F.startswith(x, F.lit("<"))
    head = F.get("_tokens", F.lit(1))
    # text behind a closing or empty tag is a tail and decides nothing
    inner = F.exists(F.transform("_tokens", lambda x, k: is_text(x) & (k > 0) & F.coalesce(_opens(F.get("_tokens", k - 1)), F.lit(False))), lambda x: x)
    has_head = opens & F.coalesce(is_text(head), F.lit(False))
    cap = F.when(has_head, tx.drop_cap(how.apply(tok.unescape(head), True, True), ignore))
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    events = tokens.where(tag.isin(*PARAGRAPHS, *ASIDES, "body")).select(
        key, "piece",
        F.when(tag.isin(*ASIDES), step).otherwise(0).alias("_aside"),
        F.when((tag == "body") & opens, 1).otherwise(0).alias("_bodies"),
        F.when((tag == "body") & closes, 1).otherwise(0).alias("_over"),
        F.when((tag == "title") & opens, F.col("piece")).alias("_title"),
        F.when(tag.isin(*PARAGRAPHS) & opens & inner, F.col("piece")).alias("_line"),
        cap.alias("_cap"),
    )
    placed = running_sums(events, [key], "piece", {n: F.col(n) for n in ("_aside", "_bodies", "_over")}, size)
    main = placed.where((F.col("_bodies") == 1) & (F.col("_over") == 0) & (F.col("_title").isNotNull() | (F.col("_line").isNotNull() & (F.col("_aside") == 0))))
    seen = last_values_before(main, [key], "piece", {"_behind": "_title", "_earlier": "_line"}, size)
    is_first = F.col("_line").isNotNull() & F.col("_behind").isNotNull() & (F.col("_earlier").isNull() | (F.col("_earlier") < F.col("_behind")))
    return seen.where(is_first & (F.col("_cap") != "")).select(key, "piece", F.col("_cap").alias("drop_cap"))
