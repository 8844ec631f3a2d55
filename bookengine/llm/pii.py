"""Personal data: fixed patterns plus bootstrapped contextual extraction, in SQL expressions only.

The fixed patterns give the seed entities. What stands around an entity is a lexical pattern, in four grains: the
two words before it, the word before it, the words on both sides, and the word before it with the shape of the
entity. A graph links patterns with the instances that stand in them. Scores pass over this graph a few times: a
pattern is as good as the share of its instances that are known as entities of one kind, an instance as good as the
best of its patterns; what a round has learned counts as known in the next. Identifier-like strings in patterns of
high confidence, which no fixed pattern covers and whose shape fits, become spans of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookengine.llm.spans import Rule, apart, bare, find_matches
from bookengine.llm.store import materialize, scratch

KINDS = ("email", "ip", "card", "phone")


def _luhn(digits: Column) -> Column:
    """Digit sum from the right with every second digit doubled is a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    weighed = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _is_card(found: Column) -> Column:
    digits = _digits(found)
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)


# Fixed patterns. A run of characters is entered at its start only (or where the last match ended),
# since a later start in the same run can't match when the first does not.
RULES = (
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, lambda t: F.contains(t, F.lit("@"))),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(r"^(?:(?:0++|0*+(?:1?[0-9]?[0-9]|2[0-4][0-9]|25[0-5]))(?:\.|$)){4}"), None),
    Rule("card", r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+", _is_card, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(8, 15), lambda t: F.contains(t, F.lit("+"))),
)
#: What an unseen identifier may look like: a run without blanks that holds a digit or @, and runs of digits that follow it
#: after single blanks; at least so many characters, and @ or so many digits.
LEAST_CHARACTERS, LEAST_DIGITS = 6, 4
CANDIDATE = Rule(
    "candidate",
    r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z._%+-]*+[0-9@])(?:[._%+-]*+[A-Za-z0-9@])++(?:\x20\(?[0-9]++(?:[().-]++[0-9]++)*+)*+",
    lambda m: (F.char_length(m) >= LEAST_CHARACTERS) & (F.contains(m, F.lit("@")) | (F.length(_digits(m)) >= LEAST_DIGITS)),
    lambda t: t.rlike("[0-9@]"),
)

ROUNDS = 3
#: Distinct known entities that a pattern must have led to, and the confidence from which it and an instance count.
LEAST_SEEDS = 3
CONFIDENT = 0.6


def _words(text: Column) -> Column:
    """Runs of letters, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _patterns(x: Column) -> Column:
    """The patterns that a match stands in; those that lack a word are left out."""
    # of what follows the first word is enough, so that the split ends with it; it may have an empty piece before it
    after = F.filter(F.slice(F.split(F.lower(x["after"]), r"[^\p{L}]+", 3), 1, 2), lambda w: w != "")
    shape = F.regexp_replace(F.regexp_replace(x["found"], "[0-9]+", "9"), "[A-Za-z]+", "a")

    def named(w: Column) -> Column:
        last, next_ = F.get(w["before"], F.size(w["before"]) - 1), F.get(w["after"], F.lit(0))
        two = F.concat(F.lit("2 "), F.get(w["before"], F.size(w["before"]) - 2), F.lit(" "), last)
        return F.array(two, F.concat(F.lit("1 "), last), F.concat(F.lit("r "), last, F.lit(" "), next_), F.concat(F.lit("s "), last, F.lit(" "), w["shape"]))

    words = F.struct(_words(x["before"]).alias("before"), after.alias("after"), shape.alias("shape"))
    return F.filter(F.element_at(F.transform(F.array(words), named), 1), lambda p: p.isNotNull())


def _nodes(matches: Column) -> Column:
    return F.transform(matches, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["found"]).alias("instance"), _patterns(x).alias("patterns")))


def base_and_candidates(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, seeds (fixed patterns) and candidates that overlap no seed; without texts."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", _nodes(find_matches(text, RULES)).alias("seeds"), _nodes(find_matches(text, (CANDIDATE,))).alias("others"))
    return found.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "seeds", apart(F.col("others"), F.col("seeds")).alias("candidates"))


def fits(instance: Column, kind: Column) -> Column:
    """An identifier can be of a kind by its shape: an address has at least three dots or colons, a card 12 to 19 digits that pass Luhn's test,
    a phone number 7 to 15 digits and no letter, an e-mail address a letter.

    So what a fixed pattern has matched and its check dropped is no span of that kind; among a pattern's instances it counts against it.
    """
    digits = _digits(instance)
    n = F.length(digits)
    return (
        F.when(kind == "ip", instance.rlike(r"^[0-9a-f]*(?:[.:][0-9a-f]*){3,}$") & ~instance.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(7, 15) & ~instance.rlike(r"[\p{L}@]"))
        .otherwise(instance.rlike(r"\p{L}"))
    )


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) and (instance, kind, score) after scoring the graph ``rounds`` times.

    ``edges``: distinct (pattern, instance, kind), kind null where no fixed pattern knows the instance. An instance is
    known as a kind where its score is at least ``confident``; seeds have 1. A pattern's confidence in a kind is the sum
    of the scores of its known instances over the number of all; it counts from ``confident`` and ``least_seeds`` known
    instances on. An instance's score is the confidence of its best pattern, in kinds whose shape it ``fits``.
    """
    seeds = edges.where(F.col("kind").isNotNull()).select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    pairs = edges.select("pattern", "instance").distinct()
    # a pattern of fewer instances can never count
    total = materialize(pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= least_seeds), "pattern_totals")
    links = materialize(pairs.join(total, "pattern"), "pattern_instances")
    scores = materialize(seeds, "instance_scores")
    for _ in range(rounds):
        known = links.join(scores.where(F.col("score") >= confident), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("good"), F.count(F.lit(1)).alias("known"), F.first("total").alias("total"))
        patterns = known.select("pattern", "kind", "known", (F.col("good") / F.col("total")).alias("confidence")).where((F.col("known") >= least_seeds) & (F.col("confidence") >= confident))
        patterns = materialize(patterns.select("pattern", "kind", "confidence"), "pattern_scores")
        raised = links.join(patterns, "pattern").where(fits(F.col("instance"), F.col("kind"))).groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        scores = materialize(seeds.unionByName(raised).groupBy("instance", "kind").agg(F.max("score").alias("score")), "instance_scores")
    return patterns, scores


def extract_pii(docs: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, base (spans of the fixed patterns), added (spans that the patterns discovered).

    One row per input row. Null text counts as empty; null and repeated ids keep their rows; empty
    table: empty result. Positions are code points, end exclusive. A string that patterns of several kinds discover is
    a span of the kind of the highest confidence, by name on ties.
    """
    with scratch(docs.sparkSession) as keep:
        rows = materialize(base_and_candidates(docs), "spans")
        seen = lambda spans, seed: F.transform(spans, lambda x: F.struct((x["kind"] if seed else F.lit(None).cast("string")).alias("kind"), x["instance"].alias("instance"), x["patterns"].alias("patterns")))
        node = rows.select(F.explode(F.concat(seen("seeds", True), seen("candidates", False))).alias("n"))
        edges = materialize(node.select("n.kind", "n.instance", F.explode("n.patterns").alias("pattern")).distinct(), "edges")
        patterns, scores = confident_patterns(edges, rounds, least_seeds, confident)
        loose = rows.select("row_id", F.explode("candidates").alias("c")).select("row_id", "c.start", "c.end", "c.instance", F.explode("c.patterns").alias("pattern"))
        hits = loose.join(patterns, "pattern").join(scores.where(F.col("score") >= confident).select("instance", "kind"), ["instance", "kind"])
        best = hits.groupBy("row_id", "start", "end").agg(F.min(F.struct((-F.col("confidence")).alias("rank"), "kind")).alias("best"))
        added = materialize(best.groupBy("row_id").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("added")), "added")
        keep(rows, added)
    # a document's own spans are the only rows gathered; they are bounded by its text
    return rows.join(added, "row_id", "left").select("doc_id", bare(F.col("seeds")).alias("base"), F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("added"))
