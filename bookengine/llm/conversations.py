"""Conversation structure repair by divide and conquer over four-state cost vectors.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles, so that a prefix of it is in one of four states:
nothing yet, behind s, behind u, behind a. Each row is kept (0), given the role that fits (2) or deleted (3; blank and
repeated rows must be), empty rows may be inserted (2), and a truncated row that stays costs 1. What a row does is a
*link*: for each pair of states the least cost, and for each state in front the order of the edits' letters.
Links of consecutive rows compose into a link, which is 16 costs and 16 ranks whatever its length.

The cheapest edits are found as Hirschberg does: a vector of costs from the front and one from the end meet in
the middle, the state there is chosen by least sum and then by the front's rank, and both halves follow. Memory is
linear in the rows. The first cuts are the borders of blocks of at most ``BLOCK_ROWS`` rows: blocks give their links, the
states at their borders are chosen over these, and blocks are then solved on their own, so that a conversation of any
length is many tasks. Where it has more than ``FAN`` blocks, blocks form larger ones first, on as many levels as it takes.

Rows are sorted once, by range, and written with a number that follows that order; everything else reads this table.
The last step alone takes a conversation through one task, row by row, since a digest of it is defined on its whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookengine.llm.columns import byte_slices
from bookengine.llm.store import materialize, scratch

#: Rows of a block at most.
BLOCK_ROWS = 4096
#: Blocks whose border states are chosen in one step.
FAN = 4096
#: Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

START, S, U, A = range(4)
INF = 1 << 60
#: What may follow each state, by initial; an inserted or rerolled row is the u or a among them.
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
#: Inserts that bring each state to an allowed end.
TAIL = {START: "", S: "II", U: "I", A: ""}

Link = tuple[tuple[int, ...], tuple[int, ...]]


def _made(state: int) -> tuple[str, int]:
    """The initial of a row inserted or rerolled in a state, and the state behind it."""
    return next((c, q) for c, q in NEXT[state].items() if c != "s")


def _row_edits(must_delete: bool, initial: str, truncated: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(state in front, state behind) -> (cost, letters): the cheapest, then ASCII-least, inserts before a row and its own edit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for front in range(4):
        state = front
        for inserts in range(3):
            options = [(DELETE, "D", state)]
            if not must_delete:
                extra = TRUNCATED if truncated else 0
                options.append((REROLE + extra, "R", _made(state)[1]))
                if initial in NEXT[state]:
                    options.append((KEEP + extra, "K", NEXT[state][initial]))
            for cost, letter, behind in options:
                found = (cost + INSERT * inserts, "I" * inserts + letter)
                best[front, behind] = min(found, best.get((front, behind), found))
            state = _made(state)[1]
    return best


def _link(edits: dict[tuple[int, int], tuple[int, str]]) -> Link:
    costs, ranks = [INF] * 16, [0] * 16
    for front in range(4):
        order = sorted((edits[front, q][1], q) for q in range(4) if (front, q) in edits)
        for rank, (_, q) in enumerate(order):
            costs[4 * front + q], ranks[4 * front + q] = edits[front, q][0], rank
    return tuple(costs), tuple(ranks)


#: Kinds of rows by their letter: x must go; o, s, u, a by initial, capital if truncated.
EDITS = {"x": _row_edits(True, "", False)} | {(c.upper() if cut else c): _row_edits(False, c, cut) for c in "osua" for cut in (False, True)}
LINKS = {kind: _link(edits) for kind, edits in EDITS.items()}


def forward(links: list[Link], state: int) -> Link:
    """Costs of the states behind ``links`` from one state in front, and the order of the letters that lead there.

    Letters of different states never begin with each other, as all hold the same number of rows' own edits and end with one.
    """
    cost, rank = [INF] * 4, [0] * 4
    cost[state] = 0
    for costs, ranks in links:
        new, key = [INF] * 4, [0] * 4
        for q in range(4):
            least, by = INF, 0
            for p in range(4):
                c = cost[p] + costs[4 * p + q]
                if c < least or (c == least < INF and rank[p] < rank[by]):
                    least, by = c, p
            new[q], key[q] = least, 4 * rank[by] + ranks[4 * by + q]
        order = sorted(k for q, k in enumerate(key) if new[q] < INF)
        cost, rank = new, [order.index(k) if new[q] < INF else 0 for q, k in enumerate(key)]
    return tuple(cost), tuple(rank)


def backward(links: list[Link], state: int) -> list[int]:
    """Costs from each state in front of ``links`` to one state behind them."""
    cost = [INF] * 4
    cost[state] = 0
    for costs, _ in reversed(links):
        cost = [min(min(costs[4 * p + q] + cost[q] for q in range(4)), INF) for p in range(4)]
    return cost


def compose(links: list[Link]) -> Link:
    """The link of consecutive links."""
    rows = [forward(links, p) for p in range(4)]
    return tuple(min(c, INF) for r in rows for c in r[0]), tuple(x for r in rows for x in r[1])


def crossings(links: list[Link], front: int, behind: int) -> list[int]:
    """States at all borders of ``links``, both ends included, on the cheapest and then ASCII-least way."""
    states = [front] * len(links) + [behind]
    open_parts = [(0, len(links))]
    while open_parts:
        lo, hi = open_parts.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        cost, rank = forward(links[lo:mid], states[lo])
        rest = backward(links[mid:hi], states[hi])
        states[mid] = min(range(4), key=lambda x: (cost[x] + rest[x], rank[x]))  # noqa: B023
        # the right part waits, so that at most log2(n) parts are open
        open_parts += [(mid, hi), (lo, mid)]
    return states


def last_state(links: list[Link], front: int = START) -> int:
    """The state behind all rows that leaves the cheapest, then ASCII-least, way to an allowed end."""
    cost, rank = forward(links, front)
    return min(range(4), key=lambda x: (cost[x] + INSERT * len(TAIL[x]), rank[x]))


@lru_cache(maxsize=50_000)
def _short(kinds: str, front: int, behind: int) -> tuple[int, str]:
    states = crossings([LINKS[k] for k in kinds], front, behind)
    found = [EDITS[k][p, q] for k, p, q in zip(kinds, states[:-1], states[1:], strict=True)]
    return sum(c for c, _ in found), ",".join(e for _, e in found)


def solve(kinds: str, front: int, behind: int) -> tuple[int, str]:
    """Cost and comma-joined edits of a block's rows between two states. Short blocks are remembered, as most look alike."""
    return _short(kinds, front, behind) if len(kinds) <= 32 else _short.__wrapped__(kinds, front, behind)


@lru_cache(maxsize=50_000)
def _short_link(kinds: str) -> Link:
    return compose([LINKS[k] for k in kinds])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_short_link(k) if len(k) <= 32 else _short_link.__wrapped__(k) for k in batch.column("kinds").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], [*batch.schema.names, "costs", "ranks"])


def _links_of(parts: list[dict]) -> list[Link]:
    return [(tuple(p["costs"]), tuple(p["ranks"])) for p in parts]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of larger blocks, in place of the last column, the links of their parts in order."""
    for batch in batches:
        found = [compose(_links_of(parts)) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], [*batch.schema.names[:-1], "costs", "ranks"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States in front of and behind each part of a conversation or larger block, in place of the parts. Without given states: from nothing to an allowed end."""
    for batch in batches:
        out = []
        for front, behind, parts in zip(batch.column("front").to_pylist(), batch.column("behind").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            links = _links_of(parts)
            front = START if front is None else front
            states = crossings(links, front, last_state(links, front) if behind is None else behind)
            out.append([{"block": p["block"], "front": a, "behind": b} for p, a, b in zip(parts, states[:-1], states[1:], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(out, pa.list_(pa.struct({"block": pa.int64(), "front": pa.int32(), "behind": pa.int32()})))], ["conv", "parts"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve(k, a, b) for k, a, b in zip(batch.column("kinds").to_pylist(), batch.column("front").to_pylist(), batch.column("behind").to_pylist(), strict=True)]
        names = ["conv", "rid", "blank", "duplicate", "truncated"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], [*names, "cost", "edits"])


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of damaged conversations: by ``crc32(conv_id:turn) % 20`` a row is dropped (0), emptied (1), loses its ``[.!?]`` (2), is repeated (3) or becomes the user's (4). Nulls count as one space, but for turns in their order."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    draw = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    drawn = rows.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copies"))
    return drawn.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows under numbers (rid) that follow conversation, turn (nulls first), role and digest, with what their faults depend on; written once."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    trimmed = F.rtrim(text, F.lit(WHITE))
    plain = rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), (trimmed == "").alias("is_blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("is_truncated"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("salt")]
    # the salt deals equal rows of one turn to many tasks; they can be told apart by nothing else
    return materialize(plain.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("rid", F.monotonically_increasing_id()), "conversation_rows")


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of numbered rows: conv, block, rid (first), kinds, counts of faults, costs and ranks."""
    slim = rows.select("conv", "rid", "role", "digest", "is_blank", "is_truncated")
    repeated = slim.where("NOT is_blank").groupBy("conv", "role", "digest").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    r = repeated.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    found = slim.join(r, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    repeat = ~F.col("is_blank") & F.coalesce(F.col("rid") > F.col("first"), F.lit(False))
    cut = ~F.col("is_blank") & ~repeat & F.col("is_truncated")
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(F.col("is_blank") | repeat, "x").when(cut, F.upper(letter)).otherwise(letter)
    one = lambda c: F.count_if(c)
    grouped = found.select("conv", "rid", F.expr(f"rid div {block_rows}").alias("block"), kind.alias("kind"), "is_blank", repeat.alias("is_repeat"), cut.alias("is_cut")).groupBy("conv", "block")
    blocks = grouped.agg(F.min("rid").alias("rid"), F.array_sort(F.collect_list(F.struct("rid", "kind"))).alias("rows"), one(F.col("is_blank")).alias("blank"), one(F.col("is_repeat")).alias("duplicate"), one(F.col("is_cut")).alias("truncated"))
    text = blocks.select("conv", "block", "rid", F.array_join(F.transform("rows", lambda x: x["kind"]), "").alias("kinds"), "blank", "duplicate", "truncated")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text.schema)
    return text.mapInArrow(_block_links, f"{schema}, costs array<long>, ranks array<int>")


def _with_states(blocks: DataFrame, fan: int) -> DataFrame:
    """conv, block, front, behind of every block: states are chosen for the largest blocks first, then inside these."""
    kind = blocks.schema["conv"].dataType.simpleString()
    parts = lambda level, *keys: level.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "costs", "ranks"))).alias("parts"))
    levels = [blocks.select("conv", "block", "costs", "ranks")]
    while (levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > fan:
        larger = parts(levels[-1].withColumn("larger", F.expr(f"block div {fan}")), "conv", "larger").withColumnRenamed("larger", "block")
        levels.append(materialize(larger.mapInArrow(_merge, f"conv {kind}, block long, costs array<long>, ranks array<int>"), "larger_blocks"))
    chosen = f"conv {kind}, parts array<struct<block: long, front: int, behind: int>>"
    opened = lambda grouped: grouped.mapInArrow(_choose, chosen).select("conv", F.inline("parts"))
    none = F.lit(None).cast("int")
    states = opened(parts(levels[-1], "conv").select("conv", none.alias("front"), none.alias("behind"), "parts"))
    for level in reversed(levels[:-1]):
        below = parts(level.withColumn("larger", F.expr(f"block div {fan}")), "conv", "larger")
        above = states.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "front", "behind")
        states = opened(below.join(above, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("larger") == F.col("_block"))).select("conv", "front", "behind", "parts"))
    return states


def _stream(rows: DataFrame, fan: int, block_rows: int, keep) -> DataFrame:
    """Every conversation's id, then each block's edits in front of its rows: conversations whole in a partition and in order, one record at a time."""
    ordered = _ordered(rows)
    keep(ordered)
    blocks = materialize(_blocks(ordered, block_rows), "conversation_blocks")
    states = _with_states(blocks, fan).select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "front", "behind")
    kind = ordered.schema["conv"].dataType.simpleString()
    fields = f"conv {kind}, rid long, blank long, duplicate long, truncated long, cost long, edits string"
    solved = materialize(blocks.join(states, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).mapInArrow(_solve, fields), "conversation_edits")
    keep(solved)
    marks = solved.withColumns({"place": F.lit(0), "text": F.lit("")})
    said = ordered.select("conv", "rid", "turn", "role", "text", F.lit(1).alias("place"))
    return marks.unionByName(said, allowMissingColumns=True)


def _in_order(records: DataFrame, ids: DataFrame) -> DataFrame:
    every = ids.select(F.col("conv_id").alias("conv")).distinct().withColumns({"rid": F.lit(-1).cast("long"), "place": F.lit(0), "text": F.lit("")})
    whole = records.unionByName(every, allowMissingColumns=True)
    names = ["conv", "rid", "place", "turn", "role", "text", "edits", "blank", "duplicate", "truncated", "cost"]
    return whole.select(*names).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "rid", "place")


class _Walk:
    """A conversation as its records pass."""

    def __init__(self) -> None:
        self.state, self.edits, self.at = START, [], 0
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "cost"), 0)
        self.illegal, self.previous = 0, None
        self.least = self.most = None
        self.turns = 0
        self.audit: list[str] = []

    def begin(self, record: dict) -> None:
        if record["edits"] is not None:
            self.edits, self.at = record["edits"].split(","), 0
            for name in self.sums:
                self.sums[name] += record[name]

    def made(self) -> str:
        initial, self.state = _made(self.state)
        return ROLE[initial]

    def row(self, turn, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what a row becomes."""
        edits, self.at = self.edits[self.at], self.at + 1
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial = role[:1]
        self.illegal += self.previous is not None and self.previous + initial not in LEGAL
        self.previous = initial
        self.audit.append(edits)
        for letter in edits:
            if letter == "I":
                yield letter, self.made(), ""
            elif letter == "R":
                yield letter, self.made(), text
            elif letter == "K":
                self.state = NEXT[self.state][initial]
                yield letter, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        tail = TAIL[self.state]
        self.audit.append(tail)
        self.sums["cost"] += INSERT * len(tail)
        for letter in tail:
            yield letter, self.made(), ""

    @property
    def gaps(self) -> int:
        return int(self.most - self.least) + 1 - self.turns if self.turns else 0


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, _Walk, list[tuple[str, str, str]], bool]]:
    """(conversation, its walk, what has come out since, whether it is over), record by record."""
    walk, conv, some = None, None, False
    for batch in byte_slices(batches, "text", 1 << 20):
        for record in batch.to_pylist():
            if not some or record["conv"] != conv:
                if some:
                    yield conv, walk, list(walk.end()), True
                walk, conv, some = _Walk(), record["conv"], True
            if record["place"] == 0:
                walk.begin(record)
            else:
                yield conv, walk, list(walk.row(record["turn"], record["role"], record["text"])), False
    if some:
        yield conv, walk, list(walk.end()), True


def _reports(kind: pa.DataType):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = pa.schema([("conv_id", kind), *((n, pa.int64()) for n in names[1:7]), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first, out = hashlib.sha256(), True, []
        for conv, walk, messages, over in _walks(batches):
            for _, role, text in messages:
                digest.update(("" if first else "\n").encode() + role.encode() + b":" + text.encode())
                first = False
            if over:
                s = walk.sums
                out.append((conv, walk.gaps, s["blank"], s["duplicate"], s["truncated"], walk.illegal, s["cost"], "".join(walk.audit), digest.hexdigest()))
                digest, first = hashlib.sha256(), True
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    return report


def _messages(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = 0, []
        for conv, _, messages, over in _walks(batches):
            for edit, role, text in messages:
                out.append((conv, place, edit, role, text))
                place += 1
            place = 0 if over else place
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return rows


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def repair_report(rows: DataFrame, ids: DataFrame | None = None, fan: int = FAN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each conversation of ``ids`` (by default of ``rows``): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows need conv_id, turn (a whole number), role, text; other columns are not looked at. A null conv_id is a conversation of
    its own, a null role or text counts as one space, null turns come first and count for no gap. Rows of one turn go by role,
    then by the SHA-256 of their text; equal rows are repeats of the first. Roles of other initials than s, u and a, empty ones
    included, can't be kept. A conversation without rows has zeros, an empty audit and the empty string's digest. Empty
    tables: empty result. Very long texts pass one at a time; a conversation of any length is blocks, see above.
    """
    ids = rows if ids is None else ids
    with scratch(rows.sparkSession) as keep:
        records = _stream(rows, fan, block_rows, keep)
    kind = rows.schema["conv_id"].dataType
    fields = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _in_order(records, ids).mapInArrow(_reports(_arrow_type(rows, "conv_id")), fields)


def repaired_messages(rows: DataFrame, fan: int = FAN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text. Cases as in ``repair_report``."""
    with scratch(rows.sparkSession) as keep:
        records = _stream(rows, fan, block_rows, keep)
    kind = rows.schema["conv_id"].dataType
    return _in_order(records, rows).mapInArrow(_messages(_arrow_type(rows, "conv_id")), f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")

