"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation's rows are kept, given another role, deleted, or get rows inserted, at least cost, so that the
roles read ``(s?(ua)+)?``. The states are what was emitted last: nothing, system, user or assistant. The cost to go
from each state is a vector; a row maps the vector behind it to the one before it.

Conversations are cut into chunks of neighbouring rows, so that no task holds a long one. Every chunk starts from a
speculative vector, that of a conversation's end. A fix-up pass hands each chunk the vector of the chunk behind it
and reruns those whose start was another, until the old and the new vector differ only by a constant, from where on
the old result holds. Mostly one pass is enough. Some runs of rows keep every difference between vectors (rows that
are all deleted, say), and hand it on one chunk a pass; chunks that are unsettled after ``FIXUPS`` passes are
composed as maps of vectors instead, with twice the reach in every step.

Up to a constant there are only some dozen vectors, as no two states' costs differ by more than a few edits. So
a step is a look-up. Tracing goes forward: the stitched costs tell the least next edit in each state, each chunk is a
map of its four starting states, and these maps are composed in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from signalspark.llm.common import query, stored, table

CHUNK_ROWS = 4096
FIXUPS = 6
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: State behind a kept row, by state and by the place of the row's initial in "sua".
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: The one user or assistant row that may come next in each state.
FORCED = (USER, USER, ASSISTANT, USER)
EMITS = {USER: "u", ASSISTANT: "a"}
FINE, DELETED, CUT = range(3)
NEVER = 1 << 20


def _closed(costs: list[int]) -> tuple[int, ...]:
    """The vector once rows may be inserted in front of it; least costs are found in two rounds."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[FORCED[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _edits(behind: tuple[int, ...], initial: int, fault: int) -> list[list[tuple[str, int, int]]]:
    """Edits of one row in each state, in ASCII order: letter, cost with all that follows, next state."""
    extra, options = TRUNCATED * (fault == CUT), []
    for q in range(4):
        own = [("D", DELETE + behind[q], q)]
        if fault != DELETED and (q, initial) in KEPT:
            own.append(("K", extra + behind[KEPT[q, initial]], KEPT[q, initial]))
        if fault != DELETED:
            own.append(("R", extra + REROLE + behind[FORCED[q]], FORCED[q]))
        options.append(own)
    return options


def _trace(options: list, costs: tuple[int, ...], q: int) -> tuple[str, str, int]:
    """Least letters for one row from state q, the roles they emit, and the state behind it."""
    letters, roles = "", ""
    while True:
        for letter, cost, to in sorted([*options[q], ("I", INSERT + costs[FORCED[q]], FORCED[q])]):
            if cost == costs[q]:
                break
        letters += letter
        roles += EMITS[to] if letter in "IR" else "-"
        q = to
        if letter != "I":
            return letters, roles, q


class Machine:
    """All vectors up to a constant, reached from a conversation's end, and the step of each row symbol on them.

    A symbol is initial * 3 + fault. ``to[v][x]`` is the vector in front of the row, ``cost[v][x]`` the constant that
    is split off, ``moves[v][x][q]`` the traced letters, roles and next state.
    """

    def __init__(self):
        ending = _closed([0, NEVER, NEVER, 0])
        self.vectors, self.to, self.cost, self.moves = [ending], [], [], []
        for behind in self.vectors:
            to, cost, moves = [], [], []
            for symbol in range(12):
                options = _edits(behind, *divmod(symbol, 3))
                costs = _closed([min(c for _, c, _ in own) for own in options])
                least = min(costs)
                vector = tuple(c - least for c in costs)
                if vector not in self.vectors:
                    self.vectors.append(vector)
                to.append(self.vectors.index(vector))
                cost.append(least)
                moves.append([_trace(options, costs, q) for q in range(4)])
            self.to.append(to)
            self.cost.append(cost)
            self.moves.append(moves)

    def back(self, symbols: bytes, vector: int) -> tuple[int, int]:
        """Vector in front of all rows, and the constant."""
        total = 0
        for x in reversed(symbols):
            total += self.cost[vector][x]
            vector = self.to[vector][x]
        return vector, total

    def fixed(self, symbols: bytes, old: int, new: int, front: int, total: int) -> tuple[int, int]:
        """``back`` from another vector, stopped where both differ only by a constant."""
        change = 0
        for x in reversed(symbols):
            if old == new:
                return front, total + change
            change += self.cost[new][x] - self.cost[old][x]
            old, new = self.to[old][x], self.to[new][x]
        return new, total + change

    def trace(self, symbols: bytes, vector: int, q: int) -> tuple[list[tuple[str, str]], int]:
        """Letters and roles of each row from state q, and the last state."""
        behind = []
        for x in reversed(symbols):
            behind.append(vector)
            vector = self.to[vector][x]
        out = []
        for x in symbols:
            letters, roles, q = self.moves[behind.pop()][x][q]
            out.append((letters, roles))
        return out, q


MACHINE = Machine()
#: What is inserted at a conversation's end in each state.
TAIL = {START: ("", ""), SYSTEM: ("II", "ua"), USER: ("I", "a"), ASSISTANT: ("", "")}

RESULT = T.StructType([T.StructField("front", T.IntegerType()), T.StructField("cost", T.LongType())])


def _structs(rows: list[tuple], **kinds) -> pa.Array:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


@arrow_udf(RESULT)
def speculated(symbols: pa.Array, vector: pa.Array) -> pa.Array:
    rows = [MACHINE.back(s.as_py(), v.as_py()) for s, v in zip(symbols, vector, strict=True)]
    return _structs(rows, front=pa.int32(), cost=pa.int64())


@arrow_udf(RESULT)
def fixed_up(symbols: pa.Array, old: pa.Array, new: pa.Array, front: pa.Array, cost: pa.Array) -> pa.Array:
    columns = [c.to_pylist() for c in (symbols, old, new, front, cost)]
    return _structs([MACHINE.fixed(*row) for row in zip(*columns, strict=True)], front=pa.int32(), cost=pa.int64())


@arrow_udf(T.ArrayType(T.IntegerType()))
def vector_map(symbols: pa.Array) -> pa.Array:
    """For every vector behind the chunk the one in front of it."""
    known = range(len(MACHINE.vectors))
    return pa.array([[MACHINE.back(s, v)[0] for v in known] for s in symbols.to_pylist()], pa.list_(pa.int32()))


@arrow_udf(T.ArrayType(T.IntegerType()))
def state_map(symbols: pa.Array, vector: pa.Array) -> pa.Array:
    """For every state in front of the chunk the one behind it."""
    pairs = zip(symbols.to_pylist(), vector.to_pylist(), strict=True)
    return pa.array([[MACHINE.trace(s, v, q)[1] for q in range(4)] for s, v in pairs], pa.list_(pa.int32()))


@arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("letters", "roles")])))
def traced(symbols: pa.Array, vector: pa.Array, state: pa.Array, last: pa.Array) -> pa.Array:
    """Each row's edits; what is inserted at a conversation's end goes with the last row."""
    out = []
    for s, v, q, at_end in zip(*(c.to_pylist() for c in (symbols, vector, state, last)), strict=True):
        rows, q = MACHINE.trace(s, v, q)
        if at_end:
            rows[-1] = (rows[-1][0] + TAIL[q][0], rows[-1][1] + TAIL[q][1])
        out.append([{"letters": a, "roles": b} for a, b in rows])
    return pa.array(out, pa.list_(pa.struct([("letters", pa.string()), ("roles", pa.string())])))


def _neighbour(chunks: DataFrame, distance: int, column: str) -> DataFrame:
    """``chunks`` with ``_other``: ``column`` of the conversation's chunk so many places on, or null."""
    other = chunks.select(F.col("conv").alias("_conv"), (F.col("chunk") - distance).alias("_chunk"), F.col(column).alias("_other"))
    same = chunks["conv"].eqNullSafe(other["_conv"]) & (chunks["chunk"] == other["_chunk"])
    return chunks.join(other, same, "left").drop("_conv", "_chunk")


def _composed(chunks: DataFrame, column: str, direction: int, longest: int) -> DataFrame:
    """``column``, a map as an array, applied after those of all chunks on that side, by doubling."""
    reach = 1
    while reach <= longest:
        own = F.coalesce(F.transform("_other", lambda y: F.col(column)[y]), F.col(column))
        chunks = stored(_neighbour(chunks, direction * reach, column).withColumn(column, own).drop("_other"), "composed")
        reach *= 2
    return chunks


def settled(chunks: DataFrame, longest: int, fixups: int = FIXUPS) -> DataFrame:
    """(conv, chunk, symbols) with ``vector`` behind each chunk, ``front`` before it and ``cost``, as if run at once."""
    done = chunks.withColumn("vector", F.lit(0)).withColumn("_s", speculated("symbols", "vector"))
    done = stored(done.select(*chunks.columns, "vector", "_s.front", "_s.cost"), "speculated")
    for turn in range(fixups + 1):
        met = _neighbour(done, 1, "front").withColumn("_other", F.coalesce("_other", F.lit(0)))
        if met.where("_other <> vector").isEmpty():
            return done
        if turn < fixups:
            again = fixed_up("symbols", "vector", "_other", "front", "cost")
            result = met.withColumn("_s", F.when(F.col("_other") != F.col("vector"), again).otherwise(F.struct("front", "cost")))
            columns = [F.col("_other").alias("vector"), F.col("_s.front").alias("front"), F.col("_s.cost").alias("cost")]
            done = stored(result.select(*chunks.columns, *columns), "fixed-up")
    # A run of chunks that hands a difference on: maps of all vectors, composed from the right.
    maps = _composed(stored(chunks.withColumn("map", vector_map("symbols")), "vector-maps"), "map", 1, longest)
    fronts = maps.withColumn("front", F.col("map")[0]).drop("map")
    behind = _neighbour(fronts, 1, "front").withColumn("vector", F.coalesce("_other", F.lit(0))).drop("_other", "front")
    last = behind.withColumn("_s", speculated("symbols", "vector")).select(*chunks.columns, "vector", "_s.front", "_s.cost")
    return stored(last, "settled")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of ``conversations`` with null roles and texts as one space, and the set damage.

    By crc32 of ``conv_id:turn`` (null: one space) modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key) % 20
    changed = rows.select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return changed.select("conv", "turn", "role", "text", F.explode(F.expr("array_repeat(0, copies)")).alias("_")).drop("_")


def placed_rows(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) in order, with ``at``: 0, 1, 2, ... over all rows.

    By conversation, turn (null first), role and text; only equal rows are in no set order. Sorted ranges are
    written, numbered, and shifted by the sizes of the ranges before them, so a long conversation, or one row repeated
    without end, spreads over many tasks.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = ["conv", "turn", "role", "text", "_row"]
    ordered = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    ordered = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("_at", 33)
    # One row per task of the sort.
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets")
    placed = ordered.withColumn("_part", part).join(offsets, "_part")
    at = F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.select("conv", "turn", "role", "text", at.alias("at"))


@dataclass(frozen=True)
class Repair:
    """``edits``: each row with its faults and edits. ``conversations``: counts and cost of each."""

    edits: DataFrame
    conversations: DataFrame

    def rows(self) -> DataFrame:
        """(conv, at, seq, edit, role, text): the repaired rows; inserted ones have an empty text."""
        letter = F.explode(F.expr("filter(transform(sequence(1, length(letters)), k -> struct(k as seq, substr(letters, k, 1) as edit, substr(roles, k, 1) as new)), e -> e.edit <> 'D')"))
        one = self.edits.select("conv", "at", "role", "text", letter.alias("e"))
        named = F.when(F.col("e.new") == "-", F.col("role")).when(F.col("e.new") == "u", ROLES["u"]).otherwise(ROLES["a"])
        text = F.when(F.col("e.edit") == "I", "").otherwise(F.col("text"))
        return one.select("conv", "at", "e.seq", "e.edit", named.alias("role"), text.alias("text"))


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, fixups: int = FIXUPS) -> Repair:
    """Least-cost repair of all conversations in ``rows`` (conv, turn, role, text).

    A null conv is a conversation of its own. Null roles and texts count as one space, null turns come first and are
    left out of ``gaps``. Rows of one turn go by role and text; a repeated row is a duplicate. Roles without a known
    initial are given another or deleted. Texts of any length are whole; conversations of any length are cut. Other
    columns are dropped; an empty table has no conversations.
    """
    space = F.lit(" ")
    rows = rows.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    placed = stored(placed_rows(rows), "placed-turns")
    ending = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    narrow = placed.select(
        "conv", "turn", "at", (F.col("at") / chunk_rows).cast("long").alias("chunk"), blank.alias("blank"),
        (~blank & ~ending.isin(".", "!", "?")).alias("cut"),
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1).otherwise(3).alias("initial"),
    )
    # The earliest row of each role and text, by its place, which no two rows share: joining on it is even.
    first = placed.where(~blank).groupBy("conv", "role", F.sha2("text", 256).alias("text")).agg(F.min("at").alias("at"))
    seen = narrow.join(first.select("at", F.lit(True).alias("_first")), "at", "left")
    seen = seen.withColumn("duplicate", ~F.col("blank") & F.col("_first").isNull()).withColumn("cut", F.col("cut") & ~F.col("duplicate"))
    fault = F.when(F.col("blank") | F.col("duplicate"), DELETED).when(F.col("cut"), CUT).otherwise(FINE)
    seen = stored(seen.drop("_first").withColumn("symbol", F.col("initial") * 3 + fault), "faults")
    # At most chunk_rows rows meet in a group.
    pieces = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    chunks = seen.groupBy("conv", "chunk").agg(pieces.alias("rows"), F.min("at").alias("at"))
    symbols = F.unhex(F.array_join(F.transform("rows", lambda r: F.lpad(F.hex(r["symbol"]), 2, "0")), ""))
    chunks = stored(chunks.select("conv", "chunk", "at", symbols.alias("symbols")), "chunks")
    spans = chunks.groupBy("conv").agg((F.max("chunk") - F.min("chunk")).alias("n"))
    longest = spans.agg(F.max("n")).first()[0] or 0
    done = settled(chunks, longest, fixups)
    states = _composed(done.withColumn("map", state_map("symbols", "vector")), "map", -1, longest)
    states = states.withColumn("ends", F.col("map")[START])
    states = _neighbour(states, -1, "ends").withColumn("state", F.coalesce("_other", F.lit(START))).drop("_other", "ends", "map")
    # The chunk behind is asked for its first symbol: without one this is the last chunk.
    byte = lambda c, k: F.conv(F.hex(F.substring(c, k, 1)), 16, 10).cast("int")
    states = states.withColumn("opens", byte("symbols", 1)).withColumn("closes", byte("symbols", -1))
    states = stored(_neighbour(states, 1, "opens"), "states")
    rows_of = traced("symbols", "vector", "state", F.col("_other").isNull())
    each = states.select("at", F.posexplode(rows_of).alias("k", "e")).select((F.col("at") + F.col("k")).alias("at"), "e.*")
    edits = stored(placed.join(each, "at"), "edits")
    legal = lambda a, b: F.struct(F.floor(a / 3).cast("int"), F.floor(b / 3).cast("int")).isin(
        *[F.struct(F.lit(x), F.lit(y)) for x, y in ((0, 1), (1, 2), (2, 1))]
    )
    inner = _illegal_pairs("symbols")
    border = (F.col("_other").isNotNull() & ~legal(F.col("closes"), F.col("_other"))).cast("long")
    opening = F.element_at(F.array(*[F.array(*map(F.lit, v)) for v in MACHINE.vectors]), F.col("front") + 1)[START]
    costs = states.groupBy("conv").agg(
        F.sum(F.col("cost")).alias("_cost"), F.sum(inner + F.coalesce(border, F.lit(0))).alias("illegal"),
        F.min_by(opening, F.col("chunk")).alias("_opening"),
    ).select("conv", (F.col("_cost") + F.col("_opening")).alias("cost"), "illegal")
    counts = seen.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(kind).alias(kind) for kind in ("blank", "duplicate")],
        F.count_if("cut").alias("truncated"),
    )
    both = counts.join(costs.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    return Repair(edits, both)


@arrow_udf(T.LongType())
def _illegal_pairs(symbols: pa.Array) -> pa.Array:
    """Neighbours whose initials are not su, ua or au."""
    fine = {(0, 1), (1, 2), (2, 1)}
    return pa.array([sum((a // 3, b // 3) not in fine for a, b in zip(s, s[1:], strict=False)) for s in symbols.to_pylist()], pa.int64())


def digests(edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of each conversation, from its rows in order.

    A hash of a whole conversation takes its bytes one after another, so each is streamed through one task, which
    holds a batch of rows and the letters so far.
    """
    kind = edits.schema["conv"].dataType.simpleString()
    rows = edits.select("conv", "at", "role", "text", "letters", "roles")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, letters, digest, lines, convs = None, False, [], None, 0, None

        def told():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], convs), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])],
                names=["conv", "audit", "repaired_sha256"],
            )

        for batch in batches:
            convs = batch.schema.field(0).type
            conv, _, role, text, own, new = (c.to_pylist() for c in batch.columns)
            for i, key in enumerate(conv):
                if not begun or key != now:
                    if begun:
                        yield told()
                    now, begun, letters, digest, lines = key, True, [], hashlib.sha256(), 0
                letters.append(own[i])
                for edit, to in zip(own[i], new[i], strict=True):
                    if edit == "D":
                        continue
                    named = role[i] if to == "-" else ROLES[to]
                    line = f"{named}:{'' if edit == 'I' else text[i]}"
                    digest.update(("\n" * (lines > 0) + line).encode())
                    lines += 1
        if begun:
            yield told()

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "at")
    return ordered.mapInArrow(streamed, f"conv {kind}, audit string, repaired_sha256 string")


def _found(column: str, none: Column) -> Column:
    return F.coalesce(F.col(column), none).alias(column)


def _sql_option(letter: str, cost: str, to: str, line: str | None, when: str = "true") -> str:
    rows = f"{to}.r" if line is None else f"list_prepend({line}, {to}.r)"
    return f"CASE WHEN {when} THEN {{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'r': {rows}}} END"


def _sql_row(q: int) -> str:
    """Least edit of one row in state q, as (cost, letters, rows) with all that follows."""
    kept = [f"'{'sua'[k]}' THEN s{to}" for (state, k), to in KEPT.items() if state == q]
    to = f"(CASE initial WHEN {' WHEN '.join(kept)} END)"
    forced = ROLES[EMITS[FORCED[q]]]
    options = [
        _sql_option("D", f"{DELETE}", f"s{q}", None),
        _sql_option("K", f"CASE WHEN cut THEN {TRUNCATED} ELSE 0 END", to, "role || ':' || text", f"NOT gone AND {to} IS NOT NULL"),
        _sql_option("R", f"{REROLE} + CASE WHEN cut THEN {TRUNCATED} ELSE 0 END", f"s{FORCED[q]}", f"'{forced}:' || text", "NOT gone"),
    ]
    return f"list_min([{', '.join(options)}]) AS t{q}"


def _sql_inserted(q: int, own: str, to: str) -> str:
    return f"list_min([{own}, {_sql_option('I', str(INSERT), to, repr(ROLES[EMITS[FORCED[q]]] + ':'))}])"


#: The least (cost, letters) of every state, row by row from each conversation's end. CRC32 by its table of 256
#: remainders, which a rule gives.
OP12_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t
  FROM range(256) r(n)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: unicode(x)::BIGINT) AS key
  FROM conversations),
kinds AS (
  SELECT * EXCLUDE (t), xor(4294967295, list_reduce([4294967295] || key,
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM kinds),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') AS ending FROM damaged),
seen AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate FROM placed),
faults AS (SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND ending AS cut FROM seen),
back(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT conv_id, max(n) + 1, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}},
    {{'c': 6::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']}}, {{'c': 3::BIGINT, 'a': 'I', 'r': ['assistant:']}},
    {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} FROM faults GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, {_sql_inserted(0, "t0", "u")}, {_sql_inserted(1, "t1", "u")}, u, {_sql_inserted(3, "t3", "t2")}
  FROM (SELECT *, {_sql_inserted(2, "t2", "t3")} AS u FROM (
    SELECT f.conv_id, f.pos, {", ".join(_sql_row(q) for q in range(4))}
    FROM back JOIN faults f ON f.conv_id IS NOT DISTINCT FROM back.conv_id AND f.pos = back.pos - 1))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(duplicate) AS duplicate, count_if(cut) AS truncated FROM faults GROUP BY conv_id),
pairs AS (
  SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS p FROM faults),
wrong AS (SELECT conv_id, count_if(p NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit,
  sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN wrong w ON w.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.pos = 1
"""


@query(OP12_SQL)
def op12_viterbi_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    mended = repair(damaged(rows))
    digest = stored(digests(mended.edits), "digests").withColumnRenamed("conv", "_conv")
    known = mended.conversations.join(digest, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    every = rows.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(known, every["conv_id"].eqNullSafe(known["conv"]), "left").select(
        "conv_id", *[_found(c, F.lit(0).cast("long")) for c in counts],
        _found("audit", F.lit("")), _found("repaired_sha256", F.sha2(F.lit(""), 256)),
    )
