"""Conversation structure repair: cheapest edits that make a conversation alternate, by an auction algorithm for shortest paths.

The lattice of a conversation has a node for every place between its rows and every state of the turn-taking automaton; edits are its arcs, at
integer costs. The auction keeps a price at every node and a path from the origin: the path's last node either raises its price to what its best arc
asks and the path contracts, or the price is already that and the path is extended along the arc. When the path arrives, prices are optimal duals: cheapest
paths are those of tight arcs, along which the least edit string is traced.

Long conversations are cut into pieces of up to ``PIECE`` rows. Pieces meet in 4 x 4 tables of costs from state to state, which are multiplied level by level
(least of sums), as are the states that traces lead to, so that no task holds a conversation's lattice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_copies, small_batches

#: Rows of a piece, as a power of two; nodes of the next level that a node stands for, likewise.
PIECE_BITS, LEVEL_BITS = 6, 10
PIECE = 1 << PIECE_BITS

# Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, system, user (an answer is due), assistant. A conversation may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (0, None, None, 0)
#: Where a state goes with the next role's initial.
STEPS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The initial that rerole and insert can only take in a state.
DUE = {q: next(c for c in "ua" if c in to) for q, to in STEPS.items()}

#: A cost that no path has.
FAR = 1 << 50


def _arcs(symbols: str, exits: tuple[int | None, ...]) -> list[list[tuple[str, int, int]]]:
    """Arcs ``(edit, cost, node)`` of every node ``4 * place + state``, without those to nodes from which no exit can be reached. The last node is the exit.

    A symbol is a row: its role's initial (``o`` for any other), in upper case if the row is truncated, or ``x`` for a row that has to go.
    """
    places = len(symbols)
    last = 4 * (places + 1)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(last + 1)]
    for i in range(places + 1):
        for q in range(4):
            own, due = arcs[4 * i + q], STEPS[q][DUE[q]]
            own.append(("I", INSERT, 4 * i + due))
            if i == places:
                if exits[q] is not None:
                    own.append(("", exits[q], last))
                continue
            own.append(("D", DELETE, 4 * (i + 1) + q))
            sign = symbols[i]
            if sign != "x":
                more = TRUNCATED if sign.isupper() else 0
                if sign.lower() in STEPS[q]:
                    own.append(("K", KEEP + more, 4 * (i + 1) + STEPS[q][sign.lower()]))
                own.append(("R", REROLE + more, 4 * (i + 1) + due))
    able = _reaching(arcs, last)
    return [[a for a in own if a[2] in able] for own in arcs]


def _reaching(arcs: list[list[tuple[str, int, int]]], last: int) -> set[int]:
    into: list[list[int]] = [[] for _ in arcs]
    for i, own in enumerate(arcs):
        for _, _, j in own:
            into[j].append(i)
    found, stack = {last}, [last]
    while stack:
        for i in into[stack.pop()]:
            if i not in found:
                found.add(i)
                stack.append(i)
    return found


def auction(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int) -> None:
    """Raise ``price`` until that of ``origin`` is the cost from it to the last node.

    Prices must meet ``price[i] <= cost + price[j]`` on all arcs, as zeros do, and keep doing so: what one origin has learned serves the next.
    """
    path, last = [origin], len(arcs) - 1
    while path[-1] != last:
        i = path[-1]
        best, to = min((cost + price[j], j) for _, cost, j in arcs[i])
        if price[i] < best:
            price[i] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


@lru_cache(maxsize=1 << 14)
def solve(symbols: str, exits: tuple[int | None, ...], starts: tuple[int, ...]) -> tuple[tuple[int | None, str, int], ...]:
    """``cost, edits, state at the end`` of the cheapest path from each of ``starts`` (no cost: there is none), the ASCII-least edits of equals.

    ``exits`` are the costs that each state at the end still has before it. On converged prices an arc is tight if its cost is the difference of its ends' prices; only tight
    arcs from which the exit can be reached along tight arcs are taken.
    """
    arcs = _arcs(symbols, exits)
    last = len(arcs) - 1
    price = [0] * len(arcs)
    able = [q for q in starts if arcs[q]]
    for q in able:
        auction(arcs, price, q)
    tight = [[a for a in own if price[i] == a[1] + price[a[2]]] for i, own in enumerate(arcs)]
    good = _reaching(tight, last)
    out: list[tuple[int | None, str, int]] = []
    for q in starts:
        if q not in able:
            out.append((None, "", q))
            continue
        node, edits = q, []
        while True:
            letter, _, to = min(a for a in tight[node] if a[2] in good)
            if to == last:
                break
            edits.append(letter)
            node = to
        out.append((price[q], "".join(edits), node % 4))
    return tuple(out)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations (conv_id, turn, role, text)`` with planted faults, for trials; nulls of any column are read as one space.

    The remainder of crc32(``conv_id:turn``) by 20 says which: 0 drops the row, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats the row, 4 makes its role user.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), draw.alias("__draw")).where("__draw <> 0")
    text = F.when(F.col("__draw") == 1, "").when(F.col("__draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.sequence(F.lit(1), F.when(F.col("__draw") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("__draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(again).alias("__copy")).drop("__copy")


def _key() -> Column:
    """A conversation's key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def place_rows(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversation and turn: ``conv, conv_id, turn, role, text, at, symbol, fault``.

    ``at`` grows with the order; turns are sorted with nulls first, equal turns by role and text. The order is that of key ranges over all rows, which split a long conversation at
    any turn; repeated rows are told apart by their place in the input. ``fault`` is a row's first: ``blank``, ``duplicate`` (role and text seen earlier), ``truncated`` or null.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(_key().alias("conv"), "conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), F.monotonically_increasing_id().alias("__row"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("__row")]
    marks = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    placed = cut_lineage(
        own.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"), F.md5(F.concat_ws("\n", F.col("conv"), F.hex("role"), F.col("text"))).alias("what"), marks.alias("mark"))
    )
    said = cut_lineage(placed.groupBy("what").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    fault = F.when(F.col("mark") == "", "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("mark").isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    judged = join_copies(placed, said, "what").withColumn("fault", fault)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return judged.select("conv", "conv_id", "turn", "role", "text", "at", symbol.alias("symbol"), "fault")


def _solver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv, piece, symbols, exits`` to the edits and end states from all four states (with exits of one state only: from the first)."""
    kind = pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.string()), ("state", pa.int32())]))
    for batch in batches:
        found = []
        for symbols, exits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            alone = exits is None
            ends = ENDS if alone else tuple(None if x >= FAR else x for x in exits)
            found.append([{"cost": c, "edits": e, "state": s} for c, e, s in solve(symbols, ends, (NOTHING,) if alone else tuple(range(4)))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["conv", "piece", "paths"])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv, piece, symbols`` to the 16 costs from state to state."""
    for batch in batches:
        out = []
        for symbols in batch.column(2).to_pylist():
            costs = [FAR] * 16
            for end in range(4):
                for q, (cost, _, _) in enumerate(solve(symbols, tuple(0 if k == end else None for k in range(4)), tuple(range(4)))):
                    costs[4 * q + end] = FAR if cost is None else cost
            out.append(costs)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv", "node", "costs"])


def _least(values) -> Column:
    return F.least(*values, F.lit(FAR))


def _product(a: Column, b: Column) -> Column:
    return F.array(*[_least([a[4 * q + m] + b[4 * m + r] for m in range(4)]) for q in range(4) for r in range(4)])


def _before(costs: Column, exits: Column) -> Column:
    """Costs that the states ahead of a table have before them, from those behind it."""
    return F.array(*[_least([costs[4 * q + r] + exits[r] for r in range(4)]) for q in range(4)])


def _levels(nodes: DataFrame, value: str, join) -> list[DataFrame]:
    """``conv, node, value`` and its levels above, each node of which joins, in order, what stands under it, until a conversation is one node."""
    levels = [nodes]
    while not levels[-1].groupBy("conv").count().where("count > 1").isEmpty():
        held = F.transform(F.array_sort(F.collect_list(F.struct("node", value))), lambda x: x[value])
        up = levels[-1].groupBy("conv", F.shiftright("node", LEVEL_BITS).alias("node")).agg(held.alias("held"))
        joined = F.aggregate(F.slice("held", 2, F.size("held")), F.element_at("held", 1), join)
        levels.append(cut_lineage(up.select("conv", "node", joined.alias(value))))
    return levels


def _down(levels: list[DataFrame], top: DataFrame, value: str, state: str, step, backward: bool) -> DataFrame:
    """``conv, node, state`` of the lowest level: what ``top (conv, node, state)`` gives, taken through the nodes in order, from the end if ``backward``."""
    own = top
    for level in reversed(levels[:-1]):
        kids = F.array_sort(F.collect_list(F.struct("node", value)))
        held = level.groupBy("conv", F.shiftright("node", LEVEL_BITS).alias("__up")).agg(kids.alias("kids"))
        held = held.join(own.select("conv", F.col("node").alias("__up"), state), ["conv", "__up"])
        seen = F.array(F.struct(F.lit(-1).cast("long").alias("node"), F.col(state).alias("at"), F.col(state).alias("then")))
        walk = F.aggregate(
            F.reverse("kids") if backward else F.col("kids"), seen,
            lambda acc, kid: F.concat(acc, F.array(F.struct(kid["node"].alias("node"), F.element_at(acc, -1)["then"].alias("at"), step(kid[value], F.element_at(acc, -1)["then"]).alias("then")))),
        )
        own = cut_lineage(held.select("conv", F.explode(F.slice(walk, 2, F.size("kids"))).alias("k")).select("conv", F.col("k.node").alias("node"), F.col("k.at").alias(state)))
    return own


def find_edits(placed: DataFrame) -> DataFrame:
    """``conv, piece, start, edits``: the edit string of each piece of each conversation, and the state it starts in. ``placed`` is a written table."""
    pieces = placed.groupBy("conv", F.shiftright("at", PIECE_BITS).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("s"))
    pieces = cut_lineage(pieces.select("conv", "piece", F.array_join(F.transform("s", lambda x: x["symbol"]), "").alias("symbols")))
    many = cut_lineage(pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv"))
    paths = "conv string, piece long, paths array<struct<cost:long,edits:string,state:int>>"
    none = F.lit(None).cast("array<long>").alias("exits")
    alone = pieces.join(many, "conv", "left_anti").select("conv", "piece", "symbols", none).mapInArrow(_solver, paths)
    short = alone.select("conv", "piece", F.lit(NOTHING).alias("start"), F.col("paths")[0]["edits"].alias("edits"))
    if many.isEmpty():
        return cut_lineage(short)
    long = pieces.join(many, "conv", "left_semi")
    tables = _levels(cut_lineage(long.mapInArrow(_tables, "conv string, node long, costs array<long>")), "costs", _product)
    ends = F.array(*[F.lit(FAR if e is None else e).cast("long") for e in ENDS])
    exits = _down(tables, tables[-1].select("conv", "node", ends.alias("exits")), "costs", "exits", _before, backward=True)
    solved = cut_lineage(long.join(exits.withColumnRenamed("node", "piece"), ["conv", "piece"]).select("conv", "piece", "symbols", "exits").mapInArrow(_solver, paths))
    moves = solved.select("conv", F.col("piece").alias("node"), F.transform("paths", lambda p: p["state"]).alias("moves"))
    turns = _levels(moves, "moves", lambda a, b: F.transform(a, lambda q: b[q]))
    starts = _down(turns, turns[-1].select("conv", "node", F.lit(NOTHING).alias("start")), "moves", "start", lambda m, q: m[q], backward=False)
    chosen = solved.join(starts.withColumnRenamed("node", "piece"), ["conv", "piece"])
    return cut_lineage(short.unionByName(chosen.select("conv", "piece", "start", F.col("paths")[F.col("start")]["edits"].alias("edits"))))


REPORT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long, n_repaired long"


def _reporter(kind: pa.DataType):
    """Walks rows sorted by conversation, place and kind: a piece's edits come before its rows. Only counts, a hash and the edits are held."""
    names = [c.split()[0] for c in REPORT.split(", ")]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.int64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, walk = [], None
        for batch in batches:
            for conv, conv_id, turn, role, text, fault, start, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if walk is None or walk.conv != conv:
                    if walk is not None:
                        done.append(walk.report())
                    walk = _Walk(conv, conv_id)
                if edits is not None:
                    walk.piece(start, edits)
                else:
                    walk.row(conv_id, turn, role, text, fault)
            if len(done) >= 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done = []
        if walk is not None:
            done.append(walk.report())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    return run


class _Walk:
    """One conversation as its rows pass by."""

    def __init__(self, conv: str, conv_id) -> None:
        self.conv, self.conv_id = conv, conv_id
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.rows = self.lines = self.turns = 0
        self.first = self.turn = self.initial = None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.state, self.left = NOTHING, iter("")

    def piece(self, start: int, edits: str) -> None:
        self._rest()
        self.state, self.left = start, iter(edits)
        self.audit.append(edits)

    def row(self, conv_id, turn, role: str, text: str, fault: str | None) -> None:
        self.conv_id = conv_id
        self.rows += 1
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        for edit in self.left:
            if edit == "I":
                self._insert()
                continue
            self.cost += {"K": KEEP, "R": REROLE, "D": DELETE}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit == "K":
                self._say(role, role[:1], text)
            elif edit == "R":
                self._say("user" if DUE[self.state] == "u" else "assistant", DUE[self.state], text)
            break

    def _insert(self) -> None:
        self.cost += INSERT
        self._say("user" if DUE[self.state] == "u" else "assistant", DUE[self.state], "")

    def _say(self, role: str, initial: str, text: str) -> None:
        self.state = STEPS[self.state][initial]
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _rest(self) -> None:
        """Edits behind a piece's last row are insertions."""
        for _ in self.left:
            self._insert()

    def report(self) -> tuple:
        self._rest()
        gaps = 0 if self.first is None else int(self.turn) - int(self.first) + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest(), self.rows, self.lines)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows (conv_id, turn, role, text)``: its faults, the cheapest edits and a digest of what they make of it.

    ``gaps`` counts turns missing between the first and the last, nulls aside; ``blank``, ``duplicate`` and ``truncated`` rows by their first fault; ``illegal`` neighbours whose
    roles do not follow one another; ``cost`` and ``audit`` (``K``\\ eep, ``R``\\ erole, ``D``\\ elete, ``I``\\ nsert, in order; the ASCII-least of the cheapest) make the role initials
    ``(s?(ua)+)?``; ``repaired_sha256`` is that of ``role:text`` lines. Nulls of role and text are one space, a null conv_id is a conversation, turns sort nulls
    first, repeated rows stand side by side. An empty table gives no row.

    The digest of a conversation is one sequential hash by its nature: its rows pass one task as a stream, none of them held.
    """
    small_batches(rows.sparkSession)
    placed = cut_lineage(place_rows(rows))
    edits = find_edits(placed)
    kind = rows.schema["conv_id"].dataType
    null = lambda c: F.lit(None).cast(rows.schema["turn"].dataType if c == "turn" else kind if c == "conv_id" else "string").alias(c)
    told = edits.select("conv", null("conv_id"), null("turn"), null("role"), null("text"), null("fault"), "start", "edits", F.shiftleft("piece", PIECE_BITS).alias("at"), F.lit(0).alias("what"))
    said = placed.select("conv", "conv_id", "turn", "role", "text", "fault", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("edits"), "at", F.lit(1).alias("what"))
    stream = told.unionByName(said).repartition("conv").sortWithinPartitions("conv", "at", "what").drop("at", "what")
    from pyspark.sql.pandas.types import to_arrow_type

    return stream.mapInArrow(_reporter(to_arrow_type(kind)), REPORT.format(kind=kind.simpleString()))


def repair_all(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """``repair`` of ``rows``, with a row of zeros, no edits and the empty text's hash for every conversation of ``conversations`` that has none."""
    found = repair(rows).withColumn("conv", _key()).drop("conv_id")
    every = conversations.select("conv_id").distinct().withColumn("conv", _key())
    zero = {c.split()[0]: F.lit("") if c.endswith("string") else F.lit(0).cast("long") for c in REPORT.split(", ")[1:]}
    zero["repaired_sha256"] = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(found, "conv", "left").select("conv_id", *[F.coalesce(F.col(c), v).alias(c) for c, v in zero.items()])
