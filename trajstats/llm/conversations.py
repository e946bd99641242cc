"""Repair of the turn structure of conversations by a generalised LR parse over the role grammar.

The role initials of a whole conversation read (s?(ua)+)?. As a grammar, S -> empty | B | s B and B -> u a | B u a. A row is kept, gets
another role, or is deleted; rows without text may be inserted. Each action has a weight and a letter, and the letters in order
are the audit.

* ``advance`` shifts one initial on every stack of a graph-structured stack and reduces complete handles. Stacks are interned
  nodes (state, node below), so equal tops are one object; those that meet are merged by the least (cost, audit). Audits of equal
  cost over the same rows are never prefixes of each other (a further letter would be an insert, which costs), so the
  least of the parts gives the least of the whole, ASCII order included.
* Conversations may be of any length. Rows are sorted over all tasks by conversation and turn and cut into blocks of at most ``BLOCK`` rows.
  Each block is parsed from every possible stack: a small table from stack to stack. ``edits`` then follows the tables of a conversation block by
  block; it sees one row for each block and holds the letters since the last point where all live parses agree.
* Edits are applied by block (``repaired``), so a conversation with a third of all rows spreads over all tasks. A digest of a whole
  conversation is a chain by nature: ``digests`` streams its repaired rows in order through one hash and holds one Arrow batch.

Faults, the first counts: ``blank`` (no word), ``duplicate`` (role and text seen earlier in the conversation), ``truncated``
(the last character of a word is none of . ! ?). Blank and duplicate rows must go; a truncated row that stays adds to the cost.

Defined cases: rows are ordered by turn (nulls first), then by a digest of role and text, then as read; nulls count as one space, in roles and texts, and null
conversation ids are a conversation of their own; a role whose first letter is not s, u or a can't be kept, nor an empty
one; repeated rows are duplicates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trajstats.llm.common import written

#: Rows of a block.
BLOCK = 64
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"

#: Shifts of the automaton of the grammar by state and initial, and handles that are complete in a state: (length, left side).
SHIFT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("B", "u"): "Bu", ("sB", "u"): "Bu", ("u", "a"): "ua", ("Bu", "a"): "Bua"}
REDUCE = {"ua": 2, "Bua": 3}
GOTO = {"0": "B", "s": "sB"}
ACCEPT = {"0", "B", "sB"}

Stack = tuple  # (state, stack below or None), interned
_nodes: dict[Stack, Stack] = {}


def _node(state: str, below: Stack | None) -> Stack:
    return _nodes.setdefault((state, below), (state, below))


def advance(stack: Stack, initial: str) -> Stack | None:
    """The stack after a shift and all reductions; None where the initial can't come."""
    to = SHIFT.get((stack[0], initial))
    if to is None:
        return None
    stack = _node(to, stack)
    while stack[0] in REDUCE:
        for _ in range(REDUCE[stack[0]]):
            stack = stack[1]
        stack = _node(GOTO[stack[0]], stack)
    return stack


def _stacks() -> list[Stack]:
    """All stacks between two shifts; the grammar recurses on the left, so there are few."""
    found = [_node("0", None)]
    for stack in found:
        found += [n for c in "sua" if (n := advance(stack, c)) and n not in found]
    return found


STACKS = _stacks()
PLACE = {s: i for i, s in enumerate(STACKS)}
OPEN = [i for i, s in enumerate(STACKS) if s[0] in ACCEPT]
Heads = dict  # Stack -> (cost, audit)


def _merge(heads: Heads, stack: Stack | None, cost: int, audit: str) -> bool:
    if stack is None or (stack in heads and heads[stack] <= (cost, audit)):
        return False
    heads[stack] = (cost, audit)
    return True


def _inserted(heads: Heads) -> Heads:
    """``heads`` and what inserts lead to."""
    todo = list(heads)
    while todo:
        stack = todo.pop()
        cost, audit = heads[stack]
        todo += [n for c in "ua" if _merge(heads, n := advance(stack, c), cost + INSERT, audit + "I")]
    return heads


def _step(heads: Heads, symbol: str) -> Heads:
    """All edits of one row. A symbol is the initial (o: any other), a capital where the row is truncated, - where it must go."""
    out: Heads = {}
    for stack, (cost, audit) in heads.items():
        _merge(out, stack, cost + DELETE, audit + "D")
        if symbol != "-":
            more = TRUNCATED if symbol.isupper() else 0
            _merge(out, advance(stack, symbol.lower()), cost + more, audit + "K")
            for c in "ua":
                _merge(out, advance(stack, c), cost + more + REROLE, audit + "R")
    return _inserted(out)


@lru_cache(maxsize=1 << 16)
def table_of(symbols: str, whole: bool = False) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, audit) of a block; ``whole``: only from the empty stack."""
    out = []
    for start in STACKS[:1] if whole else STACKS:
        heads = _inserted({start: (0, "")})
        for symbol in symbols:
            heads = _step(heads, symbol)
        out += [(PLACE[start], PLACE[s], *h) for s, h in heads.items()]
    return tuple(out)


def _last(column: str) -> Column:
    """The last character that is no blank; empty where there is none."""
    return F.substring(F.rtrim(F.translate(F.col(column), BLANKS, " " * len(BLANKS))), -1, 1)


def marked(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, digest, row, fault, initial, symbol) of each row."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    # The length keeps role and text apart.
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    table = written(named.select("*", digest.alias("digest"), F.monotonically_increasing_id().alias("row")))
    last = _last("text")
    first = table.filter(last != "").groupBy("conv", "digest").agg(F.min(F.struct("turn", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("is_first"))
    found = table.join(first, "row", "left")
    fault = F.when(last == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(known)).otherwise(known)
    return found.select("conv", "turn", "role", "text", "digest", "row", fault.alias("fault"), initial.alias("initial"), symbol.alias("symbol"))


LEGAL = ("su", "ua", "au")


class _Sink:
    """Rows gathered into Arrow batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def full(self, least: int = 2048) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), self.schema.types)], schema=self.schema)
            self.rows = []


def _typed(rows: DataFrame, columns: str) -> tuple[str, pa.Schema]:
    """A schema that begins with the conversation's type, for Spark and for Arrow."""
    text = f"conv {rows.schema['conv'].dataType.simpleString()}, {columns}"
    return text, to_arrow_schema(StructType.fromDDL(text))


def blocked(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of ``marked`` in order, as a table in the shared folder: block, place in the block, and on the first row of a block its symbols, table,
    end initials and illegal pairs.
    """
    ddl, schema = _typed(rows, f"block long, at int, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string, symbols string, moves string, ends array<string>, pairs long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, held, number, fresh = _Sink(schema), [], TaskContext.get().partitionId() << 33, False

        def close(end: bool) -> None:
            symbols = "".join(r["symbol"] for r in held)
            # A conversation that begins and ends in this block needs the empty stack only. The first of a task may continue another's.
            moves = ";".join(f"{p},{q},{c},{a}" for p, q, c, a in table_of(symbols, fresh and end))
            pairs = sum(x["initial"] + y["initial"] not in LEGAL for x, y in zip(held, held[1:]))
            more = (symbols, moves, [held[0]["initial"], held[-1]["initial"]], pairs)
            sink.rows += [(r["conv"], number, i, r["turn"], r["role"], r["text"], *(more if i == 0 else (None,) * 4)) for i, r in enumerate(held)]

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == size or r["conv"] != held[-1]["conv"]):
                    end = r["conv"] != held[-1]["conv"]
                    close(end)
                    number, held, fresh = number + 1, [], end
                    yield from sink.full()
                held.append(r)
        if held:
            close(False)
        yield from sink.full(1)

    keys = ["conv", "turn", "digest", "row"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "initial", "symbol")
    return written(ordered.mapInArrow(run, ddl))


class _Parse:
    """Live parses of one conversation over its blocks: (cost, letters not yet given out) by stack."""

    def __init__(self):
        self.heads: dict[int, tuple[int, str]] = {0: (0, "")}
        self.open: list[tuple[int, str]] = []  # blocks whose letters aren't all given out, with their symbols
        self.rest, self.before, self.system = "", 0, False

    def add(self, block: int, symbols: str, moves: str) -> None:
        out: dict[int, tuple[int, str]] = {}
        for p, q, cost, audit in (m.split(",") for m in moves.split(";")):
            if int(p) in self.heads:
                base = self.heads[int(p)]
                found = (base[0] + int(cost), base[1] + audit)
                if int(q) not in out or found < out[int(q)]:
                    out[int(q)] = found
        self.heads = out
        self.open.append((block, symbols))

    def settled(self, end: bool) -> Iterator[tuple[int, str, bool, int]]:
        """(block, letters, whether the first row of the conversation is a kept s, rows before) as far as all parses agree; at the end by the cheapest."""
        if end:
            best = min(self.heads[p] for p in OPEN if p in self.heads)
            shared, self.heads = best[1], {0: (best[0], "")}
        else:
            audits = [a for _, a in self.heads.values()]
            low, high = min(audits), max(audits)
            n = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), len(low))
            shared, self.heads = low[:n], {q: (c, a[n:]) for q, (c, a) in self.heads.items()}
        self.rest += shared
        while self.open:
            block, symbols = self.open[0]
            at = rows = 0
            while rows < len(symbols) and at < len(self.rest):
                rows += self.rest[at] != "I"
                at += 1
            # Inserts after the last row belong to the last block, the others to the next one.
            if rows < len(symbols) or (len(self.open) == 1 and not end):
                return
            letters = self.rest if len(self.open) == 1 else self.rest[:at]
            yield block, letters, self.system, self.before
            if not self.before:
                kept = next((x for x, c in zip(symbols, letters.replace("I", "")) if c != "D"), "")
                self.system = letters.lstrip("D")[:1] == "K" and kept in ("s", "S")
            self.before += len(letters) - letters.count("D")
            self.rest = self.rest[len(letters):]
            self.open.pop(0)


def edits(blocks: DataFrame) -> DataFrame:
    """(conv, block, letters, n, system, before, cost, pairs) for each block of ``blocked``, as a table in the shared folder: letters of its n rows and of inserts
    before them, whether the conversation begins with a kept s before this block, how many rows come before. Cost and illegal
    pairs are on the last block of a conversation.
    """
    ddl, schema = _typed(blocks, "block long, letters string, n int, system boolean, before long, cost long, pairs long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, parse, conv, last, pairs, sizes = _Sink(schema), None, None, None, 0, {}

        def give(end: bool) -> None:
            for block, letters, system, before in parse.settled(end):
                sink.rows.append((conv, block, letters, sizes.pop(block), system, before, None, None))
            if end:
                sink.rows[-1] = (*sink.rows[-1][:6], parse.heads[0][0], pairs)

        for batch in batches:
            for r in batch.to_pylist():
                if parse is None or r["conv"] != conv:
                    if parse is not None:
                        give(True)
                        yield from sink.full()
                    parse, conv, last, pairs = _Parse(), r["conv"], None, 0
                elif parse is not None:
                    give(False)
                pairs += r["pairs"] + (last is not None and last + r["ends"][0] not in LEGAL)
                last, sizes[r["block"]] = r["ends"][1], len(r["symbols"])
                parse.add(r["block"], r["symbols"], r["moves"])
        if parse is not None:
            give(True)
        yield from sink.full(1)

    heads = blocks.filter("at = 0").select("conv", "block", "symbols", "moves", "ends", "pairs")
    return written(heads.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(run, ddl))


def repaired(blocks: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv, position, turn, role, text, edit) of all rows and inserts; deleted rows have no position. Block by block."""
    ddl, schema = _typed(blocks, f"position long, turn {blocks.schema['turn'].dataType.simpleString()}, role string, text string, edit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, letters, at, position, system, left, conv = _Sink(schema), "", 0, 0, False, 0, None

        def due() -> str:
            return "user" if (position - system) % 2 == 0 else "assistant"

        def insert() -> None:
            nonlocal at, position
            while at < len(letters) and letters[at] == "I":
                sink.rows.append((conv, position, None, due(), "", "I"))
                at, position = at + 1, position + 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["at"] < 0:
                    letters, at, position, system, left, conv = r["letters"], 0, r["before"], r["system"], r["n"], r["conv"]
                    continue
                insert()
                letter, at, left = letters[at], at + 1, left - 1
                role = due() if letter == "R" else r["role"]
                sink.rows.append((conv, None if letter == "D" else position, r["turn"], role, r["text"], letter))
                if letter != "D":
                    system = system or (position == 0 and letter == "K" and role[:1] == "s")
                    position += 1
                if not left:
                    insert()
                yield from sink.full()
        yield from sink.full(1)

    nothing = lambda t: F.lit(None).cast(t)
    rows = blocks.select("conv", "block", "at", "turn", "role", "text", *(nothing(t).alias(c) for c, t in (("letters", "string"), ("n", "int"), ("system", "boolean"), ("before", "long"))))
    heads = edited.select("conv", "block", F.lit(-1).alias("at"), nothing(blocks.schema["turn"].dataType).alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), "letters", "n", "system", "before")
    return rows.unionAll(heads).repartition("conv", "block").sortWithinPartitions("conv", "block", "at").mapInArrow(run, ddl)


def digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines role:text of each conversation's repaired rows, in order; conversations without such rows are absent."""
    ddl, schema = _typed(rows, "sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, state, conv = _Sink(schema), None, None
        for batch in batches:
            for who, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if state is None or who != conv:
                    if state is not None:
                        sink.rows.append((conv, state.hexdigest()))
                        yield from sink.full()
                    state, conv = hashlib.sha256(), who
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
        if state is not None:
            sink.rows.append((conv, state.hexdigest()))
        yield from sink.full(1)

    kept = rows.filter("position IS NOT NULL").select("conv", "position", "role", "text")
    return kept.repartition("conv").sortWithinPartitions("conv", "position").select("conv", "role", "text").mapInArrow(run, ddl)


def report(faulty: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation of ``marked`` and ``edits``."""
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    counts = faulty.groupBy("conv").agg(gaps.alias("gaps"), *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")))
    # The letters of a conversation are one value of the result.
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "")
    costs = edited.groupBy("conv").agg(F.max("pairs").alias("illegal"), F.max("cost").alias("cost"), letters.alias("audit"))
    return counts.alias("n").join(costs.alias("c"), F.col("n.conv").eqNullSafe(F.col("c.conv"))).select("n.*", "illegal", "cost", "audit")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation, and its rows after the repair (see ``report`` and ``repaired``)."""
    faulty = written(marked(rows, conv, turn, role, text))
    blocks = blocked(faulty, block)
    edited = edits(blocks)
    return report(faulty, edited), repaired(blocks, edited)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults by a hash of their place: 0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes
    it the user's. Nulls count as one space.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    named = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), draw.alias("draw")).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
