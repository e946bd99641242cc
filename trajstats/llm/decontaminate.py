"""Benchmark decontamination: items found in documents with up to a budget of edits.

Texts are lower-cased and runs of white space become one blank. An item of L characters may differ by
``L // chars_per_edit`` edits. It is cut into one piece more than that, so at least one piece is in any such
occurrence as it is. An automaton finds the pieces; hits on near diagonals share a window; in each window
Myers' bit-parallel algorithm gives the least distance of the item to a substring.

The documents are read once and never shuffled. The benchmark goes to the executors in blocks of bounded
size, each with its own automaton.

Defined cases: null or blank items match nothing; null or empty texts have no matches; a null id is kept;
items with equal texts are all reported; repeated rows and other columns pass through; an
empty benchmark leaves all documents clean; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Characters of an item for each edit of its budget.
CHARS_PER_EDIT = 20
#: Characters of benchmark text in a block.
BLOCK_CHARS = 4_000_000


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str | None) -> str:
    return " ".join(lowered(text or "").split())


def source_places(text: str) -> list[int]:
    """The place in the text of each character of its normal form."""
    out: list[int] = []
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(m.start() - 1)
        out.extend(range(*m.span()))
    return out


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length, with their offsets."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Matcher:
    """Approximate search of one item: the masks of its characters."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least edit distance of the item to a substring of the text, and the first end where it is reached."""
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        get = self.masks.get
        up, down, score = full, 0, self.length
        best, end = score, 0
        for i, c in enumerate(text, 1):
            same = get(c, 0)
            cross = same | down
            over = (((same & up) + up) ^ up) | same
            plus = down | (full & ~(over | up))
            minus = up & over
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < best:
                    best, end = score, i
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up = minus | (full & ~(cross | plus))
            down = plus & cross
        return best, end


class Block:
    """A block of items, with the automaton of their pieces."""

    def __init__(self, items: list[tuple], chars_per_edit: int):
        self.items = []
        found: dict[str, list] = {}
        for item_id, text in items:
            text = normal(text)
            if text:
                edits = len(text) // chars_per_edit
                for offset, piece in pieces(text, edits):
                    found.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, text, edits))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.matchers: dict[int, tuple[Matcher, Matcher]] = {}

    def search(self, text: str) -> list[tuple]:
        """(item_id, distance, start, end) for each item within its budget, in the normal text."""
        if not self.items:
            return []
        diagonals: dict[int, set] = {}
        for end, (length, places) in self.automaton.iter(text):
            for item, offset in places:
                diagonals.setdefault(item, set()).add(end + 1 - length - offset)
        out = []
        for item in sorted(diagonals):
            item_id, body, edits = self.items[item]
            if item not in self.matchers:
                self.matchers[item] = (Matcher(body), Matcher(body[::-1]))
            forward, backward = self.matchers[item]
            best = None
            for low, high in self._windows(sorted(diagonals[item]), edits):
                a, b = max(0, low - edits), min(len(text), high + len(body) + edits)
                distance, end = forward.best(text[a:b])
                if distance <= edits and (best is None or distance < best[0]):
                    best = (distance, a + end, a)
            if best:
                distance, end, a = best
                _, length = backward.best(text[a:end][::-1])
                out.append((item_id, distance, end - length, end))
        return out

    @staticmethod
    def _windows(diagonals: list[int], edits: int) -> Iterator[tuple[int, int]]:
        low = high = diagonals[0]
        for d in diagonals[1:]:
            if d - high > 2 * edits + 1:
                yield low, high
                low = d
            high = d
        yield low, high


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """Blocks of items of about ``block_chars``, one on the driver at a time."""
    sized = benchmark.filter(F.length(F.trim("text")) > 0)
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for i in range(n):
        part = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda x: (str(x[0]), x[1]))


def find_items(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS, text_col: str = "text") -> DataFrame:
    """``docs`` with arrays of the items found: item_ids, distances, starts and ends (in the source text, end exclusive).

    Columns of these names that are there already are replaced.
    """
    benchmark = benchmark.select("item_id", "text")
    kind = benchmark.schema["item_id"].dataType
    added = {"item_ids": kind, "distances": T.IntegerType(), "starts": T.LongType(), "ends": T.LongType()}
    for name, t in added.items():
        docs = docs.withColumn(name, F.array().cast(T.ArrayType(t)))
    context = docs.sparkSession.sparkContext
    for items in _blocks(benchmark, block_chars):
        docs = docs.mapInArrow(_scan(context.broadcast(items), chars_per_edit, text_col, list(added)), docs.schema)
    return docs


_built: dict = {}


def _scan(items, chars_per_edit: int, text_col: str, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (items.id if hasattr(items, "id") else hash(str(items.value)), chars_per_edit)
        if key not in _built:
            _built.clear()
            _built[key] = Block(items.value, chars_per_edit)
        block = _built[key]
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in added}
            for i, text in enumerate(batch.column(text_col)):
                text = text.as_py() or ""
                found = block.search(normal(text))
                if found:
                    places = source_places(text)
                    for item_id, distance, start, end in found:
                        for name, value in zip(added, (item_id, distance, places[start] if start < len(places) else len(text), places[end - 1] + 1 if end else 0)):
                            columns[name][i] = [*columns[name][i], value]
            arrays = [pa.array(columns[c], batch.schema.field(c).type) if c in columns else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return run


def verdicts(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, distances, starts, ends), one row per input row."""
    found = find_items(docs.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "distances", "starts", "ends")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return find_items(rows, benchmark, **options).filter(F.size("item_ids") == 0).select("row.*")
