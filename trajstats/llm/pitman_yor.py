"""Hierarchical Pitman-Yor language model over a whole corpus.

Restaurants: one for each context, where the context of a token is the 64-bit hash of the previous word; all share
one parent over words, whose base is even over the V training words and one unknown word.

    p(w | u) = (c_uw - d1 t_uw + (s1 + d1 t_u) p(w)) / (s1 + c_u)
    p(w)     = (t_w  - d0 t0_w + (s0 + d0 t0) / (V + 1)) / (s0 + t)

c are customers (training tokens below, tables above), t tables. The seating of each dish in each restaurant is drawn by Gibbs
steps, a dish at a time given all else: its customers sit down one after the other, at a new table with a
weight of its parent's share. From the 64th on they sit down in blocks of an eighth of those seated, by a
binomial draw. Totals over contexts are those of the epoch before, so that dishes
are drawn in parallel. Probabilities are averaged over the samples of the last epoch.

**Data flow.** One shuffle brings all entries (word, context, document, count) of a word into one bucket, as
packed arrays; the buckets are written to the shared folder. Their number follows the bytes of text. Words with a large share of all tokens
are split by context into pieces; their totals travel with the sums over all, so that within an epoch they are those of the epoch
before and all pieces see the same tables. Every task counts all words of its documents and reports those above a share of its own tokens; a word
above the wanted share of all tokens can't be missed that way, and the share bounds the list. Each bucket then seats
its dishes and sums log probabilities by document, and the sums meet by document.

Totals of contexts grow with the vocabulary and never reach the driver: each bucket adds up its own share of every
context it holds, the shares meet in parts by context hash, and each part answers each bucket with the totals of the
bucket's contexts, in the bucket's order. A frequent context is one share a bucket, so that it loads no task. Parts are as many as leave a
share ``SHARE_CONTEXTS`` contexts on average, so messages grow with the data. Where more than ``GROUP`` buckets meet in a part,
groups of buckets add up first, and groups of groups.

Words are hashed to 64 bits; chance equality among n words has probability n^2 / 2^65.

Defined cases: a null or empty text has one token, the end; null ids count as empty text for ``held_out``;
repeated rows are documents of their own; without training documents base and model are even over
one unknown word; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from trajstats.llm.common import chunks, mix, remainder, runs, text_buffers, word_hashes, written
from trajstats.session import ensure_checkpoint_dir

#: Contexts of a bucket up to which two bytes hold their number within the bucket.
SHORT = 1 << 16
#: Discount and strength of the context restaurants (1) and of their parent (0).
D1, S1, D0, S0 = 0.6, 40.0, 0.6, 10.0
#: Sweeps of the first epoch; sweeps before the samples of the last one, and samples.
SWEEPS, BURN_IN, SAMPLES = 3, 2, 4
#: Tokens and documents that a map task packs at a time.
PACK_TOKENS, PACK_DOCS = 1_000_000, 32_000
#: Bytes of text of a bucket on average, buckets of a file, sums that a task keeps before it sends them.
BUCKET_BYTES, BUCKETS_A_FILE, KEPT_SUMS = 4_500_000, 2, 1_000_000
#: Contexts of a share on average; owners of shares that meet in a part.
SHARE_CONTEXTS, GROUP = 4096, 256
#: Pieces of a word with a large share.
PIECES = 16

END = mix(np.array([0x656E64], np.uint64))[0]
_BLOB = "bucket long, unit long, words binary, word_pairs binary, contexts binary, entries binary, docs binary, counts binary, tokens binary, held binary, ids array<{id}>"
_PACKED = ("words", "word_pairs", "contexts", "entries", "docs", "counts")
_TABLE = "bucket long, unit long, words binary, word_pairs binary, word_count binary, contexts binary, pair_context binary, pair_count binary, pair_entries binary, units binary, entry_unit binary, entry_doc binary, entry_count binary, totals binary, tokens binary, held binary, ids array<{id}>"


@dataclass
class Totals:
    """Sums over all buckets: of one bucket's contexts, by word of a large share, and overall. Those of contexts are not packed."""

    context_tables: np.ndarray = field(default_factory=lambda: np.zeros(SHORT))
    context_tokens: np.ndarray = field(default_factory=lambda: np.zeros(SHORT))
    large_tables: np.ndarray = field(default_factory=lambda: np.zeros(0))
    large_tokens: np.ndarray = field(default_factory=lambda: np.zeros(0))
    words: float = 0.0
    tables: float = 0.0
    root_tables: float = 0.0
    tokens: float = 0.0

    def packed(self) -> bytes:
        return np.concatenate([self.large_tables, self.large_tokens, [self.words, self.tables, self.root_tables, self.tokens]]).astype(np.float64).tobytes()

    @staticmethod
    def unpacked(raw: bytes | np.ndarray) -> Totals:
        x = np.frombuffer(raw, np.float64) if isinstance(raw, bytes) else raw
        n = (len(x) - 4) // 2
        a, b, rest = np.split(x, [n, 2 * n])
        return Totals(np.zeros(0), np.zeros(0), a, b, *rest.tolist())


def document_tokens(bounds: np.ndarray, raw: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end for each row, the context of each, and the row."""
    words, rows = word_hashes(bounds, raw, first, last)
    tokens, rows = np.concatenate([words, np.full(last - first, END)]), np.concatenate([rows, np.arange(first, last)])
    order = np.argsort(rows, kind="stable")
    tokens, rows = tokens[order], rows[order]
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[:1] = END
    return tokens, mix(before + np.uint64(77)), rows


def _pack(large: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packs = TaskContext.get().partitionId(), 0
        held, ids, lengths, tokens, contexts, owners = [], [], [], [], [], []
        docs = count = 0

        def flush():
            nonlocal packs
            unit = (part << 24) + packs
            packs += 1
            word, context, doc = np.concatenate(tokens), np.concatenate(contexts), np.concatenate(owners)
            at = np.minimum(np.searchsorted(large, word), max(0, len(large) - 1))
            if len(large):
                split = large[at] == word
                word[split] = mix(word[split] + np.uint64(1) + (context[split] % PIECES).astype(np.uint64))
            known, local = np.unique(context, return_inverse=True)
            place = local.astype(np.uint64) << np.uint64(16) | doc.astype(np.uint64)
            del doc, context, local
            order = np.lexsort((place, word))  # buckets rise with the hash
            word, place = word[order], place[order]
            del order
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (place[1:] != place[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(word))).astype(np.uint32)
            word, place = word[at], place[at]
            bucket = (word >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            doc, local = (place & np.uint64(0xFFFF)).astype(np.int64), place >> np.uint64(16)
            flags = np.concatenate(held)
            doc = doc.astype(np.uint16) | (flags[doc].astype(np.uint16) << np.uint16(15))
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (local[1:] != local[:-1])
            for start, length in zip(*runs(bucket)):
                here = slice(start, start + length)
                pair = np.flatnonzero(new[here])
                own = word[here][pair]
                first, pairs = runs(own)
                entries = np.diff(np.append(pair, length)).astype(np.uint32)
                blobs = [own[first], pairs.astype(np.uint32), known[local[here][pair]], entries, doc[here], times[here]]
                yield row([int(bucket[start]), unit, *(x.tobytes() for x in blobs), None, None, None])
            yield row([-1 - unit, unit, None, None, None, None, None, None, np.concatenate(lengths).astype(np.int64).tobytes(), flags.tobytes(), pa.concat_arrays(ids)])

        def row(values):
            arrays = [pa.array(values[:1], pa.int64()), pa.array(values[1:2], pa.int64())] + [pa.array([x], pa.binary()) for x in values[2:10]]
            kind = id_type[0]
            arrays.append(pa.array([values[10].to_pylist() if values[10] is not None else None], pa.list_(kind)))
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "unit", *_PACKED, "tokens", "held", "ids"])

        id_type = [pa.int64()]
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds, raw = text_buffers(batch.column("text"))
            doc_ids = batch.column("doc_id")
            id_type[0] = doc_ids.type
            flags = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for first, last in chunks(bounds):
                for a in range(first, last, PACK_DOCS):
                    b = min(last, a + PACK_DOCS)
                    if docs and (docs + b - a > PACK_DOCS or count > PACK_TOKENS):
                        yield from flush()
                        held, ids, lengths, tokens, contexts, owners = [], [], [], [], [], []
                        docs = count = 0
                    token, context, rows = document_tokens(bounds, raw, a, b)
                    tokens.append(token)
                    contexts.append(context)
                    owners.append(rows - a + docs)
                    lengths.append(np.bincount(rows - a, minlength=b - a))
                    held.append(flags[a:b])
                    ids.append(doc_ids.slice(a, b - a))
                    docs, count = docs + b - a, count + len(token)
        if docs:
            yield from flush()

    return run


def _large_words(docs: DataFrame, buckets: int) -> np.ndarray:
    """Hashes of all words with more than a quarter of a bucket's share of the tokens, and of no word with less than three quarters of that.

    A task reports words above a sixteenth of a bucket's share of its own tokens. What it doesn't report adds up to less than a sixteenth of
    all, so a sum of reports above three sixteenths is what to look for; at most 16 * buckets / 3 words have it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def folded():
            all_, back = np.unique(np.concatenate([words, *(w for w, _ in new)]), return_inverse=True)
            return all_, np.bincount(back, np.concatenate([n, *(k for _, k in new)]), len(all_)).astype(np.int64)

        for batch in batches:
            bounds, raw = text_buffers(batch.column("text"))
            for first, last in chunks(bounds):
                new.append(np.unique(document_tokens(bounds, raw, first, last)[0], return_counts=True))
                if sum(len(w) for w, _ in new) > max(1 << 19, len(words)):
                    (words, n), new = folded(), []
        words, n = folded()
        total = int(n.sum())
        often = n * 16 * buckets > total
        yield pa.RecordBatch.from_arrays([pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[often].tolist()], pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    whole = F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("total")
    found = written(counts)
    total = found.agg(whole).first()[0]
    rows = found.filter(F.col("word").isNotNull() & (F.col("n") * 16 * buckets > 3 * total)).select("word").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _piece_words(large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces, in order, and the number of the word of each."""
    pieces = mix(np.repeat(large, PIECES) + np.uint64(1) + np.tile(np.arange(PIECES, dtype=np.uint64), len(large)))
    order = np.argsort(pieces)
    return pieces[order], np.repeat(np.arange(len(large)), PIECES)[order]


def _lookup(words: np.ndarray, large: np.ndarray) -> np.ndarray:
    """The number of the large word of each word, -1 for others."""
    pieces, number = _piece_words(large)
    if not len(pieces):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(pieces, words), len(pieces) - 1)
    return np.where(pieces[at] == words, number[at], -1)


def _gather(large: np.ndarray):
    """Merge the blobs of a bucket: pairs of word and context with their training counts, and entries by document."""

    def merged(blobs: list) -> dict:
        joined = lambda k, kind: np.concatenate([np.frombuffer(b[k], kind) for b in blobs])
        entries, doc, times = joined(4, np.uint32), joined(5, np.uint16), joined(6, np.uint32)
        words = np.repeat(np.repeat(joined(1, np.uint64), joined(2, np.uint32)), entries)
        contexts, context = np.unique(joined(3, np.uint64), return_inverse=True)
        context = np.repeat(context.astype(np.uint16 if len(contexts) <= SHORT else np.uint32), entries)
        unit = np.repeat(np.arange(len(blobs), dtype=np.uint32), [len(b[5]) // 2 for b in blobs])
        order = np.lexsort((context, words))
        words, doc, context, times, unit = words[order], doc[order], context[order], times[order], unit[order].astype(np.uint16 if len(blobs) < 1 << 16 else np.uint32)
        del order
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (context[1:] != context[:-1])
        at = np.flatnonzero(new)
        train = np.where(doc >> 15 == 0, times, 0)
        count = np.add.reduceat(train, at).astype(np.int64)
        pair_word, pair_context = words[at], context[at]
        first, pairs = runs(pair_word)
        word_count = np.add.reduceat(count, first)
        word = pair_word[first]
        number = _lookup(word, large)
        sums = Totals(np.zeros(0), np.zeros(0), np.zeros(len(large)), np.zeros(len(large)), tokens=float(count.sum()))
        plain = number < 0
        sums.words = sums.root_tables = float(((word_count > 0) & plain).sum())
        sums.tables = float((count > 0).sum())
        if not plain.all():
            sums.large_tables += np.bincount(number[~plain], np.add.reduceat((count > 0).astype(float), first)[~plain], len(large))
            sums.large_tokens += np.bincount(number[~plain], word_count[~plain], len(large))
        return {
            "words": word, "word_pairs": pairs.astype(np.uint32), "word_count": word_count.astype(np.int64), "contexts": contexts, "pair_context": pair_context, "pair_count": count.astype(np.uint32),
            "pair_entries": np.diff(np.append(at, len(words))).astype(np.uint32), "units": np.array([b[0] for b in blobs], np.int64), "entry_unit": unit,
            "entry_doc": doc & np.uint16(0x7FFF), "entry_count": times, "totals": sums,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list] = {}
        names = ["words", "word_pairs", "word_count", "contexts", "pair_context", "pair_count", "pair_entries", "units", "entry_unit", "entry_doc", "entry_count"]
        columns = ["bucket", "unit", *names, "totals", "tokens", "held", "ids"]
        for batch in batches:
            buckets = batch.column("bucket").to_pylist()
            for i, b in enumerate(buckets):
                one = batch.slice(i, 1)
                if b < 0:
                    arrays = [one.column("bucket"), one.column("unit")] + [pa.nulls(1, pa.binary()) for _ in range(len(names) + 1)] + [one.column(c) for c in ("tokens", "held", "ids")]
                    yield pa.RecordBatch.from_arrays(arrays, columns)
                else:
                    blobs.setdefault(b, []).append([one.column("unit")[0].as_py(), *(one.column(c)[0].as_py() for c in _PACKED)])
            kind = batch.schema.field("ids").type
        for b in list(blobs):
            found = merged(sorted(blobs.pop(b), key=lambda x: x[0]))
            arrays = [pa.array([b], pa.int64()), pa.nulls(1, pa.int64())] + [pa.array([found[c].tobytes()], pa.binary()) for c in names]
            arrays += [pa.array([found["totals"].packed()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, kind)]
            del found
            yield pa.RecordBatch.from_arrays(arrays, columns)
            del arrays
            pa.default_memory_pool().release_unused()

    return run


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish when its customers sit down one after the other; ``weight`` is that of a new table."""
    tables = (customers > 0).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    seated = 1
    while len(live):
        step = max(1, seated // 8) if seated >= 64 else 1
        n = np.minimum(step, customers[live] - seated)
        w = weight[live]
        chance = w / (w + seated + (n - 1) / 2 - discount * tables[live])
        if step == 1:
            tables[live] += rng.random(len(live)) < chance
        else:
            tables[live] += rng.binomial(n.astype(np.int64), np.clip(chance, 0, 1))
        seated += step
        live = live[customers[live] > seated]
    return tables


def _numbers(row: dict) -> np.ndarray:
    """The number of each pair's context within the bucket, held in two or four bytes."""
    return np.frombuffer(row["pair_context"], np.uint16 if len(row["pair_context"]) < len(row["pair_count"]) else np.uint32)


def _seated(row: dict, totals: Totals, large: np.ndarray, seed: list[int], sweeps: int, samples: int) -> tuple[np.ndarray, Totals]:
    """Mean probability of each pair over the last ``samples`` sweeps, and the sums of the last sweep."""
    rng = np.random.default_rng(seed)
    get = lambda c, t: np.frombuffer(row[c], t)
    pairs, count, context = get("word_pairs", np.uint32), get("pair_count", np.uint32).astype(np.int64), _numbers(row)
    first = np.concatenate([[0], np.cumsum(pairs)[:-1]]).astype(np.int64)
    word_of = np.repeat(np.arange(len(pairs)), pairs)
    number = _lookup(get("words", np.uint64), large)
    big = number >= 0
    base = 1 / (totals.words + 1)
    root_weight = (S0 + D0 * totals.root_tables) * base
    shared = seat(totals.large_tables.astype(np.int64), np.full(len(large), root_weight), D0, np.random.default_rng(seed[:2]))
    tables = (count > 0).astype(np.float64)
    above = S1 + D1 * totals.context_tables[context]
    below = S1 + totals.context_tokens[context]
    mean = np.zeros(len(count))

    def parent():
        by_word = np.add.reduceat(tables, first)
        by_word[big] = totals.large_tables[number[big]]
        root = seat(by_word.astype(np.int64), np.full(len(pairs), root_weight), D0, rng)
        root[big] = shared[number[big]]
        return (by_word - D0 * root + root_weight) / (S0 + totals.tables), root

    p, root = parent()
    for sweep in range(sweeps):
        tables = seat(count, above * p[word_of], D1, rng)
        p, root = parent()
        if sweep >= sweeps - samples:
            mean += (count - D1 * tables + above * p[word_of]) / below
    sums = Totals(np.bincount(context, tables, len(totals.context_tables)), np.zeros(0), np.zeros(len(large)), np.zeros(len(large)))
    sums.tables, sums.root_tables = float(tables.sum()), float(root[~big].sum())
    if big.any():
        sums.large_tables += np.bincount(number[big], np.add.reduceat(tables, first)[big], len(large))
    return mean / max(1, samples), sums


def _row(batch: pa.RecordBatch, i: int) -> dict:
    """A row's blobs as views of the batch."""
    return {c: batch.column(c)[i].as_py() if c in ("bucket", "answers") else batch.column(c)[i].as_buffer() for c in batch.schema.names}


_PAIRS = ("words", "word_pairs", "word_count", "contexts", "pair_context", "pair_count")


def _with_contexts(totals: Totals, row: dict) -> Totals:
    """The totals with those of the row's contexts."""
    tables, tokens = (np.concatenate([np.frombuffer(a[k], np.int64) for a in row["answers"]]).astype(np.float64) for k in ("tables", "tokens"))
    return replace(totals, context_tables=tables, context_tokens=tokens)


def _shares(batch_rows: Iterator[tuple[dict, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """A bucket's share of the totals of its contexts, one row for each part; contexts are in order, and parts rise with the hash."""
    for row, tables in batch_rows:
        contexts = np.frombuffer(row["contexts"], np.uint64)
        tokens = np.bincount(_numbers(row), np.frombuffer(row["pair_count"], np.uint32), len(contexts)).astype(np.uint32)
        part, tables = (contexts >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), tables.astype(np.uint32)
        starts, lengths = runs(part)
        blobs = [pa.array([x[a : a + n].tobytes() for a, n in zip(starts, lengths)], pa.binary()) for x in (contexts, tables, tokens)]
        yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), pa.array(np.full(len(starts), row["bucket"])), *blobs], ["part", "bucket", "contexts", "tables", "tokens"])


_SHARES = "part long, bucket long, contexts binary, tables binary, tokens binary"


def _first_shares(parts: int):
    """Shares when all customers of a dish sit at one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    row = _row(batch, i)
                    yield row, np.bincount(_numbers(row), np.frombuffer(row["pair_count"], np.uint32) > 0, len(row["contexts"]) // 8)

        yield from _shares(rows(), parts)

    return run


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each key of sorted batches; blobs are views of their batches."""
    held, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: (x.as_buffer() if pa.types.is_binary(x.type) and x.is_valid else x.as_py()) for c in batch.schema.names for x in [batch.column(c)[i]]}
            key = tuple(row[k] for k in keys)
            if rows and key != held:
                yield held, rows
                rows = []
            held = key
            rows.append(row)
    if rows:
        yield held, rows


def _summed_up(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Contexts of all rows in order, the place of each row's contexts among them, and the sums of tables and tokens."""
    contexts, at = np.unique(np.concatenate([np.frombuffer(r["contexts"], np.uint64) for r in rows]), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([np.frombuffer(r[k], np.uint32 if len(r[k]) * 2 == len(r["contexts"]) else np.int64) for r in rows]), len(contexts)).astype(np.int64) for k in ("tables", "tokens")]
    return contexts, at, sums


def _cut(rows: list[dict], at: np.ndarray, sums: list[np.ndarray]) -> list[pa.Array]:
    """Tables and tokens of the contexts of each row."""
    cut = np.cumsum([0] + [len(r["contexts"]) // 8 for r in rows])
    return [pa.array([x[at[a:b]].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in sums]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the contexts of a part, for each bucket in its own order."""
    for (part,), rows in _by_key(batches, ["part"]):
        _, at, sums = _summed_up(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r["bucket"] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), *_cut(rows, at, sums)], ["bucket", "part", "tables", "tokens"])


def _merged_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of a group of buckets in a part."""
    for (group, part), rows in _by_key(batches, ["group", "part"]):
        contexts, _, sums = _summed_up(rows)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (part, group)] + [pa.array([x.tobytes()], pa.binary()) for x in (contexts, *sums)], ["part", "bucket", "contexts", "tables", "tokens"])


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers for the buckets of a group from the answer for the group, which comes first."""
    for _, (head, *rows) in _by_key(batches, ["group", "part"]):
        contexts = np.frombuffer(head["contexts"], np.uint64)
        at = np.searchsorted(contexts, np.concatenate([np.frombuffer(r["contexts"], np.uint64) for r in rows]))
        sums = [np.frombuffer(head[k], np.int64) for k in ("tables", "tokens")]
        yield pa.RecordBatch.from_arrays([pa.array([r["bucket"] for r in rows], pa.int64()), pa.array([head["part"]] * len(rows), pa.int64()), *_cut(rows, at, sums)], ["bucket", "part", "tables", "tokens"])


_ANSWERS = "bucket long, part long, tables binary, tokens binary"


def _answered(shares: DataFrame, owners: int, parts: int, group: int = GROUP) -> DataFrame:
    """Totals over all owners for each share. Above ``group`` owners their groups add up first, part by part."""
    if owners <= group:
        return shares.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answers, _ANSWERS)
    grouped = written(shares.withColumn("group", F.floor(F.col("bucket") / group).cast("long")))
    groups = -(-owners // group)
    tasks = parts * groups
    merged = written(grouped.repartition(tasks, "group", "part").sortWithinPartitions("group", "part").mapInArrow(_merged_shares, _SHARES))
    above = _answered(merged, groups, parts, group)
    contexts = merged.select(F.col("bucket").alias("group"), "part", "contexts")
    heads = above.withColumnRenamed("bucket", "group").join(contexts, ["group", "part"])
    columns = ["group", "part", "bucket", "contexts", "tables", "tokens"]
    both = grouped.select(columns).unionAll(heads.withColumn("bucket", F.lit(-1).cast("long")).select(columns))
    return both.repartition(tasks, "group", "part").sortWithinPartitions("group", "part", "bucket").mapInArrow(_handed_down, _ANSWERS)


def _dealt(df: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder whose files are dealt by bucket, so that joins by bucket move only the other side; and its name in the catalog."""
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, "bucket").saveAsTable(name)
    return spark.table(name), name


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session while steps are written: shuffle files go as soon as a step is done, and rows of buckets, which are large,
    are Arrow batches of their own, so that a task holds one at a time.
    """
    names = {"cleanup": "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "rows": "spark.sql.execution.arrow.maxRecordsPerBatch"}
    before = {names[k]: spark.conf.get(names[k]) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for name, v in before.items():
            spark.conf.set(name, v)


def _joined(rows: DataFrame, shares: DataFrame, owners: int, parts: int, group: int) -> DataFrame:
    """Each bucket's row with the totals of its contexts, ``answers`` in the order of parts."""
    totals = _answered(shares, owners, parts, group)
    totals = totals.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("part", "tables", "tokens"))).alias("answers"))
    return rows.join(totals.hint("shuffle_hash"), "bucket")


def _sweep(totals: bytes, large: np.ndarray, parts: int):
    """Shares after the sweeps, and a row with the packed sums of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, summed = Totals.unpacked(totals), None

        def rows():
            nonlocal summed
            for batch in batches:
                for i in range(batch.num_rows):
                    row = _row(batch, i)
                    sums = _seated(row, _with_contexts(known, row), large, [11, 1, row["bucket"]], SWEEPS, 0)[1]
                    part = np.frombuffer(sums.packed(), np.float64)
                    summed = part if summed is None else summed + part
                    yield row, sums.context_tables

        for out in _shares(rows(), parts):
            yield out.append_column("totals", pa.nulls(out.num_rows, pa.binary()))
        if summed is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([summed.tobytes()], pa.binary())], ["part", "bucket", "contexts", "tables", "tokens", "totals"])

    return run


def _summed(rows: DataFrame) -> np.ndarray | None:
    """Sum of the packed totals, first in up to 16 tasks, then of their 16 rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("totals"):
                part = np.frombuffer(x.as_py(), np.float64)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["totals"])

    local = rows.mapInArrow(add, "totals binary")
    found = [np.frombuffer(bytes(r[0]), np.float64) for r in local.repartition(16).mapInArrow(add, "totals binary").collect()]
    return sum(found) if found else None


def _score(totals: bytes, large: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by document of each pack: base, score and known tokens."""
        known = Totals.unpacked(totals)
        kept: dict[int, list] = {}
        size = 0

        def flush():
            for unit in sorted(kept):
                docs, *sums = (np.concatenate(x) for x in zip(*kept.pop(unit)))
                some = np.flatnonzero(np.bincount(docs))
                sums = [np.bincount(docs, v)[some] for v in sums]
                arrays = [some.astype(np.uint16), sums[0], sums[1], sums[2].astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in arrays], ["unit", "docs", "base", "score", "known"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                p, _ = _seated(row, _with_contexts(known, row), large, [11, 2, row["bucket"]], BURN_IN + SAMPLES, SAMPLES)
                number = _lookup(np.frombuffer(row["words"], np.uint64), large)
                count = np.frombuffer(row["word_count"], np.int64).astype(np.float64)
                count[number >= 0] = known.large_tokens[number[number >= 0]]
                word = np.repeat(np.arange(len(count), dtype=np.uint32), np.frombuffer(row["word_pairs"], np.uint32))
                by_pair = (np.log10(count + 0.1)[word], np.log10(p), (count > 0)[word])
                pair = np.repeat(np.arange(len(p), dtype=np.uint32), np.frombuffer(row["pair_entries"], np.uint32))
                times, doc = np.frombuffer(row["entry_count"], np.uint32), np.frombuffer(row["entry_doc"], np.uint16)
                units = np.frombuffer(row["units"], np.int64)
                unit = np.frombuffer(row["entry_unit"], np.uint16 if len(units) < 1 << 16 else np.uint32)
                del word, p, count
                order = np.argsort(unit, kind="stable").astype(np.uint32)
                starts, lengths = runs(unit[order])
                for start, length in zip(starts, lengths):
                    here = order[start : start + length]
                    own, at, n = pair[here], doc[here], times[here]
                    sums = [np.bincount(at, n * v[own]) for v in by_pair]
                    some = np.flatnonzero(np.bincount(at))
                    kept.setdefault(int(units[unit[here[0]]]), []).append((some.astype(np.uint16), sums[0][some], sums[1][some], sums[2][some].astype(np.uint32)))
                    size += len(some)
                del order, pair, by_pair, row
                if size > KEPT_SUMS:
                    yield from flush()
                    size = 0
            del batch
            pa.default_memory_pool().release_unused()
        yield from flush()

    return run


def _by_document(totals: bytes, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Totals.unpacked(totals)
        tokens = known.tokens
        shift = np.log10(tokens + 0.1 * (known.words + 1))
        parts, heads = {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                unit = row["unit"].as_py()
                if row["held"].as_py() is not None:
                    heads[unit] = (np.frombuffer(row["tokens"].as_py(), np.int64), np.frombuffer(row["held"].as_py(), bool), row["ids"].values)
                else:
                    parts.setdefault(unit, []).append([row[c].as_py() for c in ("docs", "base", "score", "known")])
        for unit, (n, held, ids) in heads.items():
            base, score, seen = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64)
            for docs, b, s, k in sorted(parts.pop(unit, [])):
                at = np.frombuffer(docs, np.uint16)
                base[at] += np.frombuffer(b, np.float64)
                score[at] += np.frombuffer(s, np.float64)
                seen[at] += np.frombuffer(k, np.uint32)
            arrays = [ids, pa.array(held), pa.array(n), pa.array(seen), pa.array(np.full(len(n), int(tokens))), pa.array(base - n * shift), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, bucket_bytes: int = BUCKET_BYTES, share_contexts: int = SHARE_CONTEXTS, group: int = GROUP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (remainder(id_col, folds) == held_fold).alias("held_out"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-size // bucket_bytes))
    large = _large_words(docs, buckets)
    files = -(-buckets // BUCKETS_A_FILE)
    with _settings(spark, cleanup="true"):
        table, name = _dealt(docs.mapInArrow(_pack(large, buckets), _BLOB.format(id=id_type)).repartition(files, "bucket").mapInArrow(_gather(large), _TABLE.format(id=id_type)), files)
    rows = table.filter("bucket >= 0")
    first = _summed(rows.select("totals"))
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if first is None:
        spark.sql(f"DROP TABLE {name}")
        return spark.createDataFrame([], schema)
    totals = Totals.unpacked(first)
    large_seen = float((totals.large_tokens > 0).sum())
    totals.words += large_seen
    totals.root_tables += large_seen
    held, contexts = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("contexts") / 8)).first()
    parts = max(1, round(contexts / held / share_contexts))
    shares = rows.select("bucket", "contexts", "pair_context", "pair_count").mapInArrow(_first_shares(parts), _SHARES)
    with _settings(spark, cleanup="true", rows="1"):
        sweeps = written(_joined(rows.select("bucket", *_PAIRS), shares, buckets, parts, group).mapInArrow(_sweep(totals.packed(), large, parts), f"{_SHARES}, totals binary"))
    swept = Totals.unpacked(_summed(sweeps.filter("part is null").select("totals")))
    shared = seat(swept.large_tables.astype(np.int64), np.full(len(large), (S0 + D0 * totals.root_tables) / (totals.words + 1)), D0, np.random.default_rng([11, 2]))
    totals.large_tables, totals.tables, totals.root_tables = swept.large_tables, swept.tables, swept.root_tables + float(shared.sum())
    columns = ["bucket", *_PAIRS, "pair_entries", "units", "entry_unit", "entry_doc", "entry_count"]
    scored = _joined(rows.select(columns), sweeps.filter("part is not null").drop("totals"), buckets, parts, group)
    sums = scored.mapInArrow(_score(totals.packed(), large), "unit long, docs binary, base binary, score binary, known binary")
    heads = table.filter("bucket < 0").select("unit", "tokens", "held", "ids")
    both = sums.unionByName(heads, allowMissingColumns=True).repartition(files, "unit")
    with _settings(spark, cleanup="true", rows="1"):
        scores = written(both.mapInArrow(_by_document(totals.packed(), id_type), schema))
    spark.sql(f"DROP TABLE {name}")
    return scores
