"""BPE encoding by a trie that shares prefixes, and decoding.

A text is cut into words by the tokenizer's pattern. The distinct words of a task go into a trie of their
bytes; a depth-first walk keeps the last token of the encoding of each prefix. The encoding of a prefix
that ends in token t is that of the rest plus t, and t is the one token for which the rest's last token and
t stay two tokens when they stand side by side. So every shared prefix is encoded once, and a word's tokens
are read off the path from its end.

Two tokens stay apart if no piece on the right edge of the first merges with a piece on the left edge of the
second before either is used up in its own token.

The tokenizer's file (byte-level BPE with one split pattern) is a parameter; it is read on the driver, its size is
checked, and it is sent to the executors. Its added tokens are found in the text first.

Defined cases: a null text counts as empty and has no tokens; ids, repeated rows and other columns pass
through; any text decodes to itself; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Bytes up to which a tokenizer's file is sent to the executors.
MAX_FILE = 32 << 20
#: Words that a trie holds, and encoded words that a worker keeps.
TRIE_WORDS, KEPT_WORDS = 60_000, 800_000
#: Characters of text in an output batch.
BATCH_CHARS = 2_000_000

# The pattern of byte-level BPE; white space is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The byte of each letter that stands for one: printable Latin-1 letters are themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieEncoder:
    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {as_bytes(s): i for s, i in data["model"]["vocab"].items() if s not in added}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in added.items()}
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(data["model"]["merges"]):
            left, right = (as_bytes(s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
            a, b = self.ids[left], self.ids[right]
            self.rank[a, b] = r
            self.parts.setdefault(self.ids[left + right], (a, b))
        self.born = {t: self.rank[p] for t, p in self.parts.items()}
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.whole: dict[int, bool] = {}
        self.apart: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces on one edge of a token, each with the rank at which it is used up."""
        out, used = [], 1 << 60
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out
            used, token = self.born[token], self.parts[token][side]

    def stay_apart(self, a: int, b: int) -> bool:
        at = a << 20 | b
        known = self.apart.get(at)
        if known is None:
            if a not in self.right:
                self.right[a] = self._edge(a, 1)
            if b not in self.left:
                self.left[b] = self._edge(b, 0)
            rank = self.rank
            known = True
            for x, x_used in self.right[a]:
                for y, y_used in self.left[b]:
                    r = rank.get((x, y))
                    if r is not None and r < x_used and r <= y_used:
                        known = False
                        break
                if not known:
                    break
            if len(self.apart) > 4_000_000:
                self.apart.clear()
            self.apart[at] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        known = self.whole.get(token)
        if known is None:
            known = token not in self.parts
            if not known:
                a, b = self.parts[token]
                known = self.reachable(a) and self.reachable(b) and self.rank[a, b] == self._first_merge(a, b)
            self.whole[token] = known
        return known

    def _first_merge(self, a: int, b: int) -> int:
        """The rank of the first merge over the border of two tokens."""
        found = [r for x, xu in self._edge(a, 1) for y, yu in self._edge(b, 0) if (r := self.rank.get((x, y))) is not None and r < xu and r <= yu]
        return min(found)

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words, by one walk of their trie."""
        child: dict[int, int] = {}
        children: list[list[int]] = [[]]
        ends: dict[int, str] = {}
        for word in words:
            node = 0
            for byte in word.encode():
                at = node << 8 | byte
                below = child.get(at)
                if below is None:
                    below = len(children)
                    child[at] = below
                    children[node].append(byte)
                    children.append([])
                node = below
            ends[node] = word
        out: dict[str, tuple[int, ...]] = {}
        ids, longest, apart, stay, sizes = self.ids, self.longest, self.apart, self.stay_apart, self.bytes
        last, begins = [-1], [0]  # of each prefix on the path: its last token, and where that begins
        byte_of = [bytes([i]) for i in range(256)]
        todo = [(child[byte], byte_of[byte]) for byte in children[0]]
        while todo:
            node, path = todo.pop()
            depth = len(path)
            del last[depth:], begins[depth:]
            start = near = max(begins[-1], depth - longest)
            step = 1
            while True:  # the token before it mostly grows, or ends where this one begins
                token = ids.get(path[start:])
                if token is not None:
                    if start:
                        before = last[start]
                        fits = apart.get(before << 20 | token)
                        if fits is None:
                            fits = stay(before, token)
                    else:
                        fits = self.reachable(token)
                    if fits:
                        break
                start += step
                if start == depth:
                    start, step = near - 1, -1
                if start < 0 or depth - start > longest:
                    raise ValueError("the tokenizer's merges leave a word without an encoding")
            last.append(token)
            begins.append(start)
            if node in ends:
                tokens, at = [], depth
                while at:
                    tokens.append(last[at])
                    at -= len(sizes[last[at]])
                out[ends[node]] = tuple(reversed(tokens))
            for b in children[node]:
                todo.append((child[node << 8 | b], path + byte_of[b]))
        return out

    def split(self, text: str) -> list[tuple[str, bool]]:
        """Pieces of the text, and whether each is an added token."""
        if self.cut is None or not any(s in text for s in self.added):
            return [(text, False)] if text else []
        return [(p, i % 2 == 1) for i, p in enumerate(self.cut.split(text)) if p]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [[(p if special else self.words.findall(p), special) for p, special in self.split(t)] for t in texts]
        new = set()
        for pieces in cut:
            for piece, special in pieces:
                if not special:
                    new.update(piece)
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        fresh = sorted(w for w in new if w not in self.known)
        for i in range(0, len(fresh), TRIE_WORDS):
            self.known.update(self.encode_words(fresh[i : i + TRIE_WORDS]))
        out = []
        for pieces in cut:
            ids: list[int] = []
            for piece, special in pieces:
                if special:
                    ids.append(self.added[piece])
                else:
                    for tokens in map(self.known.__getitem__, piece):
                        ids += tokens
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[int, TrieEncoder] = {}


def encoder(spec: str) -> TrieEncoder:
    """The encoder of a tokenizer's file; a worker keeps one."""
    if hash(spec) not in _encoders:
        _encoders.clear()
        _encoders[hash(spec)] = TrieEncoder(spec)
    return _encoders[hash(spec)]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = f.read(MAX_FILE + 1)
    if len(spec) > MAX_FILE:
        raise ValueError(f"{path} is too large to be sent to executors")
    return spec


def _batches(batches: Iterator[pa.RecordBatch], column: str, size) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        values = batch.column(column).to_pylist()
        start = total = 0
        for i, value in enumerate(values):
            total += size(value)
            if total > BATCH_CHARS or i == len(values) - 1:
                yield batch.slice(start, i + 1 - start), values[start : i + 1]
                start, total = i + 1, 0


def encode(docs: DataFrame, path: str, text_col: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of the text as array ``into`` and, if named, the text decoded from them.

    Columns of these names that are there already are replaced.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    docs = docs.select(F.col(text_col).alias("_text"), *(F.col(c) for c in docs.columns if c not in (into, decoded, "_text")))
    text_col = "_text"
    names = [*docs.columns[1:], into, *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for batch, texts in _batches(batches, text_col, lambda t: len(t or "")):
            found = bpe.encode([t or "" for t in texts])
            arrays = [*batch.columns[1:], pa.array(found, pa.list_(pa.int32()))]
            if decoded:
                arrays.append(pa.array([bpe.decode(ids) for ids in found], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    added = [T.StructField(into, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[1:], *added]))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of the token ids as column ``into``, which is replaced if it is there; null ids give empty text."""
    rows = rows.drop(into)
    names = [*rows.columns, into]
    spec = rows.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for batch, ids in _batches(batches, ids_col, lambda x: 4 * len(x or ())):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bpe.decode(x or ()) for x in ids], pa.string())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode`` returns, one row per input row."""
    rows = encode(docs.select("doc_id", "text"), path, into="ids", decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
