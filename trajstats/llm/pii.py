"""Personal data with disguises undone: transducers whose output keeps the place of each source character.

Plain identifiers (e-mail, IP, card, phone) are found in the text itself. Then the text is rewritten step
by step: letters that look like Latin ones, full-width forms and invisible characters; bracketed or spelled ``at`` and
``dot`` between parts of an address; runs of spelled digits. Every step maps each output character
to a source span. Identifiers found in the rewritten text are mapped back and added when they overlap no
plain span of their kind. Plain spans always stay.

``at`` and ``dot`` without brackets count only in an address that has both and ends in a common top domain, as in ``name at host dot org``;
spelled digits only in runs of three or more.

The finders run in time linear in the text: no start is tried twice over one run of characters.

Defined cases: a null or empty text has no spans; any ids, repeated rows and other columns pass through;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

# Characters that are read as others.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3", "з": "3", "б": "6",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
TOP_DOMAINS = "com org net edu gov mil int info biz name app dev io ai co me tv uk us ca au nz ie de at ch fr be lu nl es pt it se no dk fi pl cz hu ro gr tr ru ua jp kr cn in br mx ar cl eu".split()
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _full_width() -> dict[str, str]:
    return {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}


def _other_digits() -> dict[str, str]:
    """Decimal digits of the Arabic, extended Arabic and Devanagari blocks."""
    return {chr(first + i): str(i) for first in (0x660, 0x6F0, 0x966) for i in range(10)}


READ_AS = LOOKALIKES | _full_width() | _other_digits()
_LOOKALIKE = re.compile("[" + re.escape("".join(READ_AS)) + "]")
_INVISIBLE = re.compile("[" + INVISIBLE + "]+")

_DOT_WORD = r"(?:dot|punkt|punto|point)"
_AT_WORD = r"(?:at|arroba)"
_OPEN, _CLOSE = r"[ \t]?[\[({<][ \t]?", r"[ \t]?[\])}>][ \t]?"
_BRACKETED_AT = re.compile(rf"{_OPEN}(?:{_AT_WORD}|@){_CLOSE}", re.I)
_BRACKETED_DOT = re.compile(rf"{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}", re.I)
_TOP = "(?:" + "|".join(TOP_DOMAINS) + ")"
_PART = r"[A-Za-z0-9_%+-]{1,64}"
#: name [dot name ...] at host dot host [dot host ...], in words
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{_PART}(?: {_DOT_WORD} |\.)){{0,4}}{_PART} {_AT_WORD} (?:[A-Za-z0-9-]{{1,63}}(?: {_DOT_WORD} |\.)){{0,4}}[A-Za-z0-9-]{{1,63}} {_DOT_WORD} {_TOP}(?![A-Za-z0-9-])", re.I)
_SPELLED_DOT, _SPELLED_AT = re.compile(rf" {_DOT_WORD} ", re.I), re.compile(rf" {_AT_WORD} ", re.I)
_REST = re.compile(rf"(?:[A-Za-z0-9-]{{1,63}}(?: {_DOT_WORD} |\.)){{0,4}}{_TOP}(?![A-Za-z0-9-])", re.I)
_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
_DIGIT_RUN = re.compile(rf"(?<![A-Za-z0-9]){_DIGIT}(?:[ ,-]{{1,2}}(?:{_DIGIT}|[0-9](?![0-9A-Za-z])))*(?![A-Za-z0-9])", re.I)
_DIGIT_WORD = re.compile(rf"{_DIGIT}|[0-9]", re.I)

#: A text without any of these needs no rewriting.
_TRIGGER = re.compile(rf"[{re.escape(''.join(READ_AS))}{INVISIBLE}]|[\[({{<][ \t]?(?:{_AT_WORD}|@|{_DOT_WORD}|\.)[ \t]?[\])}}>]| {_DOT_WORD} |(?<![A-Za-z0-9]){_DIGIT}[ ,-]{{1,2}}(?:{_DIGIT}|[0-9])(?![A-Za-z])", re.I)


# ---------------------------------------------------------------- finders

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def find_emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one @; it starts with the local characters before it, after the match before."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            after = m.end()
            out.append((start, after))
        at = text.find("@", max(at + 1, after))
    return out


def find_ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))] if "." in text else []


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def find_cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                out.append(m.span())
    return out


def find_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15] if "+" in text else []


FINDERS = {"email": find_emails, "ip": find_ips, "card": find_cards, "phone": find_phones}


def find_plain(text: str) -> list[tuple[str, int, int]]:
    found = [(k, a, b) for k in KINDS for a, b in FINDERS[k](text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# ---------------------------------------------------------------- transducers


class Traced:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace spans, in order and apart, by texts; each new character stands for the whole span."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Traced("".join(text), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def read_lookalikes(t: Traced) -> Traced:
    t = t.rewritten([(*m.span(), "") for m in _INVISIBLE.finditer(t.text)])
    return t.rewritten([(*m.span(), READ_AS[m[0]]) for m in _LOOKALIKE.finditer(t.text)])


def join_addresses(t: Traced) -> Traced:
    edits = [(*m.span(), "@") for m in _BRACKETED_AT.finditer(t.text)] + [(*m.span(), ".") for m in _BRACKETED_DOT.finditer(t.text)]
    t = t.rewritten(_apart(edits))
    edits = []
    for m in _SPELLED.finditer(t.text):
        edits += [(*x.span(), "@") for x in _SPELLED_AT.finditer(t.text, *m.span())] + [(*x.span(), ".") for x in _SPELLED_DOT.finditer(t.text, *m.span())]
    t = t.rewritten(_apart(edits))
    after = [(*m.span(), ".") for m in _SPELLED_DOT.finditer(t.text) if _in_address(t.text, *m.span())]
    return t.rewritten(_apart(after))


def _in_address(text: str, a: int, b: int) -> bool:
    """Whether a spelled dot continues a host: the run before it holds an @, and a top domain follows, at once or after more dots."""
    start = a
    while start > max(0, a - 128) and (text[start - 1] in _LOCAL or text[start - 1] == "@"):
        start -= 1
    return "@" in text[start:a] and _REST.match(text, b) is not None


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def read_digits(t: Traced) -> Traced:
    """Runs of three or more digits in words become digits, blanks and hyphens between them go."""
    edits = []
    for m in _DIGIT_RUN.finditer(t.text):
        words = list(_DIGIT_WORD.finditer(t.text, *m.span()))
        if len(words) >= 3:
            for i, w in enumerate(words):
                end = words[i + 1].start() if i + 1 < len(words) else w.end()
                edits.append((w.start(), w.end(), DIGIT_WORDS.get(w[0].lower(), w[0])))
                if end > w.end():
                    edits.append((w.end(), end, ""))
    plus = re.compile(r"(?<![A-Za-z0-9])plus[ ,-]{1,2}(?=[0-9])", re.I)
    t = t.rewritten(edits)
    return t.rewritten([(*m.span(), "+") for m in plus.finditer(t.text)]) if edits else t


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and the spans that the rewriting adds; (kind, start, end) in order of start and kind."""
    plain = find_plain(text)
    if not _TRIGGER.search(text):
        return plain, []
    first = read_lookalikes(Traced(text))
    added: list[tuple[str, int, int]] = []
    # Spans of a kind never overlap, so the one before a place is the only one that may reach over it.
    taken: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for kind, start, end in plain:
        taken[kind].append((start, end))
    for t in (first, read_digits(join_addresses(first))):
        if t.text == text:
            continue
        for kind, a, b in find_plain(t.text):
            start, end = t.source(a, b)
            at = bisect_left(taken[kind], (end,))
            if not at or taken[kind][at - 1][1] <= start:
                taken[kind].insert(at, (start, end))
                added.append((kind, start, end))
    return plain, sorted(added, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


# ---------------------------------------------------------------- operator

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of each text as structs (kind, start, end, added), in code points, end exclusive."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text in batch.column("text"):
                plain, added = find_spans(text.as_py() or "")
                both = [(*s, False) for s in plain] + [(*s, True) for s in added]
                spans.append([dict(zip(("kind", "start", "end", "added"), s)) for s in sorted(both, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])

    rows = docs.select("doc_id", docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long,added:boolean>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
