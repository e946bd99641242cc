"""Exact dedup, sharding, fixity and personal data against plain versions, with nulls, ties, repeats, clashing names and empty tables."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trajstats.llm import exact_dedup, pii, sharding, warc_fixity

SCHEMA = "doc_id long, text string, digest string, copies int, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, "c"), (None, "c"), (6, "ä" * 3000), (7, "ä" * 3000), (8, "B"), *[(100 + i, "hot") for i in range(60)], (5, "z")]


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t).cast("string")])
def test_exact_dedup(spark, digest):
    got = exact_dedup.exact_dedup(table(spark, ROWS), digest=digest, hot_parts=5, salts=4).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, keep[t or ""], len(groups[t or ""]), sha(t)) for i, t in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(sha(t) for t in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_survivors_and_empty(spark):
    got = exact_dedup.survivors(table(spark, ROWS))
    assert got.columns == ["doc_id", "text", "digest", "copies", "row"]
    assert Counter(r.text or "" for r in got.collect()) == Counter({t or "" for _, t in ROWS})
    assert exact_dedup.exact_dedup(table(spark, ROWS).limit(0)).count() == 0
    assert exact_dedup.survivors(table(spark, ROWS).limit(0)).count() == 0


def draw(key, children, path):
    weigh = lambda n: n if not isinstance(n, dict) else sum(map(weigh, n.values()))
    unit = lambda n: (int(hashlib.md5(f"{path}/{n}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return min((-math.log(unit(n)) / weigh(c), n) for n, c in children.items())[1]


def shard_of(key, tree):
    region = draw(key, tree, "")
    rack = draw(key, tree[region], f"/{region}") if len(tree[region]) > 1 else next(iter(tree[region]))
    shards = tree[region][rack]
    return draw(key, shards, f"/{region}/{rack}") if len(shards) > 1 else next(iter(shards))


def test_sharding(spark):
    rows = ROWS + [(i, f"t{i}") for i in range(1000, 1400)]
    got = sharding.place(table(spark, rows)).collect()
    key = lambda i: "" if i is None else str(i)
    tree = sharding.even_tree()
    grown = sharding.with_shard(tree)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), shard_of(key(i), tree), shard_of(key(i), grown)) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 24 for r in got)
    assert sharding.place(table(spark, ROWS).limit(0)).count() == 0


def test_weight_change_moves_rows_of_its_subtree_only(spark):
    tree = sharding.even_tree(2, 2, 2)
    heavier = {0: tree[0], 1: {2: 0, **tree[1]}} | {1: {0: tree[1][0], 1: {6: 1.0, 7: 3.0}}}
    rows = spark.range(3000).withColumn("k", F.col("id").cast("string"))
    a = sharding.assign(sharding.assign(rows, F.col("k"), tree, "old"), F.col("k"), heavier, "new").collect()
    moved = [(r.old, r.new) for r in a if r.old != r.new]
    assert moved and all(new >= 4 for _, new in moved)  # into the heavier region only
    assert all(new in (6, 7) for old, new in moved if old >= 4)  # and within it into the heavier rack
    zero = {0: {0: {0: 1.0, 1: 0.0}}}
    assert {r.s for r in sharding.assign(rows, F.col("k"), zero, "s").select("s").distinct().collect()} == {0}


PAGES = [(1, "u1", "<a>"), (2, None, None), (None, "u", "x"), (3, "u3", "ä" * 5000), *[(9, "same", "same")] * 40, *[(i, f"u{i}", "p" * (i % 700)) for i in range(20, 320)]]


def test_fixity_of_pages(spark):
    pages = spark.createDataFrame([(*p, 1, "s") for p in PAGES], "page_id long, url string, html string, start int, status string")
    got = warc_fixity.audit_pages(pages, per_archive=50).collect()
    text = lambda p: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if p[0] is None else p[0]}>\r\nWARC-Target-URI: {p[1] or ''}\r\nContent-Type: text/html\r\nContent-Length: {len((p[2] or '').encode())}\r\n\r\n{p[2] or ''}\r\n\r\n"
    part = lambda p: hashlib.md5(f"damage:{'' if p is None else p}".encode()).hexdigest()[:2]
    status = lambda p: {"00": "changed", "01": "changed", "02": "missing"}.get(part(p), "intact")
    assert Counter((r.page_id, r.sha256, r.length, r.status) for r in got) == Counter((p[0], sha(text(p)), len(text(p).encode()), status(p[0])) for p in PAGES)
    by = defaultdict(list)
    for r in got:
        by[r.archive].append((r.start, r.length))
    for spans in by.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
    assert warc_fixity.audit_pages(pages.limit(0)).count() == 0


def test_audit_finds_all_differences_and_looks_at_few_nodes(spark):
    left = [(a, s * 100, 100, f"h{a}-{s}") for a in range(3) for s in range(200)]
    right = [x for x in left if x[:2] != (1, 700)]
    right = [(a, s, n, "bad" if (a, s) == (2, 19900) else h) for a, s, n, h in right] + [(0, 50, 10, "new")]
    frame = lambda rows: spark.createDataFrame(rows, "archive long, start long, length long, sha256 string")
    got = {tuple(r) for r in warc_fixity.audit(frame(left), frame(right), span=300, fanout=4).collect()}
    assert got == {(1, 700, "missing"), (2, 19900, "changed"), (0, 50, "extra")}
    assert warc_fixity.audit(frame(left), frame(left), span=300, fanout=4).count() == 0


def plain_spans(t):
    luhn = lambda d: sum(x // 10 + x % 10 for i, c in enumerate(d[::-1]) for x in [int(c) * (1 + i % 2)]) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    cards = ((m, re.sub(r"[ -]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t))
    out += [("card", *m.span()) for m, d in cards if 14 <= len(d) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_spans_by_brute_force():
    import random

    draws = random.Random(3)
    for _ in range(8000):
        text = "".join(draws.choice("a1.@+- (0)9b8") for _ in range(draws.randint(0, 40)))
        assert pii.find_plain(text) == plain_spans(text), text
    for text in ("4111 1111-1111 1111", "+1 (017) 555-7713", "x 192.168.0.1.5 y 300.1.1.1", "a@b@c.de", "٣@a.bc"):
        assert pii.find_plain(text) == plain_spans(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("x [at] y (dot) org", "email", "x [at] y (dot) org"),
        ("to jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
        ("no 192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
        ("plus one two three four five six seven eight nine zero one", "phone", "plus one two three four five six seven eight nine zero one"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("ｂob＠ex.com", "email", "ｂob＠ex.com"),
        ("ab@c​d.org", "email", "ab@c​d.org"),
    ],
)
def test_disguises_map_back(text, kind, found):
    plain, added = pii.find_spans(text)
    assert (kind, found) in [(k, text[a:b]) for k, a, b in (*plain, *added)]


def test_ordinary_words_are_left_alone():
    for text in ("hard at work dot the end", "look at example.com the", "one of the two", "Of at and. It at the", "", "one two"):
        assert pii.find_spans(text) == ([], [])


def test_personal_data(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "x [at] y.org a@b.cd"), (3, "x [at] y.org a@b.cd"), (4, "9" * 50_000)]
    got = pii.personal_data(table(spark, rows)).collect()
    assert len(got) == len(rows)
    both = [r.spans for r in got if r.doc_id == 3]
    assert both[0] == both[1] and [(s.kind, s.start, s.end, s.added) for s in both[0]] == [("email", 0, 12, True), ("email", 13, 19, False)]
    assert pii.personal_data(table(spark, rows).limit(0)).count() == 0
    assert pii.redact("x a@b.cd y", [("email", 2, 8)]) == "x <email> y"


def test_query_of_personal_data(spark):
    from trajstats.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op2_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain_spans(texts[r.doc_id])
        count = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in pii.KINDS)
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{a}:{b}" for k, a, b in spans}


def test_many_spans_in_one_text():
    text = " ".join(f"u{i}@mail{i % 7}.com" if i % 3 else f"u{i} (at) mail{i % 7} dot com" for i in range(100_000))
    start = time.perf_counter()
    plain, added = pii.find_spans(text)
    assert time.perf_counter() - start < 60
    assert len(plain) == 66_666 and len(added) == 33_334
    assert all(text[a:b].startswith("u") and text[a:b].endswith("com") for _, a, b in (*plain, *added))
    short = " ".join(text.split(" ")[:400])
    plain, added = pii.find_spans(short)
    assert not any(k == m and a < d and c < b for k, a, b in added for m, c, d in plain) and len({*added}) == len(added)
