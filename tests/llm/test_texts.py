"""Join, tokens, decontamination and language model against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trajstats.llm import bpe, decontaminate, jaccard_join, pitman_yor
from trajstats.llm.common import text_buffers, written
from trajstats.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", 0, "x") for i, t in rows], "doc_id long, text string, node int, label string, ids int, item_ids string").repartition(4)


def components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return Counter((d, len(sets[i]), min(least[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def near_copies(seed, n, size, rate):
    draws = random.Random(seed)
    base = [f"w{draws.randint(0, 500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draws.randint(0, rate)):
            w[draws.randrange(len(w))] = f"v{draws.randint(0, 10_000)}"
        out.append(" ".join(w))
    return out


def join_rows():
    draws = random.Random(5)
    texts = near_copies(1, 60, 120, 5) + near_copies(2, 25, 9, 1) + near_copies(3, 12, 700, 14) + [" ".join(f"r{draws.randint(0, 99)}" for _ in range(draws.randint(1, 60))) for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{draws.randint(0, 9999)}" for _ in range(25)) for _ in range(30)]
    rows = [(i * 3 % 500 + 1000, t) for i, t in enumerate(texts)]
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "a b c d"), (7, "a b c d e"), (None, texts[0]), (None, "alone in the world of nulls"), (8, "x" * 40_000), rows[0], rows[0]]


@pytest.mark.parametrize("tile, hubs", [(384, 48), (8, 2)])
def test_components(spark, tile, hubs):
    rows = join_rows()
    got = jaccard_join.jaccard_components(table(spark, rows), tile=tile, hubs=hubs).collect()
    assert Counter(map(tuple, got)) == components(rows)


def test_representatives_and_empty(spark):
    rows = [(i, t) for i, (_, t) in enumerate(join_rows())]
    got = jaccard_join.representatives(table(spark, rows))
    want = {d for d, n, c in components(rows) if d == c}
    assert {r.doc_id for r in got.collect()} == want and got.columns == table(spark, rows).columns
    repeated = jaccard_join.representatives(table(spark, [(1, "a b c d e"), (1, "a b c d e f"), (1, "u v w x y"), (None, "a b c d e"), (None, None)])).collect()
    assert sorted(len(words(r.text)) for r in repeated) == [0, 5, 5, 6]
    assert jaccard_join.jaccard_components(table(spark, rows).limit(0)).count() == 0


def test_keys_of_sets_with_many_empty_groups():
    """Whatever the hashes, two linked sets share at least t keys of each, and one of each side's t-prefix."""
    draws = np.random.default_rng(6)
    sets = []
    for _ in range(1500):
        a = np.sort(draws.integers(0, 2**64, draws.integers(4, 16), dtype=np.uint64))
        sets += [a, np.sort(np.append(a, draws.integers(0, 2**64, 1, dtype=np.uint64)))]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    member = np.repeat(np.arange(len(sets)), sizes)
    low, high = jaccard_join._class_pairs(sizes)
    found = [set() for _ in sets]
    for classes in (low, high):
        keys, owner, t = jaccard_join.group_keys(np.concatenate(sets), starts, sizes, classes, member)
        for k, o in zip(keys.tolist(), owner.tolist()):
            found[o].add(k)
    linked = [(i, i + 1) for i in range(0, len(sets), 2) if jaccard_join.linked(sets[i], sets[i + 1])]
    assert len(linked) > 1000 and all(found[a] & found[b] for a, b in linked)


def test_bounds_never_lose_a_link():
    draws = np.random.default_rng(4)
    sets = [np.sort(draws.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(40)]
    for s in sets[:20]:
        sets.append(np.sort(np.concatenate([s[: draws.integers(150, 200)], draws.integers(0, 2**63, draws.integers(0, 30)).astype(np.uint64)])))
    tree = jaccard_join.CountTree(sets)
    for s, point in zip(sets, tree.points):
        near = set(tree.near(point, len(s)).tolist())
        assert {i for i, o in enumerate(sets) if jaccard_join.linked(s, o)} <= near


TEXTS = [None, "", " ", "Hello, world!  It's 2024…\n\n x", "<|endoftext|>a <|endoftext|><|endoftext|> b", "naïve ÜBER 漢字 🙂‍↔️ \u0085x y\x1c z", "a" * 3000, " " * 500 + "b", "\n\t don't'LL 'll", "0123456789" * 40]


def test_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")]
    got = bpe.encode(table(spark, rows), tokenizer_path(), decoded="decoded")
    assert got.columns == ["doc_id", "text", "node", "label", "item_ids", "ids", "decoded"]
    for r in got.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    back = bpe.decode(got.drop("decoded"), tokenizer_path()).collect()
    assert len(back) == len(rows) and all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode(table(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_encoder_on_every_sort_of_letter():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path()), bpe.TrieEncoder(bpe.read_spec(tokenizer_path()))
    runs = [c * n for c in ("-", "=", "Ã", "ÃÂ", " ", "\n", "ab") for n in (1, 2, 63, 64, 65, 127, 128, 129, 130, 400)]
    texts = runs + ["".join(map(chr, range(i, i + 64))) for i in range(0, 0x3100, 64)] + [f"a {chr(c)} b{chr(c)}{chr(c)} 1{chr(c)}" for c in range(0x2100)]
    assert own.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_items_by_brute_force(spark):
    draws = random.Random(8)
    item = lambda n: "".join(draws.choice("abcd ") for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate((5, 19, 20, 41, 80, 130))] + [(6, None), (7, "  "), (8, "Same Text of two items"), (9, "same text  of two items")]
    rows = [(0, None), (1, ""), (2, "SAME\ttext of two\nitems"), (None, items[5][1])]
    for i in range(80):
        text = list(draws.choice(items[:6])[1] or "")
        for _ in range(draws.randint(0, 8)):
            text.insert(draws.randrange(len(text) + 1), draws.choice("abcd"))
        for _ in range(draws.randint(0, 3)):
            if text:
                text.pop(draws.randrange(len(text)))
        rows.append((10 + i, item(draws.randint(0, 50)) + "".join(text) + item(draws.randint(0, 50))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 60):
        got = decontaminate.verdicts(table(spark, rows), bench, block_chars=block).collect()
        found = {(r.doc_id, i, d) for r in got for i, d in zip(r.item_ids, r.distances)}
        want = set()
        for d, t in rows:
            text = decontaminate.normal(t)
            for i, s in items:
                s = decontaminate.normal(s)
                if s and (least := least_distance(s, text)) <= len(s) // 20:
                    want.add((d, i, least))
        assert found == want and len(got) == len(rows)
    spans = {(r.doc_id, r.starts[0], r.ends[0]) for r in got if r.doc_id == 2}
    assert spans == {(2, 0, len(rows[2][1]))}
    clean = decontaminate.clean(table(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _, _ in want} and "item_ids" in clean.columns
    assert decontaminate.verdicts(table(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.verdicts(table(spark, rows).limit(0), bench).count() == 0


def test_language_model(spark):
    draws = random.Random(2)
    rows = [(i, " ".join(draws.choices([f"w{k}" for k in range(60)], [1 / (k + 1) for k in range(60)], k=draws.randint(0, 80)))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "W1 w2"), (5, "w1 w1"), (5, "w1 w1"), (302, "hot hot " * 3000), (303, "u" * 30_000)]
    got = pitman_yor.score_documents(table(spark, rows)).collect()
    key = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    tokens = [(i, [*words(t), None]) for i, t in rows]
    count = Counter(w for i, ts in tokens if key(i) for w in ts)
    n, v = sum(count.values()), len(count)
    base = lambda ts: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
    want = sorted((str(i), key(i) == 0, len(ts), sum(count[w] > 0 for w in ts), n, round(base(ts), 6)) for i, ts in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 0.02 * abs(sum(r.base_score for r in held))
    assert pitman_yor.score_documents(table(spark, rows).limit(0)).count() == 0
    lone = pitman_yor.score_documents(table(spark, [(i, "a") for i in range(40) if key(i) == 0])).collect()
    assert lone and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in lone)


def test_language_model_by_many_buckets(spark):
    """Rows that pass between buckets and parts depend on the data alone; sums in groups of groups change nothing."""
    draws = random.Random(4)
    rows = [(i, " ".join(f"w{int(draws.paretovariate(0.6)) % 3000}" for _ in range(draws.randint(20, 60)))) for i in range(500)] + [(None, "a b")] * 3
    docs, sent, scores = table(spark, rows), {}, {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = pitman_yor._answered

    def counting(shares, owners, parts, group):
        out = written(seen(shares, owners, parts, group))
        sent.setdefault(kind, []).append((owners, parts, out.count()))
        return out

    try:
        pitman_yor._answered = counting
        for kind, group in (("4", 256), ("64", 256), ("4 grouped", 2)):
            spark.conf.set("spark.sql.shuffle.partitions", kind.split()[0])
            found = pitman_yor.score_documents(docs, bucket_bytes=8000, share_contexts=100, group=group).collect()
            scores[kind] = sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found)
    finally:
        pitman_yor._answered = seen
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sent["4"] == sent["64"] and sent["4"][0][0] > 8 and sent["4"][0][1] > 1
    assert sent["4 grouped"][-1] == sent["4"][-1]
    assert scores["4"] == scores["64"] == scores["4 grouped"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_")]


def test_large_words_are_counted_exactly(spark):
    rows = [(i, "hot " * 30 + " ".join(f"x{i}_{k}" for k in range(60))) for i in range(200)] + [(None, "null " * 5000)]
    found = pitman_yor._large_words(table(spark, rows), 4).view(np.uint64).tolist()
    want = {pitman_yor.document_tokens(*text_buffers(pa.array([w])), 0, 1)[0][0] for w in ("hot", "null")}
    assert set(found) == want


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(0)
    customers, weight = np.full(4000, 200), np.full(4000, 3.0)
    tables = pitman_yor.seat(customers, weight, 0.5, rng)
    plain = []
    for _ in range(1500):
        t = 1
        for seated in range(1, 200):
            t += rng.random() < 3.0 / (3.0 + seated - 0.5 * t)
        plain.append(t)
    assert abs(tables.mean() - np.mean(plain)) < 0.35 and abs(tables.std() - np.std(plain)) < 0.35
    assert pitman_yor.seat(np.array([0, 1]), np.array([1.0, 1.0]), 0.5, rng).tolist() == [0, 1]


def test_probabilities_of_a_context_add_up():
    draws = np.random.default_rng(1)
    count = draws.geometric(0.2, 400) - 1
    row = {
        "words": np.sort(draws.integers(0, 2**63, 400).astype(np.uint64)).tobytes(), "word_pairs": np.ones(400, np.uint32).tobytes(), "word_count": count.astype(np.int64).tobytes(),
        "pair_context": np.full(400, 7, np.uint16).tobytes(), "pair_count": count.astype(np.uint32).tobytes(),
    }
    known = pitman_yor.Totals(words=float((count > 0).sum()), root_tables=float((count > 0).sum()))
    known.context_tables[7] = known.tables = float((count > 0).sum())
    known.context_tokens[7] = float(count.sum())
    none = np.zeros(0, np.uint64)
    for _ in range(6):
        p, sums = pitman_yor._seated(row, known, none, [1, 2, 3], 6, 4)
        known.context_tables, known.tables, known.root_tables = sums.context_tables, sums.tables, sums.root_tables
    assert abs(p[count > 0].sum() + p[count == 0].min() - 1) < 0.05


def test_contexts_stay_apart_in_a_large_vocabulary(spark):
    vocabulary, length, copies = 200_000, 1000, 4
    blocks = vocabulary // length
    rows = [(i, " ".join(f"v{k}" for k in range(i % blocks * length, (i % blocks + 1) * length))) for i in range(blocks * copies)]
    key = lambda i: zlib.crc32(str(i).encode()) % 10
    held = [r for r in pitman_yor.score_documents(table(spark, rows)).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    # Each word has one word before it, so the customers of a context share a table.
    seen = Counter(i % blocks for i, _ in rows if key(i))
    for r in held:
        c = seen[r.doc_id % blocks]
        assert c == 0 or abs(r.score / (length * math.log10((c - pitman_yor.D1) / (c + pitman_yor.S1))) - 1) < 0.02
