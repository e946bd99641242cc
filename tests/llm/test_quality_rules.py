"""Quality rules: plain counts by brute force, cuts of long texts, the fit against a dense one, held-out labels, nulls and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from trajstats.llm import quality_rules as rules, queries

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def fields(counts):
    return counts.n_words, counts.word_chars, counts.n_symbols, counts.n_dup_lines, counts.n_repeat_words


TEXTS = [None, "", " \n\t", "one", "a b c a b c a b", "x y z\nx y z\n\nx y z\r\n x y z", "Ab ab AB ab Ab ab AB", "#*$ |<>&% ü𝒳ß", "w" * 20000 + " " + "w" * 20000 + " end", "a\x0bb\x0cc", "l\n" * 40, "no end\n", "\n\nno\nno"]


@pytest.mark.parametrize("piece", [5, 37, 1 << 18])
def test_counts_and_cuts(piece, monkeypatch):
    draws = random.Random(3)
    made = ["".join(draws.choices(["a", "b ", "\n", "ß", "𝒳", "#", "x y z ", "\t"], k=400)) for _ in range(20)]
    whole = {}
    for t in [*TEXTS, *made]:
        whole[t] = rules.features((t or "").encode())
    monkeypatch.setattr(rules, "PIECE", piece)
    for t in [*TEXTS, *made]:
        raw = (t or "").encode()
        assert fields(rules.counted(raw, lambda classes, kind: None)) == plain(t)
        at, share = rules.features(raw)
        assert np.array_equal(at, whole[t][0]) and np.allclose(share, whole[t][1])


def corpus(spark, n=160):
    draws = random.Random(5)
    clean, junk = ["the", "house", "stands", "near", "a", "lake", "and", "trees", "grow", "there."], ["BUY!!", "###", "win|", "$$$", "click", "NOW!!", "the", "free|"]
    texts = [" ".join(draws.choices(junk if i % 4 == 1 else clean, k=draws.randint(60, 90))) for i in range(n)]
    texts = [t + " " + " ".join(f"w{draws.randint(0, 999)}" for _ in range(60)) for t in texts]
    rows = [(i, t, "k", i % 7) for i, t in enumerate(texts)] + [(None, texts[0], "k", 1), (n, None, None, None), (n + 1, "", "x", 1), (3, texts[3], "k", 3), (n + 2, "word " * 300, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, fold int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 1)) for i in range(n) if i % 3] + [(None, 0), (6, None), (7, 0), (7, 1)], "doc_id long, quality int")
    return docs, labels, texts


def test_verdicts(spark):
    docs, labels, texts = corpus(spark)
    got = rules.verdicts(docs, labels).collect()
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    text_of = {i: t for i, t in given}
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    for r in got:
        assert fields(r) == plain(text_of[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and 0 <= r.probability <= 1
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 3 == 0]
    assert np.mean([r.kept == (r.doc_id % 4 != 1) for r in unseen if not r.base_failed]) > 0.95 and sum(not r.base_failed for r in unseen) > 40
    one = rules.verdicts(docs, labels.filter("quality = 1")).collect()
    assert all(r.kept != r.base_failed for r in one) and {r.probability for r in one} == {1.0}
    none = rules.verdicts(docs, labels.limit(0)).collect()
    assert {r.probability for r in none} == {1.0}
    assert rules.verdicts(docs.limit(0), labels).count() == 0


def test_fit_against_dense_newton(spark):
    docs, labels, texts = corpus(spark, 80)
    penalty = 1e-3
    model = rules.fit(docs, labels, penalty=penalty)
    known = {r.doc_id: r.quality for r in labels.groupBy("doc_id").agg({"quality": "max"}).withColumnRenamed("max(quality)", "quality").collect() if r.quality is not None and r.doc_id is not None and r.doc_id < 80}
    rows = [r for r in docs.collect() if r.doc_id in known]
    x = np.zeros((len(rows), rules.KINDS * rules.CLASSES))
    for i, r in enumerate(rows):
        at, share = rules.features(r.text.encode())
        x[i, at] = share * rules.GAIN
    y = np.array([known[r.doc_id] for r in rows], float)
    base, small = np.linalg.qr(x.T)
    z = np.hstack([small.T, np.ones((len(y), 1))])
    w, ridge = np.zeros(z.shape[1]), penalty * np.diag([*np.ones(z.shape[1] - 1), 0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (p - y) / len(y) + ridge @ w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge + 1e-10 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    dense = z @ w
    found = model.weights[-1] + x @ model.weights[:-1]
    loss = lambda s, v: np.logaddexp(0, -(2 * y - 1) * s).mean() + penalty / 2 * (v @ v)
    assert loss(found, model.weights[:-1]) <= 1.01 * loss(dense, w[:-1])
    assert np.abs(1 / (1 + np.exp(-found)) - 1 / (1 + np.exp(-dense))).max() < 1e-3


def test_platt():
    score = np.linspace(-4, 4, 41)
    total = np.full(41, 1000.0)
    a, b = rules.platt(score, total / (1 + np.exp(-(1.7 * score - 0.4))), total)
    assert a == pytest.approx(1.7, abs=0.02) and b == pytest.approx(-0.4, abs=0.02)


def test_query_on_given_tables(spark):
    got = {r.doc_id: r for r in queries.op12_quality_rules(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert fields(got[r.doc_id]) == plain(r.text)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [i for i in labels if not got[i].base_failed]
    assert np.mean([got[i].kept == bool(labels[i]) for i in judged]) > 0.9
