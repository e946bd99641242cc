"""Quality and toxicity on tables with known answers, and the pipeline against plain versions of its stages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_texts import components, least_distance

import corpus_pipeline
from trajstats.llm import decontaminate, quality, toxicity

SF = "/root/testdata/sf0.001"


def corpus(spark, n=240):
    draws = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = [draws.choice(["ba", "ce", "di", "fo", "gu"]) + draws.choice(["", "la", "mo", "ner"]) for _ in range(draws.randint(20, 80))]
        bad, rude = i % 3 == 0, i % 4 == 1
        if rude:
            for _ in range(4):
                w[draws.randrange(len(w))] = draws.choice(["idiot", "moron", "scum", "trash"])
        rows.append((i, (" | ".join(w) + " ###" * 9) if bad else " ".join(w) + ".", "x", 1))
        if i % 10:
            labels.append((i, None if i % 50 == 7 else int(not bad), int(rude)))
    rows += [(None, None, "x", 1), (n, "", "x", 1), (n + 1, None, "x", 1), rows[5], (n + 2, "z" * 50_000, "x", 1)]
    labels += [(5, labels[4][1], labels[4][2]), (None, 1, 1), (99_999, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, stats string, label int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def test_quality_of_held_out_rows(spark):
    docs, labels = corpus(spark)
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: int(i % 3 != 0) for i in range(240)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (fold(r.doc_id) == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)


def test_quality_without_labels(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score_documents(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_isotonic_is_the_best_rising_fit():
    draws = np.random.default_rng(2)
    weight = draws.integers(1, 5, 40).astype(float)
    good = np.minimum(weight, draws.integers(0, 5, 40))
    level = quality.isotonic(weight, good)
    mean = np.cumsum(np.concatenate([[0], good]))
    size = np.cumsum(np.concatenate([[0], weight]))
    for i in range(40):  # the min-max formula
        best = max(min((mean[b + 1] - mean[a]) / (size[b + 1] - size[a]) for b in range(i, 40)) for a in range(i + 1))
        assert level[i] == pytest.approx(best)


def test_toxicity_chain(spark):
    docs, labels = corpus(spark)
    marked = toxicity.weak_labels(docs, labels)
    got = toxicity.score_documents(docs, marked, ["insult", "contempt", "toxic"]).collect()
    assert len(got) == docs.count()
    truth = {i: i % 4 == 1 for i in range(240)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.toxic == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= p <= 1 for r in got for p in (r.p_insult, r.p_contempt, r.p_toxic))
    assert not any(r.toxic for r in got if r.doc_id is None or r.doc_id >= 240)
    none = toxicity.score_documents(docs, marked.filter("toxic = 0"), ["insult", "contempt", "toxic"]).collect()
    assert {r.p_toxic for r in none} == {0.0}
    assert toxicity.score_documents(docs.limit(0), marked, ["toxic"]).count() == 0


def test_terms_cover_many_toxic_words(spark):
    draws = random.Random(4)
    fill = ["".join(draws.choices("abcdefgh", k=5)) for _ in range(40)]
    bad = ["".join(draws.choices("klmnopqrst", k=12)) for _ in range(100)]
    rows = [(i, " ".join([*draws.choices(fill, k=20), *([bad[i // 2 % 100]] if i % 2 else [])])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = docs.select("doc_id", (docs.doc_id % 2).cast("int").alias("toxic"))
    held = [r for r in toxicity.score_documents(docs, labels, ["toxic"]).collect() if r.held_out]
    assert np.mean([r.toxic for r in held if r.doc_id % 2]) > 0.95 and np.mean([r.toxic for r in held if r.doc_id % 2 == 0]) < 0.05


def test_pipeline_by_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, stages = docs, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near duplicates", "decontamination", "tokens"]
    good = [(r.doc_id, r.text) for r in stages["quality"](spark, docs, SF).collect()]
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([truth[i] for i, _ in good if i in truth]) > 0.9
    last = {}
    for i, t in good:
        last[t] = max(i, last.get(t, i))
    rows = sorted((i, t) for t, i in last.items())
    rows = [(i, t) for i, t in rows if i in {d for d, _, c in components(rows) if d == c}]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {i: decontaminate.normal(t) for i, t in rows}
    starts = {i: {s for s in items if any(p in text[i] for _, p in decontaminate.pieces(s, len(s) // 20))} for i in text}
    want = {i: t for i, t in rows if not any(least_distance(s, text[i]) <= len(s) // 20 for s in starts[i])}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_tokens == len(r.ids) for r in got)
    assert kept.count() > len(got)
