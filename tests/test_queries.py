"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "corrected_observables", "equilibration_start", "radius_pairs", "connected_groups", "tracked_group", "radial_profile", "contact_enrichment", "against_control",
    "smoothed_series", "nearest_in_time", "member_stress", "displacement_curve", "stress_correlation", "two_stage_confinement", "framed_rows", "neighbour_bonds",
    "curvature_corrected", "mixed_pair_table", "feature_ranking", "silhouette", "stream_windowed_mean",
    "per_chain_confinement", "unwrapped_groups", "summary_files", "augmented_master", "combined_error",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def key(row):
    """Exact columns first, so that rows which differ in the last digits of a float still pair up; -0.0 is 0.0."""
    exact = tuple((v is not None, str(v)) for v in row if not isinstance(v, float))
    return exact, tuple(f"{v + 0.0:.5g}" for v in row if isinstance(v, float))


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=key)
    assert sorted(names) == cols and len(got) == len(want) and got
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 190


def test_radius_of_a_chain_of_one_and_of_coincident_beads(spark, tmp_path):
    """11 vectors: the last chain has one bead, and the first two beads lie together."""
    x = [[0.01 * ((7 * i + 3 * k) % 50) for k in range(64)] for i in range(1, 11)]
    rows = [(i, i % 3, v) for i, v in enumerate([x[0], *x])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(c.execute(f"select frame, chain_id, n_beads, rh from ({entry.oracle_sql()['hydrodynamic_radius']})").fetchall())
    got = sorted(tuple(r) for r in entry.queries()["hydrodynamic_radius"](spark, str(tmp_path)).select("frame", "chain_id", "n_beads", "rh").collect())
    assert len(got) == 63 and sum(r[3] is None for r in got) == 21
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == w[3] or close(g[3], w[3]) for g, w in zip(got, want))


def test_silhouette_of_copies_and_of_rows_without_label_or_text(spark, tmp_path):
    """Copies, a label twice for one text, rows without a label or a text: as in SQL."""
    texts = [(" a1B\n" * (1 + 7 * i % 5) + "x" * (i % 3)) for i in range(24)] + [None]
    docs = [(i, t, None if t is None else len(t)) for i, t in enumerate([*texts, *texts[:10], ""])]
    labels = [(i, None if i == 5 else i % 3) for i, _, n in docs if n != 0] + [(7, 2), (7, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(c.execute(f"select doc_id, label, s from ({entry.oracle_sql()['silhouette']})").fetchall(), key=str)
    got = sorted((tuple(r) for r in entry.queries()["silhouette"](spark, str(tmp_path)).select("doc_id", "label", "s").collect()), key=str)
    assert len(got) == 36 and [g[:2] for g in got] == [w[:2] for w in want] and all(close(g[2], w[2]) for g, w in zip(got, want))
