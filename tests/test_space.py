"""Neighbour joins, groups, tracking and assembly against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajstats.operators import contacts, groups, histograms as hist, neighbors
from trajstats.plans import space_plans
from trajstats.plans.views import SPECIES

BOX = np.array([30.0, 20.0, 9.0])


def beads(seed=0, n=150, frames=2):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(frames):
        x = rng.uniform(0, 1, (n, 3)) * BOX
        x[0], x[1] = [0.1, 5, 5], [29.9, 5, 5]  # across the boundary
        x[2] = x[3] = [10.0, 10.0, 4.0]  # coincident, on a cell edge
        x[4] = [30.0, 20.0, 9.0]  # at the upper corner, same as the origin
        rows += [(f, i, i // 3, "abc"[i // 3 % 3], *map(float, x[i]), *map(float, BOX)) for i in range(n)]
    return pd.DataFrame(rows, columns=["frame", "bead_id", "chain_id", "species", "x", "y", "z", "lx", "ly", "lz"])


def brute(pdf, radius, other=None):
    found = set()
    for f, g in pdf.groupby("frame"):
        h = g if other is None else other[other.frame == f]
        a, b = g[["x", "y", "z"]].to_numpy(), h[["x", "y", "z"]].to_numpy()
        d = a[:, None] - b[None]
        d -= BOX * np.round(d / BOX)
        for i, j in zip(*np.nonzero(np.sqrt((d**2).sum(2)) < radius)):
            p, q = int(g.bead_id.iloc[i]), int(h.bead_id.iloc[j])
            if other is not None or p < q:
                found.add((f, p, q))
    return found


@pytest.mark.parametrize("factor,hot,radius", [(1.0, None, 2.5), (2.0, 3, 2.5), (1.0, 5, 4.0)])
def test_radius_pairs(spark, factor, hot, radius):
    pdf = beads()
    out = neighbors.radius_pairs(spark.createDataFrame(pdf), ["frame"], "bead_id", radius, carry=["chain_id"], cell_factor=factor, hot_cell_rows=hot).toPandas()
    got = set(zip(out.frame, out.a_bead_id, out.b_bead_id))
    assert len(out) == len(got)
    assert got == brute(pdf, radius)
    assert (out.a_chain_id == out.a_bead_id // 3).all() and (out.b_chain_id == out.b_bead_id // 3).all()


def test_radius_join(spark):
    pdf = beads(1)
    a, b = pdf[pdf.species != "c"], pdf[pdf.species == "c"]
    out = neighbors.radius_join(spark.createDataFrame(a), spark.createDataFrame(b), ["frame"], 2.0, a_cols=["bead_id"], b_cols=["bead_id"], a_id="bead_id", hot_cell_rows=4).toPandas()
    assert set(zip(out.frame, out.a_bead_id, out.b_bead_id)) == brute(a, 2.0, b)
    assert len(out) == len(brute(a, 2.0, b))


def test_radius_joins_are_dealt_by_beads(spark, monkeypatch):
    """Few bytes may make many pairs: the partitions follow the beads and are not coalesced."""
    monkeypatch.setattr(neighbors, "DEALT_ROWS", 20)
    pdf = beads(7)
    df = spark.createDataFrame(pdf)
    pairs = neighbors.radius_pairs(df, ["frame"], "bead_id", 4.0)
    assert pairs.rdd.getNumPartitions() == 15
    assert {(r.frame, r.a_bead_id, r.b_bead_id) for r in pairs.collect()} == brute(pdf, 4.0)
    met = neighbors.radius_join(df, df, ["frame"], 2.0, a_cols=["bead_id"], b_cols=["bead_id"], a_id="bead_id")
    assert met.rdd.getNumPartitions() == 15


@pytest.mark.parametrize("rows,radius", [(96, 4.0), (4, 2.5)])
def test_pair_counts_without_pairs(spark, monkeypatch, rows, radius):
    monkeypatch.setattr(neighbors, "CELL_ROWS", rows)
    monkeypatch.setattr(neighbors, "TILE_ROWS", 2 * rows)
    pdf = beads(2, 400).assign(kind=lambda f: f.bead_id % 4)
    found = brute(pdf, radius)
    df = spark.createDataFrame(pdf)
    got = contacts.kind_contacts(df, ["frame"], "bead_id", radius, ["kind"], same="chain_id").collect()
    cells, bins = {}, {}
    x = {f: g[["x", "y", "z"]].to_numpy() for f, g in pdf.groupby("frame")}
    for f, p, q in found:
        k = (f, *sorted((p % 4, q % 4)))
        cells[k] = [a + b for a, b in zip(cells.get(k, (0, 0)), (1, p // 3 == q // 3))]
        d = x[f][p] - x[f][q]
        b = (f, int(np.sqrt(((d - BOX * np.round(d / BOX)) ** 2).sum()) / 0.5))
        bins[b] = bins.get(b, 0) + 1
    assert {(r.frame, *sorted((r.a_kind, r.b_kind))): [r.n, r.n_same] for r in got} == cells
    assert {(r.frame, r.i): r.n for r in neighbors.pair_counts(df, ["frame"], "bead_id", radius, width=0.5).collect()} == bins
    pairs = neighbors.radius_pairs(df, ["frame"], "bead_id", radius, carry=["chain_id", "species", "kind"])
    by_pair = contacts.position_contacts(pairs, [], position="kind", exclusion=1).collect()
    counted = contacts.kind_contacts(df, ["frame"], "bead_id", radius, ["species", "kind"], same="chain_id")
    assert set(by_pair) == set(contacts.position_cells(counted, [], position="kind", exclusion=1).collect())


@pytest.mark.parametrize("carried,rows,n,radius", [(16, 40, 150, 2.5), (2, 8_192, 150, 2.5), (5, 8_192, 40, 12.0)])
def test_chain_pairs_without_pairs(spark, monkeypatch, carried, rows, n, radius):
    """Chains of 1 to many beads, some of two species, cells in parts or whole: as the distinct pairs of the beads' pairs."""
    monkeypatch.setattr(neighbors, "HOME_ROWS", 8)
    monkeypatch.setattr(neighbors, "GROUP_ROWS", rows)
    monkeypatch.setattr(neighbors, "CARRIED_BEADS", carried)
    monkeypatch.setattr(neighbors, "BLOCK", (16, 32))
    monkeypatch.setattr(neighbors, "CHAIN_PAIRS", 1_000)
    pdf = beads(8, n).assign(chain_id=lambda f: f.bead_id % 9 * (f.bead_id % 4), species=lambda f: [("abc"[c % 3] if c % 5 else "ab"[b % 2]) for c, b in zip(f.chain_id, f.bead_id)])
    pdf = pdf.assign(x=[np.nan if b == 7 else x for b, x in zip(pdf.bead_id, pdf.x)])
    pdf["chain_id"] = pdf.chain_id.where(pdf.bead_id % 9 > 2, 100 + pdf.bead_id // 3)
    df = spark.createDataFrame(pdf)
    pairs = neighbors.radius_pairs(df, ["frame"], "bead_id", radius, carry=["chain_id", "species"])
    want = contacts.species_contacts(pairs, [], "frame").collect()
    got = contacts.chain_contacts(df, [], "frame", "bead_id", radius).collect()
    assert set(got) == set(want) and len(got) == len(want) == 9


def test_species_contacts_makes_no_row_for_a_pair(spark, tmp_path, monkeypatch):
    """300 vectors at one place make 44,850 pairs of beads a frame; a group gives a row for two species at most."""
    made = []
    first = neighbors._first_of_chains
    monkeypatch.setattr(neighbors, "radius_pairs", None)
    monkeypatch.setattr(neighbors, "_first_of_chains", lambda *a: made.append(a) or first(*a))
    rows = [(i, i % 3, [0.001 * (i % 7)] * 64) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = space_plans.species_contacts(spark, str(tmp_path))
    counts = {(r.i, r.j): r["count"] for r in out.collect()}
    # 60 chains, 15 of a species, all in touch.
    assert counts == {(i, j): 21 * (15 * 14 if i == j else 225) for i in SPECIES for j in SPECIES}
    assert len(made) == 1


def test_components_path_star_and_tie(spark):
    path = [(0, i, i + 1) for i in range(1, 60)]
    star = [(1, 5, k) for k in range(6, 40)]
    nodes = [(0, i) for i in range(1, 62)] + [(1, i) for i in range(4, 40)]
    out = groups.connected_components(spark.createDataFrame(nodes, "frame int, chain_id long"), spark.createDataFrame(path + star, "frame int, u long, v long"), ["frame"])
    labels = {(r.frame, r.chain_id): r.label for r in out.collect()}
    assert all(labels[(0, i)] == 1 for i in range(1, 61)) and labels[(0, 61)] == 61
    assert labels[(1, 4)] == 4 and all(labels[(1, k)] == 5 for k in range(5, 40))
    tie = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 3), (0, 4, 3)], "frame int, chain_id long, label long")
    assert groups.largest_groups(tie, ["frame"]).first().label == 1


@pytest.mark.parametrize("seed,n,radius", [(3, 120, 2.0), (4, 400, 1.2), (5, 60, 8.0)])
def test_components_by_radius_without_all_pairs(spark, seed, n, radius):
    pdf = beads(seed, n)
    want = {}
    for f, g in pdf.groupby("frame"):
        top = {c: c for c in g.chain_id}
        for _, p, q in [e for e in brute(pdf, radius) if e[0] == f]:
            low, high = sorted((top[p // 3], top[q // 3]))
            top = {c: low if t == high else t for c, t in top.items()}
        want |= {(f, c): t for c, t in top.items()}
    got = {(r.frame, r.chain_id): r.label for r in groups.radius_components(spark.createDataFrame(pdf), ["frame"], "bead_id", radius).collect()}
    assert got == want and (n < 100 or len(set(want.values())) > 1)


def test_sure_links_of_a_crowd_grow_with_beads_only(spark):
    """2,000 beads at one place make two million pairs and 1,999 links."""
    crowd = spark.range(2000).selectExpr("0 AS frame", "id AS bead_id", "id AS chain_id", "5.0D AS x", "5.0D AS y", "5.0D AS z", "30.0D AS lx", "30.0D AS ly", "30.0D AS lz")
    assert neighbors.sure_links(crowd, ["frame"], 2.0).count() == 1999


def follow(frames):
    """Sequential reference: each pick maximises the match with the pick before."""
    picks, previous = {}, set()
    for f in sorted(frames):
        options = frames[f]
        if not options:
            previous = set()
            continue
        if not previous:
            best = min(options, key=lambda s: (-len(s), min(s)))
        else:
            best = max(options, key=lambda s: (len(s & previous), len(s & previous) / len(s | previous), -abs(len(s) - len(previous)), len(s), -min(s)))
        picks[f], previous = min(best), best
    return picks


def test_tracking_matches_sequential_rule(spark):
    rng = np.random.default_rng(3)
    rows, frames = [], {}
    for f in range(13):
        frames[f] = []
        if f == 6:
            continue  # an empty frame
        label = rng.integers(0, 5, 12) if f != 9 else np.arange(12) % 2 + 20
        present = rng.permutation(12)[: 8 if f % 3 else 12] + (100 if f == 4 else 0)
        for k in set(label):
            members = {int(c) for c, m in zip(present, label) if m == k}
            if members:
                frames[f].append(members)
                rows += [("s", f, c, min(members)) for c in members]
    g = spark.createDataFrame(rows, "system string, frame int, chain_id long, label long")
    every = spark.createDataFrame([("s", f) for f in range(13)], "system string, frame int")
    got = {r.frame: r.label for r in groups.tracked_group(g, ["system"], frames=every).collect()}
    assert got == follow(frames)


def test_persistence_and_residence(spark):
    rows = [(0, f, c, c == 1 or (c == 2 and f < 5)) for f in range(20) for c in (1, 2, 3)]
    inside = spark.createDataFrame(rows, "system int, frame int, chain_id long, inside boolean")
    assert [r.chain_id for r in groups.persistent_members(inside, ["system"]).collect()] == [1]
    cls = {r.chain_id: r.residence for r in groups.residence_class(inside.withColumn("w", F.expr("frame div 5")), ["system"], "w").collect()}
    assert cls == {1: "inside", 2: "ambiguous", 3: "outside"}


def test_unwrapped_group_is_compact(spark):
    pos = [(0, i, float(x % 30), 5.0, 5.0, 30.0, 20.0, 9.0) for i, x in enumerate([28, 29.5, 31, 32.5, 34])]
    p = spark.createDataFrame(pos, "frame int, chain_id long, x double, y double, z double, lx double, ly double, lz double")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "frame int, u long, v long")
    g = groups.connected_components(p, edges, ["frame"])
    xs = {r.chain_id: r.x for r in groups.unwrapped_groups(g, edges, p, ["frame"]).collect()}
    assert [xs[i] for i in range(5)] == pytest.approx([28, 29.5, 31, 32.5, 34])


def test_assembly_by_radius_follows_the_same_tree(spark, monkeypatch):
    """Dense enough to reach around the box, where the tree decides the images."""
    monkeypatch.setattr(neighbors, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 8)
    df = spark.createDataFrame(beads(6, 150).drop(columns="chain_id").rename(columns={"bead_id": "chain_id"}))
    pairs = neighbors.radius_pairs(df, ["frame"], "chain_id", 2.5)
    edges = pairs.select("frame", F.col("a_chain_id").alias("u"), F.col("b_chain_id").alias("v"))
    g = groups.connected_components(df.select("frame", "chain_id"), edges, ["frame"])
    cols = ["frame", "chain_id", "label", *[F.round(c, 9).alias(c) for c in "xyz"]]
    want = groups.unwrapped_groups(g, edges, df, ["frame"]).select(*cols).collect()
    assert set(groups.radius_unwrapped(df, ["frame"], 2.5).select(*cols).collect()) == set(want) and len(want) == 300


def test_profile_conserves_weight_and_closes_last_bin(spark):
    rows = spark.createDataFrame([(0, 0.0, 1.0), (0, 2.0, 2.0), (0, 4.0, 4.0), (1, 4.1, 8.0)], "frame int, r double, w double")
    out = hist.radial_profile(rows.withColumn("s", F.lit("a")), ["s"], "frame", "r", "w", 1.0, 4).toPandas().sort_values("bin")
    volume = 4 / 3 * np.pi * ((out.bin + 1) ** 3 - out.bin**3)
    assert (out.density * volume * 2).tolist() == pytest.approx([1, 0, 2, 4])
    assert (out.n_frames == 2).all()


def test_shape_rg_and_hydrodynamic_radius(spark):
    x = np.random.default_rng(5).normal(size=(300, 3)) * [5, 3, 1]
    pdf = pd.DataFrame(x, columns=["xu", "yu", "zu"]).assign(frame=0, chain_id=0, bead_id=range(300), mass=2.0)
    df = spark.createDataFrame(pdf)
    s = hist.shape_eigenvalues(df, ["frame"], ("xu", "yu", "zu")).first()
    assert [s.l1, s.l2, s.l3] == pytest.approx(sorted(np.linalg.eigvalsh(np.cov(x.T)), reverse=True))
    assert hist.com_and_rg(df, ["frame"]).first().rg == pytest.approx(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean()))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = (1 / d[np.triu_indices(300, 1)]).sum()
    got = neighbors.inverse_distance_sums(df, ["frame"], "bead_id", tile_rows=64).first().inv_sum
    assert got == pytest.approx(want)
