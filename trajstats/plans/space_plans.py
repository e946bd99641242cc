"""Neighbour joins, groups, profiles and contact maps over the embedding frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trajstats.functions.scalars import DALTON_PER_A3_TO_MG_ML
from trajstats.operators import contacts, groups, histograms as hist, neighbors
from trajstats.plans.registry import query
from trajstats.plans.series_plans import rounded
from trajstats.plans.views import FRAMES_SQL, PAIR_DISTANCE_SQL, frames, table, with_ctes
from trajstats.session import cut_lineage

R = 6.0
CARRY = ["chain_id", "species", "bead_type", "mass"]
PAIRS_SQL = f"""pr AS (
  SELECT a.frame, a.bead_id AS a_id, b.bead_id AS b_id, a.chain_id AS a_chain, b.chain_id AS b_chain, a.species AS a_sp, b.species AS b_sp,
         a.bead_type AS a_t, b.bead_type AS b_t, {PAIR_DISTANCE_SQL} AS dist
  FROM fr a JOIN fr b ON a.frame = b.frame AND a.bead_id < b.bead_id WHERE {PAIR_DISTANCE_SQL} < {R}::DOUBLE)"""
EDGES_SQL = "ed AS (SELECT DISTINCT frame, least(a_chain, b_chain) AS u, greatest(a_chain, b_chain) AS v FROM pr WHERE a_chain <> b_chain)"
# Labels by repeated minimum over neighbours, fixed number of rounds above the graph diameter.
COMPONENTS_SQL = """nd AS (SELECT DISTINCT frame, chain_id FROM fr),
nb AS (SELECT frame, u, v FROM ed UNION ALL SELECT frame, v, u FROM ed UNION ALL SELECT frame, chain_id, chain_id FROM nd),
walk AS (
  SELECT frame, chain_id, chain_id AS label, 0 AS k FROM nd
  UNION ALL
  SELECT n.frame, n.u, min(w.label), any_value(w.k) + 1 FROM walk w JOIN nb n ON n.frame = w.frame AND n.v = w.chain_id WHERE w.k < 40 GROUP BY n.frame, n.u),
cc AS (SELECT frame, chain_id, min(label) AS label FROM walk GROUP BY 1, 2)"""
COMP = (FRAMES_SQL, PAIRS_SQL, EDGES_SQL, COMPONENTS_SQL)


def comp_sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(COMP + more) + "\n" + select


def _pairs(spark, d) -> DataFrame:
    return neighbors.radius_pairs(frames(spark, d), ["frame"], "bead_id", R, carry=CARRY)


def _type_pairs(spark, d) -> DataFrame:
    """Pairs of beads counted by frame and types."""
    return contacts.kind_contacts(frames(spark, d), ["frame"], "bead_id", R, ["bead_type"])


def _groups(spark, d) -> DataFrame:
    return groups.radius_components(frames(spark, d), ["frame"], "bead_id", R)


@query("radius_pairs", "J1 P3 P4 P5 M1 M2", with_ctes(FRAMES_SQL, PAIRS_SQL, select="""
SELECT frame, a_id AS a_bead_id, b_id AS b_bead_id, round(dist, 6) AS dist FROM pr"""))
def radius_pairs(spark, d):
    return rounded(_pairs(spark, d).select("frame", "a_bead_id", "b_bead_id", "dist"), "dist", places=6)


@query("radius_join_solute", "J2", with_ctes(FRAMES_SQL, select=f"""
SELECT a.frame, a.bead_id AS a_bead_id, b.bead_id AS b_bead_id, round({PAIR_DISTANCE_SQL}, 6) AS dist FROM fr a JOIN fr b ON a.frame = b.frame
WHERE a.species <> 'solute' AND b.species = 'solute' AND {PAIR_DISTANCE_SQL} < 8.0::DOUBLE"""))
def radius_join_solute(spark, d):
    fr = frames(spark, d)
    out = neighbors.radius_join(fr.filter("species <> 'solute'"), fr.filter("species = 'solute'"), ["frame"], 8.0, a_cols=["bead_id"], b_cols=["bead_id"], a_id="bead_id")
    return rounded(out, "dist", places=6)


@query("chain_edges", "J3", with_ctes(FRAMES_SQL, PAIRS_SQL, EDGES_SQL, select="SELECT frame, u, v FROM ed"))
def chain_edges(spark, d):
    return neighbors.chain_edges(_pairs(spark, d), ["frame"])


@query("connected_groups", "C1 M5", comp_sql("SELECT frame, chain_id, label FROM cc"))
def connected_groups(spark, d):
    return _groups(spark, d)


LARGEST_SQL = """sz AS (SELECT frame, label, count(*) AS size FROM cc GROUP BY 1, 2),
lg AS (SELECT frame, label, size FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY size DESC, label) AS rn FROM sz) WHERE rn = 1)"""


@query("largest_group", "C2", comp_sql("SELECT frame, label, size FROM lg", LARGEST_SQL))
def largest_group(spark, d):
    return groups.largest_groups(_groups(spark, d), ["frame"])


METRICS_SQL = """gm AS (SELECT frame, max(size) AS largest, count(*) AS n_groups, CAST(sum(size) AS BIGINT) AS n_members, max(size) / sum(size) AS fraction FROM sz GROUP BY 1)"""


@query("group_metrics", "C3", comp_sql("SELECT frame, largest, n_groups, n_members, round(fraction, 8) AS fraction FROM gm", LARGEST_SQL, METRICS_SQL))
def group_metrics(spark, d):
    return rounded(groups.group_metrics(_groups(spark, d), ["frame"]), "fraction")


@query("fraction_summary", "C4", comp_sql("""
SELECT round(avg(fraction), 8) AS mean, round(max(fraction), 8) AS max, round(quantile_cont(fraction, 0.95), 8) AS p95, avg((fraction > 0.1)::INT) AS share_over,
       (max(frame) - min(frame)) / (count(*) - 1) AS mean_gap FROM gm""", LARGEST_SQL, METRICS_SQL))
def fraction_summary(spark, d):
    out = groups.fraction_summary(groups.group_metrics(_groups(spark, d), ["frame"]), [], "frame")
    return rounded(out, "mean", "max", "p95")


# Tracking in SQL: score every next group of every group, then walk the best matches.
TRACK_SQL = LARGEST_SQL + """,
cand AS (
  SELECT a.frame, a.label, a.size, b.label AS nl, b.size AS ns, (SELECT count(*) FROM cc x JOIN cc y ON x.chain_id = y.chain_id
    WHERE x.frame = a.frame AND x.label = a.label AND y.frame = b.frame AND y.label = b.label) AS ov
  FROM sz a JOIN sz b ON b.frame = a.frame + 1),
nxt AS (SELECT frame, label, nl FROM (SELECT *, row_number() OVER (PARTITION BY frame, label
    ORDER BY ov DESC, ov / (size + ns - ov) DESC, abs(ns - size), ns DESC, nl) AS rn FROM cand) WHERE rn = 1),
tr AS (SELECT frame, label FROM lg WHERE frame = 0 UNION ALL SELECT nxt.frame + 1, nxt.nl FROM tr JOIN nxt ON nxt.frame = tr.frame AND nxt.label = tr.label)"""


def _tracked(spark, d):
    g = _groups(spark, d).withColumn("system", F.lit("all"))
    return g, groups.tracked_group(g, ["system"])


@query("tracked_group", "C5", comp_sql("SELECT frame, label FROM tr", TRACK_SQL))
def tracked_group(spark, d):
    return _tracked(spark, d)[1].drop("system")


MEMBER_SQL = TRACK_SQL + """,
mb AS (SELECT cc.frame, cc.chain_id, tr.label IS NOT NULL AS inside FROM cc LEFT JOIN tr ON tr.frame = cc.frame AND tr.label = cc.label)"""


def _members(spark, d):
    g, t = _tracked(spark, d)
    return groups.membership(g, t, ["system"])


@query("tracked_membership", "M6 C5", comp_sql("SELECT frame, chain_id, inside FROM mb", MEMBER_SQL))
def tracked_membership(spark, d):
    return _members(spark, d).drop("system")


@query("persistent_members", "C6", comp_sql("""
SELECT chain_id, count(*) AS n_inside FROM mb WHERE inside GROUP BY 1 HAVING count(*) >= greatest(1, ceil(0.30 * 21))""", MEMBER_SQL))
def persistent_members(spark, d):
    return groups.persistent_members(_members(spark, d), ["system"], share=0.30).select("chain_id", "n_inside")


@query("residence_class", "C7", comp_sql("""
SELECT chain_id, CAST(sum(hit) AS BIGINT) AS n_hits, count(*) AS n_windows,
       CASE WHEN sum(hit) >= greatest(1, ceil(0.3 * count(*))) THEN 'inside' WHEN sum(hit) <= floor(0.1 * count(*)) THEN 'outside' ELSE 'ambiguous' END AS residence
FROM (SELECT chain_id, frame // 3 AS w, CASE WHEN sum(inside::INT) >= greatest(1, ceil(0.5 * count(*))) THEN 1 ELSE 0 END AS hit FROM mb GROUP BY 1, 2) GROUP BY 1""", MEMBER_SQL))
def residence_class(spark, d):
    m = _members(spark, d).withColumn("window", F.expr("frame div 3"))
    return groups.residence_class(m, ["system"], "window", frame_share=0.5, inside_share=0.3).drop("system")


CHAIN_SQL = """ch AS (SELECT frame, chain_id, any_value(species) AS species, sum(mass * xu) / sum(mass) AS cx, sum(mass * yu) / sum(mass) AS cy, sum(mass * zu) / sum(mass) AS cz,
  sum(mass) AS mass, count(*) AS n_beads FROM fr GROUP BY 1, 2)"""


def _chains(spark, d):
    return hist.centre_of_mass(frames(spark, d), ["frame", "chain_id", "species"])


@query("occupancy_radius", "C8", comp_sql("""
SELECT ch.chain_id, round(avg(inside::INT), 8) AS occupancy, round(avg(CASE WHEN inside THEN sqrt(pow(cx - mx, 2) + pow(cy - my, 2) + pow(cz - mz, 2)) / sqrt(vx + vy + vz) END), 8) AS r_over_rms
FROM ch JOIN mb USING (frame, chain_id) JOIN mo USING (frame) WHERE k >= 3 GROUP BY 1""", MEMBER_SQL, CHAIN_SQL, """
mo AS (SELECT frame, count(*) AS k, avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz, var_pop(cx) AS vx, var_pop(cy) AS vy, var_pop(cz) AS vz FROM ch JOIN mb USING (frame, chain_id) WHERE inside GROUP BY 1)"""))
def occupancy_radius(spark, d):
    com = _chains(spark, d).join(_members(spark, d).drop("system"), ["frame", "chain_id"])
    return rounded(groups.occupancy_radius(com, [], pos=("cx", "cy", "cz")), "occupancy", "r_over_rms")


@query("inner_outer", "C9 P1 M8", comp_sql("""
SELECT frame, species, CAST(sum(inside::INT) AS BIGINT) AS n_inner, sum(CASE WHEN inside THEN mass ELSE 0 END) AS mass_inner, CAST(sum(1 - inside::INT) AS BIGINT) AS n_outer,
       sum(CASE WHEN inside THEN 0 ELSE mass END) AS mass_outer FROM ch JOIN mb USING (frame, chain_id) GROUP BY 1, 2""", MEMBER_SQL, CHAIN_SQL))
def inner_outer(spark, d):
    ch = _chains(spark, d).withColumnRenamed("mass_total", "mass").join(_members(spark, d).drop("system"), ["frame", "chain_id"])
    return groups.inner_outer(ch, ["frame"])


def _tree_sql(rounds: int) -> str:
    """Shifts along the tree of ``groups.spanning_shifts`` from the links e0 (frame, a, b, oa, ob, d0, d1, d2), as the CTE ``moved``: rounds written out, paths walked step by step."""
    out = []
    shifts = lambda f: ", ".join(f(f"d{k}") + f" AS d{k}" for k in range(3))
    for r in range(rounds):
        out.append(f"""t{r} AS MATERIALIZED (SELECT frame, b AS node, a AS up, d0, d1, d2 FROM e{r} QUALIFY row_number() OVER (PARTITION BY frame, b ORDER BY a, oa, ob) = 1),
w{r} AS (SELECT * FROM t{r} UNION ALL SELECT w.frame, w.node, t.up, {shifts(lambda c: f"w.{c} + t.{c}")} FROM w{r} w JOIN t{r} t ON t.frame = w.frame AND t.node = w.up),
f{r} AS MATERIALIZED (SELECT w.frame, w.node, w.up AS root, w.d0, w.d1, w.d2 FROM w{r} w LEFT JOIN t{r} t ON t.frame = w.frame AND t.node = w.up WHERE t.node IS NULL),
x{r} AS (SELECT e.frame, coalesce(p.root, a) AS a, coalesce(q.root, b) AS b, oa, ob, {shifts(lambda c: f"e.{c} + coalesce(p.{c}, 0) - coalesce(q.{c}, 0)")} FROM e{r} e LEFT JOIN f{r} p ON p.frame = e.frame AND p.node = e.a LEFT JOIN f{r} q ON q.frame = e.frame AND q.node = e.b),
e{r + 1} AS MATERIALIZED (SELECT frame, least(a, b) AS a, greatest(a, b) AS b, oa, ob, {shifts(lambda c: f"CASE WHEN a > b THEN -{c} ELSE {c} END")} FROM x{r} WHERE a <> b QUALIFY row_number() OVER (PARTITION BY frame, least(a, b), greatest(a, b) ORDER BY oa, ob) = 1)""")
    moved = "SELECT * FROM f0"
    for r in range(1, rounds):
        moved = f"""SELECT m.frame, m.node, coalesce(f.root, m.root) AS root, {shifts(lambda c: f"m.{c} + coalesce(f.{c}, 0)")} FROM ({moved}) m LEFT JOIN f{r} f ON f.frame = m.frame AND f.node = m.root"""
        moved += f" UNION ALL SELECT f.* FROM f{r} f WHERE NOT EXISTS (SELECT 1 FROM {' UNION ALL SELECT 1 FROM '.join(f'f{k} g WHERE g.frame = f.frame AND g.node = f.node' for k in range(r))})"
    return ",\n".join([*out, f"moved AS ({moved})"])


_IMAGE = lambda c, box: f"(q.{c} - p.{c}) - {box}::DOUBLE * round_even((q.{c} - p.{c}) / {box}::DOUBLE, 0)"


@query("unwrapped_groups", "C10", "WITH RECURSIVE " + FRAMES_SQL + f""",
cm AS (SELECT frame, chain_id, sum(mass * xu) / sum(mass) AS ux, sum(mass * yu) / sum(mass) AS uy, sum(mass * zu) / sum(mass) AS uz FROM fr GROUP BY 1, 2),
nd AS MATERIALIZED (SELECT frame, chain_id, ((ux % 100.0::DOUBLE) + 100.0::DOUBLE) % 100.0::DOUBLE AS x, ((uy % 100.0::DOUBLE) + 100.0::DOUBLE) % 100.0::DOUBLE AS y, ((uz % 120.0::DOUBLE) + 120.0::DOUBLE) % 120.0::DOUBLE AS z FROM cm),
e0 AS MATERIALIZED (SELECT frame, a, b, a AS oa, b AS ob, d0, d1, d2 FROM (SELECT p.frame, p.chain_id AS a, q.chain_id AS b, {_IMAGE('x', 100.0)} AS d0, {_IMAGE('y', 100.0)} AS d1, {_IMAGE('z', 120.0)} AS d2 FROM nd p JOIN nd q ON p.frame = q.frame AND p.chain_id < q.chain_id) WHERE sqrt(d0 * d0 + d1 * d1 + d2 * d2) < {2.5 * R}),
""" + _tree_sql(5) + """
SELECT nd.frame, nd.chain_id, coalesce(m.root, nd.chain_id) AS label, round(o.x + coalesce(d0, 0), 5) AS x, round(o.y + coalesce(d1, 0), 5) AS y, round(o.z + coalesce(d2, 0), 5) AS z
FROM nd LEFT JOIN moved m ON m.frame = nd.frame AND m.node = nd.chain_id JOIN nd o ON o.frame = nd.frame AND o.chain_id = coalesce(m.root, nd.chain_id)""")
def unwrapped_groups(spark, d):
    box = ["lx", "ly", "lz"]
    nodes = hist.centre_of_mass(frames(spark, d), ["frame", "chain_id", *box], names=("x", "y", "z"))
    nodes = cut_lineage(nodes.select("frame", "chain_id", *box, *[F.pmod(F.col(p), F.col(length)).alias(p) for p, length in zip("xyz", box)]))
    out = groups.radius_unwrapped(nodes, ["frame"], 2.5 * R)
    return rounded(out.select("frame", "chain_id", "label", "x", "y", "z"), "x", "y", "z", places=5)


# --- profiles --------------------------------------------------------------------------

CENTRE_SQL = "ce AS (SELECT frame, species, sum(mass * xu) / sum(mass) AS cx, sum(mass * yu) / sum(mass) AS cy, sum(mass * zu) / sum(mass) AS cz FROM fr GROUP BY 1, 2)"


def profile_sql(rows: str, keys: str, weight: str, width: float, n_bins: int, factor: str = "1.0") -> str:
    """Zero-filled shell density of a CTE with (keys, frame, r, weight)."""
    return f"""ph AS (SELECT {keys}, frame, least(floor(r / {width}::DOUBLE), {n_bins - 1}) AS bin, sum({weight}) AS h FROM {rows} WHERE r <= {width * n_bins}::DOUBLE GROUP BY ALL),
pg AS (SELECT DISTINCT {keys}, frame FROM {rows}),
pz AS (SELECT {keys}, frame, b.b AS bin, coalesce(ph.h, 0.0) AS h FROM pg CROSS JOIN range({n_bins}) b(b) LEFT JOIN ph USING ({keys}, frame) WHERE ph.bin = b.b OR ph.bin IS NULL),
pd AS (SELECT g.*, b.b AS bin FROM pg g CROSS JOIN range({n_bins}) b(b)),
pf AS (SELECT pd.*, coalesce(ph.h, 0.0) AS h FROM pd LEFT JOIN ph USING ({keys}, frame, bin)),
prof AS (SELECT {keys}, CAST(bin AS INTEGER) AS bin, (bin + 0.5::DOUBLE) * {width}::DOUBLE AS r_mid, avg(h) * {factor} / any_value(v) AS density, stddev_samp(h) * {factor} / any_value(v) AS sd,
  stddev_samp(h) / sqrt(count(*)) * {factor} / any_value(v) AS sem, count(*) AS n_frames
  FROM (SELECT *, 4.0::DOUBLE / 3 * pi() * {width}::DOUBLE * {width} * {width} * (pow(bin + 1, 3) - pow(bin, 3)) AS v FROM pf) GROUP BY {keys}, bin)"""


def _strip_unused(sql: str) -> str:
    return "\n".join(line for line in sql.split("\n") if not line.startswith("pz AS"))


@query("radial_profile", "A1 P5 P6 M3 M7", with_ctes(FRAMES_SQL, CENTRE_SQL, """
rr AS (SELECT frame, species, mass, sqrt(pow(xu - cx, 2) + pow(yu - cy, 2) + pow(zu - cz, 2)) AS r FROM fr JOIN ce USING (frame, species))""",
    _strip_unused(profile_sql("rr", "species", "mass", 20.0, 15, "1660.5390666::DOUBLE")), select="""
SELECT species, bin, r_mid, round(density, 8) AS density, round(sd, 8) AS sd, round(sem, 8) AS sem, n_frames FROM prof"""))
def radial_profile(spark, d):
    fr = frames(spark, d)
    r = hist.distance_from_centre(fr, hist.centre_of_mass(fr, ["frame", "species"]), ["frame", "species"], ("xu", "yu", "zu"))
    return rounded(hist.radial_profile(r, ["species"], "frame", "r", "mass", 20.0, 15, factor=DALTON_PER_A3_TO_MG_ML), "density", "sd", "sem")


@query("solute_profile", "A2 P3 P4", with_ctes(FRAMES_SQL, """
sc AS (SELECT frame, sum(mass * xu) / sum(mass) AS ux, sum(mass * yu) / sum(mass) AS uy, sum(mass * zu) / sum(mass) AS uz FROM fr WHERE species <> 'solute' GROUP BY 1),
wc AS (SELECT frame, ((ux % 100) + 100) % 100 AS cx, ((uy % 100) + 100) % 100 AS cy, ((uz % 120) + 120) % 120 AS cz FROM sc),
dd AS (SELECT frame, 'solute' AS species, mass, x - cx AS dx, y - cy AS dy, z - cz AS dz FROM fr JOIN wc USING (frame) WHERE species = 'solute'),
rr AS (SELECT frame, species, mass, sqrt(pow(dx - 100.0 * round_even(dx / 100.0, 0), 2) + pow(dy - 100.0 * round_even(dy / 100.0, 0), 2) + pow(dz - 120.0 * round_even(dz / 120.0, 0), 2)) AS r FROM dd)""",
    _strip_unused(profile_sql("rr", "species", "mass", 5.0, 10, "1660.5390666::DOUBLE")), select="""
SELECT species, bin, r_mid, round(density, 8) AS density, round(sd, 8) AS sd, round(sem, 8) AS sem, n_frames FROM prof"""))
def solute_profile(spark, d):
    fr = frames(spark, d)
    centre = hist.centre_of_mass(fr.filter("species <> 'solute'"), ["frame"])
    r = hist.distance_from_centre(fr.filter("species = 'solute'"), centre, ["frame"], box=("lx", "ly", "lz"))
    return rounded(hist.radial_profile(r, ["species"], "frame", "r", "mass", 5.0, 10, factor=DALTON_PER_A3_TO_MG_ML), "density", "sd", "sem")


@query("box_centre_profile", "A3", with_ctes(FRAMES_SQL, """
cm AS (SELECT frame, species, chain_id, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy, sum(mass * z) / sum(mass) AS cz, sum(mass) AS w FROM fr GROUP BY 1, 2, 3),
rr AS (SELECT frame, species, w, sqrt(pow(cx - 50, 2) + pow(cy - 50, 2) + pow(cz - 60, 2)) AS r FROM cm)""",
    _strip_unused(profile_sql("rr", "species", "w", 5.0, 12, "1660.5390666::DOUBLE")),
    """nh AS (SELECT species, least(floor(r / 5.0), 11) AS bin, count(*) AS c FROM rr WHERE r <= 60 GROUP BY 1, 2)""", select="""
SELECT species, p.bin, r_mid, round(density, 8) AS mass_density, round(coalesce(c, 0) / n_frames / (4.0::DOUBLE / 3 * pi() * 125.0::DOUBLE * (pow(p.bin + 1, 3) - pow(p.bin, 3))), 12) AS number_density, round(sem, 8) AS sem
FROM prof p LEFT JOIN nh USING (species, bin)"""))
def box_centre_profile(spark, d):
    com = hist.centre_of_mass(frames(spark, d), ["frame", "species", "chain_id", "lx", "ly", "lz"], pos=("x", "y", "z"))
    r = com.withColumn("r", F.sqrt((F.col("cx") - F.col("lx") / 2) ** 2 + (F.col("cy") - F.col("ly") / 2) ** 2 + (F.col("cz") - F.col("lz") / 2) ** 2))
    mass = hist.radial_profile(r, ["species"], "frame", "r", "mass_total", 5.0, 12, factor=DALTON_PER_A3_TO_MG_ML)
    number = hist.radial_profile(r, ["species"], "frame", "r", None, 5.0, 12).select("species", "bin", F.round("density", 12).alias("number_density"))
    return rounded(mass.withColumnRenamed("density", "mass_density").select("species", "bin", "r_mid", "mass_density", "sem"), "mass_density", "sem").join(number, ["species", "bin"])


RDF_SQL = """cm AS (SELECT frame, chain_id, ((sum(mass * x) / sum(mass)) % 100.0) AS x, ((sum(mass * y) / sum(mass)) % 100.0) AS y, ((sum(mass * z) / sum(mass)) % 120.0) AS z FROM fr GROUP BY 1, 2),
cp AS (SELECT a.frame, """ + PAIR_DISTANCE_SQL + """ AS dist FROM cm a JOIN cm b ON a.frame = b.frame AND a.chain_id < b.chain_id),
cn AS (SELECT frame, count(*) AS n FROM cm GROUP BY 1 HAVING count(*) >= 2),
ch AS (SELECT frame, least(floor(dist / 3.0), 9) AS bin, count(*) AS h FROM cp WHERE dist < 30.0 GROUP BY 1, 2),
cs AS (SELECT bin, sum(h / (n / 1200000.0::DOUBLE * n * 4.0::DOUBLE / 3 * pi() * 27.0::DOUBLE * (pow(bin + 1, 3) - pow(bin, 3)))) AS s FROM ch JOIN cn USING (frame) GROUP BY 1),
gr AS (SELECT CAST(b.b AS INTEGER) AS bin, (b.b + 0.5::DOUBLE) * 3.0::DOUBLE AS r_mid, coalesce(s, 0.0) / (SELECT count(*) FROM cn) AS g FROM range(10) b(b) LEFT JOIN cs ON cs.bin = b.b)"""


def _rdf(spark, d):
    com = hist.centre_of_mass(frames(spark, d), ["frame", "chain_id", "lx", "ly", "lz"], pos=("x", "y", "z"), names=("x", "y", "z"))
    per_frame = com.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("lx") * F.col("ly") * F.col("lz")).alias("volume"))
    com = cut_lineage(com.drop("mass_total", "n_beads"))
    counts = neighbors.pair_counts(com, ["frame"], "chain_id", 30.0, width=3.0).select("frame", F.least("i", F.lit(9)).alias("bin"), F.col("n").alias("h"))
    counts = counts.groupBy("frame", "bin").agg(F.sum("h").alias("h"))
    return cut_lineage(hist.distribution_from_counts(counts, per_frame, [], "frame", 3.0, 10))


@query("pair_distribution", "A4 J14", with_ctes(FRAMES_SQL, RDF_SQL, select="SELECT bin, r_mid, round(g, 8) AS g FROM gr"))
def pair_distribution(spark, d):
    return rounded(_rdf(spark, d), "g")


@query("distribution_summary", "A5", with_ctes(FRAMES_SQL, RDF_SQL, select="""
SELECT round(max(g), 8) AS peak, round(avg(g) FILTER (r_mid >= 20), 8) AS tail_mean, round(stddev_samp(g) / avg(g), 8) AS cv FROM gr"""))
def distribution_summary(spark, d):
    rdf = _rdf(spark, d)
    out = hist.distribution_summary(rdf, [], 20.0).crossJoin(F.broadcast(hist.profile_cv(rdf, [], "g")))
    return rounded(out, "peak", "tail_mean", "cv")


@query("com_and_rg", "A6 M12", with_ctes(FRAMES_SQL, """
c0 AS (SELECT frame, chain_id, sum(mass * xu) / sum(mass) AS cx, sum(mass * yu) / sum(mass) AS cy, sum(mass * zu) / sum(mass) AS cz FROM fr GROUP BY 1, 2)""", select="""
SELECT frame, chain_id, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(any_value(cz), 6) AS cz, count(*) AS n_beads,
       round(sqrt(sum(mass * (pow(xu - cx, 2) + pow(yu - cy, 2) + pow(zu - cz, 2))) / sum(mass)), 6) AS rg FROM fr JOIN c0 USING (frame, chain_id) GROUP BY 1, 2"""))
def com_and_rg(spark, d):
    return rounded(hist.com_and_rg(frames(spark, d), ["frame", "chain_id"]).drop("mass_total"), "cx", "cy", "cz", "rg", places=6)


@query("chain_rg_series", "A7", with_ctes(FRAMES_SQL, """
c0 AS (SELECT frame, chain_id, sum(mass * xu) / sum(mass) AS cx, sum(mass * yu) / sum(mass) AS cy, sum(mass * zu) / sum(mass) AS cz FROM fr GROUP BY 1, 2),
rg AS (SELECT frame, chain_id, sqrt(sum(mass * (pow(xu - cx, 2) + pow(yu - cy, 2) + pow(zu - cz, 2))) / sum(mass)) AS rg FROM fr JOIN c0 USING (frame, chain_id) WHERE frame % 2 = 0 GROUP BY 1, 2)""", select="""
SELECT chain_id, round(avg(rg), 6) AS mean, round(stddev_samp(rg), 6) AS sd, round(stddev_samp(rg) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM rg GROUP BY 1"""))
def chain_rg_series(spark, d):
    from trajstats.operators.rollups import mean_sem
    rg = hist.com_and_rg(frames(spark, d).filter("frame % 2 = 0"), ["frame", "chain_id"])
    return rounded(mean_sem(rg, ["chain_id"], "rg"), "mean", "sd", "sem", places=6)


@query("hydrodynamic_radius", "A8 J14", with_ctes(FRAMES_SQL, """
iv AS (SELECT frame, chain_id, sum(CASE WHEN r > 0 THEN 1 / r END) AS s FROM (SELECT a.frame, a.chain_id, sqrt(pow(a.xu - b.xu, 2) + pow(a.yu - b.yu, 2) + pow(a.zu - b.zu, 2)) AS r FROM fr a JOIN fr b ON a.frame = b.frame AND a.chain_id = b.chain_id AND a.bead_id < b.bead_id) GROUP BY 1, 2),
cn AS (SELECT frame, chain_id, count(*) AS n FROM fr GROUP BY 1, 2)""", select="SELECT frame, chain_id, n AS n_beads, CASE WHEN n >= 2 AND s > 0 THEN round(n * n / (2 * s), 6) END AS rh FROM cn LEFT JOIN iv USING (frame, chain_id)"))
def hydrodynamic_radius(spark, d):
    fr = frames(spark, d)
    sums = neighbors.inverse_distance_sums(fr, ["frame", "chain_id"], "bead_id")
    counts = fr.groupBy("frame", "chain_id").agg(F.count(F.lit(1)).alias("n_beads"))
    return rounded(hist.hydrodynamic_radius(sums, counts, ["frame", "chain_id"]).drop("inv_sum"), "rh", places=6)


SHAPE_SQL = """sh0 AS (SELECT frame, species, var_samp(xu) AS a, var_samp(yu) AS b, var_samp(zu) AS c, covar_samp(xu, yu) AS d, covar_samp(yu, zu) AS e, covar_samp(xu, zu) AS f, count(*) AS n FROM fr GROUP BY 1, 2),
sh1 AS (SELECT *, (a + b + c) / 3 AS q FROM sh0), sh2 AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM sh1),
sh3 AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)) / (2 * p * p * p)))) / 3 AS phi FROM sh2),
sh4 AS (SELECT frame, species, n, q, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM sh3),
shape AS (SELECT frame, species, n, l1, 3 * q - l1 - l3 AS l2, l3 FROM sh4)"""


def _shape(spark, d):
    return hist.shape_eigenvalues(frames(spark, d), ["frame", "species"], ("xu", "yu", "zu"))


@query("shape_eigenvalues", "A9 M9", with_ctes(FRAMES_SQL, SHAPE_SQL, select="SELECT frame, species, n, round(l1, 4) AS l1, round(l2, 4) AS l2, round(l3, 4) AS l3 FROM shape"))
def shape_eigenvalues(spark, d):
    return rounded(_shape(spark, d), "l1", "l2", "l3", places=4)


@query("surface_tension", "B25", with_ctes(FRAMES_SQL, SHAPE_SQL, """
md0 AS (SELECT species, 80e-10::DOUBLE AS r, l1 * 1e-10 AS l1, l2 * 1e-10 AS l2, l3 * 1e-10 AS l3 FROM shape WHERE l1 > 0 AND l2 > 0 AND l3 > 0),
md1 AS (SELECT species, r * pow(l1, 1.0::DOUBLE / 3) / pow(l2 * l3, 1.0::DOUBLE / 6) - r AS a, r * pow(l2, 1.0::DOUBLE / 3) / pow(l1 * l3, 1.0::DOUBLE / 6) - r AS b, r * pow(l3, 1.0::DOUBLE / 3) / pow(l1 * l2, 1.0::DOUBLE / 6) - r AS c FROM md0),
md2 AS (SELECT species, pow(a + b, 2) + pow(a + c, 2) + pow(b + c, 2) AS p, pow(a - b, 2) + pow(a - c, 2) + pow(b - c, 2) AS m FROM md1),
md3 AS (SELECT species, avg(p) AS p, avg(m) AS m, stddev_samp(p) / sqrt(count(*)) AS ps, stddev_samp(m) / sqrt(count(*)) AS ms, count(*) AS n FROM md2 GROUP BY 1),
md4 AS (SELECT *, 15 * 1.3806e-23 * 300 / (16 * pi()) / p AS st_1, 45 * 1.3806e-23 * 300 / (16 * pi()) / m AS st_2 FROM md3)""", select="""
SELECT species, n, round(st_1 * 1e6, 8) AS st_1, round(st_2 * 1e6, 8) AS st_2, round((st_1 + st_2) / 2 * 1e6, 8) AS st,
       round(sqrt(pow(st_1 * ps / p, 2) + pow(st_2 * ms / m, 2)) / 2 * 1e6, 8) AS st_sem FROM md4"""))
def surface_tension(spark, d):
    out = hist.surface_tension(_shape(spark, d), ["species"], F.lit(80.0), F.lit(300.0))
    return out.select("species", "n", *[F.round(F.col(c) * 1e6, 8).alias(c) for c in ("st_1", "st_2", "st", "st_sem")])


# --- contact maps ----------------------------------------------------------------------

@query("species_contacts", "A10 M10", with_ctes(FRAMES_SQL, PAIRS_SQL, """
cpair AS (SELECT DISTINCT frame, least(a_chain, b_chain) AS u, greatest(a_chain, b_chain) AS v, CASE WHEN a_chain < b_chain THEN a_sp ELSE b_sp END AS su, CASE WHEN a_chain < b_chain THEN b_sp ELSE a_sp END AS sv FROM pr WHERE a_chain <> b_chain),
dirs AS (SELECT su AS i, sv AS j FROM cpair UNION ALL SELECT sv, su FROM cpair)""", select="""
SELECT i, j, count(*) AS count, round(count(*) / 21, 8) AS per_frame, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM dirs GROUP BY 1, 2"""))
def species_contacts(spark, d):
    cells = contacts.chain_contacts(frames(spark, d), [], "frame", "bead_id", R)
    n = frames(spark, d).agg(F.count_distinct("frame").alias("n_frames"))
    out = contacts.membership(cells, []).crossJoin(F.broadcast(n))
    return out.select("i", "j", "count", F.round(F.col("count") / F.col("n_frames"), 8).alias("per_frame"), F.round("f", 8).alias("share"))


TYPE_CELLS_SQL = "tc AS (SELECT least(a_t, b_t) AS i, greatest(a_t, b_t) AS j, count(*) AS count FROM pr GROUP BY 1, 2)"


@query("type_contacts", "A11", with_ctes(FRAMES_SQL, PAIRS_SQL, TYPE_CELLS_SQL, select="""
SELECT i, j, count FROM tc UNION ALL SELECT j, i, count FROM tc WHERE i <> j"""))
def type_contacts(spark, d):
    return contacts.type_contacts(_type_pairs(spark, d), [], n="n")


def _position_cells(spark, d):
    fr = frames(spark, d).withColumn("position", F.col("bead_id") % 5)
    return contacts.position_cells(contacts.kind_contacts(fr, ["frame"], "bead_id", 12.0, ["species", "position"], same="chain_id"), [], exclusion=2)


POSITION_SQL = """pp AS (
  SELECT a.chain_id = b.chain_id AS same, least(a.species, b.species) AS sa, greatest(a.species, b.species) AS sb,
         CASE WHEN a.species > b.species THEN b.bead_id % 5 ELSE a.bead_id % 5 END AS i, CASE WHEN a.species > b.species THEN a.bead_id % 5 ELSE b.bead_id % 5 END AS j
  FROM fr a JOIN fr b ON a.frame = b.frame AND a.bead_id < b.bead_id WHERE """ + PAIR_DISTANCE_SQL + """ < 12.0::DOUBLE),
pb AS (SELECT sa, sb, i, j, same FROM pp UNION ALL SELECT sa, sb, j, i, same FROM pp WHERE sa = sb AND i <> j),
pm AS (SELECT sa, sb, i, j, count(*) AS "full", count(*) FILTER (NOT same) AS "inter", count(*) FILTER (same AND abs(i - j) > 2) AS "intra",
       count(*) FILTER (NOT same OR abs(i - j) > 2) AS combined FROM pb GROUP BY ALL)"""


@query("position_contacts", "A12", with_ctes(FRAMES_SQL, POSITION_SQL, select="SELECT * FROM pm"))
def position_contacts(spark, d):
    return _position_cells(spark, d)


@query("position_contact_axis", "A54 A20", with_ctes(FRAMES_SQL, POSITION_SQL, """
ax AS (SELECT * FROM (VALUES ('alpha', 0, false), ('beta', 5, false), ('gamma', 10, true), ('solute', 15, false)) v(sp, off, rev)),
pl AS (SELECT sa, sb, a.off + CASE WHEN a.rev THEN 4 - i ELSE i END AS i, b.off + CASE WHEN b.rev THEN 4 - j ELSE j END AS j, combined FROM pm JOIN ax a ON a.sp = sa JOIN ax b ON b.sp = sb)""", select="""
SELECT i, j, combined FROM pl UNION ALL SELECT j, i, combined FROM pl WHERE sa <> sb"""))
def position_contact_axis(spark, d):
    cells = _position_cells(spark, d)
    lengths = frames(spark, d).groupBy("species").agg(F.lit(5).cast("long").alias("length")).withColumn("rank", F.col("species"))
    return contacts.on_global_axis(cells, lengths, ["gamma"]).select("i", "j", "combined")


@query("solute_position_contacts", "A13", with_ctes(FRAMES_SQL, """
sc AS (SELECT frame, chain_id, (sum(mass * x) / sum(mass)) % 100.0 AS x, (sum(mass * y) / sum(mass)) % 100.0 AS y, (sum(mass * z) / sum(mass)) % 120.0 AS z FROM fr WHERE species = 'solute' GROUP BY 1, 2)""", select=f"""
SELECT b.species, b.bead_id % 5 AS position, count(*) AS count FROM sc a JOIN fr b ON a.frame = b.frame AND b.species <> 'solute' WHERE {PAIR_DISTANCE_SQL} < 10.0::DOUBLE GROUP BY 1, 2"""))
def solute_position_contacts(spark, d):
    fr = frames(spark, d).withColumn("position", F.col("bead_id") % 5)
    com = hist.centre_of_mass(fr.filter("species = 'solute'"), ["frame", "chain_id", "lx", "ly", "lz"], pos=("x", "y", "z"), names=("x", "y", "z"))
    pairs = neighbors.radius_join(fr.filter("species <> 'solute'"), com, ["frame"], 10.0, a_cols=["species", "position"], b_cols=["chain_id"], a_id="bead_id")
    return pairs.groupBy(F.col("a_species").alias("species"), F.col("a_position").alias("position")).agg(F.count(F.lit(1)).alias("count"))


@query("solute_type_contacts", "A14", comp_sql(f"""
SELECT b.bead_type, count(*) AS count FROM sc a JOIN big b ON a.frame = b.frame WHERE {PAIR_DISTANCE_SQL} < 10.0::DOUBLE GROUP BY 1""", LARGEST_SQL, """
sc AS (SELECT frame, chain_id, (sum(mass * x) / sum(mass)) % 100.0 AS x, (sum(mass * y) / sum(mass)) % 100.0 AS y, (sum(mass * z) / sum(mass)) % 120.0 AS z FROM fr WHERE species = 'solute' GROUP BY 1, 2),
big AS (SELECT fr.* FROM fr JOIN cc USING (frame, chain_id) JOIN lg USING (frame, label) WHERE species <> 'solute')"""))
def solute_type_contacts(spark, d):
    fr = frames(spark, d)
    com = hist.centre_of_mass(fr.filter("species = 'solute'"), ["frame", "chain_id", "lx", "ly", "lz"], pos=("x", "y", "z"), names=("x", "y", "z"))
    g = _groups(spark, d)
    biggest = g.join(groups.largest_groups(g, ["frame"]).select("frame", "label"), ["frame", "label"], "left_semi")
    beads = fr.filter("species <> 'solute'").join(biggest.select("frame", "chain_id"), ["frame", "chain_id"], "left_semi")
    pairs = neighbors.radius_join(beads, com, ["frame"], 10.0, a_cols=["bead_type"], b_cols=["chain_id"], a_id="bead_id")
    return pairs.groupBy(F.col("a_bead_type").alias("bead_type")).agg(F.count(F.lit(1)).alias("count"))


TYPE_COUNT_SQL = "tn AS (SELECT label AS t, count(*) AS n FROM embeddings GROUP BY 1)"
POSSIBLE_SQL = TYPE_COUNT_SQL + """,
pn AS (SELECT a.t AS i, b.t AS j, CASE WHEN a.t = b.t THEN a.n::DOUBLE * greatest(a.n - 1, 0) / 2 ELSE a.n::DOUBLE * b.n END AS possible FROM tn a JOIN tn b ON a.t <= b.t),
tcp AS (SELECT i, j, possible, coalesce(count, 0) AS count FROM pn LEFT JOIN tc USING (i, j))"""


def _type_counts(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("bead_type")).agg(F.count(F.lit(1)).alias("n"))


def _type_cells(spark, d):
    upper = contacts.type_contacts(_type_pairs(spark, d), [], n="n").filter("i <= j")
    possible = contacts.possible_pairs(_type_counts(spark, d), [], "bead_type", "n")
    return possible.join(upper, ["i", "j"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


@query("possible_pairs", "A17 A18", with_ctes(TYPE_COUNT_SQL, select="""
SELECT a.t AS i, b.t AS j, CASE WHEN a.t = b.t THEN a.n::DOUBLE * greatest(a.n - 1, 0) / 2 ELSE a.n::DOUBLE * b.n END AS possible,
       CASE WHEN a.t = b.t THEN CAST(a.n AS DOUBLE) END AS n_back FROM tn a JOIN tn b ON a.t <= b.t"""))
def possible_pairs(spark, d):
    from trajstats.functions.scalars import chains_from_pairs
    out = contacts.possible_pairs(_type_counts(spark, d), [], "bead_type", "n")
    return out.withColumn("n_back", F.when(F.col("i") == F.col("j"), F.round(chains_from_pairs(F.col("possible")), 6)))


@query("contact_membership", "A15", with_ctes(FRAMES_SQL, PAIRS_SQL, TYPE_CELLS_SQL, select="SELECT i, j, round(count / sum(count) OVER (), 10) AS f FROM tc"))
def contact_membership(spark, d):
    return contacts.membership(contacts.type_contacts(_type_pairs(spark, d), [], n="n").filter("i <= j"), []).select("i", "j", F.round("f", 10).alias("f"))


ENRICH_SQL = POSSIBLE_SQL + """,
en AS (SELECT i, j, count, possible, count / sum(CASE WHEN i <> j THEN 2 * count ELSE count END) OVER () AS f, possible / sum(CASE WHEN i <> j THEN 2 * possible ELSE possible END) OVER () AS q FROM tcp),
en2 AS (SELECT *, f / q AS e, CASE WHEN f > 0 THEN ln(f / q) END AS ln_e FROM en)"""


@query("contact_enrichment", "A16 A49 A52 P9", with_ctes(FRAMES_SQL, PAIRS_SQL, TYPE_CELLS_SQL, ENRICH_SQL, select="""
SELECT i, j, round(f, 10) AS f, round(q, 10) AS q, round(e, 8) AS e, round(ln_e, 8) AS ln_e FROM en2"""))
def contact_enrichment(spark, d):
    out = contacts.enrichment(_type_cells(spark, d), [], triangle=True)
    return out.select("i", "j", F.round("f", 10).alias("f"), F.round("q", 10).alias("q"), F.round("e", 8).alias("e"), F.round("ln_e", 8).alias("ln_e"))


@query("masked_enrichment", "A45", with_ctes(FRAMES_SQL, PAIRS_SQL, TYPE_CELLS_SQL, ENRICH_SQL, select="""
SELECT i, j, CASE WHEN a.n >= 50 AND b.n >= 50 THEN round(e, 8) END AS e FROM en2 JOIN tn a ON a.t = i JOIN tn b ON b.t = j"""))
def masked_enrichment(spark, d):
    out = contacts.enrichment(_type_cells(spark, d), [], triangle=True)
    masked = contacts.masked_low_support(out, _type_counts(spark, d), "e", 50, "bead_type")
    return masked.select("i", "j", F.round("e", 8).alias("e"))


@query("contact_free_energy", "A48 A20", with_ctes(FRAMES_SQL, PAIRS_SQL, TYPE_CELLS_SQL, POSSIBLE_SQL, select="""
SELECT i, j, round(count / possible / 21, 10) AS p, CASE WHEN count > 0 THEN round(-ln((count / possible / 21) / max(count / possible / 21) OVER ()), 8) END AS energy FROM tcp"""))
def contact_free_energy(spark, d):
    p = _type_cells(spark, d).select("i", "j", (F.col("count") / F.col("possible") / 21).alias("p"))
    out = contacts.relative_free_energy(p, "p")
    return out.select("i", "j", F.round("p", 10).alias("p"), F.round("energy", 8).alias("energy"))


def half_sql(cond: str, name: str) -> str:
    """Enrichment of one half of the frames."""
    return f"""t{name} AS (SELECT least(a_t, b_t) AS i, greatest(a_t, b_t) AS j, count(*) AS count FROM pr WHERE {cond} GROUP BY 1, 2),
c{name} AS (SELECT i, j, possible, coalesce(count, 0) AS count FROM pn LEFT JOIN t{name} USING (i, j)),
f{name} AS (SELECT i, j, count / sum(CASE WHEN i <> j THEN 2 * count ELSE count END) OVER () AS f, possible / sum(CASE WHEN i <> j THEN 2 * possible ELSE possible END) OVER () AS q FROM c{name}),
e{name} AS (SELECT i, j, f, f / q AS e, CASE WHEN f > 0 THEN ln(f / q) END AS ln_e FROM f{name})"""


@query("contact_contrast", "A50", with_ctes(FRAMES_SQL, PAIRS_SQL, TYPE_CELLS_SQL, POSSIBLE_SQL, half_sql("frame % 2 = 0", "1"), half_sql("frame % 2 = 1", "2"), select="""
SELECT i, j, round(e1.f - e2.f, 10) AS d_f, round(e1.ln_e - e2.ln_e, 8) AS d_ln_e, round(e1.e - e2.e, 8) AS d_e, CASE WHEN e1.f > 0 AND e2.f > 0 THEN round(ln(e1.f / e2.f), 8) END AS ln_f_ratio
FROM e1 JOIN e2 USING (i, j)"""))
def contact_contrast(spark, d):
    pairs = _type_pairs(spark, d)
    possible = contacts.possible_pairs(_type_counts(spark, d), [], "bead_type", "n").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = contacts.type_contacts(pairs.withColumn("half", F.col("frame") % 2), ["half"], n="n").filter("i <= j")
    full = possible.join(cells, ["half", "i", "j"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    en = contacts.enrichment(full, ["half"], triangle=True)
    out = contacts.contrast(en.filter("half = 0"), en.filter("half = 1"), ["i", "j"])
    return out.select("i", "j", F.round("d_f", 10).alias("d_f"), *[F.round(c, 8).alias(c) for c in ("d_ln_e", "d_e", "ln_f_ratio")])


@query("possible_bead_pairs", "A17", with_ctes(FRAMES_SQL, """
sp AS (SELECT species, count(DISTINCT chain_id)::DOUBLE AS n, (count(*) / count(DISTINCT chain_id))::DOUBLE AS l FROM fr WHERE frame = 0 GROUP BY 1),
bp AS (SELECT a.species AS i, b.species AS j, a.n AS na, a.l AS la, b.n AS nb, b.l AS lb, greatest(a.l - 2, 0) AS free FROM sp a JOIN sp b ON a.species <= b.species)""", select="""
SELECT i, j, CASE WHEN i = j THEN na * la * greatest(na * la - 1, 0) / 2 ELSE na * la * nb * lb END AS n_all,
       CASE WHEN i = j THEN na * (na - 1) / 2 * la * la ELSE na * la * nb * lb END AS n_inter,
       CASE WHEN i = j THEN na * free * greatest(free - 1, 0) / 2 ELSE 0 END AS n_intra,
       CASE WHEN i = j THEN na * (na - 1) / 2 * la * la + na * free * greatest(free - 1, 0) / 2 ELSE na * la * nb * lb END AS n_combined FROM bp"""))
def possible_bead_pairs(spark, d):
    sp = frames(spark, d).filter("frame = 0").groupBy("species").agg(F.count_distinct("chain_id").alias("n_chains"), F.count(F.lit(1)).alias("_n"))
    return contacts.possible_bead_pairs(sp.withColumn("length", F.col("_n") / F.col("n_chains")), exclusion=2)
