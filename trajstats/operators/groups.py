"""Connected groups of chains per frame, their tracking in time and member statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from trajstats.functions.scalars import minimum_image
from trajstats.functions.stats import finite
from trajstats.operators import neighbors
from trajstats.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str = "chain_id", max_rounds: int = 60, out: str = "label") -> DataFrame:
    """(keys, node, label): the label is the smallest node id of the component.

    Alternating star contraction (Kiveris et al., 2014): every round links neighbours to
    the local minimum, larger ones first, then smaller ones. The number of rounds grows
    with the logarithm of the component size. Minima are aggregations, so a node
    with very many neighbours is pre-aggregated on the map side.
    """
    links = cut_lineage(edges.select(*keys, F.col("u").alias("a"), F.col("v").alias("b")).distinct())
    previous = None
    for _ in range(max_rounds):
        links = _small_star(_large_star(links, keys), keys)
        links = cut_lineage(links)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    members = links.select(*keys, F.col("b").alias(node), F.col("a").alias(out))
    return nodes.select(*keys, node).distinct().join(members, [*keys, node], "left").withColumn(out, F.coalesce(out, node))


def radius_components(beads: DataFrame, keys: Sequence[str], id_col: str, radius: float, chain: str = "chain_id",
                      pos: Sequence[str] = ("x", "y", "z"), box: Sequence[str] = ("lx", "ly", "lz")) -> DataFrame:
    """(keys, chain, label): chains linked by beads closer than ``radius``, exactly, without all pairs of beads.

    Beads of one small cell or of two touching ones are always that close (``neighbors.sure_links``), so a crowd costs links by beads and
    cells. Only between the parts that remain are pairs of beads met (``neighbors.links_between``).
    """
    keys = list(keys)
    beads = cut_lineage(beads.select(*keys, *dict.fromkeys([id_col, chain, *pos, *box])))
    nodes = cut_lineage(beads.select(*keys, chain).distinct())
    parts = cut_lineage(connected_components(nodes, neighbors.sure_links(beads, keys, radius, chain, pos, box), keys, chain))
    rows = beads.select(*keys, id_col, chain, *pos, *box).join(parts.hint("merge"), [*keys, chain])
    links = cut_lineage(neighbors.links_between(rows, keys, id_col, radius, "label", pos, box))
    if links.isEmpty():
        return parts
    whole = connected_components(parts.select(*keys, "label").distinct(), links, keys, "label", out="_top")
    return cut_lineage(parts.join(whole, [*keys, "label"]).select(*keys, chain, F.col("_top").alias("label")))


def _large_star(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Link every larger neighbour of a node to the minimum of its neighbourhood."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.select(*keys, F.explode(ways).alias("w")).select(*keys, "w.a", "w.b")
    low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = both.filter("b > a").join(low, [*keys, "a"])
    return larger.select(*keys, F.col("m").alias("a"), "b").filter("a <> b")


def _small_star(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(*keys, F.greatest("a", "b").alias("top"), F.least("a", "b").alias("low"))
    low = down.groupBy(*keys, "top").agg(F.min("low").alias("m"))
    star = F.array(F.struct(F.col("m").alias("a"), F.col("low").alias("b")), F.struct(F.col("m").alias("a"), F.col("top").alias("b")))
    return down.join(low, [*keys, "top"]).select(*keys, F.explode(star).alias("w")).select(*keys, "w.a", "w.b").filter("a <> b").distinct()


def largest_groups(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, size) of the biggest group per frame; ties go to the lowest label."""
    sizes = groups.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("size", (-F.col("label")).alias("neg"))).alias("s"))
    return best.select(*keys, (-F.col("s.neg")).alias("label"), F.col("s.size").alias("size"))


def group_metrics(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per frame: size and share of the largest group, number of groups, number of members."""
    sizes = groups.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("size"))
    out = sizes.groupBy(*keys).agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_members"))
    return out.withColumn("fraction", F.col("largest") / F.col("n_members"))


def fraction_summary(metrics: DataFrame, keys: Sequence[str], time: str, fraction: str = "fraction", over: float = 0.1) -> DataFrame:
    """Mean, max, 95th percentile and share above ``over`` of a fraction series; mean time gap."""
    f, t = F.col(fraction), F.col(time)
    stats = [
        F.avg(f).alias("mean"), F.max(f).alias("max"), F.percentile(f, 0.95).alias("p95"), F.avg((f > over).cast("double")).alias("share_over"),
        ((F.max(t) - F.min(t)) / F.nullif(F.count(t) - 1, F.lit(0))).alias("mean_gap"),
    ]
    return metrics.groupBy(*keys).agg(*stats) if keys else metrics.agg(*stats)


# --- tracking --------------------------------------------------------------------------

def successors(groups: DataFrame, keys: Sequence[str], t: str = "t", chain: str = "chain_id") -> DataFrame:
    """(keys, t, label, next_label): for every group the best match one frame later.

    Best means largest overlap, then Jaccard index, then closest size, then size, then
    smallest first member. Overlaps come from one equi-join on the chain. Groups without
    any overlap are matched on distinct sizes only.
    """
    sizes = groups.groupBy(*keys, t, "label").agg(F.count(F.lit(1)).alias("size"), F.min(chain).alias("low"))
    now = groups.select(*keys, chain, F.col(t), F.col("label"))
    then = groups.select(*keys, chain, (F.col(t) - 1).alias(t), F.col("label").alias("next_label"))
    shared = now.join(then, [*keys, t, chain]).groupBy(*keys, t, "label", "next_label").agg(F.count(F.lit(1)).alias("overlap"))
    here = sizes.select(*keys, t, "label", "size")
    there = sizes.select(*keys, (F.col(t) - 1).alias(t), F.col("label").alias("next_label"), F.col("size").alias("next_size"), F.col("low").alias("next_low"))
    scored = shared.join(here, [*keys, t, "label"]).join(there, [*keys, t, "next_label"])
    score = F.struct(
        F.col("overlap"), (F.col("overlap") / (F.col("size") + F.col("next_size") - F.col("overlap"))).alias("jaccard"),
        (-F.abs(F.col("next_size") - F.col("size"))).alias("close"), F.col("next_size").alias("big"), (-F.col("next_low")).alias("first"), F.col("next_label"),
    )
    matched = scored.groupBy(*keys, t, "label").agg(F.max(score).alias("s")).select(*keys, t, "label", F.col("s.next_label").alias("next_label"))
    lost = here.join(matched, [*keys, t, "label"], "left_anti")
    next_sizes = there.groupBy(*keys, t, "next_size").agg(F.min(F.struct("next_low", "next_label")).alias("n"))
    by_size = lost.select(*keys, t, "size").distinct().join(next_sizes, [*keys, t])
    closest = F.struct((-F.abs(F.col("next_size") - F.col("size"))).alias("close"), F.col("next_size").alias("big"), F.col("n.next_label").alias("next_label"))
    fallback = by_size.groupBy(*keys, t, "size").agg(F.max(closest).alias("s")).select(*keys, t, "size", F.col("s.next_label").alias("next_label"))
    return matched.unionByName(lost.join(fallback, [*keys, t, "size"]).select(*keys, t, "label", "next_label"))


def tracked_group(groups: DataFrame, keys: Sequence[str], frame: str = "frame", chain: str = "chain_id", frames: DataFrame | None = None) -> DataFrame:
    """(keys, frame, label): one group followed through the frames of a system.

    A pick depends on the pick before it only, so the best matches form a map from frame
    to frame. The path through this map is found by doubling: jumps of 1, 2, 4, ...
    frames, which takes log2(frames) rounds of equi-joins instead of one sequential task
    per system. A start is the largest group of the first frame and of every frame that
    follows an empty one (``frames`` lists all frames, empty ones included).
    """
    all_frames = (frames if frames is not None else groups).select(*keys, frame).distinct()
    numbered = all_frames.withColumn("t", F.row_number().over(W.partitionBy(*keys).orderBy(frame)) - 1)
    g = cut_lineage(groups.select(*keys, frame, chain, "label").join(numbered, [*keys, frame]).select(*keys, "t", chain, "label"))
    jump = cut_lineage(successors(g, keys))
    filled = g.select(*keys, "t").distinct()
    starts = filled.join(filled.select(*keys, (F.col("t") + 1).alias("t")), [*keys, "t"], "left_anti")
    path = cut_lineage(largest_groups(g, [*keys, "t"]).select(*keys, "t", "label").join(starts, [*keys, "t"]))
    span = 1
    longest = numbered.agg(F.max("t")).first()[0] or 0
    while span <= longest:
        ahead = path.join(jump, [*keys, "t", "label"]).select(*keys, (F.col("t") + span).alias("t"), F.col("next_label").alias("label"))
        path = cut_lineage(path.unionByName(ahead))
        hop = jump.select(*keys, (F.col("t") - span).alias("t"), F.col("label").alias("next_label"), F.col("next_label").alias("far"))
        jump = cut_lineage(jump.join(hop, [*keys, "t", "next_label"]).select(*keys, "t", "label", F.col("far").alias("next_label")))
        span *= 2
    return path.join(numbered, [*keys, "t"]).select(*keys, frame, "label")


def membership(groups: DataFrame, tracked: DataFrame, keys: Sequence[str], frame: str = "frame", chain: str = "chain_id") -> DataFrame:
    """(keys, frame, chain, inside) for every chain of every frame."""
    picked = tracked.select(*keys, frame, "label", F.lit(True).alias("inside"))
    return groups.select(*keys, frame, chain, "label").join(picked, [*keys, frame, "label"], "left").select(*keys, frame, chain, F.coalesce("inside", F.lit(False)).alias("inside"))


def persistent_members(inside: DataFrame, keys: Sequence[str], frame: str = "frame", chain: str = "chain_id", share: float = 0.95) -> DataFrame:
    """Chains inside for at least ceil(share * frames) frames, at least one."""
    n = inside.groupBy(*keys).agg(F.count_distinct(frame).alias("n_frames")) if keys else inside.agg(F.count_distinct(frame).alias("n_frames"))
    counts = inside.filter("inside").groupBy(*keys, chain).agg(F.count(F.lit(1)).alias("n_inside"))
    joined = counts.join(n, list(keys)) if keys else counts.crossJoin(F.broadcast(n))
    return joined.filter(F.col("n_inside") >= F.greatest(F.lit(1), F.ceil(F.round(F.lit(share) * F.col("n_frames"), 9))))


def residence_class(inside: DataFrame, keys: Sequence[str], window: str, chain: str = "chain_id", frame_share: float = 0.95,
                    inside_share: float = 0.95, outside_share: float = 0.10) -> DataFrame:
    """inside / outside / ambiguous by the share of windows in which a chain is persistent."""
    per_window = inside.groupBy(*keys, window, chain).agg(F.sum(F.col("inside").cast("long")).alias("n_in"), F.count(F.lit(1)).alias("n_frames"))
    hit = (F.col("n_in") >= F.greatest(F.lit(1), F.ceil(F.round(frame_share * F.col("n_frames"), 9)))).cast("long")
    counts = per_window.groupBy(*keys, chain).agg(F.sum(hit).alias("n_hits"), F.count(F.lit(1)).alias("n_windows"))
    return counts.withColumn(
        "residence",
        F.when(F.col("n_hits") >= F.greatest(F.lit(1), F.ceil(F.round(inside_share * F.col("n_windows"), 9))), "inside")
        .when(F.col("n_hits") <= F.floor(F.round(outside_share * F.col("n_windows"), 9)), "outside")
        .otherwise("ambiguous"),
    )


def occupancy_radius(com: DataFrame, keys: Sequence[str], frame: str = "frame", chain: str = "chain_id", pos: Sequence[str] = ("x", "y", "z"), min_members: int = 3) -> DataFrame:
    """Per chain: share of frames inside, and mean distance from the centre over its rms while inside.

    Frames with fewer than ``min_members`` inside are skipped. Centre and rms come from
    one pass of moments per frame, joined back.
    """
    x = [F.when(F.col("inside"), F.col(p)) for p in pos]
    moments = com.groupBy(*keys, frame).agg(
        F.count(x[0]).alias("_n"), *[F.avg(c).alias(f"_m{k}") for k, c in enumerate(x)], *[F.var_pop(c).alias(f"_v{k}") for k, c in enumerate(x)]
    ).filter(F.col("_n") >= min_members)
    joined = com.join(moments, [*keys, frame])
    r2 = sum(((F.col(p) - F.col(f"_m{k}")) ** 2 for k, p in enumerate(pos)), F.lit(0.0))
    rms = F.sqrt(F.col("_v0") + F.col("_v1") + F.col("_v2"))
    norm = finite(F.when(rms > 0, F.sqrt(r2) / rms))
    return joined.groupBy(*keys, chain).agg(F.avg(F.col("inside").cast("double")).alias("occupancy"), F.avg(F.when(F.col("inside"), norm)).alias("r_over_rms"))


def inner_outer(chains: DataFrame, keys: Sequence[str], species: str = "species", mass: str = "mass") -> DataFrame:
    """Chain counts and masses inside and outside, per species; outer is total minus inner."""
    inner_n, inner_m = F.sum(F.col("inside").cast("long")), F.sum(F.when(F.col("inside"), F.col(mass)).otherwise(0.0))
    total_n, total_m = F.count(F.lit(1)), F.sum(mass)
    return chains.groupBy(*keys, species).agg(
        inner_n.alias("n_inner"), inner_m.alias("mass_inner"), (total_n - inner_n).alias("n_outer"), (total_m - inner_m).alias("mass_outer")
    )


def spanning_shifts(links: DataFrame, keys: Sequence[str], shifts: Sequence[str]) -> DataFrame:
    """(keys, node, root, shifts): a tree over every component, rooted at its smallest node, with the sum of shifts from the root to each node.

    ``links`` has a < b and the shift from a to b. Each round every node hangs on its smallest neighbour, if that is smaller; pointer
    doubling carries the sums to the tops of these trees; then each tree is one node, and of the links between two
    trees the one with the smallest original ends stays. A path is walked in the logarithm of its length.
    """
    keys, shifts = list(keys), list(shifts)
    links = cut_lineage(links.select(*keys, "a", "b", F.col("a").alias("_oa"), F.col("b").alias("_ob"), *shifts))
    return _spanned(links, None, keys, shifts)


def radius_shifts(nodes: DataFrame, keys: Sequence[str], node: str, radius: float, pos: Sequence[str] = ("x", "y", "z"), box: Sequence[str] = ("lx", "ly", "lz")) -> DataFrame:
    """``spanning_shifts`` for the links of all nodes closer than ``radius``, by the same tree, without a row for each link.

    The first round needs the smallest neighbour of each node, and after it the first link between two trees; both are found where the
    nodes meet (``neighbors.lowest_links``). What is left is links between trees.
    """
    keys, shifts = list(keys), [f"_d{k}" for k in range(len(pos))]
    tree = cut_lineage(neighbors.lowest_links(nodes, keys, node, radius, None, pos, box).select(*keys, F.col("b").alias("node"), F.col("a").alias("up"), *shifts))
    total = cut_lineage(_doubled(tree, keys, shifts).withColumnRenamed("up", "root"))
    rows = nodes.select(*keys, F.col(node).alias("node"), *pos, *box).join(total.select(*keys, "node", "root"), [*keys, "node"], "left")
    rows = cut_lineage(rows.withColumn("root", F.coalesce("root", "node")))
    links = neighbors.lowest_links(rows, keys, "node", radius, "root", pos, box).withColumnsRenamed({"a": "_oa", "b": "_ob"})
    for end, sign in (("a", 1), ("b", -1)):
        top = total.select(*keys, F.col("node").alias(f"_o{end}"), F.col("root").alias("_up"), *[F.col(s).alias(f"_{s}") for s in shifts])
        links = links.join(top, [*keys, f"_o{end}"], "left").withColumns({end: F.coalesce("_up", f"_o{end}")} | {s: F.col(s) + sign * F.coalesce(F.col(f"_{s}"), F.lit(0.0)) for s in shifts}).drop("_up", *[f"_{s}" for s in shifts])
    turned = F.col("a") > F.col("b")
    links = links.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "_oa", "_ob", *[F.when(turned, -F.col(s)).otherwise(F.col(s)).alias(s) for s in shifts])
    return _spanned(cut_lineage(links), total, keys, shifts)


def radius_unwrapped(positions: DataFrame, keys: Sequence[str], radius: float, chain: str = "chain_id", pos: Sequence[str] = ("x", "y", "z"), box: Sequence[str] = ("lx", "ly", "lz")) -> DataFrame:
    """``unwrapped_groups`` of the groups that links closer than ``radius`` make, with their labels."""
    keys = list(keys)
    where = cut_lineage(positions.select(*keys, chain, *pos, *box))
    moved = cut_lineage(radius_shifts(where, keys, chain, radius, pos, box)).withColumnsRenamed({"node": chain, "root": "label"})
    rows = where.select(*keys, chain).join(moved, [*keys, chain], "left").withColumn("label", F.coalesce("label", chain))
    origin = where.select(*keys, F.col(chain).alias("label"), *pos)
    return rows.join(origin, [*keys, "label"]).select(*keys, chain, *[(F.col(p) + F.coalesce(F.col(f"_d{k}"), F.lit(0.0))).alias(p) for k, p in enumerate(pos)], "label")


def _spanned(links: DataFrame, total: DataFrame | None, keys: Sequence[str], shifts: Sequence[str]) -> DataFrame:
    """The rounds of ``spanning_shifts`` over links (a, b, first ends, shifts) of what is one node by now, ``total`` being the tree so far."""
    while not links.isEmpty():
        best = F.min(F.struct("a", "_oa", "_ob", *shifts)).alias("_m")
        tree = links.groupBy(*keys, F.col("b").alias("node")).agg(best).select(*keys, "node", F.col("_m.a").alias("up"), *[F.col(f"_m.{s}").alias(s) for s in shifts])
        tree = cut_lineage(_doubled(cut_lineage(tree), keys, shifts))
        here = tree.withColumnRenamed("up", "root")
        if total is not None:
            top = here.select(*keys, F.col("node").alias("root"), F.col("root").alias("_root"), *[F.col(s).alias(f"_{s}") for s in shifts])
            moved = total.join(top, [*keys, "root"], "left").select(*keys, "node", F.coalesce("_root", "root").alias("root"), *[(F.col(s) + F.coalesce(F.col(f"_{s}"), F.lit(0.0))).alias(s) for s in shifts])
            here = moved.unionByName(here.join(total.select(*keys, "node"), [*keys, "node"], "left_anti"))
        total = cut_lineage(here)
        for end, sign in (("a", 1), ("b", -1)):
            top = tree.select(*keys, F.col("node").alias(end), F.col("up").alias("_up"), *[F.col(s).alias(f"_{s}") for s in shifts])
            links = links.join(top, [*keys, end], "left").select(*keys, *[F.coalesce("_up", end).alias(end) if c == end else c for c in ("a", "b")], "_oa", "_ob", *[(F.col(s) + sign * F.coalesce(F.col(f"_{s}"), F.lit(0.0))).alias(s) for s in shifts])
        turned = F.col("a") > F.col("b")
        links = links.filter("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "_oa", "_ob", *[F.when(turned, -F.col(s)).otherwise(F.col(s)).alias(s) for s in shifts])
        first = F.min(F.struct("_oa", "_ob", *shifts)).alias("_m")
        links = cut_lineage(links.groupBy(*keys, "a", "b").agg(first).select(*keys, "a", "b", "_m.*"))
    return total if total is not None else links.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"), *shifts)


def _doubled(tree: DataFrame, keys: Sequence[str], shifts: Sequence[str]) -> DataFrame:
    """Every node's ``up`` at the top of its tree, with the shifts on the way added up."""
    while True:
        above = tree.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), *[F.col(s).alias(f"_{s}") for s in shifts])
        higher = tree.join(above, [*keys, "up"], "left")
        if higher.filter("_up IS NOT NULL").isEmpty():
            return tree
        tree = cut_lineage(higher.select(*keys, "node", F.coalesce("_up", "up").alias("up"), *[(F.col(s) + F.coalesce(F.col(f"_{s}"), F.lit(0.0))).alias(s) for s in shifts]))


def unwrapped_groups(groups: DataFrame, edges: DataFrame, positions: DataFrame, keys: Sequence[str], chain: str = "chain_id",
                     pos: Sequence[str] = ("x", "y", "z"), box: Sequence[str] = ("lx", "ly", "lz")) -> DataFrame:
    """Positions of each group put together across the box: the lowest chain keeps its place, and every other chain follows
    by the nearest images along the links of a tree (``spanning_shifts``). A group that doesn't reach around the box
    comes out the same along any tree.
    """
    keys = list(keys)
    where = cut_lineage(positions.select(*keys, chain, *pos, *box))
    ends = edges.select(*keys, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    steps = ends.join(where.select(*keys, F.col(chain).alias("a"), *[F.col(p).alias(f"_a{k}") for k, p in enumerate(pos)]), [*keys, "a"])
    steps = steps.join(where.select(*keys, F.col(chain).alias("b"), *[F.col(p).alias(f"_b{k}") for k, p in enumerate(pos)], *box), [*keys, "b"])
    shift = [minimum_image(F.col(f"_b{k}") - F.col(f"_a{k}"), F.col(length)).alias(f"_d{k}") for k, length in enumerate(box)]
    moved = spanning_shifts(steps.select(*keys, "a", "b", *shift), keys, [f"_d{k}" for k in range(len(pos))])
    rows = groups.select(*keys, chain, "label").join(moved.withColumnRenamed("node", chain), [*keys, chain], "left")
    origin = where.select(*keys, F.col(chain).alias("label"), *pos)
    return rows.join(origin, [*keys, "label"]).select(*keys, chain, *[(F.col(p) + F.coalesce(F.col(f"_d{k}"), F.lit(0.0))).alias(p) for k, p in enumerate(pos)], "label")


def ragged_frames(rows: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """Per frame of a ragged group dump: groups with rg > 0, largest rg, largest size over the first frame's total."""
    per_frame = rows.groupBy(*keys, frame).agg(
        F.count(F.when(F.col("rg") > 0, 1)).alias("n_groups"), F.greatest(F.max("rg"), F.lit(0.0)).alias("max_rg"), F.max("size").alias("max_size"), F.sum("size").alias("total")
    )
    first = per_frame.groupBy(*keys).agg(F.min_by("total", frame).alias("first_total"))
    joined = per_frame.join(first, list(keys))
    return joined.select(*keys, frame, "n_groups", "max_rg", F.try_divide("max_size", "first_total").alias("phi"))
