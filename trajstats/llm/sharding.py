"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

Every child of a node draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the
child's path; the smallest draw wins, so each child gets rows in proportion to its weight.
The draw of a child depends on its own path and weight alone. A changed weight moves rows only
to or from the subtree whose weight changed. A shard that is added as a region of its own
therefore takes rows only into itself.

Only DataFrame functions are used. Nulls: a null text has size 8, CRC 0; a null id draws as
empty text. Repeated rows get neighbouring slots. Other columns of the input are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

Tree = dict  # a weight at a leaf, else the children by name

#: Hex digits of the hash that cut a shard into parts, within which rows are numbered.
PART_DIGITS = 3


def even_tree(regions: int = 2, racks: int = 3, shards: int = 4) -> Tree:
    """A tree of equal weights; shards are numbered from 0 in order."""
    number = iter(range(regions * racks * shards))
    return {g: {k: {next(number): 1.0 for _ in range(shards)} for k in range(racks)} for g in range(regions)}


def with_shard(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region and rack of its own."""
    shard = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return tree | {1 + max(tree): {0: {shard: weight}}}


def weight_of(node) -> float:
    return float(node) if not isinstance(node, dict) else sum(map(weight_of, node.values()))


def _unit(path: str, key: Column) -> Column:
    """A number in (0, 1) hashed from the path and the key: 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(path + ":"), key)), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _draw(children: dict, path: str, key: Column) -> Column:
    """The child with the smallest weighted draw; ties go to the lowest name. Children without weight are left out."""
    live = {name: weight_of(node) for name, node in children.items() if weight_of(node) > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    draws = [F.struct((-F.log(_unit(f"{path}/{name}", key)) / F.lit(w)).alias("draw"), F.lit(name).alias("name")) for name, w in sorted(live.items())]
    return F.array_min(F.array(*draws))["name"]


def _case(pairs: list[tuple[Column, Column]]) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def assign(rows: DataFrame, key: Column, tree: Tree, into: str) -> DataFrame:
    """Add the shard of each row as column ``into``, one level of the tree after the other."""
    live = {g: {k: s for k, s in racks.items() if weight_of(s) > 0} for g, racks in tree.items() if weight_of(racks) > 0}
    if not live:
        raise ValueError("the tree has no weight")
    rows = rows.withColumn("_region", _draw(live, "", key))
    rows = rows.withColumn("_rack", _case([(F.col("_region") == g, _draw(racks, f"/{g}", key)) for g, racks in live.items()]))
    shard = _case([((F.col("_region") == g) & (F.col("_rack") == k), _draw(s, f"/{g}/{k}", key)) for g, racks in live.items() for k, s in racks.items()])
    return rows.withColumn(into, shard.cast("int")).drop("_region", "_rack")


def place(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    Slots number the rows of a shard from 0 in the order of a hash of the row. Identical rows are
    counted first and expanded last, so no key is too hot; shards are numbered in 16^3 parts whose
    sizes are summed up before.
    """
    tree = tree or even_tree()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = base.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    base = assign(assign(base, key, tree, "shard"), key, with_shard(tree), "grown_shard")
    base = base.withColumn("_h", F.md5(F.concat_ws("|", key, "size", "text_crc32"))).withColumn("_part", F.substring("_h", 1, PART_DIGITS))
    parts = base.groupBy("shard", "_part").agg(F.sum("_n").alias("_m"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("shard", "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("shard", "_part").orderBy("_h", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    rows = base.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(parts, ["shard", "_part"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    slot = (F.col("_base") + F.col("_before") + F.col("_copy")).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
