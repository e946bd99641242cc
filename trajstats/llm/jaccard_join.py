"""N-gram Jaccard join: a forest of count-vector R-trees over sets of word shingles.

The words of a text are hashed; its set holds the distinct hashes of five successive words. Two sets
link when 100 * |A n B| >= 80 * |A u B|. Equal sets are one node from the start.

**Groups.** The shingles of a set fall into k groups by hash, k a power of two just over the largest
difference that a link allows: |A| + |B| - 2 |A n B| <= (|A| + |B|) / 9. Linked sets therefore agree
on at least k - (|A| + |B|) / 9 groups, content and all. A set joins the k of its own size and the k of
sizes up to 5/4 of it, so that any two sets that may link have a k in common.

**Forest.** Group contents are shuffled as keys. Of a set's keys that other sets share, a link needs
``t`` = agreeing groups that can't be empty ones. Sets with fewer are no one's neighbour; of the others
the ``L - t + 1`` rarest keys suffice (of two lists in one order that share t entries, those prefixes meet).
Sets that share such a key belong to one tree. No link crosses trees, and common passages or lines
do not join documents, for they fill too few groups.

**Tree.** In each tree the group counts of the sets are points of an R-tree. |A n B| is at most the
sum of the coordinate minima, of a point or of a box's upper corner, so boxes that can't reach the needed
overlap are skipped, and the surviving pairs are verified on the shingles. Pairs that are
connected already need no check.

**Large trees** are cut into tiles of about ``tile`` sets. Tiles are joined within; then a few hubs of the
tree with all tiles; then every set that is outside the tree's main component with all tiles, in
blocks. So no task holds more than about two tiles, and every pair of sets in different components is compared.

Hashes have 64 bits; chance equality of two of n values has probability n^2 / 2^65.

Defined cases: a null or wordless text has no shingles and its own id as component; texts of one to
four words are one shingle; a null id links like any other, and a component of null ids only has id null;
repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajstats.llm.common import chunks, mix, runs, shuffle_parts, text_buffers, word_hashes, written
from trajstats.operators.groups import connected_components
from trajstats.session import cut_lineage, small_side

WORDS = 5
#: Sets in a tile of a large tree, and hubs that are compared with all its tiles.
TILE, HUBS = 384, 48
#: Points in a leaf and boxes in an inner node of an R-tree.
FANOUT = 16
#: A set that more than one in so many documents have is joined apart.
HOT_PARTS = 500
#: Sets whose groups are sent together.
FLUSH_SETS = 50_000

_FACTORS = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


# ---------------------------------------------------------------- sets


def shingle_sets(bounds: np.ndarray, raw: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of rows ``first`` to ``last``, by row and in order, and the row of each."""
    words, rows = word_hashes(bounds, raw, first, last)
    if not len(words):
        return words, rows
    n = np.bincount(rows - first, minlength=last - first)
    sums, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= WORDS:
        m = len(words) - WORDS + 1
        sums = np.zeros(m, np.uint64)
        for i in range(WORDS):
            sums += words[i : m + i] * _FACTORS[i]
        whole = rows[:m] == rows[WORDS - 1 :]
        sums, owner = mix(sums[whole]), rows[:m][whole]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(n)])
        few = np.array([mix((words[starts[r] : starts[r + 1]] * _FACTORS[: n[r]]).sum(dtype=np.uint64)[None] + np.uint64(n[r]))[0] for r in short], np.uint64)
        sums, owner = np.concatenate([sums, few]), np.concatenate([owner, short + first])
    order = np.lexsort((sums, owner))
    sums, owner = sums[order], owner[order]
    fresh = np.ones(len(sums), bool)
    fresh[1:] = (sums[1:] != sums[:-1]) | (owner[1:] != owner[:-1])
    return sums[fresh], owner[fresh]


def set_nodes(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set."""
    return mix(np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)).view(np.int64)


# ---------------------------------------------------------------- groups


def needed_groups(n: int) -> int:
    """Groups for sets of n: over the largest difference, with some to spare for empty ones."""
    return 1 if n <= 4 else 2 * n // 9 + 2 + -(-n // 50)


def size_class(n: int) -> int:
    """The class of sets of n: they have 2 to this power groups."""
    return (needed_groups(n) - 1).bit_length()


def _largest_of_class() -> list[int]:
    out = []
    for c in range(31):
        lo, hi = 1, 1 << 40
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if needed_groups(mid) <= 1 << c else (lo, mid - 1)
        out.append(lo)
    return out


LARGEST = _largest_of_class()


def group_keys(sets: np.ndarray, starts: np.ndarray, sizes: np.ndarray, classes: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the groups of each set in its class, the set of each key, and ``t`` of each set.

    ``member`` is the number of the set of each shingle. A key's low five bits are the class. t is the
    least number of keys that a linked set shares; sets for which empty groups might be the
    only common ones also send those, and have t = 1.
    """
    k = np.left_shift(np.uint64(1), classes.astype(np.uint64))
    group = ((sets >> np.uint64(32)) * k[member]) >> np.uint64(32)
    fresh = np.ones(len(sets), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (member[1:] != member[:-1])
    at = np.flatnonzero(fresh)
    owner = member[at]
    own = mix(k * np.uint64(0x9E3779B97F4A7C15))
    keys = mix(np.add.reduceat(mix(sets), at) + mix(group[at] + own[owner]))
    largest = np.minimum(sizes * 5 // 4, np.array([LARGEST[c] for c in classes], np.int64))
    filled = np.bincount(owner, minlength=len(sizes))
    t = filled - (sizes + largest) // 9
    taken, holder = group[at], owner
    for i in np.flatnonzero(t < 1):
        empty = np.setdiff1d(np.arange(int(k[i]), dtype=np.uint64), taken[holder == i])
        keys = np.concatenate([keys, mix(empty + own[i])])
        owner = np.concatenate([owner, np.full(len(empty), i, owner.dtype)])
    keys = (keys & ~np.uint64(31)) | classes[owner].astype(np.uint64)
    return keys, owner, np.maximum(t, 1)


def _each_chunk(batches: Iterator[pa.RecordBatch], column: str):
    for batch in batches:
        if batch.num_rows:
            bounds, raw = text_buffers(batch.column(column))
            for first, last in chunks(bounds):
                sets, rows = shingle_sets(bounds, raw, first, last)
                starts, sizes = runs(rows)
                yield batch, first, last, sets, rows, starts, sizes


def _class_pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table = {int(n): (size_class(int(n)), size_class(int(n) * 5 // 4)) for n in np.unique(sizes)}
    both = np.array([table[int(n)] for n in sizes], np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, n_shingles, head0, head1): a head is class * 2^40 + t."""
    for batch, first, last, sets, rows, starts, sizes in _each_chunk(batches, "text"):
        n = np.zeros(last - first, np.int64)
        node, head0, head1 = np.zeros_like(n), np.full_like(n, -1), np.full_like(n, -1)
        if len(sets):
            at = rows[starts] - first
            n[at], node[at] = sizes, set_nodes(sets, starts)
            member = np.repeat(np.arange(len(sizes)), sizes)
            for classes, head in zip(_class_pairs(sizes), (head0, head1)):
                head[at] = (classes << 40) + group_keys(sets, starts, sizes, classes, member)[2]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(node), pa.array(n), pa.array(head0), pa.array(head1)], ["doc_id", "node", "n_shingles", "head0", "head1"])


def _send_groups(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs of (bucket, keys, owners, nodes): the group keys of the distinct sets of a task."""
        seen: set[int] = set()
        keys, owners, nodes, count = [], [], [], 0

        def flush():
            if not keys:
                return
            key, owner, node = np.concatenate(keys), np.concatenate(owners), np.concatenate(nodes)
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            key, owner, bucket = key[order], owner[order], bucket[order]
            for start, length in zip(*runs(bucket)):
                part = slice(start, start + length)
                here, local = np.unique(owner[part], return_inverse=True)
                arrays = [pa.array([int(bucket[start])], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (key[part], local.astype(np.uint16), node[here])]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "keys", "owners", "nodes"])

        for _, _, _, sets, _, starts, sizes in _each_chunk(batches, "text"):
            if not len(sets):
                continue
            node = set_nodes(sets, starts)
            new = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
            if not new.any():
                continue
            mine = np.repeat(new, sizes)
            sets, sizes, node = sets[mine], sizes[new], node[new]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            member = np.repeat(np.arange(len(sizes)), sizes)
            low, high = _class_pairs(sizes)
            for j, classes in enumerate((low, high)):
                found, owner, _ = group_keys(sets, starts, sizes, classes, member)
                if j:
                    extra = (high != low)[owner]
                    found, owner = found[extra], owner[extra]
                keys.append(found)
                owners.append(owner + count)
            nodes.append(node)
            count += len(node)
            if count > FLUSH_SETS or sum(map(len, keys)) > 4_000_000:
                yield from flush()
                keys, owners, nodes, count, seen = [], [], [], 0, set()
        yield from flush()

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, key, sets) of the keys that two or more sets of the partition have."""
    blobs: dict[int, list] = {}
    for batch in batches:
        for b, *parts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "owners", "nodes"))):
            blobs.setdefault(b, []).append(parts)
    for b in list(blobs):
        parts = blobs.pop(b)
        key = np.concatenate([np.frombuffer(k, np.uint64) for k, _, _ in parts])
        node = np.concatenate([np.frombuffer(n, np.int64)[np.frombuffer(o, np.uint16)] for _, o, n in parts])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        _, length = runs(key)
        sets = np.repeat(length, length)
        many = sets > 1
        yield pa.RecordBatch.from_arrays([pa.array(node[many]), pa.array(key[many].view(np.int64)), pa.array(sets[many])], ["node", "key", "sets"])


def _rare_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, key): of each set's shared keys the rarest that a link can't avoid. Rows without ``sets`` are heads."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    node, key, sets = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in tables]) for c in ("node", "key", "sets"))
    head = sets == 0
    klass = np.where(head, key >> 40, key & 31)
    t = np.where(head, key & ((1 << 40) - 1), 0)
    order = np.lexsort((key, sets, klass, node))  # a head comes first
    node, key, sets, klass, t, head = (x[order] for x in (node, key, sets, klass, t, head))
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (klass[1:] != klass[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(node)))
    shared, need = length - 1, t[start]
    place = np.arange(len(node)) - np.repeat(start, length) - 1
    keep = ~head & np.repeat(shared >= need, length) & (place <= np.repeat(shared - need, length))
    yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(key[keep])], ["node", "key"])


# ---------------------------------------------------------------- tree


class CountTree:
    """An R-tree over group counts of sets: leaves of ``FANOUT`` points, packed in order of size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        median = int(np.median(self.size)) if len(sets) else 1
        self.bits = min(9, max(3, (median // 4).bit_length()))
        self.points = self.count(sets)
        self.order = np.argsort(self.size, kind="stable")
        pad = -len(self.order) % FANOUT
        last = self.order[-1:] if len(self.order) else self.order
        self.leaf_rows = np.concatenate([self.order, np.repeat(last, pad)]).reshape(-1, FANOUT)
        levels = [(self.points[self.leaf_rows].max(1), self.size[self.leaf_rows].min(1), self.size[self.leaf_rows].max(1))]
        while len(levels[-1][0]) > FANOUT:
            top, small, large = levels[-1]
            at = np.arange(0, len(top), FANOUT)
            levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)))
        self.levels = levels

    def count(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), 1 << self.bits), np.int32)
        for i, s in enumerate(sets):
            out[i] = np.bincount((s >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        return out

    def near(self, point: np.ndarray, n: int) -> np.ndarray:
        """Rows whose bound on the overlap reaches what a link with a set of n needs."""
        boxes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, small, large = self.levels[depth]
            fits = (5 * large[boxes] >= 4 * n) & (4 * small[boxes] <= 5 * n)
            boxes = boxes[fits]
            bound = np.minimum(top[boxes], point).sum(1)
            boxes = boxes[9 * bound >= 4 * (n + np.maximum(small[boxes], -(-4 * n // 5)))]
            if depth:
                boxes = (boxes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                boxes = boxes[boxes < len(self.levels[depth - 1][0])]
        rows = np.unique(self.leaf_rows[boxes].ravel()) if len(boxes) else np.zeros(0, np.int64)
        bound = np.minimum(self.points[rows], point).sum(1)
        return rows[9 * bound >= 4 * (n + self.size[rows])]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= 80 * (len(a) + len(b) - common)


def links_of(sets: list[np.ndarray], labels: list[int], query: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the components of the labels, as pairs of positions.

    Sets that are no queries are the tree; if all are queries, the tree holds them all.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = np.flatnonzero(~query) if not query.all() else np.arange(len(sets))
    asked = np.flatnonzero(query)
    if not len(held) or not len(asked):
        return []
    tree = CountTree([sets[i] for i in held])
    points = tree.count([sets[i] for i in asked])
    out = []
    for q, point in zip(asked.tolist(), points):
        for other in held[tree.near(point, len(sets[q]))].tolist():
            if root(labels[q]) != root(labels[other]) and linked(sets[q], sets[other]):
                parent[root(labels[q])] = root(labels[other])
                out.append((q, other))
    return out


def _join_tile(table: pa.Table) -> pa.Table:
    """(u, v) of the links within a tile; columns node, label, query, text."""
    table = table.combine_chunks()
    bounds, raw = text_buffers(pa.concat_arrays(table.column("text").chunks))
    found: dict[int, np.ndarray] = {}
    for first, last in chunks(bounds):
        sets, rows = shingle_sets(bounds, raw, first, last)
        for start, length in zip(*runs(rows)):
            found[int(rows[start])] = sets[start : start + length]
    nodes, labels, query = (table.column(c).to_numpy() for c in ("node", "label", "query"))
    keep, seen = [], set()
    for i in range(len(nodes)):
        s = found.get(i)
        if s is not None and (nodes[i], query[i]) not in seen and set_nodes(s, np.zeros(1, np.int64))[0] == nodes[i]:
            seen.add((nodes[i], query[i]))
            keep.append(i)
    pairs = links_of([found[i] for i in keep], [int(labels[i]) for i in keep], np.array([bool(query[i]) for i in keep], bool))
    return pa.table({"u": pa.array([nodes[keep[a]] for a, _ in pairs], pa.int64()), "v": pa.array([nodes[keep[b]] for _, b in pairs], pa.int64())})


# ---------------------------------------------------------------- join


def _tree_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of the rows (rep, node, tree, tile, tiles): one pass over the documents, by broadcast where the rows were counted to be few."""
    side = small_side(rows.withColumnRenamed("rep", "_rep"), 200_000)
    return written(docs.join(side, docs["doc_id"].eqNullSafe(side["_rep"])).drop("_rep", "doc_id"))


def _tile_links(rows: DataFrame) -> DataFrame:
    """Links within the tiles of ``rows`` (node, label, query, text, tree, tile, block)."""
    return cut_lineage(rows.groupBy("tree", "tile", "block").applyInArrow(_join_tile, "u long, v long"))


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return cut_lineage(connected_components(nodes, links, [], node="node").select("node", "label"))


def shingle_members(docs: DataFrame) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_members, f"doc_id {id_type}, node long, n_shingles long, head0 long, head1 long")


def candidate_edges(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): sets that share one of their rarest keys, as stars about the key's smallest node."""
    parts = shuffle_parts(docs.sparkSession)
    blobs = docs.select("text").mapInArrow(_send_groups(4 * parts), "bucket int, keys binary, owners binary, nodes binary")
    shared = blobs.repartition(parts, "bucket").mapInArrow(_shared_keys, "node long, key long, sets long")
    heads = nodes.select("node", F.explode(F.array("head0", "head1")).alias("key"), F.lit(0).cast("long").alias("sets")).filter("key >= 0").distinct()
    rare = cut_lineage(shared.unionByName(heads).repartition(parts, "node").mapInArrow(_rare_keys, "node long, key long"))
    low = rare.groupBy("key").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rare.join(low, "key").filter("node <> u").select("u", F.col("node").alias("v")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, hubs: int = HUBS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    members = cut_lineage(shingle_members(docs))
    nodes = members.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("head0").alias("head0"), F.max("head1").alias("head1"), F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(nodes)
    edges = cut_lineage(candidate_edges(docs, nodes))
    ends = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node")))
    trees = _components(ends, edges)
    sizes = trees.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    tiles = F.ceil(F.col("m") / tile).cast("int")
    rows = trees.join(sizes, "label").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = cut_lineage(rows.join(nodes.select("node", "rep"), "node").select("rep", "node", F.col("label").alias("tree"), "tile", "tiles"))
    texts = _tree_texts(docs, rows)
    links = _tile_links(texts.withColumns({"label": F.col("node"), "query": F.lit(True), "block": F.lit(0)}))
    large = rows.filter("tiles > 1")
    if not large.isEmpty():
        links = links.unionByName(_across_tiles(texts.filter("tiles > 1"), large, links, tile, hubs))
    labels = _components(rows.select("node"), links)
    named = labels.join(nodes.select("node", "rep"), "node")
    ids = named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("node", "component_id")
    share = members.count() // HOT_PARTS
    nodes = cut_lineage(nodes.select("node", "rep", "copies").join(ids, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") > share).alias("hot")))
    hot = F.broadcast(nodes.filter("hot").drop("hot"))  # fewer than HOT_PARTS rows
    found = members.join(hot, "node").unionByName(members.join(hot, "node", "left_anti").join(nodes.filter("not hot").drop("hot"), "node", "left"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less those that have a smaller document in their component; columns stay.

    Where ids are null or repeated, rows are told apart by a hash of id and text, the smallest of which stays.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    key = F.col("doc_id") if repeated.isEmpty() else F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    found = cut_lineage(jaccard_components(docs.select(key.alias("doc_id"), "text")))
    gone = small_side(found.filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), 500_000)
    return docs.join(gone, key == gone["_gone"], "left_anti")


def _across_tiles(texts: DataFrame, large: DataFrame, links: DataFrame, tile: int, hubs: int) -> DataFrame:
    """Links between tiles of one tree: through hubs, then of all sets outside the tree's main component."""
    inside = links.join(large.select(F.col("node").alias("u")), "u", "left_semi")
    columns = ["node", "label", "query", "text", "tree", "tile", "block"]
    tiles = large.select("tree", "tiles").distinct()

    def against(asked: DataFrame, labels: DataFrame) -> DataFrame:
        """Links of the queries (tree, node, label, block) with all tiles of their tree."""
        held = texts.join(labels, "node").join(asked.select("tree", "block").distinct(), "tree").withColumn("query", F.lit(False))
        spread = texts.select("node", "text").join(asked, "node").join(tiles, "tree").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("query", F.lit(True))
        return _tile_links(held.select(columns).unionByName(spread.select(columns)))

    labels = _components(large.select("node"), inside)
    parts = large.join(labels, "node").filter(F.col("tile") < hubs).groupBy("tree", "tile", "label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    best = parts.groupBy("tree", "tile").agg(F.max(F.struct("n", "label", "node")).alias("top"))
    first = against(best.select("tree", "top.node", "top.label", F.lit(0).alias("block")), labels)
    labels = _components(large.select("node"), inside.unionByName(first))
    labelled = large.select("tree", "node").join(labels, "node")
    main = labelled.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("tree").agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("top"))
    rest = labelled.join(main.select("tree", (-F.col("top.neg")).alias("main")), "tree").filter("label <> main").drop("main")
    amount = rest.groupBy("tree").agg(F.count(F.lit(1)).alias("r"))
    rest = rest.join(amount, "tree").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("r") / tile)).cast("int"))
    return first.unionByName(against(rest.select("tree", "node", "label", "block"), labels))
