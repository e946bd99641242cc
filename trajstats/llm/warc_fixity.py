"""Merkle fixity audit of WARC archives and their replicas.

Pages become WARC response records; archives hold about ``per_archive`` of them, in order of page, one after the
other, so each record has an offset. A leaf of an archive's tree is the SHA-256 of a record's bytes. The lowest
nodes hash the leaves whose offsets lie in one range of ``span`` bytes, in order; a node above hashes
``fanout`` nodes in order, up to one root for each archive.

The audit compares roots, and goes down only into nodes that differ; at the bottom it compares the leaves of
differing ranges by offset and names each record that was changed, is missing, or is extra.

All of it is DataFrame functions. A record's bytes are hashed in the scan and never shuffled. Records go to archives by a
hash, and repeated rows are counted first and told apart by a number, so archives stay even whatever is repeated.

Defined cases: a null url or html counts as empty; null ids sort first; repeated rows are records of their
own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trajstats.llm.common import written

PER_ARCHIVE, SPAN, FANOUT = 1000, 64 * 1024, 16


def record_text(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """The bytes of a page's record, as text."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def manifest(rows: DataFrame, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """Archive and offset of each record: rows (page_id, length, sha256, ...) get archive, start and copy. Only columns of bounded size are carried."""
    archives = max(1, -(-rows.count() // per_archive))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "sha256", "copy"))
    rows = rows.withColumn("archive", F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(archives)))
    before = W.partitionBy("archive").orderBy("page_id", "sha256", "copy").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def _levels(largest: int, span: int, fanout: int) -> int:
    levels = 1
    while span * fanout ** (levels - 1) <= largest:
        levels += 1
    return levels


def tree(leaves: DataFrame, levels: int, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """(archive, level, node, hash) of all nodes above the leaves (archive, start, length, sha256)."""
    hashed = lambda parts: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda p: F.concat_ws(":", p["a"], p["b"], p["h"])), ","), 256).alias("hash")
    node = F.floor(F.col("start") / span).cast("long").alias("node")
    level = leaves.groupBy("archive", node).agg(hashed(F.struct(F.col("start").alias("a"), F.col("length").alias("b"), F.col("sha256").alias("h"))))
    out = level.select("archive", F.lit(0).alias("level"), "node", "hash")
    for i in range(1, levels):
        level = level.groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(hashed(F.struct(F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), F.col("hash").alias("h"))))
        out = out.unionByName(level.select("archive", F.lit(i).alias("level"), "node", "hash"))
    return out


def audit(left: DataFrame, right: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """(archive, start, status) of the records that differ between two replicas' leaves (archive, start, length, sha256)."""
    largest = left.select("start").unionByName(right.select("start")).agg(F.max("start")).first()[0] or 0
    levels = _levels(largest, span, fanout)
    nodes = written(tree(left, levels, span, fanout).withColumn("side", F.lit(0)).unionByName(tree(right, levels, span, fanout).withColumn("side", F.lit(1))))
    mine, theirs = (nodes.filter(F.col("side") == s).select("archive", "level", "node", F.col("hash").alias(h)) for s, h in ((0, "mine"), (1, "theirs")))
    differing = None
    for i in range(levels - 1, -1, -1):
        at = F.floor(F.col("node") / fanout).cast("long")
        a, b = (x.filter(F.col("level") == i).drop("level") for x in (mine, theirs))
        if differing is not None:
            a, b = (x.withColumn("above", at).join(differing, ["archive", "above"], "left_semi").drop("above") for x in (a, b))
        both = a.join(b, ["archive", "node"], "full").filter(~F.col("mine").eqNullSafe(F.col("theirs")))
        differing = both.select("archive", F.col("node").alias("above"))
    below = lambda x, h: x.withColumn("above", F.floor(F.col("start") / span).cast("long")).join(differing, ["archive", "above"], "left_semi").select("archive", "start", F.struct("length", "sha256").alias(h))
    pairs = below(left, "mine").join(below(right, "theirs"), ["archive", "start"], "full")
    status = F.when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("changed")
    return pairs.filter(~F.col("mine").eqNullSafe(F.col("theirs"))).select("archive", "start", status.alias("status"))


def damaged(page_id: Column) -> tuple[Column, Column]:
    """Whether a record of a made-up replica has a changed byte, and whether it is missing: by a hash of the id."""
    part = F.substring(F.md5(F.concat(F.lit("damage:"), F.coalesce(page_id.cast("string"), F.lit("")))), 1, 2)
    return part.isin("00", "01"), part == "02"


def audit_pages(pages: DataFrame, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """(page_id, archive, start, length, sha256, status): the audit of pages' archives against a replica damaged by ``damaged``."""
    text = record_text()
    changed, missing = damaged(F.col("page_id"))
    other = F.concat(F.expr("left(record, length(record) - 1)"), F.lit(" "))
    rows = pages.select("page_id", text.alias("record")).select(
        "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"), F.when(~missing, F.when(changed, F.sha2(other, 256)).otherwise(F.sha2("record", 256))).alias("theirs")
    )
    leaves = written(manifest(rows, per_archive))
    left = leaves.select("archive", "start", "length", "sha256")
    right = leaves.filter("theirs is not null").select("archive", "start", "length", F.col("theirs").alias("sha256"))
    found = audit(left, right)
    return leaves.join(found, ["archive", "start"], "left").select("page_id", "archive", "start", "length", "sha256", F.coalesce("status", F.lit("intact")).alias("status"))
