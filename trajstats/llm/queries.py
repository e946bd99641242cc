"""Queries of the corpus operators over the given tables, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trajstats.llm import bpe, conversations, decontaminate, exact_dedup, jaccard_join, pii, pitman_yor, quality, quality_rules, sharding, toxicity, warc_fixity, whitening
from trajstats.llm.common import documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql:
            ORACLE_SQL[name] = sql
        return plan

    return add


@query("op1_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256 FROM d WINDOW w AS (PARTITION BY text)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def _draw_sql(paths: str, key: str) -> str:
    return f"-ln((('0x' || substr(md5({paths} || ':' || {key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _shard_sql(regions: str, into: str) -> str:
    """The shard of each id in a tree whose levels are in a table (region, rack, shard); a node weighs as many as its shards."""
    draw = lambda path: _draw_sql(path, "k")
    return f"""
{into}_g AS (SELECT k, arg_min(region, s) AS region FROM (SELECT k, region, {draw("'/' || region")} / n AS s FROM ids, (SELECT region, count(*) AS n FROM {regions} GROUP BY 1)) GROUP BY 1),
{into}_k AS (SELECT k, region, arg_min(rack, s) AS rack FROM (SELECT k, region, rack, {draw("'/' || region || '/' || rack")} / n AS s FROM {into}_g JOIN (SELECT region, rack, count(*) AS n FROM {regions} GROUP BY 1, 2) USING (region)) GROUP BY 1, 2),
{into} AS (SELECT k, arg_min(shard, s) AS {into} FROM (SELECT k, shard, {draw("'/' || region || '/' || rack || '/' || shard")} AS s FROM {into}_k JOIN {regions} USING (region, rack)) GROUP BY 1)"""


@query("op6_sharding", f"""
WITH bits AS (SELECT range AS i, range AS v FROM range(256)),
crc0 AS (SELECT i, list_reduce(list_prepend(v, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM bits),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc0),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
raw AS (SELECT doc_id, k, strlen(text) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d, tab),
ids AS (SELECT DISTINCT k FROM d),
tree AS (SELECT s // 12 AS region, s // 4 % 3 AS rack, s AS shard FROM (SELECT range::INTEGER AS s FROM range(24))),
grown AS (SELECT region, rack, shard FROM tree UNION ALL SELECT 2, 0, 24),
{_shard_sql("tree", "shard")},
{_shard_sql("grown", "grown_shard")}
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', k, size, text_crc32)), doc_id, size, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM raw JOIN shard USING (k) JOIN grown_shard USING (k)""")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir))


#: A-Z to a-z, words as runs of bytes other than 0x20 and 0x09-0x0D, and the set of five-word shingles of each document.
SHINGLES_SQL = """
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM docs),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM w),
heads AS (SELECT s, min(doc_id) AS a, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
toks AS (SELECT a, n, unnest(s) AS t FROM heads),
links AS (SELECT x.a, y.a AS b FROM toks x JOIN toks y ON x.t = y.t AND x.a <> y.a AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT a, a AS b FROM heads UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"""


@query("op8_jaccard_join", f"""
WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {SHINGLES_SQL}
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN heads ON sets.s = heads.s LEFT JOIN comp USING (a)""")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


@query("op9_pitman_yor")
def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(documents(spark, sf_dir))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    plain = F.filter("spans", lambda s: ~s["added"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter(plain, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text(plain), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = toxicity.weak_labels(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, labels, ["insult", "contempt", "toxic"])


@query("op5_warc_fixity", """
WITH r AS (SELECT page_id, coalesce(page_id::VARCHAR, '') AS k, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
h AS (SELECT page_id, k, strlen(record)::BIGINT AS length, sha256(record) AS sha256, substr(md5('damage:' || k), 1, 2) AS part FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id, sha256) AS copy FROM h),
a AS (SELECT *, ('0x' || substr(md5(k || '|' || sha256 || '|' || copy), 1, 8))::BIGINT % (SELECT greatest(1, (count(*) + 999) // 1000) FROM pages) AS archive FROM c)
SELECT page_id, archive, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, sha256, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length, sha256,
    CASE WHEN part IN ('00', '01') THEN 'changed' WHEN part = '02' THEN 'missing' ELSE 'intact' END AS status FROM a""")
def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.audit_pages(documents(spark, sf_dir, "pages"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(documents(spark, sf_dir, "embeddings"))


def _role_moves() -> str:
    """Rows (state, initial, letters, next state, cost, lines before, role or null): up to two inserts and one edit in the automaton of the role pattern.

    An initial of '' stands for any; the role is null where the row keeps its own or goes; ``final`` rows insert only.
    """
    legal = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "b", ("b", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    rows = []
    for state in "0sub":
        at, lines = state, ""
        for k in range(3):
            rows.append((state, "", "I" * k + "D", at, 2 * k + 3, lines, None))
            rows += [(state, c, "I" * k + "K", to, 2 * k, lines, None) for (p, c), to in legal.items() if p == at]
            rows += [(state, "", "I" * k + "R", to, 2 * k + 2, lines, names[c]) for (p, c), to in legal.items() if p == at and c in names]
            rows.append((state, "end", "I" * k, at, 2 * k, lines, None))
            c = next(c for (p, c) in legal if p == at and c in names)
            at, lines = legal[at, c], lines + f"\n{names[c]}:"
    sql = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)


@query("op11_conversation_repair", f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
drawn AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(place)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS draw FROM named, tab),
rows_ AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE draw <> 0),
placed AS (SELECT *, sha256(length(role) || ':' || role || text) AS digest, substr(role, 1, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM rows_),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM placed),
marked AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered),
mv AS (SELECT * FROM (VALUES {_role_moves()}) AS v(state, initial, letters, next, cost, lines, role)),
parse AS (
    SELECT conv_id, 0::BIGINT AS i, '0' AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT p.conv_id, p.i + 1, mv.next, min({{'cost': p.best.cost + mv.cost + CASE WHEN m.fault = 'truncated' AND mv.letters NOT LIKE '%D' THEN 1 ELSE 0 END, 'audit': p.best.audit || mv.letters,
        'lines': p.best.lines || mv.lines || CASE WHEN mv.letters LIKE '%D' THEN '' ELSE chr(10) || coalesce(mv.role, m.role) || ':' || m.text END}})
    FROM parse p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1 JOIN mv ON mv.state = p.state AND mv.initial IN ('', m.initial) AND mv.letters NOT IN ('', 'I', 'II') AND (m.fault NOT IN ('blank', 'duplicate') OR mv.letters LIKE '%D')
    GROUP BY p.conv_id, p.i + 1, mv.next),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY 1),
done AS (SELECT p.conv_id, min({{'cost': p.best.cost + mv.cost, 'audit': p.best.audit || mv.letters, 'lines': p.best.lines || mv.lines}}) AS best FROM parse p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id JOIN mv ON mv.state = p.state AND mv.initial = 'end' WHERE p.i = coalesce(c.n, 0) AND mv.next IN ('0', 'b') GROUP BY 1)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = documents(spark, sf_dir, "conversations")
    report, rows = conversations.repair(conversations.damaged(given))
    all_ = given.select(F.col("conv_id").alias("of")).distinct()
    found = all_.join(report, F.col("of").eqNullSafe(F.col("conv")), "left").drop("conv")
    hashed = conversations.digests(rows)
    found = found.join(hashed, F.col("of").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("of").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op12_quality_rules")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
