"""Fixity audit of WARC replicas with Merkle trees.

Every record (header and payload, as it stands in a WARC file) is hashed.  Records in order of their id form leaves of SPAN
consecutive ids; FANOUT leaves form a node, FANOUT nodes a node above, up to one root.  A node's hash covers what is
below it in order, with the counts and bytes.  Two replicas agree if their roots do; otherwise the audit descends level by
level into the children of differing nodes only, and compares single records just in the differing leaves.

Each level is one aggregation over nodes that hold at most SPAN ids or FANOUT children; equal copies of a record are
counted before they meet, so a repeated record costs one entry.  Only the depth and the root are known to the driver.

Rows: null urls and payloads count as empty; records without an id form leaves of their own, dealt by digest.  Repeated
records are one entry with a count.  Empty replicas have the root of nothing; extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN, FANOUT, ORPHANS = 64, 64, 1 << 20


def warc_records(pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """pages with record: the bytes of each page's WARC response record."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "),
        F.coalesce(F.col(record_id).cast("string"), F.lit("")),
        F.lit("\r\nWARC-Target-URI: "),
        F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.withColumn("record", F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")))


def fixity(records: DataFrame, record_id: str = "page_id") -> DataFrame:
    """(id, digest, bytes, copies, leaf): the distinct records, slim."""
    one = records.select(F.col(record_id).cast("long").alias("id"), F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("bytes"))
    leaf = F.coalesce(F.floor(F.col("id") / SPAN), -1 - F.pmod(F.xxhash64("digest"), F.lit(ORPHANS)))
    return one.groupBy("id", "digest", "bytes").agg(F.count("*").alias("copies")).withColumn("leaf", leaf)


def _hash(*parts: str):
    """Hash of the group's parts in order."""
    each = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct(*parts, each.alias("text")))).getField("text"), ";"), 256)


def merkle_tree(entries: DataFrame, depth: int) -> list[DataFrame]:
    """fixity rows -> levels (node, hash, records, bytes), leaves first, the root last."""
    level = entries.groupBy(F.col("leaf").alias("node")).agg(_hash("id", "digest", "copies").alias("hash"), F.sum("copies").alias("records"), F.sum(F.col("bytes") * F.col("copies")).alias("bytes"))
    levels = [C.materialize(level, "leaves")]
    for k in range(depth):
        up = F.floor(F.col("node") / FANOUT) if k + 1 < depth else F.lit(0).cast("long")
        above = levels[-1].withColumn("up", up).groupBy("up").agg(_hash("node", "hash", "records", "bytes").alias("hash"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
        levels.append(C.materialize(above.withColumnRenamed("up", "node"), "nodes"))
    return levels


def depth_for(*entries: DataFrame) -> int:
    """Levels above the leaves until at most FANOUT nodes (and those of negative numbers) meet in the root."""
    ends = [e.agg(F.min("leaf"), F.max("leaf")).first() for e in entries]
    low, high = min((e[0] for e in ends if e[0] is not None), default=0), max((e[1] for e in ends if e[1] is not None), default=0)
    depth = 1
    while high // FANOUT ** (depth - 1) - low // FANOUT ** (depth - 1) > FANOUT:
        depth += 1
    return depth


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """fixity rows of two replicas -> (id, digest, bytes, copies, leaf, status) for each record of either.

    status: intact, corrupt (the id is held with another content), missing (only the primary has the id), extra."""
    depth = depth_for(primary, replica)
    ours, theirs = merkle_tree(primary, depth), merkle_tree(replica, depth)
    differing = None
    for level in range(depth, -1, -1):
        mine, other = ours[level], theirs[level]
        if differing is not None:
            up = F.lit(0).cast("long") if level + 1 == depth else F.floor(F.col("node") / FANOUT)
            mine, other = (x.withColumn("up", up).join(differing, F.col("up") == F.col("its_node"), "left_semi") for x in (mine, other))
        other = other.select(F.col("node").alias("their_node"), F.col("hash").alias("their_hash"))
        unlike = mine.join(other, F.col("node") == F.col("their_node"), "full").where(~F.col("hash").eqNullSafe(F.col("their_hash")))
        differing = C.materialize(unlike.select(F.coalesce("node", "their_node").alias("its_node")), "differing")
        if differing.isEmpty():
            break
    fields = ("id", "digest", "bytes", "copies", "leaf")
    inside = lambda x, how: x.join(differing, F.col("leaf") == F.col("its_node"), how).select(*fields)
    mine = inside(primary, "left_semi").withColumn("side", F.lit("primary"))
    both = mine.union(inside(replica, "left_semi").withColumn("side", F.lit("replica")))
    # Within the differing leaves: contents that both hold equally often are intact; ids tell what became of the others.
    ours_n, theirs_n = (F.sum(F.when(F.col("side") == x, F.col("copies")).otherwise(0)) for x in ("primary", "replica"))
    held = both.groupBy("id", "digest", "bytes", "leaf").agg(ours_n.alias("ours"), theirs_n.alias("theirs"))
    by_id = both.where("id is not null").groupBy(F.col("id").alias("its_id")).agg(F.max((F.col("side") == "primary").cast("int")).alias("here"), F.max((F.col("side") == "replica").cast("int")).alias("there"))
    status = (
        F.when(F.col("ours") == F.col("theirs"), "intact")
        .when((F.col("here") == 1) & (F.col("there") == 1), "corrupt")
        .when(F.col("ours") > F.col("theirs"), "missing")
        .otherwise("extra")
    )
    found = held.join(by_id, F.col("id") == F.col("its_id"), "left").select("id", "digest", "bytes", F.greatest("ours", "theirs").alias("copies"), "leaf", status.alias("status"))
    return found.union(inside(primary, "left_anti").withColumn("status", F.lit("intact")))


def second_copy(pages: DataFrame) -> DataFrame:
    """A replica with known damage, for the query: lost pages, changed bytes and a cut tail, by rules on the id."""
    kept = pages.where(F.col("page_id").isNull() | (F.col("page_id") % 193 != 7))
    html = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("!"), F.substring("html", 2, 1 << 30))).when(F.col("page_id") % 211 == 5, F.expr("left(html, length(html) - 9)")).otherwise(F.col("html"))
    return kept.withColumn("html", html)


def op10_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """The audit of `pages` against a damaged copy: a row for each record of either, with where its damage lies."""
    pages = C.table(spark, sf_dir, "pages")
    primary = C.materialize(fixity(warc_records(pages)), "fixity")
    replica = C.materialize(fixity(warc_records(second_copy(pages))), "fixity")
    return audit(primary, replica).select(F.col("id").alias("page_id"), F.col("digest").alias("record_sha256"), F.col("bytes").alias("record_bytes"), "copies", "leaf", "status")


OP10_SQL = """
WITH copy AS (SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN '!' || substr(html, 2) WHEN page_id % 211 = 5 THEN left(html, length(html) - 9) ELSE html END AS html
  FROM pages WHERE page_id IS NULL OR page_id % 193 <> 7),
both_sides AS (SELECT 'primary' AS side, * FROM (SELECT page_id, url, html FROM pages) UNION ALL SELECT 'replica' AS side, page_id, url, html FROM copy),
rec AS (SELECT side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: ' || coalesce(CAST(page_id AS VARCHAR), '') || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM both_sides),
held AS (SELECT page_id, sha256(record) AS record_sha256, CAST(strlen(record) AS BIGINT) AS record_bytes, count(*) FILTER (side = 'primary') AS ours, count(*) FILTER (side = 'replica') AS theirs FROM rec GROUP BY ALL),
seen AS (SELECT page_id, count(*) FILTER (side = 'primary') > 0 AS here, count(*) FILTER (side = 'replica') > 0 AS there FROM both_sides GROUP BY 1)
SELECT h.page_id, record_sha256, record_bytes, greatest(ours, theirs) AS copies, CAST(floor(h.page_id / 64) AS BIGINT) AS leaf,
  CASE WHEN ours = theirs THEN 'intact' WHEN here AND there THEN 'corrupt' WHEN ours > theirs THEN 'missing' ELSE 'extra' END AS status
FROM held h LEFT JOIN seen s ON h.page_id = s.page_id
"""
