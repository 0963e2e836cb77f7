"""Mixing sources to target weights by systematic sampling.

Sizes are words.  Each source has a weight; the targets share the corpus by weight, no target exceeds MOST times its
source, and what such a source cannot take is shared again (*water filling*): target = min(MOST * size, level * weight)
with the one level at which the targets add up to everything.

Within a source each document is expected target / source_size times (3 at most).  The documents stand in order of
size, so that neighbours are alike and any run of them has its share of words; the expected copies are summed along
that order, one random offset in [0, 1) is added, and a document is emitted once for each integer that the sum passes
in its stretch.  The offset is a digest of the seed and the source, so reruns agree.

The running sum needs each document's rank within its source.  Ranks come from a range sort of the slim rows (source,
size, id), ranks within each sorted part, and the parts' counts added up per source; no source is gathered in a task.

Rows: null text has size 0; null sources are a source of their own, last in order.  Ties in size are broken by id, and
equal rows are interchangeable.  An empty table gives an empty result.  Sources without any word get target 0 and their
documents no copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MOST = 3
WEIGHTS = (5, 2, 1)
SEED = "mix"
#: White space between words (fixed pattern).
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text):
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) -> with weight and target.  There is one row per source, whatever the corpus."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    caps = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    # In order of the level at which a source is full, the first k are full; the others share what is left.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    full = most * F.col("source_size") <= level * F.col("weight")
    caps = caps.withColumn("level", level).withColumn("full", full)
    share = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything)
    caps = caps.withColumn("share", share)
    return caps.select("source", "source_size", "weight", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("share") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs."""
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).cast("long").alias("size"), F.col(doc_id).cast("string").alias("id"))
    ranked = C.ranked(rows, "source", ["size", "id"])
    goals = targets(ranked.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goals = goals.withColumnRenamed("source", "its_source")
    joined = ranked.join(goals, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source", "weight")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = (F.floor(draw + F.col("rank") * each) - F.floor(draw + (F.col("rank") - 1) * each)).cast("long")
    out = joined.withColumn("copies", F.least(copies, F.lit(most).cast("long"))).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("id").cast(id_type).alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH rows AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM sized),
levels AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (SELECT source, source_size, CASE WHEN 3 * source_size <= level * weight THEN CAST(3 * source_size AS DOUBLE)
  ELSE weight * first_value(CASE WHEN 3 * source_size > level * weight THEN level END IGNORE NULLS) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target FROM levels),
ranked AS (SELECT r.doc_id, r.size, g.source_size, g.target, row_number() OVER (PARTITION BY r.source ORDER BY r.size, CAST(r.doc_id AS VARCHAR) NULLS LAST) AS rank,
  CAST(('0x' || substr(md5('mix|' || coalesce(r.source, '')), 1, 8)) AS BIGINT) / 4294967296.0 AS draw,
  CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS each
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(draw + rank * each) - floor(draw + (rank - 1) * each), 3) AS BIGINT) * size AS taken FROM ranked
"""
