"""Exact top-k search over binary codes by multi-index hashing.

A vector's code has a bit per dimension (set if the component is positive), cut into m segments whose width follows the
logarithm of the number of codes, so that a segment's value is shared by few codes at any size; each segment has its own index
of the distinct codes.  Round r looks up, in the segments one after the other, all values at Hamming distance exactly r from
the query's segment.  By the pigeonhole principle, after segment j of m in round r every code within m * r + j has been met: so
a query looks into segment j only while m * r + j does not exceed its k-th verified distance, and ends when that distance is
covered.  Nothing is missed, whatever the data.

*Probe or scan.*  Values at distance r are probed one by one (C(width, r) of them) while these are fewer than the segment's
distinct values; beyond that, the distinct values themselves are gone through, in blocks of VALUES.  A query costs no more than
the segment's distinct values in a round, and neither way needs a broadcast: probes and blocks meet the queries in shuffles.

*Lists in blocks.*  The codes behind a segment's value are kept in blocks of LIST; a block is compared with the query where
they meet, and only codes within the k-th distance known so far come out of it.

Equal codes are one entry of the index with their k + 1 smallest ids, which is all that a list ordered by (distance, id) can
hold; a code that a third of the rows share costs one entry.

Rows: missing components, null vectors and short ones have bits 0.  Ties are ordered by id.  A query is never its own
neighbour; rows that repeat an id and its code count once, with another code they are other neighbours, and an id that asks
with several codes gets the k nearest to any of them.  Rows without an id are left out.  With fewer than k other rows, a query
gets all of them; an empty table gives an empty result.  Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

BITS, NEAREST = 64, 10
#: Bits of a segment at least and at most; distinct values of a segment in a block; codes in a block of a list.
NARROW, WIDE, VALUES, LIST = 8, 24, 4096, 256


def codes_of(vectors: DataFrame, vec_id: str, vector: str, bits: int) -> DataFrame:
    """(id, words): the code as an array of 32-bit words."""
    bit = lambda i: F.when(F.get(F.col(vector), F.lit(i)) > 0, F.lit(1 << i % 32).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    words = [sum((bit(i) for i in range(a + 1, min(a + 32, bits))), bit(a)) for a in range(0, bits, 32)]
    return vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("id"), F.array(*words).alias("words"))


def segments_of(words, bits: int, width: int):
    """The array of the code's segments, each of `width` bits (the last may be narrower)."""

    def part(a: int, b: int):
        found, at = F.lit(0).cast("bigint"), a
        while at < b:
            n = min(b, (at // 32 + 1) * 32) - at
            piece = F.shiftright(words[at // 32], at % 32).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
            found, at = found + F.shiftleft(piece, at - a), at + n
        return found.cast("int")

    return F.array(*(part(a, min(a + width, bits)) for a in range(0, bits, width)))


def width_for(n_codes: int, bits: int) -> int:
    """Segments of equal width, as near to the logarithm of the number of codes as can be from below."""
    near = min(max(n_codes, 2).bit_length() - 1, WIDE)
    return -(-bits // -(-bits // max(NARROW, near)))


def distance(a, b, n: int):
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, n)), F.bit_count(a[0].bitwiseXOR(b[0])))


def masks(width: int, r: int):
    """All numbers of `width` bits with r of them set, made in the JVM by adding one higher bit after another."""
    found = "array(0)"
    for _ in range(r):
        found = f"flatten(transform({found}, x -> transform(filter(sequence(0, {width - 1}), i -> shiftleft(1, i) > x), i -> x | shiftleft(1, i))))"
    return F.expr(found)


def top_k(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, bits: int = BITS, width: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) for the rows where is_query holds, against all rows."""
    rows = C.materialize(codes_of(vectors, vec_id, vector, bits).distinct(), "codes")
    first = F.row_number().over(Window.partitionBy("words").orderBy("id"))
    kept = rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("words").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    kept = C.materialize(kept, "entries")
    width = width or width_for(kept.count(), bits)
    n_words = -(-bits // 32)
    m, last_width = -(-bits // width), bits - width * (-(-bits // width) - 1)
    index = kept.select("words", F.posexplode(segments_of(F.col("words"), bits, width)).alias("part", "value"))
    # Lists of more than LIST codes are cut by a hash of the code; their lengths are counted with partial sums.
    long = index.groupBy("part", "value").count().where(F.col("count") > LIST)
    cut = F.pmod(F.xxhash64("words"), F.coalesce(F.ceil(F.col("count") / LIST), F.lit(1)))
    index = index.join(long, ["part", "value"], "left").groupBy("part", "value", cut.alias("cut")).agg(F.collect_list("words").alias("list"))
    index = C.materialize(index.select("part", "value", "list"), "lists")
    values = index.select("part", "value").distinct()
    held = {r["part"]: r["count"] for r in values.groupBy("part").count().collect()}  # a number per segment
    if not held:
        return rows.select(F.col("id").alias("query_id"), F.col("id").alias("neighbour_id"), F.lit(0).alias("distance"), F.lit(0).alias("rank"))
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for p, n in held.items() for x in (p, -(-n // VALUES))]), F.col("part"))
    blocks = values.withColumn("block", F.pmod(F.xxhash64("value"), n_blocks).cast("int")).groupBy("part", "block").agg(F.collect_list("value").alias("values"))
    blocks = C.materialize(blocks, "blocks")
    size = lambda p: width if p < m - 1 else last_width
    queries = rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("words").alias("asked"))
    asking, best = C.materialize(queries.withColumn("far", F.lit(None).cast("int")), "asking"), None
    in_order = Window.partitionBy("query_id", "asked").orderBy("distance", "neighbour_id")
    for r in range(width + 1):
        wanted = asking.select("query_id", "asked", F.posexplode(segments_of(F.col("asked"), bits, width)).alias("part", "own"), "far").where(F.col("far").isNull() | (m * r + F.col("part") <= F.col("far")))
        probing = [p for p, n in held.items() if comb(size(p), r) <= n]
        ways = []
        for w in {size(p) for p in probing}:
            asked = wanted.where(F.col("part").isin([p for p in probing if size(p) == w]))
            ways.append(asked.select("query_id", "asked", "far", "part", F.explode(F.transform(masks(w, r), lambda x: x.bitwiseXOR(F.col("own")))).alias("value")))
        scanning = [p for p in held if p not in probing]
        if scanning:
            asked = wanted.where(F.col("part").isin(scanning)).withColumn("block", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
            near_values = F.filter("values", lambda v: F.bit_count(v.bitwiseXOR(F.col("own"))) == r)
            ways.append(asked.join(blocks.hint("merge"), ["part", "block"]).select("query_id", "asked", "far", "part", F.explode(near_values).alias("value")))
        probes = reduce(DataFrame.union, ways)
        far = lambda x: distance(F.col("asked"), x, n_words).cast("int")
        within = F.filter("list", lambda x: F.col("far").isNull() | (far(x) <= F.col("far")))
        met = probes.join(index.hint("merge"), ["part", "value"]).select("query_id", "asked", F.explode(within).alias("words")).distinct()
        near = met.select("query_id", "asked", "words", far(F.col("words")).alias("distance"))
        # k + 1 codes hold k ids besides the query's, so no code behind them in order of distance is needed; ties stay in.
        at = F.rank().over(Window.partitionBy("query_id", "asked").orderBy("distance"))
        close = near.withColumn("n", at).where(F.col("n") <= k + 1)
        found = close.join(kept.hint("merge"), "words").select("query_id", "asked", "distance", F.explode("ids").alias("neighbour_id")).where("neighbour_id <> query_id")
        if best is not None:
            found = found.union(best.select("query_id", "asked", "distance", "neighbour_id"))
        found = found.distinct()
        best = C.materialize(found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k).select("query_id", "asked", "distance", "neighbour_id", "rank"), "best")
        last = best.where(F.col("rank") == k).select("query_id", "asked", F.col("distance").alias("kth"))
        state = asking.select("query_id", "asked").join(last, ["query_id", "asked"], "left")
        asking = C.materialize(state.where(F.col("kth").isNull() | (F.col("kth") > m * r + m - 1)).select("query_id", "asked", F.col("kth").alias("far")), "asking")
        if asking.isEmpty():
            break
    # An id that asks with several codes: the nearest to any of them.
    whole = best.select("query_id", "neighbour_id", "distance").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return whole.withColumn("rank", rank).where(F.col("rank") <= k)


def op7_binary_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


OP7_SQL = """
WITH codes AS (SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS code FROM embeddings WHERE vec_id IS NOT NULL),
pairs AS (SELECT DISTINCT q.vec_id AS query_id, x.vec_id AS neighbour_id,
  CAST(len(list_filter(range(1, 65), lambda i: q.code[i] <> x.code[i])) AS INT) AS distance FROM codes q JOIN codes x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, neighbour_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INT) AS rank FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) <= 10
"""
