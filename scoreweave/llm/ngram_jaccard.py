"""Exact Jaccard join of documents on word shingles, returned as connected components.

A document's set is its distinct n-word shingles.  Two documents link when 100 * |x & y| >= percent * |x | y|.  Every
step below is exact; each one only leaves out pairs that cannot link.

1. *Who can have a partner.*  In hash order, the n - t + l first tokens of a set (t: the least overlap a partner
   needs, l about a tenth of n) hold l tokens of every partner's such prefix.  Sets with too few prefix tokens that
   occur elsewhere have no partner and stop here.
2. *Global order.*  The tokens of the others are counted over all of them; a set's tokens are ordered rarest first.
   Tokens that occur once never match, so a set with more of these than a partner may miss stops here too.
3. *Equal sets* become one class, so exact copies are never paired.
4. *Index lists.*  The prefix tokens' lists keep position and size.  In each list the most central set (fewest tokens
   of its own) is compared with the others: a linear number of pairs.
5. *Answers from answers.*  Sets linked to the same centre are already connected and are not compared again.  For the
   others the overlaps with the centre c bound their own: |x & y| <= min(|x & c|, |y & c|) + min(rest of x, rest of y),
   where the rest is what lies outside c and is no token of one set alone; and the distance is a metric, so that
   |d(x, c) - d(y, c)| must not exceed the limit.  What is left is joined within the lists in blocks of size, with length and position filters,
   in the first list that holds both, and verified.

Lists are keyed by a number of the set, not by an id, so that ids which repeat with other texts don't mix.  Components are found
among distinct sets only; copies, however many share a text, join their set's component once at the end.

Rows: null or empty texts have no shingle, form a component of their own and link with nothing.  Rows that repeat a
doc_id count as linked.  A null doc_id gets a null component.  Very long texts are handled whole, each in one bucket.  An empty
table gives an empty result.  Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: prefix: which of the tokens, by position, rarest first.
FEATURES = "id string, n_shingles long, sig binary, singles int, tokens array<bigint>, prefix array<int>"
#: How many of a set's earlier tokens a list keeps, to tell that a pair has met before.
EARLIER = 32
#: Marks the hash of a text of fewer words than a shingle (fixed value).
SHORT = 0x5851F42D4C957F2D


def least_overlap(n, percent: int):
    """The fewest tokens that a set of n shares with a partner."""
    return -(-n * percent // 100)


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; of fewer words, one hash of all."""
    if not words:
        return np.empty(0, C.U64)
    h = C.hash_words(words)
    if len(words) < n:
        return C.window_hashes(h, len(words)) ^ C.U64(SHORT)
    return np.unique(C.window_hashes(h, n))


def sets_of(bodies, n: int):
    return (shingle_set(b.lower().split(), n) for b in bodies)


def spared(size: int, percent: int) -> int:
    """How many of a set's prefix tokens a partner must share (l above) if the set has so many tokens."""
    return max(1, size // 10)


def prefix_of(tokens: np.ndarray, percent: int) -> np.ndarray:
    n = len(tokens)
    return tokens[: n - least_overlap(n, percent) + spared(n, percent)]


def _features(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    n_bytes = C.text_bytes(docs, text)
    n_buckets, n_ranges, n_wide = C.bucket_count(n_bytes), C.range_count(n_bytes / 20), C.range_count(n_bytes / 7)
    by = C.in_buckets(docs, doc_id, text, n_buckets).groupBy("bucket")

    def prefixes(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [prefix_of(x, percent) for x in sets_of(pdf["body"], n)]
        return C.key_rows(key[0], np.concatenate(parts) if parts else np.empty(0, C.U64), n_ranges, kind=C.TWICE)

    def count(key, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        repeated, _ = C.received(back)
        parts = []
        if len(repeated):
            for x in sets_of(pdf["body"], n):
                found = int(C.member(prefix_of(x, percent), repeated).sum())
                if len(x) and found >= spared(least_overlap(len(x), percent), percent):
                    parts.append(x)
        return C.key_rows(key[0], np.concatenate(parts) if parts else np.empty(0, C.U64), n_wide)

    def order(key, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        known, counts = C.received(back)
        out = []
        for i, x in zip(pdf["id"], sets_of(pdf["body"], n)):
            size, row = len(x), None
            if size and len(known):
                at = np.searchsorted(known, x)
                at[at == len(known)] = 0
                held = known[at] == x
                singles, room = int(size - held.sum()), size - least_overlap(size, percent) + 1
                if singles < room:
                    shared = x[held]
                    first = np.lexsort((shared, counts[at[held]]))[: room - singles]
                    row = (i, size, xxhash.xxh3_128_digest(x.tobytes()), singles, shared.view(np.int64), first.astype(np.int32))
            out.append(row or (i, size, None, None, None, None))
        frame = pd.DataFrame(out, columns=["id", "n_shingles", "sig", "singles", "tokens", "prefix"])
        return frame.astype({"singles": "Int32"})

    repeated = C.shared_keys(by.applyInPandas(prefixes, C.KEYS), kind=C.TWICE)
    counted = C.shared_keys(by.cogroup(repeated.groupBy("bucket")).applyInPandas(count, C.KEYS))
    done = by.cogroup(counted.groupBy("bucket")).applyInPandas(order, FEATURES)
    return done.withColumn("id", F.col("id").cast(docs.schema[doc_id].dataType))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) -> (a, b, common, far, linked): the overlap, the Jaccard distance, and whether the pair links."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    id_type = sets.schema["rep"].dataType.simpleString()

    def overlap(frames):
        for pdf in frames:
            inter = np.zeros(len(pdf), np.int64)
            for k, (a, b) in enumerate(zip(pdf["tokens_a"], pdf["tokens_b"])):
                inter[k] = C.member(a.view(C.U64), b.view(C.U64)).sum()
            union = pdf["n_a"].to_numpy() + pdf["n_b"].to_numpy() - inter
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "common": inter, "far": 1 - inter / np.maximum(union, 1), "linked": 100 * inter >= percent * union})

    return both.mapInPandas(overlap, f"a {id_type}, b {id_type}, common long, far double, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) -> (id, component): alternating large and small stars, each round written
    to the shared folder.  No label or link is gathered on the driver; the rounds grow as the logarithm of the size."""
    links = C.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links = C.materialize(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct(), "links")
        now = mark(links)
        if now == before:
            break
        before = now
    return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Enough of the links (a, b) between different sets to connect all that are connected."""
    limit = 1 - percent / 100 + 1e-9
    lists = sets.select("rep", "n", "singles", F.posexplode(F.transform("prefix", lambda p: F.get("tokens", p))).alias("k", "token")).select("token", "rep", "n", "singles", (F.col("k") + F.col("singles")).alias("at"))
    centre = lists.groupBy("token").agg(F.min(F.struct((F.col("singles") / F.col("n")).alias("own"), F.col("rep").alias("centre"), F.col("n").alias("size"))).alias("c"), F.count("*").alias("held")).where("held > 1").select("token", "c.centre", "c.size")
    lists = C.materialize(lists.join(centre, "token"), "lists")

    fits = F.least("n", "size") * 100 >= F.greatest("n", "size") * percent
    stars = lists.where((F.col("rep") != F.col("centre")) & fits).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    tested = C.materialize(_verified(stars, sets, percent), "tested")

    # A set's label: the centre it is nearest to among those it links to, itself otherwise.  Equal labels are connected.
    near = tested.where("linked").groupBy(F.col("a").alias("rep")).agg(F.min(F.struct("far", "b")).alias("x")).select("rep", F.col("x.b").alias("label"))
    known = tested.select(F.col("a").alias("rep"), F.col("b").alias("centre"), "common", "far")
    rest = lists.join(near, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    label_of = near.select(F.col("rep").alias("label"), F.col("label").alias("over"))
    rest = rest.join(label_of, "label", "left").withColumn("label", F.coalesce("over", "label")).drop("over")
    mixed = rest.groupBy("token").agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one <> two").select("token")
    rest = rest.join(mixed, "token").join(known, ["rep", "centre"], "left").withColumn("far", F.when(F.col("rep") == F.col("centre"), 0.0).otherwise(F.col("far")))
    earlier = F.collect_list("token").over(Window.partitionBy("rep").orderBy("at").rowsBetween(-EARLIER, -1))
    rest = C.materialize(rest.select("token", "rep", "n", "singles", "at", earlier.alias("earlier"), "label", "centre", "far", "common", F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).alias("block")), "rest")

    # What two sets can share: what each shares with the centre at most, and of the rest what is not one set's alone.
    derived = lambda x: (F.col("common").alias(f"common_{x}"), (F.col("n") - F.col("common") - F.col("singles")).alias(f"other_{x}"))
    shares = F.least("common_a", "common_b") + F.least("other_a", "other_b")
    # Sizes within the threshold lie in the same block or in neighbouring ones.
    left = rest.select(F.col("token"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("label").alias("label_a"), F.col("far").alias("far_a"), *derived("a"), F.col("earlier").alias("earlier_a"))
    right = rest.select("token", "block", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("label").alias("label_b"), F.col("far").alias("far_b"), *derived("b"), "centre", F.col("earlier").alias("earlier_b"))
    most = F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    pairs = left.join(
        right,
        (left.token == right.token)
        & (left.block == right.block)
        & (F.col("a") < F.col("b"))
        & (F.col("label_a") != F.col("label_b"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
        & (F.col("common_a").isNull() | F.col("common_b").isNull() | (shares * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent))
        & (F.col("far_a").isNull() | F.col("far_b").isNull() | (F.abs(F.col("far_a") - F.col("far_b")) <= limit))
        & (F.col("a") != F.col("centre"))
        & (F.col("b") != F.col("centre"))
        & ~F.arrays_overlap("earlier_a", "earlier_b"),  # a pair meets in the first list that holds both, and seldom again
    )
    more = _verified(pairs.select("a", "b").distinct(), sets, percent)
    return tested.where("linked").select("a", "b").union(more.where("linked").select("a", "b"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; component_id is the smallest doc_id reachable by links."""
    features = C.materialize(_features(docs, doc_id, text, n, percent), "features")
    classes = features.where("sig is not null and id is not null")
    sets = classes.groupBy("sig").agg(F.min("id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("singles").alias("singles"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix"))
    sets = C.materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")  # written once, so numbers are fixed
    links = C.materialize(_links(sets.drop("sig", "first_id"), percent), "edges")
    member = C.materialize(classes.select("id", "sig").join(sets.select("sig", "rep"), "sig").select("id", "rep"), "members")
    twin = member.groupBy("id").agg(F.min("rep").alias("one"), F.max("rep").alias("two")).where("one <> two")  # ids with several texts
    found = components(links.union(member.join(twin.select("id", "one"), "id").where("rep <> one").select("rep", "one")))
    labelled = sets.select("rep", "first_id").join(found, F.col("rep") == F.col("id"), "left").select("rep", "first_id", F.coalesce("component", "rep").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = labelled.join(least, "component").select("rep", "component_id")
    by_id = member.join(labelled, "rep").groupBy("id").agg(F.min("component_id").alias("component_id"))
    rows = features.select("id", "n_shingles")
    known = rows.where("id is not null").join(by_id, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return known.union(rows.where("id is null").select("id", "n_shingles", "id"))


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(C.table(spark, sf_dir, "documents"))
