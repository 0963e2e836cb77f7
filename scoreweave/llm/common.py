"""Helpers that several training-data operators share.

Documents are dealt into *buckets* of bounded size by a hash of their id and text.  A bucket is the unit in which
numpy looks at whole texts; what buckets have in common is found by sending each bucket's distinct 64-bit
keys, once per bucket, to key ranges and sending the repeated ones back (``shared_keys``).  A key that a third
of all documents hold therefore arrives once per bucket, not once per document.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

U64 = np.uint64
BUCKET_BYTES = 4_000_000
RANGE_KEYS = 500_000
LEAST_BUCKETS = 48
#: Multiplier of the rolling hash and of its finalizer (fixed values).
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
KEYS = "range int, bucket int, keys binary, counts binary"
SHARED = "bucket int, keys binary, counts binary"


#: Folders of our own, by application: only in local mode, where driver and executors are one process.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="scoreweave-")
        found = _OWN[context.applicationId]
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder, packed tightly, and read it back: lineage ends, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def in_buckets(docs: DataFrame, doc_id: str, text: str, n_buckets: int, keep: list[str] = ()) -> DataFrame:
    """(bucket, id, body): the id as a string (so that pandas keeps nulls and all digits), the text as UTF-8 bytes (null: empty)."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n_buckets)).cast("int").alias("bucket"),
        F.col(doc_id).cast("string").alias("id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
        *(F.col(c).cast("string").alias(f"kept_{k}") for k, c in enumerate(keep)),
    )


def bucket_count(n_bytes: int) -> int:
    return max(LEAST_BUCKETS, -(-n_bytes // BUCKET_BYTES))


def range_count(n_keys: float) -> int:
    return max(12, -(-int(n_keys) // RANGE_KEYS))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))


def finalize(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(MIX1)
    x = (x ^ (x >> U64(27))) * U64(MIX2)
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries of h, by doubling; len(h) - k + 1 values (or none)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, U64)
    acc, at, levels, size = np.zeros(m, U64), 0, {1: h}, 1
    while size * 2 <= k:
        low = levels[size]
        levels[size * 2] = low[: len(low) - size] * U64(pow(BASE, size, 1 << 64)) + low[size:]
        size *= 2
    for size in sorted(levels, reverse=True):
        if k & size:
            acc = acc * U64(pow(BASE, size, 1 << 64)) + levels[size][at : at + m]
            at += size
    return finalize(acc + U64(k))


def member(x: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Which entries of x are in sorted_keys."""
    if not len(sorted_keys) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


#: How counts travel: as numbers, or (op 9) only whether a key occurs more than once.
COUNT, TWICE = np.uint16, np.uint8


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as bytes that compress well: the steps from one to the next, all their lowest bytes first, then the next ones, ..."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    """The first n keys of a blob that begins with `packed` ones."""
    steps = np.frombuffer(blob, np.uint8, 8 * n).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(steps).view(U64).reshape(-1), dtype=U64)


def key_rows(bucket: int, keys: np.ndarray, n_ranges: int, checks: np.ndarray | None = None, kind=COUNT) -> pd.DataFrame:
    """The distinct keys of a bucket with their counts, cut at the range borders; one row per range that has any.

    With checks, a second hash each, keys are told apart by all 128 bits.  Counts end at what their kind holds."""
    if checks is None:
        keys, counts = np.unique(keys, return_counts=True)
    else:
        order = np.lexsort((checks, keys))
        keys, checks = keys[order], checks[order]
        first = _first_of(keys, checks)
        keys, checks, counts = keys[first], checks[first], np.diff(np.append(first, len(keys)))
    where = ((keys >> U64(32)) * U64(n_ranges)) >> U64(32)
    ranges, starts = np.unique(where, return_index=True)
    ends = np.append(starts[1:], len(keys))
    counts = np.minimum(counts, np.iinfo(kind).max).astype(kind)
    return pd.DataFrame(
        {
            "range": ranges.astype(np.int32),
            "bucket": np.full(len(ranges), bucket, np.int32),
            "keys": [packed(keys[a:b]) + (b"" if checks is None else checks[a:b].tobytes()) for a, b in zip(starts, ends)],
            "counts": [counts[a:b].tobytes() for a, b in zip(starts, ends)],
        }
    )


def _first_of(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where sorted (key, check) pairs begin anew."""
    if not len(keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])))


def shared_keys(keys: DataFrame, checked: bool = False, kind=COUNT) -> DataFrame:
    """keys: rows of key_rows.  For each bucket, its keys that occur more than once anywhere, with the total counts (none if
    only TWICE was asked for)."""

    def halves(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(blob) // (16 if checked else 8)
        return unpacked(blob, n), np.frombuffer(blob, U64, offset=8 * n)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [halves(x) for x in pdf["keys"]]
        keys = np.concatenate([p[0] for p in parts])
        checks = np.concatenate([p[1] for p in parts])
        counts = np.frombuffer(b"".join(pdf["counts"]), kind).astype(np.int64)
        order = np.lexsort((checks, keys)) if checked else np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = _first_of(ordered, checks[order] if checked else ordered)
        sums = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        out, at = [], 0
        for bucket, (own, second) in zip(pdf["bucket"], parts):
            sums = total[at : at + len(own)]
            keep = sums > 1
            if keep.any():
                back = b"" if kind is TWICE else np.minimum(sums[keep], np.iinfo(kind).max).astype(kind).tobytes()
                out.append((bucket, packed(own[keep]) + (second[keep].tobytes() if checked else b""), back))
            at += len(own)
        return pd.DataFrame(out, columns=["bucket", "keys", "counts"])

    return keys.groupBy("range").applyInPandas(meet, SHARED)


def received(pdf: pd.DataFrame, checked: bool = False, kind=COUNT) -> tuple[np.ndarray, np.ndarray]:
    """The keys that came back to a bucket, sorted, with their checks or else their counts."""
    sizes = [len(x) // (16 if checked else 8) for x in pdf["keys"]]
    keys = np.concatenate([unpacked(x, n) for x, n in zip(pdf["keys"], sizes)]) if sizes else np.empty(0, U64)
    if checked:
        more = np.concatenate([np.frombuffer(x, U64, offset=8 * n) for x, n in zip(pdf["keys"], sizes)]) if sizes else np.empty(0, U64)
        order = np.lexsort((more, keys))
    else:
        more = np.frombuffer(b"".join(pdf["counts"]), kind)
        order = np.argsort(keys)
    return keys[order], more[order] if len(more) else more


def member_of_pairs(x: np.ndarray, check: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which pairs (x, check) are among the sorted pairs (keys, checks)."""
    if not len(keys) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    found = (keys[at] == x) & (checks[at] == check)
    twin = np.flatnonzero(~found & (keys[at] == x))  # another pair of the same key stands before it, if any
    for k in twin.tolist():
        j = int(at[k])
        while j < len(keys) and keys[j] == x[k]:
            found[k] |= bool(checks[j] == check[k])
            j += 1
    return found


def widened(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with rank: 1, 2, ... within each group, in the given order (nulls last).

    The rows are range-sorted, numbered within each sorted part, and the parts' counts are added up per group: a group
    of any size is spread over many parts, and only (part, group) counts meet in one place.  The numbered rows are
    written before they are read twice, so part numbers cannot change in between."""
    keys = [F.col(c).asc_nulls_last() for c in (group, *order)]
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def number(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            at = batch.groupby(group, sort=False, dropna=False).cumcount().to_numpy() + 1
            for name, where in batch.groupby(group, sort=False, dropna=False).indices.items():
                name = None if pd.isna(name) else name
                at[where] += seen.get(name, 0)
                seen[name] = seen.get(name, 0) + len(where)
            yield batch.assign(part=part, at=at)

    schema = widened(rows, part=T.IntegerType(), at=T.LongType())
    numbered = materialize(parts.mapInPandas(number, schema), "ranks")
    counts = numbered.groupBy("part", group).agg(F.max("at").alias("n"))
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("part").alias("its_part"), F.col(group).alias("its_group"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    same = (F.col("part") == F.col("its_part")) & F.col(group).eqNullSafe(F.col("its_group"))
    return numbered.join(offsets, same).withColumn("rank", F.col("at") + F.col("ahead")).select(*rows.columns, "rank")
