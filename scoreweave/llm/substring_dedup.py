"""Exact removal of repeated passages, found through difference-cover anchors.

A passage of WINDOW = 35 words that occurs twice, at starts i and j, shares an *aligned* anchor: COVER holds for
every residue two members with that difference, so some d < PERIOD has (i + d) and (j + d) both at cover positions
modulo PERIOD.  An anchor is ANCHOR = 15 words long and d + ANCHOR <= WINDOW, so it lies inside the passage.  Only
5 of 21 positions are hashed; anchors that occur once anywhere cannot lie in a repeated passage.

1. every bucket sends its distinct anchor hashes, the repeated ones come back;
2. *extension*: each 35-word window that holds a repeated anchor is hashed whole; these hashes make the same trip;
3. the words under a repeated window go.

Windows are judged on the input.  Anchors, which only nominate windows, have 64-bit hashes; windows are told apart by 128
bits of two independent hashes of their words, so that different ones are confused with a chance of 2**-128 a pair.

Rows are independent of their ids: rows that repeat a doc_id (or have none) are documents of their own, so an exact copy loses
its text as any repeat does.  Null and empty texts have no words.  Very long texts are handled whole, each in one bucket.  An
empty table gives an empty result.  Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, ANCHOR, PERIOD = 35, 15, 21
#: Tells the second hash of a word from the first (fixed value).
OTHER = 0xD6E8FEB86659FD93
#: A perfect difference set modulo 21 (fixed values).
COVER = (3, 6, 7, 12, 14)


class Texts:
    """The words of a bucket's documents, end to end."""

    def __init__(self, bodies) -> None:
        self.words = [b.split() for b in bodies]
        lens = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lens)))
        self.doc = np.repeat(np.arange(len(lens)), lens)
        self.h = np.concatenate([C.hash_words(w) for w in self.words]) if len(lens) else np.empty(0, C.U64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window: of the words' hashes, and of these mixed otherwise."""
        return C.window_hashes(self.h, WINDOW), C.window_hashes(C.finalize(self.h ^ C.U64(OTHER)), WINDOW)

    def inside(self, k: int) -> np.ndarray:
        """Which window starts have their k words in one document."""
        return self.doc[: max(0, len(self.doc) - k + 1)] == self.doc[k - 1 :]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the anchors."""
        at = np.arange(len(self.doc)) - self.starts[self.doc]
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        use = self.inside(ANCHOR)
        where = np.flatnonzero(use & cover[at[: len(use)] % PERIOD])
        return where, C.window_hashes(self.h, ANCHOR)[where]

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the windows that hold a repeated anchor."""
        where, hashes = self.anchors()
        where = where[C.member(hashes, repeated)]
        use = self.inside(WINDOW)
        reach = WINDOW - ANCHOR
        mark = np.zeros(len(use) + 1, np.int32)
        np.add.at(mark, np.clip(where - reach, 0, len(use)), 1)
        np.add.at(mark, np.clip(where + 1, 0, len(use)), -1)
        starts = np.flatnonzero(use & (np.cumsum(mark)[:-1] > 0))
        one, two = self.windows()
        return one[starts], two[starts]

    def removed(self, repeated: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Which words lie under a repeated window."""
        n = len(self.doc)
        if not len(repeated) or n < WINDOW:
            return np.zeros(n, bool)
        hit = np.flatnonzero(self.inside(WINDOW) & C.member_of_pairs(*self.windows(), repeated, checks))
        mark = np.zeros(n + 1, np.int32)
        mark[hit] += 1
        np.add.at(mark, hit + WINDOW, -1)
        return np.cumsum(mark)[:-1] > 0


def _apply(docs: DataFrame, doc_id: str, text: str, finish: Callable, schema: str, keep: list[str] = ()) -> DataFrame:
    n_bytes = C.text_bytes(docs, text)
    n_buckets, n_ranges = C.bucket_count(n_bytes), C.range_count(n_bytes / 25)
    dealt = C.in_buckets(docs, doc_id, text, n_buckets, keep)  # one shuffle of the texts; the three steps below share it

    names = [f"kept_{k}" for k in range(len(keep))]

    def anchors(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return C.key_rows(key[0], Texts(pdf["body"]).anchors()[1], n_ranges, kind=C.TWICE)

    def windows(key, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        repeated, _ = C.received(back)
        hashes, checks = Texts(pdf["body"]).candidates(repeated) if len(repeated) else (np.empty(0, C.U64), np.empty(0, C.U64))
        return C.key_rows(key[0], hashes, n_ranges, checks, C.TWICE)

    def end(key, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        texts = Texts(pdf["body"])
        gone = texts.removed(*C.received(back, checked=True))
        out = [finish(body, words, gone[a:b]) for body, words, a, b in zip(pdf["body"], texts.words, texts.starts, texts.starts[1:])]
        done = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")], index=pdf.index)
        return pd.concat([pdf[["id", *names]], done], axis=1)

    by = dealt.groupBy("bucket")
    first = C.shared_keys(by.applyInPandas(anchors, C.KEYS), kind=C.TWICE)
    second = C.shared_keys(by.cogroup(first.groupBy("bucket")).applyInPandas(windows, C.KEYS), checked=True, kind=C.TWICE)
    kept = "".join(f"{x} string, " for x in names)
    done = by.cogroup(second.groupBy("bucket")).applyInPandas(end, f"id string, {kept}{schema}")
    back = [F.col(x).cast(docs.schema[c].dataType).alias(c) for x, c in zip(names, keep)]
    return done.select(F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"), *back, *done.columns[1 + len(names) :])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): what stays of each text, as a digest of its words joined by a space."""

    def finish(body: bytes, words: list[bytes], gone: np.ndarray) -> tuple:
        n = int(gone.sum())
        kept = words if not n else [w for w, x in zip(words, gone) if not x]
        return len(words), n, hashlib.sha256(b" ".join(kept)).hexdigest()

    return _apply(docs, doc_id, text, finish, "n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """(doc_id, kept columns, kept, n_removed): texts without repeated passages.  A text that loses nothing stays as it
    is, white space included; else kept words are joined by one space (all gone: empty text)."""

    def finish(body: bytes, words: list[bytes], gone: np.ndarray) -> tuple:
        n = int(gone.sum())
        kept = body if not n else b" ".join([w for w, x in zip(words, gone) if not x])
        return kept.decode("utf-8", "replace"), n

    return _apply(docs, doc_id, text, finish, "kept string, n_removed long", keep)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))
