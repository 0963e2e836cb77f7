"""Best-fit packing of documents into token sequences of bounded length.

Texts are tokenized (BPE, cached per run of non-space characters) and closed by END; longer documents are cut into
full pieces and a rest.  The pieces are packed in bulk-synchronous rounds of best fit:

1. as many sequences as the tokens need are opened;
2. waiting pieces and open gaps are range-sorted together, largest first.  A gap that holds several of the largest waiting
   piece offers as many equal slots, so that a round places several pieces in a sequence;
3. every part sweeps its rows from large to small: a slot is laid down, a piece takes the slot laid down last, which is its
   successor: the tightest that holds it.  Pieces and slots that find no partner in their part are numbered;
4. conflicts between the parts are resolved by rank: from each part's two counts follows which ranks of one part's pieces take
   which ranks of another part's slots.  Only these counts, two per PART rows, reach the driver;
5. the gaps shrink by what their sequences took, and the next round begins.  If a piece is larger than every gap, the pieces
   of that kind get new sequences.

Rounds end when nothing waits; each one places a piece at least, and as a sweep leaves no piece that fits a free slot, their
number follows the logarithm of the ratio of the largest and the smallest piece rather than the number of pieces.  Every
round's tables are written to the shared folder, so a lost executor costs a part of a round.

Rows: null and empty texts are the END token alone.  Rows that repeat a doc_id are packed each.  Very long texts are cut into
pieces, ties are broken by the place of the piece in the written table.  An empty table gives an empty result.  Extra columns
are not touched, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

CAPACITY, END = 4096, 1
#: Rows of a part in a sweep.
PART = 20_000
PIECES = "id string, piece int, start long, length long, ids_crc32 long"
_TOKENIZERS: dict[str, Tokens] = {}


#: How the vocabulary cuts lower-cased text of ASCII and Latin letters (fixed patterns): words, contractions, digits, the
#: rest; what makes a text leave that path; and what its words consist of (not U+0130, whose lower case is a letter and a mark).
CUT = re.compile(rb"[a-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\x80-\xff]+")
CONTROL, SPECIAL = bytes((*range(9), *range(14, 32), 127)), re.compile(rb"<\|(?:startof|endof)text\|>")
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


class Tokens(dict):
    """A piece that the pre-tokenizer cuts (bytes) -> its token ids (little-endian unsigned 32 bit).

    Pieces are tokenized once and looked up afterwards; words many at a time, as every word ends with a token that is marked
    so.  Texts with other letters, control characters or special tokens take another way: their runs of non-space characters,
    which the pre-tokenizer never joins, are tokenized as they stand.  Two generations of at most `most` pieces are remembered: a
    full one becomes the older, and what is met again moves on, so frequent pieces are never tokenized twice."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes | None] = {}

    def _single(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends, raw = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist(), ids.tobytes()
        if len(ends) != len(words):
            return [self._single(w) for w in words]
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, new: set[bytes]) -> None:
        """Pieces of other letters get None."""
        words = []
        for piece in new:
            if piece[0] >= 97 and piece[0] != 123 and LATIN.fullmatch(text := piece.decode()):
                words.append(text)
            else:
                self[piece] = None if max(piece) >= 128 else self._single(piece.decode())
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            self.update(zip([w.encode() for w in part], self._words(part)))

    def _by_runs(self, body: bytes) -> bytes:
        out = []
        for run in body.split():
            if run not in self.runs:
                if len(self.runs) >= self.most:
                    self.runs.clear()
                self.runs[run] = self._single(run.decode())
            out.append(self.runs[run])
        return b"".join(out)

    def encode_all(self, bodies) -> list[bytes]:
        """The ids of each text."""
        cut = [None if len(b.translate(None, CONTROL)) < len(b) or b"<|" in b and SPECIAL.search(b) else CUT.findall(b.lower()) for b in bodies]
        held = set().union(*(c for c in cut if c))
        if len(self) + len(held) > self.most:
            self.older = dict(self)
            self.clear()
        missing = held - self.keys()
        again = missing & self.older.keys()
        self.update((x, self.older[x]) for x in again)
        self.learn(missing - again)
        out = []
        for body, pieces in zip(bodies, cut):
            ids = None if pieces is None else list(map(self.__getitem__, pieces))
            out.append(self._by_runs(body) if ids is None or None in ids else b"".join(ids))
        return out


def tokenizer(path: str) -> Tokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokens(path)
    return _TOKENIZERS[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, doc_id: str, text: str, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's tokens in pieces of at most the capacity."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    close = np.array([end], "<u4").tobytes()

    def cut(frames):
        known = tokenizer(path)
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                out = []
                for i, ids in zip(part["id"], known.encode_all(part["body"])):
                    ids += close
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        out.append((i, k, a // 4, len(own) // 4, zlib.crc32(own), *([own] if keep_ids else [])))
                yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    return rows.mapInPandas(cut, PIECES + (", ids binary" if keep_ids else ""))


def sweep(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in descending size, gaps before pieces of their size -> (gap of each matched piece, -1 elsewhere; free gaps).

    A piece takes the gap laid down last, as a closing bracket its opening one: rows of equal depth alternate."""
    level = np.cumsum(np.where(is_gap, 1, -1))
    floor = np.minimum.accumulate(np.minimum(level, 0))
    depth = level - floor + ~is_gap
    unmatched = ~is_gap & (level < np.concatenate(([0], floor[:-1])))
    rows = np.flatnonzero(~unmatched)
    rows = rows[np.argsort(depth[rows], kind="stable")]
    pairs = np.flatnonzero(is_gap[rows[:-1]] & ~is_gap[rows[1:]] & (depth[rows[:-1]] == depth[rows[1:]]))
    partner = np.full(len(is_gap), -1)
    partner[rows[pairs + 1]] = rows[pairs]
    free = is_gap.copy()
    free[rows[pairs]] = False
    return partner, np.flatnonzero(free)


def between_parts(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(part, waiting pieces, free gaps) in order -> runs (part of the pieces, first rank, pieces, part of the gaps, last rank, number).

    The same sweep over whole parts: pieces of a part take free gaps of the parts before it, the latest and tightest first.
    Piece rank first + i takes gap rank last - i and both have the number + i."""
    stack, runs, number = [], [], 0
    for part, pieces, gaps in sorted(counts):
        rank = 0
        while rank < pieces and stack:
            other, free = stack.pop()
            n = min(free, pieces - rank)
            runs.append((part, rank, n, other, free - 1, number))
            rank, number = rank + n, number + n
            if free > n:
                stack.append((other, free - n))
        if gaps:
            stack.append((part, gaps))
    return runs


#: Slots and pieces of different parts meet by broadcast as long as they are counted to be so few; beyond that, in a shuffle.
FEW = 50_000
#: kind 0: a piece with its sequence; 1: a waiting piece; 2: a free slot; 3: the part's counts of both (in key and length).
SWEPT = "kind int, key long, length long, sequence long, slot int, part int, rank long"


def _swept(events: DataFrame, n_parts: int) -> DataFrame:
    """events (size, is_piece, key, slot), key being the piece's or the sequence's -> SWEPT rows."""
    keys = [F.col("size").desc(), F.col("is_piece").asc(), F.col("key").asc(), F.col("slot").asc()]

    def match(frames):
        part = TaskContext.get().partitionId()
        rows = pd.concat(list(frames) or [pd.DataFrame(columns=["size", "is_piece", "key", "slot"])])  # about PART rows
        is_gap = rows["is_piece"].to_numpy(np.int64) == 0
        if not len(is_gap):
            return
        size, key, slot = (rows[c].to_numpy(np.int64) for c in ("size", "key", "slot"))
        partner, free = sweep(is_gap)
        done, waiting = np.flatnonzero(partner >= 0), np.flatnonzero(~is_gap & (partner < 0))
        for kind, at, to in ((0, done, partner[done]), (1, waiting, waiting), (2, free, free)):
            yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "key": key[at], "length": size[at], "sequence": key[to], "slot": slot[to].astype(np.int32), "part": np.full(len(at), part, np.int32), "rank": np.arange(len(at))})
        yield pd.DataFrame({"kind": [3], "key": [len(waiting)], "length": [len(free)], "sequence": [0], "slot": [0], "part": [part], "rank": [0]})

    return events.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).mapInPandas(match, SWEPT)


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (key, length), written -> (key, sequence_id, offset)."""
    spark = parts.sparkSession
    waiting, gaps, placed, opened = parts.select("key", "length"), None, [], 0
    while True:
        state = waiting.agg(F.count("*"), F.sum("length"), F.min("length"), F.max("length")).first()
        if not state[0]:
            break
        n, total, least, most = state
        widest, n_gaps = gaps.agg(F.max("gap"), F.count_if(F.col("gap") >= least)).first() if gaps is not None else (0, 0)
        if most > (widest or 0):
            if gaps is not None:
                total = waiting.where(F.col("length") > (widest or 0)).agg(F.sum("length")).first()[0]
            new = -(-total // capacity)
            fresh = spark.range(opened, opened + new).select(F.col("id").alias("sequence"), F.lit(capacity).cast("long").alias("gap"))
            gaps = fresh if gaps is None else gaps.union(fresh)
            opened, n_gaps = opened + new, n_gaps + new
        # Equal slots for the largest waiting piece; about two per waiting piece in all are enough.
        slots = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / most), F.lit(1 + 2 * n // max(n_gaps, 1)))).cast("int")
        offers = gaps.where(F.col("gap") >= least).withColumn("n", slots)
        offers = offers.select(F.floor(F.col("gap") / F.col("n")).cast("long").alias("size"), F.lit(0).alias("is_piece"), F.col("sequence").alias("key"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"))
        events = offers.union(waiting.select("length", F.lit(1), "key", F.lit(0)))
        swept = C.materialize(_swept(events, 1 + (2 * n + n_gaps) // PART), "swept")
        counts = swept.where("kind = 3").select("part", "key", "length").collect()  # two numbers per part
        runs = between_parts([tuple(r) for r in counts])
        # At most two runs per part.
        table = F.broadcast(spark.createDataFrame(runs, "of int, first long, n long, other int, last long, number long"))
        pieces = swept.where("kind = 1").join(table, (F.col("part") == F.col("of")) & F.col("rank").between(F.col("first"), F.col("first") + F.col("n") - 1), "left")
        pieces = pieces.select("key", "length", (F.col("number") + F.col("rank") - F.col("first")).alias("match"))
        free = swept.where("kind = 2").join(table, (F.col("part") == F.col("other")) & F.col("rank").between(F.col("last") - F.col("n") + 1, F.col("last")))
        free = free.select("sequence", "slot", (F.col("number") + F.col("last") - F.col("rank")).alias("match"))
        own = swept.where("kind = 0").select("key", "length", "sequence", "slot")
        if runs:
            own = own.union(pieces.where("match is not null").join(F.broadcast(free) if sum(r[2] for r in runs) <= FEW else free, "match").select("key", "length", "sequence", "slot"))
        placed.append(C.materialize(own.withColumn("turn", F.lit(len(placed))), "placed"))
        taken = gaps.union(placed[-1].select("sequence", -F.col("length"))).groupBy("sequence").agg(F.sum("gap").alias("gap"))
        gaps = C.materialize(taken.where("gap > 0"), "gaps")
        waiting = pieces.where("match is null").select("key", "length")
    if not placed:
        return parts.select("key", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).where(F.lit(False))
    before = Window.partitionBy("sequence").orderBy("turn", "slot", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most `capacity` rows
    return reduce(DataFrame.union, placed).select("key", F.col("sequence").alias("sequence_id"), (F.sum("length").over(before) - F.col("length")).alias("offset"))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces -> with sequence_id and offset."""
    parts = C.materialize(parts.withColumn("key", F.monotonically_increasing_id()), "pieces")  # written once, so keys are fixed
    return parts.join(place(parts, capacity), "key").drop("key")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs."""
    return pack(pieces(docs, doc_id, text, path or vocabulary(), capacity, end), capacity).select(F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, at most the capacity of ids each."""
    found = pack(pieces(docs, doc_id, text, path or vocabulary(), capacity, end, keep_ids=True), capacity)
    one = found.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def join(frames):
        for pdf in frames:
            yield pd.DataFrame({"sequence_id": pdf["sequence_id"], "n_tokens": pdf["n_tokens"], "ids": [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64) for parts in pdf["parts"]]})

    return one.mapInPandas(join, "sequence_id long, n_tokens long, ids array<bigint>")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(C.table(spark, sf_dir, "documents"))
