"""Media columns: payloads stored as lossless WebP and read back as pixel arrays.

A payload is cut into rows of SAMPLES grey samples; an image holds at most ROWS rows, so a long payload becomes
several images, one after the other, and neither side ever holds more than one image's working arrays (some 100 MB).
Reading decodes them with the decoder of ``webp`` and assumes nothing about how they were written: any lossless WebP
works, colour included.  What is stored carries the payload's digest; a read that gives other bytes raises an error, so
a damaged image cannot pass as the payload.

Rows: a null or empty text is one row of the filler.  Texts of any length are stored whole.  Equal texts have equal values.
A null or broken image gives null pixels and its error as text.  Rows that repeat are stored each; extra columns are not
touched, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import webp

SAMPLES, FILLER = 576, b"\xff"
#: Rows of an image at most (295 KB of samples).
ROWS = 512
STORED = "id string, n_bytes long, media binary, digest binary"


def padded(body: bytes) -> bytes:
    """The body, filled up to a positive multiple of SAMPLES bytes."""
    return body + FILLER * (SAMPLES - len(body) % SAMPLES if len(body) % SAMPLES or not body else 0)


def store_payload(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    return b"".join(webp.encode_grey(rows[a : a + ROWS]) for a in range(0, len(rows), ROWS))


def images_of(media: bytes) -> list[bytes]:
    found, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        found.append(media[at:end])
        at = end
    return found


def load_payload(media: bytes) -> bytes:
    """The grey samples of the images, from their decoded pixels."""
    return b"".join(((webp.decode(x)[2] >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes() for x in images_of(media))


def features(samples: np.ndarray) -> str:
    """What the samples look like: rows, distinct values, sums of value, square and step, and a 64-bit average hash."""
    values = samples.astype(np.int64)
    held = np.bincount(samples, minlength=256)
    cells = np.add.reduceat(values, np.arange(64) * len(values) // 64) * 64 / len(values)
    bits = int("".join("1" if x else "0" for x in cells > values.mean()), 2)
    step = int(np.abs(np.diff(values)).sum())
    return f"rows={len(values) // SAMPLES};distinct={int((held > 0).sum())};sum={int(values.sum())};squares={int((values * values).sum())};steps={step};hash={bits:016x}"


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media, digest): each text's UTF-8 bytes as lossless WebP; the digest is that of the payload."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def write(frames):
        for pdf in frames:
            payloads = [padded(x) for x in pdf["body"]]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [len(x) for x in pdf["body"]], "media": [store_payload(x) for x in payloads], "digest": [hashlib.sha256(x).digest() for x in payloads]})

    return rows.mapInPandas(write, STORED)


def decode_column(media: DataFrame, column: str = "media") -> DataFrame:
    """media with width, height, pixels (little-endian uint32 ARGB, row by row) and error, for any lossless WebP."""

    def read(frames):
        for pdf in frames:
            out = []
            for data in pdf[column]:
                try:
                    width, height, pixels = webp.decode(data)
                    out.append((width, height, pixels.astype("<u4").tobytes(), None))
                except (ValueError, TypeError, IndexError) as e:
                    out.append((None, None, None, f"{type(e).__name__}: {e}"))
            got = pd.DataFrame(out, columns=["width", "height", "pixels", "error"], index=pdf.index).astype({"width": "Int32", "height": "Int32"})
            yield pd.concat([pdf, got], axis=1)

    from pyspark.sql import types as T

    return media.mapInPandas(read, C.widened(media, width=T.IntegerType(), height=T.IntegerType(), pixels=T.BinaryType(), error=T.StringType()))


def digests(stored: DataFrame) -> DataFrame:
    """What the stored media hold, read back: digests of the payload and of the media, and the features."""

    def read(frames):
        for pdf in frames:
            out = []
            for i, n, media, digest in zip(pdf["id"], pdf["n_bytes"], pdf["media"], pdf["digest"]):
                payload = load_payload(media)
                held = hashlib.sha256(payload)
                if held.digest() != digest:
                    raise ValueError(f"the media of row {i} hold other bytes than were stored")
                out.append((i, n, len(payload), held.hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(payload, np.uint8))))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInPandas(read, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = digests(store(docs))
    return found.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *found.columns[1:])
