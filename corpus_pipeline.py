"""A training corpus in five stages: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
docs.  All but the last return the columns of `documents`.

Rows in every stage: null texts count as empty; rows without an id are kept and handled one by one; rows that repeat an id with
other texts are told apart, except that of a group of near duplicates one row stays; very long texts are handled whole; an empty
table stays empty; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreweave.llm import common as C
from scoreweave.llm import ngram_jaccard, packing, source_mixing, substring_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that op 8 scores under one half; the examples are labelled rows of these very documents."""
    docs = docs.select(*COLUMNS)
    scored = toxicity.score(docs, toxicity.learn(spark, docs, sf_dir))
    return scored.where("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of op 6; of rows that share this id, the least by text.

    Documents without an id are all kept."""
    docs = docs.select(*COLUMNS)
    found = ngram_jaccard.jaccard_components(docs)
    firsts = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count()
    alone, several = (docs.join(firsts.where(rows).select("doc_id"), "doc_id", "left_semi") for rows in ("count = 1", "count > 1"))
    least = several.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("one")).select("doc_id", "one.*")
    return alone.select(*COLUMNS).union(least.select(*COLUMNS)).union(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts (op 9); every document stays, a text may become empty."""
    return substring_dedup.remove_repeats(docs, keep=["lang", "source"]).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as op 3 takes it (0 to 3 times).

    Rows alike in id, source and size share the copies that op 3 gives them, in order of their text."""
    docs = docs.select(*COLUMNS).withColumn("size", source_mixing.word_count(F.col("text")).cast("long"))
    alike = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "source")), F.col("doc_id").isNull().alias("no_id"), F.col("source").isNull().alias("no_source"), "size")
    taken = source_mixing.mix(docs).groupBy(alike.alias("alike")).agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")).where("copies > 0")
    joined = docs.withColumn("alike", alike).join(taken, "alike")
    nth = F.row_number().over(Window.partitionBy("alike").orderBy("text", "lang", "n_chars"))
    alone = joined.where("rows = 1").withColumn("times", F.col("copies").cast("int"))
    several = joined.where("rows > 1").withColumn("nth", nth).withColumn("times", F.expr("cast(copies div rows + if(nth <= copies % rows, 1, 0) as int)")).drop("nth")
    times = alone.union(several).where("times > 0")
    return times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens (op 4)."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the nearest-example scores nor the connected components nor the tokens; tests/llm compares the
#: stages with brute force.
ORACLE_SQL = None
