"""Reject inference, flags, filters, column partition and attribute typing: projections and single aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.window import Window

from ..functions import scalar as S
from ..sources.shared import materialize


def placed_after(df: DataFrame, new: str, source: str) -> DataFrame:
    """df with the column `new` right after `source`."""
    rest = [c for c in df.columns if c != new]
    at = rest.index(source) + 1
    return df.select(*(F.col(f"`{c}`") for c in [*rest[:at], new, *rest[at:]]))


def reject_inference(df: DataFrame, key: str | None = None, seed: int = 0) -> DataFrame:
    """Outcome of rejected applications, drawn at their expected default rate, and group means for their returns.

    isFPD_wRI: IsFPD where a loan exists, else FPD; a missing one is 1 with probability expected_DefaultRate2.  With a key the
    draw depends on seed and key only; without, rand(seed) is used.  FRODI26_wRI and GRODI26_wRI: missing values get the
    mean of the loans whose own IsFPD equals the inferred flag.
    """
    loan = ~S.blank(F.col("LoanID"))
    u = S.draw(str(seed), F.col(key)) if key else F.rand(seed)
    own = F.when(loan, F.col("IsFPD")).otherwise(F.col("FPD"))
    drawn = F.when(~loan & own.isNull() & F.col("expected_DefaultRate2").isNotNull(), (u <= F.col("expected_DefaultRate2")).cast("int"))
    out = df.withColumn("isFPD_wRI", F.coalesce(own, drawn).cast("int"))
    means = df.agg(*(F.avg(F.when(F.col("IsFPD") == y, F.col(c))).alias(f"_{c}{y}") for c in ("FRODI26", "GRODI26") for y in (0, 1)))
    out = out.crossJoin(F.broadcast(means))  # one row
    for c in ("FRODI26", "GRODI26"):
        mean = F.when(F.col("isFPD_wRI") == 1, F.col(f"_{c}1")).when(F.col("isFPD_wRI") == 0, F.col(f"_{c}0"))
        out = out.withColumn(f"{c}_wRI", F.coalesce(F.col(c), mean))
    out = out.drop(*(f"_{c}{y}" for c in ("FRODI26", "GRODI26") for y in (0, 1)))
    for new, source in (("isFPD_wRI", "IsFPD"), ("FRODI26_wRI", "FRODI26"), ("GRODI26_wRI", "GRODI26")):
        out = placed_after(out, new, source)
    return out


def bad_flag(df: DataFrame, column: str = "GRODI26_wRI", flag: str = "isBad", below: float = 1, keep_null: bool = False) -> DataFrame:
    """The flag as first column: 1 if the value is below the bound; null counts as 0 unless it is kept."""
    value = (F.col(f"`{column}`") < below).cast("int")
    value = value if keep_null else F.coalesce(value, F.lit(0))
    return df.select(value.alias(flag), *(F.col(f"`{c}`") for c in df.columns if c != flag))


def score_filter(df: DataFrame, column: str = "CCR.score", least: float = 480) -> DataFrame:
    """Rows whose value is a number of at least the bound; the column becomes a number."""
    return df.withColumn(column, S.number(F.col(f"`{column}`"))).where(F.col(f"`{column}`") >= least)


def score_filter_counts(df: DataFrame, column: str = "CCR.score", least: float = 480) -> DataFrame:
    v = S.number(F.col(f"`{column}`"))
    return df.agg(F.count("*").alias("total"), F.count_if(v.isNull()).alias("missing"), F.count_if(v < least).alias("below"), F.count_if(v >= least).alias("kept"), (F.count("*") - F.count_if(v >= least)).alias("removed"))


def strip_quotes(df: DataFrame, column: str = "b_Score") -> DataFrame:
    return df.withColumn(column, F.translate(F.col(f"`{column}`").cast("string"), "'", ""))


def is_side_column(name: str) -> bool:
    low = name.lower()
    return name.startswith(("b_", "WOE_")) or low.endswith("_points") or any(x in low for x in ("date", "code", "basescore", "unq_id", "nodeid", "avg_"))


def partition_columns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the side columns, the others), by name alone."""
    side = [c for c in df.columns if is_side_column(c)]
    return df.select(*(F.col(f"`{c}`") for c in side)), df.select(*(F.col(f"`{c}`") for c in df.columns if c not in side))


def sanitize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(S.sanitized(c) for c in df.columns))


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at most one distinct value besides null: min = max, so no distinct aggregate is needed."""
    row = df.agg(*(F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`")).alias(str(k)) for k, c in enumerate(columns))).first()
    return [c for k, c in enumerate(columns) if row[k]]


# ---------------------------------------------------------------- attribute typing

PROFILE = "Variable string, Include boolean, Role string, Type string, Level string, Cardinality long, Missing long, Convertible boolean, Whole boolean, Min double, Max double, DefaultBins int, OrderedDisplay string, MissingValues string, Samples string, Position int, Rows long"


#: Samples per column; below so many distinct values an integer or a number in text is discrete, in text one bin each; above so many whole numbers in text are
#: continuous; bins of a continuous variable (fixed values).
SAMPLES, DISCRETE_INT, DISCRETE_TEXT, EACH_TEXT, CONTINUOUS_TEXT, DEFAULT_BINS = 5, 21, 20, 10, 50, 10


def value_counts(df: DataFrame) -> DataFrame:
    """(k, value, n): how often each value, as text, stands in column k; one unpivoted pass, counted within tasks first."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in enumerate(df.columns)))
    return df.select(F.explode(pairs).alias("x")).groupBy("x.k", "x.value").agg(F.count("*").alias("n"))


def profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """A row per column: type, level of measurement, cardinality, missing values, bins and samples.

    The table is unpivoted and counted once; everything follows from the counts of (column, value), which are written before they are read twice.  Samples
    are the SAMPLES most frequent values, ties by text."""
    counts = materialize(value_counts(df), "values")
    text = S.clean_text(F.col("value"))
    number = F.when(text.rlike(S.NUMBER), text.try_cast("double"))
    facts = counts.withColumns({"text": text, "number": number}).groupBy("k").agg(
        F.count("value").alias("card"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count_if(F.col("text").isNotNull() & F.col("number").isNull()).alias("odd"),
        F.count("text").alias("seen"),
        F.coalesce(F.bool_and(F.col("number") == F.bround("number", 0)), F.lit(False)).alias("whole"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
    )
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.col("n").desc(), "value"))
    first = counts.where("value is not null").withColumn("place", place).where(F.col("place") <= SAMPLES)
    known = {r["k"]: r for r in facts.collect()}  # a row per column
    some: dict[int, list[str]] = {}
    for r in first.select("k", F.coalesce(S.clean_text(F.col("value")), "value").alias("value")).orderBy("k", "place").collect():  # SAMPLES rows per column
        some.setdefault(r["k"], []).append(r["value"])
    rows, n = [], df.count()
    for k, f in enumerate(df.schema.fields):
        r = known.get(k)
        card, convertible, whole = (r["card"], r["odd"] == 0 and r["seen"] > 0, bool(r["whole"])) if r else (0, False, False)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            kind, level, bins = "integer", "discrete" if card < DISCRETE_INT else "continuous", min(card, DEFAULT_BINS)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            kind, level, bins = "float", "continuous", DEFAULT_BINS
        elif not convertible:
            kind, level, bins = "factor", "nominal", 1
        elif card < DISCRETE_TEXT:
            kind, level, bins = "factor", "discrete", card if card < EACH_TEXT else 1
        else:
            kind, level, bins = "factor", "continuous" if not whole or card > CONTINUOUS_TEXT else "discrete", DEFAULT_BINS
        own = f.name == target
        rows.append((f.name, True, "target" if own else "predictor", kind, level, card, r["missing"] if r else 0, convertible, whole, r["min"] if r else None, r["max"] if r else None, int(bins), "range" if own else None, "float" if own else None, ", ".join(some.get(k, [])), k, n))
    return df.sparkSession.createDataFrame(rows, PROFILE)


def override(meta: DataFrame, edits: dict[str, dict[str, object]]) -> DataFrame:
    """The profile with cells replaced: {variable: {column: value}}."""
    for variable, cells in edits.items():
        for name, value in cells.items():
            meta = meta.withColumn(name, F.when(F.col("Variable") == variable, F.lit(value).cast(meta.schema[name].dataType)).otherwise(F.col(name)))
    return meta


def apply_types(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Columns cast as the profile says; those that are not included go."""
    out = []
    for r in meta.select("Variable", "Include", "Level", "Position").orderBy("Position").collect():  # a row per column
        if not r["Include"]:
            continue
        c = F.col(f"`{r['Variable']}`")
        if r["Level"] in ("nominal", "ordinal"):
            c = S.clean_text(c)
        elif r["Level"] == "continuous":
            c = S.number(S.clean_text(c))
        elif r["Level"] == "discrete":
            c = F.bround(S.number(S.clean_text(c)), 0).cast("int")
        out.append(c.alias(r["Variable"]))
    return df.select(*out)
