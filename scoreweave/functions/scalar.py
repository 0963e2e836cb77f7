"""Column expressions that the operators share.  All of them stay in the JVM; rounding is half-even (bround)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for a missing value in profiled data (fixed values).
NULL_TOKENS = ("null", "na", "n/a", "nan", "none", "''", ".", "-", "")
#: Text of a plain number (fixed pattern): excludes what a cast accepts beyond it, such as type suffixes.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SMALL = 1e-4


def blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def number(c: Column) -> Column:
    """A number from text, else null; NaN becomes null."""
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def clean_text(c: Column) -> Column:
    """Trimmed, without matching outer quotes (however deep), null tokens as null."""
    out = F.trim(c.cast("string"))
    deep = F.length(F.regexp_extract(out, r"^[\"'\s]+", 0))  # no more pairs than quotes at the start
    out = F.aggregate(F.sequence(F.lit(0), deep), out, lambda text, _: F.trim(F.regexp_replace(text, r"(?s)^([\"'])(.*)\1$", "$2")))
    return F.when(~F.lower(out).isin(*NULL_TOKENS), out)


def draw(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only, so that reruns and other engines agree."""
    text = F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def woe(bads: Column, goods: Column, all_bads: Column, all_goods: Column) -> Column:
    """ln of the share of bads over the share of goods; an empty cell counts as SMALL; 0 if a class is empty."""
    b = F.when(bads > 0, bads / all_bads).otherwise(SMALL)
    g = F.when(goods > 0, goods / all_goods).otherwise(SMALL)
    return F.when((all_bads > 0) & (all_goods > 0), F.bround(F.log(b / g), 5)).otherwise(0.0)


def entropy(bads: Column, n: Column) -> Column:
    """Bits; 0 if one class is empty."""
    p = bads / n
    return F.when((bads > 0) & (bads < n), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def scaling(points: float, odds: float, pdo: float) -> tuple[float, float]:
    """(a, b) of score = a - b * logit: `points` at odds of 1 : odds - 1, doubling every pdo."""
    b = pdo / math.log(2)
    return points + b * math.log(1 / (odds - 1)), b


def score_from_probability(p: Column, a: float, b: float) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - SMALL)), F.lit(SMALL))
    return F.bround(F.lit(a) - F.lit(b) * F.log(p / (1 - p)), 0).cast("int")


def probability_from_score(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(a) - score) / F.lit(b)))


def sanitized(name: str) -> str:
    """A column name that other tools accept."""
    name = re.sub(r"[() \-]", "_", name.replace("#", "_NUM_"))
    return re.sub(r"_{2,}", "_", name).rstrip("_")


def r_names(names: list[str]) -> list[str]:
    """Syntactic and unique names: odd characters become dots, repeats get a number."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[^0-9A-Za-z._]", ".", name)
        base = base if re.match(r"[A-Za-z]|\.(?![0-9])", base) else "X" + base
        n = sum(1 for x in out if x == base or re.fullmatch(re.escape(base) + r"\.[0-9]+", x))
        out.append(f"{base}.{n}" if n else base)
    return out
