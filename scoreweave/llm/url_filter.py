"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule `host/path` fits its host and all subdomains if the URL's path starts with the rule's; the longest rule that fits
wins.  URLs that a rule decides are the labelled ones; the trees are trained on at most SAMPLE of them (distinct, chosen by a
hash), on length, depth, digit ratio, character entropy, parameter and label counts, and statistics of the host's suffix
(its block rate among the domains of the training URLs, smoothed, and how many these are).  A domain counts once, however many
URLs it has, so one rule's domain does not speak for all of its suffix; and a training URL's own statistics come from the
domains of the other FOLDS, so neither its label nor its rule's other URLs are part of its features.  URLs that no rule fits get the trees' verdict.

Everything but the fit is one projection over the pages; suffix statistics are learnt from the sample too, so their size is
bounded by it.

Rows: a null URL or one without :// has an empty host and path and is judged like any other.  Without labels of both kinds
the verdict is the only kind there is, or allow.  Very long URLs are judged whole.  Repeated rows are judged each; an empty table
gives an empty result.  Extra columns stay, whatever their names; those named as a result (host, path, rule, score, verdict)
give way to it.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

SAMPLE, TREES, DEPTH, SEED, FOLDS, PRIOR = 20_000, 12, 4, 7, 5, 10
#: rule -> verdict (fixed values).
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
FEATURES = ["length", "host_length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "suffix_rate", "suffix_count"]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    text = F.coalesce(F.col(url), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.translate(F.regexp_extract(text, URL, 1), upper, lower), "path": F.regexp_extract(text, URL, 2)})


def ruled(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """parsed pages with rule and its verdict (else null)."""
    rule = F.lit(None).cast("string")
    verdict = rule
    for name in sorted(rules, key=len):  # a longer rule overrides
        host, slash, path = name.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(rules[name])).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """parsed pages with the features of the URL alone, and its suffix."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    count = lambda what, of=text: F.length(of) - F.length(F.replace(of, F.lit(what)))
    share = lambda c: (n - F.length(F.replace(text, c))) / n
    letters = F.array_distinct(F.split(text, ""))
    entropy = F.aggregate(F.filter(letters, lambda c: F.length(c) > 0), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    digits = n - F.length(F.translate(text, "0123456789", ""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return pages.withColumns(
        {
            "length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": count("/", F.col("path")).cast("double"),
            "digits": F.when(n > 0, digits / n).otherwise(0.0),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "parameters": F.when(F.length(query) > 0, count("&", query) + 1).otherwise(0).cast("double"),
            "labels": count(".", F.col("host")).cast("double"),
            "hyphens": count("-").cast("double"),
            "suffix": F.element_at(F.split("host", r"\."), -1),
            "domain": F.substring_index("host", ".", -2),
        }
    )


def _with_suffix(rows: DataFrame, stats: DataFrame, rate: float) -> DataFrame:
    # stats has a row per suffix of the training sample: at most SAMPLE rows
    joined = rows.join(F.broadcast(stats), "suffix", "left")
    return joined.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(rate)), "suffix_count": F.coalesce("suffix_count", F.lit(0.0))})


def train(labelled: DataFrame, url: str = "url", sample: int = SAMPLE):
    """lexical rows with y (1: block) -> (model or None, suffix statistics, block rate)."""
    kept = labelled.select(url, "suffix", "domain", "y", *FEATURES[:-2]).dropDuplicates([url])
    kept = C.materialize(kept.orderBy(F.xxhash64(url), url).limit(sample), "urls").repartition(4)
    n, blocked = kept.agg(F.count("*"), F.sum("y")).first()
    rate = float(blocked or 0) / n if n else 0.0
    smoothed = lambda blocked, of: (blocked + PRIOR * rate) / (of + PRIOR)
    # At most `sample` rows: the block rate of each domain, and the fold it is in.
    domains = C.materialize(kept.groupBy("suffix", "domain").agg(F.avg("y").alias("y")).withColumn("fold", F.pmod(F.xxhash64("domain"), F.lit(FOLDS))), "domains")
    stats = C.materialize(domains.groupBy("suffix").agg(smoothed(F.sum("y"), F.count("*")).alias("suffix_rate"), F.count("*").cast("double").alias("suffix_count")), "suffixes")
    if not 0 < rate < 1:
        return None, stats, rate
    every, own = Window.partitionBy("suffix"), Window.partitionBy("suffix", "fold")
    others = lambda x: F.sum(x).over(every) - F.sum(x).over(own)
    folded = domains.withColumn("one", F.lit(1.0))
    folded = folded.select("domain", smoothed(others("y"), others("one")).alias("suffix_rate"), (others("one") * FOLDS / (FOLDS - 1)).alias("suffix_count"))
    folded = kept.join(folded, "domain")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(folded).select("features", "y").repartition(4).cache()
    model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED).fit(ready)
    ready.unpersist()
    return model, stats, rate


def predict(rows: DataFrame, model, stats: DataFrame, rate: float) -> DataFrame:
    """lexical rows with score: the probability of block."""
    rows = _with_suffix(rows, stats, rate)
    if model is None:
        return rows.withColumn("score", F.lit(rate))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return scored.withColumn("score", vector_to_array("probability")[1])


def judge(pages: DataFrame, rules: dict[str, str] = RULES, url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """pages with host, path, rule, score and verdict."""
    own = pages.select(F.struct("*").alias("row"), F.col(url).alias("url"))  # so that no column of pages meets one of ours
    rows = lexical(ruled(parsed(own), rules))
    labelled = rows.where(F.col("ruled").isNotNull() & F.col("url").isNotNull()).withColumn("y", (F.col("ruled") == "block").cast("double"))
    scored = predict(rows, *train(labelled, sample=sample))
    found = scored.withColumn("verdict", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
    results = ["host", "path", "rule", "score", "verdict"]
    return found.select(*(F.col("row")[c].alias(c) for c in pages.columns if c not in results), *results)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
