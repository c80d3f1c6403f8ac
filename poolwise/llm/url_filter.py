"""URL filtering: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and Spark ML, which runs in the JVM. URLs that a rule decides are the
labelled URLs. The trees learn from at most ``TRAIN_ROWS`` distinct ones, half of them of each verdict, those with the
smallest hash of their url, weighted by one plus the logarithm of their copies; so the fit does not grow with the table
and copies of one url cannot fill it. Suffix statistics count all rows.

Features: lengths of url, host and path, path depth, host labels, share of digits, hyphens, query
parameters, character entropy, and of the host's suffix (its last two labels), alone and with the first part of the
path, the logarithm of its count and its smoothed share of blocked labelled URLs. The shares come from one half of the labelled URLs, by hash, and
the trees learn from the other half.

Defined results: a null url, or one without ``://``, has empty host and path and no rule, and is judged
by the trees; repeated rows are judged alike, each for itself; where the URLs to learn from
have labels of only one verdict, or none, the method gives that verdict, or allow; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwise.functions import broadcast_if_small
from poolwise.session import cut_lineage

TRAIN_ROWS = 20_000
TREES, DEPTH = 12, 3
PRIOR_ROWS = 20
STATISTICS = ("f_suffix_count", "f_suffix_blocked", "f_opening_count", "f_opening_blocked")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def shown(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def split_url(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    )


def first_rule(rules: tuple[Rule, ...], shown) -> Column:
    """``shown(rule)`` of the longest rule that fits, else null; for rule lists that fit an expression."""
    ranked = sorted(rules, key=lambda r: -len(r.shown))
    return F.coalesce(*[F.when(r.fits(), F.lit(shown(r))) for r in ranked], F.lit(None).cast("string"))


def occurrences(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def entropy(text: Column) -> Column:
    """Bits per character."""
    signs = F.split(text, "")
    share = lambda c: F.size(F.filter(signs, lambda x: x == c)) / F.size(signs)
    return F.aggregate(F.array_distinct(signs), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def features() -> dict[str, Column]:
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    length = F.length(url).cast("double")
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return {
        "f_length": length,
        "f_host": F.length(host).cast("double"),
        "f_path": F.length(path).cast("double"),
        "f_depth": occurrences(path, "/").cast("double"),
        "f_labels": occurrences(host, ".").cast("double"),
        "f_digits": F.when(length > 0, digits / length).otherwise(0.0),
        "f_hyphens": occurrences(url, "-").cast("double"),
        "f_parameters": occurrences(url, "=").cast("double"),
        "f_entropy": F.when(length > 0, entropy(url)).otherwise(0.0),
    }


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, train_rows: int = TRAIN_ROWS, learn: Column | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, method_verdict (that of the trees alone).

    ``learn``, over url, host and path, keeps the rest of the labelled urls out of the fit and of the suffix statistics.
    """
    named = split_url(pages.select("page_id", "url"))
    labels = F.split("host", r"\.")
    rows = named.withColumns(
        {
            "rule": first_rule(rules, lambda r: r.shown),
            "label_text": first_rule(rules, lambda r: r.verdict),
            "suffix": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
            "opening": F.regexp_extract("path", "^/([^/]*)/", 1),
        }
    )
    taught = F.col("label_text") if learn is None else F.when(learn, F.col("label_text"))
    rows = rows.withColumn("label", F.when(taught == "block", 1.0).when(taught == "allow", 0.0))
    # One half of the labelled urls gives the suffix shares, the other trains the trees: none speaks for its own label.
    counted = F.when(F.pmod(F.xxhash64("url", F.lit(5)), F.lit(2)) == 0, F.col("label"))
    opening = rows.groupBy("suffix", "opening").agg(F.count("*").alias("n"), F.count(counted).alias("labelled"), F.sum(counted).alias("blocked"))
    whole = opening.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))

    def share(blocked: str, labelled: str, prior: Column) -> Column:
        return (F.coalesce(blocked, F.lit(0.0)) + PRIOR_ROWS * prior) / (F.col(labelled) + PRIOR_ROWS)

    # Read by the sample and by all rows, so it is written once; a hot suffix is not shuffled while the table is small.
    statistics = (
        opening.join(whole, "suffix")
        .withColumn("f_suffix_blocked", share("all_blocked", "all_labelled", F.lit(0.5)))
        .withColumn("f_opening_blocked", share("blocked", "labelled", F.col("f_suffix_blocked")))
        .select("suffix", "opening", F.log1p("all_n").alias("f_suffix_count"), "f_suffix_blocked", F.log1p("n").alias("f_opening_count"), "f_opening_blocked")
    )
    statistics = broadcast_if_small(cut_lineage(statistics))

    # Copies of a url are one row of the sample.
    taught_urls = rows.where(F.col("label").isNotNull() & counted.isNull())
    urls = taught_urls.groupBy("url", "host", "path", "suffix", "opening", "label").agg(F.count("*").alias("copies"))
    drawn = [urls.where(F.col("label") == kind).orderBy(F.xxhash64("url"), "url").limit(train_rows // 2) for kind in (0.0, 1.0)]
    sample = drawn[0].unionByName(drawn[1]).join(statistics, ["suffix", "opening"]).withColumns(features())

    assembler = VectorAssembler(inputCols=[*features(), *STATISTICS], outputCol="features")
    train = assembler.transform(sample.withColumn("weight", 1 + F.log("copies"))).select("label", "weight", "features").persist()
    try:
        kinds = [r.label for r in train.select("label").distinct().collect()]
        if len(kinds) == 2:
            model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=17, weightCol="weight").fit(train)
    finally:
        train.unpersist()
    scored = rows.join(statistics, ["suffix", "opening"]).withColumns(features())
    if len(kinds) < 2:
        judged = scored.withColumn("prediction", F.lit(kinds[0] if kinds else 0.0))
    else:
        judged = model.transform(assembler.transform(scored))
    by_method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("label_text", by_method).alias("verdict"), by_method.alias("method_verdict"))
