"""URL filtering: rules by host and path, and boosted trees on lexical features for the rest.

Everything is columns and MLlib: nothing leaves the JVM. The trees learn from the URLs that a rule
decides, a bounded sample of them, and judge those that no rule fits.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions.binding import let
from framescope.llm.common import draw, draw_limit, small_join

ALLOW, BLOCK = "allow", "block"
#: Expected number of labelled URLs of each verdict that the trees are fitted on at most.
FIT_URLS = 6_000
TREES, DEPTH = 10, 3


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty if it is null or has no ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, F.lit("://")) + F.lit(3), F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
        return F.aggregate(counts, F.lit(0.0), lambda total, p: total - p * F.log2(p))

    return F.when(F.length(text) > 0, let(F.split(text, ""), of)).otherwise(0.0)


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Length, depth, digits, entropy and parameters of a URL. All are finite for any text."""
    text = F.coalesce(url, F.lit(""))
    marks = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c)))
    first = F.element_at(F.split(path, "/"), F.lit(2))
    return {
        "url_length": F.length(text),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": marks(path, "/"),
        "labels": marks(host, "."),
        "hyphens": marks(host, "-"),
        "digit_ratio": _digits(text) / F.greatest(F.length(text), F.lit(1)),
        "path_digits": _digits(path),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "parameters": marks(text, "=") + marks(text, "&"),
        "fragment": marks(text, "#"),
        "secure": text.startswith("https:").cast("int"),
        "extension": path.rlike(r"\.[a-z]{2,5}$").cast("int"),
        "first_length": F.coalesce(F.length(F.try_element_at(F.split(path, "/"), F.lit(2))), F.lit(0)),
    }


def url_rows(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict by rule, host suffix and lexical features of each page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict, "suffix": F.substring_index("host", ".", -1)})
    return rows.withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path"))).drop("url")


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """Per last label of the host: log of its number of URLs, and smoothed share of blocked ones."""
    known, blocked = F.count("ruled"), F.count(F.when(F.col("ruled") == BLOCK, 1))
    return rows.groupBy("suffix").agg(
        F.log1p(F.count("*")).alias("suffix_urls"), ((blocked + 1) / (known + 2)).alias("suffix_blocked")
    )


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("page_id", "host", "path", "rule", "ruled", "suffix")]


def fit_url_trees(rows: DataFrame, fit_urls: int = FIT_URLS) -> GBTClassificationModel | str:
    """Boosted trees on the ruled rows; the only verdict there is if they do not show both."""
    sizes = {r["ruled"]: r["count"] for r in rows.filter("ruled is not null").groupBy("ruled").count().collect()}
    if len(sizes) < 2:
        return next(iter(sizes), ALLOW)
    keep = F.lit(False)
    for verdict, n in sizes.items():
        rate = min(1.0, fit_urls / n)
        keep = keep | ((F.col("ruled") == verdict) & (draw("page_id", "host", "path") < draw_limit(rate)))
    total = sum(min(n, fit_urls) for n in sizes.values())
    sample = rows.filter(keep).withColumn("label", (F.col("ruled") == BLOCK).cast("double"))
    vectors = VectorAssembler(inputCols=feature_names(rows), outputCol="features").transform(sample)
    # Bounded by fit_urls: a few partitions, so that a tree level is one short job.
    few = vectors.select("label", "features").repartition(max(1, min(8, total // 2000)))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=17, cacheNodeIds=False)
    return trees.fit(few)


def filter_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Verdict on each page's URL: (page_id, host, path, rule, verdict, p_block).

    The rule's verdict where one fits, else that of the trees (``p_block`` >= 0.5 blocks). A null URL
    or one without ``://`` has an empty host and path, is fitted by no rule and judged by the trees.
    Repeated rows give repeated results; an empty table gives none; other columns are not read.
    """
    rows = url_rows(pages, rules)
    rows = small_join(rows, suffix_statistics(rows), "suffix")
    model = fit_url_trees(rows)
    if isinstance(model, str):
        scored = rows.withColumn("p_block", F.lit(float(model == BLOCK)))
    else:
        vectors = VectorAssembler(inputCols=feature_names(rows), outputCol="features").transform(rows)
        scored = model.transform(vectors).withColumn("p_block", vector_to_array("probability")[1])
    learned = F.when(F.col("p_block") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "p_block")
