"""URL filter: allow and block rules by host suffix and path prefix, boosted trees on lexical features for the rest.

The trees are grown by Spark's gradient-boosted classifier on at most ``sample_rows`` labelled URLs (in the
order of a hash) and then compiled into one column expression, so judging a URL is arithmetic inside the
scan: no shuffle, no Python. Features: lengths, depth, digit ratio, character entropy, parameter counts,
separators, and the smoothed block rate of the host's last label in the sample.

The query has no labelled table, so it labels a sample of the URLs themselves by ``SEED_WORDS``: a host
with such a word is a blocked example, any other an allowed one. The words aren't features.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by
its (empty) features; ties between rules of equal length go to the first by text; repeated rows get equal
verdicts; a sample with labels of one kind gives that verdict everywhere, an empty one allows everything;
an empty table gives an empty result; only the id and URL columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.llm._common import ascii_lower, table

SAMPLE_ROWS = 20_000
#: A suffix needs so many labelled URLs to have a rate of its own, which bounds their number.
LEAST_SUFFIX = 50
TREES, DEPTH, STEP = 20, 3, 0.2

#: (verdict, rule): a host and a path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Words of host names that mark unwanted sites.
SEED_WORDS = ("ad", "ads", "adult", "bet", "bets", "bonus", "casino", "cheap", "click", "crypto", "deal", "deals", "farm", "free", "loan", "loans", "pill", "pills", "poker", "porn", "promo", "replica", "seo", "sex", "slots", "spam", "track", "tracker", "viagra", "win", "xxx")

LEXICAL = ("url_length", "host_length", "host_labels", "depth", "longest_segment", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "query_length", "percent_signs", "fragment")


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule as struct(verdict, rule), or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    size = lambda c: F.length(c).cast("double")
    kept = lambda c, pattern: F.length(F.regexp_replace(c, pattern, "")).cast("double")
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    segments = F.array_remove(F.split(path, "/"), "")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    entropy = F.aggregate(F.array_distinct(F.array_remove(F.split(text, ""), "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return {
        "url_length": size(text),
        "host_length": size(host),
        "host_labels": F.size(F.array_remove(F.split(host, r"\."), "")).cast("double"),
        "depth": F.size(segments).cast("double"),
        "longest_segment": F.coalesce(F.array_max(F.transform(segments, F.length)), F.lit(0)).cast("double"),
        "digit_ratio": kept(text, "[^0-9]+") / F.greatest(F.length(text), F.lit(1)),
        "host_digits": kept(host, "[^0-9]+"),
        "hyphens": kept(host, "[^-]+"),
        "entropy": entropy,
        "parameters": F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(F.lit(0)).cast("double"),
        "query_length": size(query),
        "percent_signs": kept(text, "[^%]+"),
        "fragment": F.contains(text, F.lit("#")).cast("double"),
    }


@dataclass(frozen=True)
class UrlModel:
    """Weighted trees as nested (feature, threshold, left, right) or leaf values; ``suffixes``: block rates."""

    trees: tuple[tuple[float, tuple | float], ...]
    suffixes: tuple[tuple[str, float], ...]
    prior: float

    def suffix_rate(self, host: Column) -> Column:
        known = [x for s, rate in self.suffixes for x in (F.lit(s), F.lit(rate))]
        own = F.element_at(F.split(host, r"\."), -1)
        return F.coalesce(F.try_element_at(F.create_map(*known), own), F.lit(self.prior)) if known else F.lit(self.prior)

    def chance(self, values: dict[str, Column]) -> Column:
        """Chance of a block by the compiled trees."""
        if not self.trees:
            return F.lit(self.prior)
        names = (*LEXICAL, "suffix_rate")

        def grown(node: tuple | float) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(values[names[feature]] <= threshold, grown(left)).otherwise(grown(right))

        margin = reduce(lambda a, b: a + b, (F.lit(w) * grown(t) for w, t in self.trees))
        return 1 / (1 + F.exp(-2 * margin))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """A model from (url, blocked boolean); at most ``sample_rows`` of them, by a hash of the URL."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    some = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("double").alias("label"))
    some = some.groupBy("url").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(sample_rows)
    host, path = host_and_path(F.col("url"))
    some = some.withColumns({"host": host, "path": path}).cache()
    try:
        n, blocked = some.agg(F.count("*"), F.sum("label")).first()
        if not n or not 0 < blocked < n:
            return UrlModel((), (), 1.0 if n and blocked else 0.0)
        prior = blocked / n
        rates = some.groupBy(F.element_at(F.split("host", r"\."), -1).alias("s")).agg(F.count("*").alias("n"), F.sum("label").alias("b")).where(F.col("n") >= LEAST_SUFFIX)
        suffixes = tuple((r["s"], (r["b"] + 10 * prior) / (r["n"] + 10)) for r in rates.orderBy("s").collect())
        model = UrlModel((), suffixes, prior)
        values = lexical(F.col("url"), F.col("host"), F.col("path")) | {"suffix_rate": model.suffix_rate(F.col("host"))}
        frame = VectorAssembler(inputCols=list(values), outputCol="features").transform(some.withColumns(values).coalesce(1).orderBy("url"))
        grown = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1).fit(frame)

        def nodes(node) -> tuple | float:
            if not node.getClass().getSimpleName().startswith("Internal"):
                return float(node.prediction())
            return (node.split().featureIndex(), float(node.split().threshold()), nodes(node.leftChild()), nodes(node.rightChild()))

        trees = tuple((float(w), nodes(t._call_java("rootNode"))) for w, t in zip(grown.treeWeights, grown.trees, strict=True))
        return UrlModel(trees, suffixes, prior)
    finally:
        some.unpersist()


def seed_labels(urls: DataFrame) -> DataFrame:
    """(url, blocked) by the seed words in host names."""
    host, _ = host_and_path(F.col("url"))
    words = F.split(host, r"[.\-_]")
    return urls.select("url", F.arrays_overlap(words, F.array(*map(F.lit, SEED_WORDS))).alias("blocked"))


def judge(pages: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, chance) of every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    df = df.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    values = {f"__{k}": c for k, c in (lexical(F.col("url"), F.col("host"), F.col("path")) | {"suffix_rate": model.suffix_rate(F.col("host"))}).items()}
    df = df.withColumns(values)
    df = df.withColumn("chance", model.chance({k[2:]: F.col(k) for k in values}))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("chance") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return df.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "chance")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every row of ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(seed_labels(pages)))


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLE: dict[str, str] = {}
