"""URL filter: rules for hosts and paths, and for the rest a logistic regression on hashed character n-grams.

Everything is DataFrame and SQL expressions and spark.ml transformers; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Buckets that n-grams are hashed into, and the lengths of the n-grams.
BUCKETS = 1 << 13
SIZES = (3, 4)

#: Names of sites for the labelled URL table: spam, gambling, tracking and pill shops against ordinary ones (fixed values).
SPAM = [
    "casino-win", "casino-royal-bonus", "online-casino", "cheap-pills", "buy-pills-now", "discount-pharmacy", "free-bets", "sports-bets-tips", "best-bets-odds", "ads-track",
    "click-track-ads", "ads-server", "win-prize-now", "free-money-win", "poker-slots", "cheap-replica-watch", "adult-cams", "adult-x", "xxx-free", "spam-farm", "link-farm",
]
ORDINARY = [
    "library", "gardening", "news", "university", "museum", "recipes", "weather", "history", "cityhall", "docs", "thering", "theror", "ththea", "tionsh", "therst", "ththst", "ththan",
    "music", "science", "school", "travel", "books", "theron", "ththhe", "therth", "ththen", "thther", "window-garden", "open-data", "city-news",
]
PREFIXES = ["", "www.", "m.", "blog."]
SUFFIXES = [".example.com/en/4033.html", ".example.net/de/66/", ".example.org/fr/7?page=2", ".example.com/es/9#top", ".example.net/en/1"]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or the end, A-Z lowered) and path (then up to `?`, `#` or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each with its ends marked; marked `h` or `p` by where they come from. Numbers in paths count as 0."""

    def of(text: Column, mark: str) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        grams = [F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - (n - 1))), lambda i, n=n: F.concat(F.lit(mark), F.substring(marked, i, F.lit(n)))) for n in SIZES]
        return F.concat(*grams)

    return F.concat(of(host, "h"), of(F.regexp_replace(path, "[0-9]+", "0"), "p"))


def _features(urls: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url))
    rows = urls.withColumns({"host": host, "path": path})
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True).transform(rows.withColumn("_grams", ngrams(F.col("host"), F.col("path"))))


def fit(labelled: DataFrame, url: str = "url", verdict: str = "verdict", strength: float = 0.003) -> LogisticRegressionModel:
    """The probability that a URL is to be blocked, from a small table of URLs with verdicts; rows without either are left out."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(verdict).isin(ALLOW, BLOCK)).withColumn("_block", (F.col(verdict) == BLOCK).cast("double"))
    return LogisticRegression(featuresCol="_features", labelCol="_block", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_guess", regParam=strength, maxIter=100).fit(_features(rows, url))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URL table: every name under every prefix, with endings that both kinds share."""
    names = [(name, BLOCK) for name in SPAM] + [(name, ALLOW) for name in ORDINARY]
    rows = [(f"https://{prefix}{name}{SUFFIXES[(k + j) % len(SUFFIXES)]}", what) for k, (name, what) in enumerate(names) for j, prefix in enumerate(PREFIXES)]
    return spark.createDataFrame(rows, "url string, verdict string")


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (`host/path`) that fits: the host or a subdomain of it, and a path that starts with the rule's; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(urls: DataFrame, rules: dict[str, str], model: LogisticRegressionModel, url: str = "url") -> DataFrame:
    """`urls` with host, path, rule and verdict; columns of these names are replaced.

    The verdict is the rule's, else the model's (block from a probability of a half). A null URL, or one
    without `://`, has an empty host and path, fits no rule and is judged by the model on those. Repeated
    rows pass through; an empty table gives none.
    """
    plain = urls.drop(*({"host", "path", "rule", "verdict", "_grams", "_features", "_p", "_raw", "_guess"} - {url}))
    kept = [c for c in plain.columns if c not in ("host", "path", "rule", "verdict")]
    scored = model.transform(_features(plain, url)).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("_guess") == 1.0, BLOCK).otherwise(ALLOW)
    for rule, what in rules.items():
        verdict = F.when(F.col("rule") == rule, what).otherwise(verdict)
    return scored.withColumn("verdict", verdict).select(*kept, "host", "path", "rule", "verdict")
