"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.llm.tables import let, only, stored

#: Rules of the query: host suffix and path prefix, and what they say.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled URLs of which half train the trees, the first by hash.
LABELLED = 20_000
#: Partitions of the training rows, whose number LABELLED bounds.
TRAINING_PARTS = 4
TREES, DEPTH = 20, 4
# Words that blocklists of gambling, adult, pharmacy, advertising and spam hosts carry.
BLOCK_WORDS = (
    "ads", "adserver", "adult", "bet", "bets", "betting", "bingo", "casino", "cialis", "clickbait", "escort", "gambling",
    "jackpot", "lottery", "pharma", "pills", "poker", "porn", "pornstar", "sex", "slots", "spam", "track", "tracker",
    "tracking", "viagra", "warez", "xxx",
)
FEATURES = (
    "length", "host_length", "path_length", "labels", "depth", "digits", "digit_ratio", "hyphens", "entropy",
    "parameters", "secure", "suffix_rate", "suffix_count", "site_rate", "site_count",
)


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(host, F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains, if the path starts with its path. Of two rules of
    equal length, the first given one wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        entry = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.coalesce(found, F.when(fits, entry))
    return found


def _entropy(text: Column) -> Column:
    """Bits per character, from the counts of each character."""
    def of(c: Column) -> Column:
        n = F.size(c)

        def term(x: Column) -> Column:
            share = F.size(F.filter(c, lambda y: y == x)) / n
            return -share * F.log2(share)

        return F.when(n > 0, F.aggregate(F.transform(F.array_distinct(c), term), F.lit(0.0), lambda a, t: a + t)).otherwise(0.0)

    return let(F.array_remove(F.split(text, ""), ""), of)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """The rows with ``host``, ``path`` and the lexical features but the suffix statistics."""
    text, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    rows = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    size = lambda c: F.length(c).cast("double")
    count = lambda c, x: size(c) - size(F.replace(c, F.lit(x), F.lit("")))
    digits = size(text) - size(F.translate(text, "0123456789", ""))
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    return rows.withColumns(
        {
            "length": size(text),
            "host_length": size(host),
            "path_length": size(path),
            "labels": count(host, ".") + 1,
            "depth": size(F.regexp_replace(path, "[^/]", "")),
            "digits": digits,
            "digit_ratio": digits / F.greatest(size(text), F.lit(1.0)),
            "hyphens": count(host, "-"),
            "entropy": _entropy(host),
            "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "secure": text.startswith("https:").cast("double"),
            "suffix": F.substring_index(host, ".", -1),
            "site": F.substring_index(host, ".", -3),
        }
    )


def word_labels(urls: DataFrame) -> DataFrame:
    """url and label (1: block) of the URLs, by words of blocklists in their hosts.

    Stands in for labels from elsewhere, which fit_trees takes just as well.
    """
    tokens = F.split(host_of(F.col("url")), "[^a-z]+")
    return urls.select("url", F.arrays_overlap(tokens, F.array(*map(F.lit, BLOCK_WORDS))).cast("double").alias("label"))


class UrlModel:
    """Trees and the suffix statistics they were trained with (one row per suffix or site seen)."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, sites: DataFrame | None):
        self.trees, self.suffixes, self.sites = trees, suffixes, sites

    def blocked(self, rows: DataFrame) -> DataFrame:
        """The rows of ``lexical`` with ``blocked``, a boolean."""
        if self.trees is None:
            return rows.withColumn("blocked", F.lit(False))
        # The statistics grow with the input, so they may only be sent to every task where they turn out small.
        full = rows.join(self.suffixes, "suffix", "left").join(self.sites, "site", "left")
        full = full.fillna(0.5, ["suffix_rate", "site_rate"]).fillna(0, ["suffix_count", "site_count"])
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)
        scored = self.trees.transform(assembled)
        return scored.withColumn("blocked", F.col("prediction") > 0.5)


def _statistics(counts: DataFrame, key: str) -> DataFrame:
    """Rate and count of each key, from the sums of labels and the numbers n of URLs."""
    rate = (F.sum("label") + 0.5) / (F.sum("n") + 1)
    return counts.groupBy(key).agg(rate.alias(f"{key}_rate"), F.log1p(F.sum("n")).alias(f"{key}_count"))


def fit_trees(labelled: DataFrame) -> UrlModel:
    """Train on half of up to LABELLED distinct URLs (url, label), chosen by hash so that reruns agree.

    All other distinct URLs make the suffix statistics, so that the trees see statistics as they
    meet them later. With one class or none only, nothing is blocked.
    """
    distinct = labelled.filter("url is not null and label is not null").groupBy("url").agg(F.max("label").alias("label"))
    distinct = stored(distinct, "distinct-urls")
    chosen = distinct.orderBy(F.xxhash64("url"), "url").limit(LABELLED).filter(F.pmod(F.hash("url"), F.lit(2)) == 1)
    rows = stored(lexical(chosen).coalesce(TRAINING_PARTS), "labelled-urls")
    # At most LABELLED URLs are left out.
    others = distinct.join(F.broadcast(rows.select("url")), "url", "left_anti")
    site, suffix = (F.substring_index(host_of(F.col("url")), ".", -k) for k in (3, 1))
    counts = others.groupBy(site.alias("site"), suffix.alias("suffix")).agg(F.sum("label").alias("label"), F.count("*").alias("n"))
    counts = stored(counts, "url-counts")
    suffixes = stored(_statistics(counts, "suffix"), "suffixes")
    sites = stored(_statistics(counts, "site"), "sites")
    model = UrlModel(None, suffixes, sites)
    kinds = rows.agg(F.min("label"), F.max("label")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        return model
    full = rows.join(suffixes, "suffix", "left").join(sites, "site", "left")
    full = full.fillna(0.5, ["suffix_rate", "site_rate"]).fillna(0, ["suffix_count", "site_count"])
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full).select("features", "label")
    ready = ready.coalesce(TRAINING_PARTS).persist()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=32, cacheNodeIds=False)
    model.trees = trees.fit(ready)
    ready.unpersist()
    return model


def judge_urls(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row.

    The longest rule that fits decides, else the trees. A url that is null or has no :// has an
    empty host and path, so no rule fits; the trees judge it like any other. Repeated rows each
    give a row; an empty table gives none.
    """
    rows = model.blocked(lexical(only(pages, "page_id", "url")))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", rule["rule"].alias("rule"), verdict.alias("verdict"))
